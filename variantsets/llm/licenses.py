"""License scans: Aho-Corasick over words, and a shunting-yard parser of license expressions.

Texts are reduced to words joined by single blanks, so one automaton finds every
phrase that stands as consecutive words, wherever the text breaks lines or puts
marks. A notice inside a longer one that was found does not count. At each place
where the automaton meets the words of an identifier tag, the expression that
follows in the same line is read from the text: ``and``, ``or``, ``with`` and
brackets are brought to postfix order and evaluated to the set of licenses and
exceptions named and to whether the whole can be taken under permissive terms.
Only known identifiers and references to licenses of the document's own
(``LicenseRef-``) count, so prose after a tag names nothing.

The score is the support for the document stating a license: 1 less the product
of (1 - weight) over the distinct (kind of evidence, label) found, so it is 0
without evidence and at least 0.9 with a tag that names a license.

Defined results: a null or empty text has no words, empty labels and score 0;
repeated rows give repeated results; an expression that does not parse gives the
identifiers up to the fault; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases of the base rule: fixed values.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Further notices that the method knows: fixed values.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache-2",
    "apache software license": "apache-2",
    "licensed under the apache": "apache-2",
    "gnu general public license": "gpl",
    "gnu gpl": "gpl",
    "gplv2": "gpl",
    "gplv3": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu lgpl": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl-2",
    "eclipse public license": "epl-2",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "server side public license": "sspl",
    "business source license": "busl",
    "open software license": "osl",
    "artistic license": "artistic",
    "academic free license": "afl",
    "microsoft public license": "ms-pl",
    "python software foundation license": "psf",
    "boost software license": "bsl",
    "zlib license": "zlib",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons zero": "cc0",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by": "cc-by",
    "cc0": "cc0",
    "free and unencumbered software released into the public domain": "public-domain",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"

#: Stems of public identifiers, which stand before a version, with permissive terms and with others: fixed values.
PERMISSIVE = """
0bsd aal afl apache artistic blueoak bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-2-clause-views bsd-3-clause
bsd-3-clause-attribution bsd-3-clause-clear bsd-4-clause bsd-source-code bsl cc-by cc-pddc cc0 curl ecl fsfap ftl hpnd icu
ijg intel isc json libpng libtiff mit mit-0 mit-cmu ms-pl mulanpsl ncsa nist-pd ntp odc-by ofl openssl pddl php postgresql psf
python ruby sgi-b tcl unicode-3 unicode-dfs unlicense upl w3c wtfpl x11 xnet zlib zlib-acknowledgement zpl
""".split()
OTHERS = """
agpl apsl busl cc-by-nc cc-by-nc-nd cc-by-nc-sa cc-by-nd cc-by-sa cddl cecill cecill-b cecill-c cpal cpl elastic epl eupl gfdl
gpl ipl lgpl lgpllr lppl mpl ms-rl nosl npl odbl osl polyform-noncommercial polyform-small-business qpl rpl sspl
""".split()
#: Labels that are not the stem itself: fixed values.
LABELS = {"apache": "apache-2", "mpl": "mpl-2", "epl": "epl-2", "0bsd": "bsd", "unlicense": "public-domain", "cc-pddc": "public-domain", "mit-0": "mit", "mit-cmu": "mit"}

#: Weight of one piece of evidence of each kind in the score.
WEIGHTS = {"tag": 0.9, "base": 0.8, "notice": 0.5}

_AFTER_TAG = re.compile(r"[ \t]*[:=]?[ \t]*")
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+:-]*[A-Za-z0-9+])", re.A)
_VERSION = re.compile(r"-v?\d+(\.\d+)*$")
_EXCEPTION = re.compile(r"[a-z0-9.+-]+-exception(-[0-9.]+)?|linux-syscall-note")
_OWN = re.compile(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}

_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def identifier(name: str) -> tuple[str, bool] | None:
    """Label and permissiveness; a license of the document's own is its own label and not permissive; None for other words."""
    plain = re.sub(r"(-only|-or-later|\+)$", "", name.lower())
    if _OWN.fullmatch(plain):
        return plain, False
    for stem in (plain, _VERSION.sub("", plain)):
        if stem in PERMISSIVE or stem in OTHERS:
            label = "bsd" if stem.startswith("bsd-") else LABELS.get(stem, stem)
            return label, stem in PERMISSIVE
    return None


def exception(name: str) -> str | None:
    """Label of what may stand after ``with``."""
    low = name.lower()
    return _VERSION.sub("", low) if _EXCEPTION.fullmatch(low) else None


def postfix(text: str, at: int = 0, end: int | None = None) -> list[str]:
    """Shunting-yard: identifiers and operators of the longest valid expression at a place, in postfix order."""
    out: list[str] = []
    ops: list[str] = []
    want, depth, end = True, 0, len(text) if end is None else end
    # Length of the output and the open operators where the expression was last complete: the output only grows.
    good: tuple[int, list[str]] = (0, [])
    while m := _TOKEN.match(text, at, end):
        token = m[1]
        low = token.lower()
        if want and token == "(" and (not ops or ops[-1] != "with"):
            ops.append("(")
            depth += 1
        elif not want and token == ")" and depth:
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
        elif not want and low in _BINDS:
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[low]:
                out.append(ops.pop())
            ops.append(low)
            want = True
        elif want and (exception(token) if ops and ops[-1] == "with" else identifier(token)):
            out.append(token)
            want = False
        else:
            break
        at = m.end()
        if not want and not depth:
            good = len(out), list(ops)
    return out[: good[0]] + good[1][::-1]


def evaluate(rpn: list[str]) -> tuple[set[str], bool]:
    """Labels of the licenses and exceptions named, and whether permissive terms can be had."""
    stack: list[tuple[set[str], bool]] = []
    for token in rpn:
        if token in _BINDS:
            (b, pb), (a, pa_) = stack.pop(), stack.pop()
            # An exception adds permissions but does not change the kind of terms. Sets are handed on, the larger one grown.
            a, b = (a, b) if len(a) >= len(b) else (b, a)
            a |= b
            stack.append((a, pa_ if token == "with" else pa_ or pb if token == "or" else pa_ and pb))
        else:
            label, permissive = identifier(token) or (exception(token), False)
            stack.append(({label}, permissive))
    return stack[-1] if stack else (set(), False)


def expressions(text: str, tag_ends: list[int]) -> list[tuple[set[str], bool]]:
    """What the expressions say that follow tags; ``tag_ends``: ascending numbers of the words after tags."""
    raw = text.encode("utf-8", "surrogatepass")
    # A character for each byte: identifiers are ASCII, and places in bytes and in this string agree.
    chars, wanted, found, line_end = raw.decode("latin-1"), iter(tag_ends), [], -1
    last = next(wanted, None)
    for k, m in enumerate(_WORD.finditer(raw.translate(_WORD_BYTES))):
        if last is None:
            break
        if k + 1 != last:
            continue
        at = m.end()
        if at > line_end:
            line_end = chars.find("\n", at)
            line_end = len(chars) if line_end < 0 else line_end
        if rpn := postfix(chars, _AFTER_TAG.match(chars, at, line_end).end(), line_end):
            found.append(evaluate(rpn))
        last = next(wanted, None)
    return found


def automaton(base: dict[str, str], notices: dict[str, str], tag: str) -> ahocorasick.Automaton:
    found: dict[str, list] = {}
    for kind, phrases in (("base", base), ("notice", notices), ("tag", {tag: ""})):
        for phrase, label in phrases.items():
            found.setdefault(f" {phrase} ", []).append((kind, label, len(phrase) + 1))
    a = ahocorasick.Automaton()
    for phrase, what in found.items():
        a.add_word(phrase, what)
    a.make_automaton()
    return a


def _outermost(notices: list[tuple[int, int, str]], longer: list[tuple[int, int, str]]) -> set[str]:
    """Labels of the notices (start, end, label) that no longer match holds."""
    labels, reach = set(), -1
    held = sorted([(s, -e, 0, label) for s, e, label in longer] + [(s, -e, 1, label) for s, e, label in notices])
    for _, e, notice, label in held:
        if notice and -e > reach:
            labels.add(label)
        reach = max(reach, -e)
    return labels


def scan_text(text: str | None, auto: ahocorasick.Automaton) -> tuple:
    found = words(text)
    joined = f" {b' '.join(found).decode('utf-8', 'surrogatepass')} "
    base, notices, tags = [], [], []
    for end, what in auto.iter(joined):
        for kind, label, back in what:
            {"base": base, "notice": notices, "tag": tags}[kind].append((end - back, end, label))
    base_labels = {label for _, _, label in base}
    evidence = {("base", label) for label in base_labels} | {("notice", label) for label in _outermost(notices, base)}
    permissive = None
    if tags:
        for named, ok in expressions(text, _words_before(joined, [end for _, end, _ in tags])):
            evidence |= {("tag", label) for label in named}
            permissive = ok if permissive is None else permissive and ok
    at = _words_before(joined, [min(base)[0], max(base)[0]]) if base else [None, None]
    doubt = 1.0
    for kind, _ in sorted(evidence):
        doubt *= 1 - WEIGHTS[kind]
    return len(found), len(base), *at, ",".join(sorted(base_labels)), ",".join(sorted({label for _, label in evidence})), 1 - doubt, permissive


def _words_before(joined: str, places: list[int]) -> list[int]:
    """How many words end before each of the ascending places, which are blanks."""
    out, n, at = [], 0, 0
    for place in places:
        n += joined.count(" ", at, place)
        at = place
        out.append(n)
    return out


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    auto = automaton(BASE, NOTICES, TAG)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
    names = [c.split()[0] for c in SCAN.split(", ")]
    for batch in batches:
        rows = [scan_text(t, auto) for t in batch.column("text").to_pylist()]
        cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *cols], names)


def license_scan(docs: DataFrame) -> DataFrame:
    """A row per document: counts, places and labels of licenses, a score, and whether tags allow permissive terms (null without tags)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scanner, SCAN)
