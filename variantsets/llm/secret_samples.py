"""Made-up secrets and look-alikes, put into real windows of text to train and to test the secret tagger.

Patterns only label what they match, so a tagger that is trained on them alone learns
them again. Here, tokens of the shapes that services give out, and passwords
stand in the phrases that people write about them, and strings of like length or
characters (addresses, dates, paths, names) and sentences on secrets that hold none are
the counter-examples.
"""

from __future__ import annotations

import random
import string

B, I, O = 0, 1, 2

LOWER, UPPER, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
BASE62 = LOWER + UPPER + DIGITS
_HEX = DIGITS + "abcdef"
_SYLLABLES = "ba be bo da de di fa go ka ki la le lo ma me mi na ne no pa ra re ri ro sa se si ta te ti to va vi zu th er an in on st ing tion ard ent".split()

#: Prefixes that services put before their tokens, with the length of the rest. The last three are for tests only.
PREFIXES = [("ghp_", 36), ("gho_", 36), ("glpat-", 20), ("xoxb-", 40), ("xoxp-", 48), ("sk_live_", 24), ("pk_test_", 24), ("rk_live_", 24), ("AIza", 35), ("SG.", 43), ("sk-", 48), ("npm_", 36), ("dop_v1_", 40), ("key-", 32), ("EAAC", 60), ("shpat_", 32), ("pypi-", 60), ("whsec_", 32)]
UNSEEN_PREFIXES = 3
LEADS = ["password", "Password", "passwd", "passphrase", "pwd", "secret", "token", "credential", "credentials", "api key", "access key", "access token", "auth token", "private key", "client secret", "login", "secret key", "bearer token"]


class Maker:
    """Sequences of (token, tag); ``unseen`` also takes the prefixes kept for tests."""

    def __init__(self, rng: random.Random, unseen: bool = False):
        self.rng = rng
        self.prefixes = PREFIXES[-UNSEEN_PREFIXES:] if unseen else PREFIXES[:-UNSEEN_PREFIXES]

    def chars(self, of: str, n: int) -> str:
        return "".join(self.rng.choice(of) for _ in range(n))

    def word(self, least: int = 1, most: int = 4) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(least, most)))

    def key(self) -> str:
        """A string as a service gives out."""
        r = self.rng
        kind = r.randrange(6)
        if kind < 2:
            prefix, n = r.choice(self.prefixes)
            if prefix[-1] == "-" and r.random() < 0.5:  # in parts
                return f"{prefix}{self.chars(DIGITS, r.randint(8, 13))}-{self.chars(r.choice([BASE62, LOWER + DIGITS, LOWER]), r.randint(10, 24))}"
            return prefix + self.chars(BASE62, n)
        if kind == 2:
            return self.chars(BASE62 + "+/", 40)
        if kind == 3:
            return ".".join(["eyJ" + self.chars(BASE62, r.randint(17, 30)), "eyJ" + self.chars(BASE62 + "-_", r.randint(30, 60)), self.chars(BASE62 + "-_", 43)])
        if kind == 4:
            return self.chars(BASE62, r.choice([20, 24, 32, 40, 64]))
        return self.chars(BASE62 + "+/", r.choice([42, 62, 86])) + "=="

    def password(self) -> str:
        """A string as a person chooses."""
        r = self.rng
        kind = r.randrange(5)
        if kind == 0:
            return self.word(2, 4) + self.chars(DIGITS, r.randint(1, 4)) + r.choice(["", "!", "#", "$"])
        if kind == 1:
            return self.word(1, 3).capitalize() + r.choice("@_-.!$") + self.chars(DIGITS, r.randint(2, 4)) + self.word(1, 2)
        if kind == 2:
            return self.chars(BASE62 + "!@#$%^&*-_", r.randint(8, 20))
        if kind == 3:
            return self.word(7, 11)
        return self.chars(LOWER + DIGITS, r.randint(8, 16))

    def secret(self) -> list[tuple[str, int]]:
        r = self.rng
        lead = r.choice(LEADS).split()
        words = lambda s: [(w, O) for w in s.split()]
        end = r.choice(["", "", ".", ",", ";"])
        kind = r.randrange(9)
        if kind == 0:  # stands alone
            return [(r.choice(["", "", "'", '"', "("]) + self.key() + end, B)]
        if kind == 1:
            return [("Authorization:", O), ("Bearer", O), (self.key(), B)]
        if kind in (2, 3):
            return words(r.choice(["the", "my", "your", "our", ""])) + words(" ".join(lead)) + words(r.choice(["is", "was", "is now", "->", "=", ":", "-"])) + [(self.password() + end, B)]
        if kind == 4:
            return words(" ".join(lead)) + words(r.choice(["is", "=", ":", ""])) + [(self.key() + end, B)]
        if kind == 5:
            lead[-1] += ":"
            return words(" ".join(lead)) + [(self.password() if r.random() < 0.7 else self.key(), B)]
        if kind == 6:
            return words(r.choice(["credentials:", "login:", "login with", "credentials"])) + [(self.word(1, 3), O)] + words(r.choice(["/", "and", ":"])) + [(self.password() + end, B)]
        if kind == 7:
            return [(f"{self.word(1, 1)}{r.choice(['db', 'sql', 'amqp', 'http', 'redis'])}://{self.word(1, 2)}:{self.password()}@{self.word(2, 3)}.{self.word(1, 1)}:{self.chars(DIGITS, 4)}/{self.word(1, 2)}", B)]
        return words("-----BEGIN PRIVATE KEY-----") + [(self.chars(BASE62 + "+/", 64), B), (self.chars(BASE62 + "+/", 64), I), (self.chars(BASE62 + "+/", r.randint(20, 64)), I)] + words("-----END PRIVATE KEY-----")

    def innocent(self) -> list[tuple[str, int]]:
        r = self.rng
        d = lambda n: self.chars(DIGITS, n)
        kind = r.randrange(20)
        if kind == 0:
            said = r.choice(["is required", "is missing", "was changed", "is wrong", "has expired", "must be long", "was sent to you", "is kept safe", "should never be shared", "field of the form", "of the garden", "and the key"])
            text = f"{r.choice(['the', 'a', 'your', 'this'])} {r.choice(LEADS)} {said}"
        elif kind == 1:
            text = f"{r.choice(LEADS)}{r.choice([':', ' :', ' is', ' =', ''])} {r.choice(['required', 'missing', 'none', 'null', 'empty', 'short', self.word(1, 3), self.word(1, 4)])}"
        elif kind == 2:
            text = r.choice(["bearer of bad news", "a token of thanks", "the secret garden", "login page", "private life of", "keys to the house", "an open secret", "the author and the authority"])
        elif kind == 3:
            text = "-".join(self.chars(_HEX, n) for n in (8, 4, 4, 4, 12))
        elif kind == 4:
            text = ".".join(str(r.randint(1, 255)) for _ in range(4)) + r.choice(["", ",", "!!", "***", ":" + d(4)])
        elif kind == 5:
            text = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}Z"
        elif kind == 6:
            text = f"https://www.{self.word(2, 3)}.com/{self.word(1, 3)}/{self.word(1, 3)}-{self.word(1, 3)}-{d(r.randint(1, 8))}{r.choice(['', '.html', '?id=' + d(5)])}"
        elif kind == 7:
            text = f"{self.word(1, 3)}.{d(2)}@{self.word(1, 3)}{r.randint(0, 9)}.{self.word(1, 3)}.com"
        elif kind == 8:
            text = f"v{r.randint(0, 30)}.{r.randint(0, 30)}.{r.randint(0, 30)}-{r.choice(['beta', 'rc1', 'alpha.2', 'SNAPSHOT'])}"
        elif kind == 9:
            text = "/" + "/".join(self.word(1, 3) for _ in range(r.randint(2, 6))) + r.choice(["", ".py", ".txt", "_" + d(3) + ".log"])
        elif kind == 10:
            text = self.word(1, 2) + "".join(self.word(1, 2).capitalize() for _ in range(r.randint(2, 4)))
        elif kind == 11:
            text = "_".join(self.word(1, 3) for _ in range(r.randint(2, 5))) + r.choice(["", "()", "_id", "=" + d(2)])
        elif kind >= 17 or kind == 12:
            text = self.word(4, 9) + r.choice(["", "", ".", ","])
        elif kind == 13:
            text = r.choice([f"+{d(2)}-{d(3)}-{d(7)}", f"ISBN {d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(1)}", f"{d(2)},{d(3)},{d(3)}.{d(2)}", f"#{d(6)}", f"({d(3)}) {d(3)}-{d(4)}"])
        elif kind == 14:
            text = f"{'-'.join(self.word(1, 3) for _ in range(r.randint(2, 6)))} {'=' * r.randint(8, 30)}"
        elif kind == 15:
            text = self.word(2, 5).upper() + r.choice(["", "!!", ".!!", ",!!", "***"])
        else:
            text = f"<{self.word(1, 2)} {self.word(1, 2)}=\"{self.word(1, 3)}-{d(2)}\"> {self.word(1, 2)}={self.word(1, 3)};"
        return [(w, O) for w in text.split()]
