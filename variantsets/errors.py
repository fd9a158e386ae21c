"""Errors with the codes of the command line."""

from __future__ import annotations


class VariantQueryError(Exception):
    """Base of all errors; ``code`` is the exit code before the shell reduces it."""

    code = 1

    def __init__(self, message: str, code: int | None = None):
        super().__init__(message)
        if code is not None:
            self.code = code


class QuerySyntaxError(VariantQueryError):
    code = 1


class NoSuchGenome(VariantQueryError):
    code = 600


class InputError(VariantQueryError):
    code = 5000


class DuplicateSample(VariantQueryError):
    code = 5005


class UnknownChromosome(VariantQueryError):
    code = 6001


class BadBounds(VariantQueryError):
    code = 6002


class BadVariant(VariantQueryError):
    code = 7000


class UnknownVariantChromosome(VariantQueryError):
    code = 7001


class BadNameFile(VariantQueryError):
    code = 9001


class BinsNeedOneRegion(VariantQueryError):
    code = 10000


class IndexExists(VariantQueryError):
    code = 5003


class IndexNotOpen(VariantQueryError):
    code = 701


class UnreadableVcf(VariantQueryError):
    code = 7100


class NoNameFile(VariantQueryError):
    code = 9000


class NoListFile(VariantQueryError):
    code = 10001
