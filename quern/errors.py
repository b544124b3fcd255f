"""Errors with codes."""


class QuernError(Exception):
    code = 1000


class ParameterError(QuernError, ValueError):
    code = 1100


class SourceError(QuernError):
    code = 1200


class SchemaMismatch(QuernError):
    code = 1300


class ModelError(QuernError):
    code = 1400
