"""Errors of the engine."""


class EngineError(Exception):
    pass


class SchemaMismatch(EngineError):
    """A column, kind or table definition doesn't fit."""


class ConstraintViolation(EngineError):
    """NOT NULL or UNIQUE is broken."""


class DuplicateKey(EngineError):
    pass


class InvalidQuery(EngineError):
    pass


class TableNotFound(EngineError):
    pass


class NotFound(EngineError):
    pass


class TransactionAborted(EngineError):
    pass
