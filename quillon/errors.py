"""Error hierarchy: one code per class, so callers can switch on ``err.code``."""

from __future__ import annotations


class EngineError(Exception):
    """Base class of every error the engine raises on purpose."""

    code = "INVALID_OPERATION"

    def __init__(self, message: str, **details: object) -> None:
        super().__init__(message)
        self.details = details


class InvalidOperation(EngineError):
    code = "INVALID_OPERATION"


class ColumnNotFound(EngineError):
    code = "COLUMN_NOT_FOUND"

    def __init__(self, name: str, available: list[str] | None = None) -> None:
        super().__init__(f"column {name!r} not found" + (f"; have {available}" if available else ""), column=name, available=available)


class TypeMismatch(EngineError):
    code = "TYPE_MISMATCH"


class ShapeMismatch(EngineError):
    code = "SHAPE_MISMATCH"


class ParseError(EngineError):
    """SQL text that cannot be parsed; ``details`` may hold ``position``."""

    code = "PARSE_ERROR"


class SourceError(EngineError):
    """Reading or writing failed."""

    code = "IO_ERROR"
