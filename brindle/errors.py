"""Errors by code.  ``Unsupported`` is understood and declined; ``InvalidArgument`` is wrong."""

from __future__ import annotations


class EngineError(Exception):
    """``code``: its name; ``byte``: where in the statement, if known; ``retryable``: whether trying again can help."""

    retryable = False

    def __init__(self, message: str, byte: int | None = None):
        super().__init__(message if byte is None else f"{message} (byte {byte})")
        self.byte = byte

    @property
    def code(self) -> str:
        return type(self).__name__


class InvalidArgument(EngineError):
    pass


class Unsupported(EngineError):
    pass


class NotFound(EngineError):
    pass


class AlreadyExists(EngineError):
    pass


class OutOfRange(EngineError):
    pass


class CardinalityViolation(EngineError):
    pass


class ResourceExhausted(EngineError):
    pass


class FkViolation(EngineError):
    pass


class AssertionViolation(EngineError):
    pass


class TxnConflict(EngineError):
    retryable = True


#: What a text reply calls the codes that clients act on.
REPLY_TOKENS = {"TxnConflict": "TXN_CONFLICT", "FkViolation": "FK_VIOLATION", "AssertionViolation": "ASSERTION_VIOLATION"}


def reply(error: EngineError) -> str:
    """The one-line reply for an error."""
    token = REPLY_TOKENS.get(error.code)
    return f"ERR {token} retryable={int(error.retryable)} {error}" if token else f"ERR {error}"
