"""Errors by code."""

from __future__ import annotations

#: The error codes.
CODES = ("invalid_argument", "not_found", "already_exists", "permission_denied", "failed_precondition", "resource_exhausted", "unavailable", "not_supported", "corruption", "internal")


class CairnError(Exception):
    """An error with one of ``CODES``."""

    def __init__(self, code: str, message: str) -> None:
        assert code in CODES
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


def invalid(message: str) -> CairnError:
    return CairnError("invalid_argument", message)


def unsupported(message: str) -> CairnError:
    return CairnError("not_supported", message)
