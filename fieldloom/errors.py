"""Errors by category, and warnings that are given once."""

from __future__ import annotations

import logging


class FieldError(Exception):
    category = "General"

    def __init__(self, where: str, message: str, hint: str = ""):
        self.where, self.message, self.hint = where, message, hint
        super().__init__(f"FieldError[{self.category}] {where}: {message}" + (f" (hint: {hint})" if hint else ""))


class ConfigError(FieldError):
    category = "Config"


class DeviceError(FieldError):
    category = "Device"


class ValidationError(FieldError):
    category = "Validation"


class NumericsError(FieldError):
    category = "Numerics"


class IOFailure(FieldError):
    category = "IO"


_WARNED: set[str] = set()


def warn_once(key: str, message: str) -> bool:
    """Log a warning the first time a key is seen."""
    if key in _WARNED:
        return False
    _WARNED.add(key)
    logging.getLogger("fieldloom").warning(message)
    return True
