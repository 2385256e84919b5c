"""Argument checks shared by the operators."""

from __future__ import annotations


def positive(**values: int) -> None:
    """Raise ValueError unless every given value is an integer of at least 1."""
    for name, value in values.items():
        if isinstance(value, bool) or not isinstance(value, int) or value < 1:
            raise ValueError(f"{name} must be an integer of at least 1, got {value!r}")


def one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, got {value!r}")
