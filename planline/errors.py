"""Refusals: an answer that cannot be given says why, before the work."""

from __future__ import annotations


class Refusal(ValueError):
    """``code``, ``message`` and a ``hint`` on what to ask instead."""

    def __init__(self, code: str, message: str, hint: str = ""):
        super().__init__(f"{code}: {message}" + (f" ({hint})" if hint else ""))
        self.code, self.message, self.hint = code, message, hint


def refuse_empty(**filters: str | None) -> None:
    """An empty string is a refused filter, never 'no filter'."""
    for name, value in filters.items():
        if value is not None and value == "":
            raise Refusal("empty_filter", f"{name} is empty", "leave it out for no filter")


def refuse_oversize(what: str, size: int, limit: int, hint: str = "") -> None:
    if size > limit:
        raise Refusal("too_large", f"{what}: {size} is over the limit of {limit}", hint)
