"""Bounds of requests.  Values out of range are errors, never clamped."""

from __future__ import annotations

#: Fixed values.
MAX_QUERY_BYTES = 16 * 1024
MAX_IDENTIFIER_BYTES = 4 * 1024
MAX_RESULTS = 100
MAX_CANDIDATES = 400
MAX_DEPTH = 20
MAX_NODES = 10_000
MAX_EDGES = 100_000
MAX_TERMS = 64
MAX_ITERATIONS = 1_000
MAX_NODE_LINES = 2_000
MAX_NODE_CHARS = 64_000
MAX_RELATIONSHIPS = 8
MAX_FILES = 1_000


class BudgetError(ValueError):
    """A request or its work is out of bounds."""


def text(value: str, what: str = "query", most: int = MAX_QUERY_BYTES) -> str:
    if not value.strip():
        raise BudgetError(f"{what} must not be empty")
    if len(value.encode()) > most:
        raise BudgetError(f"{what} exceeds the {most}-byte limit")
    return value


def identifier(value: str) -> str:
    return text(value, "identifier", MAX_IDENTIFIER_BYTES)


def between(value: int, most: int, what: str, least: int = 1) -> int:
    if not least <= value <= most:
        raise BudgetError(f"{what} must be between {least} and {most}")
    return value


def limit(value: int) -> int:
    return between(value, MAX_RESULTS, "result limit")


def depth(value: int) -> int:
    return between(value, MAX_DEPTH, "traversal depth")


def terms(values: list[str]) -> list[str]:
    if len(values) > MAX_TERMS:
        raise BudgetError(f"query exceeds the {MAX_TERMS}-term limit")
    return values
