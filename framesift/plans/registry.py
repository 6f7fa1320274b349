"""All queries of the library itself, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import advanced, gallery, learning, library, pictures, shelves  # noqa: F401  (the others add their queries to library's)


def queries() -> dict:
    return dict(library.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(library.SQL)
