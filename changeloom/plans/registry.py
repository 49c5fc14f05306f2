"""All queries of this library and their SQL."""

from __future__ import annotations

from changeloom.plans import catalog, catalog_entries, catalog_sources, catalog_streams  # noqa: F401  they register their queries


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLE)
