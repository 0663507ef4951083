"""Queries over the driver tables with equivalent SQL."""

from importlib import import_module

_MODULES = ("cleaning", "funds", "questions", "chunking", "retrieval")


def _load() -> None:
    for name in ("views", *_MODULES):
        import_module(f"{__name__}.{name}")


def queries():
    from fundweave.workload.catalog import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql():
    from fundweave.workload.catalog import SQL

    _load()
    return dict(SQL)
