"""Training-data operators.  Nothing outside this package imports it."""

from __future__ import annotations


def queries() -> dict:
    """The opN_<name> queries and the pipeline of corpus_pipeline.py."""
    from . import registry

    return registry.queries()


def oracle_sql() -> dict:
    from . import registry

    return registry.oracle_sql()
