"""Queries over the bench tables, one or more per operator, with their SQL counterparts."""


def load():
    """The registry with every query module imported."""
    from stopflow.catalog import (  # noqa: F401
        aggregates,
        end_to_end,
        expressions,
        graphs,
        joins,
        registry,
        scans,
        windows,
    )

    return registry
