"""Named queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

import functools
import inspect
import textwrap

from ..session import tune

QUERIES: dict = {}
ORACLE: dict = {}


def query(function=None, *, sql: str | None = None):
    """Register a (spark, sf_dir) function under its own name."""
    def add(fn):
        @functools.wraps(fn)
        def tuned(spark, sf):
            return fn(tune(spark), sf)

        QUERIES[fn.__name__] = tuned
        if sql:
            ORACLE[fn.__name__] = textwrap.dedent(inspect.cleandoc(sql))
        return fn

    return add(function) if function else add
