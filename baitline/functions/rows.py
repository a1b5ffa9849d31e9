"""Array-to-rows helper.

``inline(transform(arr, (x, i) -> struct(i + 1 AS pos, ...)))`` is used instead
of ``posexplode``: the filter Spark infers from an explode (non-empty array) is
pushed down through every alias of a long projection chain and makes planning
time explode on deep rule pipelines, while ``inline`` keeps the plan small.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positioned(arr: Column, fields: list[str] | None = None, pos: str = "pos",
               value: str = "value") -> Column:
    """Generator of ``(pos, field...)`` rows; ``fields=None`` for arrays of scalars."""
    def row(x, i):
        cols = [x[f].alias(f) for f in fields] if fields else [x.alias(value)]
        return F.struct((i + 1).cast("int").alias(pos), *cols)
    return F.inline(F.transform(arr, row))
