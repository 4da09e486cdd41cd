"""Joins whose keys may be hot: the few keys that hold many rows are broadcast, the others shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot; so there are at most ``1 / SHARE`` hot keys.
SHARE = 0.001
#: A key of fewer rows is never hot.
FLOOR = 64


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` inner-joined with ``table``, which has one row a key and in ``count`` how many of ``rows`` have it.

    Rows of hot keys meet their key by broadcast (at most ``1 / SHARE`` rows of ``table``, by the sum
    of the counts), where they are; only the others are shuffled by key.  Keys are not null.  The result
    has the columns of ``rows``, then those of ``table`` without the keys.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]  # one row
    least = max(FLOOR, int(total * SHARE))
    hot = table.where(F.col(count) > least)
    rest = [c for c in table.columns if c not in keys]
    if hot.isEmpty():
        return rows.join(table, keys).select(*rows.columns, *rest)
    few = F.broadcast(hot)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(count) <= least), keys)
    return rows.join(few, keys).select(*rows.columns, *rest).unionByName(cold.select(*rows.columns, *rest))
