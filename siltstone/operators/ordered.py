"""Running values over the ordered rows of a key without one task a key.

Rows are range-sorted by key and order, so that a key with a third of all rows lies in many partitions;
these are written, and their numbers (``piece``) stay.  Values run inside each piece, and a second, tiny
pass carries what a key's earlier pieces leave: at most a row a piece, which every task gets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.scratch import shared_folder, written


#: Pieces; by default Spark's number of shuffle partitions, fewer where rows are few.
PIECES: int | None = None


class Ordered:
    """``df`` in pieces; ``order`` must tell all rows of a key apart for results that do not depend on luck.

    Null keys are a key like others.  ``df`` may have no column of the names piece, _value, _carried.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str]):
        cut = df.repartitionByRange(*([PIECES] if PIECES else []), *keys, *order).withColumn("piece", F.spark_partition_id())
        self.df, self.keys, self.order = written(cut, shared_folder(df.sparkSession, "pieces")), keys, order

    def _carry(self, name: str, local: Column, left: Column, before, joined, value: Column) -> Ordered:
        """``name`` from the value inside the piece (``local``) and what earlier pieces leave: ``before`` over their ``left``."""
        rows = self.df.withColumn("_value", value)
        earlier = Window.partitionBy(*self.keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        ends = rows.groupBy(*self.keys, "piece").agg(left.alias("_left"))
        carry = ends.withColumn("_carried", before(F.col("_left")).over(earlier)).where("_carried IS NOT NULL")
        carry = F.broadcast(carry.select(*[F.col(k).alias(f"_{k}") for k in self.keys], F.col("piece").alias("_piece"), "_carried"))
        same = F.col("piece") == F.col("_piece")
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = rows.withColumn(name, local).join(carry, same, "left").withColumn(name, joined(F.col(name), F.col("_carried")))
        self.df = out.drop("_value", "_left", "_carried", "_piece", *[f"_{k}" for k in self.keys])
        return self

    def _frame(self, inclusive: bool):
        here = Window.partitionBy("piece", *self.keys).orderBy(*self.order)
        return here.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    def running_sum(self, name: str, value: Column, inclusive: bool = True) -> Ordered:
        """Column ``name``: the sum of the key's values up to the row (without it unless ``inclusive``)."""
        both = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        return self._carry(name, F.sum("_value").over(self._frame(inclusive)), F.sum("_value"), F.sum, both, value)

    def running_min(self, name: str, value: Column, inclusive: bool = True) -> Ordered:
        """Column ``name``: the least of the key's values up to the row (without it unless ``inclusive``); nulls are skipped."""
        return self._carry(name, F.min("_value").over(self._frame(inclusive)), F.min("_value"), F.min, F.least, value)

    def last_known(self, name: str, value: Column, inclusive: bool = True) -> Ordered:
        """Column ``name``: the key's last value that is not null, up to the row (without it unless ``inclusive``)."""
        left = F.max_by(F.col("_value"), F.when(F.col("_value").isNotNull(), F.struct(*self.order)))
        return self._carry(name, F.last("_value", True).over(self._frame(inclusive)), left, lambda c: F.last(c, True), F.coalesce, value)

    def result(self) -> DataFrame:
        return self.df.drop("piece")


def as_of(rows: DataFrame, states: DataFrame, key: str, time: str, row_id: str, state: str) -> DataFrame:
    """``rows`` with ``state``: the value of the latest of ``states`` (key, time, row_id, state) of the key at or before the row's time.

    Of states of one time the one of the greatest ``row_id`` counts; without any, or with a null time, it
    is null.  ``rows`` has no column of that name.
    """
    columns = [c for c in rows.columns if c not in (key, time, row_id)]
    left = rows.select(key, time, F.lit(1).alias("_kind"), row_id, F.struct(F.lit(1), *columns).alias("_rest"), F.lit(None).cast(dict(states.dtypes)[state]).alias("_state"))
    right = states.where(F.col(time).isNotNull() & F.col(state).isNotNull()).select(key, time, F.lit(0).alias("_kind"), row_id, F.lit(None).alias("_rest"), F.col(state).alias("_state"))
    both = Ordered(left.unionByName(right), [key], [time, "_kind", row_id]).last_known(state, F.col("_state")).result()
    return both.where("_kind = 1").select(key, time, row_id, *[F.col(f"_rest.{c}").alias(c) for c in columns], state)
