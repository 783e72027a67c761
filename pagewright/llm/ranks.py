"""Gapless positions within groups, however large one of them is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import durable, narrow


def ranked(rows: DataFrame, group: list[str], order: list[str], running: Column | None = None) -> DataFrame:
    """rows (durable from here on) with ``at`` (position within group by order, from 0, nulls first) and ``n`` (rows of the group); with running also ``upto``, its sum over the group up to this row.

    Rows are sorted by range, equal ones by where they came from, so a group or a run of equal rows may fill any number of tasks. Each
    task numbers its own rows; what earlier tasks hold of a group is summed over one row a task and group. Group columns may be null.
    """
    where = rows.withColumn("__from", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order, "__from"]]
    sorted_ = where.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__from")
    kept = durable(sorted_.withColumn("__row", F.monotonically_increasing_id()))  # the task in the upper bits, the row in the lower 33
    kept = kept.withColumn("__part", F.shiftright("__row", 33))
    sums = [F.min("__row").alias("__first"), F.count("*").alias("__n")] + ([F.sum(running).alias("__sum")] if running is not None else [])
    parts = kept.groupBy("__part", *group).agg(*sums)
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(*group)
    found = {"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "n": F.sum("__n").over(own)}
    if running is not None:
        found["__sofar"] = F.coalesce(F.sum("__sum").over(before), F.lit(0))
    parts = narrow(durable(parts.withColumns(found).withColumnsRenamed({c: f"__g{k}" for k, c in enumerate(group)} | {"__part": "__p"})))
    same = F.col("__part") == F.col("__p")
    for k, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"__g{k}"))
    if running is not None:
        within = Window.partitionBy("__part", *group).orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
        kept = kept.withColumn("upto", F.sum(running).over(within))
    at = (F.col("__before") + F.col("__row") - F.col("__first")).alias("at")
    upto = [(F.col("__sofar") + F.col("upto")).alias("upto")] if running is not None else []
    return kept.join(parts, same).select(*rows.columns, at, "n", *upto)
