"""Numbers and running sums over large groups without one window per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts of a whole table's numbering that one window adds up.
PARTS = 4096


def dense_positions(table: DataFrame, order: str, name: str = "position") -> DataFrame:
    """Numbers from 1 by ``order``, a column of distinct longs whose high bits spread the rows.

    Rows are counted by the number's high part first, and the parts by a higher one; only those counts are added up in
    order, then rows are numbered within their part.
    """
    parts = table.withColumn("part", F.expr(f"{order} div 65536"))
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("super", F.expr(f"part div {PARTS}"))
    above = counts.groupBy("super").agg(F.sum("n").alias("n"))
    above = above.select("super", F.coalesce(F.sum("n").over(Window.orderBy("super").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("super").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("before", before).join(above, "super").select("part", (F.col("before") + F.col("above")).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return parts.join(offsets, "part").withColumn(name, F.col("offset") + within).drop("part", "offset")


def sum_before(table: DataFrame, keys: list[str], order: list[str], value: Column, name: str, span: int = 65536) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same ``keys`` that come before by ``order``, 0 for the first.

    The first column of ``order`` is a long; it cuts a group into spans, whose sums are added up first, so that a group is no single window.
    """
    parts = table.withColumns({"part": F.expr(f"{order[0]} div {span}"), "value_": value})
    sums = parts.groupBy(*keys, "part").agg(F.sum("value_").alias("n"))
    first = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "part", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.join(offsets, [*keys, "part"]).withColumn(name, F.col("offset") + F.coalesce(F.sum("value_").over(within), F.lit(0)))
    return summed.drop("part", "value_", "offset")


def with_tail(table: DataFrame, order: str, span: int, tail: int) -> DataFrame:
    """Rows dealt to spans of ``order``, each also to the next span if it is within ``tail`` of its end.

    Adds ``span_`` and ``own_``: a window over (keys, span_) that looks back ``tail`` is whole for the rows that are ``own_``.
    """
    at = F.expr(f"{order} div {span}")
    spans = F.when(F.expr(f"{order} % {span}") >= span - tail, F.array(at, at + 1)).otherwise(F.array(at))
    return table.withColumn("span_", F.explode(spans)).withColumn("own_", F.col("span_") == at)
