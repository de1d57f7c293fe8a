"""Sharding by minimax contiguous partition, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, columns

SHARDS = 16
#: Equal texts share a cell of the text's hash; cells, in hash order, are the atomic groups that shards are cut from.
#: Their number is fixed, so the size list stays this small however many rows there are.
CELL_HEX = 4
#: Rows that one window of the slot numbering holds on average.
SLOT_ROWS = 4096


def _fold(capacity: Column, groups: Column) -> Column:
    """Greedy cut of the ordered (at, size) groups: closed shards, open load, and where each shard starts.

    A group above the capacity stands alone: it bounds the largest shard whatever else is done, and so the
    capacity that is searched is that of the shards of several groups.
    """
    empty = F.struct(F.lit(0).alias("closed"), F.lit(0).cast("long").alias("load"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, g: Column) -> Column:
        load, size = acc["load"], g["size"]
        opened = F.array_append(acc["starts"], g["at"])
        alone = F.struct((acc["closed"] + F.when(load > 0, 2).otherwise(1)).alias("closed"), F.lit(0).cast("long").alias("load"), opened.alias("starts"))
        fresh = F.struct((acc["closed"] + F.when(load > 0, 1).otherwise(0)).alias("closed"), size.alias("load"), opened.alias("starts"))
        more = F.struct(acc["closed"].alias("closed"), (load + size).alias("load"), acc["starts"].alias("starts"))
        return F.when(size > capacity, alone).when((load == 0) | (load + size > capacity), fresh).otherwise(more)

    return F.aggregate(groups, empty, step)


def _shards_needed(capacity: Column, groups: Column) -> Column:
    """The same greedy walk without the cuts, for the search."""
    empty = F.struct(F.lit(0).alias("closed"), F.lit(0).cast("long").alias("load"))

    def step(acc: Column, g: Column) -> Column:
        load, size = acc["load"], g["size"]
        alone = F.struct((acc["closed"] + F.when(load > 0, 2).otherwise(1)).alias("closed"), F.lit(0).cast("long").alias("load"))
        fresh = F.struct((acc["closed"] + F.when(load > 0, 1).otherwise(0)).alias("closed"), size.alias("load"))
        more = F.struct(acc["closed"].alias("closed"), (load + size).alias("load"))
        return F.when(size > capacity, alone).when((load == 0) | (load + size > capacity), fresh).otherwise(more)

    return F.aggregate(groups, empty, step, lambda acc: acc["closed"] + F.when(acc["load"] > 0, 1).otherwise(0))


def minimax_starts(cells: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``cells(at int, size long)`` -> one row: ``capacity`` and ``starts``, the first cell of each shard.

    Binary search for the smallest capacity with which the greedy walk needs at most ``shards`` shards.
    ``cells`` must be a bounded list. An empty list gives no starts.
    """
    one = cells.agg(F.array_sort(F.collect_list(F.struct("at", F.col("size").cast("long").alias("size")))).alias("groups"), F.coalesce(F.sum("size"), F.lit(1)).cast("long").alias("total"))

    def halve(acc: Column, _: Column) -> Column:
        mid = acc["lo"] + F.call_function("div", acc["hi"] - acc["lo"], F.lit(2))
        fits = _shards_needed(mid, F.col("groups")) <= shards
        tried = F.when(fits, F.struct(acc["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi")))
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(tried)

    bounds = F.struct(F.lit(1).cast("long").alias("lo"), F.col("total").alias("hi"))
    searched = one.withColumn("capacity", F.aggregate(F.sequence(F.lit(1), F.lit(63)), bounds, halve, lambda acc: acc["hi"]))
    return searched.select("capacity", _fold(F.col("capacity"), F.col("groups"))["starts"].alias("starts"))


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, cell_hex: int = CELL_HEX, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """One row per document: (doc_id, size, text_crc32, shard, slot); the largest shard is as small as can be over the cells.

    The atoms that shards are cut from are cells of the text's hash (``cell_hex`` digits of it), not single texts: a cell holds every row of a
    text and of the texts that share its digits, so a cut is off the best one of single texts by less than a cell.
    size is the text's UTF-8 bytes plus 1 (null text: 1, with the crc of no bytes). Rows of equal text stay
    together, null with empty. slot numbers a shard's rows from 0 without gaps, by windows of the ids' hash; windows that
    null or repeated ids overfill are dealt again by a number of each row. Repeated rows are placed each; texts of any length count whole; with few rows some shards stay empty; an empty table gives no
    rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    named = columns(docs, id_col, text_col).toDF("doc_id", "text")
    narrow = scratch.keep(
        named.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.conv(F.substring(F.md5(text), 1, cell_hex), 16, 10).cast("int").alias("at"),
            F.monotonically_increasing_id().alias("nth"),
        )
    )
    cells = scratch.keep(narrow.groupBy("at").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    starts = scratch.keep(minimax_starts(cells.select("at", "size"), shards))
    shard = lambda at: (F.size(F.filter(F.col("starts"), lambda s: s <= at)) - 1).cast("int")
    cuts = lambda df: df.withColumn("starts", starts.select("starts").scalar()).withColumn("shard", shard(F.col("at"))).drop("starts")
    # rows of a shard spread over windows by their id's hash, as many as its size asks for
    counts = cuts(cells).groupBy("shard").agg(F.sum("n").alias("n"))
    windows = counts.agg(F.map_from_entries(F.collect_list(F.struct("shard", F.ceil(F.col("n") / slot_rows).cast("long")))).alias("windows"))
    windows = scratch.keep(windows)
    dealt = cuts(narrow).withColumn("windows", windows.select("windows").scalar())
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.element_at("windows", F.col("shard")))).drop("windows", "at")
    dealt = dealt.withColumn("deal", F.lit(0).cast("long"))
    parts = scratch.keep(dealt.groupBy("shard", "part", "deal").agg(F.count(F.lit(1)).alias("n")))
    full = parts.filter(F.col("n") > 4 * slot_rows).select("shard", "part", F.ceil(F.col("n") / slot_rows).alias("deals"))
    if not full.isEmpty():
        dealt = dealt.join(full, ["shard", "part"], "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64("nth"), F.col("deals")), F.lit(0))).drop("deals")
        parts = dealt.groupBy("shard", "part", "deal").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part", "deal").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.keep(parts.select("shard", "part", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    within = Window.partitionBy("shard", "part", "deal").orderBy("doc_id", "text_crc32", "size", "nth")
    return dealt.join(parts, ["shard", "part", "deal"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.row_number().over(within) - 1).alias("slot"))
