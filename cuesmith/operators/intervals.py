"""Merged periods and gaps of time intervals per entity, by compressed run bitmaps.

Time is counted in exact milliseconds and cut into shards of ``2**SHARD_BITS`` ms. For an entity and shard the
covered milliseconds form a bitmap that is kept as its runs only (start and end of each stretch of set bits).
An interval contributes at most three entries: the part in its first shard, the whole shards between as one run
that starts at the second shard, and the part in its last shard. Bitmaps of a shard are united, their set runs
extracted, and neighbouring shards joined by the end of what was covered before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import before

SHARD_BITS = 20
"""A shard has 2**20 ms (17.5 minutes), so it holds at most 2**19 runs however many rows fall into it."""
BLOCK_SHARDS = 1024
"""Shards of an entity that one task walks through when shards are joined."""


def shard_runs(intervals: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Run bitmaps: ``entity, shard, runs array<struct<lo, hi>>``, runs disjoint, in order, not touching.

    Rows with a null entity, start or end, or an end not after the start, are left out.
    """
    size = 1 << SHARD_BITS
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    a, b = F.floor(s / size), F.floor((e - 1) / size)
    piece = lambda shard, lo, hi: F.struct(shard.alias("shard"), lo.alias("lo"), hi.alias("hi"))
    pieces = (
        F.when(a == b, F.array(piece(a, s, e)))
        .when(b == a + 1, F.array(piece(a, s, b * size), piece(b, b * size, e)))
        .otherwise(F.array(piece(a, s, (a + 1) * size), piece(a + 1, (a + 1) * size, b * size), piece(b, b * size, e)))
    )
    # Rows of one start unite to the longest, before the shuffle where they meet in a task.
    united = (
        intervals.where(F.col(entity).isNotNull() & (e > s))
        .select(F.col(entity).alias("entity"), F.explode(pieces).alias("p"))
        .groupBy("entity", "p.shard", "p.lo")
        .agg(F.max("p.hi").alias("hi"))
    )
    w = Window.partitionBy("entity", "shard").orderBy("lo")
    flagged = united.withColumn("until", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "opens", F.when(F.col("until").isNull() | (F.col("lo") > F.col("until")), 1).otherwise(0)
    )
    numbered = flagged.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("entity", "shard", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.groupBy("entity", "shard").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))


def _clear_runs(runs: Column, carry: Column) -> Column:
    """Stretches between what was covered before (``carry``, may be null) and the runs, in order."""
    n = F.size(runs)
    ends = F.transform(runs, lambda r: r["hi"])
    pairs = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.greatest(F.when(i > 1, F.element_at(ends, F.greatest(i - 1, F.lit(1)))), carry).alias("from"),
            F.element_at(runs, i)["lo"].alias("to"),
        ),
    )
    return F.filter(pairs, lambda p: p["from"] < p["to"])


def coverage(intervals: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """One row per entity and shard with ``clear`` runs (gaps that end in the shard), first start and last end."""
    bitmaps = shard_runs(intervals, entity, start, end).withColumn("block", F.floor(F.col("shard") / BLOCK_SHARDS))
    last = F.array_max(F.transform("runs", lambda r: r["hi"]))
    joined = before(bitmaps, ["entity"], "block", ["shard"], carry=("max", last))
    return joined.select(
        "entity", "shard", F.element_at("runs", 1)["lo"].alias("first_start"), last.alias("last_end"), _clear_runs(F.col("runs"), F.col("carry")).alias("clear")
    )


def gaps(intervals: DataFrame, entity: str = "transcript_id", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Every maximal uncovered stretch between an entity's first start and last end: ``entity, gap_start_ms, gap_end_ms``.

    Intervals are half-open, so touching ones leave no gap. Nulls and empty or reversed intervals are ignored, repeated
    rows count once, an empty table gives no rows, further columns are not read.
    """
    found = coverage(intervals, entity, start, end).select(F.col("entity").alias(entity), F.explode("clear").alias("g"))
    return found.select(entity, F.col("g.from").alias("gap_start_ms"), F.col("g.to").alias("gap_end_ms"))


def periods(intervals: DataFrame, entity: str = "transcript_id", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """The merged continuous periods: ``entity, period_start_ms, period_end_ms``. Cases as in :func:`gaps`."""
    rows = coverage(intervals, entity, start, end).withColumn("block", F.floor(F.col("shard") / BLOCK_SHARDS))
    rows = before(rows, ["entity"], "block", ["shard"], __carry=("max", F.col("last_end")))
    # A gap ends one period and begins the next; the first start begins one, the last end ends one.
    starts = F.concat(
        F.when(F.col("__carry").isNull(), F.array(F.col("first_start"))).otherwise(F.array().cast("array<bigint>")),
        F.transform("clear", lambda g: g["to"]),
    )
    begun = rows.select("entity", "shard", F.explode(starts).alias("at"), F.lit(True).alias("begins"))
    ended = rows.select("entity", "shard", F.explode(F.transform("clear", lambda g: g["from"])).alias("at"), F.lit(False).alias("begins"))
    final = rows.groupBy("entity").agg(F.max("shard").alias("shard"), F.max("last_end").alias("at")).withColumn("begins", F.lit(False))
    edges = begun.unionByName(ended).unionByName(final).withColumn("block", F.floor(F.col("at") / (BLOCK_SHARDS << SHARD_BITS)))
    # Starts before a start number its period, so do ends before an end.
    edges = before(
        edges, ["entity"], "block", ["at", "begins"],
        opened=("sum", F.when(F.col("begins"), 1).otherwise(0)), closed=("sum", F.when(F.col("begins"), 0).otherwise(1)),
    )
    number = F.when(F.col("begins"), F.col("opened")).otherwise(F.col("closed"))
    return (
        edges.groupBy("entity", number.alias("n"))
        .agg(F.max(F.when(F.col("begins"), F.col("at"))).alias("period_start_ms"), F.max(F.when(~F.col("begins"), F.col("at"))).alias("period_end_ms"))
        .select(F.col("entity").alias(entity), "period_start_ms", "period_end_ms")
    )


def summary(intervals: DataFrame, entity: str = "transcript_id", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Per entity ``span_ms, covered_ms, largest_gap_ms, gap_count``; entities without a valid interval have no row."""
    width = F.transform("clear", lambda g: g["to"] - g["from"])
    rows = coverage(intervals, entity, start, end)
    per = rows.groupBy("entity").agg(
        (F.max("last_end") - F.min("first_start")).alias("span_ms"),
        F.sum(F.aggregate(width, F.lit(0).cast("long"), lambda x, y: x + y)).alias("__open"),
        F.coalesce(F.max(F.array_max(width)), F.lit(0).cast("long")).alias("largest_gap_ms"),
        F.sum(F.size("clear")).cast("long").alias("gap_count"),
    )
    return per.select(F.col("entity").alias(entity), "span_ms", (F.col("span_ms") - F.col("__open")).alias("covered_ms"), "largest_gap_ms", "gap_count")
