"""Fixed word windows over transcripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS
from ..session import stored

BUCKET = 2048
UNNUMBERED = -(1 << 62)
"""The bucket of cues without a number, which come first."""


def word_windows(segments: DataFrame, size: int = 140, stride: int = 110, videos: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """``transcript_id, window, text, words, first_segment, start_ms, end_ms``: windows of ``size`` words every ``stride``.

    With ``videos``, ``transcript_id, video_id``, also the ``video_id``, for transcripts that have one there; it meets the cues where
    they lie, so that windows aren't shuffled for it. ``keep`` writes what is read twice, which is not needed after the windows.

    The last window of a transcript is the first that reaches its end. Words are counted in buckets of sequence numbers, so no task
    walks through a whole transcript: cues are shuffled once, where rows that repeat another whole are dropped too, and then once
    for each window that they reach into. Null texts have no words.
    """
    bucket = F.coalesce(F.floor(F.col("sequence_number") / BUCKET), F.lit(UNNUMBERED)).alias("bucket")
    cues = segments.select("*", bucket).repartition("transcript_id", "bucket").distinct()
    words = F.filter(F.split(F.coalesce("original_text", F.lit("")), BLANKS), lambda w: w != "")
    inside = Window.partitionBy("transcript_id", "bucket")
    counted = cues.withColumn("n", F.size(words)).where("n > 0").withColumns(
        {"before": F.sum("n").over(inside.orderBy("sequence_number", "id").rowsBetween(Window.unboundedPreceding, -1)), "inside": F.sum("n").over(inside)}
    )
    video = []
    if videos is not None:
        video = ["video_id"]
        of = videos.select(F.col("transcript_id").alias("__v"), "video_id")
        there = segments.select("transcript_id", bucket).distinct().join(of, F.col("transcript_id") == F.col("__v")).select("__v", F.col("bucket").alias("__w"), "video_id")
        counted = counted.join(there, (F.col("transcript_id") == F.col("__v")) & (F.col("bucket") == F.col("__w")))
    local = keep(counted.select(*video, "transcript_id", "bucket", "id", "start_ms", "end_ms", "original_text", "n", "before", "inside"))
    # Only transcripts beyond the first bucket need more than what their bucket holds.
    beyond = local.where("bucket <> 0").select("transcript_id").distinct()
    buckets = local.select("transcript_id", "bucket", "inside").distinct().join(beyond, "transcript_id", "left_semi")
    across = Window.partitionBy("transcript_id")
    earlier = F.coalesce(F.sum("inside").over(across.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = keep(buckets.select(F.col("transcript_id").alias("__t"), F.col("bucket").alias("__b"), earlier.alias("earlier"), F.sum("inside").over(across).alias("all")))
    known = local.join(totals, (F.col("transcript_id") == F.col("__t")) & (F.col("bucket") == F.col("__b")), "left")
    n, at = F.col("n"), F.col("offset")
    placed = known.withColumns({"ws": words, "offset": F.coalesce("before", F.lit(0)) + F.coalesce("earlier", F.lit(0)), "total": F.coalesce("all", "inside")})
    last = F.ceil(F.greatest(F.col("total") - size, F.lit(0)) / stride)
    first = F.greatest(F.ceil((at - (size - 1)) / stride), F.lit(0))
    until = F.least(F.floor((at + n - 1) / stride), last)
    # One row for each cue and window it reaches into, with the words it gives.
    spread = placed.where(first <= until).withColumn("window", F.explode(F.sequence(first, until)))
    a = F.greatest(F.col("window") * stride - at, F.lit(0))
    z = F.least(F.col("window") * stride + size - at, n)
    parts = spread.select(*video, "transcript_id", "window", "id", "start_ms", "end_ms", (at + a).alias("at"), (z - a).alias("n"), F.array_join(F.slice("ws", (a + 1).cast("int"), (z - a).cast("int")), " ").alias("part"))
    return parts.groupBy(*video, "transcript_id", "window").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), " ").alias("text"),
        F.sum("n").alias("words"), F.min_by("id", "at").alias("first_segment"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
    )
