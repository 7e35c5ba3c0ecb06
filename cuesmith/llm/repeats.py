"""Collapsing runs of repeated consecutive cues.

Every cue starts as a run of its own in a linked list per transcript; a priority queue holds the neighbouring runs that
may merge, the most similar first. Merging links the runs, and the similarity of a run and its neighbour is that of the
cues at their seam, until no pair meets the limits of similarity and gap. A transcript is walked in buckets of
sequence numbers; the outermost runs of buckets, which keep their seam cues, are joined afterwards.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookalikes import IGNORABLE
from .streams import by_bucket

MAX_GAP_MS = 250
NEAR_LENGTH = 20
MAX_EDITS = 2

_INVISIBLE = re.compile(f"[{IGNORABLE}]")
_DIGITS = re.compile(r"\d+")

RUNS = "transcript_id string, bucket int, run int, first_number int, last_number int, cues int, start_ms bigint, end_ms bigint, head string, head_digits string, tail string, tail_digits string, last_end_ms bigint, outer int"


@lru_cache(maxsize=1 << 14)
def reduced(text: str | None) -> tuple[str, str]:
    """Lower-case letters and digits of the visible text, and its digit groups joined by blanks."""
    seen = _INVISIBLE.sub("", text or "")
    return "".join(filter(str.isalnum, seen.lower())), " ".join(_DIGITS.findall(seen))


def edits_within(a: str, b: str, most: int) -> int | None:
    """The number of single-character edits between the strings if it is ``most`` at most."""
    if abs(len(a) - len(b)) > most:
        return None
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    i = 0
    while i < len(a) and i < len(b) and a[-1 - i] == b[-1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b:
        return len(a) + len(b) if len(a) + len(b) <= most else None
    if most == 0:
        return None
    found = [x for x in (edits_within(a[1:], b[1:], most - 1), edits_within(a[1:], b, most - 1), edits_within(a, b[1:], most - 1)) if x is not None]
    return 1 + min(found) if found else None


def similarity(a: tuple[str, str], b: tuple[str, str]) -> float | None:
    """1 for equal reduced texts, less by each edit for near ones, None where the cues don't repeat each other."""
    (x, dx), (y, dy) = a, b
    if not x or not y or dx != dy:
        return None
    if x == y:
        return 1.0
    if len(x) < NEAR_LENGTH or len(y) < NEAR_LENGTH:
        return None
    edits = edits_within(x, y, MAX_EDITS)
    return None if edits is None else 1.0 - edits / max(len(x), len(y))


def agglomerate(texts: list[tuple[str, str]], starts: list[int | None], ends: list[int | None]) -> list[tuple[int, int]]:
    """Runs as index ranges. Neighbours with a null time at their seam don't merge."""
    n = len(texts)
    head, tail = list(range(n)), list(range(n))  # of the run at an end of which the index is
    queue: list[tuple[float, int]] = []
    for i in range(1, n):
        if ends[i - 1] is None or starts[i] is None or starts[i] - ends[i - 1] > MAX_GAP_MS:
            continue
        alike = similarity(texts[i - 1], texts[i])
        if alike is not None:
            heapq.heappush(queue, (-alike, i))
    while queue:
        _, i = heapq.heappop(queue)  # the seam before cue i: runs only grow outwards, so it is still a seam
        left, right = head[i - 1], tail[i]
        tail[left], head[right] = right, left
    out, i = [], 0
    while i < n:
        out.append((i, tail[i]))
        i = tail[i] + 1
    return out


def _whole(values: np.ndarray) -> list[int | None]:
    known = values.astype(float)
    return [None if lost else int(x) for x, lost in zip(known.tolist(), np.isnan(known).tolist())]


def _runs(cues: dict[str, np.ndarray]) -> list[tuple]:
    texts = [reduced(t) for t in cues["text"]]
    starts, ends = _whole(cues["start_ms"]), _whole(cues["end_ms"])
    numbers = cues["sequence_number"].tolist()
    found = agglomerate(texts, starts, ends)
    key = (cues["transcript_id"][0], int(cues["bucket"][0]))
    out = []
    for k, (a, b) in enumerate(found):
        known = [x for x in ends[a : b + 1] if x is not None]
        outer = int(k in (0, len(found) - 1))
        # Inner runs of one cue are none; outer ones may join runs of the neighbouring buckets.
        if b > a or outer:
            out.append((*key, k, numbers[a], numbers[b], b - a + 1, starts[a], max(known, default=None), *(texts[a] + texts[b] if outer else (None,) * 4), ends[b], outer))
    return out


@F.pandas_udf(T.BooleanType())
def _repeats(a: pd.Series, da: pd.Series, b: pd.Series, db: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and similarity((x, dx), (y, dy)) is not None for x, dx, y, dy in zip(a, da, b, db)])


def collapse(cues: DataFrame) -> DataFrame:
    """Runs of two or more cues: ``transcript_id, first_number, last_number, cues, start_ms, end_ms, duration_ms``.

    Cues follow each other by ``sequence_number``; one joins the run before it if it starts at most 250 ms after that run's
    last cue ends, has the same digit groups and, in lower-case letters and digits, the same text or one of at least 20
    characters two edits away at most. Null, blank and symbol-only texts are in no run and break none but the one they
    stand in; null keys are left out, re-delivered rows count once, empty tables give no rows.
    """
    kept = cues.where("transcript_id IS NOT NULL AND sequence_number IS NOT NULL").select("transcript_id", F.col("sequence_number").cast("int").alias("sequence_number"), "text", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))
    runs = by_bucket(kept, _runs, RUNS)
    # Inner runs are windows of their own, so that only two runs a bucket meet in the window of a transcript.
    own = [F.when(F.col("outer") == 0, F.col(c)).otherwise(-1) for c in ("bucket", "run")]
    order = Window.partitionBy("transcript_id", *own).orderBy("bucket", "run")
    before = {c: F.lag(c).over(order) for c in ("bucket", "tail", "tail_digits", "last_end_ms")}
    seen = runs.withColumns({f"__{k}": v for k, v in before.items()})
    near = (F.col("outer") == 1) & (F.col("bucket") != F.col("__bucket")) & (F.col("start_ms") - F.col("__last_end_ms") <= MAX_GAP_MS)
    alike = _repeats(F.when(near, F.col("__tail")), F.col("__tail_digits"), F.when(near, F.col("head")), F.col("head_digits"))
    joined = seen.withColumn("joins", F.coalesce(near & alike, F.lit(False))).select("transcript_id", "bucket", "run", "outer", "first_number", "last_number", "cues", "start_ms", "end_ms", "joins")
    numbered = joined.withColumn("group", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("transcript_id", *[o.alias(f"__o{i}") for i, o in enumerate(own)], "group").agg(
        F.min("first_number").alias("first_number"), F.max("last_number").alias("last_number"), F.sum("cues").cast("int").alias("cues"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")
    )
    return merged.where("cues > 1").select("transcript_id", "first_number", "last_number", "cues", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))


def removed_counts(cues: DataFrame) -> DataFrame:
    """Per transcript with cues its ``source_segment_count, removed_duplicate_count``; 0 where nothing repeats."""
    keys = cues.where("transcript_id IS NOT NULL AND sequence_number IS NOT NULL").select("transcript_id", "sequence_number").distinct()
    all_cues = keys.groupBy("transcript_id").agg(F.count("*").alias("source_segment_count"))
    removed = collapse(cues).groupBy(F.col("transcript_id").alias("__t")).agg(F.sum(F.col("cues") - 1).alias("removed"))
    return all_cues.join(removed, F.col("transcript_id") == F.col("__t"), "left").select("transcript_id", "source_segment_count", F.coalesce("removed", F.lit(0).cast("long")).alias("removed_duplicate_count"))
