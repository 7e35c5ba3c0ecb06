"""Splitting oversized cues at natural boundaries.

The token starts and ends of a text are its prefix sums of offsets; the token positions after which a natural
boundary lies form a sorted array. A piece is as long as the limit lets it be: the last boundary within the limit is
found by binary search, with a hard cut where there is none, and the next piece starts ``overlap`` tokens before the cut.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Unicode White_Space property.
WHITE_SPACE = "\\u0009-\\u000d\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
TOKEN = f"[^{WHITE_SPACE}]+"
CLOSERS = "\"'”’»)]}"
SENTENCE_END = re.compile(f"[.!?…。！？]+[{re.escape(CLOSERS)}]*$")
CLAUSE_END = re.compile(f"[,;:–—、，；]+[{re.escape(CLOSERS)}]*$")

PIECES = "segment_id string, transcript_id string, piece_number int, first_token int, last_token int, text string, cut string, start_ms bigint, end_ms bigint"


def token_count(text: Column) -> Column:
    """Tokens are runs of characters between Unicode white space."""
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def boundaries(text: str) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Token spans, and the sorted counts of tokens before each sentence boundary and each clause boundary.

    The end of a line counts as a sentence boundary.
    """
    spans = [m.span() for m in re.finditer(TOKEN, text)]
    sentence, clause = [], []
    for i, (a, b) in enumerate(spans):
        word = text[a:b]
        if SENTENCE_END.search(word) or (i + 1 < len(spans) and any(c in "\n\r  \x85" for c in text[b : spans[i + 1][0]])):
            sentence.append(i + 1)
        elif CLAUSE_END.search(word):
            clause.append(i + 1)
    return spans, sentence, clause


def pieces_of(text: str, limit: int, overlap: int) -> list[tuple[int, int, str, str]]:
    """``(first token, last token, text, kind of cut)`` of each piece; every piece but the last shares its last
    ``overlap`` tokens with the next. An overlap of the limit or more is reduced to the limit less one."""
    spans, sentence, clause = boundaries(text)
    overlap = max(0, min(overlap, limit - 1))
    out, start, n = [], 0, len(spans)
    while start < n:
        cut, kind = n, "end"
        if n - start > limit:
            cut, kind = start + limit, "hard"
            for marks, name in ((sentence, "sentence"), (clause, "clause")):
                k = bisect_right(marks, start + limit) - 1
                if k >= 0 and marks[k] > start + overlap:  # else no progress
                    cut, kind = marks[k], name
                    break
        out.append((start, cut - 1, text[spans[start][0] : spans[cut - 1][1]], kind))
        if cut == n:
            break
        start = cut - overlap
    return out


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PIECES.split(", ")]
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            for k, (a, b, text, kind) in enumerate(pieces_of(r.text, int(r.child_max), int(r.child_overlap))):
                out.append((r.segment_id, r.transcript_id, k, a, b, text, kind, r.start_ms, r.end_ms))
        frame = pd.DataFrame(out, columns=names)
        yield frame.astype({"start_ms": "Int64", "end_ms": "Int64"})


def split_oversized(cues: DataFrame, versions: DataFrame) -> DataFrame:
    """Pieces of every cue whose ``normalized_text`` has more tokens than its transcript's active version allows.

    A null text, a transcript without an active version or a limit that is null or not positive gives no rows; a null
    overlap is 0. Of several active versions the latest activated counts, then the smallest id. Cues repeated under one
    id count once. Null times stay null. Empty tables give no rows; other columns are not read.
    """
    limits = (
        versions.where(F.col("status") == "active")
        .groupBy(F.col("transcript_id").alias("__transcript"))
        .agg(F.min(F.struct((-F.unix_micros(F.coalesce(F.col("activated_at").cast("timestamp"), F.timestamp_micros(F.lit(0))))).alias("age"), "id", F.col("chunker_config.child_max_tokens").alias("child_max"), F.coalesce("chunker_config.child_overlap_tokens", F.lit(0)).alias("child_overlap"))).alias("v"))
        .select("__transcript", "v.child_max", "v.child_overlap")
        .where("child_max > 0")
    )
    counted = cues.where("normalized_text IS NOT NULL").select(
        F.col("id").alias("segment_id"), "transcript_id", F.col("normalized_text").alias("text"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), token_count(F.col("normalized_text")).alias("tokens")
    )
    # Cues within the least limit of all are out before the join, so few texts are shuffled; copies of a cue meet after it.
    least = limits.agg(F.min("child_max")).first()[0]
    over = counted.where(F.col("tokens") > (least if least is not None else 0)).join(limits, F.col("transcript_id") == F.col("__transcript")).where("tokens > child_max").dropDuplicates(["segment_id"])
    return over.select("segment_id", "transcript_id", "text", "start_ms", "end_ms", "child_max", "child_overlap").mapInPandas(_split, PIECES)
