"""Walking ordered entities in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_CUES = 2048
"""Cues of a transcript that one call gets at most: sequence numbers are unique, so a bucket of them is bounded."""


def bucket_of(number: Column) -> Column:
    return F.floor(number / BUCKET_CUES).cast("int")


def by_bucket(cues: DataFrame, walk: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """Call ``walk`` with the columns of the cues of each ``transcript_id, bucket``, ordered by ``sequence_number``, each number once.

    The buckets of a long transcript spread over tasks; tasks stream over their sorted buckets. A column ``bucket`` of
    ``cues`` is taken as it is.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[dict[str, np.ndarray]] = []
        key = None

        def flush() -> list[tuple]:
            if not kept:
                return []
            cues = {c: np.concatenate([k[c] for k in kept]) for c in kept[0]} if len(kept) > 1 else kept[0]
            at = cues["sequence_number"]
            first = np.r_[True, at[1:] != at[:-1]]  # re-delivered cues stand next to each other
            return walk(cues if first.all() else {c: v[first] for c, v in cues.items()})

        for batch in batches:
            if batch.empty:
                continue
            columns = {c: batch[c].to_numpy() for c in batch.columns}
            ids, numbers = columns["transcript_id"], columns["bucket"]
            changes = np.flatnonzero((ids[1:] != ids[:-1]) | (numbers[1:] != numbers[:-1])) + 1
            cuts = [0, *changes.tolist(), len(batch)]
            out: list[tuple] = []
            for a, b in zip(cuts, cuts[1:]):
                if key != (ids[a], numbers[a]):
                    out += flush()
                    kept, key = [], (ids[a], numbers[a])
                kept.append({c: v[a:b] for c, v in columns.items()})
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(flush(), columns=names)

    placed = cues if "bucket" in cues.columns else cues.withColumn("bucket", bucket_of(F.col("sequence_number")))
    return placed.repartition("transcript_id", "bucket").sortWithinPartitions("transcript_id", "bucket", "sequence_number").mapInPandas(run, schema)
