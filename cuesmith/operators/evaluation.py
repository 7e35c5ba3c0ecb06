"""Scores of retrieved lists against judged ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_metrics(retrieved: Column, expected: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and reciprocal rank of an ordered list of ids, to 4 digits; all 0 where nothing is expected.

    A repeated id counts each time for precision and once for recall.
    """
    wanted = F.array_distinct(expected)
    hits = F.filter(retrieved, lambda c: F.array_contains(wanted, c))
    n = F.size(wanted)
    first = F.size(retrieved) - F.size(F.aggregate(retrieved, F.struct(retrieved.alias("left"), F.lit(False).alias("met")), lambda a, c: F.when(a["met"] | F.array_contains(wanted, c), F.struct(a["left"].alias("left"), F.lit(True).alias("met"))).otherwise(F.struct(F.slice(a["left"], 2, F.greatest(F.size(a["left"]) - 1, F.lit(0))).alias("left"), F.lit(False).alias("met"))), lambda a: a["left"])) + 1
    none = n == 0
    return (
        F.round(F.when(none, 0.0).otherwise(F.size(hits) / F.greatest(F.size(retrieved), F.lit(1))), 4),
        F.round(F.when(none, 0.0).otherwise(F.size(F.array_distinct(hits)) / n), 4),
        F.round(F.when(none | (F.size(hits) == 0), 0.0).otherwise(1.0 / first), 4),
    )


def segment_metrics(asked: DataFrame, retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """Recall, hit, reciprocal rank, gain, citation accuracy and false positive of each question, judged by segments.

    ``asked`` has ``query_id``; ``retrieved`` ``query_id, rank, segment_id``, a row for each segment of each chunk found;
    ``expected`` ``query_id, segment_id``. A chunk is relevant if it holds an expected segment. A question that expects
    nothing scores 1 and is a false positive if anything was found; the gain's ideal has as many hits as were found.
    """
    e = expected.select(F.col("query_id").alias("__q"), F.col("segment_id").alias("__s")).distinct()
    judged = retrieved.select("query_id", "rank", "segment_id").distinct().join(e, (F.col("query_id") == F.col("__q")) & (F.col("segment_id") == F.col("__s")), "left")
    chunks = judged.groupBy("query_id", "rank").agg(F.count("*").alias("cited"), F.count("__s").alias("supported"))
    covered = judged.where("__s IS NOT NULL").groupBy(F.col("query_id").alias("__c")).agg(F.count_distinct("__s").alias("covered"))
    good = F.col("supported") > 0
    per = chunks.groupBy(F.col("query_id").alias("__p")).agg(
        F.count("*").alias("found"), F.sum(F.when(good, 1).otherwise(0)).alias("relevant"), F.min(F.when(good, F.col("rank"))).alias("first"),
        F.sum(F.when(good, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.sum("cited").alias("cited"), F.sum("supported").alias("supported"),
    )
    wanted = e.groupBy("__q").agg(F.count("*").alias("expected"))
    every = asked.select("query_id").distinct().join(per, F.col("query_id") == F.col("__p"), "left").join(covered, F.col("query_id") == F.col("__c"), "left").join(wanted, F.col("query_id") == F.col("__q"), "left")
    none, relevant = F.col("expected").isNull(), F.coalesce("relevant", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(relevant, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return every.select(
        "query_id", F.round(F.when(none, 1.0).otherwise(zero(F.col("covered") / F.col("expected"))), 4).alias("recall"), F.when(none | (relevant > 0), 1.0).otherwise(0.0).alias("hit"),
        F.round(F.when(none, 1.0).otherwise(zero(1.0 / F.col("first"))), 4).alias("mrr"), F.round(F.when(none, 1.0).when(relevant == 0, 0.0).otherwise(F.col("dcg") / ideal), 4).alias("ndcg"),
        F.round(F.when(none, 1.0).otherwise(zero(F.col("supported") / F.greatest("cited", F.lit(1)))), 4).alias("citation_accuracy"),
        F.when(none & (F.coalesce("found", F.lit(0)) > 0), 1.0).otherwise(0.0).alias("unanswerable_false_positive"), none.alias("unanswerable"),
    )


def recommended(variants: DataFrame, margin: float = 0.01) -> DataFrame:
    """Of the variants (``variant_id, citation_accuracy, ndcg, p95_ms, recall, mrr``) within the margin of the best citations, and of
    these within it of the best gain, the fastest; then the higher recall, reciprocal rank and the first id."""
    if not 0 <= margin < 1:
        raise ValueError("the margin must be between 0 and 1")
    by = lambda df, c: df.crossJoin(F.broadcast(df.agg(F.max(c).alias("__best")))).where(F.col(c) >= F.col("__best") - margin).drop("__best")  # one row
    order = F.struct("p95_ms", (-F.col("recall")).alias("r"), (-F.col("mrr")).alias("m"), "variant_id")
    return by(by(variants, "citation_accuracy"), "ndcg").agg(F.min_by("variant_id", order).alias("variant_id"))
