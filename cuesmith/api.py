"""What a user of the served application calls, over many questions or videos at once."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as X
from .functions.embedding import embed
from .operators import retrieval
from .session import stored
from .sources.providers import OverlapReranker, Reranker

MODES = ("lexical", "dense", "hybrid", "reranked")
CANDIDATES = 20


def search(
    questions: DataFrame, chunks: DataFrame, mode: str = "hybrid", limit: int = 6, context: int = 12, reranker: Reranker | None = None, postings: retrieval.Postings | None = None, vectors: DataFrame | None = None, parents: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Context rows and diagnostics of each question within its video.

    ``questions`` has ``query_id, video_id, question``, ``chunks`` ``chunk_id, video_id, transcript_id, window, text, start_ms,
    end_ms``; where ``postings`` and ``vectors`` of an index of them are given, they are read, else they are made. Candidates of the lexical and dense rankings are fused; in mode ``reranked`` the first 20 are scored again and
    the others follow by their fused rank. Near copies are dropped, then each hit brings its parent, if ``parents`` (``parent_id, text,
    start_ms, end_ms``) is given and ``chunks`` has ``parent_id``, and its neighbours, first come first kept. The context is ``query_id, place, kind, chunk_id, text, start_ms, end_ms, score``, the score that of the
    fusion; the diagnostics hold the rank in each list of every candidate.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if limit < 1 or context < limit:
        raise ValueError("limits must be positive, the context at least the limit")
    parent = F.col("parent_id") if parents is not None else F.lit(None).cast("string")
    chunks = chunks.select("chunk_id", "video_id", "transcript_id", "window", "text", "start_ms", "end_ms", parent.alias("parent_id"))
    lists = []
    if mode != "dense":
        asked = questions.select("video_id", "query_id", X.tokens(F.col("question")).alias("words"))
        if postings is None:
            scored = retrieval.best_pairs(asked, chunks.select("video_id", "chunk_id", X.tokens(F.col("text")).alias("words")), "video_id", "chunk_id", CANDIDATES)
        else:
            scored = retrieval.bm25(asked.select("video_id", "query_id", F.explode("words").alias("term")), postings)
        lists.append(retrieval.top(scored, CANDIDATES, "chunk_id").select("query_id", F.lit("lexical").alias("source"), "chunk_id", "rank"))
    if mode != "lexical":
        if vectors is None:
            near = retrieval.best_vectors(questions.select("video_id", "query_id", F.col("question").alias("text")), chunks.select("video_id", F.col("chunk_id").alias("id"), "text"), "video_id", "id", CANDIDATES)
            found = retrieval.top(near, CANDIDATES, "id")
        else:
            found = retrieval.dense_top(questions.select("video_id", "query_id", embed("question").alias("embedding")), vectors, "video_id", CANDIDATES)
        lists.append(found.select("query_id", F.lit("dense").alias("source"), F.col("id").alias("chunk_id"), "rank"))
    every = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    fused = retrieval.fuse(every, "chunk_id")
    rank = lambda s: F.max(F.when(F.col("source") == s, F.col("rank"))).alias(f"{s}_rank")
    per = every.groupBy(F.col("query_id").alias("__q"), F.col("chunk_id").alias("__c")).agg(rank("lexical"), rank("dense"))
    diagnostics = fused.join(per, (F.col("query_id") == F.col("__q")) & (F.col("chunk_id") == F.col("__c"))).drop("__q", "__c")
    known = chunks.select(F.col("chunk_id").alias("__c"), "transcript_id", "window", "text", "parent_id")
    order, pool = [F.col("fused_rank")], fused
    if mode == "reranked":  # the questions meet the candidates before the texts do
        pool = pool.join(questions.select(F.col("query_id").alias("__q"), "question"), F.col("query_id") == F.col("__q")).drop("__q")
    pool = pool.join(known, F.col("chunk_id") == F.col("__c")).drop("__c")
    if mode == "reranked":
        again = (reranker or OverlapReranker()).scores(pool)
        pool = again.withColumn("rerank_score", F.when(F.col("fused_rank") <= CANDIDATES, F.col("rerank_score")).otherwise(F.lit(float("-inf"))))
        order = [F.col("rerank_score").desc(), F.col("score").desc(), F.col("chunk_id")]
    placed = pool.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    row = F.struct("rank", "chunk_id", "transcript_id", "window", "score", "parent_id", F.array_distinct(X.tokens(F.col("text"))).alias("terms"))
    kept = placed.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("c")).select("query_id", F.posexplode(retrieval.keep_different(F.col("c"), limit)).alias("at", "x"))
    kinds = F.array(*[F.struct(F.lit(k).alias("o"), F.lit(name).alias("kind"), (F.col("x.window") + d).alias("want")) for k, name, d in ((0, "primary", 0), (2, "neighbour", -1), (3, "neighbour", 1))])
    wanted = kept.select("query_id", "at", F.col("x.score").alias("score"), F.col("x.transcript_id").alias("__t"), F.explode(kinds).alias("k"))
    # Texts come last, so neither the hits nor their neighbours carry them through a shuffle.
    columns = ["query_id", "at", "score", "k", "chunk_id"]
    near = wanted.join(chunks, (F.col("__t") == F.col("transcript_id")) & (F.col("k.want") == F.col("window"))).select(*columns)
    shown = ["text", "start_ms", "end_ms"]
    texts = chunks.select(F.lit(False).alias("__up"), F.col("chunk_id").alias("__c"), *shown)
    if parents is not None:
        up = kept.select("query_id", "at", F.col("x.score").alias("score"), F.col("x.parent_id").alias("chunk_id"), F.struct(F.lit(1).alias("o"), F.lit("parent").alias("kind"), F.lit(None).cast(chunks.schema["window"].dataType).alias("want")).alias("k"))
        near = near.unionByName(up.join(parents.select(F.col("parent_id").alias("__p")), F.col("chunk_id") == F.col("__p"), "left_semi").select(*columns))
        texts = texts.unionByName(parents.select(F.lit(True).alias("__up"), F.col("parent_id").alias("__c"), *shown))
    first = near.groupBy("query_id", "chunk_id").agg(F.min_by(F.struct("at", "k.o", "k.kind", "score"), F.struct("at", "k.o")).alias("r"))
    w = Window.partitionBy("query_id").orderBy("r.at", "r.o")
    placed = first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= context)
    rows = placed.join(texts, (F.col("chunk_id") == F.col("__c")) & ((F.col("r.kind") == "parent") == F.col("__up")))
    return rows.select("query_id", "place", "r.kind", "chunk_id", "text", "start_ms", "end_ms", "r.score"), diagnostics


def candidates(mode: str, k: int, rerank_k: int = 8) -> int:
    """How many chunks each source is asked for: twice what is wanted for a fusion, as many as are scored again where any are."""
    if not 1 <= k <= CANDIDATES:
        raise ValueError(f"between 1 and {CANDIDATES} chunks can be asked for")
    wide = max(k, rerank_k) if mode == "reranked" else k
    return 2 * wide if mode in ("hybrid", "reranked") else wide


def debug(questions: DataFrame, chunks: DataFrame, mode: str = "hybrid", top_k: int = 4, **index) -> tuple[DataFrame, float]:
    """The best ``top_k`` candidates of each question with their ranks, and the milliseconds that finding all of them took."""
    wanted = candidates(mode, top_k)
    began = time.monotonic()
    found = stored(search(questions, chunks, mode, **index)[1].where(F.col("fused_rank") <= min(wanted, top_k)))
    return found, max(0.0, round((time.monotonic() - began) * 1000, 4))


def ask(questions: DataFrame, chunks: DataFrame, mode: str = "hybrid", groundedness: float = 0.08, **index) -> DataFrame:
    """Extractive answers ``query_id, language, answer, warning, sources``; a question without context says so.

    The warning depends on the best score against the threshold, on whatever scale the mode has.
    """
    context, _ = search(questions, chunks, mode, limit=4, **index)
    hits = context.where("kind = 'primary'")
    line = F.concat(F.lit("- ["), X.minutes_seconds(F.col("start_ms") / 1000), F.lit("] "), X.shorten(F.col("text"), 220))
    per = hits.groupBy(F.col("query_id").alias("__q")).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line"), "chunk_id"))).alias("ls"), F.max("score").alias("best"))
    joined = questions.select("query_id", "question").join(per, F.col("query_id") == F.col("__q"), "left")
    vi = X.answer_language(F.col("question")) == "vi"
    none = F.when(vi, "Không đủ bằng chứng trong video.").otherwise("There is not enough evidence in the video.")
    found = F.array_join(F.transform(F.slice("ls", 1, 3), lambda x: x["line"]), "\n")
    warning = F.when(F.col("best").isNull(), "none").when(F.col("best") < groundedness, "low")
    return joined.select("query_id", X.answer_language(F.col("question")).alias("language"), F.coalesce(found, none).alias("answer"), warning.alias("warning"), F.coalesce(F.transform("ls", lambda x: x["chunk_id"]), F.array().cast("array<string>")).alias("sources"))
