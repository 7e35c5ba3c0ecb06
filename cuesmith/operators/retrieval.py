"""Lexical and dense retrieval for many queries at once, fusion, reranking and context."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.embedding import hashed_all
from ..session import stored


@dataclass
class Postings:
    """An inverted index: ``rows`` have ``scope, key, term, tf, dl``, ``terms`` ``__s, __term, df, n_docs, avgdl`` of each scope."""

    rows: DataFrame
    terms: DataFrame
    scope: str
    key: str


TERM_BUCKETS = 16
"""Parts of a scope's postings by the hash of the term, so that a large scope is no single task's."""


def index_terms(documents: DataFrame, scope: str, key: str, terms: Column, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Postings:
    """The postings of documents. Terms of a document are counted where it lies; ``keep`` may write both tables, which are laid
    out by scope and term so that a lookup reads few row groups."""
    seen = documents.select(scope, key, terms.alias("ts"))
    counted = F.transform(F.array_distinct("ts"), lambda t: F.struct(t.alias("term"), F.size(F.filter("ts", lambda x: x == t)).alias("tf")))
    rows = seen.select(scope, key, F.size("ts").alias("dl"), F.explode(counted).alias("t")).select(scope, key, "t.term", F.col("t.tf").cast("long").alias("tf"), "dl")
    placed = rows.repartition(scope, F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS))).sortWithinPartitions(scope, "term")
    rows = keep(placed)
    sizes = seen.groupBy(F.col(scope).alias("__s")).agg(F.count("*").alias("n_docs"), F.greatest(F.avg(F.size("ts")), F.lit(1.0)).alias("avgdl"))
    df = rows.groupBy(F.col(scope).alias("__ds"), F.col("term").alias("__term")).agg(F.count("*").alias("df"))
    return Postings(rows, keep(df.join(sizes, F.col("__ds") == F.col("__s")).drop("__ds")), scope, key)


def updated(index: Postings, documents: DataFrame, terms: Column, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """The postings after the documents of the scopes ``changed`` became ``documents`` and those of ``deleted`` went; both have the
    scope alone. Postings of other scopes are not made again."""
    scope = index.scope
    drop = changed.unionByName(deleted).select(F.col(scope).alias("__s")).distinct()
    gone = deleted.select(F.col(scope).alias("__s")).distinct()
    kept = index.rows.join(drop, F.col(scope) == F.col("__s"), "left_anti")
    new = index_terms(documents, scope, index.key, terms).rows.join(gone, F.col(scope) == F.col("__s"), "left_anti")
    return kept.unionByName(new)


def bm25(queries: DataFrame, index: Postings, k1: float = 1.5, b: float = 0.75, plus_one: bool = True) -> DataFrame:
    """``query_id, key, score`` of every document of a query's scope that shares a term with it, score to 6 digits.

    ``queries`` has ``scope, query_id, term`` with one row per occurrence that counts. Statistics are those of the scope.
    With ``plus_one`` the inverse document frequency is ``ln(1 + (N - n + .5) / (n + .5))``, without it
    ``ln((N - n + .5) / (n + .5))``, at least 1e-6.
    """
    scope, key = index.scope, index.key
    ratio = (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = F.when(F.lit(plus_one), F.log(ratio + 1)).otherwise(F.greatest(F.log(ratio), F.lit(1e-6)))
    # The terms of the queries meet the weights first: postings of other terms never leave their tasks.
    asked = queries.join(index.terms, (F.col(scope) == F.col("__s")) & (F.col("term") == F.col("__term"))).select(F.col(scope).alias("__qs"), F.col("term").alias("__qt"), "query_id", idf.alias("idf"), "avgdl")
    tf = F.col("tf")
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hits = index.rows.join(asked, (F.col(scope) == F.col("__qs")) & (F.col("term") == F.col("__qt")))
    return hits.groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score"))


def top(scored: DataFrame, k: int, *ties: str, query: str = "query_id", score: str = "score") -> DataFrame:
    """The ``k`` best rows of each query with ``rank``; ties by the given columns."""
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


PLACE_DOCUMENTS, PLACE_QUERIES = 2048, 256
"""Documents of a scope in one place, and queries that are scored there at once."""


def best_pairs(queries: DataFrame, documents: DataFrame, scope: str, key: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query_id, key, score, share`` of each query with documents of its scope that share a word with it: the score as in
    :func:`bm25`, and the share of the query's distinct words that the document has. Among them are the ``k`` best of each
    query by either, ties by key; most others are left out.

    ``queries`` has ``scope, query_id, words``, ``documents`` ``scope, key, words``; a word that a query repeats counts each time.
    A scope lies in places of about ``PLACE_DOCUMENTS`` documents by the hash of the key, each with all queries of the scope, so a
    document is shuffled once, and of each place only what can be among the best goes on. Ids are strings.
    """
    words = F.coalesce("words", F.array().cast("array<string>"))
    documents = documents.where(F.col(scope).isNotNull()).select(F.col(scope).alias("s"), F.col(key).alias("id"), words.alias("words"))
    queries = queries.where(F.col(scope).isNotNull()).select(F.col(scope).alias("s"), F.col("query_id").alias("id"), words.alias("words"))
    large = _large(documents)
    # What lies in one place is counted there; scopes of several places need their statistics before.
    several = lambda rows: rows.join(large, F.col("s") == F.col("__s"))
    terms = lambda rows: rows.select("s", F.explode(F.array_distinct("words")).alias("term"))
    df = terms(several(documents)).groupBy("s", "term").agg(F.count("*").alias("df"))
    # The id is read here too: of queries that are groups the same shuffle then serves this and their places.
    wanted = terms(several(queries.where(F.length(F.coalesce("id", F.lit(""))) >= 0))).distinct().select(F.col("s").alias("__ws"), F.col("term").alias("__wt"))
    df = df.join(wanted, (F.col("s") == F.col("__ws")) & (F.col("term") == F.col("__wt")), "left_semi").groupBy(F.col("s").alias("__d")).agg(F.collect_list(F.struct("term", "df")).alias("t"))
    sizes = several(documents).groupBy("s", "n_docs", "parts").agg(F.greatest(F.avg(F.size("words")), F.lit(1.0)).alias("avgdl"))
    row = lambda kind, id, words, df=F.lit(None), n=F.lit(None), mean=F.lit(None): [
        "s", "part", F.lit(kind).alias("kind"), id.cast("string").alias("id"), F.array_join(words, " ").alias("words"), df.cast("array<bigint>").alias("df"), n.cast("bigint").alias("n_docs"), mean.cast("double").alias("avgdl"),
    ]
    everywhere, part = _parts()
    known = sizes.join(df, F.col("s") == F.col("__d")).select("*", everywhere)
    known = known.select(*row(0, F.lit(None), F.col("t.term"), F.col("t.df"), F.col("n_docs"), F.col("avgdl")))
    asked = queries.join(large, F.col("s") == F.col("__s"), "left").select("s", "id", "words", everywhere).select(*row(1, F.col("id"), F.col("words")))
    placed = documents.join(large, F.col("s") == F.col("__s"), "left").select("s", "id", "words", part).select(*row(2, F.col("id"), F.col("words")))
    every = known.unionByName(asked).unionByName(placed).repartition("s", "part").sortWithinPartitions("s", "part", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for rows in _places(batches):
            for found in _pairs_of_place(rows, k, k1, b):
                held.append(found)
                n += len(found[0])
                if n >= 10_000:
                    yield _as_frame(held, key)
                    held, n = [], 0
        if held:
            yield _as_frame(held, key)

    return every.mapInPandas(run, f"query_id string, {key} string, score double, share double")


def best_vectors(queries: DataFrame, documents: DataFrame, scope: str, key: str, k: int) -> DataFrame:
    """``query_id, key, score`` of the ``k`` documents of a query's scope that are nearest to it, and of some others: cosines of
    hashed embeddings to 6 digits as :func:`dense_all` has them, ties by key. ``queries`` has ``scope, query_id, text``,
    ``documents`` ``scope, key, text``; texts go to the places of :func:`best_pairs` and are embedded there, so no vector is shuffled."""
    documents = documents.where(F.col(scope).isNotNull()).select(F.col(scope).alias("s"), F.col(key).alias("id"), "text")
    queries = queries.where(F.col(scope).isNotNull()).select(F.col(scope).alias("s"), F.col("query_id").alias("id"), "text")
    large, (everywhere, part) = _large(documents), _parts()
    at = lambda rows, part, kind: rows.join(large, F.col("s") == F.col("__s"), "left").select("s", part, F.lit(kind).alias("kind"), "id", "text")
    every = at(queries, everywhere, 1).unionByName(at(documents, part, 2)).repartition("s", "part").sortWithinPartitions("s", "part", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for rows in _places(batches):
            asked, docs = ([r for r in rows if r[0] == kind] for kind in (1, 2))
            if not asked or not docs:
                continue
            d = _unit(hashed_all([r[2] for r in docs]))
            for low in range(0, len(asked), PLACE_QUERIES):
                some = asked[low : low + PLACE_QUERIES]
                held.append(_best([r[1] for r in some], _unit(hashed_all([r[2] for r in some])), [r[1] for r in docs], d, k, key))
                n += len(held[-1])
                if n >= 10_000:
                    yield pd.concat(held)
                    held, n = [], 0
        if held:
            yield pd.concat(held)

    return every.mapInPandas(run, f"query_id string, {key} string, score double")


def _large(documents: DataFrame) -> DataFrame:
    """``__s, n_docs, parts`` of the scopes ``s`` of several places, written."""
    counts = documents.groupBy(F.col("s").alias("__s")).agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > PLACE_DOCUMENTS)
    return stored(counts.withColumn("parts", F.ceil(F.col("n_docs") / PLACE_DOCUMENTS).cast("int")))


def _parts() -> tuple[Column, Column]:
    """The part of a row of a scope of ``parts``, null for one: every one, and that of its id."""
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    return every, F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")


def _as_frame(held: list[tuple], key: str) -> pd.DataFrame:
    return pd.DataFrame({name: np.concatenate(x) for name, x in zip(("query_id", key, "score", "share"), zip(*held))})


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """The rows of one place after another, without where they lie (``s, part``, the first columns); a place can go on over batches."""
    at, held = None, []
    for rows in batches:
        for row in zip(*(rows[c].tolist() for c in rows.columns)):
            if row[:2] != at:
                if held:
                    yield held
                at, held = row[:2], []
            held.append(row[2:])
    if held:
        yield held


def _pairs_of_place(rows: list[tuple], k: int, k1: float, b: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids of queries and documents, scores and shares of the pairs that are among the ``k`` best of a query here."""
    asked, docs = [r for r in rows if r[0] == 1], sorted((r for r in rows if r[0] == 2), key=lambda r: r[1])
    if not asked or not docs:
        return
    terms: dict[str, int] = {}
    number: dict[str, int] = {}
    q = np.array([(number.setdefault(r[1], len(number)), terms.setdefault(w, len(terms))) for r in asked for w in r[2].split()], dtype=np.int64).reshape(-1, 2)
    if not len(q):
        return
    split = [r[2].split() for r in docs]
    length = np.array([len(ws) for ws in split], dtype=np.float64)
    at = np.array([terms[w] * len(docs) + j for j, ws in enumerate(split) for w in ws if w in terms], dtype=np.int64)
    at, tf = np.unique(at, return_counts=True)
    term, doc = at // len(docs), at % len(docs)
    n, mean, df = len(docs), max(length.mean(), 1.0), np.bincount(term, minlength=len(terms)).astype(np.float64)
    for _, _, ws, counts, n_docs, avgdl in (r for r in rows if r[0] == 0):
        n, mean = n_docs, avgdl
        for w, c in zip(ws.split(), counts):
            df[terms[w]] = c
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean))
    pairs, times = np.unique(q[:, 0] * len(terms) + q[:, 1], return_counts=True)
    who, what = pairs // len(terms), pairs % len(terms)
    distinct = np.bincount(who, minlength=len(number)).astype(np.float64)
    query_ids, ids = np.array(list(number), dtype=object), np.array([r[1] for r in docs], dtype=object)
    here = np.zeros(len(terms), dtype=bool)
    here[term] = True
    for low in range(0, len(number), PLACE_QUERIES):
        of = slice(*np.searchsorted(who, (low, low + PLACE_QUERIES)))
        used = np.unique(what[of][here[what[of]]])
        if not len(used):
            continue
        place = np.full(len(terms), -1)
        place[used] = np.arange(len(used))
        x, w = np.zeros((len(used), len(docs))), np.zeros((min(PLACE_QUERIES, len(number) - low), len(used)))
        mine, mine_q = place[term] >= 0, place[what[of]] >= 0
        x[place[term[mine]], doc[mine]] = weight[mine]
        w[who[of][mine_q] - low, place[what[of]][mine_q]] = times[of][mine_q]
        shared = (w > 0).astype(np.float32) @ (x > 0).astype(np.float32)
        score = np.where(shared > 0, np.round(w @ x, 6), -1.0)
        share = shared.astype(np.float64) / distinct[low : low + len(w), None]
        keep = shared > 0
        if len(docs) > k:
            best = np.zeros_like(keep)
            for by in (score, share):
                np.put_along_axis(best, np.argsort(-by, axis=1, kind="stable")[:, :k], True, 1)
            keep &= best
        i, j = np.nonzero(keep)
        yield query_ids[low + i], ids[j], score[i, j], share[i, j]


def fuse(rankings: DataFrame, key: str, constant: int = 60, by_rank: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of rows ``query_id, source, key, rank``: ``query_id, key, score, best_rank, fused_rank``.

    A key that a source ranks twice counts once, with its first rank among distinct keys. ``by_rank`` puts ties of the
    score in order of the best source rank, then of the key; without it the key alone decides. ``carried`` columns, of one value for
    a query and key, are kept.
    """
    if constant <= 0:
        raise ValueError("the constant must be positive")
    first = rankings.groupBy("query_id", "source", key).agg(F.min("rank").alias("pos"), *[F.max(c).alias(c) for c in carried])
    dense = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("pos", key)))
    per = dense.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 8).alias("score"), F.min("rank").alias("best_rank"), *[F.max(c).alias(c) for c in carried])
    order = [F.col("score").desc(), *(["best_rank"] if by_rank else []), key]
    return per.withColumn("best_rank", F.col("best_rank").cast("long")).withColumn("fused_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))


def fused_with_ranks(lists: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of a lexical and a dense list after fusion, with the rank in each."""
    fused = fuse(lists, "chunk_id").where(F.col("fused_rank") <= k).select(F.col("query_id").alias("__q"), F.col("chunk_id").alias("__c"), F.col("score").alias("fused_score"), "fused_rank")
    rank = lambda s: F.max(F.when(F.col("source") == s, F.col("rank"))).alias(f"{s}_rank")
    per = lists.groupBy("query_id", "chunk_id").agg(rank("lexical"), rank("dense"))
    return fused.join(per, (F.col("__q") == F.col("query_id")) & (F.col("__c") == F.col("chunk_id"))).select("query_id", "chunk_id", "lexical_rank", "dense_rank", "fused_score", "fused_rank")


def rerank(scored: DataFrame, query_terms: str, document_terms: str, weight: float = 0.65) -> DataFrame:
    """Adds ``reranked``: the score as a share of the query's best, mixed with the share of query terms in the document."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    share = F.when(best <= 0, F.lit(0.0)).otherwise(F.col("score") / best)
    mixed = F.round(weight * share + (1 - weight) * X.overlap_ratio(F.col(query_terms), F.col(document_terms)), 6)
    return scored.withColumn("reranked", F.when(F.size(query_terms) == 0, F.col("score")).otherwise(mixed))


def keep_different(candidates: Column, limit: int, threshold: float = 0.85) -> Column:
    """Of an ordered array of structs with ``terms``, those whose terms are no near copy of any kept one, ``limit`` at most.

    The array is what one query retrieved, so it is short.
    """
    empty = F.slice(candidates, 1, 0)
    near = lambda kept, c: F.exists(kept, lambda k: X.jaccard(k["terms"], c["terms"]) >= threshold)
    return F.aggregate(candidates, empty, lambda kept, c: F.when((F.size(kept) >= limit) | near(kept, c), kept).otherwise(F.concat(kept, F.array(c))))


QUERY_BLOCK, DOCUMENT_BLOCK = 512, 4096
SENT_VALUES = 1 << 20
"""Numbers in the vectors of all queries up to which they are sent to the tasks, 8 MB; more go in blocks through a shuffle."""


def _blocks(rows: DataFrame, scope: str, key: str, vector: str, size: int) -> DataFrame:
    """Rows packed to ``scope, block, ids, vectors``; the block of a row comes from its hash, their number from a count."""
    counts = rows.groupBy(F.col(scope).alias("__s")).agg(F.ceil(F.count("*") / size).alias("n"))
    placed = rows.join(counts, F.col(scope) == F.col("__s")).withColumn("block", F.pmod(F.xxhash64(key), "n").cast("int"))
    return placed.groupBy(scope, "block").agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).alias("v"))).alias("rows"))


def _unit(vectors: list) -> np.ndarray:
    a = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-150)


def _best(query_ids: list, q: np.ndarray, ids: list, d: np.ndarray, k: int | None, key: str) -> pd.DataFrame:
    """Of unit vectors the best ``k`` documents of each query, or all, ties by the id."""
    s = np.round(q @ d.T, 6)
    order = np.argsort(np.array(ids), kind="stable")
    best = np.argsort(-s[:, order], axis=1, kind="stable")[:, :k]
    m = best.shape[1]
    return pd.DataFrame({"query_id": np.repeat(query_ids, m), key: np.array(ids)[order][best.ravel()], "score": np.take_along_axis(s[:, order], best, 1).ravel() + 0.0})


def _sent(queries: DataFrame, documents: DataFrame, scope: str, k: int | None, key: str, vector: str, schema: str) -> DataFrame:
    """Few queries go to the documents where they lie: nothing but the best of each batch is shuffled."""
    by_scope: dict = {}
    for r in queries.select(F.col(scope).alias("s"), "query_id", F.col(vector).alias("v")).collect():
        by_scope.setdefault(r["s"], ([], []))
        by_scope[r["s"]][0].append(r["query_id"])
        by_scope[r["s"]][1].append(r["v"])
    shared = queries.sparkSession.sparkContext.broadcast({s: (ids, _unit(vs)) for s, (ids, vs) in by_scope.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for s, part in rows.groupby("s", sort=False):
                if s in shared.value:
                    ids, q = shared.value[s]
                    yield _best(ids, q, part["id"].tolist(), _unit(part["v"].tolist()), k, key)

    return documents.select(F.col(scope).alias("s"), F.col(key).alias("id"), F.col(vector).alias("v")).mapInPandas(run, schema)


def _paired(queries: DataFrame, documents: DataFrame, scope: str, k: int | None, key: str, vector: str, schema: str) -> DataFrame:
    q = _blocks(queries, scope, "query_id", vector, QUERY_BLOCK).select(F.col(scope).alias("__qs"), F.col("block").alias("q_block"), F.col("rows").alias("q"))
    d = _blocks(documents, scope, key, vector, DOCUMENT_BLOCK).select(scope, F.col("block").alias("d_block"), F.col("rows").alias("d"))
    # Spread the documents' blocks over as many keys as there are query blocks, so a large scope uses many tasks.
    n = q.groupBy("__qs").agg(F.max("q_block").alias("most")).select(F.col("__qs").alias("__n"), "most")
    spread = d.join(n, F.col(scope) == F.col("__n")).select(scope, "d", F.explode(F.sequence(F.lit(0), "most")).alias("want"))
    pairs = spread.join(q, (F.col(scope) == F.col("__qs")) & (F.col("want") == F.col("q_block"))).select("q", "d")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for qs, ds in zip(rows["q"], rows["d"]):
                yield _best([x["id"] for x in qs], _unit([x["v"] for x in qs]), [x["id"] for x in ds], _unit([x["v"] for x in ds]), k, key)

    return pairs.mapInPandas(run, schema)


def dense_all(queries: DataFrame, documents: DataFrame, scope: str, key: str = "id", vector: str = "embedding", k: int | None = None) -> DataFrame:
    """Exact cosine ranking within the scope: ``query_id, key, score, rank``; scores to 6 digits, ties by key, the best ``k`` or all.

    A vector of length 0 scores 0; vectors must have one dimension. Queries whose vectors have ``SENT_VALUES`` numbers at
    most are sent to the documents; more queries and the documents are packed in blocks, and each pair of blocks of a scope is
    one matrix product, of which the best ``k`` per query go on.
    """
    values = queries.agg(F.sum(F.size(vector))).first()[0] or 0
    schema = f"query_id {dict(queries.dtypes)['query_id']}, {key} {dict(documents.dtypes)[key]}, score double"
    found = (_sent if values <= SENT_VALUES else _paired)(queries, documents, scope, k, key, vector, schema)
    if k is not None:
        return top(found, k, key)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return found.withColumn("rank", F.row_number().over(w).cast("long"))


def dense_top(queries: DataFrame, documents: DataFrame, scope: str, k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The best ``k`` of :func:`dense_all`."""
    return dense_all(queries, documents, scope, key, vector, k)
