"""Queries over chunks, postings, ranked lists and vectors, and their SQL."""

from __future__ import annotations

import unicodedata
from functools import cached_property

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.embedding import embed
from ..operators import chunks, retrieval
from ..session import discard, file_state, stored
from ..tables import table
from . import sqltext as S

QUERIES, SQL = {}, {}


def query(name, sql):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def made_chunks(spark, folder, keep=stored):
    """Chunks of every transcript: ``chunk_id, video_id, transcript_id, window, text, start_ms, end_ms``."""
    # Rows that differ in the normalised text alone are two, as in `segments`; its digest tells them apart, an empty one from the original.
    digest = F.when(F.col("normalized_text") == F.col("original_text"), F.unhex(F.lit(""))).otherwise(F.unhex(F.md5("normalized_text")))
    cues = table(spark, folder, "transcript_segments").select("id", "transcript_id", "sequence_number", "original_text", digest.alias("normalized"), "start_ms", "end_ms")
    videos = table(spark, folder, "transcripts").select(F.col("id").alias("transcript_id"), "video_id")
    return chunks.word_windows(cues, videos=videos, keep=keep).withColumn("chunk_id", F.concat("transcript_id", F.lit(":"), F.lpad(F.col("window").cast("string"), 6, "0")))


class Index:
    """What queries of one session read of a folder's chunks: the chunks, their postings and their vectors, each written to the
    shared folder when first asked for."""

    def __init__(self, spark, folder, state) -> None:
        self.spark, self.folder, self.state, self.written = spark, folder, state, []

    def _keep(self, df):
        self.written.append(stored(df))
        return self.written[-1]

    def holds(self, state) -> bool:
        """Whether the tables are those it was made of, and what was written is still there."""
        return self.state == state and all(file_state(self.spark, w.inputFiles()[0]) for w in self.written if w.inputFiles())

    @cached_property
    def chunks(self):
        passing = []
        made = self._keep(made_chunks(self.spark, self.folder, lambda df: passing.append(stored(df)) or passing[-1]))
        for df in passing:
            discard(df)
        return made

    @cached_property
    def postings(self):
        return retrieval.index_terms(self.chunks, "video_id", "chunk_id", X.tokens(F.col("text")), self._keep)

    @cached_property
    def folded(self):
        return retrieval.index_terms(self.chunks, "video_id", "chunk_id", folded_tokens(F.col("text")), self._keep)

    @cached_property
    def vectors(self):
        return self._keep(self.chunks.select("video_id", F.col("chunk_id").alias("id"), embed("text").alias("embedding")))


def index(spark, folder) -> Index:
    known = spark.sparkContext.__dict__.setdefault("_cuesmith_indexes", {})
    state = tuple(file_state(spark, f"{folder}/{name}.parquet") for name in ("transcripts", "transcript_segments"))
    if folder not in known or not known[folder].holds(state):
        known[folder] = Index(spark, folder, state)
    return known[folder]


def chunked(spark, folder):
    return index(spark, folder).chunks


def questions(spark, folder):
    """Each question of a video once: ``video_id, query_id, question``."""
    # Re-delivered rows don't change a minimum, so only these columns are shuffled.
    return table(spark, folder, "chat_messages").groupBy("video_id", "question").agg(F.min("message_id").alias("query_id"))


CHUNKS = f"""{S.SEGMENTS},
  wrd AS (SELECT transcript_id, sequence_number, id, start_ms, end_ms, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
          FROM (SELECT *, regexp_extract_all(coalesce(original_text, ''), '[^{S.WS[1:-2]}]+') AS ws FROM seg)),
  pos AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY sequence_number, id, i) - 1 AS ix, count(*) OVER (PARTITION BY transcript_id) AS total FROM wrd),
  win AS (SELECT *, unnest(range(CAST(greatest(ceil((ix - 139) / 110), 0) AS BIGINT), least(ix // 110, CAST(ceil(greatest(total - 140, 0) / 110) AS BIGINT)) + 1)) AS k FROM pos),
  chunks AS (SELECT win.transcript_id, t.video_id, k AS "window", win.transcript_id || ':' || lpad(CAST(k AS VARCHAR), 6, '0') AS chunk_id, string_agg(w, ' ' ORDER BY ix) AS text,
                    count(*) AS words, arg_min(win.id, ix) AS first_segment, min(start_ms) AS start_ms, max(end_ms) AS end_ms
             FROM win JOIN transcripts t ON t.id = win.transcript_id GROUP BY ALL)"""
QUESTIONS = f"{S.MESSAGES}, questions AS (SELECT video_id, question, min(message_id) AS query_id FROM msg GROUP BY 1, 2)"


@query("w5_word_windows", f"WITH {CHUNKS} SELECT chunk_id, text, words, first_segment, start_ms, end_ms FROM chunks")
def w5(spark, folder):
    return made_chunks(spark, folder).select("chunk_id", "text", "words", "first_segment", "start_ms", "end_ms")


TERMS = f"{CHUNKS}, toks AS (SELECT video_id, chunk_id, {S.tokens('text')} AS ts FROM chunks), post AS (SELECT video_id, chunk_id, term, count(*) AS tf FROM (SELECT video_id, chunk_id, unnest(ts) AS term FROM toks) GROUP BY ALL)"


@query("a1_document_frequency", f"WITH {TERMS} SELECT video_id, term, count(*) AS df FROM post GROUP BY ALL")
def a1(spark, folder):
    return index(spark, folder).postings.terms.select(F.col("__s").alias("video_id"), F.col("__term").alias("term"), "df")


@query("a2_term_frequency", f"WITH {TERMS} SELECT chunk_id, term, tf FROM post")
def a2(spark, folder):
    return index(spark, folder).postings.rows.select("chunk_id", "term", "tf")


@query("a3_average_length", f"WITH {TERMS} SELECT video_id, round(greatest(avg(len(ts)), 1.0), 6) AS avgdl, count(*) AS n_docs FROM toks GROUP BY 1")
def a3(spark, folder):
    sizes = chunked(spark, folder).select("video_id", F.size(X.tokens(F.col("text"))).alias("dl"))
    return sizes.groupBy("video_id").agg(F.round(F.greatest(F.avg("dl"), F.lit(1.0)), 6).alias("avgdl"), F.count("*").alias("n_docs"))


BM25 = f"""{TERMS}, {QUESTIONS}, df AS (SELECT video_id, term, count(*) AS df FROM post GROUP BY ALL),
  st AS (SELECT video_id, count(*) AS n, greatest(avg(len(ts)), 1.0) AS avgdl FROM toks GROUP BY 1), dl AS (SELECT chunk_id, len(ts) AS dl FROM toks),
  asked AS (SELECT query_id, video_id, unnest(list_distinct({S.tokens('question')})) AS term FROM questions),
  bm AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
         FROM asked JOIN df USING (video_id, term) JOIN st USING (video_id) JOIN post USING (video_id, term) JOIN dl USING (chunk_id) GROUP BY ALL)"""


def scored(spark, folder):
    asked = questions(spark, folder).select("video_id", "query_id", F.explode(F.array_distinct(X.tokens(F.col("question")))).alias("term"))
    return retrieval.bm25(asked, index(spark, folder).postings)


@query("a4_bm25_scores", f"WITH {BM25} SELECT * FROM bm")
def a4(spark, folder):
    return scored(spark, folder)


RANKED = f"{BM25}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm)"


@query("r1_bm25_search", f"WITH {RANKED} SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= 4 AND score > 0")
def r1(spark, folder):
    return retrieval.top(scored(spark, folder), 4, "chunk_id").where("score > 0")


FOLD_FROM = "".join(c for c in map(chr, range(0xC0, 0x1EFA)) if c.islower() and len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii())
FOLD_TO = "".join(unicodedata.normalize("NFD", c)[0] for c in FOLD_FROM)


def folded_tokens(c):
    """Tokens without accents; letters without a decomposition stay."""
    return F.regexp_extract_all(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), F.lit(X.WORD), F.lit(0))


def _sql_folded(c):
    return f"regexp_extract_all(translate(lower({c}), '{FOLD_FROM}', '{FOLD_TO}'), '[\\p{{L}}\\p{{N}}]+')"


FTS = f"""{CHUNKS}, {QUESTIONS}, toks AS (SELECT video_id, chunk_id, {_sql_folded('text')} AS ts FROM chunks), post AS (SELECT video_id, chunk_id, term, count(*) AS tf FROM (SELECT video_id, chunk_id, unnest(ts) AS term FROM toks) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), st AS (SELECT count(*) AS n, greatest(avg(len(ts)), 1.0) AS avgdl FROM toks), dl AS (SELECT chunk_id, len(ts) AS dl FROM toks),
  asked AS (SELECT query_id, video_id, unnest({_sql_folded('question')}) AS term FROM questions),
  bm AS (SELECT query_id, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
         FROM asked JOIN df USING (term) CROSS JOIN st JOIN post USING (video_id, term) JOIN dl USING (chunk_id) GROUP BY ALL)"""


def folded_scores(spark, folder):
    """Scores of the folded terms of each question in its video, with the statistics of all chunks."""
    post = index(spark, folder).folded
    total = chunked(spark, folder).agg(F.count("*").alias("n"), F.greatest(F.avg(F.size(folded_tokens(F.col("text")))), F.lit(1.0)).alias("mean"))  # one row
    everywhere = post.terms.groupBy(F.col("__term").alias("__t")).agg(F.sum("df").alias("all"))
    asked = questions(spark, folder).select(F.col("video_id").alias("__v"), "query_id", F.explode(folded_tokens(F.col("question"))).alias("__q"))
    weighted = asked.join(everywhere, F.col("__q") == F.col("__t")).crossJoin(F.broadcast(total))
    hits = post.rows.join(weighted, (F.col("video_id") == F.col("__v")) & (F.col("term") == F.col("__q")))
    idf = F.greatest(F.log((F.col("n") - F.col("all") + 0.5) / (F.col("all") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (1 - 0.75 + 0.75 * F.col("dl") / F.col("mean")))
    return hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))


@query("r2_full_text_search", f"WITH {FTS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 20")
def r2(spark, folder):
    return retrieval.top(folded_scores(spark, folder), 20, "chunk_id")


DENSE = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  dense AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_cosine_similarity(q.e, d.e), 6) AS score FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
  dranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dense)"""


def dense(spark, folder, k):
    """Queries are the vectors whose id is divisible by 100, against all vectors; a vector doesn't find itself."""
    e = table(spark, folder, "embeddings").select(F.lit(0).alias("scope"), F.col("vec_id").alias("id"), "embedding")
    q = e.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    found = retrieval.dense_top(q, e, "scope", k + 1).where("query_id <> id").drop("rank")
    return retrieval.top(found, k, "id")


@query("r3_dense_search", f"WITH {DENSE} SELECT * FROM dranked WHERE rank <= 10")
def r3(spark, folder):
    return dense(spark, folder, 10)


@query("r4_dense_positive", f"WITH {DENSE} SELECT * FROM dranked WHERE rank <= 50 AND score > 0")
def r4(spark, folder):
    return dense(spark, folder, 50).where("score > 0")


@query("r5_cosine_distance", f"WITH {DENSE} SELECT query_id, id, greatest(0.0, round(1 - (1 - score), 6)) AS score FROM dranked WHERE rank <= 20 AND round(1 - (1 - score), 6) > 0")
def r5(spark, folder):
    return dense(spark, folder, 20).select("query_id", "id", F.greatest(F.lit(0.0), F.round(1 - (1 - F.col("score")), 6)).alias("score")).where("score > 0")


# Two rankings of each question: by score, and by the share of its words in the chunk.
TWO = f"""{BM25}, share AS (SELECT b.query_id, b.chunk_id, len(list_intersect(list_distinct({S.tokens('question')}), ts)) / greatest(len(list_distinct({S.tokens('question')})), 1) AS share
            FROM bm b JOIN questions USING (query_id) JOIN toks USING (chunk_id)),
  lists AS (SELECT query_id, 'score' AS source, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm
            UNION ALL SELECT query_id, 'share', chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, chunk_id) FROM share),
  cut AS (SELECT * FROM lists WHERE rank <= 20), fused AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 8) AS score, min(rank) AS best_rank FROM cut GROUP BY ALL)"""


def two_ranks(spark, folder):
    """Pairs of a question and a chunk that are among its 20 best by score or by share, with both and the rank by each; a rank over
    20 is null."""
    docs = chunked(spark, folder).select("video_id", "chunk_id", X.tokens(F.col("text")).alias("words"))
    asked = questions(spark, folder).select("video_id", "query_id", F.array_distinct(X.tokens(F.col("question"))).alias("words"))
    pairs = retrieval.best_pairs(asked, docs, "video_id", "chunk_id", 20)
    rank = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(c).desc(), "chunk_id")).cast("long")
    ranks = pairs.select("*", rank("score").alias("score_rank"), rank("share").alias("share_rank")).where("score_rank <= 20 OR share_rank <= 20")
    return ranks.withColumns({c: F.when(F.col(c) <= 20, F.col(c)) for c in ("score_rank", "share_rank")})


def two_lists(spark, folder):
    lists = F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"{s}_rank").alias("rank")) for s in ("score", "share")])
    return two_ranks(spark, folder).select("query_id", "chunk_id", "share", F.explode(lists).alias("l")).select("query_id", "l.source", "chunk_id", "l.rank", "share").where("rank IS NOT NULL")


@query("r6_rank_fusion", f"WITH {TWO} SELECT query_id, chunk_id, score, best_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, chunk_id) AS fused_rank FROM fused")
def r6(spark, folder):
    return retrieval.fuse(two_lists(spark, folder), "chunk_id")


@query("t3_fusion_by_id", f"WITH {TWO} SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS fused_rank FROM fused) WHERE fused_rank <= 10")
def t3(spark, folder):
    return retrieval.fuse(two_lists(spark, folder), "chunk_id", by_rank=False).where("fused_rank <= 10").drop("best_rank")


@query(
    "j3_merged_lists",
    f"WITH {TWO}, a AS (SELECT * FROM cut WHERE source = 'score'), b AS (SELECT * FROM cut WHERE source = 'share') SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS score_rank, b.rank AS share_rank FROM a FULL JOIN b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id",
)
def j3(spark, folder):
    return two_ranks(spark, folder).select("query_id", "chunk_id", "score_rank", "share_rank")


@query(
    "r8_lexical_rerank",
    f"""WITH {RANKED}, best AS (SELECT query_id, max(score) AS best FROM ranked WHERE rank <= 8 GROUP BY 1), x AS (SELECT r.query_id, r.chunk_id, r.rank, round(0.65 * CASE WHEN best <= 0 THEN 0 ELSE score / best END
        + 0.35 * len(list_intersect(list_distinct({S.tokens('question')}), ts)) / len(list_distinct({S.tokens('question')})), 6) AS reranked
      FROM ranked r JOIN best USING (query_id) JOIN questions USING (query_id) JOIN toks USING (chunk_id) WHERE rank <= 8)
    SELECT query_id, chunk_id, reranked, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranked DESC, rank) AS new_rank FROM x) WHERE new_rank <= 4""",
)
def r8(spark, folder):
    pool = retrieval.top(scored(spark, folder), 8, "chunk_id")
    docs = chunked(spark, folder).select(F.col("chunk_id").alias("__c"), X.tokens(F.col("text")).alias("d_terms"))
    asked = questions(spark, folder).select(F.col("query_id").alias("__q"), X.tokens(F.col("question")).alias("q_terms"))
    both = pool.join(docs, F.col("chunk_id") == F.col("__c")).join(asked, F.col("query_id") == F.col("__q"))
    again = retrieval.rerank(both, "q_terms", "d_terms").select("query_id", "chunk_id", "reranked", F.col("rank").alias("old"))
    return retrieval.top(again, 4, "old", score="reranked").select("query_id", "chunk_id", "reranked", F.col("rank").alias("new_rank"))


def embedded(spark, folder):
    asked = questions(spark, folder).select("video_id", "query_id", embed("question").alias("embedding"))
    return asked, index(spark, folder).vectors


@query("r7_hybrid_search", None)
def r7(spark, folder):
    """Lexical and hashed dense ranking of each question in its video, fused; the rank in each list is kept."""
    asked, docs = embedded(spark, folder)
    d = retrieval.dense_top(asked, docs, "video_id", 8).where("score > 0").select("query_id", F.lit("dense").alias("source"), F.col("id").alias("chunk_id"), "rank")
    lex = retrieval.top(scored(spark, folder), 8, "chunk_id").where("score > 0").select("query_id", F.lit("lexical").alias("source"), "chunk_id", "rank")
    return retrieval.fused_with_ranks(lex.unionByName(d), 4)


@query("r15_hashed_embedding", None)
def r15(spark, folder):
    return table(spark, folder, "documents").select("doc_id", embed("text").alias("embedding"))


EXPANDED = f"""{RANKED}, hits AS (SELECT r.query_id, r.rank, c.transcript_id, c."window" AS ix FROM ranked r JOIN chunks c USING (chunk_id) WHERE rank <= 4),
  near AS (SELECT h.query_id, h.rank, o.o AS kind, c.chunk_id FROM hits h CROSS JOIN (VALUES (0, 0), (1, -1), (2, 1)) o(o, d) JOIN chunks c ON c.transcript_id = h.transcript_id AND c."window" = h.ix + o.d),
  once AS (SELECT query_id, chunk_id, min(rank * 10 + kind) AS ord FROM near GROUP BY ALL)"""


@query("w17_context_expansion", f"WITH {EXPANDED} SELECT query_id, chunk_id, place FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS place FROM once) WHERE place <= 8")
def w17(spark, folder):
    docs = chunked(spark, folder)
    hits = retrieval.top(scored(spark, folder), 4, "chunk_id").join(docs.select(F.col("chunk_id").alias("__c"), "transcript_id", "window"), F.col("chunk_id") == F.col("__c"))
    places = F.array(*[F.struct(F.lit(k).alias("kind"), (F.col("window") + d).alias("want")) for k, d in ((0, 0), (1, -1), (2, 1))])
    wanted = hits.select("query_id", "rank", F.col("transcript_id").alias("__t"), F.explode(places).alias("p"))
    near = wanted.join(docs.select("transcript_id", "window", "chunk_id"), (F.col("__t") == F.col("transcript_id")) & (F.col("p.want") == F.col("window")))
    once = near.groupBy("query_id", "chunk_id").agg(F.min(F.col("rank") * 10 + F.col("p.kind")).alias("ord"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("ord")).cast("long")).where("place <= 8").select("query_id", "chunk_id", "place")


@query("pred12_groundedness_gate", f"WITH {RANKED} SELECT q.query_id, CASE WHEN max(score) IS NULL THEN 'none' WHEN max(score) < 6.0 THEN 'low' ELSE 'ok' END AS gate FROM questions q LEFT JOIN ranked r ON r.query_id = q.query_id AND rank <= 4 GROUP BY 1")
def pred12(spark, folder):
    best = retrieval.top(scored(spark, folder), 1, "chunk_id").select(F.col("query_id").alias("__q"), "score")
    gate = F.when(F.col("score").isNull(), "none").when(F.col("score") < 6.0, "low").otherwise("ok")
    return questions(spark, folder).join(best, F.col("query_id") == F.col("__q"), "left").select("query_id", gate.alias("gate"))


@query("d1_extractive_answer", f"WITH {RANKED} SELECT query_id, string_agg('- [' || {S.clock('start_ms / 1000.0')} || '] ' || text, chr(10) ORDER BY rank) AS answer FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 3 GROUP BY 1")
def d1(spark, folder):
    docs = chunked(spark, folder).select(F.col("chunk_id").alias("__c"), "text", "start_ms")
    best = retrieval.top(scored(spark, folder), 3, "chunk_id").join(docs, F.col("chunk_id") == F.col("__c"))
    line = F.concat(F.lit("- ["), X.minutes_seconds(F.col("start_ms") / 1000), F.lit("] "), "text")
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return best.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("answer"))


METRICS = f"""{RANKED}, rel AS (SELECT r.query_id, r.chunk_id, r.rank, contains(lower(c.text), lower(regexp_extract(question, '(?:about|về|đề cập|with|mention|nhắc đến|is|thì) (.{{6,24}})', 1))) AND regexp_extract(question, '(?:about|về|đề cập|with|mention|nhắc đến|is|thì) (.{{6,24}})', 1) <> '' AS hit FROM ranked r JOIN questions USING (query_id) JOIN chunks c USING (chunk_id)),
  per AS (SELECT query_id, sum(CASE WHEN hit AND rank <= 3 THEN 1 ELSE 0 END) AS found, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS relevant, min(CASE WHEN hit THEN rank END) AS first_hit,
          sum(CASE WHEN hit AND rank <= 3 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM rel GROUP BY 1),
  m AS (SELECT query_id, round(CASE WHEN relevant = 0 THEN 1.0 ELSE found / relevant END, 4) AS recall, CASE WHEN relevant = 0 OR found > 0 THEN 1e0 ELSE 0e0 END AS hit,
          round(CASE WHEN relevant = 0 THEN 1.0 WHEN first_hit <= 3 THEN 1.0 / first_hit ELSE 0.0 END, 4) AS mrr,
          round(CASE WHEN relevant = 0 THEN 1.0 WHEN found = 0 THEN 0.0 ELSE dcg / (CASE found WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 + 1 / log2(3) ELSE 1.0 + 1 / log2(3) + 0.5 END) END, 4) AS ndcg, relevant = 0 AS unanswerable FROM per)"""


def metrics(spark, folder):
    """Per question recall, hit, reciprocal rank and gain at 3; the gain's ideal counts the hits found, and a question
    without a relevant chunk scores 1."""
    docs = chunked(spark, folder).select(F.col("chunk_id").alias("__c"), F.lower("text").alias("text"))
    topic = F.regexp_extract("question", "(?:about|về|đề cập|with|mention|nhắc đến|is|thì) (.{6,24})", 1)
    asked = questions(spark, folder).select(F.col("query_id").alias("__q"), F.lower(topic).alias("topic"))
    every = scored(spark, folder).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")).cast("long"))
    rel = every.join(docs, F.col("chunk_id") == F.col("__c")).join(asked, F.col("query_id") == F.col("__q")).withColumn("rel", F.contains("text", "topic") & (F.col("topic") != ""))
    near = F.col("rel") & (F.col("rank") <= 3)
    per = rel.groupBy("query_id").agg(
        F.sum(F.when(near, 1).otherwise(0)).alias("found"), F.sum(F.when(F.col("rel"), 1).otherwise(0)).alias("relevant"),
        F.min(F.when(F.col("rel"), F.col("rank"))).alias("first_hit"), F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.when(F.col("found") == 1, 1.0).when(F.col("found") == 2, 1.0 + 1 / F.log2(F.lit(3))).otherwise(1.5 + 1 / F.log2(F.lit(3)))
    none, found = F.col("relevant") == 0, F.col("found")
    return per.select(
        "query_id", F.round(F.when(none, 1.0).otherwise(found / F.col("relevant")), 4).alias("recall"), F.when(none | (found > 0), 1.0).otherwise(0.0).alias("hit"),
        F.round(F.when(none, 1.0).when(F.col("first_hit") <= 3, 1.0 / F.col("first_hit")).otherwise(0.0), 4).alias("mrr"),
        F.round(F.when(none, 1.0).when(found == 0, 0.0).otherwise(F.col("dcg") / ideal), 4).alias("ndcg"), none.alias("unanswerable"),
    )


@query("a10_question_metrics", f"WITH {METRICS} SELECT * FROM m")
def a10(spark, folder):
    return metrics(spark, folder)


@query("a11_macro_average", f"WITH {METRICS} SELECT round(avg(recall), 4) AS recall, round(avg(hit), 4) AS hit, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(CASE WHEN unanswerable THEN 1.0 ELSE 0.0 END), 4) AS unanswerable FROM m")
def a11(spark, folder):
    one = metrics(spark, folder).withColumn("unanswerable", F.when(F.col("unanswerable"), 1.0).otherwise(0.0))
    return one.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("recall", "hit", "mrr", "ndcg", "unanswerable")])


EVERY = f"""{RANKED}, topics AS (SELECT query_id, video_id, lower(regexp_extract(question, '(?:about|về|đề cập|with|mention|nhắc đến|is|thì) (.{{6,24}})', 1)) AS topic FROM questions),
  rel AS (SELECT query_id, chunk_id FROM topics JOIN chunks USING (video_id) WHERE topic <> '' AND contains(lower(text), topic)),
  per AS (SELECT query_id, count(r.chunk_id) AS got, count(rel.chunk_id) AS found, min(CASE WHEN rel.chunk_id IS NOT NULL THEN rank END) AS first_hit, sum(CASE WHEN rel.chunk_id IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg
          FROM ranked r LEFT JOIN rel USING (query_id, chunk_id) WHERE rank <= 3 GROUP BY 1),
  e AS (SELECT query_id, coalesce(got, 0) AS got, coalesce(found, 0) AS found, first_hit, dcg, coalesce(relevant, 0) AS relevant FROM topics LEFT JOIN per USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS relevant FROM rel GROUP BY 1) USING (query_id)),
  m AS (SELECT query_id, round(CASE WHEN relevant = 0 THEN 1.0 ELSE found / relevant END, 4) AS recall, CASE WHEN relevant = 0 OR found > 0 THEN 1e0 ELSE 0e0 END AS hit, round(CASE WHEN relevant = 0 THEN 1.0 WHEN found > 0 THEN 1.0 / first_hit ELSE 0.0 END, 4) AS mrr,
          round(CASE WHEN relevant = 0 THEN 1.0 WHEN found = 0 THEN 0.0 ELSE dcg / (CASE found WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 + 1 / log2(3) ELSE 1.0 + 1 / log2(3) + 0.5 END) END, 4) AS ndcg,
          round(CASE WHEN relevant = 0 THEN 1.0 ELSE found / greatest(got, 1) END, 4) AS citation_accuracy, CASE WHEN relevant = 0 AND got > 0 THEN 1e0 ELSE 0e0 END AS unanswerable_false_positive, relevant = 0 AS unanswerable FROM e)"""


def every_metrics(spark, folder):
    """Metrics at 3 of every question, whatever it found; all chunks of its video can be relevant.

    The gain's ideal counts the hits found, as in the reference. A question without a relevant chunk scores 1, and is a
    false positive if anything was retrieved; one that found nothing of what there is scores 0.
    """
    docs = chunked(spark, folder).select("video_id", "chunk_id", "text")
    topic = F.lower(F.regexp_extract("question", "(?:about|về|đề cập|with|mention|nhắc đến|is|thì) (.{6,24})", 1))
    asked = questions(spark, folder).select("video_id", "query_id", "question", topic.alias("topic"))
    # Topics repeat within a video, so each meets its chunks once.
    topics = asked.where("topic <> ''").select(F.col("video_id").alias("__v"), "topic").distinct()
    rel = topics.join(docs, (F.col("__v") == F.col("video_id")) & F.contains(F.lower("text"), F.col("topic"))).select("__v", F.col("topic").alias("__t"), F.col("chunk_id").alias("__c"))
    counts = rel.groupBy("__v", "__t").agg(F.count("*").alias("relevant"))
    terms = asked.select("video_id", "query_id", F.explode(F.array_distinct(X.tokens(F.col("question")))).alias("term"))
    best = retrieval.top(retrieval.bm25(terms, index(spark, folder).postings), 3, "chunk_id").select(F.col("query_id").alias("__q"), "chunk_id", "rank")
    lists = asked.join(best, F.col("query_id") == F.col("__q"), "left").join(rel, (F.col("video_id") == F.col("__v")) & (F.col("topic") == F.col("__t")) & (F.col("chunk_id") == F.col("__c")), "left")
    good = F.col("__c").isNotNull()
    per = lists.groupBy("query_id", "video_id", "topic").agg(
        F.count("chunk_id").alias("got"), F.count("__c").alias("found"), F.min(F.when(good, F.col("rank"))).alias("first_hit"), F.sum(F.when(good, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    both = per.join(counts, (F.col("video_id") == F.col("__v")) & (F.col("topic") == F.col("__t")), "left")
    ideal = F.when(F.col("found") == 1, 1.0).when(F.col("found") == 2, 1.0 + 1 / F.log2(F.lit(3))).otherwise(1.5 + 1 / F.log2(F.lit(3)))
    none, found = F.col("relevant").isNull(), F.col("found")
    return both.select(
        "query_id", F.round(F.when(none, 1.0).otherwise(found / F.col("relevant")), 4).alias("recall"), F.when(none | (found > 0), 1.0).otherwise(0.0).alias("hit"),
        F.round(F.when(none, 1.0).when(found > 0, 1.0 / F.col("first_hit")).otherwise(0.0), 4).alias("mrr"),
        F.round(F.when(none, 1.0).when(found == 0, 0.0).otherwise(F.col("dcg") / ideal), 4).alias("ndcg"),
        F.round(F.when(none, 1.0).otherwise(found / F.greatest("got", F.lit(1))), 4).alias("citation_accuracy"),
        F.when(none & (F.col("got") > 0), 1.0).otherwise(0.0).alias("unanswerable_false_positive"), none.alias("unanswerable"),
    )


@query("a10_every_question", f"WITH {EVERY} SELECT * FROM m")
def a10_every(spark, folder):
    return every_metrics(spark, folder)


@query("a11_every_average", f"WITH {EVERY} SELECT round(avg(recall), 4) AS recall, round(avg(hit), 4) AS hit, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(citation_accuracy), 4) AS citation_accuracy, round(avg(unanswerable_false_positive) FILTER (unanswerable), 4) AS unanswerable_false_positive, round(avg(CASE WHEN unanswerable THEN 1.0 ELSE 0.0 END), 4) AS unanswerable FROM m")
def a11_every(spark, folder):
    """Averages over all questions; false positives over those without a relevant chunk."""
    one = every_metrics(spark, folder).withColumn("unanswerable_false_positive", F.when(F.col("unanswerable"), F.col("unanswerable_false_positive"))).withColumn("unanswerable", F.when(F.col("unanswerable"), 1.0).otherwise(0.0))
    return one.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("recall", "hit", "mrr", "ndcg", "citation_accuracy", "unanswerable_false_positive", "unanswerable")])


@query("r13_tf_ranking", f"WITH {TERMS}, {QUESTIONS}, dl AS (SELECT chunk_id, len(ts) AS dl FROM toks), asked AS (SELECT query_id, video_id, unnest(list_distinct({S.tokens('question')})) AS term FROM questions), s AS (SELECT query_id, chunk_id, round(sum(tf) / sqrt(greatest(any_value(dl), 1)), 6) AS score FROM asked JOIN post USING (video_id, term) JOIN dl USING (chunk_id) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s")
def r13(spark, folder):
    asked = questions(spark, folder).select(F.col("video_id").alias("__v"), "query_id", F.explode(F.array_distinct(X.tokens(F.col("question")))).alias("__q"))
    post = index(spark, folder).postings.rows
    hits = post.join(asked, (F.col("video_id") == F.col("__v")) & (F.col("term") == F.col("__q"))).groupBy("query_id", "chunk_id").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    s = hits.select("query_id", "chunk_id", F.round(F.col("tf") / F.sqrt(F.greatest("dl", F.lit(1))), 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")).cast("long"))
