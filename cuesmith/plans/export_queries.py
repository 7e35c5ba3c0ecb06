"""Queries of exports and reports, incremental postings, uncut rankings and searches with stand-in vectors, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieval
from ..session import checkpoint_folder, stored
from ..sources import subtitles
from ..sources.providers import FakeEmbedding
from ..tables import table
from . import sqltext as S
from .content_queries import subtitle_files
from .fold_queries import READ
from .record_queries import _SEGMENT_METRICS, STUDY, by_segments
from .record_queries import SQL as RECORD_SQL
from .retrieval_queries import BM25, CHUNKS, QUESTIONS, RANKED, TERMS, chunked, index, questions, scored
from .scalar_queries import segments

QUERIES, SQL = {}, {}


def query(name, sql):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# Exports

_URL = "'https://www.youtube.com/watch?v='"
_LIST = f"array_to_string(list_transform(sources, lambda s: '- [' || {S.clock('s.start_seconds')} || '](' || {_URL} || video_id || '&t=' || CAST(greatest(CAST(floor(s.start_seconds) AS BIGINT), 0) AS VARCHAR) || 's) - ' || {S.squeeze('s.text')}), chr(10))"


@query(
    "k9_library_pages",
    f"""WITH {CHUNKS}, m AS (SELECT DISTINCT message_id, video_id, question, answer, generation, sources FROM chat_messages WHERE video_id IS NOT NULL),
      n AS (SELECT video_id, count(*) AS n FROM chunks GROUP BY 1),
      q AS (SELECT video_id, message_id, trim(question) || chr(10) || chr(10) || trim(coalesce(answer, '')) || chr(10) || chr(10) || 'Generation: ' || generation.generation_mode || ' (' || generation.provider || ')'
              || CASE WHEN generation.fallback_reason IS NOT NULL THEN chr(10) || 'Fallback reason: ' || generation.fallback_reason ELSE '' END || chr(10) || chr(10)
              || CASE WHEN len(sources) > 0 THEN '### Q&A sources' || chr(10) || chr(10) || {_LIST} || chr(10) || chr(10) ELSE '' END AS body, row_number() OVER (PARTITION BY video_id ORDER BY message_id) AS k FROM m),
      c AS (SELECT video_id, string_agg(k || '. ' || body, '' ORDER BY k) AS body FROM q WHERE k <= 3 GROUP BY 1)
    SELECT v.id AS video_id, rtrim('# ' || trim(coalesce(v.title, 'YouTube video ' || v.id)) || chr(10) || chr(10) || '## Video' || chr(10) || chr(10) || '- Video ID: ' || v.id || chr(10) || '- URL: ' || coalesce(v.canonical_url, {_URL} || v.id) || chr(10)
      || '- Chunks: ' || coalesce(CAST(n.n AS VARCHAR), 'Unknown') || CASE WHEN v.duration_ms IS NOT NULL THEN chr(10) || '- Duration: ' || CAST(v.duration_ms // 1000 AS VARCHAR) || ' seconds' ELSE '' END
      || chr(10) || chr(10) || '## Selected Q&A' || chr(10) || chr(10) || coalesce(c.body, 'No chat answers have been selected for export.'), chr(10) || ' ') || chr(10) AS page
    FROM videos v LEFT JOIN n ON n.video_id = v.id LEFT JOIN c ON c.video_id = v.id""",
)
def k9(spark, folder):
    """A page for each video: its header and the first three of its messages with their sources."""
    m = table(spark, folder, "chat_messages").where("video_id IS NOT NULL").select("message_id", "video_id", "question", "answer", "generation", "sources").dropDuplicates(["message_id"])
    link = lambda s: F.concat(F.lit("- ["), X.minutes_seconds(s["start_seconds"]), F.lit("]("), X.deep_link(F.col("video_id"), s["start_seconds"]), F.lit(") - "), X.squeeze(s["text"]))
    cited = F.when(F.size("sources") > 0, F.concat(F.lit("### Q&A sources\n\n"), F.array_join(F.transform("sources", link), "\n"), F.lit("\n\n"))).otherwise("")
    why = F.coalesce(F.concat(F.lit("\nFallback reason: "), "generation.fallback_reason"), F.lit(""))
    body = F.concat(F.trim("question"), F.lit("\n\n"), F.trim(F.coalesce("answer", F.lit(""))), F.lit("\n\nGeneration: "), "generation.generation_mode", F.lit(" ("), "generation.provider", F.lit(")"), why, F.lit("\n\n"), cited)
    first = m.withColumn("k", F.row_number().over(Window.partitionBy("video_id").orderBy("message_id"))).where("k <= 3")
    c = first.groupBy(F.col("video_id").alias("__v")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat(F.col("k").cast("string"), F.lit(". "), body).alias("b")))), lambda x: x["b"]), "").alias("chat"))
    n = chunked(spark, folder).groupBy(F.col("video_id").alias("__n")).agg(F.count("*").alias("n"))
    v = table(spark, folder, "videos").join(c, F.col("id") == F.col("__v"), "left").join(n, F.col("id") == F.col("__n"), "left")
    page = F.concat(
        F.lit("# "), F.trim(F.coalesce("title", F.concat(F.lit("YouTube video "), "id"))), F.lit("\n\n## Video\n\n- Video ID: "), "id", F.lit("\n- URL: "), F.coalesce("canonical_url", F.concat(F.lit("https://www.youtube.com/watch?v="), "id")),
        F.lit("\n- Chunks: "), F.coalesce(F.col("n").cast("string"), F.lit("Unknown")), F.coalesce(F.concat(F.lit("\n- Duration: "), F.floor(F.col("duration_ms") / 1000).cast("string"), F.lit(" seconds")), F.lit("")),
        F.lit("\n\n## Selected Q&A\n\n"), F.coalesce("chat", F.lit("No chat answers have been selected for export.")),
    )
    return v.select(F.col("id").alias("video_id"), F.concat(F.rtrim(page, F.lit("\n ")), F.lit("\n")).alias("page"))


_FIGURES = ("recall", "hit", "mrr", "ndcg", "citation_accuracy")
_PRINTED = " || ' | ' || ".join(f"printf('%.4f', {c})" for c in _FIGURES)


@query("k11_evaluation_report", f"WITH {_SEGMENT_METRICS}, t AS (SELECT {', '.join(f'round(avg({c}), 4) AS {c}' for c in _FIGURES)}, count(*) AS n FROM qm) SELECT '# Retrieval evaluation' || chr(10) || chr(10) || 'Questions: ' || n || chr(10) || chr(10) || '| Variant | ' || '{' | '.join(_FIGURES)} |' || chr(10) || '|---|---:|---:|---:|---:|---:|' || chr(10) || '| lexical | ' || {_PRINTED} || ' |' || chr(10) AS report FROM t")
def k11(spark, folder):
    """The report of an evaluation, written as JSON and as Markdown to the shared folder; the query gives the Markdown read back."""
    one = by_segments(spark, folder).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in _FIGURES])
    path = f"{checkpoint_folder(spark)}/report-{uuid.uuid4().hex}"
    one.coalesce(1).write.json(f"{path}/json")
    read = spark.read.schema(one.schema).json(f"{path}/json")
    row = F.concat(F.lit("| lexical | "), F.concat_ws(" | ", *[F.format_string("%.4f", c) for c in _FIGURES]), F.lit(" |\n"))
    page = F.concat(F.lit("# Retrieval evaluation\n\nQuestions: "), F.col("n").cast("string"), F.lit("\n\n| Variant | " + " | ".join(_FIGURES) + " |\n|---|---:|---:|---:|---:|---:|\n"), row)
    read.select(page.alias("value")).coalesce(1).write.text(f"{path}/markdown", lineSep="\u0001")
    return spark.read.text(f"{path}/markdown", lineSep="\u0001").select(F.col("value").alias("report"))


# Postings


@query(
    "k7_incremental_postings",
    f"""WITH {S.SEGMENTS}, changed AS (SELECT DISTINCT transcript_id FROM index_versions WHERE status = 'retired'),
      t AS (SELECT id, transcript_id, unnest({S.tokens("coalesce(CASE WHEN transcript_id IN (FROM changed) THEN normalized_text ELSE original_text END, '')")}) AS term FROM seg WHERE transcript_id NOT IN (SELECT transcript_id FROM index_versions WHERE status = 'failed'))
    SELECT id, term, count(*) AS tf FROM t GROUP BY ALL""",
)
def k7(spark, folder):
    """Postings kept up to date: those of changed documents give way to new ones, those of deleted ones go, the rest stay as they are."""
    s = segments(spark, folder)
    post = retrieval.index_terms(s.select("transcript_id", "id", F.coalesce("original_text", F.lit("")).alias("text")), "transcript_id", "id", X.tokens(F.col("text")), stored)
    versions = table(spark, folder, "index_versions")
    changed = versions.where("status = 'retired'").select("transcript_id").distinct()
    deleted = versions.where("status = 'failed'").select("transcript_id").distinct()
    new = s.join(changed.select(F.col("transcript_id").alias("__t")), F.col("transcript_id") == F.col("__t"), "left_semi").select("transcript_id", "id", F.coalesce("normalized_text", F.lit("")).alias("text"))
    return retrieval.updated(post, new, X.tokens(F.col("text")), changed, deleted).select("id", "term", "tf")


# Rankings

_VECTOR = "list_transform(range(32), lambda i: (CAST('0x' || substr(sha256(CAST(i AS VARCHAR) || chr(10) || {}), 1, 2) AS INTEGER) - 127.5) / 128)"
_FAKE = f"""{RANKED}, cv AS (SELECT video_id, chunk_id, {_VECTOR.format('text')} AS e FROM chunks), qv AS (SELECT video_id, query_id, {_VECTOR.format('question')} AS e FROM questions),
  dn AS (SELECT q.query_id, c.chunk_id, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM qv q JOIN cv c USING (video_id)), dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dn)"""


def fake_vectors(spark, folder):
    column = FakeEmbedding(32).column
    docs = chunked(spark, folder).select("video_id", F.col("chunk_id").alias("id"), column("text").alias("embedding"))
    asked = questions(spark, folder).select("video_id", "query_id", column("question").alias("embedding"))
    return asked, docs


@query(
    "r7_fused_search",
    f"""WITH {_FAKE}, l AS (SELECT query_id, 'lexical' AS source, chunk_id, rank FROM ranked WHERE rank <= 8 AND score > 0 UNION ALL SELECT query_id, 'dense', chunk_id, rank FROM dr WHERE rank <= 8 AND score > 0),
      p AS (SELECT query_id, source, chunk_id, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS rank FROM l),
      f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 8) AS fused_score, min(rank) AS best, max(rank) FILTER (source = 'lexical') AS lexical_rank, max(rank) FILTER (source = 'dense') AS dense_rank FROM p GROUP BY ALL)
    SELECT query_id, chunk_id, lexical_rank, dense_rank, fused_score, fused_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, best, chunk_id) AS fused_rank FROM f) WHERE fused_rank <= 4""",
)
def r7(spark, folder):
    """Hybrid search with the stand-in vectors: eight of each source, fused, the best four with their rank in each list."""
    asked, docs = fake_vectors(spark, folder)
    d = retrieval.dense_top(asked, docs, "video_id", 8).where("score > 0").select("query_id", F.lit("dense").alias("source"), F.col("id").alias("chunk_id"), "rank")
    lex = retrieval.top(scored(spark, folder), 8, "chunk_id").where("score > 0").select("query_id", F.lit("lexical").alias("source"), "chunk_id", "rank")
    return retrieval.fused_with_ranks(lex.unionByName(d), 4)


_FULL = f"""{TERMS}, {QUESTIONS}, asked AS (SELECT query_id, video_id, unnest(list_distinct({S.tokens('question')})) AS term FROM questions),
  hit AS (SELECT query_id, chunk_id, sum(tf) AS tf FROM asked JOIN post USING (video_id, term) GROUP BY ALL),
  lx AS (SELECT q.query_id, t.chunk_id, round(coalesce(h.tf, 0) / sqrt(greatest(len(t.ts), 1)), 6) AS score FROM questions q JOIN toks t USING (video_id) LEFT JOIN hit h ON h.query_id = q.query_id AND h.chunk_id = t.chunk_id),
  lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lx)"""
_FULL_DENSE = f"""{_FULL}, cv AS (SELECT video_id, chunk_id, {_VECTOR.format('text')} AS e FROM chunks), qv AS (SELECT video_id, query_id, {_VECTOR.format('question')} AS e FROM questions),
  dn AS (SELECT q.query_id, c.chunk_id, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM qv q JOIN cv c USING (video_id)), dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dn)"""


def full_lexical(spark, folder):
    """Every chunk of a question's video by its shared terms over the root of its length; those without one score 0."""
    asked = questions(spark, folder).select("video_id", "query_id", F.explode(F.array_distinct(X.tokens(F.col("question")))).alias("__t"))
    post = index(spark, folder).postings.rows
    hits = post.join(asked.withColumnRenamed("video_id", "__v"), (F.col("video_id") == F.col("__v")) & (F.col("term") == F.col("__t"))).groupBy(F.col("query_id").alias("__q"), F.col("chunk_id").alias("__c")).agg(F.sum("tf").alias("tf"))
    docs = chunked(spark, folder).select(F.col("video_id").alias("__d"), "chunk_id", F.size(X.tokens(F.col("text"))).alias("dl"))
    every = questions(spark, folder).select("query_id", "video_id").join(docs, F.col("video_id") == F.col("__d"))
    s = every.join(hits, (F.col("query_id") == F.col("__q")) & (F.col("chunk_id") == F.col("__c")), "left")
    s = s.select("query_id", "chunk_id", F.round(F.coalesce("tf", F.lit(0)) / F.sqrt(F.greatest("dl", F.lit(1))), 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")).cast("long"))


def full_dense(spark, folder):
    asked, docs = fake_vectors(spark, folder)
    return retrieval.dense_all(asked, docs, "video_id").select("query_id", F.col("id").alias("chunk_id"), "score", "rank")


@query("r13_full_lexical", f"WITH {_FULL} SELECT * FROM lr")
def r13(spark, folder):
    return full_lexical(spark, folder)


@query("r13_full_dense", f"WITH {_FULL_DENSE} SELECT * FROM dr")
def r13_dense(spark, folder):
    return full_dense(spark, folder)


_FUSED = f"{_FULL_DENSE}, u AS (SELECT query_id, chunk_id, rank FROM lr UNION ALL SELECT query_id, chunk_id, rank FROM dr), fu AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 8) AS score FROM u GROUP BY ALL)"


@query("r13_full_fusion", f"WITH {_FUSED} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fu")
def r13_fusion(spark, folder):
    """Both whole rankings fused, ties by the id alone."""
    both = full_lexical(spark, folder).select("query_id", "chunk_id", "rank").unionByName(full_dense(spark, folder).select("query_id", "chunk_id", "rank"))
    s = both.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 8).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")).cast("long"))


@query("d12_expanded_queries", "WITH " + RECORD_SQL["t9_source_choice"].split("WITH ", 1)[1].split(",\n      hits AS", 1)[0] + ", h AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rk FROM bm), u AS (SELECT c.video_id, h.chunk_id, max(h.score) AS score FROM h JOIN chunks c USING (chunk_id) WHERE rk <= 3 GROUP BY ALL) SELECT video_id, chunk_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, chunk_id) AS place FROM u) WHERE place <= 6")
def d12(spark, folder):
    """For each video the study questions asked one by one, the best three of each, merged by score; six at most."""
    asked = table(spark, folder, "videos").select(F.col("id").alias("video_id"), F.posexplode(F.array(*map(F.lit, STUDY))).alias("k", "q"))
    terms = asked.select("video_id", F.concat_ws(":", "video_id", "k").alias("query_id"), F.explode(F.array_distinct(X.tokens(F.col("q")))).alias("term"))
    hits = retrieval.top(retrieval.bm25(terms, index(spark, folder).postings), 3, "chunk_id").select(F.element_at(F.split("query_id", ":"), 1).alias("video_id"), "chunk_id", "score")
    best = hits.groupBy("video_id", "chunk_id").agg(F.max("score").alias("score"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("score").desc(), "chunk_id")).cast("long")).where("place <= 6")


@query(
    "w16_greedy_dedupe",
    f"""WITH RECURSIVE {RANKED}, p AS (SELECT r.query_id, r.chunk_id, r.rank, list_distinct(t.ts) AS terms FROM ranked r JOIN toks t USING (chunk_id) WHERE rank <= 20),
      k(query_id, rank, chunk_id, taken, kept, n) AS (
        SELECT DISTINCT query_id, 0::BIGINT, '', false, CAST([] AS VARCHAR[][]), 0::BIGINT FROM p
        UNION ALL
        SELECT query_id, rank, chunk_id, fresh, CASE WHEN fresh THEN list_append(kept, terms) ELSE kept END, n + CASE WHEN fresh THEN 1 ELSE 0 END
        FROM (SELECT p.query_id, p.rank, p.chunk_id, p.terms, k.kept, k.n, k.n < 6 AND len(list_filter(k.kept, lambda o: CASE WHEN len(o) + len(p.terms) = 0 THEN true ELSE len(list_intersect(o, p.terms)) / len(list_distinct(list_concat(o, p.terms))) >= 0.85 END)) = 0 AS fresh
              FROM k JOIN p ON p.query_id = k.query_id AND p.rank = k.rank + 1))
    SELECT query_id, CAST(n AS INTEGER) AS place, chunk_id FROM k WHERE taken""",
)
def w16(spark, folder):
    """Of the 20 best chunks of each question, those that are no near copy of a kept one, 6 at most."""
    pool = retrieval.top(scored(spark, folder), 20, "chunk_id")
    docs = chunked(spark, folder).select(F.col("chunk_id").alias("__c"), F.array_distinct(X.tokens(F.col("text"))).alias("terms"))
    per = pool.join(docs, F.col("chunk_id") == F.col("__c")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "terms"))).alias("c"))
    return per.select("query_id", F.posexplode(retrieval.keep_different(F.col("c"), 6)).alias("place", "x")).select("query_id", (F.col("place") + 1).alias("place"), "x.chunk_id")


@query("s1_parse_subtitles", READ.replace("FROM c WHERE", "FROM c JOIN transcripts t ON t.id = c.transcript_id AND t.source_format IN ('vtt', 'ttml', 'srv3') WHERE").replace("'[<>&]', '', 'g')) AS t, start_ms", "'[<>&]', '', 'g')) AS t, start_ms").replace(S.squeeze("t"), S.squeeze("c.t")).replace("WHERE t <> ''", "WHERE c.t <> ''") + f" UNION ALL SELECT DISTINCT c.transcript_id || '/' || CAST(sequence_number // 100 AS VARCHAR), NULL, NULL, NULL FROM c JOIN transcripts t ON t.id = c.transcript_id AND t.source_format NOT IN ('vtt', 'ttml', 'srv3') WHERE c.t <> '' AND start_ms >= 0 AND end_ms > start_ms")
def s1(spark, folder):
    """Payloads of each transcript in its own format, read by it; an unknown format is an error row without a cue."""
    return subtitles.parse_subtitles(subtitle_files(spark, folder).select("key", "format", "payload")).drop("error")
