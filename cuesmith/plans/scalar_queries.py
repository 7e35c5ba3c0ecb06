"""Queries for the scalar functions over the tables they belong to, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..tables import table
from . import sqltext as S

MESSAGE_COLUMNS = ["message_id", "video_id", "question", "answer", "answer_language", "retrieval_mode", "groundedness_warning"]
SEGMENT_COLUMNS = ["id", "transcript_id", "sequence_number", "original_text", "normalized_text", "start_ms", "end_ms"]


def messages(spark, folder):
    return table(spark, folder, "chat_messages").select(*MESSAGE_COLUMNS).distinct()


def segments(spark, folder):
    return table(spark, folder, "transcript_segments").select(*SEGMENT_COLUMNS).distinct()


QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("f1_tokenize", f"WITH {S.MESSAGES} SELECT message_id, array_to_string({S.tokens('question')}, ' ') AS tokens, CAST(len({S.tokens('question')}) AS INTEGER) AS n FROM msg")
def f1(spark, folder):
    words = X.tokens(F.col("question"))
    return messages(spark, folder).select("message_id", F.array_join(words, " ").alias("tokens"), F.size(words).alias("n"))


@query("f2_clean_text", f"WITH {S.SEGMENTS} SELECT id, {S.squeeze('original_text')} AS cleaned FROM seg")
def f2(spark, folder):
    return segments(spark, folder).select("id", X.squeeze(F.col("original_text")).alias("cleaned"))


@query("f3_normalize_text", None)
def f3(spark, folder):
    return segments(spark, folder).select("id", X.normalize("original_text").alias("normalized"))


@query("f4_same_text", f"WITH {S.SEGMENTS} SELECT id, replace(lower(original_text), 'ß', 'ss') = replace(lower(normalized_text), 'ß', 'ss') AS same FROM seg")
def f4(spark, folder):
    return segments(spark, folder).select("id", (X.fold_case(F.col("original_text")) == X.fold_case(F.col("normalized_text"))).alias("same"))


@query("f5_shorten", f"WITH {S.MESSAGES} SELECT message_id, {S.shorten('answer', 60)} AS short FROM msg")
def f5(spark, folder):
    return messages(spark, folder).select("message_id", X.shorten(F.col("answer"), 60).alias("short"))


@query("f6_timestamp", f"WITH {S.SEGMENTS} SELECT id, {S.clock('start_ms / 1000.0')} AS shown FROM seg")
def f6(spark, folder):
    return segments(spark, folder).select("id", X.minutes_seconds(F.col("start_ms") / 1000).alias("shown"))


@query(
    "f7_duration",
    """WITH d AS (SELECT id, duration_ms, greatest(duration_ms // 1000, 0) AS s FROM videos)
    SELECT id, CASE WHEN duration_ms IS NULL THEN 'Unknown'
      WHEN s // 3600 > 0 THEN CAST(s // 3600 AS VARCHAR) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's'
      ELSE CAST(s // 60 AS VARCHAR) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' END AS shown FROM d""",
)
def f7(spark, folder):
    return table(spark, folder, "videos").select("id", X.long_duration(F.col("duration_ms") / 1000).alias("shown"))


@query(
    "f8_deep_link",
    f"""WITH {S.SEGMENTS} SELECT s.id, 'https://www.youtube.com/watch?v=' || v.youtube_video_id || '&t=' || CAST(greatest(coalesce(s.start_ms, 0) // 1000, 0) AS VARCHAR) || 's' AS link
    FROM seg s JOIN transcripts t ON t.id = s.transcript_id JOIN videos v ON v.id = t.video_id""",
)
def f8(spark, folder):
    t = table(spark, folder, "transcripts").select(F.col("id").alias("t"), "video_id")
    v = table(spark, folder, "videos").select(F.col("id").alias("v"), "youtube_video_id")
    s = segments(spark, folder).select("id", "transcript_id", "start_ms")
    return s.join(t, s.transcript_id == F.col("t")).join(v, F.col("video_id") == F.col("v")).select("id", X.deep_link(F.col("youtube_video_id"), F.col("start_ms") / 1000).alias("link"))


@query("f9_excerpt", f"WITH {S.SEGMENTS} SELECT id, {S.shorten('original_text', 220)} AS excerpt FROM seg")
def f9(spark, folder):
    return segments(spark, folder).select("id", X.shorten(F.col("original_text"), 220).alias("excerpt"))


@query(
    "f10_safe_diagnostic",
    r"""SELECT id, substr(regexp_replace(regexp_replace(trim(regexp_replace('fetch of ' || canonical_url || ' failed, token=' || youtube_video_id || ' used', '\s+', ' ', 'g')),
      'https?://[^ ]+', '[redacted-url]', 'gi'), '\b(api[_-]?key|token|authorization|password|cookie) *[=:] *[^ ,;]+', '\1=[redacted]', 'gi'), 1, 300) AS shown FROM videos""",
)
def f10(spark, folder):
    said = F.concat(F.lit("fetch of "), "canonical_url", F.lit(" failed, token="), "youtube_video_id", F.lit(" used"))
    return table(spark, folder, "videos").select("id", X.redact(said).alias("shown"))


@query("f11_safe_message", f"WITH {S.MESSAGES} SELECT message_id, substr({S.squeeze('answer')}, 1, 500) AS message FROM msg")
def f11(spark, folder):
    return messages(spark, folder).select("message_id", F.substring(X.squeeze(F.col("answer")), 1, 500).alias("message"))


@query(
    "f12_answer_language",
    f"""WITH {S.MESSAGES} SELECT message_id, CASE WHEN regexp_matches(lower(question), '{X.VIETNAMESE_LETTERS}')
      OR len(list_intersect({S.tokens('question')}, {list(X.VIETNAMESE_WORDS)!r})) > 0 THEN 'vi' ELSE 'en' END AS language FROM msg""",
)
def f12(spark, folder):
    return messages(spark, folder).select("message_id", X.answer_language(F.col("question")).alias("language"))


@query(
    "f13_content_hash",
    f"""WITH {S.SEGMENTS} SELECT id, sha256('[' || coalesce(CAST(start_ms AS VARCHAR), 'null') || ',' || coalesce(CAST(end_ms AS VARCHAR), 'null') || ',"' || coalesce(normalized_text, '') || '"]') AS hash FROM seg""",
)
def f13(spark, folder):
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    material = F.concat(F.lit("["), part("start_ms"), F.lit(","), part("end_ms"), F.lit(',"'), F.coalesce("normalized_text", F.lit("")), F.lit('"]'))
    return segments(spark, folder).select("id", F.sha2(material, 256).alias("hash"))


NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


@query(
    "f15_uuid5",
    f"""WITH h AS (SELECT id, sha1(unhex('{NAMESPACE_URL}') || encode(fingerprint || chr(10) || 'child')) AS d FROM index_versions)
    SELECT id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
      substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(d, 17, 1)), 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS chunk_id FROM h""",
)
def f15(spark, folder):
    return table(spark, folder, "index_versions").select("id", X.uuid5(NAMESPACE_URL, F.concat_ws("\n", "fingerprint", F.lit("child"))).alias("chunk_id"))


@query("f16_goal_key", "SELECT id, substr(sha1(title), 1, 10) AS key FROM videos")
def f16(spark, folder):
    return table(spark, folder, "videos").select("id", F.substring(F.sha1("title"), 1, 10).alias("key"))


@query(
    "f17_overlap_ratio",
    f"""WITH {S.MESSAGES}, t AS (SELECT message_id, list_distinct({S.tokens('question')}) AS q, list_distinct({S.tokens("coalesce(answer, '')")}) AS a FROM msg)
    SELECT message_id, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, a)) / len(q) END, 6) AS ratio FROM t""",
)
def f17(spark, folder):
    return messages(spark, folder).select("message_id", F.round(X.overlap_ratio(X.tokens(F.col("question")), X.tokens(F.coalesce("answer", F.lit("")))), 6).alias("ratio"))


@query(
    "f18_jaccard",
    f"""WITH {S.MESSAGES}, t AS (SELECT message_id, list_distinct({S.tokens('question')}) AS q, list_distinct({S.tokens("coalesce(answer, '')")}) AS a FROM msg)
    SELECT message_id, round(CASE WHEN len(q) + len(a) = 0 THEN 1.0 ELSE len(list_intersect(q, a)) / (len(q) + len(a) - len(list_intersect(q, a))) END, 6) AS jaccard FROM t""",
)
def f18(spark, folder):
    return messages(spark, folder).select("message_id", F.round(X.jaccard(X.tokens(F.col("question")), X.tokens(F.coalesce("answer", F.lit("")))), 6).alias("jaccard"))


@query(
    "f19_max_normalize",
    """WITH m AS (SELECT DISTINCT message_id, sources FROM chat_messages), s AS (SELECT message_id, unnest(sources) AS x FROM m), b AS (SELECT message_id, max(x.score) AS best FROM s GROUP BY 1)
    SELECT DISTINCT message_id, x.chunk_id AS chunk_id, round(CASE WHEN best <= 0 THEN 0.0 ELSE x.score / best END, 6) AS share FROM s JOIN b USING (message_id)""",
)
def f19(spark, folder):
    s = table(spark, folder, "chat_messages").select("message_id", "sources").dropDuplicates(["message_id"])
    best = F.array_max(F.transform("sources", lambda x: x["score"]))
    shares = F.transform("sources", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), F.round(F.when(best <= 0, F.lit(0.0)).otherwise(x["score"] / best), 6).alias("share")))
    return s.select("message_id", F.explode(shares).alias("x")).select("message_id", "x.chunk_id", "x.share").distinct()


@query(
    "f20_cosine",
    """WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT x.vec_id, round(list_dot_product(x.e, y.e), 6) AS dot, round(list_cosine_similarity(x.e, y.e), 6) AS cosine FROM a x JOIN a y ON y.vec_id = x.vec_id + 1""",
)
def f20(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    after = e.select((F.col("vec_id") - 1).alias("before"), F.col("e").alias("f"))
    return e.join(after, F.col("vec_id") == F.col("before")).select("vec_id", F.round(X.dot(F.col("e"), F.col("f")), 6).alias("dot"), F.round(X.cosine(F.col("e"), F.col("f")), 6).alias("cosine"))


@query(
    "f21_normalize_vector",
    """WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM a)
    SELECT vec_id, array_to_string(list_transform(list_transform(e, lambda x: CASE WHEN l = 0 THEN 0.0 ELSE x / l END), lambda y: CAST(CAST(round(y * 10000) AS BIGINT) AS VARCHAR)), ',') AS scaled FROM n""",
)
def f21(spark, folder):
    e = table(spark, folder, "embeddings").withColumn("l", X.norm(F.col("embedding")))
    unit = F.transform("embedding", lambda x: F.round(F.when(F.col("l") == 0, F.lit(0.0)).otherwise(x.cast("double") / F.col("l")) * 10000).cast("long").cast("string"))
    return e.select("vec_id", F.array_join(unit, ",").alias("scaled"))


@query(
    "f22_trigrams",
    f"""WITH {S.MESSAGES}, t AS (SELECT DISTINCT unnest({S.tokens('question')}) AS word FROM msg)
    SELECT word, CASE WHEN length(word) <= 3 THEN word ELSE array_to_string(list_transform(range(1, length(word) - 1), lambda i: substr(word, CAST(i AS INTEGER), 3)), ' ') END AS grams FROM t""",
)
def f22(spark, folder):
    words = messages(spark, folder).select(F.explode(X.tokens(F.col("question"))).alias("word")).distinct()
    return words.select("word", F.array_join(X.trigrams(F.col("word")), " ").alias("grams"))


@query(
    "f24_tf_score",
    f"""WITH {S.MESSAGES}, q AS (SELECT message_id, unnest(list_distinct({S.tokens('question')})) AS w FROM msg),
      a AS (SELECT message_id, unnest({S.tokens("coalesce(answer, '')")}) AS w FROM msg), n AS (SELECT message_id, greatest(len({S.tokens("coalesce(answer, '')")}), 1) AS l FROM msg),
      h AS (SELECT q.message_id, count(*) AS tf FROM q JOIN a ON a.message_id = q.message_id AND a.w = q.w GROUP BY 1)
    SELECT n.message_id, round(coalesce(tf, 0) / sqrt(l), 6) AS score FROM n LEFT JOIN h USING (message_id)""",
)
def f24(spark, folder):
    q, a = F.array_distinct(X.tokens(F.col("question"))), X.tokens(F.coalesce("answer", F.lit("")))
    tf = F.size(F.filter(a, lambda w: F.array_contains(q, w)))
    return messages(spark, folder).select("message_id", F.round(tf / F.sqrt(F.greatest(F.size(a), F.lit(1))), 6).alias("score"))


@query("f28_goal", f"WITH {S.MESSAGES} SELECT message_id, nullif(substr({S.squeeze('groundedness_warning')}, 1, 240), '') AS goal FROM msg")
def f28(spark, folder):
    return messages(spark, folder).select("message_id", F.nullif(F.substring(X.squeeze(F.col("groundedness_warning")), 1, 240), F.lit("")).alias("goal"))


@query("f29_fallback_message", f"WITH {S.MESSAGES} SELECT message_id, CASE WHEN trim(answer_language) ILIKE 'vi%' THEN 'Không đủ bằng chứng.' ELSE 'Not enough evidence.' END AS message FROM msg")
def f29(spark, folder):
    vi = F.lower(F.trim("answer_language")).startswith("vi")
    return messages(spark, folder).select("message_id", F.when(vi, "Không đủ bằng chứng.").otherwise("Not enough evidence.").alias("message"))


@query("f31_token_count", f"WITH {S.SEGMENTS} SELECT id, CAST(len(regexp_extract_all(original_text, '[^{S.WS[1:-2]}]+')) AS INTEGER) AS n FROM seg")
def f31(spark, folder):
    return segments(spark, folder).select("id", F.size(F.filter(F.split(F.col("original_text"), X.BLANKS), lambda w: w != "")).alias("n"))


@query("f32_elapsed_ms", "SELECT event_id, greatest(CAST(round_even(value * 1000, 0) AS BIGINT), 0) AS ms FROM events")
def f32(spark, folder):
    return table(spark, folder, "events").select("event_id", F.greatest(F.bround(F.col("value") * 1000).cast("long"), F.lit(0).cast("long")).alias("ms"))


@query(
    "f33_cached_note",
    "WITH m AS (SELECT DISTINCT message_id, generation FROM chat_messages) SELECT message_id, 'Cached output originally used ' || generation.generation_mode || '.' || CASE WHEN coalesce(generation.fallback_reason, '') <> '' THEN ' ' || generation.fallback_reason ELSE '' END AS note FROM m",
)
def f33(spark, folder):
    m = table(spark, folder, "chat_messages").dropDuplicates(["message_id"])
    first = F.concat(F.lit("Cached output originally used "), "generation.generation_mode", F.lit("."))
    return m.select("message_id", F.concat_ws(" ", first, F.nullif("generation.fallback_reason", F.lit(""))).alias("note"))


@query("s12_backoff", "SELECT event_id, round(0.5 * power(2, (user_id % 5)) * (1 + 0.25 * ((event_id % 8) / 8.0)), 6) AS delay FROM events")
def s12(spark, folder):
    jitter = (F.col("event_id") % 8) / 8.0
    return table(spark, folder, "events").select("event_id", F.round(0.5 * F.pow(F.lit(2.0), F.col("user_id") % 5) * (1 + 0.25 * jitter), 6).alias("delay"))


@query("k10_slug", "SELECT id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'untitled') || '.md' AS filename FROM videos")
def k10(spark, folder):
    return table(spark, folder, "videos").select("id", F.concat(X.slug(F.col("title")), F.lit(".md")).alias("filename"))


