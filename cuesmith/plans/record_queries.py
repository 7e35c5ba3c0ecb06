"""Queries of evaluation, predicates on texts, listings and transcript sources, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation, retrieval
from ..operators.ordered import before
from ..tables import table
from . import sqltext as S
from .relational_queries import _OFFSETS, _links_sql, at_sources, links  # noqa: F401
from .retrieval_queries import BM25, CHUNKS, RANKED, TWO, chunked, index, questions, scored, two_lists
from .scalar_queries import messages, segments

QUERIES, SQL = {}, {}


def query(name, sql):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def sources(spark, folder):
    return table(spark, folder, "chat_messages").select("message_id", "video_id", "question", "answer", "sources", "retrieval_mode", "created_at").dropDuplicates(["message_id"])


_M = "m AS (SELECT DISTINCT message_id, video_id, question, answer, sources, retrieval_mode, groundedness_warning FROM chat_messages)"

# Evaluation

_TOPIC = "(?:about|về|đề cập|with|mention|nhắc đến|is|thì) (.{6,24})"
_QRELS = f"""tp AS (SELECT query_id, video_id, lower(regexp_extract(question, '{_TOPIC}', 1)) AS topic FROM questions),
  cues AS (SELECT t.video_id, s.id, lower(coalesce(s.original_text, '')) AS text FROM seg s JOIN transcripts t ON t.id = s.transcript_id),
  qrels AS (SELECT query_id, cues.id AS segment_id FROM tp JOIN cues USING (video_id) WHERE topic <> '' AND contains(text, topic))"""


def qrels(spark, folder):
    """``query_id, segment_id``: cues of the question's video that hold its topic; a topic meets the cues of a video once."""
    asked = questions(spark, folder).select("video_id", "query_id", F.lower(F.regexp_extract("question", _TOPIC, 1)).alias("topic")).where("topic <> ''")
    t = table(spark, folder, "transcripts").select(F.col("id").alias("__t"), F.col("video_id").alias("__v"))
    cues = segments(spark, folder).join(t, F.col("transcript_id") == F.col("__t")).select("__v", F.col("id").alias("segment_id"), F.lower(F.coalesce("original_text", F.lit(""))).alias("text"))
    topics = asked.select("video_id", "topic").distinct()
    met = topics.join(cues, (F.col("video_id") == F.col("__v")) & F.contains(F.col("text"), F.col("topic"))).select("__v", F.col("topic").alias("__topic"), "segment_id")
    return asked.join(met, (F.col("video_id") == F.col("__v")) & (F.col("topic") == F.col("__topic"))).select("query_id", "segment_id")


@query("pred10_substring", f"WITH {S.SEGMENTS}, {S.MESSAGES}, questions AS (SELECT video_id, question, min(message_id) AS query_id FROM msg GROUP BY 1, 2), {_QRELS} SELECT * FROM qrels")
def pred10(spark, folder):
    return qrels(spark, folder)


def found_segments(spark, folder):
    """The three best chunks of each question with their cues: ``query_id, rank, segment_id``."""
    best = retrieval.top(scored(spark, folder), 3, "chunk_id").select("query_id", "rank", F.col("chunk_id").alias("__c"))
    inside = links(spark, folder, 140, 110).withColumn("chunk_id", F.concat("transcript_id", F.lit(":"), F.lpad(F.col("window").cast("string"), 6, "0"))).select("chunk_id", F.col("id").alias("segment_id"))
    return best.join(inside, F.col("__c") == F.col("chunk_id")).select("query_id", "rank", "segment_id")


_JUDGED = f"""{RANKED}, {_OFFSETS.split('seg AS', 1)[1].split('),', 1)[1].lstrip()}, {_links_sql('lk', 140, 110)}, {_QRELS},
  got AS (SELECT DISTINCT r.query_id, r.rank, lk.id AS segment_id FROM ranked r JOIN lk ON r.chunk_id = lk.transcript_id || ':' || lpad(CAST(lk."window" AS VARCHAR), 6, '0') WHERE r.rank <= 3),
  judged AS (SELECT g.*, q.segment_id IS NOT NULL AS good FROM got g LEFT JOIN (SELECT DISTINCT * FROM qrels) q USING (query_id, segment_id))"""


@query("j10_relevance", f"WITH {_JUDGED} SELECT query_id, rank, count(*) AS cited, count(*) FILTER (WHERE good) AS supported, bool_or(good) AS relevant FROM judged GROUP BY ALL")
def j10(spark, folder):
    """Whether a retrieved chunk holds a judged cue, through the links of chunks to cues."""
    got, e = found_segments(spark, folder).distinct(), qrels(spark, folder).select(F.col("query_id").alias("__q"), F.col("segment_id").alias("__s")).distinct()
    judged = got.join(e, (F.col("query_id") == F.col("__q")) & (F.col("segment_id") == F.col("__s")), "left")
    return judged.groupBy("query_id", "rank").agg(F.count("*").alias("cited"), F.count("__s").alias("supported"), F.bool_or(F.col("__s").isNotNull()).alias("relevant"))


_SEGMENT_METRICS = f"""{_JUDGED}, ch AS (SELECT query_id, rank, count(*) AS cited, count(*) FILTER (WHERE good) AS supported FROM judged GROUP BY ALL),
  cv AS (SELECT query_id, count(DISTINCT segment_id) FILTER (WHERE good) AS covered FROM judged GROUP BY 1), ex AS (SELECT query_id, count(DISTINCT segment_id) AS expected FROM qrels GROUP BY 1),
  pc AS (SELECT query_id, count(*) AS found, count(*) FILTER (WHERE supported > 0) AS relevant, min(rank) FILTER (WHERE supported > 0) AS first, sum(CASE WHEN supported > 0 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(cited) AS cited, sum(supported) AS supported FROM ch GROUP BY 1),
  qm AS (SELECT q.query_id, round(CASE WHEN expected IS NULL THEN 1.0 ELSE coalesce(covered / expected, 0) END, 4) AS recall, CASE WHEN expected IS NULL OR coalesce(relevant, 0) > 0 THEN 1e0 ELSE 0e0 END AS hit,
      round(CASE WHEN expected IS NULL THEN 1.0 ELSE coalesce(1.0 / first, 0) END, 4) AS mrr, round(CASE WHEN expected IS NULL THEN 1.0 WHEN coalesce(relevant, 0) = 0 THEN 0.0 ELSE dcg / list_sum(list_transform(range(1, relevant + 1), lambda i: 1 / log2(i + 1))) END, 4) AS ndcg,
      round(CASE WHEN expected IS NULL THEN 1.0 ELSE coalesce(supported / greatest(cited, 1), 0) END, 4) AS citation_accuracy, CASE WHEN expected IS NULL AND coalesce(found, 0) > 0 THEN 1e0 ELSE 0e0 END AS unanswerable_false_positive, expected IS NULL AS unanswerable
    FROM questions q LEFT JOIN pc USING (query_id) LEFT JOIN cv USING (query_id) LEFT JOIN ex USING (query_id))"""


def by_segments(spark, folder):
    return evaluation.segment_metrics(questions(spark, folder), found_segments(spark, folder), qrels(spark, folder))


@query("a10_segment_metrics", f"WITH {_SEGMENT_METRICS} SELECT * FROM qm")
def a10s(spark, folder):
    return by_segments(spark, folder)


@query("a11_segment_average", f"WITH {_SEGMENT_METRICS} SELECT round(avg(recall), 4) AS recall, round(avg(hit), 4) AS hit, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(citation_accuracy), 4) AS citation_accuracy, round(avg(unanswerable_false_positive) FILTER (unanswerable), 4) AS unanswerable_false_positive FROM qm")
def a11s(spark, folder):
    """Averages over all questions, false positives over those that expect nothing."""
    one = by_segments(spark, folder)
    return one.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("recall", "hit", "mrr", "ndcg", "citation_accuracy")], F.round(F.avg(F.when(F.col("unanswerable"), F.col("unanswerable_false_positive"))), 4).alias("unanswerable_false_positive"))


_LISTS = f"""{_M}, l AS (SELECT message_id, video_id, question, list_transform(sources, lambda s: s.chunk_id) AS got, list_transform(list_filter(sources, lambda s: s.score >= 0.5), lambda s: s.chunk_id) AS good FROM m),
  e AS (SELECT video_id, question, flatten(list(good)) AS expected FROM l GROUP BY ALL),
  r AS (SELECT l.message_id, l.got, list_distinct(e.expected) AS want FROM l JOIN e ON e.video_id = l.video_id AND e.question = l.question),
  pm AS (SELECT message_id, round(CASE WHEN len(want) = 0 THEN 0.0 ELSE len(list_filter(got, lambda c: list_contains(want, c))) / greatest(len(got), 1) END, 4) AS precision,
     round(CASE WHEN len(want) = 0 THEN 0.0 ELSE len(list_intersect(got, want)) / len(want) END, 4) AS recall,
     round(CASE WHEN len(want) = 0 THEN 0.0 ELSE coalesce(1.0 / list_min(list_filter(list_transform(want, lambda w: list_position(got, w)), lambda p: p > 0)), 0.0) END, 4) AS mrr FROM r)"""


def listed(spark, folder):
    """Metrics of each message's sources against the sources with a score from 0.5 on of all messages with its question."""
    m = sources(spark, folder)
    got = F.transform("sources", lambda s: s["chunk_id"])
    good = F.transform(F.filter("sources", lambda s: s["score"] >= 0.5), lambda s: s["chunk_id"])
    l = m.select("message_id", "video_id", "question", got.alias("got"), good.alias("good"))
    e = l.groupBy(F.col("video_id").alias("__v"), F.col("question").alias("__q")).agg(F.array_distinct(F.flatten(F.collect_set("good"))).alias("want"))
    p, r, f = evaluation.list_metrics(F.col("got"), F.col("want"))
    return l.join(e, (F.col("video_id") == F.col("__v")) & (F.col("question") == F.col("__q"))).select("message_id", p.alias("precision"), r.alias("recall"), f.alias("mrr"))


@query("a12_list_metrics", f"WITH {_LISTS} SELECT * FROM pm")
def a12(spark, folder):
    return listed(spark, folder)


@query("a12_averages", f"WITH {_LISTS} SELECT round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr FROM pm")
def a12_averages(spark, folder):
    return listed(spark, folder).agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c) for c in ("precision", "recall", "mrr")])


@query(
    "a14_quiz_score",
    f"""WITH {_M}, q AS (SELECT message_id, video_id, len(sources) >= 2 AS gradable, CASE WHEN answer IS NOT NULL THEN sources[1].chunk_id END AS given, list_sort(list_transform(sources, lambda s: {{'k': -s.score, 'c': s.chunk_id}}))[1].c AS right_one FROM m)
    SELECT video_id, count(*) FILTER (gradable) AS gradable, count(*) FILTER (gradable AND given = right_one) AS correct, count(*) FILTER (gradable AND given IS NULL) AS unanswered,
      coalesce(string_agg(message_id, ',' ORDER BY message_id) FILTER (gradable AND given IS DISTINCT FROM right_one), '') AS missed FROM q GROUP BY 1""",
)
def a14(spark, folder):
    """A quiz for each video: its messages are questions, their sources the options, the first source the choice and the one of
    the best score the answer. A question without two options can't be graded; one without an answer is missed."""
    m = sources(spark, folder)
    best = F.array_sort(F.transform("sources", lambda s: F.struct((-s["score"]).alias("k"), s["chunk_id"].alias("c"))))
    q = m.select("message_id", "video_id", (F.size("sources") >= 2).alias("g"), F.when(F.col("answer").isNotNull(), F.get("sources", F.lit(0))["chunk_id"]).alias("given"), F.get(best, F.lit(0))["c"].alias("right"))
    ok = F.coalesce(F.col("given") == F.col("right"), F.lit(False))
    missed = F.array_join(F.array_sort(F.collect_list(F.when(F.col("g") & ~ok, F.col("message_id")))), ",")
    return q.groupBy("video_id").agg(F.count_if("g").alias("gradable"), F.count_if(F.col("g") & ok).alias("correct"), F.count_if(F.col("g") & F.col("given").isNull()).alias("unanswered"), missed.alias("missed"))


_WORDS = lambda c: f"CAST(len(regexp_extract_all({c}, '[^{S.WS[1:-2]}]+')) AS BIGINT)"


@query("a20_usage", f"WITH {_M}, u AS (SELECT video_id, {_WORDS('question')} AS i, {_WORDS('answer')} AS o, CAST(round_even(length(answer) * 1500500 / 1000000.0, 0) AS BIGINT) AS ms FROM m) SELECT video_id, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(i + o) AS BIGINT) AS total_tokens, CAST(sum(ms) AS BIGINT) AS elapsed_ms, count(*) FILTER (WHERE o IS NULL) AS unknown FROM u GROUP BY 1")
def a20(spark, folder):
    """Tokens in and out by video; a total needs both, so a message without an answer has none. Nanoseconds become milliseconds, halves to even."""
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit("[^\\u0009-\\u000d\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"), F.lit(0))).cast("long")
    u = sources(spark, folder).select("video_id", words(F.col("question")).alias("i"), F.when(F.col("answer").isNotNull(), words(F.col("answer"))).alias("o"), F.bround(F.char_length("answer") * 1500500 / F.lit(1000000.0)).cast("long").alias("ms"))
    return u.groupBy("video_id").agg(F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.sum(F.col("i") + F.col("o")).alias("total_tokens"), F.sum("ms").alias("elapsed_ms"), F.count_if(F.col("o").isNull()).alias("unknown"))


_VARIANTS = f"""{_M}, x AS (SELECT retrieval_mode, message_id, length(question) AS ms, unnest(sources) AS s FROM m),
  lat AS (SELECT retrieval_mode, length(question) AS ms, row_number() OVER (PARTITION BY retrieval_mode ORDER BY length(question)) - 1 AS i, count(*) OVER (PARTITION BY retrieval_mode) AS n FROM m),
  v AS (SELECT retrieval_mode AS variant_id, round(avg(CASE WHEN s.score >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS citation_accuracy, round(avg(s.score), 6) AS ndcg, round(avg(s.end_seconds - s.start_seconds), 6) AS recall, round(max(s.score), 6) AS mrr FROM x GROUP BY 1),
  p AS (SELECT retrieval_mode AS variant_id, max(ms) FILTER (WHERE i = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT)) AS p95_ms FROM lat GROUP BY 1), w AS (SELECT * FROM v JOIN p USING (variant_id)),
  c AS (SELECT * FROM w WHERE citation_accuracy >= (SELECT max(citation_accuracy) FROM w) - 0.01), d AS (SELECT * FROM c WHERE ndcg >= (SELECT max(ndcg) FROM c) - 0.01)"""


@query("w6_recommendation", f"WITH {_VARIANTS} SELECT variant_id FROM d ORDER BY p95_ms, recall DESC, mrr DESC, variant_id LIMIT 1")
def w6(spark, folder):
    """The retrieval modes as variants, with figures of their messages."""
    m = sources(spark, folder)
    x = m.select("retrieval_mode", F.explode("sources").alias("s"))
    v = x.groupBy(F.col("retrieval_mode").alias("variant_id")).agg(
        F.round(F.avg(F.when(F.col("s.score") >= 0.5, 1.0).otherwise(0.0)), 6).alias("citation_accuracy"), F.round(F.avg("s.score"), 6).alias("ndcg"), F.round(F.avg(F.col("s.end_seconds") - F.col("s.start_seconds")), 6).alias("recall"), F.round(F.max("s.score"), 6).alias("mrr"),
    )
    counts = m.groupBy("retrieval_mode", F.char_length("question").alias("ms")).agg(F.count("*").alias("c"))
    run = Window.partitionBy("retrieval_mode")
    # One row for each mode and length of a question.
    ranks = counts.withColumns({"b": F.sum("c").over(run.orderBy("ms")) - F.col("c"), "n": F.sum("c").over(run)}).withColumn("at", F.bround((F.col("n") - 1) * 0.95).cast("long"))
    p = ranks.where("b <= at AND at < b + c").select(F.col("retrieval_mode").alias("__m"), F.col("ms").alias("p95_ms"))
    return evaluation.recommended(v.join(p, F.col("variant_id") == F.col("__m")))


# Texts


@query(
    "pred13_usable",
    f"""WITH {S.MESSAGES}, l AS (SELECT message_id, trim(coalesce(answer, ''), chr(10) || ' ' || chr(9) || chr(13)) AS t FROM msg), n AS (SELECT message_id, t, string_split(t, chr(10)) AS lines, len(regexp_extract_all(t, '[^{S.WS[1:-2]}]+')) AS words FROM l),
      k AS (SELECT *, coalesce(regexp_matches(trim(list_filter(lines, lambda x: trim(x) <> '')[-1]), '[.!?)\\]]$'), false) AS complete, len(list_filter(lines, lambda x: regexp_matches(ltrim(x), '^[-*]'))) AS bullets FROM n)
    SELECT message_id, words >= 35 AND complete AS long_summary, words >= 35 AND complete AND bullets >= 3 AS short_summary,
      words >= 45 AND complete AND contains(t, 'Mục tiêu bài học') AND contains(t, 'Khái niệm chính') AND contains(t, 'Giải thích') AND contains(t, 'Timestamp nên xem lại') AS notes FROM k""",
)
def pred13(spark, folder):
    """Whether an answer would do as a summary, as a short one with bullets, or as notes with their four headings."""
    t = F.btrim(F.coalesce("answer", F.lit("")), F.lit("\n \t\r"))
    usable = X.usable_text(t)
    return messages(spark, folder).select("message_id", usable["summary"].alias("long_summary"), usable["short"].alias("short_summary"), usable["notes"].alias("notes"))


_SAID = """CASE CAST(length(question) AS BIGINT) % 6 WHEN 0 THEN 'HTTP 429 Too Many Requests: retry in ' || CAST(length(question) / 10.0 AS VARCHAR) || 's' WHEN 1 THEN 'RESOURCE_EXHAUSTED while calling ' || retrieval_mode
  WHEN 2 THEN 'the prompt exceeds the maximum context length' WHEN 3 THEN 'Token limit reached after ' || CAST(length(question) AS VARCHAR) WHEN 4 THEN 'quota exceeded, please retry in 0.2s' ELSE 'connection reset by ' || retrieval_mode END"""


@query("pred14_error_kind", f"WITH {S.MESSAGES}, e AS (SELECT message_id, lower({_SAID}) AS t FROM msg) SELECT message_id, contains(t, '429') OR contains(t, 'resource_exhausted') OR contains(t, 'quota exceeded') OR contains(t, 'rate limit') AS rate_limited, contains(t, 'token limit') OR contains(t, 'context length') AS token_limited, CASE WHEN contains(t, 'retry in ') THEN greatest(CAST(floor(CAST(string_split(string_split(t, 'retry in ')[2], 's')[1] AS DOUBLE)) AS BIGINT), 1) END AS retry_after FROM e")
def pred14(spark, folder):
    """Kinds of provider errors, from messages of six forms; without a hint there is no time to wait."""
    n = F.char_length("question")
    tenth = F.concat((n / F.lit(10.0)).cast("string"), F.lit("s"))
    said = F.lower(
        F.when(n % 6 == 0, F.concat(F.lit("HTTP 429 Too Many Requests: retry in "), tenth)).when(n % 6 == 1, F.concat(F.lit("RESOURCE_EXHAUSTED while calling "), "retrieval_mode"))
        .when(n % 6 == 2, F.lit("the prompt exceeds the maximum context length")).when(n % 6 == 3, F.concat(F.lit("Token limit reached after "), n.cast("string")))
        .when(n % 6 == 4, F.lit("quota exceeded, please retry in 0.2s")).otherwise(F.concat(F.lit("connection reset by "), "retrieval_mode"))
    )
    wait = F.nullif(F.regexp_extract("t", "retry in ([0-9.]+)s", 1), F.lit("")).cast("double")
    return messages(spark, folder).withColumn("t", said).select("message_id", F.col("t").rlike("429|resource_exhausted|quota exceeded|rate limit").alias("rate_limited"), F.col("t").rlike("token limit|context length").alias("token_limited"), F.when(wait.isNotNull(), F.greatest(F.floor(wait), F.lit(1).cast("long"))).alias("retry_after"))


@query("f14_fingerprints", "SELECT id, sha256(concat_ws(chr(10), CAST(chunker_config.child_target_tokens AS VARCHAR), CAST(chunker_config.child_max_tokens AS VARCHAR), CAST(chunker_config.child_overlap_tokens AS VARCHAR), chunker_version)) AS chunker, sha256(video_id || chr(10) || transcript_id || chr(10) || chunker_version || chr(10) || 'hashing-256') AS index_print, sha256(video_id || chr(10) || fingerprint) AS idempotency, sha256(chunker_version || chr(10) || '1') AS pipeline FROM index_versions")
def f14(spark, folder):
    v = table(spark, folder, "index_versions")
    sha = lambda *c: F.sha2(F.concat_ws("\n", *c), 256)
    sizes = [F.col(f"chunker_config.{c}").cast("string") for c in ("child_target_tokens", "child_max_tokens", "child_overlap_tokens")]
    return v.select("id", sha(*sizes, "chunker_version").alias("chunker"), sha("video_id", "transcript_id", "chunker_version", F.lit("hashing-256")).alias("index_print"), sha("video_id", "fingerprint").alias("idempotency"), sha("chunker_version", F.lit("1")).alias("pipeline"))


@query("f25_extract_json", "SELECT event_id, CASE WHEN contains(props, '{') AND contains(props, '}') THEN props END AS found FROM events")
def f25(spark, folder):
    """The JSON object in a model's reply: inside a code fence for odd events, between sentences for even ones."""
    reply = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), "props", F.lit(" Done.")))
    return table(spark, folder, "events").select("event_id", X.json_object(reply).alias("found"))


@query(
    "f26_json_rows",
    f"""WITH {_M}, k AS (SELECT DISTINCT video_id, s.chunk_id AS chunk_id FROM (SELECT video_id, unnest(sources) AS s FROM m) WHERE s.score >= 0.3), x AS (SELECT message_id, video_id, unnest(sources) AS s FROM m)
    SELECT DISTINCT x.message_id, x.s.chunk_id AS chunk_id, round(x.s.score, 6) AS score FROM x WHERE (x.video_id, x.s.chunk_id) IN (SELECT (video_id, chunk_id) FROM k)""",
)
def f26(spark, folder):
    """Rows written as JSON and read again; those of a source unknown to the video are dropped. Known is what has a score from 0.3 on."""
    m = sources(spark, folder)
    known = m.select(F.col("video_id").alias("__v"), F.explode("sources").alias("s")).where("s.score >= 0.3").select("__v", F.col("s.chunk_id").alias("__c")).distinct()
    x = m.select("message_id", "video_id", F.to_json("sources").alias("j")).select("message_id", "video_id", F.explode(F.from_json("j", "array<struct<chunk_id: string, score: double>>")).alias("s"))
    return x.join(known, (F.col("video_id") == F.col("__v")) & (F.col("s.chunk_id") == F.col("__c")), "left_semi").select("message_id", "s.chunk_id", F.round("s.score", 6).alias("score")).distinct()


@query(
    "f27_cache_keys",
    f"""WITH {_M}, i AS (SELECT *, array_to_string(list_sort(list_transform(sources[1:8], lambda s: s.chunk_id)), ',') AS ids FROM m)
    SELECT message_id, concat_ws(':', 'summary', retrieval_mode, CAST(len(sources) AS VARCHAR), ids) AS summary, concat_ws(':', 'notes', retrieval_mode, coalesce(substr(sha1(nullif(trim(groundedness_warning), '')), 1, 10), 'none')) AS notes, concat_ws(':', 'quiz', retrieval_mode, ids) AS quiz FROM i""",
)
def f27(spark, folder):
    """Keys of cached summaries of sections, notes for a goal and quizzes."""
    m = table(spark, folder, "chat_messages").select("message_id", "sources", "retrieval_mode", "groundedness_warning").dropDuplicates(["message_id"])
    ids = F.array_join(F.array_sort(F.transform(F.slice("sources", 1, 8), lambda s: s["chunk_id"])), ",")
    goal = F.nullif(F.trim("groundedness_warning"), F.lit(""))
    key = lambda *p: F.concat_ws(":", *p)
    return m.select("message_id", key(F.lit("summary"), "retrieval_mode", F.size("sources").cast("string"), ids).alias("summary"), key(F.lit("notes"), "retrieval_mode", F.coalesce(F.substring(F.sha1(goal), 1, 10), F.lit("none"))).alias("notes"), key(F.lit("quiz"), "retrieval_mode", ids).alias("quiz"))


@query(
    "f30_prompts",
    f"""WITH {_M} SELECT message_id, 'Answer the question from the passages only and cite them.' || chr(10) || 'Question: ' || question || chr(10) || array_to_string(list_transform(sources, lambda s, i: '[' || CAST(i AS VARCHAR) || '] timestamp=' || {S.clock('s.start_seconds')} || '-' || {S.clock('s.end_seconds')} || ' score=' || printf('%.6f', s.score) || ' text=' || s.text), chr(10)) AS prompt FROM m""",
)
def f30(spark, folder):
    line = lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] timestamp="), X.minutes_seconds(s["start_seconds"]), F.lit("-"), X.minutes_seconds(s["end_seconds"]), F.lit(" score="), F.format_string("%.6f", s["score"]), F.lit(" text="), s["text"])
    return sources(spark, folder).select("message_id", F.concat(F.lit("Answer the question from the passages only and cite them.\nQuestion: "), "question", F.lit("\n"), F.array_join(F.transform("sources", line), "\n")).alias("prompt"))


@query(
    "w19_sentence_spans",
    f"""WITH {S.SEGMENTS}, c AS (SELECT id, string_split(regexp_replace(original_text, '([.!?。！？]+)(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM seg WHERE original_text <> ''),
      p AS (SELECT id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM c), o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p)
    SELECT id, CAST(off + length(piece) - length(ltrim(piece)) AS BIGINT) AS from_char, CAST(off + length(rtrim(piece)) AS BIGINT) AS to_char, trim(piece) AS sentence FROM o WHERE trim(piece) <> ''""",
)
def w19(spark, folder):
    """Sentences with the places of their first and past their last character; a mark ends one only before a blank or the end."""
    s = segments(spark, folder).where("original_text <> ''").select("id", F.posexplode(X.sentence_spans(F.col("original_text"))).alias("k", "x"))
    return s.select("id", "x.from_char", "x.to_char", "x.sentence")


# Ranks, listings and validators


@query("w3_attempt_numbers", "WITH b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT e.event_id, coalesce(b.n, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS attempt FROM events e LEFT JOIN b USING (user_id) WHERE e.event_type <> 'signup'")
def w3(spark, folder):
    """New attempts are numbered on from those there are; a user's sign-ups stand for these."""
    e = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    there = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("__u")).agg(F.count("*").alias("base"))
    new = e.where("event_type <> 'signup'").withColumn("bucket", F.unix_date(F.to_date("ts")))
    placed = before(new, ["user_id"], "bucket", ["ts", "event_id"], earlier=("sum", F.lit(1)))
    return placed.join(there, F.col("user_id") == F.col("__u"), "left").select("event_id", (F.coalesce("base", F.lit(0)) + F.col("earlier") + 1).cast("long").alias("attempt"))


@query("w10_violations", """WITH c AS (SELECT DISTINCT transcript_id, sequence_number, start_ms FROM source_segments), o AS (SELECT *, row_number() OVER w - 1 AS place, lag(start_ms) OVER w AS earlier FROM c WINDOW w AS (PARTITION BY transcript_id ORDER BY sequence_number, start_ms))
    SELECT transcript_id, sequence_number, 'order' AS rule FROM o WHERE start_ms < earlier UNION ALL SELECT transcript_id, sequence_number, 'contiguity' FROM o WHERE sequence_number <> place""")
def w10(spark, folder):
    """Cues that start before the one before, and cues whose number is not their place; both by buckets of numbers."""
    c = table(spark, folder, "source_segments").select("transcript_id", "sequence_number", "start_ms").distinct().withColumn("bucket", F.floor(F.col("sequence_number") / 2048))
    placed = before(c, ["transcript_id"], "bucket", ["sequence_number", "start_ms"], place=("sum", F.lit(1)))
    gaps = placed.where("sequence_number <> place").select("transcript_id", "sequence_number", F.lit("contiguity").alias("rule"))
    inside = Window.partitionBy("transcript_id", "bucket").orderBy("sequence_number", "start_ms")
    tails = c.groupBy("transcript_id", "bucket").agg(F.max_by("start_ms", F.struct("sequence_number", "start_ms")).alias("tail"))
    tails = tails.select(F.col("transcript_id").alias("__t"), F.col("bucket").alias("__b"), F.lag("tail").over(Window.partitionBy("transcript_id").orderBy("bucket")).alias("tail"))
    known = c.withColumns({"__p": F.lag("start_ms").over(inside), "__n": F.row_number().over(inside)}).join(tails, (F.col("transcript_id") == F.col("__t")) & (F.col("bucket") == F.col("__b")))
    earlier = F.when(F.col("__n") == 1, F.col("tail")).otherwise(F.col("__p"))
    return gaps.unionByName(known.where(F.col("start_ms") < earlier).select("transcript_id", "sequence_number", F.lit("order").alias("rule")))


@query("w22_rising_stamps", "WITH v AS (SELECT id, status, epoch_us(updated_at) AS us, row_number() OVER (PARTITION BY status ORDER BY id) AS i FROM videos) SELECT id, CAST(max(us - i) OVER (PARTITION BY status ORDER BY id ROWS UNBOUNDED PRECEDING) + i AS BIGINT) AS stamp_us FROM v")
def w22(spark, folder):
    """Stamps that rise strictly in order of the ids of each status: the wanted one, or a microsecond after the one before.

    With i rows counted, stamp - i does not fall, so it is the greatest wanted stamp - i so far.
    """
    v = table(spark, folder, "videos").select("id", "status", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("us")).withColumn("bucket", F.substring("id", 1, 1))
    counted = before(v, ["status"], "bucket", ["id"], n=("sum", F.lit(1))).withColumn("i", F.col("n") + 1).drop("n")
    seen = before(counted, ["status"], "bucket", ["id"], most=("max", F.col("us") - F.col("i")))
    return seen.select("id", (F.greatest("most", F.col("us") - F.col("i")) + F.col("i")).cast("long").alias("stamp_us"))


@query("t1_lexical_top", f"WITH {BM25} SELECT query_id, chunk_id, -score AS bm25, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY -score, chunk_id) AS place FROM bm) WHERE place <= 5")
def t1(spark, folder):
    """The five best by the negative score in rising order, then the id."""
    s = scored(spark, folder).withColumn("bm25", -F.col("score"))
    w = Window.partitionBy("query_id").orderBy("bm25", "chunk_id")
    return s.withColumn("place", F.row_number().over(w)).where("place <= 5").select("query_id", "chunk_id", "bm25", F.col("place").cast("long").alias("place"))


@query("t4_rerank_order", f"WITH {TWO}, o AS (SELECT f.query_id, f.chunk_id, f.score, CASE WHEN s.share >= 0.3 THEN round(s.share, 6) END AS again FROM fused f JOIN share s USING (query_id, chunk_id)) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(again, '-inf'::DOUBLE) DESC, score DESC, chunk_id) AS place FROM o")
def t4(spark, folder):
    """Candidates by their second score, those without one last, then by the fused score and the id. Shares below 0.3 have no second score."""
    fused = retrieval.fuse(two_lists(spark, folder), "chunk_id", carried=("share",))
    again = F.when(F.col("share") >= 0.3, F.round("share", 6))
    w = Window.partitionBy("query_id").orderBy(F.coalesce("again", F.lit(float("-inf"))).desc(), F.col("score").desc(), "chunk_id")
    return fused.select("query_id", "chunk_id", "score", again.alias("again")).select("query_id", "chunk_id", F.row_number().over(w).cast("long").alias("place"))


STUDY = ("the main ideas of the lesson", "các ý chính của bài học", "steps and examples in plain language")


@query(
    "t9_source_choice",
    f"""WITH {BM25.replace('questions AS (', 'unused AS (').replace('FROM questions)', "FROM study)").replace('asked AS (SELECT', "study AS (SELECT id || ':' || CAST(k AS VARCHAR) AS query_id, id AS video_id, q AS question FROM videos, (VALUES " + ', '.join(f"({i}, '{t}')" for i, t in enumerate(STUDY)) + ") x(k, q)), asked AS (SELECT")},
      hits AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rk FROM bm), n AS (SELECT video_id, count(*) AS n FROM chunks GROUP BY 1),
      ord AS (SELECT video_id, chunk_id, start_ms, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, chunk_id) - 1 AS ix FROM chunks),
      line AS (SELECT o.video_id, o.chunk_id FROM ord o JOIN n USING (video_id) WHERE n <= 8 OR ix IN (SELECT CAST(round_even(i * ((n - 1) / 7.0::DOUBLE), 0) AS BIGINT) FROM range(8) r(i))),
      u AS (SELECT video_id, chunk_id FROM line UNION SELECT c.video_id, h.chunk_id FROM hits h JOIN chunks c USING (chunk_id) WHERE rk <= 3)
    SELECT video_id, chunk_id, place FROM (SELECT u.video_id, u.chunk_id, row_number() OVER (PARTITION BY u.video_id ORDER BY c.start_ms, u.chunk_id) AS place FROM u JOIN chunks c USING (chunk_id)) WHERE place <= 12""",
)
def t9(spark, folder):
    """Chunks for a text about a video: eight evenly over its time and the best three for each study question, in order of time, at
    most twelve."""
    c = chunked(spark, folder).select("video_id", "chunk_id", "start_ms")
    asked = table(spark, folder, "videos").select(F.col("id").alias("video_id"), F.posexplode(F.array(*map(F.lit, STUDY))).alias("k", "q"))
    terms = asked.select("video_id", F.concat_ws(":", "video_id", "k").alias("query_id"), F.explode(F.array_distinct(X.tokens(F.col("q")))).alias("term"))
    hits = retrieval.top(retrieval.bm25(terms, index(spark, folder).postings), 3, "chunk_id").select("chunk_id")
    # By buckets of ten minutes, so that a video with very many chunks is no single task's.
    placed = before(c.withColumn("bucket", F.floor(F.coalesce("start_ms", F.lit(-1)) / 600_000)), ["video_id"], "bucket", [F.col("start_ms").asc_nulls_last(), F.col("chunk_id")], ix=("sum", F.lit(1)), n=("total", F.lit(1)))
    spots = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.bround(i * ((F.col("n") - 1) / 7.0)).cast("long"))
    line = placed.where((F.col("n") <= 8) | F.array_contains(spots, F.col("ix").cast("long"))).select("chunk_id")
    every = line.unionByName(hits).distinct().select(F.col("chunk_id").alias("__c"))
    w = Window.partitionBy("video_id").orderBy(F.col("start_ms").asc_nulls_last(), "chunk_id")
    return c.join(every, F.col("chunk_id") == F.col("__c"), "left_semi").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 12").select("video_id", "chunk_id", "place")


# Lookups and sources


@query("pred2_unique_key", "SELECT t.id AS asked_by, min(o.id) AS id FROM transcripts t JOIN transcripts o ON o.video_id IS NOT DISTINCT FROM t.video_id AND o.provider IS NOT DISTINCT FROM t.provider AND o.content_hash IS NOT DISTINCT FROM t.content_hash AND o.parser_version IS NOT DISTINCT FROM t.parser_version AND o.normalizer_version IS NOT DISTINCT FROM t.normalizer_version WHERE t.is_active GROUP BY 1")
def pred2(spark, folder):
    """The transcript with the five-part key of each active one; nulls match nulls."""
    keys = ["video_id", "provider", "content_hash", "parser_version", "normalizer_version"]
    t = table(spark, folder, "transcripts").select("id", "is_active", *keys)
    first = t.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min("id").alias("found"))
    return t.where("is_active").join(first, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).select(F.col("id").alias("asked_by"), F.col("found").alias("id"))


@query("s8_structured_selection", """WITH r AS (SELECT *, coalesce(list_position(['vi', 'en'], string_split(replace(lower(trim(language_code)), '_', '-'), '-')[1]), 3) AS rk FROM transcripts WHERE source_format = 'structured')
    SELECT video_id, arg_min(id, (rk, transcript_type <> 'manual', id)) AS id FROM r GROUP BY 1""")
def s8(spark, folder):
    """Of the structured tracks of a video the one of the first preferred language, by the code or its beginning, made by hand before
    generated, then the first."""
    t = table(spark, folder, "transcripts").where("source_format = 'structured'")
    rank = X.language_rank(F.col("language_code"), ("vi", "en"))
    return t.groupBy("video_id").agg(F.min_by("id", F.struct(rank.alias("r"), (F.col("transcript_type") != "manual").alias("g"), "id")).alias("id"))


@query("s13_metadata_lookup", "SELECT DISTINCT m.video_id, nullif(trim(v.title), '') AS title, nullif(trim(v.channel_title), '') AS channel_title, v.id IS NOT NULL AS found FROM chat_messages m LEFT JOIN videos v ON v.id = m.video_id AND v.status = 'ready'")
def s13(spark, folder):
    """Title and channel of each video asked about; one that isn't ready has neither, and that is no error."""
    v = table(spark, folder, "videos").where("status = 'ready'").select("id", "title", "channel_title")
    m = table(spark, folder, "chat_messages").select("video_id").distinct()
    blank = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    return m.join(v, F.col("video_id") == F.col("id"), "left").select("video_id", blank("title"), blank("channel_title"), F.col("id").isNotNull().alias("found"))


_SCANS = (("videos", "id"), ("transcripts", "id"), ("source_segments", "transcript_id"), ("transcript_segments", "id"), ("index_versions", "id"), ("chat_messages", "message_id"), ("documents", "doc_id"), ("mix_targets", "source"))


@query("s15_canonical_scans", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, count(DISTINCT CAST({k} AS VARCHAR)) AS keys, min(CAST({k} AS VARCHAR)) AS first_key FROM {t}" for t, k in _SCANS))
def s15(spark, folder):
    """The canonical tables: rows, keys and the first key of each."""
    out = None
    for name, key in _SCANS:
        k = F.col(key).cast("string")
        one = table(spark, folder, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct(k).alias("keys"), F.min(k).alias("first_key"))
        out = one if out is None else out.unionByName(one)
    return out


_CASES = "CASE WHEN len(sources) = 0 THEN 'unanswerable' WHEN len(sources) >= 3 THEN 'multi_evidence' WHEN trim(answer_language) ILIKE 'vi%' AND regexp_matches(question, '[ăâđêôơưáàảãạ]') THEN 'same_language' WHEN length(question) < 40 THEN 'keyword' WHEN contains(question, '?') THEN 'paraphrase' ELSE 'cross_language' END"


@query(
    "s16_dataset_rules",
    f"""WITH d AS (SELECT DISTINCT message_id, video_id, question, answer, answer_language, sources, groundedness_warning FROM chat_messages), q AS (SELECT message_id, {_CASES} AS case_type, coalesce(trim(groundedness_warning), '') = '' AS reviewed, list_transform(sources, lambda s: s.chunk_id) AS ids, answer IS NULL AS unanswerable FROM d),
      known AS (SELECT DISTINCT s.chunk_id AS id FROM (SELECT unnest(sources) AS s FROM d) WHERE s.score >= 0.1)
    SELECT 'missing case type' AS rule, c AS id FROM (SELECT unnest(['same_language', 'cross_language', 'keyword', 'paraphrase', 'multi_evidence', 'unanswerable']) AS c) WHERE c NOT IN (SELECT case_type FROM q)
    UNION ALL SELECT 'not reviewed', message_id FROM q WHERE NOT reviewed
    UNION ALL SELECT DISTINCT 'unknown segment', message_id FROM (SELECT message_id, unnest(ids) AS i FROM q) WHERE i NOT IN (SELECT id FROM known)
    UNION ALL SELECT 'inconsistent evidence', message_id FROM q WHERE unanswerable <> (len(ids) = 0)""",
)
def s16(spark, folder):
    """Violations of the rules of an evaluation set that the messages are taken for: all six kinds of cases, reviewed, evidence that
    is known (a score from 0.1 on), and none exactly where there is no answer."""
    m = table(spark, folder, "chat_messages").select("message_id", "question", "answer", "answer_language", "sources", "groundedness_warning").dropDuplicates(["message_id"])
    n, question = F.size("sources"), F.col("question")
    case = F.when(n == 0, "unanswerable").when(n >= 3, "multi_evidence").when(F.lower(F.trim("answer_language")).startswith("vi") & question.rlike("[ăâđêôơưáàảãạ]"), "same_language").when(F.char_length(question) < 40, "keyword").when(F.contains(question, F.lit("?")), "paraphrase").otherwise("cross_language")
    q = m.select("message_id", case.alias("case_type"), (F.trim(F.coalesce("groundedness_warning", F.lit(""))) == "").alias("reviewed"), F.transform("sources", lambda s: s["chunk_id"]).alias("ids"), F.col("answer").isNull().alias("unanswerable"))
    types = ("same_language", "cross_language", "keyword", "paraphrase", "multi_evidence", "unanswerable")
    there = q.agg(F.collect_set("case_type").alias("there"))  # six at most
    missing = there.select(F.lit("missing case type").alias("rule"), F.explode(F.array_except(F.array(*map(F.lit, types)), "there")).alias("id"))
    known = m.select(F.explode("sources").alias("s")).where("s.score >= 0.1").select(F.col("s.chunk_id").alias("__k")).distinct()
    unknown = q.select("message_id", F.explode("ids").alias("i")).join(known, F.col("i") == F.col("__k"), "left_anti").select(F.lit("unknown segment").alias("rule"), F.col("message_id").alias("id")).distinct()
    rule = lambda name, cond: q.where(cond).select(F.lit(name).alias("rule"), F.col("message_id").alias("id"))
    return missing.unionByName(rule("not reviewed", ~F.col("reviewed"))).unionByName(unknown).unionByName(rule("inconsistent evidence", F.col("unanswerable") != (F.size("ids") == 0)))


@query("s19_built_cues", f"WITH c AS (SELECT DISTINCT transcript_id, sequence_number, text, start_ms, end_ms FROM source_segments), k AS (SELECT *, {S.squeeze('text')} AS t FROM c) SELECT transcript_id, sequence_number, CASE WHEN start_ms >= 0 AND end_ms > start_ms THEN t END AS text, NOT coalesce(start_ms >= 0 AND end_ms > start_ms, false) AS rejected FROM k WHERE t <> ''")
def s19(spark, folder):
    """Cues built of raw rows: blank texts are dropped, ranges that are negative or empty are rejected."""
    c = table(spark, folder, "source_segments").select("transcript_id", "sequence_number", "text", "start_ms", "end_ms").distinct().withColumn("t", X.squeeze(F.col("text"))).where("t <> ''")
    good = F.coalesce((F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms")), F.lit(False))
    return c.select("transcript_id", "sequence_number", F.when(good, F.col("t")).alias("text"), (~good).alias("rejected"))
