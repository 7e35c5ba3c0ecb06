"""Queries of derived texts, quizzes, grounded answers, source chains and ingest runs, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.embedding import embed
from ..operators import chunks as windows
from ..operators import folds, jobs
from ..session import checkpoint_folder, stored
from ..sources import subtitles
from ..sources.providers import SourceError, acquire
from ..tables import table
from . import sqltext as S
from .entity_queries import store
from .fold_queries import READ, _clock, at_places, payloads, spaced
from .record_queries import _M, sources
from .retrieval_queries import CHUNKS, FTS, RANKED, chunked, index, questions, scored
from .scalar_queries import segments

QUERIES, SQL = {}, {}


def query(name, sql):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _spots(k: int) -> str:
    """Places of ``k`` chunks evenly over those of a transcript, or of all where there are no more."""
    return f"""sp{k} AS (SELECT transcript_id, w, row_number() OVER (PARTITION BY transcript_id ORDER BY w) AS place FROM (
      SELECT DISTINCT transcript_id, CASE WHEN n <= {k} THEN i ELSE CAST(round_even(i * ((n - 1) / {k - 1}.0::DOUBLE), 0) AS BIGINT) END AS w FROM (SELECT transcript_id, count(*) AS n FROM chunks GROUP BY 1), range({k}) r(i) WHERE i < n))"""


def _at(k: int) -> str:
    return f'chunks c JOIN sp{k} p ON p.transcript_id = c.transcript_id AND p.w = c."window"'


# The headings of the reference's summaries.
HEADINGS = {"short": "Tóm tắt ngắn:", "detailed": "Các ý chính trong video:", "sections": "Tóm tắt theo phần:", "timeline": "Tóm tắt theo timeline:"}
_FROM, _TO = S.clock("start_ms / 1000.0"), S.clock("end_ms / 1000.0")


@query(
    "d2_summaries",
    f"""WITH {CHUNKS}, {_spots(8)}, {_spots(12)}, {_spots(18)},
      a AS (SELECT c.transcript_id, '{HEADINGS['short']}' || chr(10) || string_agg('- [' || {_FROM} || '] ' || {S.shorten('text', 150)}, chr(10) ORDER BY place) AS t FROM {_at(8)} WHERE place <= 7 GROUP BY 1),
      b AS (SELECT c.transcript_id, CASE WHEN count(*) >= 12 THEN '{HEADINGS['sections']}' || chr(10) || string_agg('- Phần ' || place || ' [' || {_FROM} || ']: ' || {S.shorten('text', 170)}, chr(10) ORDER BY place) FILTER (place <= 10)
             ELSE '{HEADINGS['detailed']}' || chr(10) || string_agg(place || '. ' || {S.shorten('text', 180)}, chr(10) ORDER BY place) END AS t FROM {_at(12)} GROUP BY 1),
      d AS (SELECT c.transcript_id, '{HEADINGS['timeline']}' || chr(10) || string_agg('- ' || {_FROM} || '-' || {_TO} || ': ' || {S.shorten('text', 160)}, chr(10) ORDER BY place) AS t FROM {_at(18)} GROUP BY 1)
    SELECT transcript_id, a.t AS short, b.t AS detailed, d.t AS timeline FROM a JOIN b USING (transcript_id) JOIN d USING (transcript_id)""",
)
def d2(spark, folder):
    """Short, detailed and timeline summary of each transcript from 8, 12 and 18 chunks evenly over its whole length."""
    c = chunked(spark, folder).select("transcript_id", "window", "text", "start_ms", "end_ms")
    clock = lambda ms: X.minutes_seconds(F.col(ms) / 1000)
    short = lambda n: X.shorten(F.col("text"), n)
    place = F.col("place").cast("string")

    def listed(k, **lines):
        per = at_places(c, lambda n: spaced(n, k)).groupBy("transcript_id")
        return per.agg(F.array_sort(F.collect_list(F.struct("place", *[v.alias(name) for name, v in lines.items()]))).alias(f"l{k}")).withColumnRenamed("transcript_id", f"__{k}")

    show = lambda k, name, most: F.array_join(F.transform(F.slice(f"l{k}", 1, most), lambda x: x[name]), "\n")
    head = lambda name, body: F.concat(F.lit(HEADINGS[name] + "\n"), body)
    a = listed(8, line=F.concat(F.lit("- ["), clock("start_ms"), F.lit("] "), short(150)))
    b = listed(12, few=F.concat(place, F.lit(". "), short(180)), many=F.concat(F.lit("- Phần "), place, F.lit(" ["), clock("start_ms"), F.lit("]: "), short(170)))
    d = listed(18, line=F.concat(F.lit("- "), clock("start_ms"), F.lit("-"), clock("end_ms"), F.lit(": "), short(160)))
    both = a.join(b, F.col("__8") == F.col("__12")).join(d, F.col("__8") == F.col("__18"))
    detailed = F.when(F.size("l12") >= 12, head("sections", show(12, "many", 10))).otherwise(head("detailed", show(12, "few", 12)))
    return both.select(F.col("__8").alias("transcript_id"), head("short", show(8, "line", 7)).alias("short"), detailed.alias("detailed"), head("timeline", show(18, "line", 18)).alias("timeline"))


MODES = ("practice", "concept_check", "exam")
_CANNED = [f"None of the passages says this ({i})." for i in (1, 2, 3)]
_KIND = "CASE mode WHEN 'practice' THEN CASE WHEN place % 2 = 1 THEN 'multiple_choice' ELSE 'true_false' END ELSE CASE WHEN place % 3 = 0 THEN 'short_answer' ELSE 'multiple_choice' END END"


@query(
    "d5_quiz_modes",
    f"""WITH {CHUNKS}, {_spots(5)}, s AS (SELECT transcript_id, "window", {S.shorten('text', 180)} AS short FROM chunks), f AS (SELECT transcript_id, short, min("window") AS first FROM s GROUP BY ALL),
      n AS (SELECT transcript_id, list(short ORDER BY first) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY first) AS k FROM f) WHERE k <= 4 GROUP BY 1),
      q AS (SELECT c.transcript_id, c.chunk_id, place, {S.shorten('text', 180)} AS answer, list_concat([{S.shorten('text', 180)}], list_concat(list_filter(texts, lambda t: t <> {S.shorten('text', 180)}), [{', '.join("'" + c + "'" for c in _CANNED)}])[1:3]) AS four FROM {_at(5)} JOIN n ON n.transcript_id = c.transcript_id),
      m AS (SELECT *, {_KIND} AS kind FROM q, (VALUES ('practice'), ('concept_check'), ('exam')) x(mode))
    SELECT mode, chunk_id || '-q' || place AS question_id, kind, CASE kind WHEN 'true_false' THEN ['Đúng', 'Sai'] WHEN 'short_answer' THEN CAST([] AS VARCHAR[]) ELSE list_concat(four[place % 4 + 1:], four[1:place % 4]) END AS options, CASE kind WHEN 'true_false' THEN 'Đúng' ELSE answer END AS correct_answer FROM m""",
)
def d5(spark, folder):
    """Quizzes in three modes: five questions a transcript, of the kinds that the mode gives to each number."""
    c = chunked(spark, folder).select("transcript_id", "window", "chunk_id", X.shorten(F.col("text"), 180).alias("short"))
    texts = c.groupBy(F.col("transcript_id").alias("__t"), "short").agg(F.min("window").alias("first"))
    # Of a transcript's distinct texts the first four: one of them may be the answer.
    best = texts.withColumn("nth", F.row_number().over(Window.partitionBy("__t").orderBy("first"))).where("nth <= 4")
    pools = best.groupBy("__t").agg(F.array_sort(F.collect_list(F.struct("first", "short"))).alias("pool"))
    asked = at_places(c, lambda n: spaced(n, 5)).join(pools, F.col("transcript_id") == F.col("__t")).withColumn("mode", F.explode(F.array(*map(F.lit, MODES))))
    n = F.col("place")
    kind = F.when(F.col("mode") == "practice", F.when(n % 2 == 1, "multiple_choice").otherwise("true_false")).otherwise(F.when(n % 3 == 0, "short_answer").otherwise("multiple_choice"))
    others = F.filter(F.transform("pool", lambda x: x["short"]), lambda t: t != F.col("short"))
    four = F.concat(F.array("short"), F.slice(F.concat(others, F.array(*map(F.lit, _CANNED))), 1, 3))
    turn = (n % 4).cast("int")
    turned = F.concat(F.slice(four, turn + 1, 4 - turn), F.slice(four, F.lit(1), turn))
    options = F.when(kind == "true_false", F.array(F.lit("Đúng"), F.lit("Sai"))).when(kind == "short_answer", F.array().cast("array<string>")).otherwise(turned)
    return asked.select("mode", F.concat("chunk_id", F.lit("-q"), n.cast("string")).alias("question_id"), kind.alias("kind"), options.alias("options"), F.when(kind == "true_false", "Đúng").otherwise(F.col("short")).alias("correct_answer"))


@query(
    "d6_quiz_validation",
    f"""WITH {_M}, r AS (SELECT message_id, unnest(sources) AS s, generate_subscripts(sources, 1) AS i, len(sources) AS n, length(question) AS l FROM m),
      q AS (SELECT *, (['multiple_choice', 'true_false', 'short_answer'])[(l + i) % 3 + 1] AS kind, i % 4 <> 0 AS known, l % 5 <> 0 AS four, l % 7 <> 0 AS within FROM r)
    SELECT message_id, s.chunk_id || '-llm-q' || i AS question_id, kind, CASE kind WHEN 'multiple_choice' THEN 4 WHEN 'true_false' THEN 2 ELSE 0 END AS options FROM q
    WHERE known AND (kind = 'short_answer' OR (kind = 'true_false' AND within) OR (kind = 'multiple_choice' AND four AND within))""",
)
def d6(spark, folder):
    """Questions in a model's reply that hold: of a known source, of a known kind, with four options where there is a choice and the
    answer among them. The replies are made of the messages; some have wrong sources, three options or another answer."""
    m = sources(spark, folder)
    l = F.char_length("question")

    def raw(s, k):
        i = k + 1
        kind = F.get(F.array(F.lit("multiple_choice"), F.lit("true_false"), F.lit("short_answer")), ((l + i) % 3).cast("int"))
        right = F.when(l % 7 == 0, F.lit("another")).when(kind == "true_false", F.lit("Đúng")).otherwise(F.lit("a"))
        options = F.slice(F.array(*map(F.lit, "abcd")), F.lit(1), F.when(l % 5 == 0, 3).otherwise(4))
        return F.struct(F.when(i % 4 == 0, F.lit("unknown")).otherwise(s["chunk_id"]).alias("source_chunk_id"), kind.alias("question_type"), options.alias("options"), right.alias("correct_answer"))

    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.transform("sources", raw).alias("questions"))), F.lit("\n```"))
    read = F.from_json(X.json_object(F.col("reply")), "questions array<struct<source_chunk_id: string, question_type: string, options: array<string>, correct_answer: string>>")
    q = m.select("message_id", F.transform("sources", lambda s: s["chunk_id"]).alias("known"), reply.alias("reply")).select("message_id", "known", F.posexplode(read["questions"]).alias("k", "q"))
    kind, right = F.col("q.question_type"), F.col("q.correct_answer")
    options = F.when(kind == "true_false", F.array(F.lit("Đúng"), F.lit("Sai"))).when(kind == "short_answer", F.array().cast("array<string>")).otherwise(F.col("q.options"))
    good = F.array_contains("known", F.col("q.source_chunk_id")) & kind.isin("multiple_choice", "true_false", "short_answer") & ((kind != "multiple_choice") | (F.size(options) == 4)) & ((F.size(options) == 0) | F.array_contains(options, right))
    return q.where(good).select("message_id", F.concat("q.source_chunk_id", F.lit("-llm-q"), (F.col("k") + 1).cast("string")).alias("question_id"), kind.alias("kind"), F.size(options).alias("options"))


SECTION_CHARS, SECTIONS = 9000, 8


@query(
    "w11_time_sections",
    f"""WITH RECURSIVE {CHUNKS}, s(transcript_id, w, begun, section) AS (
      SELECT transcript_id, "window", start_ms, 0 FROM chunks WHERE "window" = 0
      UNION ALL
      SELECT c.transcript_id, c."window", CASE WHEN s.begun IS NULL THEN c.start_ms WHEN c.start_ms IS NOT NULL AND c.end_ms - s.begun >= 300000 THEN c.start_ms ELSE s.begun END, s.section + CASE WHEN s.begun IS NOT NULL AND c.start_ms IS NOT NULL AND c.end_ms - s.begun >= 300000 THEN 1 ELSE 0 END
      FROM s JOIN chunks c ON c.transcript_id = s.transcript_id AND c."window" = s.w + 1)
    SELECT transcript_id, w AS "window", section FROM s""",
)
def w11(spark, folder):
    return folds.sections(chunked(spark, folder))


@query(
    "d7_sectioned_summary",
    SQL["w11_time_sections"].rsplit("SELECT transcript_id, w", 1)[0]
    + f""", n AS (SELECT transcript_id, max(section) + 1 AS n FROM s GROUP BY 1),
      g AS (SELECT s.transcript_id, s.w, CASE WHEN n.n <= {SECTIONS} THEN s.section ELSE (SELECT max(i) FROM range({SECTIONS}) r(i) WHERE CAST(round_even(i * (n.n / {SECTIONS}.0::DOUBLE), 0) AS BIGINT) <= s.section) END AS part FROM s JOIN n USING (transcript_id)),
      t AS (SELECT g.transcript_id, g.part, string_agg({S.shorten('c.text', 350)}, chr(10) ORDER BY g.w) AS body, string_agg(c.chunk_id, ',' ORDER BY g.w) AS ids FROM g JOIN chunks c ON c.transcript_id = g.transcript_id AND c."window" = g.w GROUP BY ALL),
      x AS (SELECT transcript_id, part, substr(body, 1, {SECTION_CHARS}) AS body, 'summary:section:' || sha256(ids) AS key FROM t)
    SELECT transcript_id, count(*) AS sections, string_agg('## ' || (part + 1) || chr(10) || body, chr(10) ORDER BY part) AS summary, string_agg(key, ',' ORDER BY part) AS keys FROM x GROUP BY 1""",
)
def d7(spark, folder):
    """Each transcript in sections of 300 s, at most eight after merging; each is summed up on its own within a budget of
    characters under a key of its own, and the sums are put together."""
    c = stored(chunked(spark, folder).select("transcript_id", "window", "chunk_id", "text", "start_ms", "end_ms"))
    s = folds.sections(c).select(F.col("transcript_id").alias("__t"), F.col("window").alias("__w"), "section")
    n = s.groupBy(F.col("__t").alias("__n")).agg((F.max("section") + 1).alias("n"))
    bounds = F.transform(F.sequence(F.lit(0), F.lit(SECTIONS - 1)), lambda i: F.bround(i * (F.col("n") / float(SECTIONS))).cast("int"))
    part = F.when(F.col("n") <= SECTIONS, F.col("section")).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("section"))) - 1)
    known = c.join(s, (F.col("transcript_id") == F.col("__t")) & (F.col("window") == F.col("__w"))).join(n, F.col("transcript_id") == F.col("__n")).withColumn("part", part)
    per = known.groupBy("transcript_id", "part").agg(F.array_sort(F.collect_list(F.struct("window", X.shorten(F.col("text"), 350).alias("t"), "chunk_id"))).alias("cs"))
    join = lambda f, by: F.array_join(F.transform("cs", lambda x: x[f]), by)
    x = per.select("transcript_id", "part", F.substring(join("t", "\n"), 1, SECTION_CHARS).alias("body"), F.concat(F.lit("summary:section:"), F.sha2(join("chunk_id", ","), 256)).alias("key"))
    line = F.struct("part", F.concat(F.lit("## "), (F.col("part") + 1).cast("string"), F.lit("\n"), "body").alias("b"), "key")
    whole = x.groupBy("transcript_id").agg(F.array_sort(F.collect_list(line)).alias("l"))
    return whole.select("transcript_id", F.size("l").cast("long").alias("sections"), F.array_join(F.transform("l", lambda p: p["b"]), "\n").alias("summary"), F.array_join(F.transform("l", lambda p: p["key"]), ",").alias("keys"))


@query(
    "d8_cached_outputs",
    f"""WITH m AS (SELECT message_id, video_id, question, answer, generation, retrieval_mode, min(created_at) AS created_at FROM chat_messages GROUP BY ALL), u AS (SELECT *, generation.generation_mode = 'llm' AND coalesce(answer, '') <> '' AND regexp_matches(trim(answer), '[.!?)\\]]$') AS valid FROM m),
      c AS (SELECT video_id, question, arg_max(message_id, (created_at, message_id)) AS cached FROM u WHERE valid GROUP BY ALL)
    SELECT u.message_id, CASE WHEN retrieval_mode <> 'hybrid' THEN cached END AS served, retrieval_mode = 'hybrid' OR cached IS NULL AS to_compute FROM u LEFT JOIN c ON c.video_id = u.video_id AND c.question = u.question""",
)
def d8(spark, folder):
    """What is served from the cache: the newest output of a video and question that is a model's and complete. Requests in mode
    hybrid force a new one."""
    m = table(spark, folder, "chat_messages").select("message_id", "video_id", "question", "answer", "generation", "retrieval_mode", "created_at")
    # A message sent again counts from its first time.
    m = m.groupBy("message_id", "video_id", "question", "answer", "generation", "retrieval_mode").agg(F.min("created_at").alias("created_at"))
    valid = (F.col("generation.generation_mode") == "llm") & (F.coalesce("answer", F.lit("")) != "") & F.trim("answer").rlike("[.!?)\\]]$")
    c = m.where(valid).groupBy(F.col("video_id").alias("__v"), F.col("question").alias("__q")).agg(F.max_by("message_id", F.struct("created_at", "message_id")).alias("cached"))
    forced = F.col("retrieval_mode") == "hybrid"
    return m.join(c, (F.col("video_id") == F.col("__v")) & (F.col("question") == F.col("__q")), "left").select("message_id", F.when(~forced, F.col("cached")).alias("served"), (forced | F.col("cached").isNull()).alias("to_compute"))


ANSWER = "answer string, answer_language string, citations array<struct<chunk_id: string>>, insufficient_evidence boolean"


@query(
    "d9_grounded_answers",
    f"""WITH {_M}, a AS (SELECT message_id, length(question) AS l, coalesce(answer, '') = '' AS none, len(sources) AS n FROM m)
    SELECT message_id, CASE WHEN l % 11 = 0 THEN 'invalid_json' WHEN l % 4 = 0 AND n > 0 THEN 'unknown_citation' WHEN l % 5 = 0 THEN 'language' WHEN none AND n > 0 THEN 'citations_without_evidence' END AS error,
      l % 11 <> 0 AS usable FROM a""",
)
def d9(spark, folder):
    """Structured answers checked against their schema, the passages given, the language asked for and their own claim; one that fails
    is repaired once, and is usable if it then holds. Replies are made of the messages; some are cut, cite what was not given,
    or name another language. A reply that isn't JSON can't be repaired without a model."""
    m = table(spark, folder, "chat_messages").select("message_id", "question", "answer", "sources").dropDuplicates(["message_id"])
    l = F.char_length("question")
    cited = F.transform("sources", lambda s: F.struct(F.when(l % 4 == 0, F.lit("elsewhere")).otherwise(s["chunk_id"]).alias("chunk_id")))
    language = X.answer_language(F.col("question"))
    body = F.to_json(F.struct(F.coalesce("answer", F.lit("")).alias("answer"), F.when(l % 5 == 0, F.lit("xx")).otherwise(F.upper(language)).alias("answer_language"), cited.alias("citations"), (F.coalesce("answer", F.lit("")) == "").alias("insufficient_evidence")))
    reply = F.when(l % 11 == 0, F.substring(body, 1, 20)).otherwise(body)
    known = F.transform("sources", lambda s: s["chunk_id"])
    rows = m.select("message_id", language.alias("expected"), known.alias("allowed"), reply.alias("reply")).withColumn("a", F.from_json("reply", ANSWER, {"mode": "PERMISSIVE"}))
    fault = X.answer_fault(F.col("a"), F.col("allowed"), F.col("expected"))
    kept = F.filter("a.citations", lambda c: F.array_contains("allowed", c["chunk_id"]))
    mended = F.when(F.col("a.answer").isNotNull(), F.struct(F.col("a.answer").alias("answer"), F.col("expected").alias("answer_language"), F.when(F.col("a.insufficient_evidence"), F.array().cast("array<struct<chunk_id: string>>")).otherwise(kept).alias("citations"), F.col("a.insufficient_evidence").alias("insufficient_evidence")))
    checked = rows.withColumn("error", fault).withColumn("b", mended)
    return checked.select("message_id", "error", (F.col("error").isNull() | X.answer_fault(F.col("b"), F.col("allowed"), F.col("expected")).isNull()).alias("usable"))


# Sources and ingest

_ORDER = ("manual", "generated", "asr")


@query(
    "s11_fallback_chain",
    """WITH a AS (SELECT v.id, bool_or(t.transcript_type = 'manual') AS m, bool_or(t.transcript_type = 'generated') AS g, bool_or(t.transcript_type = 'asr') AS a FROM videos v LEFT JOIN transcripts t ON t.video_id = v.id GROUP BY 1),
      b AS (SELECT id, coalesce(m, false) AS m, coalesce(g, false) AS g, coalesce(a, false) AS a, ascii(right(id, 1)) % 2 = 0 AS flaky FROM a)
    SELECT id, CASE WHEN m THEN 'manual' WHEN g THEN 'generated' WHEN a THEN 'asr' END AS source, CASE WHEN m THEN CASE WHEN flaky THEN 2 ELSE 1 END WHEN g THEN 2 WHEN a THEN 3 ELSE 3 END AS attempts,
      CASE WHEN NOT (m OR g OR a) THEN 'NOT_FOUND' END AS error FROM b""",
)
def s11(spark, folder):
    """The chain run for every video: sources of each kind in order, each failing for good where the video has no such transcript;
    the first is flaky for some videos, so that it is tried again."""
    v = table(spark, folder, "videos").select("id")
    t = table(spark, folder, "transcripts").groupBy(F.col("video_id").alias("__v")).agg(F.collect_set("transcript_type").alias("kinds"))
    known = v.join(t, F.col("id") == F.col("__v"), "left").select("id", F.array_join(F.coalesce("kinds", F.array().cast("array<string>")), ",").alias("kinds"))

    class Kind:
        def __init__(self, name: str, kinds: set, flaky: bool) -> None:
            self.name, self.kinds, self.flaky = name, kinds, flaky

        def fetch(self, video, languages):
            if self.name not in self.kinds:
                raise SourceError("NOT_FOUND")
            if self.flaky:
                self.flaky = False
                raise SourceError("DOWNLOAD_FAILED", retryable=True)
            return [("text", 0, 1)]

    def run(batches):
        for rows in batches:
            out = []
            for video, kinds in zip(rows["id"], rows["kinds"]):
                chain = [Kind(k, set(kinds.split(",")), k == "manual" and ord(video[-1]) % 2 == 0) for k in _ORDER]
                try:
                    got = acquire(chain, video, ("vi", "en"), sleep=lambda s: None)
                    out.append((video, got.source, len(got.attempts), None))
                except SourceError as e:
                    out.append((video, None, len(chain), e.code))
            yield pd.DataFrame(out, columns=["id", "source", "attempts", "error"])

    return known.mapInPandas(run, "id string, source string, attempts int, error string")


def subtitle_files(spark, folder):
    """Payloads of every raw transcript in its format: ``key, video_id, track, language_code, format, payload``. A structured one has
    no file format of its own and is written as text."""
    t = table(spark, folder, "transcripts").select("id", "video_id", "language_code", "source_format")
    start, length = F.col("start_ms").cast("string"), (F.col("end_ms") - F.col("start_ms")).cast("string")
    lines = {
        "vtt": (F.concat(_clock(F.col("start_ms")), F.lit(" --> "), _clock(F.col("end_ms")), F.lit("\n"), "clean", F.lit("\n")), "WEBVTT\n\n", "\n"),
        "ttml": (F.concat(F.lit('<p begin="'), start, F.lit('ms" dur="'), length, F.lit('ms">'), "clean", F.lit("</p>")), "<tt><body><div>", "</div></body></tt>"),
        "srv3": (F.concat(F.lit('<p t="'), start, F.lit('" d="'), length, F.lit('">'), "clean", F.lit("</p>")), "<timedtext><body>", "</body></timedtext>"),
    }
    files = None
    lines["structured"] = lines["vtt"]
    for kind, (line, head, foot) in lines.items():
        written = payloads(spark, folder, line, head, foot).withColumn("track", F.split("key", "/")[0])
        one = written.join(t.where(F.col("source_format") == kind), F.col("track") == F.col("id")).select("key", "video_id", "track", "language_code", F.lit(kind).alias("format"), "payload")
        files = one if files is None else files.unionByName(one)
    return files


@query("s18_file_source", READ.replace("SELECT transcript_id ||", "SELECT transcript_id, transcript_id ||").split("SELECT transcript_id, transcript_id ||")[0].rstrip() + f""", tr AS (SELECT id FROM (SELECT t.id, row_number() OVER (PARTITION BY t.video_id ORDER BY coalesce(list_position(['vi', 'en'], string_split(replace(lower(trim(t.language_code)), '_', '-'), '-')[1]), 3), CASE t.source_format WHEN 'vtt' THEN 0 WHEN 'srv3' THEN 1 ELSE 2 END, t.id) AS rk FROM transcripts t WHERE t.normalizer_version IS NULL AND t.source_format IN ('vtt', 'srv3', 'ttml')) WHERE rk = 1)
      SELECT c.transcript_id, {S.squeeze('t')} AS text, start_ms, end_ms FROM c JOIN tr ON tr.id = c.transcript_id WHERE t <> '' AND start_ms >= 0 AND end_ms > start_ms""")
def s18(spark, folder):
    """Subtitle files read back: payloads of every raw transcript are written in its format, the best track of each video is picked and
    parsed by its format."""
    files = subtitle_files(spark, folder).where("format <> 'structured'")
    path = f"{checkpoint_folder(spark)}/subtitles-{folder.rstrip('/').rsplit('/', 1)[-1]}"
    files.write.mode("overwrite").json(path)
    read = spark.read.schema("key string, video_id string, track string, language_code string, format string, payload string").json(path)
    rank = F.struct(X.language_rank(F.col("language_code"), ("vi", "en")).alias("r"), F.when(F.col("format") == "vtt", 0).when(F.col("format") == "srv3", 1).otherwise(2).alias("f"), F.col("track").alias("k"))
    best = read.groupBy(F.col("video_id").alias("__v")).agg(F.min_by("track", rank).alias("__track"))
    chosen = read.join(best, (F.col("video_id") == F.col("__v")) & (F.col("track") == F.col("__track")))
    return subtitles.parse_subtitles(chosen.select("key", "format", "payload")).where("error IS NULL").select(F.split("key", "/")[0].alias("transcript_id"), "text", "start_ms", "end_ms")


def _requests(spark, folder, changed: bool):
    v = table(spark, folder, "videos").select("id", "title", "status")
    t = table(spark, folder, "transcripts").where("is_active").groupBy(F.col("video_id").alias("__v")).agg(F.min("content_hash").alias("hash"))
    mark = F.when((F.col("status") == "ready") & F.lit(changed), F.lit("-2")).otherwise("")
    return v.join(t, F.col("id") == F.col("__v")).select(F.col("id").alias("video_id"), "title", F.concat("hash", mark).alias("fingerprint"))


def _stages(spark, folder):
    videos = table(spark, folder, "transcripts").where("is_active").select(F.col("id").alias("__t"), F.col("video_id").alias("__v"))
    cues = segments(spark, folder).join(videos, F.col("transcript_id") == F.col("__t"))
    fetch = lambda rows: cues.join(rows.select("video_id"), F.col("__v") == F.col("video_id"), "left_semi").drop("__t")

    def chunk(rows):
        made = windows.word_windows(rows)
        return made.join(rows.select(F.col("transcript_id").alias("__x"), F.col("__v").alias("video_id")).distinct(), F.col("transcript_id") == F.col("__x")).select("video_id", F.concat("transcript_id", F.lit(":"), F.lpad(F.col("window").cast("string"), 6, "0")).alias("chunk_id"), "text")

    return [jobs.Stage("fetching_transcript", fetch), jobs.Stage("chunking", chunk), jobs.Stage("embedding", lambda rows: rows.withColumn("embedding", embed("text")))]


_ACTIVE = "act AS (SELECT video_id FROM transcripts WHERE is_active GROUP BY 1), per AS (SELECT t.video_id, count(*) AS chunks FROM chunks c JOIN transcripts t ON t.id = c.transcript_id AND t.is_active GROUP BY 1)"


@query("c6_ingest", f"WITH {CHUNKS}, {_ACTIVE} SELECT v.id AS video_id, 'ready' AS status, CASE WHEN v.status = 'ready' THEN 'made' ELSE 'hit' END AS outcome, coalesce(chunks, 0) AS chunks FROM videos v JOIN act ON act.video_id = v.id LEFT JOIN per ON per.video_id = v.id")
def c6(spark, folder):
    """All videos taken in, then again: those with the same fingerprint are hits, the changed ones are made anew, and all are
    published in one transaction."""
    s = store(spark)
    for changed in (False, True):
        jobs.ingest(s, _requests(spark, folder, changed), _stages(spark, folder))
    n = s.read("chunks").groupBy(F.col("video_id").alias("__v")).agg(F.count("*").alias("chunks"))
    return s.read("jobs").join(n, F.col("video_id") == F.col("__v"), "left").select("video_id", "status", "outcome", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))


@query("g4_cancelled_and_failed", f"WITH {CHUNKS}, {_ACTIVE} SELECT v.id AS video_id, 'ready' AS status, coalesce(chunks, 0) AS chunks FROM videos v JOIN act ON act.video_id = v.id LEFT JOIN per ON per.video_id = v.id")
def g4(spark, folder):
    """After one whole ingest, a cancelled and a failing one change nothing that readers see."""
    s = store(spark)
    first = jobs.ingest(s, _requests(spark, folder, False), _stages(spark, folder))
    stopped = jobs.ingest(s, _requests(spark, folder, True), _stages(spark, folder), cancelled=lambda: True)

    def broken(rows):
        raise SourceError("PARSE_FAILED")

    failed = jobs.ingest(s, _requests(spark, folder, True), [jobs.Stage("fetching_transcript", broken)])
    assert (first.status, stopped.status, failed.status, failed.error_code) == ("ready", "cancelled", "failed", "PARSE_FAILED")
    n = s.read("chunks").groupBy(F.col("video_id").alias("__v")).agg(F.count("*").alias("chunks"))
    return s.read("videos").join(n, F.col("video_id") == F.col("__v"), "left").select("video_id", "status", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))


@query("c8_vector_rebuild", f"WITH {CHUNKS} SELECT chunk_id, 256 AS dimension, true AS same FROM chunks JOIN transcripts t ON t.id = chunks.transcript_id AND t.is_active")
def c8(spark, folder):
    """The vectors of a store's chunks made again without touching the chunks, and compared with those before."""
    s = store(spark)
    jobs.ingest(s, _requests(spark, folder, False), _stages(spark, folder))
    with s.transaction() as tx:
        tx.rewrite("vectors", s.read("chunks").select("video_id", "chunk_id", embed("text").alias("embedding")))
    old = s.read("chunks").select(F.col("chunk_id").alias("__c"), F.col("embedding").alias("before"))
    return s.read("vectors").join(old, F.col("chunk_id") == F.col("__c")).select("chunk_id", F.size("embedding").alias("dimension"), (F.col("embedding") == F.col("before")).alias("same"))


# Index scope


@query("j1_scoped_hits", f"""WITH {FTS}, act AS (SELECT transcript_id, min(id) AS version_id FROM index_versions WHERE status = 'active' GROUP BY 1)
    SELECT b.query_id, b.chunk_id, a.version_id, b.score FROM bm b JOIN chunks c USING (chunk_id) JOIN act a ON a.transcript_id = c.transcript_id""")
def j1(spark, folder):
    """Full-text hits joined with the chunks of an active index version; others are out of scope."""
    from .retrieval_queries import folded_scores

    act = table(spark, folder, "index_versions").where("status = 'active'").groupBy(F.col("transcript_id").alias("__t")).agg(F.min("id").alias("version_id"))
    c = chunked(spark, folder).select(F.col("chunk_id").alias("__c"), "transcript_id").join(act, F.col("transcript_id") == F.col("__t"))
    return folded_scores(spark, folder).join(c, F.col("chunk_id") == F.col("__c")).select("query_id", "chunk_id", "version_id", "score")


@query("r2_scoped_search", SQL["j1_scoped_hits"].replace("SELECT b.query_id, b.chunk_id, a.version_id, b.score FROM", "SELECT query_id, chunk_id, version_id, score, place FROM (SELECT b.query_id, b.chunk_id, a.version_id, b.score, row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, b.chunk_id) AS place FROM") + ") WHERE place <= 20")
def r2_scoped(spark, folder):
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return j1(spark, folder).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 20")


@query(
    "w15_character_budget",
    """WITH RECURSIVE m AS (SELECT DISTINCT message_id, sources FROM chat_messages), x AS (SELECT message_id, sources[i].chunk_id AS chunk_id, i - 1 AS place, """
    + S.squeeze("sources[i].text")
    + """ AS plain FROM (SELECT message_id, sources, generate_subscripts(sources, 1) AS i FROM m)),
      b(message_id, place, chunk_id, text, remaining) AS (
        SELECT DISTINCT message_id, -1::BIGINT, '', '', 400::BIGINT FROM x
        UNION ALL
        SELECT x.message_id, x.place, x.chunk_id, x.cut, b.remaining - length(x.cut) FROM b JOIN LATERAL (
          SELECT y.*, CASE WHEN length(plain) <= room THEN plain WHEN room <= 3 THEN substr(plain, 1, room) ELSE rtrim(substr(plain, 1, room - 3)) || '...' END AS cut FROM (SELECT x.*, least(150, b.remaining) AS room FROM x WHERE x.message_id = b.message_id AND x.place = b.place + 1) y
        ) x ON true WHERE b.remaining > 0)
    SELECT message_id, CAST(place AS INTEGER) AS place, chunk_id, text FROM b WHERE place >= 0""",
)
def w15(spark, folder):
    from .relational_queries import w15 as plain

    return plain(spark, folder)
