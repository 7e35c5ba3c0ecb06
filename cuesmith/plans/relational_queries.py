"""Lookups, joins, aggregates, ranks and set operations over the tables.

``both`` registers queries that plain SQL states best: one text, which Spark and the comparison run. Where partitioning
matters the query is written with DataFrames and has SQL of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunks, intervals
from ..operators.ordered import before
from ..tables import table
from . import sqltext as S
from .interval_queries import SQL as INTERVAL_SQL
from .retrieval_queries import CHUNKS, chunked
from .scalar_queries import messages, segments

QUERIES, SQL = {}, {}
TABLES = "region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|videos|transcripts|source_segments|transcript_segments|index_versions|chat_messages|mix_targets"


def query(name, sql):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def both(name: str, sql: str) -> None:
    def run(spark, folder):
        return spark.sql(re.sub(rf"\b(FROM|JOIN) ({TABLES})\b", lambda m: f"{m[1]} parquet.`{folder}/{m[2]}.parquet`", sql))

    QUERIES[name], SQL[name] = run, sql


_ANSWER = "coalesce(answer, '')"
MSG = "(SELECT DISTINCT message_id, video_id, question, answer, answer_language, retrieval_mode, groundedness_warning FROM chat_messages x)"
SEG = "(SELECT DISTINCT id, transcript_id, sequence_number, original_text, normalized_text, start_ms, end_ms FROM transcript_segments x)"

# Lookups and predicates
both("pred1_primary_key", f"SELECT m.message_id, v.title, v.status FROM {MSG} m JOIN videos v ON v.id = m.video_id")
both("pred3_active_version", "SELECT t.id AS transcript_id, i.id AS version_id, i.fingerprint FROM transcripts t JOIN index_versions i ON i.transcript_id = t.id WHERE t.is_active AND i.status = 'active'")
both("pred4_newest_active_job", "SELECT e.user_id, max_by(e.event_id, e.event_id) AS event_id, count(*) AS n FROM events e WHERE e.event_type IN ('view', 'click') GROUP BY e.user_id")
both("pred5_running_jobs", "SELECT i.id, i.video_id, i.transcript_id FROM index_versions i WHERE i.status = 'building'")
both("pred8_segment_count", f"SELECT t.video_id, count(*) AS n FROM {SEG} s JOIN transcripts t ON t.id = s.transcript_id GROUP BY t.video_id")
both("pred9_filter_after_top", "SELECT user_id, event_id, value FROM (SELECT e.user_id, e.event_id, e.value, row_number() OVER (PARTITION BY e.user_id ORDER BY e.value DESC, e.event_id) AS rk FROM events e) r WHERE rk <= 3 AND value > 50")
both("pred15_projection", "SELECT t.id AS transcript_id, t.language_code, t.transcript_type, t.is_active, t.quality_diagnostics.covered_ms AS covered_ms, t.quality_diagnostics.largest_gap_ms AS largest_gap_ms FROM transcripts t")
both("pred17_cache_lookup", f"SELECT m.video_id, m.retrieval_mode, m.question, max(m.message_id) AS message_id FROM {MSG} m GROUP BY m.video_id, m.retrieval_mode, m.question")

# Joins
both("j2_hydration", f"SELECT i.id AS version_id, t.provider, t.language_code, v.title FROM index_versions i JOIN transcripts t ON t.id = i.transcript_id JOIN videos v ON v.id = i.video_id")
both("j7_previous_of_child", f"SELECT a.id, b.id AS previous_id FROM {SEG} a LEFT JOIN {SEG} b ON b.transcript_id = a.transcript_id AND b.sequence_number = a.sequence_number - 1")
both("j9_semi_join", "SELECT v.id FROM videos v WHERE EXISTS (SELECT 1 FROM chat_messages m WHERE m.video_id = v.id)")
both("j9_anti_join", "SELECT t.id FROM transcripts t WHERE NOT EXISTS (SELECT 1 FROM index_versions i WHERE i.transcript_id = t.id AND i.status = 'active')")
both("j11_entity_graph", f"SELECT v.id, count(DISTINCT t.id) AS transcripts, count(DISTINCT i.id) AS versions FROM videos v LEFT JOIN transcripts t ON t.video_id = v.id LEFT JOIN index_versions i ON i.transcript_id = t.id GROUP BY v.id")
both("j12_active_segments", f"SELECT v.youtube_video_id, s.sequence_number, s.start_ms, s.end_ms, s.normalized_text FROM videos v JOIN transcripts t ON t.video_id = v.id AND t.is_active JOIN {SEG} s ON s.transcript_id = t.id")
both("j13_library_merge", f"SELECT coalesce(v.id, m.video_id) AS id, coalesce(v.title, 'untitled') AS title, coalesce(m.n, 0) AS n FROM videos v FULL OUTER JOIN (SELECT c.video_id, count(DISTINCT c.message_id) AS n FROM chat_messages c GROUP BY c.video_id) m ON m.video_id = v.id")

# Aggregates
both("a7_segment_counts", f"SELECT s.transcript_id, count(*) AS n, CAST(count_if(s.normalized_text IS NULL) AS BIGINT) AS unnormalized, CAST(count_if(s.end_ms <= s.start_ms) AS BIGINT) AS reversed FROM {SEG} s GROUP BY s.transcript_id")
both("a8_sectioning", f"SELECT s.transcript_id, max(s.end_ms) - min(s.start_ms) AS span_ms, CAST(sum(length(s.original_text)) AS BIGINT) AS chars, max(s.end_ms) - min(s.start_ms) >= 1200000 OR sum(length(s.original_text)) > 9000 AS sectioned FROM {SEG} s GROUP BY s.transcript_id")
both("a9_duration", f"SELECT s.transcript_id, CAST(floor(max(s.end_ms) / 1000) AS INT) AS seconds FROM {SEG} s GROUP BY s.transcript_id")
both("a15_best_of_group", "SELECT e.event_type, round(max(e.value), 6) AS best, round(avg(e.value), 6) AS mean FROM events e GROUP BY e.event_type")

# Ranks and orders
both("w1_dense_rank", "SELECT user_id, event_type, first_event, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first_event) AS BIGINT) AS rk FROM (SELECT e.user_id, e.event_type, min(e.event_id) AS first_event FROM events e GROUP BY e.user_id, e.event_type) f")
both("w2_enumeration", f"SELECT m.video_id, m.message_id, CAST(row_number() OVER (PARTITION BY m.video_id ORDER BY m.message_id) AS BIGINT) AS rk FROM {MSG} m")
both("t2_stable_top", "SELECT event_type, event_id, value FROM (SELECT e.event_type, e.event_id, e.value, row_number() OVER (PARTITION BY e.event_type ORDER BY e.value DESC, e.event_id) AS rk FROM events e) r WHERE rk <= 20")
both("t5_recent_videos", "SELECT v.id, v.updated_at FROM videos v ORDER BY v.updated_at DESC, v.id LIMIT 20")
both("t6_ordered_listing", f"SELECT s.transcript_id, s.sequence_number, s.id FROM {SEG} s ORDER BY s.transcript_id, s.sequence_number, s.id")
both("t10_arg_min", "SELECT t.video_id, min_by(t.id, concat(CASE WHEN t.transcript_type = 'manual' THEN '0' WHEN t.transcript_type = 'generated' THEN '1' ELSE '2' END, t.id)) AS chosen FROM transcripts t GROUP BY t.video_id")

# Sets
both("u1_bag_union", "SELECT t.id, 'transcript' AS kind FROM transcripts t UNION ALL SELECT i.id, 'version' FROM index_versions i UNION ALL SELECT v.id, 'video' FROM videos v")
both("u2_set_algebra", "(SELECT t.video_id FROM transcripts t INTERSECT SELECT m.video_id FROM chat_messages m) EXCEPT SELECT i.video_id FROM index_versions i WHERE i.status = 'failed'")
both("u3_subset", "SELECT e.user_id, count(DISTINCT CASE WHEN e.event_type IN ('view', 'click') THEN e.event_type END) = 2 AS has_all FROM events e GROUP BY e.user_id")

# Versions and jobs
both("s10_language_rank", "SELECT t.id, CASE WHEN lower(t.language_code) = 'vi' OR lower(t.language_code) LIKE 'vi-%' THEN 0 WHEN lower(t.language_code) = 'en' OR lower(t.language_code) LIKE 'en-%' THEN 1 ELSE 2 END AS rk FROM transcripts t")
both("s9_track_selection", "SELECT video_id, id FROM (SELECT t.video_id, t.id, row_number() OVER (PARTITION BY t.video_id ORDER BY CASE WHEN lower(t.language_code) = 'vi' OR lower(t.language_code) LIKE 'vi-%' THEN 0 WHEN lower(t.language_code) = 'en' OR lower(t.language_code) LIKE 'en-%' THEN 1 ELSE 2 END, CASE t.source_format WHEN 'vtt' THEN 0 WHEN 'srv3' THEN 1 ELSE 2 END, t.id) AS rk FROM transcripts t) r WHERE rk = 1")
both("s14_table_scan", "SELECT d.doc_id, d.lang, d.source, d.n_chars FROM documents d")


@query("j8_neighbours", f"WITH {S.SEGMENTS} SELECT a.id, b.id AS neighbour_id, b.sequence_number - a.sequence_number AS side FROM seg a JOIN seg b ON b.transcript_id = a.transcript_id AND abs(b.sequence_number - a.sequence_number) = 1")
def j8(spark, folder):
    """Each cue asks for the numbers beside its own, so that the join is on equal keys."""
    s = segments(spark, folder).select("id", "transcript_id", "sequence_number")
    wanted = s.select("id", F.col("transcript_id").alias("__t"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"), "sequence_number").withColumn("__n", F.col("sequence_number") + F.col("side")).drop("sequence_number")
    return wanted.join(s.withColumnRenamed("id", "neighbour_id"), (F.col("__t") == F.col("transcript_id")) & (F.col("__n") == F.col("sequence_number"))).select("id", "neighbour_id", "side")


@query("a6_interval_union", INTERVAL_SQL["p1_summary"])
def a6(spark, folder):
    return intervals.summary(segments(spark, folder))


@query(
    "pred6_ordered_fetch",
    "WITH m AS (SELECT DISTINCT message_id, sources FROM chat_messages) SELECT message_id, i - 1 AS pos, s.chunk_id AS chunk_id FROM (SELECT message_id, unnest(sources) AS s, generate_subscripts(sources, 1) AS i FROM m)",
)
def pred6(spark, folder):
    m = table(spark, folder, "chat_messages").dropDuplicates(["message_id"])
    return m.select("message_id", F.posexplode("sources").alias("pos", "s")).select("message_id", F.col("pos").cast("long").alias("pos"), "s.chunk_id")


@query(
    "pred7_pinned_sources",
    "WITH m AS (SELECT DISTINCT message_id, sources FROM chat_messages) SELECT message_id, i AS place, s.chunk_id AS chunk_id, 1.0::DOUBLE AS score FROM (SELECT message_id, unnest(sources) AS s, generate_subscripts(sources, 1) AS i FROM m) WHERE i <= 4",
)
def pred7(spark, folder):
    m = table(spark, folder, "chat_messages").dropDuplicates(["message_id"])
    first = m.select("message_id", F.posexplode(F.slice("sources", 1, 4)).alias("pos", "s"))
    return first.select("message_id", (F.col("pos") + 1).cast("long").alias("place"), "s.chunk_id", F.lit(1.0).alias("score"))


@query(
    "a16_first_occurrence",
    "WITH m AS (SELECT DISTINCT message_id, sources FROM chat_messages), x AS (SELECT message_id, s.chunk_id AS chunk_id, i FROM (SELECT message_id, unnest(sources) AS s, generate_subscripts(sources, 1) AS i FROM m)) SELECT message_id, chunk_id, min(i) AS pos FROM x GROUP BY ALL",
)
def a16(spark, folder):
    m = table(spark, folder, "chat_messages").dropDuplicates(["message_id"])
    return m.select("message_id", F.posexplode("sources").alias("pos", "s")).groupBy("message_id", F.col("s.chunk_id").alias("chunk_id")).agg((F.min("pos") + 1).cast("long").alias("pos"))


MINUTE = 60_000


def overlapping(spark, folder):
    """Pairs of cues of a transcript that overlap, by an equal join on the minutes they touch; kept in the first common one."""
    valid = segments(spark, folder).where("end_ms > start_ms").select("transcript_id", "id", "start_ms", "end_ms")
    spread = valid.withColumn("minute", F.explode(F.sequence(F.floor(F.col("start_ms") / MINUTE), F.floor((F.col("end_ms") - 1) / MINUTE))))
    a, b = spread.alias("a"), spread.alias("b")
    near = (F.col("a.transcript_id") == F.col("b.transcript_id")) & (F.col("a.minute") == F.col("b.minute")) & (F.col("a.id") < F.col("b.id"))
    both_ = (F.col("a.start_ms") < F.col("b.end_ms")) & (F.col("a.end_ms") > F.col("b.start_ms"))
    first = F.col("a.minute") == F.floor(F.greatest("a.start_ms", "b.start_ms") / MINUTE)
    return a.join(b, near & both_ & first).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), (F.least("a.end_ms", "b.end_ms") - F.greatest("a.start_ms", "b.start_ms")).alias("shared_ms"))


@query(
    "j4_interval_overlap",
    f"WITH {S.SEGMENTS}, v AS (SELECT * FROM seg WHERE end_ms > start_ms) SELECT a.id AS id_a, b.id AS id_b, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS shared_ms FROM v a JOIN v b ON a.transcript_id = b.transcript_id AND a.id < b.id AND a.start_ms < b.end_ms AND a.end_ms > b.start_ms",
)
def j4(spark, folder):
    return overlapping(spark, folder)


def at_sources(spark, folder, wide: bool):
    """Cues of a video under the sources of its messages: those that hold the start, or that overlap the range."""
    m = table(spark, folder, "chat_messages").dropDuplicates(["message_id"]).select("message_id", "video_id", F.explode("sources").alias("s"))
    ranges = m.select(F.col("video_id").alias("__v"), F.round(F.col("s.start_seconds") * 1000).cast("long").alias("a"), F.round(F.col("s.end_seconds") * 1000).cast("long").alias("b")).distinct()
    end = F.greatest(F.col("b") - 1, F.col("a")) if wide else F.col("a")
    ranges = ranges.withColumn("__m", F.explode(F.sequence(F.floor(F.col("a") / MINUTE), F.floor(end / MINUTE))))
    videos = table(spark, folder, "transcripts").select(F.col("id").alias("__t"), "video_id")
    cues = segments(spark, folder).where("end_ms > start_ms").join(videos, F.col("transcript_id") == F.col("__t"))
    spread = cues.select("video_id", "id", "start_ms", "end_ms", F.explode(F.sequence(F.floor(F.col("start_ms") / MINUTE), F.floor((F.col("end_ms") - 1) / MINUTE))).alias("minute"))
    holds = (F.col("start_ms") < F.col("b")) & (F.col("end_ms") > F.col("a")) if wide else (F.col("a") >= F.col("start_ms")) & (F.col("a") < F.col("end_ms"))
    hit = spread.join(ranges, (F.col("video_id") == F.col("__v")) & (F.col("minute") == F.col("__m")) & holds)
    return hit.select("video_id", F.col("a").alias("from_ms"), F.col("b").alias("to_ms"), "id").distinct()


_RANGES = f"WITH {S.SEGMENTS}, m AS (SELECT DISTINCT message_id, video_id, sources FROM chat_messages), r AS (SELECT DISTINCT video_id, CAST(round(s.start_seconds * 1000) AS BIGINT) AS a, CAST(round(s.end_seconds * 1000) AS BIGINT) AS b FROM (SELECT video_id, unnest(sources) AS s FROM m)), c AS (SELECT t.video_id, s.* FROM seg s JOIN transcripts t ON t.id = s.transcript_id WHERE end_ms > start_ms)"


@query("pred11_cue_at_time", _RANGES + "SELECT DISTINCT c.video_id, a AS from_ms, b AS to_ms, c.id FROM r JOIN c ON c.video_id = r.video_id AND a >= start_ms AND a < end_ms")
def pred11(spark, folder):
    return at_sources(spark, folder, False)


@query("j5_range_overlap", _RANGES + "SELECT DISTINCT c.video_id, a AS from_ms, b AS to_ms, c.id FROM r JOIN c ON c.video_id = r.video_id AND start_ms < b AND end_ms > a")
def j5(spark, folder):
    return at_sources(spark, folder, True)


def links(spark, folder, size, stride):
    """Which cues a window of words touches, by the words' positions."""
    words = F.size(F.filter(F.split(F.coalesce("original_text", F.lit("")), X.BLANKS), lambda w: w != ""))
    cues = segments(spark, folder).select("transcript_id", "sequence_number", "id", words.alias("n")).where("n > 0").withColumn("bucket", F.floor(F.col("sequence_number") / chunks.BUCKET))
    placed = before(cues, ["transcript_id"], "bucket", ["sequence_number", "id"], offset=("sum", F.col("n")))
    total = cues.groupBy(F.col("transcript_id").alias("__t")).agg(F.sum("n").alias("total"))
    known = placed.join(total, F.col("transcript_id") == F.col("__t"))
    last = F.ceil(F.greatest(F.col("total") - size, F.lit(0)) / stride)
    a, b = F.greatest(F.ceil((F.col("offset") - (size - 1)) / stride), F.lit(0)), F.least(F.floor((F.col("offset") + F.col("n") - 1) / stride), last)
    return known.where(a <= b).select("transcript_id", "id", F.explode(F.sequence(a, b)).alias("window"))


def _links_sql(name, size, stride):
    return f"""{name} AS (SELECT transcript_id, id, unnest(range(CAST(greatest(ceil((off - {size - 1}) / {stride}), 0) AS BIGINT), least(CAST((off + n - 1) // {stride} AS BIGINT), CAST(ceil(greatest(total - {size}, 0) / {stride}) AS BIGINT)) + 1)) AS "window" FROM o)"""


_OFFSETS = f"""{S.SEGMENTS}, cnt AS (SELECT transcript_id, sequence_number, id, len(regexp_extract_all(coalesce(original_text, ''), '[^{S.WS[1:-2]}]+')) AS n FROM seg),
  o AS (SELECT *, sum(n) OVER (PARTITION BY transcript_id ORDER BY sequence_number, id) - n AS off, sum(n) OVER (PARTITION BY transcript_id) AS total FROM cnt WHERE n > 0)"""


@query("a17_chunk_links", f"WITH {_OFFSETS}, {_links_sql('k', 140, 110)} SELECT transcript_id, \"window\", string_agg(id, ',' ORDER BY id) AS ids FROM k GROUP BY ALL")
def a17(spark, folder):
    return links(spark, folder, 140, 110).groupBy("transcript_id", "window").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))


@query(
    "j6_best_parent",
    f"""WITH {_OFFSETS}, {_links_sql('c', 140, 110)}, {_links_sql('p', 600, 600)}, s AS (SELECT c.transcript_id, c."window" AS child, p."window" AS parent, count(*) AS shared FROM c JOIN p USING (transcript_id, id) GROUP BY ALL)
    SELECT transcript_id, child, parent, shared FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, child ORDER BY shared DESC, parent) AS rk FROM s) WHERE rk = 1""",
)
def j6(spark, folder):
    c = links(spark, folder, 140, 110).withColumnRenamed("window", "child")
    p = links(spark, folder, 600, 600).select(F.col("transcript_id").alias("__t"), F.col("id").alias("__i"), F.col("window").alias("parent"))
    shared = c.join(p, (F.col("transcript_id") == F.col("__t")) & (F.col("id") == F.col("__i"))).groupBy("transcript_id", "child", "parent").agg(F.count("*").alias("shared"))
    best = shared.groupBy("transcript_id", "child").agg(F.max(F.struct("shared", (-F.col("parent")).alias("p"))).alias("b"))
    return best.select("transcript_id", "child", (-F.col("b.p")).alias("parent"), "b.shared")


@query("a18_limit_report", f"WITH {CHUNKS} SELECT chunk_id, CASE WHEN end_ms - start_ms > 75000 THEN 'duration' WHEN words > 130 THEN 'tokens' END AS reason FROM chunks WHERE end_ms - start_ms > 75000 OR words > 130")
def a18(spark, folder):
    long, many = F.col("end_ms") - F.col("start_ms") > 75000, F.col("words") > 130
    return chunked(spark, folder).where(long | many).select("chunk_id", F.when(long, "duration").when(many, "tokens").alias("reason"))


@query("a19_vector_checks", "SELECT count(*) AS n, min(len(embedding)) AS least, max(len(embedding)) AS most, CAST(count_if(len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS BIGINT) AS broken FROM embeddings")
def a19(spark, folder):
    bad = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return table(spark, folder, "embeddings").agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("least"), F.max(F.size("embedding")).cast("long").alias("most"), F.count_if(bad).alias("broken"))


@query("a13_percentiles", "WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, round(max(CASE WHEN i = CAST(round_even((n - 1) * 0.5, 0) AS BIGINT) THEN value END), 6) AS p50, round(max(CASE WHEN i = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT) THEN value END), 6) AS p95 FROM o GROUP BY 1")
def a13(spark, folder):
    """Nearest-rank percentiles by counts of values, so that no task holds a group's values."""
    counts = table(spark, folder, "events").where("value IS NOT NULL").groupBy("event_type", "value").agg(F.count("*").alias("c")).withColumn("bucket", F.floor(F.col("value")))
    placed = before(counts, ["event_type"], "bucket", ["value"], before=("sum", F.col("c")))
    total = counts.groupBy(F.col("event_type").alias("__e")).agg(F.sum("c").alias("n"))
    known = placed.join(total, F.col("event_type") == F.col("__e"))
    rank = lambda p: F.bround((F.col("n") - 1) * p).cast("long")
    pick = lambda p: F.round(F.max(F.when((F.col("before") <= rank(p)) & (rank(p) < F.col("before") + F.col("c")), F.col("value"))), 6)
    return known.groupBy("event_type").agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"))


@query(
    "w8_gap_runs",
    f"WITH {S.SEGMENTS}, l AS (SELECT id, transcript_id, sequence_number, start_ms, lag(end_ms) OVER (PARTITION BY transcript_id ORDER BY sequence_number, id) AS prev FROM seg WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL) SELECT id, sum(CASE WHEN start_ms - prev > 2500 THEN 1 ELSE 0 END) OVER (PARTITION BY transcript_id ORDER BY sequence_number, id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM l",
)
def w8(spark, folder):
    """Runs of cues without a gap of more than 2.5 s; each cue finds its predecessor by an equal join, runs are counted in buckets."""
    cues = segments(spark, folder).where("start_ms IS NOT NULL AND end_ms IS NOT NULL").select("id", "transcript_id", "sequence_number", "start_ms", "end_ms").withColumn("bucket", F.floor(F.col("sequence_number") / 2048))
    inside = Window.partitionBy("transcript_id", "bucket").orderBy("sequence_number", "id")
    ends = cues.groupBy("transcript_id", "bucket").agg(F.max_by("end_ms", F.struct("sequence_number", "id")).alias("tail"))
    tails = ends.select(F.col("transcript_id").alias("__t"), F.col("bucket").alias("__b"), F.lag("tail").over(Window.partitionBy("transcript_id").orderBy("bucket")).alias("tail"))
    known = cues.withColumn("__p", F.lag("end_ms").over(inside)).join(tails, (F.col("transcript_id") == F.col("__t")) & (F.col("bucket") == F.col("__b")))
    opened = known.select("id", "transcript_id", "sequence_number", "bucket", F.when(F.col("start_ms") - F.coalesce("__p", "tail") > 2500, 1).otherwise(0).alias("opens"))
    return before(opened, ["transcript_id"], "bucket", ["sequence_number", "id"], run=("sum", F.col("opens"))).select("id", (F.col("run") + F.col("opens")).cast("long").alias("run"))


@query("w21_text_offsets", f"WITH {S.SEGMENTS} SELECT id, CAST(sum(length(coalesce(original_text, '')) + 1) OVER (PARTITION BY transcript_id ORDER BY sequence_number, id) - length(coalesce(original_text, '')) - 1 AS BIGINT) AS off FROM seg")
def w21(spark, folder):
    cues = segments(spark, folder).select("id", "transcript_id", "sequence_number", (F.char_length(F.coalesce("original_text", F.lit(""))) + 1).alias("n")).withColumn("bucket", F.floor(F.col("sequence_number") / 2048))
    return before(cues, ["transcript_id"], "bucket", ["sequence_number", "id"], off=("sum", F.col("n"))).select("id", F.col("off").cast("long").alias("off"))


def sampled(spark, folder, wanted):
    """Chunks of each transcript at the places that ``wanted(n)`` gives, an array of 0-based windows."""
    c = chunked(spark, folder)
    n = c.groupBy(F.col("transcript_id").alias("__t")).agg(F.count("*").alias("n"))
    places = n.select("__t", F.explode(F.array_distinct(wanted(F.col("n")))).alias("__w"))
    return c.join(places, (F.col("transcript_id") == F.col("__t")) & (F.col("window") == F.col("__w"))).select("chunk_id")


@query("w13_timeline_sample", f"WITH {CHUNKS}, n AS (SELECT transcript_id, count(*) AS n FROM chunks GROUP BY 1), p AS (SELECT DISTINCT transcript_id, CASE WHEN n <= 8 THEN i ELSE CAST(round_even(i * ((n - 1) / 7.0::DOUBLE), 0) AS BIGINT) END AS w FROM n, range(8) r(i) WHERE i < n) SELECT chunk_id FROM chunks JOIN p ON p.transcript_id = chunks.transcript_id AND p.w = chunks.\"window\"")
def w13(spark, folder):
    return sampled(spark, folder, lambda n: F.when(n <= 8, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.bround(i * ((n - 1) / 7.0)).cast("long"))))


@query("w14_section_heads", f"WITH {CHUNKS}, n AS (SELECT transcript_id, count(*) AS n FROM chunks GROUP BY 1), p AS (SELECT DISTINCT transcript_id, unnest([i * n // 3, (i * n // 3 + (i + 1) * n // 3) // 2]) AS w FROM n, range(3) r(i)) SELECT DISTINCT chunk_id FROM chunks JOIN p ON p.transcript_id = chunks.transcript_id AND p.w = chunks.\"window\"")
def w14(spark, folder):
    third = lambda n, i: F.floor(i * n / 3)
    return sampled(spark, folder, lambda n: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.array(third(n, i), F.floor((third(n, i) + third(n, i + 1)) / 2)))))


@query("w12_merged_sections", f"WITH {CHUNKS}, n AS (SELECT transcript_id, count(*) AS n FROM chunks GROUP BY 1), b AS (SELECT transcript_id, i, CAST(round_even(i * (n / least(n, 4)::DOUBLE), 0) AS BIGINT) AS a, CAST(round_even((i + 1) * (n / least(n, 4)::DOUBLE), 0) AS BIGINT) AS z FROM n, range(4) r(i) WHERE i < least(n, 4)) SELECT chunk_id, i AS section FROM chunks JOIN b ON b.transcript_id = chunks.transcript_id AND chunks.\"window\" >= a AND chunks.\"window\" < z")
def w12(spark, folder):
    c = chunked(spark, folder)
    n = c.groupBy(F.col("transcript_id").alias("__t")).agg(F.count("*").alias("n"))
    step = F.col("n") / F.least("n", F.lit(4)).cast("double")
    bounds = n.select("__t", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(4)).cast("long") - 1)).alias("section"))
    spans = bounds.select("__t", "section", F.explode(F.sequence(F.bround(F.col("section") * step).cast("long"), F.bround((F.col("section") + 1) * step).cast("long") - 1)).alias("__w"))
    return c.join(spans, (F.col("transcript_id") == F.col("__t")) & (F.col("window") == F.col("__w"))).select("chunk_id", "section")


@query(
    "t8_term_rank",
    f"""WITH m AS (SELECT DISTINCT message_id, question, sources FROM chat_messages), x AS (SELECT message_id, list_distinct({S.tokens('question')}) AS q, s.chunk_id AS chunk_id, s.text AS text, i FROM (SELECT message_id, question, unnest(sources) AS s, generate_subscripts(sources, 1) AS i FROM m))
    SELECT message_id, chunk_id, row_number() OVER (PARTITION BY message_id ORDER BY len(list_intersect(q, list_distinct({S.tokens('text')}))) DESC, i) AS rk FROM x""",
)
def t8(spark, folder):
    m = table(spark, folder, "chat_messages").dropDuplicates(["message_id"])
    q = F.array_distinct(X.tokens(F.col("question")))
    per = F.transform("sources", lambda s, i: F.struct((-F.size(F.array_intersect(q, X.tokens(s["text"])))).alias("o"), i.alias("i"), s["chunk_id"].alias("chunk_id")))
    return m.select("message_id", F.posexplode(F.array_sort(per)).alias("rk", "x")).select("message_id", "x.chunk_id", (F.col("rk") + 1).cast("long").alias("rk"))


@query("g6_cooldown", "WITH l AS (SELECT event_type, max(ts) AS last_ts FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events) SELECT event_type, last_ts + INTERVAL 60 SECOND > now AS cooling FROM l, n")
def g6(spark, folder):
    per = table(spark, folder, "events").groupBy("event_type").agg(F.max("ts").alias("last_ts"))
    now = F.max("last_ts").over(Window.partitionBy())  # a row per type
    return per.select("event_type", (F.col("last_ts") + F.expr("INTERVAL 60 SECOND") > now).alias("cooling"))


@query("g9_sessions", "WITH l AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, count(*) AS n, CAST(date_diff('second', min(ts), max(ts)) AS BIGINT) AS seconds FROM s GROUP BY user_id, k")
def g9(spark, folder):
    e = table(spark, folder, "events").withColumn("t", F.col("ts").cast("timestamp"))
    per = e.groupBy("user_id", F.session_window("t", "30 minutes").alias("s")).agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    return per.select("user_id", "n", (F.unix_timestamp("b") - F.unix_timestamp("a")).alias("seconds"))


@query("d2_short_summary", f"WITH {CHUNKS} SELECT transcript_id, 'Summary:' || chr(10) || string_agg('- [' || {S.clock('start_ms / 1000.0')} || '] ' || {S.shorten('text', 150)}, chr(10) ORDER BY \"window\") AS summary FROM chunks WHERE \"window\" < 7 GROUP BY 1")
def d2(spark, folder):
    line = F.concat(F.lit("- ["), X.minutes_seconds(F.col("start_ms") / 1000), F.lit("] "), X.shorten(F.col("text"), 150))
    per = chunked(spark, folder).where("window < 7").groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("window", line.alias("line")))).alias("ls"))
    return per.select("transcript_id", F.concat(F.lit("Summary:\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("summary"))


@query("k9_markdown", "WITH m AS (SELECT DISTINCT message_id, video_id, question, answer, sources FROM chat_messages) SELECT message_id, '# Chat' || chr(10) || '**Q:** ' || question || chr(10) || '**A:** ' || coalesce(answer, '') || chr(10) || array_to_string(list_transform(sources, lambda s: '- [' || s.chunk_id || '](https://www.youtube.com/watch?v=' || video_id || '&t=' || CAST(greatest(CAST(floor(s.start_seconds) AS BIGINT), 0) AS VARCHAR) || 's)'), chr(10)) || chr(10) AS page FROM m")
def k9(spark, folder):
    m = table(spark, folder, "chat_messages").dropDuplicates(["message_id"])
    bullet = lambda s: F.concat(F.lit("- ["), s["chunk_id"], F.lit("]("), X.deep_link(F.col("video_id"), s["start_seconds"]), F.lit(")"))
    return m.select("message_id", F.concat(F.lit("# Chat\n**Q:** "), "question", F.lit("\n**A:** "), F.coalesce("answer", F.lit("")), F.lit("\n"), F.array_join(F.transform("sources", bullet), "\n"), F.lit("\n")).alias("page"))


@query(
    "w15_character_budget",
    None,
)
def w15(spark, folder):
    """Sources of a message in order while characters remain, each cut to what is left; 400 in all, 150 each."""
    m = table(spark, folder, "chat_messages").dropDuplicates(["message_id"])
    empty = F.array().cast("array<struct<chunk_id: string, text: string>>")

    def step(acc, s):
        room = F.least(F.lit(150), acc["left"])
        plain = X.squeeze(s["text"])
        cut = F.when(F.char_length(plain) <= room, plain).when(room <= 3, F.substr(plain, F.lit(1), room)).otherwise(F.concat(F.rtrim(F.substr(plain, F.lit(1), F.greatest(room - 3, F.lit(0)))), F.lit("...")))
        more = F.struct((acc["left"] - F.char_length(cut)).alias("left"), F.concat(acc["out"], F.array(F.struct(s["chunk_id"].alias("chunk_id"), cut.alias("text")))).alias("out"))
        return F.when(acc["left"] <= 0, acc).otherwise(more)

    folded = F.aggregate("sources", F.struct(F.lit(400).alias("left"), empty.alias("out")), step, lambda a: a["out"])
    return m.select("message_id", F.posexplode(folded).alias("place", "x")).select("message_id", "place", "x.chunk_id", "x.text")
