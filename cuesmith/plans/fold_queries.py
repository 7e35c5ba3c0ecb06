"""Queries of the sequential operators and the subtitle readers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from .. import api
from ..operators import folds, retrieval
from ..session import stored
from ..settings import ChunkerConfig
from ..sources import subtitles
from ..tables import table
from . import sqltext as S
from .retrieval_queries import CHUNKS, chunked, index, questions
from .scalar_queries import messages, segments

QUERIES, SQL = {}, {}


def query(name, sql):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def source_cues(spark, folder):
    return table(spark, folder, "source_segments").select("transcript_id", "sequence_number", "text", "start_ms", "end_ms").distinct()


def canonical(spark, folder):
    return segments(spark, folder).select("id", "transcript_id", "sequence_number", F.col("normalized_text").alias("text"), "start_ms", "end_ms")


@query("w4_segment_packing", None)
def w4(spark, folder):
    return folds.packed_segments(source_cues(spark, folder))


@query("w9_rolling_captions", None)
def w9(spark, folder):
    return folds.canonical_cues(source_cues(spark, folder))


@query("c1_normalized_transcript", None)
def c1(spark, folder):
    """Per transcript the counts, the duplicates removed and a hash of the canonical cues, cue hashes combined in order."""
    cues = folds.canonical_cues(source_cues(spark, folder))
    one = F.xxhash64("sequence_number", "start_ms", "end_ms", "normalized_text")
    return cues.groupBy("transcript_id").agg(F.count("*").alias("canonical_segment_count"), F.max("removed_so_far").alias("removed_duplicate_count"), F.bit_xor(one).alias("content_hash"))


# The sizes of the chunks that questions are asked of; smaller than the defaults, so that a short transcript has several.
SIZES = ChunkerConfig(child_target_tokens=160, child_max_tokens=200, child_overlap_tokens=24, parent_target_tokens=500, parent_max_tokens=700)


def hierarchy(spark, folder):
    return folds.hierarchical_chunks(canonical(spark, folder), SIZES)


@query("c2_hierarchical_chunks", None)
def c2(spark, folder):
    return hierarchy(spark, folder)


@query("w7_child_chunks", None)
def w7(spark, folder):
    return hierarchy(spark, folder).where("chunk_type = 'child'")


def _children(spark, folder):
    """Children with their parent and video, and the parents; the chunks are written once, where they are packed."""
    chunks = hierarchy(spark, folder)
    videos = table(spark, folder, "transcripts").select(F.col("id").alias("__v"), "video_id")
    child = folds.with_parents(chunks).join(videos, F.col("transcript_id") == F.col("__v")).drop("__v")
    return child, chunks.where("chunk_type = 'parent'").select(F.col("chunk_id").alias("parent_id"), "text", "start_ms", "end_ms")


@query("r16_index_rows", None)
def r16(spark, folder):
    """Rows of a rebuilt index: children with their parent, fingerprint and embedding."""
    from ..functions.embedding import embed

    child, _ = _children(spark, folder)
    return child.select("chunk_id", "parent_id", "transcript_id", F.sha2(F.concat_ws("\n", "transcript_id", "text"), 256).alias("fingerprint"), embed("text").alias("embedding"))


BLOCK = 100


def payloads(spark, folder, line, head: str, foot: str):
    """Payloads of up to ``BLOCK`` consecutive cues of a transcript, written by ``line``."""
    cues = source_cues(spark, folder).withColumn("clean", F.trim(F.regexp_replace(F.regexp_replace("text", X.BLANKS, " "), "[<>&]", ""))).where("clean <> '' AND start_ms >= 0 AND end_ms > start_ms")
    keyed = cues.withColumn("key", F.concat_ws("/", "transcript_id", F.floor(F.col("sequence_number") / BLOCK)))
    per = keyed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("sequence_number", line.alias("line")))).alias("ls"))
    return per.select("key", F.concat(F.lit(head), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit(foot)).alias("payload"))


def _clock(ms):
    two = lambda c, n: F.lpad(c.cast("string"), n, "0")
    hours = F.floor(ms / 3_600_000).cast("string")
    return F.concat(F.lpad(hours, F.greatest(F.length(hours), F.lit(2)), F.lit("0")), F.lit(":"), two(F.floor(ms / 60_000) % 60, 2), F.lit(":"), two(F.floor(ms / 1000) % 60, 2), F.lit("."), two(ms % 1000, 3))


READ = f"""WITH c AS (SELECT DISTINCT transcript_id, sequence_number, trim(regexp_replace(regexp_replace(text, '{S.WS}', ' ', 'g'), '[<>&]', '', 'g')) AS t, start_ms, end_ms FROM source_segments)
  SELECT transcript_id || '/' || CAST(sequence_number // {BLOCK} AS VARCHAR) AS key, {S.squeeze('t')} AS text, start_ms, end_ms FROM c WHERE t <> '' AND start_ms >= 0 AND end_ms > start_ms"""


@query("s2_parse_vtt", READ)
def s2(spark, folder):
    line = F.concat(_clock(F.col("start_ms")), F.lit(" --> "), _clock(F.col("end_ms")), F.lit("\n"), "clean", F.lit("\n"))
    return subtitles.parse_vtt(payloads(spark, folder, line, "WEBVTT\n\n", "\n"))


@query("s3_parse_ttml", READ)
def s3(spark, folder):
    line = F.concat(F.lit('<p begin="'), F.col("start_ms").cast("string"), F.lit('ms" dur="'), (F.col("end_ms") - F.col("start_ms")).cast("string"), F.lit('ms">'), "clean", F.lit("</p>"))
    return subtitles.parse_xml(payloads(spark, folder, line, '<tt xmlns="http://www.w3.org/ns/ttml"><body><div>', "</div></body></tt>"), "ttml").drop("error")


@query("s4_parse_srv3", READ)
def s4(spark, folder):
    line = F.concat(F.lit('<p t="'), F.col("start_ms").cast("string"), F.lit('" d="'), (F.col("end_ms") - F.col("start_ms")).cast("string"), F.lit('">'), "clean", F.lit("</p>"))
    return subtitles.parse_xml(payloads(spark, folder, line, "<timedtext><body>", "</body></timedtext>"), "srv3").drop("error")


_BARE = "regexp_replace(coalesce(text, ''), '<[^>]*>', '', 'g')"
for _name, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, '{_name}', '{_sign}')"


@query("s5_clean_markup", f"SELECT doc_id, {S.squeeze(_BARE)} AS cleaned FROM documents")
def s5(spark, folder):
    return table(spark, folder, "documents").select("doc_id", subtitles.clean_markup(F.coalesce("text", F.lit(""))).alias("cleaned"))


@query("s6_clock_time", "SELECT DISTINCT transcript_id, sequence_number, start_ms AS ms FROM source_segments WHERE start_ms >= 0")
def s6(spark, folder):
    cues = source_cues(spark, folder).where("start_ms >= 0")
    return cues.select("transcript_id", "sequence_number", subtitles.clock_ms(_clock(F.col("start_ms"))).alias("ms"))


@query("s7_video_identity", r"SELECT id, youtube_video_id AS video, CASE WHEN canonical_url IS NOT NULL THEN regexp_matches(trim(canonical_url), '^https?://') END AS web FROM videos")
def s7(spark, folder):
    v = table(spark, folder, "videos")
    found = subtitles.video_identity(F.col("canonical_url"))
    return v.select("id", F.coalesce(found["id"], "youtube_video_id").alias("video"), F.trim("canonical_url").rlike("^https?://").alias("web"))


_AT = f"'- [' || {S.clock('start_ms / 1000.0')} || '] ' || "


@query(
    "d4_study_notes",
    f"""WITH {CHUNKS} SELECT transcript_id, 'Key points:' || chr(10) || string_agg({_AT} ({S.shorten('text', 180)}), chr(10) ORDER BY "window") FILTER ("window" < 6)
      || chr(10) || chr(10) || 'See again:' || chr(10) || string_agg({_AT} ({S.shorten('text', 140)}), chr(10) ORDER BY "window") FILTER ("window" < 5) AS notes FROM chunks GROUP BY 1""",
)
def d4(spark, folder):
    """Key points and timestamps to see again for each transcript, from its first ten chunks."""
    c = chunked(spark, folder).where("window < 10")
    at = F.concat(F.lit("- ["), X.minutes_seconds(F.col("start_ms") / 1000), F.lit("] "))
    per = c.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("window", F.concat(at, X.shorten(F.col("text"), 180)).alias("long"), F.concat(at, X.shorten(F.col("text"), 140)).alias("short")))).alias("ls"))
    lines = lambda n, f: F.array_join(F.transform(F.slice("ls", 1, n), lambda x: x[f]), "\n")
    return per.select("transcript_id", F.concat(F.lit("Key points:\n"), lines(6, "long"), F.lit("\n\nSee again:\n"), lines(5, "short")).alias("notes"))


def at_places(c, wanted):
    """Chunks of each transcript at the windows ``wanted(n)``, an array, with their ``place`` from 1."""
    n = c.groupBy(F.col("transcript_id").alias("__t")).agg(F.count("*").alias("n"))
    at = n.select("__t", F.posexplode(F.array_sort(F.array_distinct(wanted(F.col("n"))))).alias("place", "__w"))
    return c.join(at, (F.col("transcript_id") == F.col("__t")) & (F.col("window") == F.col("__w"))).withColumn("place", F.col("place") + 1).drop("__t", "__w")


def spaced(n, k):
    """``k`` windows evenly over all ``n``, or all where there are no more."""
    some = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * ((n - 1) / (k - 1))).cast("long"))
    return F.when(n <= k, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(some)


def representative(n, k):
    """Like :func:`spaced`, but from 18 windows on the first and the middle one of each of up to six sections."""
    count = min(6, max(3, k // 2))
    start = lambda i: F.bround(i * n / count).cast("long")
    both = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.array(start(i), start(i) + F.floor((start(i + 1) - start(i)) / 2))))
    return F.when(n >= 18, F.slice(F.array_sort(F.array_distinct(both)), 1, k)).otherwise(spaced(n, k))


# Fixed value: the words by which notes rank key points.
NOTE_TERMS = ("main", "concepts", "key", "ideas")


@query("d4_timeline_notes", None)
def d4_timeline(spark, folder):
    """Notes, flashcards and a concept map of each transcript from chunks of its whole length.

    Key points are the six of the sample with most of the wanted words, in order of their number; chunks to see again and
    sections are the first of the sample.
    """
    c = chunked(spark, folder).select("transcript_id", "window", "text", "start_ms", "end_ms")
    clock = lambda ms: X.minutes_seconds(F.col(ms) / 1000)
    short = lambda n: X.shorten(F.col("text"), n)
    at, number = F.concat(F.lit("["), clock("start_ms"), F.lit("] ")), F.col("place").cast("string")
    shared = F.size(F.array_intersect(X.tokens(F.col("text")), F.array(*map(F.lit, NOTE_TERMS))))
    lines = F.struct(
        "place", F.concat(F.lit("- "), at, short(140)).alias("again"),
        F.concat(F.lit("- Part "), number, F.lit(" ("), clock("start_ms"), F.lit("-"), clock("end_ms"), F.lit("): "), short(150)).alias("part"),
        F.concat(number, F.lit(". "), F.rtrim(at), F.lit("\n   Q: What is the main idea here?\n   A: "), short(170)).alias("card"),
    )
    key = F.struct((-shared).alias("less"), "place", F.concat(F.lit("- "), at, short(180)).alias("point"))
    per = at_places(c, lambda n: representative(n, 12)).groupBy("transcript_id").agg(F.array_sort(F.collect_list(lines)).alias("ls"), F.array_sort(F.collect_list(key)).alias("keys"))
    show = lambda rows, n, f: F.array_join(F.transform(F.slice(rows, 1, n), lambda x: x[f]), "\n")
    parts = F.when(F.size("ls") >= 12, F.concat(F.lit("Parts:\n"), show("ls", 6, "part"), F.lit("\n\n"))).otherwise("")
    notes = F.concat(F.lit("Key points:\n"), show("keys", 6, "point"), F.lit("\n\n"), parts, F.lit("See again:\n"), show("ls", 5, "again"))
    branch = F.struct("place", F.concat(F.lit("- Topic "), number, F.lit(" "), F.rtrim(at), F.lit("\n  - Idea: "), short(160)).alias("branch"))
    topics = at_places(c, lambda n: representative(n, 16)).where("place <= 6").groupBy(F.col("transcript_id").alias("__t")).agg(F.array_sort(F.collect_list(branch)).alias("bs"))
    both = per.join(topics, F.col("transcript_id") == F.col("__t"))
    return both.select("transcript_id", notes.alias("notes"), F.concat(F.lit("Flashcards:\n"), show("ls", 6, "card")).alias("flashcards"), F.concat(F.lit("Concept map:\n"), show("bs", 6, "branch")).alias("concept_map"))


# Fixed value: how often the reference's player reads its position.
PLAYER_MS = 500


@query(
    "g8_playback_cues",
    f"WITH {S.SEGMENTS} SELECT transcript_id, u * 30000 AS position_ms, id FROM (SELECT *, unnest(range(CAST(ceil(start_ms / 30000) AS BIGINT), CAST(ceil(end_ms / 30000) AS BIGINT))) AS u FROM seg WHERE end_ms > start_ms)",
)
def g8(spark, folder):
    """The cue shown at each sampled playback position: every half minute of each transcript, by minute and range."""
    cues = segments(spark, folder).where("end_ms > start_ms").select("transcript_id", "id", "start_ms", "end_ms")
    spread = cues.withColumn("minute", F.explode(F.sequence(F.floor(F.col("start_ms") / 60_000), F.floor((F.col("end_ms") - 1) / 60_000))))
    at = F.explode(F.array(F.col("minute") * 60_000, F.col("minute") * 60_000 + 30_000))
    return spread.withColumn("position_ms", at).where("start_ms <= position_ms AND position_ms < end_ms").select("transcript_id", "position_ms", "id")


@query(
    "g8_playback_positions",
    f"WITH {S.SEGMENTS} SELECT transcript_id, u * 500 AS position_ms, id FROM (SELECT *, unnest(range(CAST(ceil(start_ms / 500) AS BIGINT), CAST(ceil(end_ms / 500) AS BIGINT))) AS u FROM seg WHERE end_ms > start_ms)",
)
def g8_positions(spark, folder):
    """The cue shown at each position that the player samples: every 500 ms of each transcript."""
    cues = segments(spark, folder).where("end_ms > start_ms").select("transcript_id", "id", "start_ms", "end_ms")
    first, last = F.ceil(F.col("start_ms") / PLAYER_MS), F.ceil(F.col("end_ms") / PLAYER_MS) - 1
    # A cue between two positions has none; sequence() would count down for it.
    at = cues.where(first <= last).withColumn("at", F.explode(F.sequence(first, last)))
    return at.select("transcript_id", (F.col("at") * PLAYER_MS).alias("position_ms"), "id")


@query("d3_merged_sections", f"WITH {CHUNKS} SELECT transcript_id, \"window\" // 4 AS section, string_agg({S.shorten('text', 350)}, chr(10) ORDER BY \"window\") AS text FROM chunks GROUP BY ALL")
def d3(spark, folder):
    c = chunked(spark, folder).withColumn("section", F.floor(F.col("window") / 4))
    per = c.groupBy("transcript_id", "section").agg(F.array_sort(F.collect_list(F.struct("window", X.shorten(F.col("text"), 350).alias("t")))).alias("ts"))
    return per.select("transcript_id", "section", F.array_join(F.transform("ts", lambda x: x["t"]), "\n").alias("text"))


def _asked(spark, folder):
    return questions(spark, folder).select("query_id", "video_id", "question")


def _found(spark, folder, mode):
    """Context and diagnostics over the child chunks of transcripts with an active version; a video without one gives none."""
    child, parents = _children(spark, folder)
    active = table(spark, folder, "index_versions").where("status = 'active'").select(F.col("transcript_id").alias("__a")).distinct()
    scope = stored(child.join(active, F.col("transcript_id") == F.col("__a"), "left_semi").withColumn("window", F.col("sequence_number")))
    return api.search(_asked(spark, folder), scope, mode, parents=parents)


@query("r10_search_context", None)
def r10(spark, folder):
    return _found(spark, folder, "hybrid")[0]


@query("r10_lexical_context", None)
def r10_lexical(spark, folder):
    return _found(spark, folder, "lexical")[0]


@query("r10_dense_context", None)
def r10_dense(spark, folder):
    return _found(spark, folder, "dense")[0]


@query("r9_reranked_context", None)
def r9(spark, folder):
    return _found(spark, folder, "reranked")[0]


@query("r14_search_diagnostics", None)
def r14(spark, folder):
    """The four best candidates of each question with the rank in each list, and the time of the search."""
    at = index(spark, folder)
    found, ms = api.debug(_asked(spark, folder), at.chunks, "hybrid", 4, postings=at.postings, vectors=at.vectors)
    return found.withColumn("latency_ms", F.lit(ms))


@query("d11_ask_lexical", None)
def d11_lexical(spark, folder):
    """Answers in the lexical mode, whose scores reach the gate's threshold."""
    at = index(spark, folder)
    return api.ask(_asked(spark, folder), at.chunks, "lexical", groundedness=0.0, postings=at.postings)


@query("d11_ask", None)
def d11(spark, folder):
    at = index(spark, folder)
    return api.ask(_asked(spark, folder), at.chunks, postings=at.postings, vectors=at.vectors)


@query("f23_feature_hash", None)
def f23(spark, folder):
    from ..functions.embedding import hash_features

    words = messages(spark, folder).select(F.explode(X.tokens(F.col("question"))).alias("word")).distinct()
    return words.select("word", hash_features("word").alias("h")).select("word", "h.bucket", "h.sign")


@query("w18_split_units", None)
def w18(spark, folder):
    from ..operators.folds import split_units

    return segments(spark, folder).where("original_text IS NOT NULL").select("id", F.posexplode(split_units("original_text")).alias("place", "unit"))


