"""Queries of stores, jobs, publication and evaluation records, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import jobs
from ..operators.store import TableStore
from ..session import checkpoint_folder
from ..tables import table
from . import sqltext as S
from .scalar_queries import messages, segments

QUERIES, SQL = {}, {}


def query(name, sql):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def store(spark):
    """A store of its own in the shared folder."""
    return TableStore(spark, f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}")


def read(spark, folder, name, *columns):
    df = table(spark, folder, name)
    return df.select(*columns) if columns else df


# Writes


@query("k1_written_table", "SELECT id, title, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status FROM videos")
def k1(spark, folder):
    """A table written and then rewritten as a whole from what was read of it."""
    s = store(spark)
    with s.transaction() as tx:
        tx.rewrite("videos", read(spark, folder, "videos", "id", "title", "status"))
    with s.transaction() as tx:
        tx.rewrite("videos", s.read("videos").withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status"))))
    return s.read("videos")


@query("k2_appended_rows", f"WITH {S.SEGMENTS} SELECT id, transcript_id, sequence_number FROM seg")
def k2(spark, folder):
    """Segments appended in two deliveries that overlap; re-delivered rows count once."""
    rows = table(spark, folder, "transcript_segments").select("id", "transcript_id", "sequence_number")
    s = store(spark)
    for part in ("sequence_number < 40", "sequence_number >= 20"):
        with s.transaction() as tx:
            tx.append("segments", rows.where(part), "id")
    return s.read("segments")


_SPLIT = "message_id < '8'"


@query(
    "k3_upsert",
    f"""WITH m AS (SELECT DISTINCT message_id, video_id, question, answer, created_at FROM chat_messages),
      r AS (SELECT *, {_SPLIT} AS old, row_number() OVER (PARTITION BY video_id, question, {_SPLIT} ORDER BY created_at DESC, message_id DESC) AS k FROM m),
      o AS (SELECT * FROM r WHERE old AND k = 1), n AS (SELECT * FROM r WHERE NOT old AND k = 1)
    SELECT coalesce(n.video_id, o.video_id) AS video_id, coalesce(n.question, o.question) AS question, CASE WHEN n.message_id IS NULL THEN o.answer ELSE n.answer END AS answer,
      coalesce(o.created_at, n.created_at) AS created_at,
      CASE WHEN n.message_id IS NULL THEN o.created_at WHEN o.message_id IS NULL OR n.created_at > o.created_at THEN n.created_at ELSE o.created_at + INTERVAL 1 MICROSECOND END AS updated_at
    FROM o FULL JOIN n ON o.video_id = n.video_id AND o.question = n.question""",
)
def k3(spark, folder):
    """The last answer to each question, from two deliveries: the second keeps the first's creation and gets a later stamp."""
    m = read(spark, folder, "chat_messages", "message_id", "video_id", "question", "answer", "created_at").distinct()
    last = lambda df: df.groupBy("video_id", "question").agg(F.max(F.struct("created_at", "message_id", "answer")).alias("x")).select("video_id", "question", "x.answer", F.col("x.created_at").alias("now"))
    s = store(spark)
    for part in (_SPLIT, f"NOT {_SPLIT}"):
        with s.transaction() as tx:
            tx.upsert("answers", last(m.where(part)), ["video_id", "question"], "now")
    return s.read("answers")


@query(
    "k4_replace_partition",
    f"WITH {S.SEGMENTS}, b AS (SELECT DISTINCT transcript_id FROM index_versions WHERE status = 'retired') SELECT id, transcript_id, CASE WHEN transcript_id IN (FROM b) THEN normalized_text ELSE original_text END AS text FROM seg",
)
def k4(spark, folder):
    """Texts by transcript, those of transcripts with a retired version replaced by the normalized ones."""
    again = read(spark, folder, "index_versions").where("status = 'retired'").select(F.col("transcript_id").alias("__t")).distinct()
    rows = segments(spark, folder)
    s = store(spark)
    with s.transaction() as tx:
        tx.rewrite("texts", rows.select("id", "transcript_id", F.col("original_text").alias("text")))
    with s.transaction() as tx:
        tx.replace("texts", "transcript_id", rows.join(again, F.col("transcript_id") == F.col("__t")).select("id", "transcript_id", F.col("normalized_text").alias("text")))
    return s.read("texts")


_CASCADE = [("videos", "id"), ("transcripts", "video_id"), ("index_versions", "video_id"), ("chat_messages", "video_id"), ("documents", "video_id")]


@query(
    "k5_cascade_delete",
    "WITH g AS (SELECT id FROM videos WHERE channel_title IS NULL) "
    + " UNION ALL ".join(
        f"SELECT '{t}' AS store, count(*) FILTER (WHERE {c} IN (FROM g)) AS deleted, count(*) FILTER (WHERE {c} IS NULL OR {c} NOT IN (FROM g)) AS kept FROM {t}" for t, c in _CASCADE
    ),
)
def k5(spark, folder):
    """Videos without a channel are deleted from five stores in one transaction."""
    s = store(spark)
    with s.transaction() as tx:
        for name, column in _CASCADE:
            tx.rewrite(name, read(spark, folder, name, column))
    gone = read(spark, folder, "videos").where("channel_title IS NULL").select("id")
    with s.transaction() as tx:
        counts = tx.cascade(_CASCADE, gone)
    left = [s.read(name).agg(F.lit(name).alias("store"), F.lit(counts[name]).cast("long").alias("deleted"), F.count("*").alias("kept")) for name, _ in _CASCADE]
    out = left[0]
    for one in left[1:]:
        out = out.unionByName(one)
    return out


@query("k6_vector_collections", "SELECT label, vec_id, len(embedding) AS dimension FROM embeddings WHERE label <> (SELECT max(label) FROM embeddings)")
def k6(spark, folder):
    """A collection of vectors for each label, its ids upserted twice, and the last label's collection dropped."""
    rows = read(spark, folder, "embeddings", "label", "vec_id", "embedding")
    labels = [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]  # few: one for each collection
    s = store(spark)
    with s.transaction() as tx:
        for label in labels:
            tx.rewrite(f"vectors-{label}", rows.where((F.col("label") == label) & (F.col("vec_id") % 2 == 0)))
    with s.transaction() as tx:
        for label in labels:
            tx.replace(f"vectors-{label}", "vec_id", rows.where(F.col("label") == label))
        tx.drop(f"vectors-{labels[-1]}")
    kept = None
    for label in labels[:-1]:
        one = s.read(f"vectors-{label}")
        kept = one if kept is None else kept.unionByName(one)
    return kept.select("label", "vec_id", F.size("embedding").cast("long").alias("dimension"))


@query("k12_newest_first", "WITH m AS (SELECT message_id, video_id, max(created_at) AS created_at FROM chat_messages GROUP BY ALL) SELECT video_id, message_id, created_at, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, message_id) AS place FROM m")
def k12(spark, folder):
    """The log of messages, appended in two deliveries and listed newest first within each video."""
    m = read(spark, folder, "chat_messages").groupBy("message_id", "video_id").agg(F.max("created_at").alias("created_at"))
    s = store(spark)
    for part in (_SPLIT, f"NOT {_SPLIT}"):
        with s.transaction() as tx:
            tx.append("log", m.where(part), "message_id")
    return s.read("log").withColumn("place", F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("created_at").desc(), "message_id")).cast("long")).select("video_id", "message_id", "created_at", "place")


# Jobs

_COMMANDS = """SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'retry' END WHEN 'view' THEN 'advance' WHEN 'click' THEN 'advance' WHEN 'purchase' THEN 'succeed' ELSE CASE WHEN event_id % 5 = 0 THEN 'cancel' ELSE 'fail' END END AS command,
  CASE WHEN event_type IN ('view', 'click') THEN 2 + event_id % 6 END AS target, event_id % 3 > 0 AS can_retry FROM events"""


@query(
    "g1_state_machine",
    f"""WITH RECURSIVE c AS ({_COMMANDS}), o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS n FROM c),
    s(job_id, n, event_id, command, status_before, stage_before, status, stage, retryable, legal) AS (
      SELECT DISTINCT job_id, 0::BIGINT, 0::BIGINT, '', '', 0::BIGINT, 'pending', 0::BIGINT, false, true FROM o
      UNION ALL
      SELECT job_id, n, event_id, command, was, spot, CASE WHEN ok THEN next ELSE was END,
        CASE WHEN NOT ok THEN spot WHEN command = 'start' THEN 1 WHEN command = 'advance' THEN target WHEN command = 'succeed' THEN 8 WHEN command = 'retry' THEN 0 ELSE spot END,
        CASE WHEN NOT ok THEN r WHEN command = 'fail' THEN can_retry WHEN command = 'advance' THEN r ELSE false END, ok
      FROM (
        SELECT o.*, s.status AS was, s.stage AS spot, s.retryable AS r,
          CASE o.command WHEN 'start' THEN s.status = 'pending' WHEN 'advance' THEN s.status = 'running' AND target > s.stage WHEN 'succeed' THEN s.status = 'running' AND s.stage = 7
            WHEN 'retry' THEN s.status = 'failed' AND s.retryable ELSE s.status IN ('pending', 'running') END AS ok,
          CASE o.command WHEN 'start' THEN 'running' WHEN 'advance' THEN 'running' WHEN 'succeed' THEN 'ready' WHEN 'retry' THEN 'pending' WHEN 'fail' THEN 'failed' ELSE 'cancelled' END AS next
        FROM s JOIN o ON o.job_id = s.job_id AND o.n = s.n + 1)
    ), names AS (SELECT unnest(range(9)) AS i, unnest(['pending', 'fetching_metadata', 'fetching_transcript', 'normalizing', 'validating', 'chunking', 'embedding', 'committing', 'complete']) AS name)
    SELECT job_id, event_id, command, status_before, b.name AS stage_before, status, a.name AS stage, retryable, legal FROM s JOIN names a ON a.i = s.stage JOIN names b ON b.i = s.stage_before WHERE n > 0""",
)
def g1(spark, folder):
    """A log of commands made of the events, one job a user, replayed through the state machine."""
    e = table(spark, folder, "events")
    kind, n = F.col("event_type"), F.col("event_id")
    command = F.when(kind == "signup", F.when(n % 2 == 0, "start").otherwise("retry")).when(kind.isin("view", "click"), "advance").when(kind == "purchase", "succeed").otherwise(F.when(n % 5 == 0, "cancel").otherwise("fail"))
    stage = F.when(kind.isin("view", "click"), F.get(F.array(*map(F.lit, jobs.STAGES)), (2 + n % 6).cast("int")))
    return jobs.replayed(e.select(F.col("user_id").alias("job_id"), "event_id", "ts", command.alias("command"), stage.alias("argument"), (n % 3 > 0).alias("retryable")))


@query("g2_idempotent_create", "WITH k AS (SELECT id, created_at, sha256(video_id || chr(10) || fingerprint) AS idempotency_key FROM index_versions) SELECT id, idempotency_key, first_value(id) OVER w AS job_id, row_number() OVER w > 1 AS reused FROM k WINDOW w AS (PARTITION BY idempotency_key ORDER BY created_at, id)")
def g2(spark, folder):
    """Requests with the same video and fingerprint get the job of the first of them."""
    k = read(spark, folder, "index_versions").select("id", "created_at", F.sha2(F.concat_ws("\n", "video_id", "fingerprint"), 256).alias("idempotency_key"))
    first = k.groupBy(F.col("idempotency_key").alias("__k")).agg(F.min_by("id", F.struct("created_at", "id")).alias("job_id"))
    return k.join(first, F.col("idempotency_key") == F.col("__k")).select("id", "idempotency_key", "job_id", (F.col("id") != F.col("job_id")).alias("reused"))


@query("g3_crash_recovery", "SELECT 'version' AS kind, id, CASE status WHEN 'building' THEN 'failed' ELSE status END AS status, CASE status WHEN 'building' THEN 'INTERRUPTED' END AS error_code, status = 'building' AS retryable FROM index_versions UNION ALL SELECT 'video', id, replace(status, 'processing', 'failed'), NULL, false FROM videos")
def g3(spark, folder):
    a, b = jobs.recovered(table(spark, folder, "index_versions"), table(spark, folder, "videos"))
    return a.select(F.lit("version").alias("kind"), "*").unionByName(b.select(F.lit("video").alias("kind"), "*", F.lit(None).cast("string").alias("error_code"), F.lit(False).alias("retryable")))


@query("g10_retry", "WITH l AS (SELECT video_id, arg_max(status, (created_at, id)) AS status FROM index_versions GROUP BY 1) SELECT v.id, CASE WHEN v.status = 'failed' AND coalesce(l.status, 'failed') <> 'active' THEN 'pending' ELSE v.status END AS status, v.status = 'failed' AND coalesce(l.status, 'failed') <> 'active' AS resubmitted FROM videos v LEFT JOIN l ON l.video_id = v.id")
def g10(spark, folder):
    """A retry puts failed videos whose newest version is not active back to pending and submits them again."""
    newest = read(spark, folder, "index_versions").groupBy(F.col("video_id").alias("__v")).agg(F.max_by("status", F.struct("created_at", "id")).alias("last"))
    v = table(spark, folder, "videos").select("id", "status").join(newest, F.col("id") == F.col("__v"), "left")
    again = (F.col("status") == "failed") & (F.coalesce("last", F.lit("failed")) != "active")
    return v.select("id", F.when(again, "pending").otherwise(F.col("status")).alias("status"), again.alias("resubmitted"))


@query("r17_activation", """WITH t AS (SELECT transcript_id, max(id) AS target FROM index_versions WHERE status IN ('building', 'active') AND (transcript_id, created_at) IN (SELECT transcript_id, max(created_at) FROM index_versions WHERE status IN ('building', 'active') GROUP BY 1) GROUP BY 1)
    SELECT i.id, i.transcript_id, CASE WHEN t.target IS NULL THEN i.status WHEN i.id = t.target THEN 'active' WHEN i.status = 'active' THEN 'retired' ELSE i.status END AS status FROM index_versions i LEFT JOIN t USING (transcript_id)""")
def r17(spark, folder):
    """The newest version of each transcript that is active or being built is activated."""
    v = table(spark, folder, "index_versions").select("id", "transcript_id", "status", "created_at")
    newest = v.where("status IN ('building', 'active')").groupBy("transcript_id").agg(F.max(F.struct("created_at", "id")).alias("x")).select("x.id")
    return jobs.activated(v, newest)


@query("g11_attempt_report", r"""WITH m AS (SELECT DISTINCT message_id, generation, question, retrieval_mode FROM chat_messages)
    SELECT message_id, generation.provider AS provider, CASE WHEN generation.fallback_reason IS NULL THEN 'succeeded' ELSE 'failed' END AS outcome, upper(generation.fallback_reason) AS error_code,
      CASE WHEN generation.fallback_reason IS NOT NULL THEN substr(regexp_replace(trim(regexp_replace(generation.fallback_reason || ' at https://host/' || retrieval_mode || ' token=' || message_id, '\s+', ' ', 'g')), 'https?://[^ ]+|\btoken=[^ ,;]+', '', 'g'), 1, 300) END AS shown,
      CAST(length(question) AS BIGINT) AS elapsed_ms FROM m""")
def g11(spark, folder):
    """Attempts to answer with their outcome; addresses and secrets are out of the message."""
    m = table(spark, folder, "chat_messages").select("message_id", "generation", "question", "retrieval_mode").dropDuplicates(["message_id"])
    why = F.col("generation.fallback_reason")
    said = X.redact(F.concat(why, F.lit(" at https://host/"), "retrieval_mode", F.lit(" token="), "message_id"))
    bare = F.replace(F.replace(said, F.lit("[redacted-url]"), F.lit("")), F.lit("token=[redacted]"), F.lit(""))
    return m.select("message_id", "generation.provider", F.when(why.isNull(), "succeeded").otherwise("failed").alias("outcome"), F.upper(why).alias("error_code"), bare.alias("shown"), F.char_length("question").cast("long").alias("elapsed_ms"))


@query("g11_error_rollup", "WITH m AS (SELECT DISTINCT message_id, video_id, generation FROM chat_messages) SELECT video_id, count(*) AS attempts, count(generation.fallback_reason) AS failures, CASE WHEN count(generation.fallback_reason) < count(*) THEN NULL WHEN bool_or(generation.fallback_reason = 'timeout') THEN 'TIMEOUT' ELSE 'NO_MODEL' END AS final_error FROM m GROUP BY 1")
def g11_rollup(spark, folder):
    """What is left of a video's attempts: no error after a success, else the retryable one before the others."""
    m = table(spark, folder, "chat_messages").select("message_id", "video_id", "generation").dropDuplicates(["message_id"])
    why = F.col("generation.fallback_reason")
    per = m.groupBy("video_id").agg(F.count("*").alias("attempts"), F.count(why).alias("failures"), F.min(F.struct((why != "timeout").alias("later"), F.upper(why).alias("code"))).alias("worst"))
    return per.select("video_id", "attempts", "failures", F.when(F.col("failures") == F.col("attempts"), F.col("worst.code")).alias("final_error"))


@query("g12_component_health", "WITH c AS (SELECT 'canonical' AS component, (SELECT count(*) FROM transcripts WHERE is_active) > 0 AS available UNION ALL SELECT 'vectors', (SELECT count(*) > 0 AND min(len(embedding)) = max(len(embedding)) FROM embeddings) UNION ALL SELECT 'llm', (SELECT count(*) FILTER (WHERE generation.generation_mode = 'llm') > 0 FROM chat_messages)) SELECT component, available, bool_and(available) OVER () AS operational FROM c")
def g12(spark, folder):
    """Probes of the canonical tables, the vectors and the model's answers; operational if all are there."""
    probe = lambda df, name, ok: df.agg(ok.alias("available")).select(F.lit(name).alias("component"), "available")
    rows = probe(table(spark, folder, "transcripts").where("is_active"), "canonical", F.count("*") > 0)
    rows = rows.unionByName(probe(table(spark, folder, "embeddings"), "vectors", (F.count("*") > 0) & (F.min(F.size("embedding")) == F.max(F.size("embedding")))))
    rows = rows.unionByName(probe(table(spark, folder, "chat_messages").where("generation.generation_mode = 'llm'"), "llm", F.count("*") > 0))
    return rows.withColumn("operational", F.bool_and("available").over(Window.partitionBy()))  # three rows


# Stable codes of failures and their HTTP status.
STATUS = {"INVALID_URL": 400, "NOT_FOUND": 404, "ILLEGAL_TRANSITION": 409, "PROVIDER_UNAVAILABLE": 503}


@query("g13_failure_status", """WITH f AS (SELECT 'INVALID_URL' AS code, id FROM videos WHERE canonical_url IS NULL OR NOT regexp_matches(canonical_url, '^https?://')
      UNION ALL SELECT DISTINCT 'NOT_FOUND', message_id FROM chat_messages m WHERE NOT EXISTS (SELECT 1 FROM videos v WHERE v.id = m.video_id AND v.status = 'ready')
      UNION ALL SELECT 'ILLEGAL_TRANSITION', id FROM index_versions WHERE status IN ('active', 'retired', 'failed') AND activated_at IS NULL
      UNION ALL SELECT DISTINCT 'PROVIDER_UNAVAILABLE', message_id FROM chat_messages WHERE generation.fallback_reason IS NOT NULL)
    SELECT code, id, CASE code WHEN 'INVALID_URL' THEN 400 WHEN 'NOT_FOUND' THEN 404 WHEN 'ILLEGAL_TRANSITION' THEN 409 ELSE 503 END AS status FROM f""")
def g13(spark, folder):
    """Requests that fail, each with its code and status: bad addresses, videos that are not there, moves out of order, no model."""
    videos, m, v = (table(spark, folder, t) for t in ("videos", "chat_messages", "index_versions"))
    ready = videos.where("status = 'ready'").select(F.col("id").alias("__v"))
    cases = [
        ("INVALID_URL", videos.where("canonical_url IS NULL OR NOT canonical_url RLIKE '^https?://'").select("id")),
        ("NOT_FOUND", m.join(ready, F.col("video_id") == F.col("__v"), "left_anti").select(F.col("message_id").alias("id")).distinct()),
        ("ILLEGAL_TRANSITION", v.where("status IN ('active', 'retired', 'failed') AND activated_at IS NULL").select("id")),
        ("PROVIDER_UNAVAILABLE", m.where("generation.fallback_reason IS NOT NULL").select(F.col("message_id").alias("id")).distinct()),
    ]
    out = None
    for code, rows in cases:
        one = rows.select(F.lit(code).alias("code"), "id", F.lit(STATUS[code]).alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "c5_publication",
    """WITH t AS (SELECT *, id >= '8' AS incoming FROM transcripts WHERE video_id IS NOT NULL),
      m AS (SELECT t.id, t.video_id, t.incoming, min(o.id) AS same FROM t LEFT JOIN t o ON NOT o.incoming AND o.video_id = t.video_id AND o.provider = t.provider AND o.content_hash = t.content_hash AND o.parser_version = t.parser_version AND o.normalizer_version IS NOT DISTINCT FROM t.normalizer_version GROUP BY ALL),
      n AS (SELECT video_id, max(coalesce(same, id)) AS target FROM m WHERE incoming GROUP BY 1)
    SELECT m.id, CASE WHEN m.incoming THEN coalesce(m.same, m.id) ELSE m.id END AS published_id, m.incoming AND m.same IS NULL AS is_new, coalesce(n.target = m.id, t.is_active) AS is_active
    FROM m JOIN t USING (id) LEFT JOIN n ON n.video_id = m.video_id""",
)
def c5(spark, folder):
    """One half of the transcripts, by their ids, is published on the other: a version with the same five keys is used again, another
    one is new, and the last one published of a video becomes its active one."""
    t = table(spark, folder, "transcripts").where("video_id IS NOT NULL").select("id", "video_id", "provider", "content_hash", "parser_version", "normalizer_version", "is_active")
    t = t.withColumn("incoming", F.col("id") >= "8")
    keys = ["video_id", "provider", "content_hash", "parser_version", "normalizer_version"]
    old = t.where("NOT incoming").groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min("id").alias("same"))
    m = t.join(old, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*[f"__{k}" for k in keys])
    n = m.where("incoming").groupBy(F.col("video_id").alias("__v")).agg(F.max(F.coalesce("same", "id")).alias("target"))
    both = m.join(n, F.col("video_id") == F.col("__v"), "left")
    return both.select("id", F.when(F.col("incoming"), F.coalesce("same", "id")).otherwise(F.col("id")).alias("published_id"), (F.col("incoming") & F.col("same").isNull()).alias("is_new"), F.coalesce(F.col("target") == F.col("id"), "is_active").alias("is_active"))
