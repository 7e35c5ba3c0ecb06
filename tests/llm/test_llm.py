import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesmith.llm import garbled, languages, lookalikes, mixing, pairs, repeats, splitting, streams, tokenizing, turns

TABLES = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{TABLES}/{name}.parquet")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def empty(spark, name):
    return table(spark, name).where("false")


# Splitting


def check_pieces(text, limit, overlap):
    words = [text[a:b] for a, b in splitting.boundaries(text)[0]]
    got = splitting.pieces_of(text, limit, overlap)
    overlap = min(overlap, limit - 1)
    assert got[0][0] == 0 and got[-1][1] == len(words) - 1
    for (a, b, piece, _), after in zip(got, got[1:] + [None]):
        assert b - a + 1 <= limit
        assert [piece[x:y] for x, y in splitting.boundaries(piece)[0]] == words[a : b + 1]
        if after:
            assert after[0] == b + 1 - overlap


@pytest.mark.parametrize("seed", range(30))
def test_pieces_lose_no_word_and_share_the_overlap(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice(("a", "bc", "d.", "e,", "f!”", "x​y", "9")) + rnd.choice((" ", "  ", "\n", " ", "　", " \t")) for _ in range(rnd.randrange(1, 200)))
    check_pieces(text, rnd.randrange(1, 20), rnd.randrange(0, 25))


def test_cuts_prefer_sentences_then_clauses_then_none():
    assert [x[3] for x in splitting.pieces_of("a b. c d, e f g h i j k", 4, 0)] == ["sentence", "clause", "hard", "end"]


def test_a_very_long_text_is_split():
    check_pieces("word " * 200_000, 200, 24)


def test_split_cases(spark):
    config = "struct<child_target_tokens: int, child_max_tokens: int, child_overlap_tokens: int>"
    cues = spark.createDataFrame(
        [("1", "t", "a b c d e", None, None, "x"), ("1", "t", "a b c d e", None, None, "x"), ("2", "t", "a b c", 1, 2, "x"), ("3", "t", None, 1, 2, "x"), ("4", "no", "a b c d e", 1, 2, "x"), ("5", "t", "", 1, 2, "x"), ("6", "t", "a​b c d", 1, 2, "x")],
        "id string, transcript_id string, normalized_text string, start_ms bigint, end_ms bigint, child_max string",
    )
    versions = spark.createDataFrame([("2", "t", "active", (9, 9, None), None, 1), ("1", "t", "active", (9, 3, None), None, 1), ("3", "no", "retired", (9, 1, 1), None, 1)], f"id string, transcript_id string, status string, chunker_config {config}, activated_at timestamp_ntz, tokens int")
    got = rows(splitting.split_oversized(cues, versions).select("segment_id", "piece_number", "text", "start_ms"))
    assert got == [("1", 0, "a b c", None), ("1", 1, "d e", None)]
    assert splitting.split_oversized(cues.where("false"), versions.where("false")).count() == 0


# Look-alikes


def test_lookalike_pairs(spark):
    same = ["Die Straße é ok", "Die  Straße é ok ", "Die Straße é ok", "Ｄie Straße é ok", "Diе Strаße é​ ok"]
    other = ["die Straße é ok", "Die Straße e ok", "Die Straße é ok.", "Die Straße é ok²", "Die Straße &eacute; ok", "a b", "ab"]
    data = [(f"s{i}", "t", x, "c") for i, x in enumerate(same)] + [(f"o{i}", "t", x, "c") for i, x in enumerate(other)]
    data += [("s0", "t", same[0], "c"), ("u", "u", same[1], "c"), ("n1", "t", None, "c"), ("n2", "t", None, "c"), ("c1", "t", same[0], "c"), ("f1", "t", "ﬁn", "c"), ("f2", "t", "fin", "c"), ("e1", "t", "", "c"), ("e2", "t", " ​", "c")]
    df = spark.createDataFrame(data, "id string, transcript_id string, original_text string, form string")
    texts = {i: x for i, t, x, _ in data if t == "t" and x is not None}
    alike = [[i for i in texts if i[0] in "s" or i == "c1"], ["f1", "f2"], ["e1", "e2"]]
    want = sorted((a, b) for group in alike for a in group for b in group if a < b and texts[a] != texts[b])
    assert rows(lookalikes.lookalike_pairs(df)) == want
    assert rows(lookalikes.lookalike_pairs(df.where("false"))) == []


def test_forms_keep_nulls_and_extra_columns_aside(spark):
    df = spark.createDataFrame([("a", "ｘ y", None, 1), ("b", None, None, 1), (None, "x", "y", 1), ("c", " ", "сова", 1)], "id string, original_text string, normalized_text string, word int")
    assert lookalikes.canonical_texts(df, "id", ["original_text", "normalized_text"]).orderBy("id").collect() == [("a", "x y", None), ("b", None, None), ("c", "", "сова")]


def test_the_automaton_finds_exactly_what_looks_the_same():
    rnd = random.Random(1)
    letters = list(lookalikes.TWINS) + list("aceopxyABCEHK") + ["​", "́", "é", "ｅ", "ﬁ", "đ", "Ð"]
    words = list({"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 4))) for _ in range(3000)})
    trie = lookalikes.Trie()
    entries = [w for w in words if lookalikes.is_sound(w) and lookalikes.letters(w)]
    for w in entries:
        trie.add(w)
    for w in words:
        assert {e for _, e, _ in trie.reached(w)} == {e for e in entries if lookalikes.table_form(e) == lookalikes.table_form(w)}


def test_the_automaton_weighs_other_edits():
    trie = lookalikes.Trie()
    for w in ("bread", "break", "beard", "сова"):
        trie.add(w)
    assert [(c, e) for c, e, _ in trie.reached("bread​", 0)] == [(0, "bread")]
    assert {(c, e) for c, e, _ in trie.reached("brеad", 1)} == {(0, "bread"), (1, "break")}
    assert {(c, e) for c, e, _ in trie.reached("beаd", 1)} == {(1, "bread"), (1, "beard")}
    assert trie.reached("coва", 0) == [(0, "сова", 1)] and trie.reached("cива", 0) == []


def test_the_vocabulary_decides_where_the_table_can_t(spark):
    """A Cyrillic word is spelt as the corpus has it; by the table it would become a mixture of scripts."""
    texts = ["сова летит", "coва летит", "сова", "со", "co со", "Ρolo", "coвый"]
    df = spark.createDataFrame([(str(i), t, None) for i, t in enumerate(texts)], "id string, original_text string, normalized_text string")
    got = {r.id: r.original_text for r in lookalikes.canonical_texts(df, "id", ["original_text", "normalized_text"]).collect()}
    assert [got[str(i)] for i in range(len(texts))] == ["сова летит", "сова летит", "сова", "co", "co co", "Polo", "coвый"]
    assert lookalikes.table_form("coва") != got["1"]


def test_classes_count_the_pairs(spark):
    df = table(spark, "transcript_segments")
    found = rows(lookalikes.lookalike_pairs(df))
    links = {}
    for a, b in found:
        for x in (a, b):
            links[x] = links.get(x, 0) + 1
    classes = lookalikes.lookalike_classes(df).collect()
    assert {r.id: r.links for r in classes} == links
    of = {r.id: r.class_id for r in classes}
    assert all(of[a] == of[b] for a, b in found)


# Pairs and languages


@pytest.fixture(scope="session")
def model(spark):
    return languages.fitted(*[table(spark, t) for t in ("transcripts", "source_segments", "transcript_segments", "chat_messages")])


@pytest.fixture(scope="session")
def field(spark):
    return pairs.fitted_field(spark.read.parquet("/root/testdata/sf0.1/chat_messages.parquet"))


def test_the_field_tags_its_own_kind(field):
    held = pairs.made_sequences([("What is said about bread?", "The tutor explains the bread in plain language. The panel tests it twice.")], field.wording, 400, seed=99)
    good = [pairs.TAGS[y] == g for x, ys in held for y, g in zip(ys, field.decode(x, pairs.TAGS))]
    assert sum(good) / len(good) > 0.97


# Wordings that neither the code nor the tables have.
DECLINED = (
    "I cannot tell you anything about the bread.", "Sorry, I am not able to discuss bread with you.", "I could not find bread in the clip, so I cannot say.", "We would rather not talk about this topic.", "I am not allowed to help with this request.",
    "Tôi không thể nói gì về bánh mì.", "Xin lỗi, tôi không được phép nói về bánh mì.", "Tôi không tìm thấy bánh mì trong đoạn này nên không thể trả lời.", "Lo siento, no puedo hablar de eso.", "Leider darf ich darüber nicht sprechen.",
)
ANSWERED = (
    "The baker explains why the bread cannot rise in the cold.", "She smiles, says “I will not answer that”, and then cuts the bread.", "The host could not find the oven at first, but bakes the bread in the end.", "Yes, shortly after minute three.", "The dough rests for an hour before it is baked.",
    "Thợ bánh giải thích vì sao bột không nở khi trời lạnh.", "Cô ấy cười, nói “tôi không trả lời đâu” rồi cắt bánh.", "Bột nghỉ một giờ trước khi nướng.", "El panadero explica cómo se hace el pan.", "Der Bäcker erklärt, wie das Brot gebacken wird.",
)


def test_refusals_in_wordings_never_seen(field):
    found = field.wording.chances([*DECLINED, *ANSWERED]) > 0.5
    assert found[: len(DECLINED)].sum() >= 8 and found[len(DECLINED) :].sum() <= 1


def test_the_wording_is_learned_from_warnings():
    """An invented way to decline is known by the warnings alone."""
    clauses = ["The oracle keeps its veil over the bread.", "The tutor bakes the bread.", "The panel tests the bread twice."] * 60
    wording = pairs.learned_wording(clauses, [i % 3 == 0 for i in range(180)])
    assert (wording.chances(["The oracle keeps its veil over the soup.", "The tutor bakes the soup."]) > 0.5).tolist() == [True, False]


Q, A = "What does the video say about bread?", "The tutor explains a slow bread dough in plain language."
CASES = [
    (Q, None, "en", None, {"empty"}), (Q, " ​\n", "en", None, {"empty"}), (Q, "N/A", "en", None, {"empty"}), (Q, "<p> </p>", "en", None, {"empty"}), (Q, "(no answer)", "en", None, {"empty"}), (Q, "-", "en", None, {"empty"}),
    (Q, A, "en", None, set()), (Q, A + " [1][3]", " EN-us", None, set()), (Q, A + " 👍", None, None, set()), (Q, "Yes, around minute 9.", "en", None, set()),
    (Q, "The tutor explains a slow bread", "en", None, {"truncated"}), (Q, A + " The panel, as follows: 1. it tests\n2.", "en", None, {"truncated"}), (Q, A + " The reasons are:", "en", None, {"truncated"}), (Q, A + " The panel tests the…", "en", None, {"truncated"}),
    (Q, "I cannot answer this question.", "en", None, {"refusal"}), (Q, "I cannot answer this question.", "en", "weak", set()), (Q, "I cannot answer this question.", "en", "  ", {"refusal"}), (Q, "Well. I could not find it in the clip, so I cannot tell you.", "en", "", {"refusal"}),
    (Q, "She laughs, says “I will not tell you that”, and then the panel tests the bread.", "en", None, set()),
    (Q, Q, "en", None, {"copy"}), (Q, Q.upper(), "en", None, {"copy"}), (Q, f"Q: {Q} {Q}", "en", None, {"copy"}), (Q, Q + " " + A, "en", None, set()), (Q, "What does this clip say about bread?", "en", None, {"copy"}), ("How long does the panel bake", "HOW LONG DOES THE PANEL BAKE", "en", None, {"copy"}),
    (Q, "Người dẫn chương trình giải thích khối bột bánh ủ chậm trong mười phút cuối.", "en", None, {"language"}), (Q, "Người dẫn chương trình giải thích khối bột bánh ủ chậm trong mười phút cuối.", "unknown", None, {"language"}), (Q, "Người dẫn chương trình giải thích khối bột bánh ủ chậm trong mười phút cuối.", "vie", None, set()),
]


def test_pair_defects(spark, model, field):
    data = [(str(i), *c[:4], "clash") for i, c in enumerate(CASES)] + [(None, Q, None, "en", None, "clash"), ("0", *CASES[0][:4], "clash")]
    df = spark.createDataFrame(data, "message_id string, question string, answer string, answer_language string, groundedness_warning string, expected string")
    got = {str(i): set() for i in range(len(CASES))}
    found = pairs.found_defects(df, model, field).collect()
    assert len(found) == len(set(found))
    for r in found:
        got[r.message_id].add(r.defect)
    assert [(CASES[int(i)][1], g, CASES[int(i)][4]) for i, g in got.items() if g != CASES[int(i)][4]] == []
    assert pairs.found_defects(df.where("false"), model, field).count() == 0


def test_long_and_null_questions_and_answers(spark, model, field):
    df = spark.createDataFrame([("a", None, A * 3000, None, None), ("b", "", " " * 5000, None, None)], "message_id string, question string, answer string, answer_language string, groundedness_warning string")
    assert rows(pairs.found_defects(df, model, field)) == [("b", "empty")]


def test_one_clause_in_another_language_makes_no_foreign_answer(field):
    """The languages of clauses are told apart by a clear margin, whatever sample the field was fitted on."""
    parts, own = [A, "Das Brot schmeckt allen gut.", A], ["en", "de", "en"]
    defects, _, tongues = pairs.judge(Q, parts, field.wording.chances(parts), own, [10, 5, 10], "en", False, field)
    assert (defects, tongues) == ([], ["answer", "foreign", "answer"])
    x = pairs._language_only(pairs.features(Q, parts, [False, True, False], np.zeros(3)))
    said = (x @ field.language.weights)[:, [pairs.TAGS.index("answer"), pairs.TAGS.index("foreign")]]
    assert (said[[0, 2], 0] > said[[0, 2], 1] + 2).all() and said[1, 1] > said[1, 0] + 2


HELD_OUT = {
    "vi": ["trời mưa suốt đêm nên sáng nay đường rất trơn", "co giao da sua bai tap cua chung toi vao hom qua", "anh ấy thích uống trà nóng khi đọc báo"],
    "en": ["it rained all night so the road was slippery this morning", "she likes to drink hot tea while reading the newspaper", "the keys were lying under the old blanket"],
    "fr": ["il a plu toute la nuit et la route est glissante ce matin", "elle aime boire du thé chaud en lisant le journal", "les clés étaient sous la vieille couverture"],
    "de": ["es hat die ganze nacht geregnet und die straße ist glatt", "sie trinkt gerne heißen tee beim lesen der zeitung", "die schlüssel lagen unter der alten decke"],
    "es": ["llovió toda la noche y la calle está resbaladiza", "a ella le gusta tomar té caliente mientras lee el periódico", "las llaves estaban debajo de la manta vieja"],
}


def test_languages_of_unseen_sentences(model):
    pairs_ = [(t, k) for k, ts in HELD_OUT.items() for t in ts]
    best = model.scores([t for t, _ in pairs_]).argmax(1)
    assert [languages.LANGUAGES[b] for b in best] == [k for _, k in pairs_]


def test_wrong_training_labels_are_outvoted():
    rnd = random.Random(4)
    texts, labels = [], []
    for k, ts in languages.SEEDS.items():
        for t in ts:
            for _ in range(12):
                w = t.split()
                rnd.shuffle(w)
                texts.append(" ".join(w))
                labels.append(k if rnd.random() > 0.15 else rnd.choice(languages.LANGUAGES))
    m = languages.fit(texts, labels)
    every = [(t, k) for k, ts in HELD_OUT.items() for t in ts if k != "vi"]
    assert sum(languages.LANGUAGES[b] == k for b, (_, k) in zip(m.scores([t for t, _ in every]).argmax(1), every)) >= len(every) - 2


def test_stretches_of_other_languages(model):
    text = HELD_OUT["vi"][0] + " " + HELD_OUT["de"][0]
    (cut,) = languages.stretches(model.places, [text])
    assert [languages.LANGUAGES[k] for _, _, k in cut] == ["vi", "de"] and abs(cut[0][1] + 1 - len(HELD_OUT["vi"][0].split())) <= 1
    assert languages.stretches(model.places, ["", "xin chào", ""])[0::2] == [[], []]


@pytest.mark.parametrize("label,want", [("vi-VN", "vi"), ("VIE ", "vi"), ("en_GB", "en"), ("spa", "es"), ("und", None), ("", None), (" ", None), ("??", None), (None, None), ("it", "it")])
def test_language_labels(spark, label, want):
    assert spark.createDataFrame([(label,)], "x string").select(languages.language_code(F.col("x"))).collect()[0][0] == want


def test_label_records(spark, model):
    vi, de = HELD_OUT["vi"], HELD_OUT["de"]
    t = spark.createDataFrame([("right", "vi", 1), ("wrong", "de", 1), ("none", None, 1), ("none", None, 1), ("silent", None, 1), ("canon", "en", 1)], "id string, language_code string, lang int")
    cues = [(k, i, x, 0) for k in ("right", "wrong", "none") for i, x in enumerate([vi[0], vi[2], "[Âm nhạc]", None, vi[0] + ". " + de[0], "[Peter Pan]: " + vi[0]])] + [("silent", 0, "♪ ♪", 0), ("right", 0, vi[0], 0), (None, 0, de[0], 0)]
    s = spark.createDataFrame(cues, "transcript_id string, sequence_number int, text string, lang int")
    c = spark.createDataFrame([("x", "canon", 0, vi[0])], "id string, transcript_id string, sequence_number int, original_text string")
    m = spark.createDataFrame([("m1", vi[0], "en"), ("m2", vi[0], "vi"), ("m3", vi[0], " "), ("m4", "n/a", "und"), ("m5", None, None), ("m1", vi[0], "en")], "message_id string, answer string, answer_language string")
    got = rows(languages.wrong_labels(t, m, s, c, model, pairs.without_empty).drop("confidence"))
    assert got == sorted([("transcript", "wrong", "vi"), ("transcript", "none", "vi"), ("transcript", "canon", "vi"), ("message", "m1", "vi"), ("message", "m3", "vi"), *[("cue", f"{k}:4", "de") for k in ("right", "wrong", "none")]])
    none = [x.where("false") for x in (t, m, s, c)]
    assert languages.wrong_labels(*none, languages.fitted(t.where("false"), s.where("false"), c.where("false")), pairs.without_empty).count() == 0


# Turns

CUE = "transcript_id string, sequence_number int, text string, start_ms bigint, end_ms bigint, kind string"


def cues_of(spark, by):
    return spark.createDataFrame([(t, i, x, 1000 * i, 1000 * i + 900, "clash") for t, xs in by.items() for i, x in enumerate(xs)], CUE)


TURNS = {
    "a": (["hello all", "BRAMMO TILK: one", "two", "[Music]", "Brammo: three", ">> four", "Brammo – five", None, "um.", "Cô Jorvi Halmet: six. >> seven", "Jörvi (2:12):", "<00:00:10.000> eight"], [(0, 0), (1, 4), (5, 5), (6, 6), (9, 9), (9, 9), (11, 11)]),
    "b": (["SPEAKER_01: a", "speaker 1 : b", "[SPEAKER_02]: c", "Người nói 2: d", "Note: not a label", "Step 3: nor this", "x [speaker 01] y"], [(0, 1), (2, 6), (6, 6)]),
    "c": (["no labels", "at all"], []),
    "d": (["Host:", "[laughter]"], []),
}


@pytest.mark.parametrize("size", [2048, 3, 2, 1])
def test_turns(spark, monkeypatch, size):
    """Small buckets put every turn across borders."""
    monkeypatch.setattr(streams, "BUCKET_CUES", size)
    df = cues_of(spark, {t: x for t, (x, _) in TURNS.items()})
    found = turns.turns(df.union(df.where("sequence_number < 2"))).where("marked").select("transcript_id", "first_number", "last_number")
    assert rows(found) == sorted((t, *w) for t, (_, ws) in TURNS.items() for w in ws)


@pytest.mark.parametrize("size", [2048, 2])
def test_turns_hold_clean_text_and_times(spark, monkeypatch, size):
    monkeypatch.setattr(streams, "BUCKET_CUES", size)
    got = turns.turns(cues_of(spark, {"a": TURNS["a"][0]})).orderBy("place").collect()
    said = [(r.first_number, r.speaker or "", r.text, r.start_ms, r.end_ms) for r in got]
    assert said[:2] == [(0, "", "hello all", 0, 900), (1, "brammo", "one two three", 1000, 4900)] and said[-1] == (11, "jorvi", "eight", 11000, 11900)
    assert turns.turns(cues_of(spark, {"a": ["x"]}).where("false")).count() == 0


def test_isotonic_times():
    import numpy as np

    nan = float("nan")
    assert turns.isotonic(np.array([3.0, 1.0, 2.0, 5.0])).tolist() == [2.0, 2.0, 2.0, 5.0]
    begin, end = turns.repaired_times(np.array([0, 50_000, 0, nan, 10_000]), np.array([900, 50_900, 900, nan, nan]))
    assert begin.tolist() == [0, 50_000, 50_900, 50_900, 60_900] and (end >= begin).all()


@pytest.mark.parametrize("size", [2048, 4, 3, 1])
def test_times_are_fitted_within_file_segments_whatever_the_buckets(spark, monkeypatch, size):
    monkeypatch.setattr(streams, "BUCKET_CUES", size)
    rnd = random.Random(size)
    one = [(t, i, f">> w{i}", s, None if s is None else s + 500, "c") for t, xs in {"a": [0, 1000, 2000, 9000, 3000, 4000, 12_000, None, 13_000], "b": [None, 5000, 90_000, 1000, 3000, 2000, 2000, 99_000, 500]}.items() for i, s in enumerate(xs)]
    many = [("r", i, f">> w{i}", max(0, 1000 * (i % 40) + rnd.randrange(-4000, 4000)), None, "c") for i in range(160)]
    got = {}
    for r in turns.turns(spark.createDataFrame(one + many, CUE)).collect():
        got.setdefault(r.transcript_id, []).append((r.first_number, r.start_ms))
    at = {t: [s for _, s in sorted(x)] for t, x in got.items()}
    assert at["a"] == [0, 1000, 2000, 5333, 5333, 5333, 12_000, 12_000, 13_000]
    assert at["b"] == [0, 5000, 90_000, 91_500, 92_833, 92_833, 92_833, 189_500, 190_500]
    # Against the min-max formula of the isotonic fit, segment by segment.
    raw, want, shift, seg = [r[3] for r in many], [], 0, []

    def close(seg):
        for j in range(len(seg)):
            want.append(round(max(min(sum(seg[a : b + 1]) / (b - a + 1) for b in range(j, len(seg))) for a in range(j + 1))))

    for i, s in enumerate(raw):
        if i and s < raw[i - 1] - turns.RESET_MS:
            close(seg)
            shift, seg = shift + raw[i - 1], []
        seg.append(s + shift)
    close(seg)
    assert all(abs(a - b) <= 1 for a, b in zip(at["r"], want)) and len(want) == 160


# Repeats


def brute_runs(xs, gap):
    t = [repeats.reduced(x) for x in xs]

    def near(a, b):
        if not a[0] or not b[0] or a[1] != b[1]:
            return False
        d = list(range(len(b[0]) + 1))
        for i, x in enumerate(a[0], 1):
            d, old = [i], d
            for j, y in enumerate(b[0], 1):
                d.append(min(old[j] + 1, d[-1] + 1, old[j - 1] + (x != y)))
        return a[0] == b[0] or (min(len(a[0]), len(b[0])) >= 20 and d[-1] <= 2)

    out, i = [], 0
    while i < len(xs):
        j = i
        while j + 1 < len(xs) and not gap[j + 1] and near(t[j], t[j + 1]):
            j += 1
        out += [(i, j)] if j > i else []
        i = j + 1
    return out


@pytest.mark.parametrize("size", [2048, 7, 1])
def test_runs_match_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(streams, "BUCKET_CUES", size)
    rnd = random.Random(size)
    base = "the quick brown fox jumps over 3 lazy dogs"
    forms = [base, base.upper() + "!", base[:-1], base[2:], base.replace("3", "4"), "short", "shorts", "...", None, "", "​short", base[5:]]
    xs = [rnd.choice(forms) for _ in range(150)]
    gap = [rnd.random() < 0.2 for _ in xs]
    data, at = [], 0
    for i, (x, g) in enumerate(zip(xs, gap)):
        at += 251 if g else rnd.choice((250, -500, 0))
        data.append(("t", i, x, at, at + 1000, "clash"))
        at += 1000
    df = spark.createDataFrame(data + data[:9], CUE)
    want = brute_runs(xs, gap)
    assert rows(repeats.collapse(df).select("first_number", "last_number")) == want
    assert rows(repeats.removed_counts(df)) == [("t", 150, sum(b - a for a, b in want))]
    assert repeats.collapse(df.where("false")).count() == 0


def test_null_times_and_long_texts_don_t_merge_or_fail(spark):
    df = spark.createDataFrame([("t", 0, "abc", 0, None, ""), ("t", 1, "abc", None, 5, ""), ("t", 2, "z" * 300_000, 5, 9, ""), ("t", 3, "z" * 300_001, 9, 12, ""), (None, 1, "abc", 1, 2, "")], CUE)
    assert rows(repeats.collapse(df).select("first_number", "last_number")) == [(2, 3)]


# Tokens and mixing


def test_ids_equal_the_public_library(spark):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    public.encode_special_tokens = True
    rnd = random.Random(3)
    signs = [chr(c) for c in [*range(0x300), 0x1EA5, 0x1ED9, 0x200B, 0x2009, 0x3000, 0x4E2D, 0x1F989] if c not in (0,)]
    texts = ["<|endoftext|> x", "a" * 2000, "abab" * 300, "中文" * 300, " " * 900 + "x", "don't\r\n\r\n  we'll", *["".join(rnd.choice(signs) for _ in range(50)) for _ in range(300)]]
    data = [(i, t, 1) for i, t in enumerate(texts)] + [(9000, None, 1), (9001, "", 1), (0, texts[0], 1)]
    coded = tokenizing.encode_documents(spark.createDataFrame(data, "doc_id long, text string, ids int"))
    got = {r.doc_id: r.ids for r in coded.collect()}
    assert [got[i] for i in range(len(texts))] == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]
    assert got[9000] == got[9001] == [] and coded.count() == len(data)
    back = {r.doc_id: r.text for r in tokenizing.decode_documents(coded).collect()}
    assert [back[i] for i in range(len(texts))] == texts and back[9000] == ""


def test_many_long_words_and_one_of_a_million_bytes():
    from tokenizers import Tokenizer

    public = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    rnd = random.Random(4)
    texts = [" ".join("".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(80)) for _ in range(4000)), "a" * 1_000_000, "".join(rnd.choice("etaoinshr") for _ in range(20_000))]
    with open(tokenizing.VOCABULARY, "rb") as f:
        encoder = tokenizing.Encoder(f.read())
    assert encoder.encode(texts) == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("size", [None, 500, 4000, 10**9])
def test_mixing_meets_shares_and_limits(spark, monkeypatch, size):
    monkeypatch.setattr(mixing, "BLOCK_DOCUMENTS", 16)
    rnd = random.Random(5)
    data = [(i, s, rnd.randrange(1, 9), 1) for i, s in enumerate(rnd.choice(["big"] * 6 + ["mid"] * 3 + ["low"]) for _ in range(900))] + [(5000, None, 4, 1), (5001, "other", 4, 1), (5002, "big", None, 1)]
    docs = spark.createDataFrame(data, "doc_id long, source string, n_tokens int, passes int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("low", 0.2, 3), ("gone", 0.0, 2)], "source string, target_share double, max_repeats int")
    drawn = mixing.select_documents(docs, targets, size).collect()
    most = {"big": 1, "mid": 2, "low": 3}
    assert all(1 <= r.uses <= most[r.source] for r in drawn) and len({r.doc_id for r in drawn}) == len(drawn)
    got = {r.source: r for r in mixing.shares(docs, targets, size).collect()}
    total = sum(r.uses * r.n_tokens for r in drawn)
    assert total == sum(r.tokens for r in got.values())
    if size is None or size == 500:
        assert all(abs(got[s].actual_share - got[s].target_share) < 8 / total for s in most)
    if size == 10**9:  # everything that may be used is
        assert got["low"].tokens == 3 * sum(n for _, s, n, _ in data if s == "low") and got["big"].tokens == sum(n or 0 for _, s, n, _ in data if s == "big")


def test_mixing_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert mixing.select_documents(docs, targets).count() == 0
    assert [r.actual_share for r in mixing.shares(docs, targets).collect()] == [0.0]
    assert mixing.select_documents(docs, targets.where("false")).count() == 0


def test_the_exponent_meets_an_entropy():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    x = mixing.exponent_for_entropy(shares, 1.0)
    assert abs(mixing.entropy(mixing.tempered(shares, x)) - 1.0) < 1e-6


def test_the_weights_are_powers_of_the_token_shares():
    target, tokens, most = {"a": 0.2, "b": 0.5, "c": 0.3}, {"a": 700, "b": 200, "c": 100}, {"a": 2, "b": 3, "c": 4}
    drawn, exponents = mixing.budgets(target, tokens, most)
    size = sum(drawn.values())
    for s in target:
        assert abs((tokens[s] / 1000) ** exponents[s] - target[s]) < 1e-9 and abs(drawn[s] / size - target[s]) < 1e-9
    assert exponents["a"] > 1 > exponents["b"]
    assert max(drawn[s] / (tokens[s] * most[s]) for s in target) == pytest.approx(1)
    # Beyond that size the limits hold and the shares give way.
    more, _ = mixing.budgets(target, tokens, most, size * 1.5)
    assert sum(more.values()) == pytest.approx(size * 1.5) and all(more[s] <= tokens[s] * most[s] * (1 + 1e-9) for s in target)


def test_one_exponent_goes_up_to_the_repetition_limit():
    shares, capacity = {"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 700.0, "b": 400.0, "c": 200.0}
    for size in (300, 600, 900):
        weights, x = mixing.tempered_weights(shares, capacity, 1.05, size)
        assert all(w * size <= capacity[s] * (1 + 1e-9) for s, w in weights.items())
    assert x > mixing.exponent_for_entropy(shares, 1.05)
    assert max(w * size / capacity[s] for s, w in weights.items()) == pytest.approx(1)


# Garbled texts

SOUND = ["Le mot « Âge » et « À suivre » restent en capitales.", "Größe ½ × ¾, Øre and Ångvik are names.", "В конце урока сова летит над рекой.", "用語集: 字幕、区間、索引。", "LÃNG SÃO ÂM LƯỢNG ±3 dB, góc 45°", "🦉📚🧵 family 👨‍👩‍👧", "plain ascii", ""]
CLEAN = "Người dẫn chương trình giải thích về độ mặn của đầm nước triều. Die Überlappung der Untertitel prüft der Erzähler für später. L’équipe vérifie la tâche — “voilà”, naïve. El patrón de la señora está aquí."


def wrongly(text, way):
    data = text.encode(way[0], "strict")
    return garbled._with_holes(data, way[1]) if way[1].startswith("cp125") else data.decode(way[1], "replace")


WAYS = [("utf-8", e) for e in ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman", "gb18030", "cp1250", "ascii")]


def test_garbled_documents(spark):
    data = [(i, CLEAN, "clash") for i in range(50)] + [(100 + i, x, "clash") for i, x in enumerate(SOUND)]
    data += [(200 + i, "sound words before " + wrongly("độ mặn của đầm nước triều für später prüft", w), "clash") for i, w in enumerate(WAYS)]
    data += [(300, wrongly("prüft für später", ("cp1252", "cp1251")), "c"), (301, wrongly("prüft für", ("cp1252", "utf-8")), "c"), (302, wrongly(wrongly("prüft für", ("utf-8", "latin-1")), ("utf-8", "cp1252")), "c"), (400, None, "c"), (None, "fÃ¼r", "c"), (200, "sound words before " + wrongly("độ mặn của đầm nước triều für später prüft", WAYS[0]), "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, core string")
    found = [r[0] for r in garbled.affected(df).orderBy("doc_id").collect()]
    assert found == [*range(200, 200 + len(WAYS)), 300, 301, 302]
    unique = df.dropDuplicates(["doc_id"])
    whole = {r.doc_id: r for r in garbled.restored(unique).collect()}
    for i, (_, e) in enumerate(WAYS):
        if e != "ascii":
            assert whole[200 + i].restored_text == "sound words before độ mặn của đầm nước triều für später prüft" and whole[200 + i].restorable, e
    assert whole[302].restored_text == "prüft für" and whole[300].restored_text == "prüft für später"
    assert garbled.affected(df.where("false")).count() == 0


def test_a_form_that_looks_sound_is_put_back_beside_a_sure_one(spark):
    seen = "école très tôt"
    wrong = wrongly(seen, ("cp1252", "mac_roman"))
    assert garbled.is_clean(wrong.split()[0])
    data = [(i, seen) for i in range(9)] + [(100, wrong), (101, wrong.split()[0] + " is a name")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert [(r.doc_id, r.restored_text) for r in garbled.restored(df).collect()] == [(100, seen)]
    assert [r.doc_id for r in garbled.affected(df).collect()] == [100]


def test_very_long_documents(spark):
    df = spark.createDataFrame([(1, (CLEAN + " ") * 3000), (2, ("fÃ¼r " * 30_000))], "doc_id long, text string")
    many = df.union(spark.createDataFrame([(3 + i, "für") for i in range(40)], df.schema))
    assert [r[0] for r in garbled.affected(many).collect()] == [2]


# Whole queries


def test_nfd_and_nfc_are_one_form():
    assert lookalikes.table_form(unicodedata.normalize("NFD", CLEAN)) == lookalikes.table_form(CLEAN)


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p3_classes", "p3_forms", "p7_found", "p7_runs", "p7_counts", "p8_ids", "p8_decoded"])
def test_query_equals_sql(spark, name):
    import os

    import duckdb

    import __spark_entry__ as entry
    from verify import _rows

    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{TABLES}/{f}')")
    res = con.execute(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, TABLES)
    assert _rows(df.columns, df.collect()) == _rows([d[0] for d in res.description], res.fetchall())
