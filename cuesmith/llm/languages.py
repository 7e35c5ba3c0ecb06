"""Languages of texts and of stretches in them, by a string kernel.

Two texts are as alike as the share of character n-grams (one to ``MAX_N`` characters, presence only, so a blended
spectrum) they have in common. Some training texts serve as Nyström landmarks; one-versus-rest kernel ridge regression
is fitted on the map they give. Texts are scored in batches: one matrix product with the landmarks, one with the weights.
Within a text, the kernel's weight of each word's n-grams feeds a Viterbi pass that finds stretches of other languages,
each of which is scored again as a text of its own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .lookalikes import IGNORABLE

LANGUAGES = ("vi", "en", "fr", "de", "es")
MAX_N = 4
WIDTH = 1 << 13
"""Presence vectors: n-grams are hashed to this many places."""
LANDMARKS = 400
RIDGE = 1.0
CLEANING_RIDGE = 0.01
"""Times the rows of the sample: the stiffer fit by which its wrong labels are found."""
TRAIN_TRANSCRIPTS = 120
"""Labelled transcripts of each language that the training sample takes, by the hash of their ids."""
TRAIN_CUES = 30
"""Cues of each of them, so the sample has at most 5 x 120 x 30 rows, of which ``TRAIN_ROWS`` are kept by hash."""
TRAIN_ROWS = 6000
SEED_WEIGHT = 2.0
"""What a sentence of our own weighs against one of the sample, whose words are those of its own subjects."""
TRAIN_MESSAGES = 3000
"""Answers with a language label that the sample takes besides, by the hash of their ids: they have words of their own."""
SHARPNESS = 4.0
BATCH = 256
SWITCH = 1.2
"""Evidence that a change of language within a text must bring."""
CLAUSE_WORDS = 5
"""A stretch of fewer words is no whole clause."""

# Spellings of the language codes, first part only.
CODES = {
    "vi": ("vi", "vie", "vn", "vietnamese", "tiengviet"), "en": ("en", "eng", "english"), "fr": ("fr", "fra", "fre", "french", "francais", "français"),
    "de": ("de", "deu", "ger", "german", "deutsch"), "es": ("es", "spa", "spanish", "espanol", "español", "castellano"),
}
NO_LANGUAGE = ("", "und", "unknown", "unk", "none", "null", "n/a", "na", "xx", "xxx", "zxx", "mul", "mis", "auto", "?", "??", "???", "-", "--")

# Plain sentences of our own that anchor each language, also where a sample has none of it.
SEEDS = {
    "vi": ("hôm nay chúng ta sẽ nói về cách làm việc của máy này", "tôi không biết câu trả lời cho câu hỏi đó", "các bạn hãy nhìn vào bảng và ghi lại những điều quan trọng", "người ta thường quên rằng nước cũng có thể làm hỏng giấy", "xin lỗi tôi không thể giúp bạn việc này được", "đó là lý do vì sao phần này rất khó với người mới", "tôi phải từ chối nói về chuyện đó ở đây", "có lẽ bạn nên hỏi một người khác", "yêu cầu của bạn không được phép", "vâng điều đó đúng", "không tôi không nghĩ vậy", "trợ lý không thể bàn về chủ đề ấy", "rất tiếc là chưa có gì trong đoạn này", "bằng một ví dụ cụ thể", "bằng lời lẽ dễ hiểu", "chúng tôi sẽ trả lời sau"),
    "en": ("today we are going to talk about how this machine works", "i do not know the answer to that question", "please look at the board and write down what is important", "people often forget that water can also damage paper", "sorry but i am not able to help you with this", "that is the reason why this part is so hard for beginners", "i must refuse to speak about that here", "maybe you should ask somebody else", "your request is not permitted", "yes that is right", "no i do not think so", "as an assistant i decline to discuss the matter", "unfortunately there is nothing in this passage", "i would rather not respond to it", "this is beyond what we can do", "we will reply later"),
    "fr": ("aujourd'hui nous allons parler du fonctionnement de cette machine", "je ne connais pas la réponse à cette question", "regardez le tableau et notez ce qui est important", "on oublie souvent que l'eau peut aussi abîmer le papier", "désolé mais je ne peux pas vous aider avec cela", "c'est la raison pour laquelle cette partie est difficile pour les débutants", "je dois refuser d'en parler ici", "vous devriez peut-être demander à quelqu'un d'autre", "votre demande n'est pas permise", "oui c'est exact", "non je ne crois pas", "en tant qu'assistant je préfère éviter ce sujet", "malheureusement il n'y a rien dans ce passage", "je n'ai pas le droit d'y répondre", "cela dépasse mes moyens", "nous répondrons plus tard"),
    "de": ("heute sprechen wir darüber wie diese maschine funktioniert", "ich kenne die antwort auf diese frage nicht", "schaut bitte auf die tafel und schreibt das wichtige auf", "man vergisst oft dass wasser auch papier beschädigen kann", "leider kann ich ihnen dabei nicht helfen", "das ist der grund warum dieser teil für anfänger so schwer ist", "ich muss es ablehnen hier darüber zu sprechen", "vielleicht fragen sie besser jemand anderen", "ihre anfrage ist nicht erlaubt", "ja das stimmt", "nein das glaube ich nicht", "als assistent möchte ich dieses thema vermeiden", "leider steht nichts in diesem abschnitt", "dazu darf ich nichts sagen", "das geht über meine möglichkeiten hinaus", "wir antworten später"),
    "es": ("hoy vamos a hablar de cómo funciona esta máquina", "no conozco la respuesta a esa pregunta", "miren la pizarra y anoten lo que es importante", "la gente olvida a menudo que el agua también puede dañar el papel", "lo siento pero no puedo ayudarle con esto", "esa es la razón por la que esta parte es tan difícil para los principiantes", "debo negarme a hablar de eso aquí", "quizás debería preguntar a otra persona", "su petición no está permitida", "sí eso es correcto", "no yo no lo creo", "como asistente prefiero evitar ese tema", "por desgracia no hay nada en este pasaje", "no me dejan contestar a ello", "eso supera lo que podemos hacer", "responderemos más tarde"),
}


def language_code(label: Column) -> Column:
    """``vi``, ``en``, ``fr``, ``de`` or ``es`` for any spelling of them, null for none, the label itself for others."""
    low = F.lower(F.trim(F.translate(label, " ​﻿\t\n", "     ")))
    first = F.element_at(F.split(low, "[-_. ]"), 1)
    known = F.lit(None).cast("string")
    for code, spellings in CODES.items():
        known = F.when(first.isin(*spellings) | F.regexp_replace(low, " ", "").isin(*spellings), F.lit(code)).otherwise(known)
    return F.when(label.isNull() | low.isin(*NO_LANGUAGE), F.lit(None)).otherwise(F.coalesce(known, low))


_LETTERS = re.compile(r"[^\W\d_]+")
_ASIDE = re.compile(r"<[^<>\n]*>|\[[^\[\]\n]*\]|\([^()\n]*\)|\{[^{}\n]*\}|\*[^*\n]+\*|♪[^♪\n]*♪?")
_SIGNS = re.compile(f"[<\\[({{*♪{IGNORABLE}]")
_HIDDEN = re.compile(f"[{IGNORABLE}]")


def plain_words(text: str) -> list[str]:
    """Lower-case words of letters only; apostrophes split words."""
    return _LETTERS.findall(unicodedata.normalize("NFC", text.lower()))


def without_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D")) if not unicodedata.combining(c))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and place of every n-gram of the texts, each with a blank before and after."""
    padded = [f" {t} " for t in texts]
    lengths = np.fromiter((len(p) for p in padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    rows = np.repeat(np.arange(len(padded)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    starts = np.arange(len(codes))
    out_r, out_s, out_p = [], [], []
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, MAX_N + 1):
        value = value * np.uint64(1_000_003) + np.uint64(n)
        value[: len(codes) - n + 1] += codes[n - 1 :]
        whole = starts + n <= ends
        if n == 1:
            whole &= codes != 32
        mixed = value[whole]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out_r.append(rows[whole])
        out_s.append(starts[whole])
        out_p.append(((mixed >> np.uint64(40)) % np.uint64(WIDTH)).astype(np.int64))
    return np.concatenate(out_r), np.concatenate(out_s), np.concatenate(out_p)


def confidence(scores: np.ndarray) -> np.ndarray:
    s = np.exp(SHARPNESS * scores)
    return s / s.sum(1, keepdims=True)


def product(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``x @ places`` in slices of few rows: of a large product a library starts a thread on every core, and tasks that do
    so side by side slow each other down."""
    return np.concatenate([x[i : i + 6] @ places for i in range(0, len(x), 6)]) if len(x) else np.zeros((0, places.shape[1]), np.float32)


def present(texts: list[str], grams: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """1 where a text has an n-gram of the place, else 0."""
    x = np.zeros((len(texts), WIDTH), np.float32)
    if texts:
        r, _, p = grams or _grams(texts)
        x[r, p] = 1.0
    return x


def presence(texts: list[str]) -> np.ndarray:
    """Rows of unit length; the kernel of two texts is the product of their rows."""
    x = present(texts)
    return x / np.maximum(np.sqrt(x.sum(1, keepdims=True)), 1.0)


@dataclass
class KernelModel:
    landmarks: np.ndarray
    weights: np.ndarray

    @cached_property
    def places(self) -> np.ndarray:
        """Weight of each n-gram place for each language: what a single n-gram adds to a score."""
        return (self.landmarks.T @ self.weights).astype(np.float32)

    @cached_property
    def places_and_ones(self) -> np.ndarray:
        """With a column that counts the places of a text, so that its length comes from the same product."""
        return np.hstack([self.places, np.ones((WIDTH, 1), np.float32)])

    def scores(self, texts: list[str], grams: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """One matrix product a batch: that of the landmarks and the weights is the same for all and done before."""
        out = [np.zeros((0, len(LANGUAGES)), np.float32)]
        for i in range(0, len(texts), BATCH):
            found = product(present(texts[i : i + BATCH], grams), self.places_and_ones)
            out.append(found[:, :-1] / np.maximum(np.sqrt(found[:, -1:]), 1.0))
        return np.concatenate(out)

    def confidence(self, texts: list[str]) -> np.ndarray:
        return confidence(self.scores(texts))


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, rounds: int = 2) -> KernelModel:
    """Fit on labelled texts; labels that a stiff fit contradicts are put right first."""
    words = [" ".join(plain_words(t)) for t in texts]
    y = np.array([LANGUAGES.index(x) for x in labels], dtype=int)
    anchors = [(" ".join(plain_words(t)), LANGUAGES.index(k)) for k, ts in SEEDS.items() for t in ts]
    # Vietnamese is also written without accents.
    bare = [(without_accents(w), 0) for w, k in zip(words, y) if k == 0] + [(without_accents(w), k) for w, k in anchors if k == 0]
    words += [w for w, _ in anchors + bare]
    fixed = np.zeros(len(words), bool)
    fixed[len(y) : len(y) + len(anchors)] = True
    y = np.concatenate([y, np.array([k for _, k in anchors + bare], dtype=int)])
    chosen = np.linspace(0, len(words) - 1, min(landmarks, len(words))).astype(int)
    marks = presence([words[i] for i in chosen])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > 1e-6
    root = vectors[:, kept] / np.sqrt(values[kept])
    kernel = np.concatenate([presence(words[i : i + BATCH]) @ marks.T for i in range(0, len(words), BATCH)])
    mapped = kernel.astype(np.float64) @ root
    weights = np.zeros((len(chosen), len(LANGUAGES)), np.float32)
    for k in range(rounds + 1):
        target = np.where(y[:, None] == np.arange(len(LANGUAGES))[None, :], 1.0, -1.0)
        # While labels are checked every row weighs the same, then every language.
        share = np.bincount(y, minlength=len(LANGUAGES)).astype(float)
        w = (len(y) / len(LANGUAGES) / np.maximum(share, 1.0))[y][:, None] if k == rounds else np.ones((len(y), 1))
        w = w * np.where(fixed, SEED_WEIGHT, 1.0)[:, None]
        stiff = ridge if k == rounds else max(ridge, CLEANING_RIDGE * len(y))
        solved = np.linalg.solve(mapped.T @ (w * mapped) + stiff * np.eye(mapped.shape[1]), mapped.T @ (w * target))
        weights = (root @ solved).astype(np.float32)
        if k < rounds:
            best = (mapped @ solved).argmax(1)
            y = np.where(fixed, y, best)
    return KernelModel(marks, weights)


def labelled_sample(transcripts: DataFrame, source_cues: DataFrame, canonical_cues: DataFrame) -> list[tuple[str, str]]:
    """At most ``TRAIN_ROWS`` pairs of text and label, the same for the same tables."""
    spark = transcripts.sparkSession
    labelled = transcripts.where("id IS NOT NULL").select(F.col("id").alias("__t"), language_code(F.col("language_code")).alias("lang"), F.xxhash64("id").alias("h")).where(F.col("lang").isin(*LANGUAGES))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # About four times what is wanted of each language comes to the driver, however many there are.
    share = F.lit(0.0)
    for code, n in counts.items():
        share = F.when(F.col("lang") == code, min(1.0, 4 * TRAIN_TRANSCRIPTS / n)).otherwise(share)
    near = sorted((r["h"], r["__t"], r["lang"]) for r in labelled.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).collect())
    chosen = [{"__t": t, "lang": k} for code in LANGUAGES for _, t, k in [x for x in near if x[2] == code][:TRAIN_TRANSCRIPTS]]
    if not chosen:
        return []
    few = F.broadcast(spark.createDataFrame([(r["__t"], r["lang"]) for r in chosen], "__t string, lang string"))
    cues = source_cues.select("transcript_id", "sequence_number", "text").unionByName(canonical_cues.select("transcript_id", "sequence_number", F.col("original_text").alias("text")))
    rows = cues.where((F.col("sequence_number") < TRAIN_CUES) & F.col("text").isNotNull()).join(few, F.col("transcript_id") == F.col("__t")).select("text", "lang", F.xxhash64("transcript_id", "sequence_number").alias("h"))
    return [(r["text"], r["lang"]) for r in rows.orderBy("h", "text").limit(TRAIN_ROWS).collect()]


def labelled_answers(messages: DataFrame) -> list[tuple[str, str]]:
    """At most ``TRAIN_MESSAGES`` answers and labels, the same for the same table."""
    known = messages.where("answer IS NOT NULL AND message_id IS NOT NULL").select("answer", language_code(F.col("answer_language")).alias("lang"), F.xxhash64("message_id").alias("h"))
    share = min(1.0, 4 * TRAIN_MESSAGES / max(1, messages.count()))
    rows = known.where(F.col("lang").isin(*LANGUAGES) & (F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)))).orderBy("h", "answer").limit(TRAIN_MESSAGES).collect()
    return [(r["answer"], r["lang"]) for r in rows]


def fitted(transcripts: DataFrame, source_cues: DataFrame, canonical_cues: DataFrame, messages: DataFrame | None = None) -> KernelModel:
    pairs = [(spoken(t), k) for t, k in labelled_sample(transcripts, source_cues, canonical_cues)]
    pairs += labelled_answers(messages) if messages is not None else []
    pairs = [(t, k) for t, k in pairs if len(plain_words(t)) >= 3]
    return fit([t for t, _ in pairs], [k for _, k in pairs])


def spoken(text: str | None) -> str:
    """The words of a cue without times, sounds and bracketed labels."""
    if not text or not _SIGNS.search(text):
        return text or ""
    return _ASIDE.sub(" ", _HIDDEN.sub("", text))


def word_evidence(places: np.ndarray, texts: list[str], grams: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row of each word of all texts, and what the n-grams that begin in it (or at the blank before) say for each language.

    Scaled like a text of the word's own n-grams, so that long words don't outweigh short ones by much.
    """
    _, starts, spots = grams
    blanks = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), np.uint32) == 32
    ends = np.cumsum([len(t) + 2 for t in texts]) - 1  # the blank after each text begins no word
    opens = blanks.copy()
    opens[ends] = False
    word_of = np.cumsum(opens) - 1
    gains = places[spots]
    gains = gains - gains.mean(1, keepdims=True)
    n = int(opens.sum())
    at = word_of[starts]
    count = np.bincount(at, minlength=n)
    sums = np.stack([np.bincount(at, weights=gains[:, k], minlength=n) for k in range(gains.shape[1])], 1)
    rows = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], np.cumsum(opens)[ends]])))
    return rows, sums / np.sqrt(np.maximum(count, 1))[:, None]


def _path(evidence: np.ndarray) -> list[int]:
    """The best language of each word, a change costing ``SWITCH``, by the Viterbi algorithm."""
    score, back = evidence[0], []
    for e in evidence[1:]:
        best = score.argmax()
        stay = score >= score[best] - SWITCH
        back.append(np.where(stay, np.arange(len(score)), best))
        score = np.where(stay, score, score[best] - SWITCH) + e
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def stretches(places: np.ndarray, texts: list[str], grams: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[list[tuple[int, int, int]]]:
    """For each text of plain words its stretches ``(first word, last word, language)``.

    A change of language pays only where some run of words speaks for another language than the whole by ``SWITCH`` at
    least; the Viterbi pass is left out where the largest such sum, found for all texts at once, stays below.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    full = [k for k, t in enumerate(texts) if t]
    if not full:
        return out
    if grams is None or len(full) < len(texts):
        texts = [texts[k] for k in full]
        grams = _grams(texts)
    rows, evidence = word_evidence(places, texts, grams)
    begins = np.searchsorted(rows, np.arange(len(texts)))
    whole = np.add.reduceat(evidence, begins, 0).argmax(1)
    against = np.cumsum(evidence - evidence[np.arange(len(rows)), whole[rows]][:, None], 0)
    apart = (np.ptp(against) + 1.0) * rows[:, None]  # sets the texts apart, so that one running minimum serves all
    before = np.concatenate([np.zeros((1, against.shape[1])), against[:-1]])
    lowest = np.minimum.accumulate(before - apart, 0) + apart
    mixed = np.maximum.reduceat((against - lowest).max(1), begins) >= SWITCH
    limits = np.append(begins, len(rows))
    for k, spot in enumerate(full):
        a, b = limits[k], limits[k + 1]
        if not mixed[k]:
            out[spot].append((0, int(b - a) - 1, int(whole[k])))
            continue
        path = _path(evidence[a:b])
        first = 0
        for i in range(1, len(path) + 1):
            if i == len(path) or path[i] != path[first]:
                out[spot].append((first, i - 1, path[first]))
                first = i
    return out


CLASSIFIED = "lang string, confidence double, parts array<struct<lang: string, confidence: double, words: int>>"


def classify(rows: DataFrame, keys: list[str], text: str, model: KernelModel, cues: bool = True) -> DataFrame:
    """``keys`` with ``lang, confidence`` of the text and ``parts``, its whole clauses in a language of their own.

    A text without a word has null language and no parts; otherwise the language is the best one, however short the text.
    Rows are kept as they are, repeated ones too.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                texts = [" ".join(plain_words(spoken(t) if cues else t or "")) for t in batch.column(len(keys)).to_pylist()]
                distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
                langs, sure, parts = of_texts(model, list(distinct))
                index = [distinct[t] for t in texts]
                flat = [p for i in index for p in parts[i]]
                inner = pa.StructArray.from_arrays([pa.array([p[k] for p in flat], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int32()))], names=["lang", "confidence", "words"])
                offsets = np.concatenate([[0], np.cumsum([len(parts[i]) for i in index])]).astype(np.int32)
                made = [pa.array([langs[i] for i in index], pa.string()), pa.array([sure[i] for i in index], pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), inner)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], names=[*keys, "lang", "confidence", "parts"])

    return spread(rows.select(*keys, F.col(text).alias("__text"))).mapInArrow(run, f"{fields}, {CLASSIFIED}")


def of_texts(model: KernelModel, texts: list[str]) -> tuple[list[str | None], list[float | None], list[list[tuple[str, float, int]]]]:
    """Language, confidence and clauses ``(language, confidence, words)`` of each text of plain words, at most ``BATCH``."""
    grams = _grams(texts)
    sure = confidence(model.scores(texts, grams))
    found: list[list[tuple[str, float, int]]] = [[] for _ in texts]
    clauses = []
    for i, (t, cut) in enumerate(zip(texts, stretches(model.places, texts, grams))):
        if len(cut) == 1:
            if cut[0][1] + 1 >= CLAUSE_WORDS:
                found[i].append((LANGUAGES[int(sure[i].argmax())], float(sure[i].max()), cut[0][1] + 1))
            continue
        words = t.split(" ")
        clauses += [(i, " ".join(words[a : b + 1]), b - a + 1) for a, b, _ in cut if b - a + 1 >= CLAUSE_WORDS]
    for (i, _, n), p in zip(clauses, model.confidence([c for _, c, _ in clauses])):
        found[i].append((LANGUAGES[int(p.argmax())], float(p.max()), n))
    return [LANGUAGES[int(p.argmax())] if t else None for t, p in zip(texts, sure)], [float(p.max()) if t else None for t, p in zip(texts, sure)], found


MIN_CONFIDENCE = 0.5


def transcript_languages(source_cues: DataFrame, canonical_cues: DataFrame, model: KernelModel) -> tuple[DataFrame, DataFrame]:
    """The classified cues of both tables, once each, and per transcript the language of most of them.

    Cues without a whole clause vote only where a transcript has no others; ties go to the more confident language. The
    confidence of a transcript is the share of its votes. Transcripts without words have no row. The classified cues are
    used twice, so they are written to the checkpoint folder.
    """
    known = "transcript_id IS NOT NULL AND sequence_number IS NOT NULL"
    number = F.col("sequence_number").cast("int").alias("sequence_number")
    a = source_cues.where(known).select("transcript_id", number, F.lit("source").alias("origin"), "text")
    b = canonical_cues.where(known).select("transcript_id", number, F.lit("canonical").alias("origin"), F.col("original_text").alias("text"))
    # Texts are read where they lie; re-delivered cues meet as short rows afterwards.
    told = classify(a.unionByName(b), ["transcript_id", "sequence_number", "origin"], "text", model)
    cues = cut_lineage(told.dropDuplicates(["transcript_id", "sequence_number", "origin"]))
    votes = cues.where("lang IS NOT NULL").groupBy("transcript_id", "lang").agg(F.sum(F.when(F.size("parts") > 0, 1).otherwise(0)).alias("clauses"), F.count("*").alias("cues"), F.sum("confidence").alias("sure"))
    main = votes.groupBy("transcript_id").agg(F.max_by("lang", F.struct("clauses", "cues", "sure", "lang")).alias("main"), (F.max("cues") / F.sum("cues")).alias("share"))
    return cues, main


def wrong_labels(transcripts: DataFrame, messages: DataFrame, source_cues: DataFrame, canonical_cues: DataFrame, model: KernelModel, is_empty) -> DataFrame:
    """``record_type, record_id, lang, confidence`` of transcripts and messages whose label is missing, no language or another
    one, and of cues of ``source_cues`` for each language other than its transcript's main one with a whole clause.

    Null ids are left out, repeated rows count once; transcripts without words and empty answers are no case.
    """
    cues, main = transcript_languages(source_cues, canonical_cues, model)
    known = main.select(F.col("transcript_id").alias("__t"), "main", "share")
    labelled = transcripts.where("id IS NOT NULL").dropDuplicates(["id"]).select("id", language_code(F.col("language_code")).alias("said"))
    wrong = labelled.join(known, F.col("id") == F.col("__t")).where("said IS NULL OR said <> main").select(F.lit("transcript").alias("record_type"), F.col("id").alias("record_id"), F.col("main").alias("lang"), F.col("share").alias("confidence"))
    full = is_empty(messages.where("message_id IS NOT NULL AND answer IS NOT NULL").select("message_id", "answer", "answer_language"))
    told = classify(full.withColumn("said", language_code(F.col("answer_language"))), ["message_id", "said"], "answer", model, cues=False)
    wrongly = told.where("lang IS NOT NULL AND (said IS NULL OR said <> lang)").dropDuplicates(["message_id"])
    answers = wrongly.select(F.lit("message").alias("record_type"), F.col("message_id").alias("record_id"), "lang", "confidence")
    inside = cues.where((F.col("origin") == "source") & (F.size("parts") > 0)).select("transcript_id", "sequence_number", F.explode("parts").alias("p")).where(F.col("p.confidence") >= MIN_CONFIDENCE)
    foreign = inside.join(known, F.col("transcript_id") == F.col("__t")).where(F.col("p.lang") != F.col("main"))
    stretches_ = foreign.groupBy("transcript_id", "sequence_number", "p.lang").agg(F.max("p.confidence").alias("confidence"))
    cued = stretches_.select(F.lit("cue").alias("record_type"), F.concat_ws(":", "transcript_id", "sequence_number").alias("record_id"), "lang", "confidence")
    return wrong.unionByName(answers).unionByName(cued)
