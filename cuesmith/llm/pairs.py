"""Defects of question and answer pairs, from clauses tagged by a conditional random field.

An answer is cut into clauses. A linear-chain conditional random field tags each as answer, refusal, echo of the
question, foreign or unfinished. Since a clause may be foreign and something else, it is decoded twice: without the tag
foreign for its part, and between answer and foreign for its language, by a field of its own that was fitted on languages
alone. The clauses of each tag make out the defects.

How a refusal is worded is learned from the messages themselves: answers that carry a warning of weak evidence are refusals
far more often than others. A logistic regression on the words of clauses learns to tell them, first from the warnings,
then from its own sure verdicts; what it says of a clause is a feature of the field.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from .languages import LANGUAGES, SEEDS, KernelModel, language_code, plain_words
from .lookalikes import table_form
from .turns import folded

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
TRAIN_MESSAGES = 4500
"""Messages without a warning that the models are trained on at most, by the hash of their ids."""
TRAIN_WARNED = 3000
"""Messages with one."""
TRAIN_SEQUENCES = 3000
LANGUAGE_SEQUENCES = 600
STEPS, RATE, PENALTY = 250, 0.1, 1e-3

# What stands for no answer, signs and accents left out.
PLACEHOLDERS = (
    "", "na", "n a", "null", "none", "nil", "nan", "undefined", "empty", "no answer", "not available", "not applicable", "tbd", "todo", "blank", "missing", "unknown", "answer", "no response", "no content",
    "khong co", "khong co cau tra loi", "khong tra loi", "chua co cau tra loi", "trong", "sin respuesta", "pas de reponse", "aucune reponse", "keine antwort", "ninguna", "keine", "aucune", "br", "p",
)

DANGLING = frozenset(
    "nhung va hoac bang voi cua la boi vi o de cho trong tren thi ma neu khi nhu gom the a an of and or but because with in to for from on at by that which as if when while so the pero y o con de en el la los las un una porque que para por sin et ou mais avec dans le les des du une parce pour sur und oder aber weil mit der die das ein eine zu fur auf von dass".split()
)

_INNER = re.compile(r"[“\"«„][^”\"»“]*[”\"»“]")
_DRESS = re.compile(r"(?:\s*(?:\[\d+\]|\(\d{1,3}(?::\d{2}){1,2}\)|[–—-]\s*(?=\[\d+\])|[^\w\s.,;:!?…()\[\]{}“”\"'«»„‘’<>/\\*–—-]))+\s*$")
_SPLIT = re.compile(r"(?<=[.!?…])(?<!\d\.)(?<![.]{2}(?=[?!]))[”\"»]*\s+(?=[^\W\d_]|[“\"«„¿¡]|\d+[.)]\s)|\n+")
_ENDS = re.compile(r"[.!?。！？][”\"»’')]*$")
_LIST_MARK = re.compile(r"(?:^|(?<=\s))(\d{1,2})[.)]$")
_TAG = re.compile(r"<[^<>]*>")


def bare(text: str) -> str:
    """Words of letters and digits without accents, in lower case, single blanks."""
    return " ".join(re.findall(r"[^\W_]+", folded(text)))


_PLENTY = re.compile(r"(?:[\W_]*[^\W_]){30}")


def is_empty(answer: str | None) -> bool:
    if answer and "<" not in answer and _PLENTY.match(answer):
        return False  # more letters than any placeholder has
    return answer is None or bare(_TAG.sub(" ", table_form(answer))) in PLACEHOLDERS


def clauses(question: str, answer: str) -> list[str]:
    """Sentences and lines of the answer, its dress at the end left out; a copy of the question at its start is one
    clause even where nothing divides it from what follows."""
    text = _DRESS.sub("", table_form(answer.replace("\n", "\x00")).replace("\x00", "\n")).strip()
    out = []
    asked = bare(question).split()
    words = list(re.finditer(r"[^\W_]+", text))
    while asked and len(words) > len(asked) and [bare(w[0]) for w in words[: len(asked)]] == asked:
        rest = text[words[len(asked)].start() :]
        out.append(text[: words[len(asked)].start()].strip())
        text = rest
        words = list(re.finditer(r"[^\W_]+", text))
    return out + [c.strip() for c in _SPLIT.split(text) if c and c.strip()]


def likeness(question: str, clause: str) -> float:
    """Share of words in common order; what announces the question is left out."""
    q, c = bare(question).split(), bare(clause).split()
    if len(c) > 1 and c[0] in ("q", "hoi", "question", "cau", "pregunta", "frage"):
        c = c[2:] if c[:2] == ["cau", "hoi"] else c[1:]
    elif c[:3] == ["ban", "hoi", "ve"] or c[:3] == ["you", "asked", "about"]:
        topic = c[3:]
        return 1.0 if topic and all(w in q for w in topic) else 0.8
    if not q or not c:
        return 0.0
    if set(c) <= set(q) and len(c) >= 0.7 * len(q):
        return 1.0
    return SequenceMatcher(None, q, c, autojunk=False).ratio()


def _open_item(text: str, part: str) -> bool:
    """Whether the part ends in the mark of a list item without its text: the item before is marked in the text."""
    m = _LIST_MARK.search(part)
    if not m:
        return False
    before = int(m[1]) - 1
    return m.start() == 0 or before == 0 and ":" in part or bool(re.search(rf"(?:^|\s){before}[.)]\s", text))


def _unclosed(text: str) -> bool:
    return any(text.count(a) > text.count(b) for a, b in ("()", "[]", "{}", "“”", "«»"))


WORDING_PLACES = 1 << 15
WORDING_PENALTY = 0.5
WORDING_SEEDS = 50.0
"""What a sentence of our own weighs against a clause of the sample."""
WORDING_STEPS = 150

# Sentences of our own, so that a refusal is known where no warning is.
REFUSALS = (
    "We do not comment on that.", "It is not something I may speak about.", "The recording gives me nothing to go on.", "There is no way for me to know this from the clip.", "I will not go into this.", "I am afraid nobody says anything on it.",
    "Chúng tôi xin không bình luận về việc đó.", "Tôi không có quyền nói về chuyện này.", "Đoạn phim không cho biết điều ấy.", "Mình không trả lời được đâu.", "Tôi chịu, không biết trả lời sao.",
    "Je ne suis pas en mesure de répondre.", "Je regrette, je ne peux rien dire là-dessus.", "Je refuse d'en parler.", "L'enregistrement ne dit rien à ce sujet.", "Je préfère me taire.", "Pardon, je ne peux pas vous répondre.", "Il ne m'est pas permis de traiter cela.",
    "Dazu kann ich nichts sagen.", "Ich bin nicht in der Lage, das zu beantworten.", "Das möchte ich lieber nicht beantworten.", "Die Aufnahme gibt darüber keine Auskunft.", "Es ist mir nicht erlaubt, darüber zu sprechen.",
    "No estoy en condiciones de responder.", "Lamento no poder ayudar con eso.", "No me corresponde hablar de ello.", "Perdone, no puedo contestarle.", "La grabación no dice nada al respecto.", "Prefiero no hablar de eso.",
)


#: Which of the sentences that anchor each language decline something.
REFUSING_SEEDS = dict.fromkeys(LANGUAGES, (4, 6, 8, 11, 12, 13, 14)) | {"vi": (4, 6, 8, 11, 12)}


def _wording(clause: str) -> list[int]:
    """Places of the runs of one to three words of a clause; what stands in quotation marks is somebody else's word."""
    words = ["^", *re.sub(r"\d+", "0", bare(_INNER.sub(" qq ", clause))).split(), "$"]
    return sorted({zlib.crc32(" ".join(words[i : i + n]).encode()) % WORDING_PLACES for n in (1, 2, 3) for i in range(len(words) - n + 1)})


def _flat(clauses_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [_wording(c) for c in clauses_]
    sizes = np.array([len(x) for x in found], int)
    return np.repeat(np.arange(len(found)), sizes), np.fromiter(chain.from_iterable(found), int, int(sizes.sum())), 1 / np.sqrt(np.maximum(sizes, 1))


@dataclass
class Wording:
    """How likely a clause is a refusal by its words."""

    weights: np.ndarray
    offset: float

    def chances(self, clauses_: list[str]) -> np.ndarray:
        rows, places, scale = _flat(clauses_)
        return 1 / (1 + np.exp(-np.bincount(rows, self.weights[places], len(clauses_)) * scale - self.offset))


def learned_wording(clauses_: list[str], warned: list[bool]) -> Wording:
    """Logistic regression on ``warned``, then twice on what the fit before holds for more likely than not; sentences of our
    own keep their side."""
    refusing = [*REFUSALS, *(SEEDS[k][i] for k in LANGUAGES for i in REFUSING_SEEDS[k])]
    plain = [x for k in LANGUAGES for i, x in enumerate(SEEDS[k]) if i not in REFUSING_SEEDS[k]]
    texts = [*clauses_, *refusing, *plain]
    known = np.arange(len(texts)) >= len(clauses_)
    y = np.concatenate([np.array(warned, float), np.ones(len(refusing)), np.zeros(len(plain))])
    weight = np.where(known, WORDING_SEEDS, 1.0)
    rows, places, scale = _flat(texts)
    w, offset = np.zeros(WORDING_PLACES), 0.0
    for _ in range(3):
        w, m, v = (np.zeros(WORDING_PLACES) for _ in range(3))
        share = (weight @ y) / weight.sum()
        offset = float(np.log(share / (1 - share)))
        p = y
        for step in range(1, WORDING_STEPS + 1):
            p = 1 / (1 + np.exp(-np.bincount(rows, w[places], len(texts)) * scale - offset))
            g = np.bincount(places, (weight * (y - p) * scale)[rows], WORDING_PLACES) - WORDING_PENALTY * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        y = np.where(known, y, p > 0.5).astype(float)
    return Wording(w, offset)


FEATURES = 22
FOREIGN_ONLY = (0, 9, 10)
"""Features that the second decoding sees: what a clause says has no part in the language it is in."""


def features(question: str, parts: list[str], foreign: list[bool], refused: np.ndarray) -> np.ndarray:
    """One row per clause; ``refused`` is the chance of each to be a refusal by its words."""
    x = np.zeros((len(parts), FEATURES), np.float32)
    text = "\n".join(parts)
    asked = tuple((bare(question).split() or [""])[k] for k in (0, -1))
    for i, part in enumerate(parts):
        plain = bare(part)
        like, last, no = likeness(question, part), i == len(parts) - 1, refused[i]
        ends = bool(_ENDS.search(part)) and not _open_item(text, part) and not part.endswith("..")
        words = plain.split()
        x[i, :] = [
            1, no >= 0.75, no >= 0.5, no >= 0.25,
            like >= 0.95, 0.85 <= like < 0.95, 0.8 <= like < 0.85, 0.6 <= like < 0.8, like < 0.6,
            foreign[i], not foreign[i], ends, last and not ends, last and ends, last and not ends and like >= 0.8,
            last and bool(words) and words[-1] in DANGLING and not ends, last and _unclosed(part), last and bool(re.search(r"[,;:(\[“«–—-]$|\.\.$|…$", part)), last and _open_item(text, part),
            i == 0, len(words) <= 3, like >= 0.7 and bool(words) and (words[0], words[-1]) == asked,
        ]
    return x


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class ChainField:
    """Linear-chain conditional random field: weights of features and of neighbouring tags, the wording it was fitted with and the
    field of the languages of clauses."""

    weights: np.ndarray
    moves: np.ndarray
    wording: Wording | None = None
    language: ChainField | None = None

    def decode(self, x: np.ndarray, allowed: tuple[str, ...]) -> list[str]:
        """The best tags by the Viterbi algorithm, of the allowed ones only."""
        closed = np.array([0.0 if t in allowed else -1e9 for t in TAGS])
        score = x @ self.weights + closed
        best, back = score[0], []
        for s in score[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(0))
            best = step.max(0) + s
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return [TAGS[k] for k in reversed(path)]


def train(sequences: list[tuple[np.ndarray, list[int]]]) -> ChainField:
    """Maximum likelihood by gradient steps; the expected counts come from the forward and backward pass."""
    n, length, k = len(sequences), max(len(y) for _, y in sequences), len(TAGS)
    x, y, there = np.zeros((n, length, FEATURES)), np.zeros((n, length), int), np.zeros((n, length), bool)
    for i, (rows, tags) in enumerate(sequences):
        x[i, : len(tags)], y[i, : len(tags)], there[i, : len(tags)] = rows, tags, True
    gold = np.eye(k)[y] * there[:, :, None]
    pairs = there[:, 1:]
    gold_moves = np.einsum("nli,nlj->ij", gold[:, :-1] * pairs[:, :, None], gold[:, 1:])
    w, t = np.zeros((FEATURES, k)), np.zeros((k, k))
    state = [np.zeros_like(p) for p in (w, w, t, t)]
    for step in range(1, STEPS + 1):
        s = (x @ w) * there[:, :, None]
        a, b = np.zeros((n, length, k)), np.zeros((n, length, k))
        a[:, 0] = s[:, 0]
        for i in range(1, length):
            new = _logsum(a[:, i - 1, :, None] + t[None], 1) + s[:, i]
            a[:, i] = np.where(there[:, i, None], new, a[:, i - 1])
        for i in range(length - 2, -1, -1):
            new = _logsum(t[None] + (s[:, i + 1] + b[:, i + 1])[:, None, :], 2)
            b[:, i] = np.where(there[:, i + 1, None], new, 0.0)
        z = _logsum(a[:, -1], 1)
        p = np.exp(a + b - z[:, None, None]) * there[:, :, None]
        both = a[:, :-1, :, None] + t[None, None] + (s[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]
        seen = (np.exp(np.minimum(both, 0)) * pairs[:, :, None, None]).sum((0, 1))
        grads = [np.einsum("nlf,nlk->fk", x, gold - p) / n - PENALTY * w, (gold_moves - seen) / n - PENALTY * t]
        for j, (param, g) in enumerate(zip((w, t), grads)):
            m, v = state[2 * j], state[2 * j + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            param += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return ChainField(w, t)


def made_sequences(pairs: list[tuple[str, str]], wording: Wording, count: int = TRAIN_SEQUENCES, seed: int = 11) -> list[tuple[np.ndarray, list[int]]]:
    """Answers with made defects: whole clauses of sample answers are put together with refusals, copies and cuts. By its
    words a clause of the sample is surely a refusal, surely none, or left out."""
    rnd = random.Random(seed)
    seen = [(q, c) for q, a in pairs for c in clauses(q, a) if _ENDS.search(c) and not c.endswith("..") and likeness(q, c) < 0.8]
    seen += [(f"What about {s.split()[-1]}?", s.capitalize() + ".") for group in SEEDS.values() for s in group]
    chances = wording.chances([c for _, c in seen])
    pool = [x for x, p in zip(seen, chances) if p < 0.4 and len(bare(x[1]).split()) > 4]
    refusals = [c for (_, c), p in zip(seen, chances) if p > 0.6] + list(REFUSALS)
    tag = {name: k for k, name in enumerate(TAGS)}
    made = []
    for _ in range(count if pool else 0):
        q, first = rnd.choice(pool)
        parts, tags = [first], [tag["answer"]]
        for _ in range(rnd.choice((0, 0, 1, 2))):
            parts.append(rnd.choice(pool)[1])
            tags.append(tag["answer"])
        kind = rnd.choice(("whole", "whole", "refusal", "echo", "echoed", "cut", "cut"))
        if kind == "refusal":
            at = rnd.choice((0, 0, len(parts)))
            parts, tags = ([rnd.choice(refusals)], [tag["refusal"]]) if rnd.random() < 0.6 else ([*parts[:at], rnd.choice(refusals), *parts[at:]], [*tags[:at], tag["refusal"], *tags[at:]])
        elif kind in ("echo", "echoed"):
            words = q.split()
            for _ in range(rnd.choice((0, 0, 1, 2)) if len(words) > 6 else 0):
                words[rnd.randrange(1, len(words) - 1)] = "clip"
            copy = rnd.choice(("{}", "Q: {}", "“{}”")).format(" ".join(words))
            copy = rnd.choice((copy, copy.upper(), copy.rstrip("?"), copy.lower()))
            parts, tags = ([copy], [tag["echo"]]) if kind == "echo" else ([copy, *parts], [tag["echo"], *tags])
        elif kind == "cut":
            words = parts[-1].split()
            cut = " ".join(words[: rnd.randint(1, max(1, len(words) - 1))]).rstrip(".!?”")
            parts[-1], tags[-1] = cut + rnd.choice(("", "", "", "…", "...", ",", ";", ":", " (", " “", " and", " nhưng", ": 1. abc 2.")), tag["unfinished"]
        made.append((q, parts, tags))
        if rnd.random() < 0.15:
            made.append((q, parts, [tag["foreign"]] * len(parts)))
    chances = iter(wording.chances([c for _, parts, _ in made for c in parts]))
    out = []
    for q, parts, tags in made:
        foreign = [t == tag["foreign"] for t in tags]
        x = features(q, parts, foreign, np.array([next(chances) for _ in parts]))
        out.append((_language_only(x) if all(foreign) else x, tags))
    return out


def _language_only(x: np.ndarray) -> np.ndarray:
    kept = np.zeros_like(x)
    kept[:, FOREIGN_ONLY] = x[:, FOREIGN_ONLY]
    return kept


def language_sequences(count: int = LANGUAGE_SEQUENCES, seed: int = 12) -> list[tuple[np.ndarray, list[int]]]:
    """Clauses by their languages alone, tagged answer or foreign: as many of the one as of the other, in answers wholly in
    either language and in mixed ones."""
    rnd = random.Random(seed)
    out = []
    for _ in range(count):
        share, n = rnd.choice((0.0, 0.5, 1.0)), rnd.choice((1, 1, 2, 3, 4, 6))
        foreign = [rnd.random() < share for _ in range(n)]
        x = np.zeros((n, FEATURES), np.float32)
        x[:, FOREIGN_ONLY] = [(1, f, not f) for f in foreign]
        out.append((x, [TAGS.index("foreign" if f else "answer") for f in foreign]))
    return out


def _is_warned() -> Column:
    return F.trim(F.regexp_replace(F.coalesce("groundedness_warning", F.lit("")), "[\\p{Z}\\p{C}]", "")) != ""


def fitted_field(messages: DataFrame) -> ChainField:
    """The field and the wording of refusals, fitted on at most ``TRAIN_MESSAGES`` and ``TRAIN_WARNED`` messages."""
    known = messages.where("answer IS NOT NULL AND question IS NOT NULL").select("question", "answer", _is_warned().alias("warned"), F.xxhash64("message_id").alias("h"))
    counts = {r["warned"]: r["n"] for r in known.groupBy("warned").agg(F.count("*").alias("n")).collect()}
    sample = []
    for warned, most in ((False, TRAIN_MESSAGES), (True, TRAIN_WARNED)):
        # About twice what is wanted is ordered, however many there are, so that tasks send little to the driver.
        share = min(1.0, 2 * most / max(1, counts.get(warned, 0)))
        rows = known.where((F.col("warned") == warned) & (F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)))).orderBy("h", "answer").limit(most).collect()
        sample += [(r["question"], r["answer"], warned) for r in rows if not is_empty(r["answer"])]
    cut = [(c, warned) for q, a, warned in sample for c in clauses(q, a)]
    wording = learned_wording([c for c, _ in cut], [w for _, w in cut])
    sequences = made_sequences([(q, a) for q, a, _ in sample], wording)
    field = train(sequences) if sequences else ChainField(np.zeros((FEATURES, len(TAGS))), np.zeros((len(TAGS), len(TAGS))))
    field.wording = wording
    field.language = train(language_sequences())
    return field


def judge(question: str, parts: list[str], refused: np.ndarray, own: list[str], sizes: list[int], expected: str | None, warned: bool, field: ChainField) -> tuple[list[str], list[str], list[str]]:
    """Defects, tags and languages' tags; ``own`` has the language of each clause, ``sizes`` its words."""
    foreign = [expected is not None and k != expected for k in own]
    x = features(question, parts, foreign, refused)
    tags = field.decode(x, ("answer", "refusal", "echo", "unfinished"))
    tongues = field.language.decode(_language_only(x), ("answer", "foreign"))
    defects = []
    if tags[-1] == "unfinished":
        defects.append("truncated")
    if "refusal" in tags and not warned:
        defects.append("refusal")
    if "echo" in tags and all(t == "echo" or n == 0 for t, n in zip(tags, sizes)):
        defects.append("copy")
    # A repeated question is in its own language whatever the answer is in; the rest of the words counts.
    weight = [0 if t == "echo" and "copy" not in defects else n for t, n in zip(tags, sizes)]
    if sum(weight) and sum(n for n, t in zip(weight, tongues) if t == "foreign") > sum(weight) / 2:
        defects.append("language")
    return defects, tags, tongues


def found_defects(messages: DataFrame, model: KernelModel, field: ChainField) -> DataFrame:
    """``message_id, defect`` for each defect of each message, once per id.

    A null question is taken as an empty one; messages with a null id are left out. A null, blank or placeholder answer
    is ``empty`` and nothing else. Blank warnings are none. Empty tables give no rows; other columns are not read.
    """
    shared = messages.sparkSession.sparkContext.broadcast((model, field))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, field = shared.value
        for whole in batches:
            for at in range(0, len(whole), 1024):
                out = []
                todo = []
                for r in whole.iloc[at : at + 1024].itertuples(index=False):
                    if is_empty(r.answer):
                        out.append((r.message_id, "empty"))
                        continue
                    question = r.question or ""
                    parts = clauses(question, r.answer)
                    if parts:
                        todo.append((r.message_id, question, parts, r.expected, bool(r.warned)))
                    else:
                        out.append((r.message_id, "empty"))
                texts = [" ".join(plain_words(t)) for _, q, parts, _, _ in todo for t in (q, " ".join(parts), *parts)]
                distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
                best = model.confidence(list(distinct)).argmax(1)
                said = list(dict.fromkeys(c for _, _, parts, _, _ in todo for c in parts))
                chances = dict(zip(said, field.wording.chances(said)))
                spot = 0
                for key, question, parts, expected, warned in todo:
                    mine = texts[spot : spot + 2 + len(parts)]
                    spot += 2 + len(parts)
                    asked, all_, *each = (LANGUAGES[int(best[distinct[t]])] for t in mine)
                    sizes = [len(t.split()) for t in mine[2:]]
                    # A clause of a few words is too short to tell: the answer's language stands for it.
                    own = [k if n >= 4 else all_ for k, n in zip(each, sizes)]
                    defects, _, _ = judge(question, parts, np.array([chances[c] for c in parts]), own, sizes, expected or (asked if mine[0] else None), warned, field)
                    out += [(key, d) for d in defects]
                yield pd.DataFrame(out, columns=["message_id", "defect"])

    kept = messages.where("message_id IS NOT NULL").select(
        "message_id", "question", "answer", language_code(F.col("answer_language")).alias("expected"), _is_warned().alias("warned")
    )
    # Messages sent again have the same defects and meet as short rows.
    return spread(kept).mapInPandas(run, "message_id string, defect string").distinct()


@F.pandas_udf(T.BooleanType())
def _is_empty(answers: pd.Series) -> pd.Series:
    return answers.map(is_empty).astype(bool)


def without_empty(messages: DataFrame) -> DataFrame:
    return messages.where(~_is_empty("answer"))
