"""Speaker turns of speech transcripts.

A grammar reads each cue: times, sound annotations and fillers are dropped, speaker labels and marks of a change of
speaker cut it into utterances, and the label is brought to one name per person, role or number. Cue times are repaired
by isotonic regression within file segments (stretches between resets of the clock). Utterances of one speaker in a row
are merged into turns, and a turn takes the repaired times of its cues. A transcript is walked in spans: buckets of
sequence numbers, several together where times contradict each other across their edges, so that the fit of a span is
the fit of its file segments. Turns that reach over the edge of a span are joined afterwards.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .lookalikes import IGNORABLE
from .repeats import edits_within
from .streams import bucket_of, by_bucket

RESET_MS = 30_000
"""A start this much before the one of the cue before is a reset of the clock, less is an error of the time."""

# Words of the five languages, accents folded.
NUMBERED = ("speaker", "nguoi noi", "hablante", "intervenant", "intervenante", "sprecher", "sprecherin", "locuteur", "locutor", "orador", "voice", "giong", "spk")
ROLES = (
    "moderator", "moderatorin", "moderateur", "moderatrice", "moderador", "moderadora", "host", "hostess", "guest", "mc", "nguoi dan", "nguoi dan chuong trinh", "khach moi", "khach", "animateur", "animatrice", "invite", "invitee", "invitado", "invitada", "anfitrion", "anfitriona",
    "gast", "gastgeber", "gastgeberin", "interviewer", "narrator", "narrateur", "narratrice", "narrador", "narradora", "erzahler", "erzahlerin", "presenter", "presentateur", "presentatrice", "presentador", "presentadora", "giang vien", "sinh vien", "hoc vien", "dieu phoi", "giao vien", "teacher", "student", "audience", "question", "lecturer", "tutor",
)
HONORIFICS = ("co", "anh", "chi", "ong", "ba", "thay", "bac", "chu", "em", "ms", "mr", "mrs", "miss", "dr", "prof", "mme", "mlle", "m", "frau", "herr", "sr", "sra", "srta", "senor", "senora", "don", "dona", "ts", "gs")
NO_SPEAKERS = (
    "note", "notes", "example", "examples", "reminder", "warning", "step", "tip", "tips", "caution", "attention", "important", "summary", "hint", "remember", "question", "answer", "chapter", "part", "section", "slide", "item", "minute", "clip", "todo", "ps", "nb", "update", "edit", "source", "title", "topic", "figure", "table", "exercise", "definition", "conclusion", "result",
    "vi du", "luu y", "nhac nho", "canh bao", "buoc", "ghi chu", "chu y", "tom lai", "ket luan", "meo", "phan", "chuong", "muc", "cau hoi", "tra loi", "dinh nghia", "bai tap", "quan trong", "nguon",
    "remarque", "rappel", "exemple", "etape", "avertissement", "conseil", "resume", "chapitre", "partie", "astuce", "definition", "exercice",
    "nota", "ejemplo", "recordatorio", "atencion", "paso", "aviso", "advertencia", "consejo", "resumen", "capitulo", "parte", "ejercicio", "definicion", "importante", "pista",
    "hinweis", "beispiel", "erinnerung", "achtung", "schritt", "warnung", "tipp", "merke", "zusammenfassung", "kapitel", "teil", "anmerkung", "bemerkung", "wichtig", "ubung", "frage", "antwort",
)
#: A label in brackets with one of these words names a sound.
SOUNDS = tuple(
    "music musik musique musica nhac song singing laughter laughs laughing gelachter lachen rires rire risas risa cuoi applause applaudissements aplausos applaus clapping inaudible unverstandlich inintelligible ininteligible indistinct nghe noise noises bruit bruits ruido gerausch tieng silence silencio stille cough coughs coughing toux tos husten sigh sighs crosstalk static beep pause".split()
)
FILLERS = ("ừ", "ừm", "ờ", "ờm", "ưm", "um", "umm", "uh", "uhm", "er", "erm", "hm", "hmm", "mm", "mmm", "mhm", "ah", "euh", "heu", "äh", "ähm", "öh", "ehm", "hum")
#: Words too; fillers only where a comma or dots follow or nothing else stands in the cue.
SOMETIMES = ("à", "em", "eh", "ben", "bah", "este", "pues", "tja", "na", "thì là", "kiểu như", "you know", "like", "bueno")

_INVISIBLE = re.compile(f"[{IGNORABLE}]")

_TIME = re.compile(r"<\d{1,2}(?::\d{2}){1,2}(?:[.,]\d+)?>|\[\d{1,2}(?::\d{2}){1,2}(?:[.,]\d+)?\]|\(\d{1,3}(?::\d{2}){1,2}(?:[.,]\d+)?\)|(?<![\w:])\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?(?![\w:])(?:\s*[-–—](?=\s))?")
_CUT = re.compile(r"<\s*/?\s*v\b[^>]*>|♪[^♪\n]*♪?|<[^<>\n]*>|\[[^\[\]\n]*\]|\([^()\n]*\)|\{[^{}\n]*\}|\*[^*\n]+\*|>{2,}|\n|(?:(?<=\n)|^)\s*[-–—]\s+", re.IGNORECASE)
_LEAD = re.compile(r"[\s,.…]*(?:(?:" + "|".join(sorted(map(re.escape, FILLERS + SOMETIMES), key=len, reverse=True)) + r")(?!\w)[,.…]*\s*)*", re.IGNORECASE)
_COLON = re.compile(r"([^\W\d_][^:\n<>\[\]♪]{0,45}?)\s*:(?=\s|$)")
_DASH = re.compile(r"([^\W\d_][^:\n<>\[\]♪,.!?]{0,40}?)\s+[-–—](?=\s|$)")
_NUMBER = re.compile(r"(.*?)[\s_#]*0*(\d+)$")
_FILLER = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, FILLERS), key=len, reverse=True)) + r")(?!\w)(?:\.{2,}|[…,])?", re.IGNORECASE)
_MAYBE = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, SOMETIMES), key=len, reverse=True)) + r")(?!\w)(?:\.{2,}|[…,])", re.IGNORECASE)
_ANY_FILLER = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, FILLERS + SOMETIMES), key=len, reverse=True)) + r")(?!\w)|\s[,.;!?…]", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]")
#: Without any of these a cue is one utterance.
_MARKED = re.compile(f"[<>\\[(\\]{{*♪:\n–—{IGNORABLE}]|^\\s*-|\\s-(?:\\s|$)")
_ALONE = re.compile(r"[\W_]*(?:(?:" + "|".join(sorted(map(re.escape, FILLERS + SOMETIMES), key=len, reverse=True)) + r")[\W_]+)*", re.IGNORECASE)


@lru_cache(maxsize=1 << 14)
def folded(text: str) -> str:
    """Lower case without accents, blanks and low lines single."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower().replace("đ", "d")) if not unicodedata.combining(c))
    return " ".join(plain.replace("_", " ").split())


def _like_any(name: str, known: tuple[str, ...]) -> bool:
    return name in known or any(len(k) > 4 and edits_within(name, k, 1 if len(k) < 8 else 2) is not None for k in known)


@lru_cache(maxsize=1 << 14)
def speaker(label: str, bracketed: bool = False, dashed: bool = False) -> str | None:
    """The one name of the speaker a label stands for; None if it is no label.

    Numbered speakers are ``#n``, roles their folded words, persons their first name without honorific, folded.
    """
    name = folded(label.replace(".", " ").strip("-–—>: "))
    numbered = _NUMBER.match(name)
    if numbered:
        word = numbered[1].strip()
        return f"#{int(numbered[2])}" if word and _like_any(word, NUMBERED) else None
    words = name.split()
    if not words or len(words) > 4 or not all(w.replace("'", "").replace("-", "").isalpha() for w in words):
        return None
    if name in ROLES or _like_any(name, tuple(r for r in ROLES if len(r) > 6)):
        return name
    if name in NO_SPEAKERS or _like_any(name, tuple(k for k in NO_SPEAKERS if len(k) > 5)) or _like_any(name, NUMBERED):
        return None
    if bracketed and any(_like_any(w, SOUNDS) for w in words):
        return None
    titled = all(w[0].isupper() for w in label.replace("_", " ").split() if w[0].isalpha())
    if (dashed or bracketed) and not titled:
        return None
    while len(words) > 1 and words[0] in HONORIFICS:
        words = words[1:]
    return words[0] if len(words) <= 3 else None


def same_speaker(a: str | None, b: str | None) -> bool:
    """Names one edit apart are one name; numbers are not."""
    if a == b:
        return True
    if not a or not b or a[0] == "#" or b[0] == "#":
        return False
    return min(len(a), len(b)) >= 4 and edits_within(a, b, 1) is not None


#: The first words of fillers, and signs that end or surround words: without any of these words a text needs no closer look.
_FILLER_STARTS = frozenset(f.split()[0] for f in FILLERS + SOMETIMES)
_SIGNS = str.maketrans(dict.fromkeys(".,;:!?…\"'“”‘’«»()[]{}<>*-–—_/", " "))
_APART = (" ,", " .", " ;", " !", " ?", " …")


def clean_words(text: str) -> str:
    """Spoken text without fillers, or the empty string where nothing but fillers and signs is left."""
    single = " ".join(text.split())
    if _FILLER_STARTS.isdisjoint(single.lower().translate(_SIGNS).split()) and not any(sign in single for sign in _APART):
        return single.lstrip(" ,;–—-") if _WORD.search(single) else ""
    if not _ANY_FILLER.search(text):
        return single.lstrip(" ,;–—-") if _WORD.search(single) else ""
    if not any(map(str.isalnum, text)) or not any(map(str.isalnum, text[_ALONE.match(text + " ").end() :])):
        return ""
    text = _MAYBE.sub(" ", _FILLER.sub(" ", text))
    text = re.sub(r"\s+([,.;!?…])", r"\1", re.sub(r"\s+", " ", text)).strip()
    return text.lstrip(" ,;–—-")


def utterances(text: str | None) -> list[tuple[str, str | None, str]]:
    """``(kind, speaker, spoken text)`` in order; kind is ``""`` before any mark, ``named`` or ``change``."""
    if not text or not _MARKED.search(text):
        return [("", None, clean_words(text or ""))]
    text = _INVISIBLE.sub("", text).replace("\r\n", "\n")
    text = _TIME.sub(" ", text)
    out: list[list] = [["", None, ""]]
    at, expected = 0, True  # expected: a label may stand here
    while at <= len(text):
        if expected:
            begun = _LEAD.match(text, at).end()
            for pattern, dashed in ((_COLON, False), (_DASH, True)):
                m = pattern.match(text, begun)
                who = m and speaker(m[1], dashed=dashed)
                if who:
                    if out[-1][0] == "change" and not out[-1][2] and out[-1][1] is None and out[-1][3:]:
                        out.pop()  # the mark belongs to the label
                    out.append(["named", who, ""])
                    at = m.end()
                    break
            expected = False
            continue
        m = _CUT.search(text, at)
        if not m:
            out[-1][2] += text[at:]
            break
        out[-1][2] += text[at : m.start()] + " "
        token, at = m[0], m.end()
        if token.startswith(">>"):
            out.append(["change", None, "", True])
            expected = True
        elif token == "\n":
            expected = True
        elif token.strip() in ("-", "–", "—"):
            # A dash at the start of a line marks a speech only with a label behind it or one before it.
            expected = True
        else:
            inner = re.match(r"<\s*v\b[.\w]*\s+([^>]*)>", token, re.IGNORECASE)
            who = speaker(inner[1]) if inner else speaker(token[1:-1], bracketed=True) if token[0] == "[" else None
            if who:
                if out[-1][0] == "change" and out[-1][3:] and not out[-1][2].strip():
                    out.pop()
                out.append(["named", who, ""])
                colon = re.match(r"\s*:", text[at:])
                at += colon.end() if colon else 0
            elif not out[-1][2].strip():
                expected = True  # an annotation before a label
    return [(kind, who, clean_words(said)) for kind, who, said, *_ in out]


def isotonic(values: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence with least squared distance, by pooling adjacent violators."""
    means: list[float] = []
    sizes: list[int] = []
    for v in values:
        means.append(float(v))
        sizes.append(1)
        while len(means) > 1 and means[-2] > means[-1]:
            m, n = means.pop(), sizes.pop()
            means[-1] = (means[-1] * sizes[-1] + m * n) / (sizes[-1] + n)
            sizes[-1] += n
    return np.repeat(means, sizes)


def repaired_times(starts: np.ndarray, ends: np.ndarray, shift: int = 0, before: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Times in order: files put one after the other, starts fitted within each, missing ones taken from before.

    ``before`` is the last start known earlier, ``shift`` what the clock resets up to the first cue add.
    """
    known = np.maximum.accumulate(np.where(np.isnan(starts), 0, np.arange(1, len(starts) + 1)))
    s = np.where(known > 0, starts[known - 1], before)
    e = np.where(ends > s, ends, s)  # false for missing ends
    resets = np.flatnonzero(s[1:] < s[:-1] - RESET_MS) + 1
    moved = np.zeros(len(s))
    moved[resets] = e[resets - 1]
    moved = shift + np.cumsum(moved)
    fitted = s + moved
    cuts = [0, *resets.tolist(), len(s)]
    for a, b in zip(cuts, cuts[1:]):
        if (fitted[a + 1 : b] < fitted[a : b - 1]).any():
            fitted[a:b] = isotonic(fitted[a:b])
    fitted = np.rint(fitted)
    return fitted.astype(np.int64), (fitted + np.rint(e - s)).astype(np.int64)


PARTS = "transcript_id string, bucket int, part int, kind string, speaker string, first_number int, last_number int, text string, start_ms bigint, end_ms bigint, outer int"


def _parts(cues: dict[str, np.ndarray]) -> list[tuple]:
    key = (cues["transcript_id"][0], int(cues["bucket"][0]))
    begin, finish = repaired_times(cues["start_ms"].astype(float), cues["end_ms"].astype(float), int(cues["shift"][0]), float(cues["before"][0]))
    # Kind, speaker, first and last number, texts, start, end.
    parts: list[list] = [["", None, None, None, [], None, None]]
    for number, text, start, end in zip(cues["sequence_number"].tolist(), cues["text"].tolist(), begin.tolist(), finish.tolist()):
        for kind, who, said in utterances(text):
            now = parts[-1]
            if kind == "change" or kind == "named" and not (now[0] == "named" and same_speaker(now[1], who)):
                now = [kind, who, None, None, [], None, None]
                parts.append(now)
            if said:
                if now[2] is None:
                    now[2], now[5], now[6] = number, start, end
                now[3] = number
                now[4].append(said)
                now[6] = max(now[6], end)
    return [(*key, k, kind, who, first, last, " ".join(texts), start, end, int(k <= 1 or k == len(parts) - 1)) for k, (kind, who, first, last, texts, start, end) in enumerate(parts)]


def _spans(cues: DataFrame) -> DataFrame:
    """``transcript_id, number, span, shift, before`` of the buckets that are no span of their own, follow a reset of the clock
    or begin without a start: the first bucket of the span it is walked in, the sum of the clock resets before the span
    and the last start known before.

    An edge of buckets is open if a start before it is greater than one behind it in the same file segment. Only then a fit
    can reach over it, and the buckets go in one span.
    """
    inside = Window.partitionBy("transcript_id", "number").orderBy("sequence_number")
    across = Window.partitionBy("transcript_id").orderBy("number")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    start, until = F.col("start_ms"), F.greatest("start_ms", "end_ms")
    # Cues without a start take the one before, so they are no part of this; re-delivered cues have equal times.
    placed = cues.select("transcript_id", bucket_of(F.col("sequence_number")).alias("number"), "sequence_number", "start_ms", "end_ms")
    known = placed.where("start_ms IS NOT NULL").withColumns({"__s": F.lag(start).over(inside), "__e": F.lag(until).over(inside)})
    known = known.withColumn("__reset", F.coalesce(start < F.col("__s") - RESET_MS, F.lit(False)))
    resets = F.sum(F.col("__reset").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    known = known.withColumn("__n", resets).withColumn("__all", F.max("__n").over(Window.partitionBy("transcript_id", "number")))
    timed = known.groupBy("transcript_id", "number").agg(
        F.sum(F.when(F.col("__reset"), F.col("__e")).otherwise(0)).alias("within"), F.max("__n").alias("resets"),
        F.min("sequence_number").alias("opens_at"), F.min_by("start_ms", "sequence_number").alias("first"), F.max_by("start_ms", "sequence_number").alias("last"), F.max_by(until, "sequence_number").alias("until"),
        F.min(F.when(F.col("__n") == 0, start)).alias("head_least"), F.max(F.when(F.col("__n") == F.col("__all"), start)).alias("tail_most"),
    )
    # One row a bucket from here on; buckets without any start take part with nulls.
    every = placed.groupBy("transcript_id", "number").agg(F.min("sequence_number").alias("opening"))
    per = every.join(timed.withColumnsRenamed({"transcript_id": "__t", "number": "__b"}), (F.col("transcript_id") == F.col("__t")) & (F.col("number") == F.col("__b")), "left").drop("__t", "__b").fillna(0, ["within", "resets"]).withColumn("late", F.col("opens_at") > F.col("opening"))
    per = per.withColumns({"before": F.last("last", ignorenulls=True).over(earlier), "__until": F.last("until", ignorenulls=True).over(earlier)})
    per = per.withColumn("__at_edge", F.coalesce(F.col("first") < F.col("before") - RESET_MS, F.lit(False)))
    per = per.withColumn("__until_now", F.sum(F.col("resets") + F.col("__at_edge").cast("int")).over(across.rowsBetween(Window.unboundedPreceding, 0)))
    same_tail = Window.partitionBy("transcript_id", "__until_now").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    same_head = Window.partitionBy("transcript_id", F.col("__until_now") - F.col("resets")).orderBy("number").rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumns({"__most": F.max("tail_most").over(same_tail), "__least": F.min("head_least").over(same_head)})
    is_open = ~F.col("__at_edge") & (F.lag("__most").over(across) > F.col("__least"))
    shift = F.sum(F.col("within") + F.when(F.col("__at_edge"), F.col("__until")).otherwise(0)).over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("within")
    per = per.withColumns({"__opens": ~F.coalesce(is_open, F.lit(False)), "shift": shift})
    per = per.withColumn("span", F.last(F.when(F.col("__opens"), F.col("number")), ignorenulls=True).over(across))
    firsts = Window.partitionBy("transcript_id", "span").orderBy("number")
    per = per.withColumns({"shift": F.first("shift").over(firsts), "before": F.coalesce(F.first(F.when(F.coalesce("late", F.lit(True)), F.col("before"))).over(firsts), F.lit(0))})
    return per.where("span <> number OR shift <> 0 OR before <> 0").select(F.col("transcript_id").alias("__t"), F.col("number").alias("__b"), "span", "shift", "before")


def _turn_parts(cues: DataFrame) -> DataFrame:
    """Parts of turns, each within one span, with ``turn``, unique within a transcript, and ``marked``."""
    kept = cues.where("transcript_id IS NOT NULL AND sequence_number IS NOT NULL").select("transcript_id", F.col("sequence_number").cast("int").alias("sequence_number"), "text", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))
    # Few buckets have a row here. It is written before the join, so that its size is known: small enough, it is broadcast.
    spans = stored(_spans(kept))
    number = bucket_of(F.col("sequence_number"))
    placed = kept.join(spans, (F.col("transcript_id") == F.col("__t")) & (number == F.col("__b")), "left").withColumn("bucket", F.coalesce("span", number)).drop("__t", "__b", "span").fillna(0, ["shift", "before"])
    parts = by_bucket(placed, _parts, PARTS)
    # Inner parts are turns of their own; three parts a span meet in the window of a transcript.
    own = [F.when(F.col("outer") == 0, F.col(c)).otherwise(-1) for c in ("bucket", "part")]
    order = Window.partitionBy("transcript_id", *own).orderBy("bucket", "part")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("kind") != "", F.struct("kind", "speaker"))
    seen = parts.withColumns({"__last": F.last(mark, ignorenulls=True).over(earlier), "__first": F.row_number().over(order) == 1})
    a, b = F.col("__last.speaker"), F.col("speaker")
    close = (a == b) | ((F.least(F.length(a), F.length(b)) >= 4) & ~a.startswith("#") & ~b.startswith("#") & (F.levenshtein(a, b) <= 1))
    goes_on = F.when(F.col("kind") == "", ~F.col("__first")).when(F.col("kind") == "named", (F.col("part") == 1) & F.coalesce(F.col("__last.kind") == "named", F.lit(False)) & F.coalesce(close, F.lit(False))).otherwise(F.lit(False))
    counted = seen.withColumn("__n", F.sum(F.when(goes_on, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    named = counted.withColumn("turn", F.when(F.col("outer") == 1, F.concat(F.lit("o"), "__n")).otherwise(F.concat_ws("-", F.lit("i"), "bucket", "part")))
    # An unmarked transcript has outer parts only, and the first mark of a span is outer, so the window knows.
    whole = Window.partitionBy("transcript_id", *own)
    return named.withColumn("marked", F.max(F.col("kind") != "").over(whole))


def turns(cues: DataFrame) -> DataFrame:
    """One row for each turn with words: ``transcript_id, place, speaker, first_number, last_number, text, start_ms, end_ms,
    marked``. Turns of a transcript are ordered by ``place``; ``marked`` holds where it has any label or mark.

    Null keys are left out and re-delivered rows count once. Null, blank and annotation-only texts speak no words. Null
    times take those of the cue before. A null ``speaker`` is one without a name. Empty tables give no rows.
    """
    at = (F.col("bucket").cast("long") * (1 << 20) + F.col("part")).alias("at")
    parts = _turn_parts(cues).where("first_number IS NOT NULL OR kind <> ''").select("transcript_id", "turn", at, "speaker", "first_number", "last_number", "text", "start_ms", "end_ms", "marked")
    spoken = F.sort_array(F.collect_list(F.when(F.col("first_number").isNotNull(), F.struct("at", "text"))))
    per = parts.groupBy("transcript_id", "turn").agg(
        F.min("at").alias("place"), F.min_by("speaker", F.when(F.col("speaker").isNotNull(), F.col("at"))).alias("speaker"), F.min("first_number").alias("first_number"), F.max("last_number").alias("last_number"),
        F.array_join(F.transform(spoken, lambda x: x["text"]), " ").alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max("marked").alias("marked"),
    )
    return per.where("first_number IS NOT NULL").drop("turn")
