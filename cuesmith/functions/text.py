"""Text functions as column expressions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The Unicode White_Space property.
BLANKS = "[\\u0009-\\u000d\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
WORD = "[\\p{L}\\p{N}]+"
#: Zero-width characters that normalising drops.
ZERO_WIDTH = "​‌‍﻿"
# Letters and words by which a question counts as Vietnamese.
VIETNAMESE_LETTERS = "[ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]"
VIETNAMESE_WORDS = ("không", "gì", "tại", "sao", "hãy", "video", "này", "trong")


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def fold_case(text: Column) -> Column:
    """Lower case with the sharp s spelt out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def shorten(text: Column, most: int) -> Column:
    """Squeezed text cut to ``most`` characters with three dots; shorter limits than the dots cut plainly."""
    plain = squeeze(text)
    if most <= 3:
        return F.substring(plain, 1, most)
    return F.when(F.char_length(plain) <= most, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, most - 3)), F.lit("...")))


def minutes_seconds(seconds: Column) -> Column:
    whole = F.greatest(F.floor(F.coalesce(seconds, F.lit(0))), F.lit(0)).cast("long")
    minutes = F.floor(whole / 60)
    return F.concat(F.lpad(minutes.cast("string"), F.greatest(F.length(minutes.cast("string")), F.lit(2)), F.lit("0")), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def long_duration(seconds: Column) -> Column:
    whole = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    hours, minutes, rest = F.floor(whole / 3600), F.floor((whole % 3600) / 60), whole % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    shown = F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), two(minutes), F.lit("m "), two(rest), F.lit("s"))).otherwise(F.concat(minutes.cast("string"), F.lit("m "), two(rest), F.lit("s")))
    return F.when(seconds.isNull(), F.lit("Unknown")).otherwise(shown)


def deep_link(video: Column, seconds: Column) -> Column:
    whole = F.greatest(F.floor(F.coalesce(seconds, F.lit(0))), F.lit(0)).cast("long")
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video, F.lit("&t="), whole.cast("string"), F.lit("s"))


def redact(text: Column, most: int = 300) -> Column:
    """Squeezed text without addresses and values of credentials, cut."""
    hidden = F.regexp_replace(squeeze(text), "(?i)https?://[^ ]+", "[redacted-url]")
    hidden = F.regexp_replace(hidden, "(?i)\\b(api[_-]?key|token|authorization|password|cookie) *[=:] *[^ ,;]+", "$1=[redacted]")
    return F.substring(hidden, 1, most)


def answer_language(text: Column, fallback: str = "en") -> Column:
    """``vi`` for any accented Latin vowel or marker word, else the fallback."""
    words = tokens(text)
    marked = F.lower(text).rlike(VIETNAMESE_LETTERS) | F.arrays_overlap(words, F.array(*map(F.lit, VIETNAMESE_WORDS)))
    return F.when(marked, "vi").otherwise(fallback)


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 identifier of a name in a namespace given as hex digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def trigrams(word: Column) -> Column:
    return F.when(F.char_length(word) <= 3, F.array(word)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(word) - 2, F.lit(1))), lambda i: F.substr(word, i, F.lit(3))))


def slug(text: Column, default: str = "untitled", most: int = 80) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(plain, 1, most), F.lit("")), F.lit(default))


def overlap_ratio(query: Column, document: Column) -> Column:
    asked = F.array_distinct(query)
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(asked, document)) / F.size(asked))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; vectors of different lengths give 0."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(product)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    below = norm(a) * norm(b)
    return F.when(below == 0, F.lit(0.0)).otherwise(dot(a, b) / below)


@F.pandas_udf(T.StringType())
def normalize(texts: pd.Series) -> pd.Series:
    """Entities decoded, zero-width characters dropped, compatibility forms composed, blanks single; null stays null."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        plain = html.unescape(text).translate({ord(c): None for c in ZERO_WIDTH}).replace(" ", " ")
        return " ".join(unicodedata.normalize("NFKC", plain).split())

    return texts.map(one)


@F.pandas_udf(T.StringType())
def fold_accents(texts: pd.Series) -> pd.Series:
    """Lower case without combining marks; letters without a decomposition stay."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn"))


# The headings that notes must have.
NOTE_HEADINGS = ("Mục tiêu bài học", "Khái niệm chính", "Giải thích", "Timestamp nên xem lại")


def usable_text(text: Column) -> dict[str, Column]:
    """Whether a generated text would do as a ``summary`` (35 words, last line ended), a ``short`` one (three bullets besides) or as
    ``notes`` (45 words and all headings)."""
    lines = F.split(text, "\n")
    full = F.filter(lines, lambda x: F.trim(x) != "")
    complete = F.coalesce(F.trim(F.try_element_at(full, F.lit(-1))).rlike("[.!?)\\]]$"), F.lit(False))
    words = F.size(F.filter(F.split(text, BLANKS), lambda w: w != ""))
    bullets = F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*]")))
    headed = F.lit(True)
    for h in NOTE_HEADINGS:
        headed = headed & F.contains(text, F.lit(h))
    summary = (words >= 35) & complete
    return {"summary": summary, "short": summary & (bullets >= 3), "notes": (words >= 45) & complete & headed}


def json_object(reply: Column) -> Column:
    """From the first brace of a reply to the last one, a code fence around it left out; null without one."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(reply), "^```[a-zA-Z]*\\s*", ""), "\\s*```$", "")
    return F.nullif(F.regexp_extract(bare, "(?s)(\\{.*\\})", 1), F.lit(""))


def language_rank(code: Column, preferred: tuple[str, ...]) -> Column:
    """Place of the first preferred language that the code is or begins with, from 1; one more than there are for others."""
    low = F.replace(F.lower(F.trim(code)), F.lit("_"), F.lit("-"))
    rank = F.lit(len(preferred) + 1)
    for i, k in reversed(list(enumerate(preferred, 1))):
        rank = F.when((low == k) | low.startswith(f"{k}-"), i).otherwise(rank)
    return rank


def sentence_spans(text: Column) -> Column:
    """Array of ``from_char, to_char, sentence``, blanks around a sentence left out; a mark ends one before a blank or the end."""
    pieces = F.regexp_extract_all(text, F.lit("(?s).+?(?:[.!?。！？]+(?=\\s)|$)"), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<from_char: bigint, to_char: bigint, sentence: string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        left = acc["at"] + F.char_length(p) - F.char_length(F.ltrim(p))
        right = acc["at"] + F.char_length(F.rtrim(p))
        one = F.array(F.struct(left.cast("long").alias("from_char"), right.cast("long").alias("to_char"), F.trim(p).alias("sentence")))
        return F.struct((acc["at"] + F.char_length(p)).cast("long").alias("at"), F.when(F.trim(p) == "", acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.aggregate(pieces, start, step, lambda a: a["out"])


def answer_fault(answer: Column, allowed: Column, language: Column) -> Column:
    """What is wrong with a structured answer, null if nothing: ``invalid_json`` for a null one, ``unknown_citation`` of a passage not
    given, ``language`` other than asked for, ``citations_without_evidence`` where it says there is none."""
    unknown = F.size(F.filter(answer["citations"], lambda c: ~F.array_contains(allowed, c["chunk_id"]))) > 0
    none = answer.isNull() | answer["answer"].isNull() | answer["citations"].isNull() | answer["insufficient_evidence"].isNull()
    return F.when(none, "invalid_json").when(unknown, "unknown_citation").when(F.lower(answer["answer_language"]) != F.lower(language), "language").when(answer["insufficient_evidence"] & (F.size(answer["citations"]) > 0), "citations_without_evidence")
