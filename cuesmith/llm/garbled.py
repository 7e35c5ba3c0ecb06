"""Texts decoded with a wrong character encoding: found, and restored where the bytes are still there.

The distinct words of the corpus with characters beyond ASCII are collected. Of each clean one, and of each run of such
characters in it, the garbled forms under all chains of wrong decodings are made. The words of the documents are joined
with this table by hash; what matches was garbled, and the clean original takes its place. An original is put back only
where its garbled form by the chain is the very text that stands there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The letters beyond ASCII of the five languages, and signs that sound texts use.
LETTERS = frozenset("àáâãèéêìíòóôõùúăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹýäöüßçñœæëïûîôÿ")
SIGNS = "‘’“”„«»‹›–—…•°£€½¾¼×±¿¡º²³§♪·©®™"
ASCII_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BETWEEN = frozenset("’–—…“”«»°")

# Decoders that a text in UTF-8, or in one of the single-byte sets of the West, may have met.
FROM_UTF8_HOLES = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp1258", "cp874")
FROM_UTF8 = ("latin-1", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8_r", "iso8859-2", "iso8859-15", "iso8859-9")
FROM_UTF8_WIDE = ("gb18030", "gbk", "big5", "cp950", "cp932", "euc_jp", "cp949")
FROM_WEST = ("cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859-2")
FROM_WEST_WIDE = ("gb18030", "big5", "cp932", "cp949")

_LOST = re.compile("[\x80-\xa0]")
_RUN = re.compile(r"[^\x00-\x7f]+")
_MIXED = re.compile(r"[A-Za-z][Ѐ-ӿͰ-Ͽ]|[Ѐ-ӿͰ-Ͽ][a-z]")
MARK = "�"

BLANK = "[ \\t\\n\\r]+"


def core(word: Column) -> Column:
    """The word without ASCII signs at its ends, every digit as 0: garbling leaves both alone."""
    return F.translate(F.btrim(word, F.lit(ASCII_SIGNS)), "123456789", "0" * 9)


def is_clean(word: str) -> bool:
    """Whether a word can be taken as sound: letters of the five languages, signs at the ends or where they belong, no
    capital beyond ASCII behind a small letter; or a word wholly of characters far from Latin, such as emoji."""
    inner = word.strip(SIGNS + ASCII_SIGNS)
    if MARK in word or _LOST.search(word):
        return False
    before = ""
    good = True
    for c in inner:
        if not c.isascii() and c not in BETWEEN:
            if c.lower() not in LETTERS or (c.isupper() and before.islower()):
                good = False
                break
        before = c
    if good:
        return True
    far = [c for c in inner if not c.isascii() and c not in BETWEEN]
    if any(c.isascii() and c.isalpha() for c in inner):
        return False
    if all("Ѐ" <= c <= "ӿ" for c in far):  # Cyrillic: of one case but for its first letter, basic letters only
        return all("А" <= c <= "я" or c in "ёЁ" for c in far) and (inner[1:].islower() or len(inner) == 1)
    return all(ord(c) >= 0x2E80 or c in "‍️" for c in far)


@lru_cache(maxsize=64)
def _holes(encoding: str) -> list[str]:
    """What each byte is decoded to; what the set leaves undefined becomes a control character."""
    return [bytes((b,)).decode(encoding, "ignore") or chr(b) for b in range(256)]


def _with_holes(data: bytes, encoding: str) -> str:
    return "".join(map(_holes(encoding).__getitem__, data))


@lru_cache(maxsize=1 << 14)
def garbled_forms(word: str) -> dict[str, str]:
    """Every garbled form of a word with the chain that makes it, the first chain for forms that several make."""
    out: dict[str, str] = {}

    def put(form: str, chain: str) -> None:
        if form != word and form:
            out.setdefault(form, chain)
            kept = _LOST.sub("", form)
            # Control characters and no-break spaces are often lost afterwards.
            if kept not in (form, word) and len(kept) > 1:
                out.setdefault(kept, chain + ", controls lost")

    data = word.encode()
    for e in FROM_UTF8_HOLES:
        put(_with_holes(data, e), f"utf-8 as {e}")
        put(data.decode(e, "replace"), f"utf-8 as {e}, holes marked")
        put(data.decode(e, "ignore"), f"utf-8 as {e}, holes lost")
    for e in FROM_UTF8:
        put(data.decode(e), f"utf-8 as {e}")
    for e in FROM_UTF8_WIDE:
        put(data.decode(e, "replace"), f"utf-8 as {e}")
        put(data.decode(e, "ignore"), f"utf-8 as {e}, rests lost")
    put(data.decode("ascii", "replace"), "utf-8 as ascii, marked")
    for a in ("latin-1", "cp1252"):
        for b in ("latin-1", "cp1252", "cp437", "mac_roman"):
            put(_with_holes(_with_holes(data, a).encode(), b), f"utf-8 as {a}, again utf-8 as {b}")
    try:
        west = word.encode("cp1252")
    except UnicodeEncodeError:
        return out
    marked = west.decode("utf-8", "replace")
    if MARK in marked:  # else the word would have been garbled and this its original
        put(marked, "cp1252 as utf-8")
    if any(c.isalpha() for c in word):
        for e in FROM_WEST:
            put(_with_holes(west, e), f"cp1252 as {e}")
        for e in FROM_WEST_WIDE:
            put(west.decode(e, "replace"), f"cp1252 as {e}")
    return out


def _table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forms of clean words, and of the runs beyond ASCII in them."""
    for words in batches:
        out = []
        for word, n in zip(words["core"], words["n"]):
            if is_clean(word):
                out += [(form, "word", word, chain, n) for form, chain in garbled_forms(word).items()]
                for run in set(_RUN.findall(word)):
                    out += [(form, "run", run, chain, n) for form, chain in garbled_forms(run).items()]
        yield pd.DataFrame(out, columns=["form", "kind", "original", "chain", "n"])


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What to look up for each word: itself, and its runs if it can't be taken as sound."""
    for words in batches:
        out = []
        for word, n in zip(words["core"], words["n"]):
            clean = is_clean(word)
            out.append((word, n, clean, "word", word))
            if not clean:
                out += [(word, n, clean, "run", run) for run in set(_RUN.findall(word))]
        yield pd.DataFrame(out, columns=["core", "n", "clean", "kind", "part"])


def _accept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Matches that hold. ``sure`` is false where the garbled form could be a sound word as well: it is one by its letters
    and more frequent than the original, or as long as the original, as forms of single-byte sets are. Other matches of
    the same chain in a document decide on those."""
    for rows in batches:
        kept = []
        for r in rows.itertuples(index=False):
            west = r.chain.startswith("cp1252 as")
            single = len(r.part) == 1 and r.part != MARK
            if r.kind == "word" and west and MARK not in r.core and not (len(r.core) > 1 and any(c.isascii() and c.isalpha() for c in r.core)):
                continue
            if r.kind == "run" and west and MARK not in r.part and not _MIXED.search(r.core):
                continue
            if r.kind == "run" and single and (not west and (r.core.startswith(r.part) or not r.part.isupper())):
                continue
            sure = not (r.clean and (west or r.original_n < r.n))
            kept.append((r.core, r.kind, r.part, r.original, r.chain, sure))
        yield pd.DataFrame(kept, columns=["core", "kind", "part", "original", "chain", "sure"])


def document_words(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``key, raw, core``: the distinct words of each document with characters beyond ASCII."""
    beyond = lambda t: F.octet_length(t) != F.char_length(t)
    words = F.array_distinct(F.filter(F.split(F.col(text), BLANK), beyond))
    documents = documents.where(beyond(F.col(text)))
    long = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.explode(words).alias("raw"))
    return long.withColumn("core", core(F.col("raw")))


def garbled_words(words: DataFrame) -> DataFrame:
    """``core, kind, part, original, chain, sure`` for the garbled words of the corpus, the best match of each part."""
    # The vocabulary is small beside the texts but many forms come of each word, so it is spread over all cores.
    distinct = words.groupBy("core").agg(F.count("*").alias("n")).repartition(max(8, words.sparkSession.sparkContext.defaultParallelism * 4), "core")
    table = distinct.mapInPandas(_table, "form string, kind string, original string, chain string, n bigint")
    # Of several originals of one form the most frequent counts.
    table = table.groupBy("form", "kind").agg(F.max(F.struct("n", "original", "chain")).alias("o"))
    table = table.select("form", F.col("kind").alias("__kind"), F.col("o.original").alias("original"), F.col("o.chain").alias("chain"), F.col("o.n").alias("original_n"))
    parts = distinct.mapInPandas(_look, "core string, n bigint, clean boolean, kind string, part string")
    matched = parts.join(table, (F.col("part") == F.col("form")) & (F.col("kind") == F.col("__kind")))
    return matched.select("core", "n", "clean", "kind", "part", "original", "chain", "original_n").mapInPandas(_accept, "core string, kind string, part string, original string, chain string, sure boolean")


def affected(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` of the documents with a garbled word, once each.

    Null and empty texts and null keys are never affected, empty tables give no rows, other columns are not read. Words
    are counted over all documents; a document repeated counts again.
    """
    words = document_words(documents, key, text)
    cores = garbled_words(words).where("sure").select(F.col("core").alias("__core")).distinct()
    return words.join(cores, F.col("core") == F.col("__core")).select(F.col("__key").alias(key)).distinct()


def _digits_back(core_fixed: str, raw: str) -> str:
    digits = iter(re.findall(r"[0-9]", raw))
    return re.sub("0", lambda m: next(digits, "0"), core_fixed)


def mend_word(raw: str, core_text: str, fixes: list[tuple[str, str, str]]) -> str:
    """The word with its garbled parts put right; a match of the whole word goes before those of its runs."""
    whole = [o for kind, _, o in fixes if kind == "word"]
    fixed = whole[0] if whole else _RUN.sub(lambda m: next((o for kind, part, o in fixes if kind == "run" and part == m[0]), m[0]), core_text)
    if MARK in core_text and not whole:
        fixed = core_text  # a lone mark can stand for many characters
    at = re.sub("[0-9]", "0", raw).find(core_text)
    return raw if at < 0 else raw[:at] + _digits_back(fixed, raw[at : at + len(core_text)]) + raw[at + len(core_text) :]


def restored(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, restored_text, chains, restorable`` of the affected documents; ``restorable`` if nothing garbled is left.

    A word that could be sound is put back only in a document where another word was surely garbled by its chain. Cases as in :func:`affected`; keys have to be unique here.
    """
    words = document_words(documents, key, text)
    fixes = garbled_words(words).groupBy(F.col("core").alias("__core")).agg(F.collect_list(F.struct("kind", "part", "original", "chain", "sure")).alias("fixes"))
    per = words.join(fixes, F.col("core") == F.col("__core")).groupBy("__key").agg(F.collect_list(F.struct("raw", "core", "fixes")).alias("words"))
    per = per.where(F.exists("words", lambda w: F.exists(w["fixes"], lambda f: f["sure"])))
    whole = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.col(text).alias("text")).join(per, F.col("__k") == F.col("__key")).select("__key", "text", "words")
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, t, found in zip(rows["__key"], rows["text"], rows["words"]):
                chains = {f["chain"] for w in found for f in w["fixes"] if f["sure"]}
                mended = {}
                for w in found:
                    fixes = [(f["kind"], f["part"], f["original"]) for f in w["fixes"] if f["sure"] or f["chain"] in chains]
                    if fixes:
                        mended[w["raw"]] = mend_word(w["raw"], w["core"], fixes)
                new = re.sub(r"[^ \t\n\r]+", lambda m: mended.get(m[0], m[0]), t)
                bad = MARK in new or any(raw == good for raw, good in mended.items())
                out.append((k, t, new, "; ".join(sorted(chains)), not bad))
            yield pd.DataFrame(out, columns=[key, "text", "restored_text", "chains", "restorable"])

    return whole.mapInPandas(run, f"{key} {kind}, text string, restored_text string, chains string, restorable boolean")
