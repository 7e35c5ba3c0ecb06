"""One consistent form for texts that look the same but differ in characters.

The sound words of the corpus form vocabulary tries: words of one script in composed characters without anything unseen.
A weighted edit automaton runs over a trie with every odd word: taking a look-alike letter, a full-width form, a ligature or
a composed accent for another spelling of it and skipping an ignorable character cost nothing, any other edit costs one. Only
spellings at no cost look the same. Of the entries reached, the Latin one is the canonical spelling, else the most frequent:
a Cyrillic word with some Latin letters comes out in Cyrillic if the corpus has it so. A word that reaches no entry is
spelt by the table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .splitting import WHITE_SPACE

# Characters that are not seen. Variation selectors and tags follow as ranges.
IGNORABLE = "\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180f\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f\\u3164\\ufe00-\\ufe0f\\ufeff\\uffa0"

# Letters of other scripts and the letters of the Latin script that look the same.
TWINS = {
    # Cyrillic, small and capital
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y", "ѵ": "v",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ѵ": "V", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    # Greek, small and capital
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Latin: capital eth and capital African d look like the capital d with stroke
    "Ð": "Đ", "Ɖ": "Đ",
}

_IGNORE = re.compile(f"[{IGNORABLE}]")
_BLANKS = re.compile(f"[{WHITE_SPACE}\x1c-\x1f]+")
#: A text without these is in the one form but for its blanks: ASCII and composed Latin letters and common signs stay.
UNSTABLE = f"[^\\u0021-\\u007e{WHITE_SPACE}\\u001c-\\u001f\\u00a1-\\u00ac\\u00ae-\\u00cf\\u00d1-\\u0188\\u018a-\\u024f\\u1ea0-\\u1ef9\\u2013-\\u201f\\u2026]"
#: Blanks that are not single spaces between words.
LOOSE = "[" + WHITE_SPACE.replace("\\u0020", "") + "\\u001c-\\u001f]|  |^ | $"
TRIE_PREFIX = 4
"""Words of one length that begin alike in this many letters, look-alikes taken for one, share a trie."""


def _free(char: str) -> str:
    """The ordinary spelling of one decomposed character, itself if it has none."""
    if char in TWINS:
        return TWINS[char]
    kind = unicodedata.decomposition(char)
    if kind.startswith(("<wide>", "<narrow>")) or "ﬀ" <= char <= "ﬆ":
        return unicodedata.normalize("NFKC", char)
    return char


def table_form(text: str) -> str:
    """The spelling by the table: ignorables left out, twins and widths replaced, accents composed, blanks single."""
    if text.isascii() and "\t" not in text and "\n" not in text and "  " not in text and text == text.strip() and text.isprintable():
        return text
    text = unicodedata.normalize("NFD", _IGNORE.sub("", text))
    text = unicodedata.normalize("NFC", "".join(map(_free, text)))
    return _BLANKS.sub(" ", text).strip(" ")


_TWINS_OF: dict[str, tuple[str, ...]] = {}
for _a, _b in TWINS.items():
    if unicodedata.normalize("NFD", _a) == _a:
        _TWINS_OF[_b] = (*_TWINS_OF.get(_b, ()), _a)


def letters(word: str) -> list[str]:
    """The decomposed characters of what is seen of a word, each in its ordinary spelling."""
    return [t for c in unicodedata.normalize("NFD", _IGNORE.sub("", word)) for t in unicodedata.normalize("NFD", _free(c))]


def script(char: str) -> str:
    """Cyrillic, Greek, or Latin for all else that has twins."""
    return "c" if "\u0400" <= char <= "\u052f" else "g" if "\u0370" <= char <= "\u03ff" else "l"


def is_sound(word: str) -> bool:
    """Whether a word may be an entry: composed, nothing unseen, no form that stands for an ordinary one, letters of one script."""
    if word.isascii():
        return True
    if unicodedata.normalize("NFC", word) != word or _IGNORE.search(word):
        return False
    scripts = {script(c) for c in word if c.isalpha()}
    return len(scripts) <= 1 and all(_free(c) == c or c in TWINS and script(c) != "l" for c in word)


class Trie:
    """A vocabulary as nested dictionaries of decomposed characters; ``END`` holds the spelling of an entry and its weight."""

    END = ""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int = 1) -> None:
        node = self.root
        for char in unicodedata.normalize("NFD", word):
            node = node.setdefault(char, {})
        node.setdefault(self.END, (word, count))

    def reached(self, word: str, most: int = 0) -> list[tuple[int, str, int]]:
        """``(cost, entry, count)`` of the entries within ``most`` edits by the weighted automaton.

        A state is a trie node with the least cost it was reached at. A letter leads on by itself and by any twin of it that
        the trie holds at no cost; by any other letter, past a letter of the word or past one of the trie it costs one.
        """

        def close(states: dict[int, tuple[dict, int]]) -> dict[int, tuple[dict, int]]:
            queue = [s for s in states.values() if s[1] < most]
            while queue:
                node, cost = queue.pop()
                for char, child in node.items():
                    if char != self.END and cost + 1 <= most and states.get(id(child), (child, most + 1))[1] > cost + 1:
                        states[id(child)] = (child, cost + 1)
                        queue.append(states[id(child)])
            return states

        def put(states: dict[int, tuple[dict, int]], node: dict, cost: int) -> None:
            if cost <= most and states.get(id(node), (node, most + 1))[1] > cost:
                states[id(node)] = (node, cost)

        states = close({id(self.root): (self.root, 0)})
        for t in letters(word):
            same = (t, *_TWINS_OF.get(t, ()))
            step: dict[int, tuple[dict, int]] = {}
            for node, cost in states.values():
                for char in same:
                    if char in node:
                        put(step, node[char], cost)
                if cost < most:
                    put(step, node, cost + 1)
                    for char, child in node.items():
                        if char != self.END and char not in same:
                            put(step, child, cost + 1)
            states = close(step)
            if not states:
                break
        return sorted((cost, *node[self.END]) for node, cost in states.values() if self.END in node)

    def canonical(self, word: str) -> str | None:
        """The entry that looks like the word: the Latin one, else the most frequent, the first in code point order of equals."""
        alike = [(not all(script(c) == "l" for c in entry), -count, entry) for _, entry, count in self.reached(word)]
        return min(alike)[2] if alike else None


def _canonical_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by trie, vocabulary entries of a trie first; one trie is held at a time."""
    at, trie = None, Trie()
    for rows in batches:
        out = []
        for place, entry, odd, word, n in rows[["trie", "entry", "odd", "word", "n"]].itertuples(index=False):
            if place != at:
                at, trie = place, Trie()
            if entry:
                trie.add(word, n)
            elif odd:
                out.append((word, trie.canonical(word) or table_form(word)))
        yield pd.DataFrame(out, columns=["word", "canonical"])


@F.pandas_udf(T.StructType([T.StructField("trie", T.StringType()), T.StructField("sound", T.BooleanType())]))
def _place(words: pd.Series) -> pd.DataFrame:
    seen = [letters(w) for w in words]
    return pd.DataFrame({"trie": [f"{len(x)} {''.join(x[:TRIE_PREFIX])}" for x in seen], "sound": [bool(x) and is_sound(w) for w, x in zip(words, seen)]})


def canonical_words(words: DataFrame) -> DataFrame:
    """``word, canonical`` for the distinct words in column ``word`` with characters that may look like others; equal
    canonical spellings mean that words look the same.

    Which entries a word reaches depends on its letters with look-alikes taken for one, so all words of a class reach the
    same entries and get the same spelling, or all of them none and the same form of the table.
    """
    distinct = words.where("word IS NOT NULL AND word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    placed = distinct.withColumn("p", _place("word")).select("word", "n", "p.trie", F.col("p.sound"), F.col("word").rlike(UNSTABLE).alias("odd"))
    # A sound word beyond Latin is an entry and is looked up as well.
    roles = F.filter(F.array(F.when(F.col("sound"), True), F.when(F.col("odd"), False)), lambda x: x.isNotNull())
    ordered = placed.withColumn("entry", F.explode(roles)).repartition("trie").sortWithinPartitions(F.col("trie"), F.col("entry").desc(), F.col("word"))
    return ordered.select("trie", "entry", "odd", "word", "n").mapInPandas(_canonical_words, "word string, canonical string")


def blank_split(text: Column) -> Column:
    """Words between blanks, ignorable characters kept."""
    return F.filter(F.split(text, f"[{WHITE_SPACE}\\x1c-\\x1f]+"), lambda w: w != "")


def _vocabulary(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode(F.split("text", f"[{WHITE_SPACE}\\x1c-\\x1f]+")).alias("word"))


def _plain_form(text: Column) -> Column:
    """The form of a text of stable characters: its blanks made single."""
    return F.when(text.rlike(LOOSE), F.array_join(blank_split(text), " ")).otherwise(text)


def _odd_forms(rows: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """``rows``, whose ``text`` has odd characters, with ``form``. The odd words alone are looked up by a join and come
    back to their row as a map. Nulls in ``key`` or ``text`` are not allowed here."""
    odd_words = F.array_distinct(F.filter(blank_split(F.col("text")), lambda w: w.rlike(UNSTABLE)))
    wanted = rows.select(F.col(key).alias("__key"), F.explode(odd_words).alias("__word"))
    found = wanted.join(canonical_words(words), F.col("__word") == F.col("word")).groupBy("__key").agg(F.map_from_entries(F.collect_set(F.struct("word", "canonical"))).alias("__map"))
    joined = rows.join(found, F.col(key) == F.col("__key"), "left")
    mended = F.filter(F.transform(blank_split(F.col("text")), lambda w: F.coalesce(F.col("__map")[w], w)), lambda w: w != "")
    return joined.withColumn("form", F.array_join(mended, " ")).drop("__key", "__map")


def canonical_texts(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key`` and for each text column the same text in the one form; texts are equal in it exactly if they read the same.

    Null stays null; a text of nothing visible becomes empty. Rows repeated under one key count once; those with a null
    ``key`` are left out. Letter case, accents, superscripts, punctuation and entities as written are kept.
    """
    kept = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *columns)
    texts = kept.select("key", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("text")) for i, c in enumerate(columns)])).alias("p"))
    place = F.concat_ws(":", "p.i", F.col("key").cast("string"))
    long = texts.where("p.text IS NOT NULL").select(place.alias("place"), "key", F.col("p.i").alias("i"), F.col("p.text").alias("text"))
    odd = F.col("text").rlike(UNSTABLE)
    forms = long.where(~odd).withColumn("form", _plain_form(F.col("text"))).unionByName(_odd_forms(long.where(odd), "place", _vocabulary(long)))
    wide = forms.groupBy("key").agg(*[F.max(F.when(F.col("i") == i, F.col("form"))).alias(c) for i, c in enumerate(columns)])
    none = kept.where(" AND ".join(f"{c} IS NULL" for c in columns)).select("key", *columns).distinct()
    return wide.unionByName(none.join(wide.select(F.col("key").alias("__k")), F.col("key") == F.col("__k"), "left_anti")).withColumnRenamed("key", key)


def _alike(cues: DataFrame) -> DataFrame:
    """``transcript_id, form, id, string`` of the cues in classes of more than one string, once per id.

    Texts and forms are kept by 128 bits of their hash, and read once: rows of stable characters, nearly all, get their form
    in place, the others keep their text until their words are looked up. The least and greatest string of a class tell
    whether it is mixed, so no class is collected.
    """
    own = cues.where("original_text IS NOT NULL AND id IS NOT NULL AND transcript_id IS NOT NULL").select("id", "transcript_id", F.col("original_text").alias("text"))
    digest = lambda c: F.unhex(F.md5(c))
    marked = own.withColumn("odd", F.col("text").rlike(UNSTABLE))
    kept = stored(marked.select("id", "transcript_id", digest(F.col("text")).alias("string"), F.when(~F.col("odd"), digest(_plain_form(F.col("text")))).alias("form"), F.when(F.col("odd"), F.col("text")).alias("text")))
    odd = _odd_forms(kept.where("text IS NOT NULL").drop("form"), "id", _vocabulary(own))
    known = kept.where("text IS NULL").drop("text").unionByName(odd.select("id", "transcript_id", "string", digest(F.col("form")).alias("form")))
    known = stored(known)
    ends = known.groupBy("transcript_id", "form").agg(F.min("string").alias("least"), F.max("string").alias("most")).where("least <> most")
    mixed = ends.select(F.col("transcript_id").alias("__t"), F.col("form").alias("__f"))
    return known.join(mixed, (F.col("transcript_id") == F.col("__t")) & (F.col("form") == F.col("__f")), "left_semi").distinct()


def lookalike_pairs(cues: DataFrame) -> DataFrame:
    """Pairs of different cues of a transcript whose ``original_text`` reads the same but is another string.

    ``segment_id_a`` is the smaller id. Cues with a null text or key pair with none, repeated rows count once, empty tables
    give no rows. :func:`lookalike_classes` gives the same links without a row for each.
    """
    few = stored(_alike(cues))
    a, b = few.alias("a"), few.alias("b")
    same = (F.col("a.transcript_id") == F.col("b.transcript_id")) & (F.col("a.form") == F.col("b.form")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.string") != F.col("b.string"))
    return a.join(b, same).select(F.col("a.id").alias("segment_id_a"), F.col("b.id").alias("segment_id_b"))


def lookalike_classes(cues: DataFrame) -> DataFrame:
    """``id, transcript_id, class_id, links`` of each cue that has a partner in :func:`lookalike_pairs`.

    ``class_id`` is the least id of the cues that read the same, ``links`` the number of them with another string. Cases as
    there; a class is counted by its strings and never collected.
    """
    few = stored(_alike(cues))
    strings = few.groupBy(F.col("transcript_id").alias("__t"), F.col("form").alias("__f"), F.col("string").alias("__s")).agg(F.count("*").alias("own"), F.min("id").alias("first"))
    classes = strings.groupBy(F.col("__t").alias("__ct"), F.col("__f").alias("__cf")).agg(F.sum("own").alias("all"), F.min("first").alias("class_id"))
    both = few.join(strings, (F.col("transcript_id") == F.col("__t")) & (F.col("form") == F.col("__f")) & (F.col("string") == F.col("__s")))
    both = both.join(classes, (F.col("transcript_id") == F.col("__ct")) & (F.col("form") == F.col("__cf")))
    return both.select("id", "transcript_id", "class_id", (F.col("all") - F.col("own")).alias("links"))
