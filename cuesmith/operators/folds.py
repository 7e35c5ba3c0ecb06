"""Sequential operators: one pass over the ordered rows of each entity with bounded state.

Where a row's treatment depends on what was made of all rows before it, an entity can't be cut. Its rows are streamed
in order through a state machine instead of being collected, so a long entity takes time but no memory. Captions and
chunks have places where nothing goes on; there a long entity is cut into parts that spread over tasks.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from uuid import NAMESPACE_URL, uuid5

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import uuid5 as uuid5_column
from ..session import stored
from ..settings import ChunkerConfig
from .ordered import before

WORD = re.compile(r"[^\W_]+")
ROLLING_GAP_MS = 250


def stream_fold(rows: DataFrame, entity: str, order: list[str], machine: Callable[[str], object], schema: str, part: str | None = None) -> DataFrame:
    """Feed the rows of each entity, in order, to ``machine(entity)``; its ``add(row)`` and ``close()`` give output tuples.

    With ``part``, a column of numbers, each part of an entity has a machine of its own, ``machine(entity, part)``, and the parts
    of a long entity spread over tasks.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    keys = [entity] if part is None else [entity, part]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, key = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                at = tuple(getattr(row, k) for k in keys)
                if now is None or at != key:
                    out += now.close() if now is not None else []
                    key, now = at, machine(*at)
                out += now.add(row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(now.close() if now is not None else [], columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _int(value) -> int | None:
    return None if pd.isna(value) else int(value)


class SegmentPacker:
    """Whole segments are packed until ``target`` words; the next chunk begins with the last ``overlap`` words.

    Segments that fit the overlap whole keep their text, one that is cut gives its last words in lower case. What is
    left at the end is a chunk even if it is overlap only.
    """

    def __init__(self, entity: str, target: int = 140, overlap: int = 30) -> None:
        self.entity, self.target, self.overlap = entity, target, overlap
        self.parts: list[tuple[str, int | None, int | None, int]] = []
        self.made = 0

    def _chunk(self) -> list[tuple]:
        text = " ".join(" ".join(p[0] for p in self.parts).split())
        self.made += 1
        return [(f"{self.entity}-{self.made:04d}", self.entity, text, self.parts[0][1], self.parts[-1][2])]

    def add(self, row) -> list[tuple]:
        text = " ".join((row.text or "").split())
        words = WORD.findall(text.lower())
        if not words:
            return []
        self.parts.append((text, _int(row.start_ms), _int(row.end_ms), len(words)))
        if sum(p[3] for p in self.parts) < self.target:
            return []
        out, kept, room = self._chunk(), [], self.overlap
        for part in reversed(self.parts):
            if room <= 0:
                break
            if part[3] <= room:
                kept.append(part)
                room -= part[3]
            else:
                last = WORD.findall(part[0].lower())[-room:]
                kept.append((" ".join(last), part[1], part[2], len(last)))
                break
        self.parts = kept[::-1]
        return out

    def close(self) -> list[tuple]:
        return self._chunk() if self.parts else []


CHUNKS = "chunk_id string, transcript_id string, text string, start_ms bigint, end_ms bigint"


def packed_segments(cues: DataFrame) -> DataFrame:
    """Chunks of whole cues, see :class:`SegmentPacker`; needs ``transcript_id, sequence_number, text, start_ms, end_ms``."""
    return stream_fold(cues.where("transcript_id IS NOT NULL"), "transcript_id", ["sequence_number"], SegmentPacker, CHUNKS)


def normal_text(text: str | None) -> str:
    plain = html.unescape(text or "").translate({ord(c): None for c in "​‌‍﻿"}).replace(" ", " ")
    return " ".join(unicodedata.normalize("NFKC", plain).split())


def without_rolled(before: str, text: str) -> str:
    """``text`` without the longest start of two words or more that ends ``before``, letter case aside."""
    a, b = before.casefold().split(), text.casefold().split()
    for size in range(min(len(a), len(b)), 1, -1):
        if a[-size:] == b[:size]:
            return " ".join(text.split()[size:])
    return text


class CaptionRoller:
    """Captions that roll: one that repeats the last kept one extends it, one that begins with its end loses that start."""

    def __init__(self, entity: str, part: int) -> None:
        self.entity, self.part, self.last, self.made, self.removed = entity, part, None, 0, 0

    def _out(self) -> list[tuple]:
        if self.last is None:
            return []
        text, start, end, source = self.last
        self.made += 1
        return [(self.entity, int(self.part), self.made - 1, source, text, start, end, self.removed)]

    def add(self, row) -> list[tuple]:
        text, start, end = normal_text(row.text), _int(row.start_ms), _int(row.end_ms)
        if not text or start is None or end is None:
            return []
        if self.last is not None and start <= self.last[2] + ROLLING_GAP_MS:
            kept = "" if self.last[0].casefold() == text.casefold() else without_rolled(self.last[0], text)
            if kept != text:
                self.removed += 1
            if not kept:
                self.last = (self.last[0], self.last[1], max(self.last[2], end), self.last[3])
                return []
            text = kept
        out = self._out()
        self.last = (text, start, end, row.text)
        return out

    def close(self) -> list[tuple]:
        return self._out()


ROLLED = "transcript_id string, part bigint, sequence_number int, original_text string, normalized_text string, start_ms bigint, end_ms bigint, removed_so_far int"
PART_CUES = 2048


def _parts_of(seen: DataFrame, opens: Column) -> DataFrame:
    """The parts of long transcripts, ``__t, __b, cut, earlier``: in each bucket of numbers the first cue that may begin one."""
    per = seen.groupBy("transcript_id", "bucket").agg(F.min(F.when(opens, F.col("sequence_number"))).alias("cut"))
    earlier = Window.partitionBy("transcript_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("earlier", F.max("cut").over(earlier)).where("cut IS NOT NULL OR earlier IS NOT NULL")
    return per.select(F.col("transcript_id").alias("__t"), F.col("bucket").alias("__b"), "cut", "earlier")


def _in_parts(cues: DataFrame, parts: DataFrame) -> DataFrame:
    """``cues`` with ``part``, -1 before the first cut. Few buckets have a row in ``parts``; it is written first, so that its size
    is known when it is joined."""
    at = (F.col("transcript_id") == F.col("__t")) & (F.floor(F.col("sequence_number") / PART_CUES) == F.col("__b"))
    part = F.when(F.col("sequence_number") >= F.col("cut"), F.col("cut")).otherwise(F.coalesce("earlier", F.lit(-1))).cast("long")
    return cues.join(stored(parts), at, "left").withColumn("part", part).drop("__t", "__b", "cut", "earlier")


def _caption_parts(cues: DataFrame) -> DataFrame:
    """A readable cue behind the first bucket that starts more than the rolling gap after all that was before it opens a caption
    whatever came before, so it may begin a part."""
    readable = F.col("text").rlike("[\\p{L}\\p{N}]") & ~F.contains("text", F.lit("&")) & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    narrow = cues.select("transcript_id", "sequence_number", "start_ms", "end_ms", F.coalesce(readable, F.lit(False)).alias("readable"), F.floor(F.col("sequence_number") / PART_CUES).alias("bucket"))
    seen = before(narrow, ["transcript_id"], "bucket", ["sequence_number"], until=("max", F.col("end_ms")))
    return _parts_of(seen, F.col("readable") & (F.col("bucket") > 0) & (F.col("start_ms") > F.col("until") + ROLLING_GAP_MS))


def canonical_cues(cues: DataFrame) -> DataFrame:
    """Canonical cues of source cues, see :class:`CaptionRoller`; blank texts and null times are left out.

    A long transcript is cut where captions can't roll on; numbers and counts of removed cues are added up over its parts.
    """
    cues = cues.where("transcript_id IS NOT NULL")
    placed = _in_parts(cues, _caption_parts(cues))
    rolled = stored(stream_fold(placed, "transcript_id", ["sequence_number"], CaptionRoller, ROLLED, part="part"))
    # One row a part from here; transcripts of one part need none.
    totals = rolled.groupBy(F.col("transcript_id").alias("__t"), F.col("part").alias("__p")).agg(F.count("*").alias("made"), F.max("removed_so_far").alias("removed"))
    earlier = Window.partitionBy("__t").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.withColumns({"made": F.sum("made").over(earlier), "removed": F.sum("removed").over(earlier)}).where("made IS NOT NULL")
    both = rolled.join(shifts, (F.col("transcript_id") == F.col("__t")) & (F.col("part") == F.col("__p")), "left")
    moved = lambda c, by: (F.col(c) + F.coalesce(by, F.lit(0))).cast("int").alias(c)
    return both.select("transcript_id", moved("sequence_number", "made"), "original_text", "normalized_text", "start_ms", "end_ms", moved("removed_so_far", "removed"))


class SectionCutter:
    """A section begins with the chunk that ends ``length`` ms or more after the section's first start."""

    def __init__(self, entity: str, length: int = 300_000) -> None:
        self.entity, self.length, self.start, self.section = entity, length, None, 0

    def add(self, row) -> list[tuple]:
        start, end = _int(row.start_ms), _int(row.end_ms)
        if self.start is None:
            self.start = start
        elif start is not None and end is not None and end - self.start >= self.length:
            self.section, self.start = self.section + 1, start
        return [(self.entity, int(row.window), self.section)]

    def close(self) -> list[tuple]:
        return []


def sections(chunks: DataFrame) -> DataFrame:
    return stream_fold(chunks.select("transcript_id", "window", "start_ms", "end_ms"), "transcript_id", ["window"], SectionCutter, "transcript_id string, window bigint, section int")


# What ends a sentence, and where a long one may be cut.
SENTENCE = re.compile(r".+?(?:[.!?。！？]+(?=\s|$)|$)", re.DOTALL)
MARK = re.compile(r"[.!?。！？]")
SOFT = re.compile(r"(?<=[,;:!?।。！？])\s+")


def split_long(text: str, most: int) -> list[str]:
    """``text``, cut at soft signs if it has more than ``most`` words, or between words where there are none."""
    if len(text.split()) <= most:
        return [text] if text else []
    parts = SOFT.split(text)
    parts = text.split() if len(parts) == 1 else parts
    out: list[str] = []
    now: list[str] = []
    for part in parts:
        if now and len(" ".join([*now, part]).split()) > most:
            out.append(" ".join(now))
            now = []
        now.append(part)
    return [*out, " ".join(now)]


def units_of(text: str, most: int) -> list[str]:
    """Sentences, those of more than ``most`` words cut at soft signs, or between words where there are none."""
    return [unit for m in SENTENCE.finditer(text) for unit in split_long(m[0].strip(), most)]


class SentenceJoiner:
    """Sentence units of an entity's cues read as one text: ``text, start, end, sources``.

    A sentence that no cue ends goes on in the next one, and its unit has all cues it lies in as sources. Where it lasts
    longer than ``longest_ms``, each of its cues is a unit with its whole text instead, as in the reference, so a cue
    shared with another sentence comes again there. Cues of an entity without any end of a sentence are units each.
    Only the open sentence is kept. Once a cue starts more than ``longest_ms`` after the sentence did, its cues are given
    out and no longer kept, as cues come in order of time.
    """

    def __init__(self, most: int, longest_ms: int) -> None:
        self.most, self.longest = most, longest_ms
        self.parts: list[str] = []
        self.cues: list[tuple[str, int, int, str]] = []
        self.begun = self.marked = self.too_long = False

    def _single(self, cue: tuple[str, int, int, str]) -> list[tuple]:
        return [(text, cue[1], cue[2], (cue[3],)) for text in split_long(cue[0], self.most)]

    def _sentence(self, whole: bool = True) -> list[tuple]:
        cues, text = self.cues, " ".join(self.parts)
        self.parts, self.cues = [], []
        if not cues:
            return []
        if not whole or self.too_long or cues[-1][2] - cues[0][1] > self.longest:
            return [x for cue in cues for x in self._single(cue)]
        sources = tuple(cue[3] for cue in cues)
        return [(x, cues[0][1], cues[-1][2], sources) for x in split_long(text, self.most)]

    def add(self, row) -> list[tuple]:
        text, start, end = " ".join((row.text or "").split()), _int(row.start_ms), _int(row.end_ms)
        if not text or start is None or end is None:
            return []
        # The blanks around a cue are those of the joined text; a match up to its end is a sentence that goes on.
        joined = f" {text} " if self.begun else f"{text} "
        self.begun, self.marked = True, self.marked or MARK.search(text) is not None
        out: list[tuple] = []
        for m in SENTENCE.finditer(joined):
            if part := m[0].strip():
                self.parts.append(part)
                self.cues.append((text, start, end, row.id))
                if m.end() < len(joined):
                    out += self._sentence()
                    self.too_long = False
        if self.cues and (self.too_long or start - self.cues[0][1] > self.longest):
            self.too_long = True
            out += self._sentence()
        return out

    def close(self) -> list[tuple]:
        return self._sentence(whole=self.marked or len(self.cues) == 1)


class HierarchyPacker:
    """Sentence units packed to children and, apart from them, to parents.

    A chunk ends before a unit that follows a gap, or would bring it over its words or duration, or when it has reached its
    target. The next one begins with whole units of up to ``overlap`` words, except after a gap, and only if units follow.
    """

    def __init__(self, entity: str, kind: str, target: int, most: int, longest_ms: int, overlap: int, gap_ms: int, unit_words: int) -> None:
        self.entity, self.kind, self.target, self.most, self.longest, self.overlap, self.gap = entity, kind, target, most, longest_ms, overlap, gap_ms
        self.now: list[tuple[str, int, int, tuple[str, ...], int]] = []
        self.fresh, self.made = False, 0
        self.sentences = SentenceJoiner(unit_words, longest_ms)

    def _chunk(self) -> list[tuple]:
        words, span = sum(u[4] for u in self.now), self.now[-1][2] - self.now[0][1]
        reason = "duration" if span > self.longest else "tokens" if words > self.most else None
        key = str(uuid5(NAMESPACE_URL, f"{self.entity}\n{self.kind}\n{self.made}"))
        self.made += 1
        ids = list(dict.fromkeys(source for u in self.now for source in u[3]))
        return [(key, self.entity, self.kind, self.made - 1, " ".join(u[0] for u in self.now), self.now[0][1], self.now[-1][2], words, ids, reason)]

    def put(self, text: str, start: int, end: int, sources: tuple[str, ...]) -> list[tuple]:
        unit, out = (text, start, end, sources, len(text.split())), []
        if self.now:
            gap = start - self.now[-1][2] > self.gap
            words = sum(u[4] for u in self.now)
            if gap or words + unit[4] > self.most or end - self.now[0][1] > self.longest or (words >= self.target and self.fresh):
                kept: list = []
                if self.fresh:
                    out = self._chunk()
                    room = self.overlap
                    for u in [] if gap else reversed(self.now):
                        if u[4] > room:
                            break
                        kept.insert(0, u)
                        room -= u[4]
                self.now, self.fresh = kept, False
        self.now.append(unit)
        self.fresh = True
        return out

    def add(self, row) -> list[tuple]:
        return [x for unit in self.sentences.add(row) for x in self.put(*unit)]

    def close(self) -> list[tuple]:
        out = [x for unit in self.sentences.close() for x in self.put(*unit)]
        return out + (self._chunk() if self.now and self.fresh else [])


class BothLevels:
    def __init__(self, entity: str, part: int, child: tuple, parent: tuple, gap_ms: int) -> None:
        self.part = int(part)
        self.levels = [HierarchyPacker(entity, kind, *sizes[:3], sizes[3], gap_ms, child[1]) for kind, sizes in (("child", child), ("parent", parent))]
        self.sentences = SentenceJoiner(child[1], child[2])  # the same units for both
        self.sentences.marked = self.part >= 0  # a part behind another follows the end of a sentence

    def _put(self, units: list[tuple]) -> list[tuple]:
        return [(*x, self.part) for level in self.levels for unit in units for x in level.put(*unit)]

    def add(self, row) -> list[tuple]:
        return self._put(self.sentences.add(row))

    def close(self) -> list[tuple]:
        return self._put(self.sentences.close()) + [(*x, self.part) for level in self.levels for x in level.close()]


HIERARCHY = "chunk_id string, transcript_id string, chunk_type string, sequence_number int, text string, start_ms bigint, end_ms bigint, token_count int, segment_ids array<string>, exception string"


def _sentence_parts(segments: DataFrame, gap_ms: int) -> DataFrame:
    """A cue behind the first bucket may begin a part if it starts more than the gap after the cue before it, which has the same
    bucket and ends a sentence: then neither a sentence nor an overlap goes on. Cues without words or times stand in no chunk."""
    mark = F.regexp_replace("text", "[\\s\\u00a0]+$", "").rlike("[.!?。！？]$")
    full = F.coalesce(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull() & F.col("text").rlike("[\\p{L}\\p{N}]"), F.lit(False))
    rows = segments.select(full.alias("full"), "transcript_id", "sequence_number", "id", "start_ms", "end_ms", mark.alias("ends"), F.floor(F.col("sequence_number") / PART_CUES).alias("bucket"))
    inside = Window.partitionBy("transcript_id", "bucket").orderBy("sequence_number", "id")
    seen = rows.withColumns({"__end": F.lag("end_ms").over(inside), "__ends": F.lag(F.col("ends") & F.col("full")).over(inside)})
    return _parts_of(seen, (F.col("bucket") > 0) & F.col("full") & F.col("__ends") & (F.col("start_ms") - F.col("__end") > gap_ms))


def hierarchical_chunks(segments: DataFrame, config: ChunkerConfig | None = None) -> DataFrame:
    """Children and parents of canonical segments ``id, transcript_id, sequence_number, text, start_ms, end_ms``.

    Units are sentences of the joined cues, see :class:`SentenceJoiner`; cues without times are left out.
    """
    c = config or ChunkerConfig()
    child = (c.child_target_tokens, c.child_max_tokens, c.child_max_duration_seconds * 1000, c.child_overlap_tokens)
    parent = (c.parent_target_tokens, c.parent_max_tokens, c.parent_max_duration_seconds * 1000, 0)
    gap = round(c.timing_gap_boundary_seconds * 1000)
    segments = segments.where("transcript_id IS NOT NULL")
    placed = _in_parts(segments, _sentence_parts(segments, gap))
    packed = stored(stream_fold(placed, "transcript_id", ["sequence_number", "id"], lambda entity, part: BothLevels(entity, part, child, parent, gap), f"{HIERARCHY}, part bigint", part="part"))
    # One row a kind and part from here; transcripts of one part need none.
    totals = packed.groupBy(F.col("transcript_id").alias("__t"), F.col("chunk_type").alias("__k"), F.col("part").alias("__p")).agg(F.count("*").alias("made"))
    earlier = Window.partitionBy("__t", "__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.withColumn("made", F.sum("made").over(earlier)).where("made IS NOT NULL")
    both = packed.join(shifts, (F.col("transcript_id") == F.col("__t")) & (F.col("chunk_type") == F.col("__k")) & (F.col("part") == F.col("__p")), "left")
    number = (F.col("sequence_number") + F.coalesce("made", F.lit(0))).cast("int")
    name = F.concat_ws("\n", "transcript_id", "chunk_type", number.cast("string"))
    moved = both.withColumns({"chunk_id": F.when(F.col("made").isNull(), F.col("chunk_id")).otherwise(uuid5_column(NAMESPACE_URL.hex, name)), "sequence_number": number})
    return moved.select(*[c.split()[0] for c in HIERARCHY.split(", ")])


def with_parents(chunks: DataFrame) -> DataFrame:
    """Children with ``parent_id``: the parent that shares most segments with them, the first of several."""
    links = chunks.select("chunk_type", "transcript_id", "chunk_id", "sequence_number", F.explode("segment_ids").alias("segment"))
    c = links.where("chunk_type = 'child'").select("transcript_id", "chunk_id", "segment")
    p = links.where("chunk_type = 'parent'").select(F.col("transcript_id").alias("__t"), F.col("chunk_id").alias("parent_id"), F.col("sequence_number").alias("__n"), F.col("segment").alias("__s"))
    shared = c.join(p, (F.col("transcript_id") == F.col("__t")) & (F.col("segment") == F.col("__s"))).groupBy("chunk_id", "parent_id", "__n").agg(F.count("*").alias("n"))
    best = shared.groupBy(F.col("chunk_id").alias("__c")).agg(F.max_by("parent_id", F.struct("n", -F.col("__n"))).alias("parent_id"))
    return chunks.where("chunk_type = 'child'").join(best, F.col("chunk_id") == F.col("__c"), "left").drop("__c")


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_units(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: units_of(" ".join((t or "").split()), 12))
