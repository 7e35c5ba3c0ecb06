"""Encoding of texts by a public byte-level BPE vocabulary, with DuckDB recursive queries per partition.

A text is cut into words by the tokenizer's pattern. The distinct words of a batch become token-position rows, one per
byte, of a DuckDB table. A recursive query joins neighbouring positions with the merge table and contracts pairs of
minimum rank, the leftmost first where they overlap, until no pair of a word is left; an ordered aggregation gives the
ids, and another one decodes. The recursion is keyed by word and position, so it holds one state of each word and not
one of every round.

A pair can only lose its tokens to a merge within a token's length of it. So the minimum is taken over a stretch of a word
and its two neighbours, each at least twice as long as the longest token that can occur there: a word of ordinary length
is one stretch, and a very long one contracts in many places in a round.

Nothing is shuffled: a partition encodes its own distinct words, which it keeps for its further batches.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

# The pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEPT_WORDS = 200_000
"""Encoded words that a partition keeps at most; beyond it they are forgotten and encoded anew."""
BATCH_CHARS = 4_000_000
STATE_BYTES = 400_000
"""Bytes of words, each a row, that one recursion takes; a longer word is a recursion of its own."""
MEMORY = 1 << 29
MEMORY_PER_BYTE = 700
"""Memory of the database: the larger of half a gigabyte and this for each byte of the longest word at hand."""

_CONTRACT = """
WITH RECURSIVE state(w, p, g, t) USING KEY (w, p) AS (
  SELECT w, p, g, t FROM start
  UNION
  SELECT w, p, g, t FROM (
    WITH paired AS (
      SELECT s.*, lead(s.t) OVER word AS next_t, lead(s.p) OVER word AS next_p
      FROM recurring.state s WHERE s.t IS NOT NULL AND s.w IN (SELECT w FROM state)
      WINDOW word AS (PARTITION BY s.w ORDER BY s.p)
    ),
    ranked AS (SELECT x.*, m.r FROM paired x LEFT JOIN merges m ON m.a = x.t AND m.b = x.next_t),
    least AS (SELECT w, g, min(r) AS r FROM ranked GROUP BY w, g),
    near AS (SELECT w, g, least(r, lag(r) OVER word, lead(r) OVER word) AS lowest FROM least WINDOW word AS (PARTITION BY w ORDER BY g)),
    -- Overlapping pairs of one rank form an island, of which every second pair is taken from the left.
    islands AS (
      SELECT x.*, lowest, row_number() OVER (PARTITION BY x.w ORDER BY p) - row_number() OVER (PARTITION BY x.w, x.r ORDER BY p) AS island
      FROM ranked x JOIN near USING (w, g)
    ),
    counted AS (
      SELECT *, row_number() OVER (PARTITION BY w, r, island ORDER BY p) AS k, bool_and(r <= lowest) OVER (PARTITION BY w, r, island) AS free
      FROM islands WHERE r IS NOT NULL
    ),
    taken AS (SELECT * FROM counted WHERE free AND k % 2 = 1)
    SELECT w, p, g, r AS t FROM taken UNION ALL SELECT w, next_p, g, NULL FROM taken
  )
)
SELECT w, list(t ORDER BY p) AS ids FROM state WHERE t IS NOT NULL GROUP BY w
"""


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Encoder:
    """Words to ids in one DuckDB connection of one thread."""

    def __init__(self, data: bytes) -> None:
        import duckdb
        import regex

        self.words = regex.compile(PATTERN).findall
        ranks = read_ranks(data)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        # A pair of tokens merges if the vocabulary holds both together; its rank is that token's id, above those of its parts.
        splits = ((t[:i], t[i:], r) for t, r in ranks.items() for i in range(1, len(t)))
        merges = [(ranks[a], ranks[b], r) for a, b, r in splits if ranks.get(a, r) < r and ranks.get(b, r) < r]
        table = pa.table({name: pa.array([m[k] for m in merges], pa.int32()) for k, name in enumerate("abr")})
        # The longest token that holds a pair of bytes.
        self.longest = np.ones(1 << 16, np.int32)
        for token in ranks:
            at = np.frombuffer(token, np.uint8).astype(np.int32)
            np.maximum.at(self.longest, at[:-1] * 256 + at[1:], len(token))
        vocabulary = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]})
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}B", "temp_directory": ""})
        for name, rows in (("merges", table), ("vocabulary", vocabulary)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.known: dict[str, list[int]] = {}

    def _positions(self, words: list[bytes], first: int) -> pa.Table:
        """A row for each byte of the words, which are numbered from ``first``: word, position, stretch and token."""
        sizes = np.array([len(b) for b in words])
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        w, starts = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes
        p = np.arange(len(flat)) - np.repeat(starts, sizes)
        reach = np.append(self.longest[flat[:-1] * 256 + flat[1:]], 1)
        reach[starts + sizes - 1] = 1  # no token goes on into the next word
        stretch = 2 * np.maximum.reduceat(reach, starts)
        made = {"w": w + first, "p": p, "g": p // stretch[w], "t": self.byte_ids[flat]}
        return pa.table({name: pa.array(column.astype(np.int32)) for name, column in made.items()})

    def learn(self, words: set[str]) -> None:
        """Encode the words that aren't known yet."""
        new = [w for w in words if w not in self.known]
        raw = [w.encode() for w in new]
        most = max(map(len, raw), default=0)
        self.db.execute(f"SET memory_limit = '{max(MEMORY, MEMORY_PER_BYTE * most)}B'")
        first = size = 0
        for k, word in enumerate(raw):
            if k > first and size + len(word) > STATE_BYTES:
                self._contract(new, raw, first, k)
                first, size = k, 0
            size += len(word)
        if raw:
            self._contract(new, raw, first, len(raw))

    def _contract(self, new: list[str], raw: list[bytes], first: int, last: int) -> None:
        self.db.register("start", self._positions(raw[first:last], first))
        for k, ids in self.db.execute(_CONTRACT).fetchall():
            self.known[new[k]] = ids
        self.db.unregister("start")

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.words(t) if t else [] for t in texts]
        wanted = set(chain.from_iterable(cut))
        if len(self.known) + len(wanted) > KEPT_WORDS:
            self.known = {}
        self.learn(wanted)
        return [list(chain.from_iterable(self.known[w] for w in words)) for words in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        rows = pa.table({"d": pa.array(range(len(ids)), pa.int32()), "ids": pa.array(ids, pa.list_(pa.int32()))})
        self.db.register("coded", rows)
        found = dict(
            self.db.execute(
                "SELECT d, string_agg(hex, '' ORDER BY p) FROM (SELECT d, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM coded) JOIN vocabulary USING (id) GROUP BY d"
            ).fetchall()
        )
        self.db.unregister("coded")
        return [bytes.fromhex(found.get(d, "")).decode("utf-8", "replace") for d in range(len(ids))]


def _sized(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded text, for very long texts."""
    at = start = size = 0
    for n in pa.compute.utf8_length(batch.column(column)).to_pylist():
        size, at = size + (n or 0), at + 1
        if size >= BATCH_CHARS:
            yield batch.slice(start, at - start)
            start, size = at, 0
    if at > start:
        yield batch.slice(start, at - start)


def encode_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, beside: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns named ``beside`` and ``ids``, the token ids of each text without special tokens; strings of
    special tokens are plain text.

    Null and empty texts give an empty list. Each row gives one row, repeated keys included; other columns are not read.
    The vocabulary, a file of fixed size, is read where this is called and sent to the tasks.
    """
    with open(vocabulary, "rb") as f:
        data = documents.sparkSession.sparkContext.broadcast(f.read())
    names = [key, *beside]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            for batch in _sized(whole, "__text"):
                encoder = encoder or Encoder(data.value)
                ids = encoder.encode(batch.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names=[*names, "ids"])

    kinds = ", ".join(f"`{n}` {documents.schema[n].dataType.simpleString()}" for n in names)
    return spread(documents.select(*names, F.col(text).alias("__text"))).mapInArrow(run, f"{kinds}, ids array<int>")


def decode_documents(coded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``text`` of token ids; null or empty ids give an empty text."""
    with open(vocabulary, "rb") as f:
        data = coded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(data.value)
            texts = encoder.decode([x or [] for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=[key, "text"])

    kind = coded.schema[key].dataType.simpleString()
    return coded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"{key} {kind}, text string")
