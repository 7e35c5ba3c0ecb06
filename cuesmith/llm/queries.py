"""Queries of the subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import cut_lineage
from ..tables import table
from . import garbled, languages, lookalikes, mixing, pairs, repeats, splitting, tokenizing, turns


def p2_found(spark, folder):
    pieces = splitting.split_oversized(table(spark, folder, "transcript_segments"), table(spark, folder, "index_versions"))
    return pieces.where("piece_number = 0").select("segment_id")


def p2_pieces(spark, folder):
    return splitting.split_oversized(table(spark, folder, "transcript_segments"), table(spark, folder, "index_versions"))


def p3_found(spark, folder):
    return lookalikes.lookalike_pairs(table(spark, folder, "transcript_segments"))


def p3_classes(spark, folder):
    return lookalikes.lookalike_classes(table(spark, folder, "transcript_segments"))


def p3_forms(spark, folder):
    return lookalikes.canonical_texts(table(spark, folder, "transcript_segments"), "id", ["original_text", "normalized_text"])


def p8_ids(spark, folder):
    return tokenizing.encode_documents(table(spark, folder, "documents"))


def p8_decoded(spark, folder):
    return tokenizing.decode_documents(p8_ids(spark, folder))


def _counted(spark, folder):
    coded = tokenizing.encode_documents(table(spark, folder, "documents"), beside=("source",))
    return cut_lineage(coded.select("doc_id", "source", F.size("ids").alias("n_tokens")))


def p9_selection(spark, folder):
    return mixing.select_documents(_counted(spark, folder), table(spark, folder, "mix_targets"))


def p9_shares(spark, folder):
    return mixing.shares(_counted(spark, folder), table(spark, folder, "mix_targets"))


def p7_found(spark, folder):
    return repeats.collapse(table(spark, folder, "source_segments")).select("transcript_id", "first_number", "last_number")


def p7_runs(spark, folder):
    return repeats.collapse(table(spark, folder, "source_segments"))


def p7_counts(spark, folder):
    return repeats.removed_counts(table(spark, folder, "source_segments"))


def p6_turns(spark, folder):
    return turns.turns(table(spark, folder, "source_segments"))


def p6_found(spark, folder):
    return p6_turns(spark, folder).where("marked").select("transcript_id", "first_number", "last_number")


def _language_model(spark, folder):
    return languages.fitted(*[table(spark, folder, t) for t in ("transcripts", "source_segments", "transcript_segments", "chat_messages")])


def p4_found(spark, folder):
    messages = table(spark, folder, "chat_messages")
    return pairs.found_defects(messages, _language_model(spark, folder), pairs.fitted_field(messages))


def p5_records(spark, folder):
    tables = [table(spark, folder, t) for t in ("transcripts", "chat_messages", "source_segments", "transcript_segments")]
    return languages.wrong_labels(*tables, _language_model(spark, folder), pairs.without_empty)


def p5_found(spark, folder):
    return p5_records(spark, folder).drop("confidence")


def p5_transcripts(spark, folder):
    cues = [table(spark, folder, t) for t in ("source_segments", "transcript_segments")]
    _, main = languages.transcript_languages(*cues, _language_model(spark, folder))
    return main.select("transcript_id", F.col("main").alias("lang"), F.col("share").alias("confidence"))


def p10_found(spark, folder):
    return garbled.affected(table(spark, folder, "documents"))


def p10_restored(spark, folder):
    return garbled.restored(table(spark, folder, "documents"))


QUERIES = {name: query for name, query in list(globals().items()) if name[:1] == "p" and "_" in name and name[1].isdigit()}

# The Unicode White_Space property, for RE2.
_WS = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

SQL = {
    "p2_found": rf"""
    WITH v AS (SELECT transcript_id, chunker_config.child_max_tokens AS most FROM index_versions WHERE status = 'active')
    SELECT DISTINCT s.id AS segment_id FROM transcript_segments s JOIN v USING (transcript_id)
    WHERE len(regexp_extract_all(s.normalized_text, '[^{_WS}]+')) > v.most""",
}


# Letters of other scripts, and under them the ones they look like.
_FOREIGN = "асԁеһіјӏорԛѕԝхуѵАВСЕНІЈКМОРЅТХУҮѴԚԜӀονϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿÐƉ"
_LATIN = "acdehijlopqswxyvABCEHIJKMOPSTXYYVQWIovcjABEZHIKMNOPTYXCJĐĐ"
_INVISIBLE = r"\x{ad}\x{34f}\x{61c}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}"


def _sql_form(column: str) -> str:
    """The table form in SQL; accents composed last."""
    wide = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
    pairs = {**dict(zip(_FOREIGN, _LATIN, strict=True)), **wide}
    quote = lambda s: s.replace("'", "''")
    bare = f"regexp_replace({column}, '[{_INVISIBLE}]', '', 'g')"
    latin = f"translate({bare}, '{quote(''.join(pairs))}', '{quote(''.join(pairs.values()))}')"
    ligatures = f"replace(replace({latin}, 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    return f"trim(regexp_replace(nfc_normalize({ligatures}), '[{_WS}]+', ' ', 'g'))"


_ALIKE = f"""
    WITH c AS (SELECT DISTINCT id, transcript_id, original_text AS t, {_sql_form("original_text")} AS f FROM transcript_segments WHERE original_text IS NOT NULL)"""
SQL["p3_found"] = _ALIKE + """
    SELECT a.id AS segment_id_a, b.id AS segment_id_b FROM c a JOIN c b ON a.transcript_id = b.transcript_id AND a.f = b.f AND a.id < b.id AND a.t <> b.t"""
SQL["p3_classes"] = _ALIKE + """
    SELECT a.id, a.transcript_id, least(a.id, min(b.id)) AS class_id, count(*) FILTER (WHERE a.t <> b.t) AS links
    FROM c a JOIN c b ON a.transcript_id = b.transcript_id AND a.f = b.f AND a.id <> b.id GROUP BY a.id, a.transcript_id HAVING count(*) FILTER (WHERE a.t <> b.t) > 0"""
# A word is spelt like the sound word that it looks like: the one without Cyrillic and Greek, else the most frequent.
SQL["p3_forms"] = rf"""
    WITH l AS (SELECT id, 'o' AS k, original_text AS t FROM transcript_segments UNION ALL SELECT id, 'n', normalized_text FROM transcript_segments),
    cut AS (SELECT id, k, regexp_extract_all(t, '[^{_WS}]+') AS words FROM l WHERE t IS NOT NULL),
    v AS (SELECT word, count(*) AS n, {_sql_form("word")} AS f FROM (SELECT unnest(words) AS word FROM cut) GROUP BY word),
    bare AS (SELECT *, regexp_replace(word, '[\x{{370}}-\x{{3ff}}\x{{400}}-\x{{52f}}]', '', 'g') AS rest FROM v),
    sound AS (
      SELECT word, f, n, rest <> word AS other FROM bare
      WHERE word <> '' AND (word = f AND rest = word
        OR nfc_normalize(word) = word AND NOT regexp_matches(word, '[{_INVISIBLE}\x{{fb00}}-\x{{fb06}}\x{{ff01}}-\x{{ffee}}]') AND NOT regexp_matches(rest, '\p{{L}}')
           AND (regexp_replace(word, '[\x{{370}}-\x{{3ff}}]', '', 'g') = word OR regexp_replace(word, '[\x{{400}}-\x{{52f}}]', '', 'g') = word))
    ),
    chosen AS (SELECT f, first(word ORDER BY other, n DESC, word) AS word FROM sound GROUP BY f),
    spelt AS (SELECT v.word, coalesce(c.word, v.f) AS form FROM v LEFT JOIN chosen c USING (f)),
    d AS (SELECT DISTINCT id, k, words FROM cut),
    placed AS (SELECT id, k, unnest(words) AS word, generate_subscripts(words, 1) AS spot FROM d),
    forms AS (SELECT id, k, string_agg(form, ' ' ORDER BY spot) FILTER (WHERE form <> '') AS form FROM placed JOIN spelt USING (word) GROUP BY id, k),
    whole AS (SELECT d.id, d.k, coalesce(form, '') AS form FROM d LEFT JOIN forms f ON f.id = d.id AND f.k = d.k)
    SELECT s.id, o.form AS original_text, n.form AS normalized_text
    FROM (SELECT DISTINCT id FROM transcript_segments) s LEFT JOIN whole o ON o.id = s.id AND o.k = 'o' LEFT JOIN whole n ON n.id = s.id AND n.k = 'n'"""

# Words by the tokenizer's pattern; RE2 can't look ahead, so the last blank of a run is first set apart from the others.
_S = _WS + r"\x{1c}-\x{1f}"
_PATTERN = rf"''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+"
# One contraction of each word a round: its leftmost pair of least rank, any split of the merged token counting.
_IDS = rf"""
    WITH RECURSIVE vocabulary AS (SELECT hex(from_base64(column0)) AS h, CAST(column1 AS INTEGER) AS id FROM read_csv('{tokenizing.VOCABULARY}', delim = ' ', header = false, quote = '', escape = '', all_varchar = true)),
    merges AS (
      SELECT a.id AS a, b.id AS b, v.id AS r
      FROM (SELECT h, id, unnest(range(2, length(h), 2)) AS n FROM vocabulary) v
      JOIN vocabulary a ON a.h = left(v.h, v.n) JOIN vocabulary b ON b.h = substr(v.h, v.n + 1)
    ),
    texts AS (SELECT doc_id, string_split(regexp_replace(text, '([{_S}]+)([{_S}][^{_S}])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS pieces FROM documents WHERE text <> ''),
    cut AS (SELECT doc_id, flatten(list_transform(pieces, lambda x: regexp_extract_all(x, '{_PATTERN}'))) AS words FROM texts),
    placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS spot FROM cut),
    distinct_words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM placed)),
    state(n, word, p, t) AS (
      SELECT 0, word, p, id FROM (SELECT word, h, unnest(range(length(h) // 2)) AS p FROM distinct_words) x JOIN vocabulary v ON v.h = substr(x.h, 2 * p + 1, 2)
      UNION ALL
      SELECT n + 1, word, p, CASE WHEN p = best[2] THEN best[1] ELSE t END
      FROM (
        SELECT x.*, min(CASE WHEN r IS NOT NULL THEN [r, p] END) OVER (PARTITION BY word) AS best
        FROM (
          SELECT s.*, m.r, lag(s.p) OVER (PARTITION BY s.word ORDER BY s.p) AS before
          FROM (SELECT *, lead(t) OVER (PARTITION BY word ORDER BY p) AS next_t FROM state) s
          LEFT JOIN merges m ON m.a = s.t AND m.b = s.next_t
        ) x
      ) WHERE best IS NOT NULL AND (before IS NULL OR before <> best[2])
    ),
    coded AS (SELECT word, list(t ORDER BY p) AS ids FROM (SELECT *, max(n) OVER (PARTITION BY word) AS last FROM state) WHERE n = last GROUP BY word),
    whole AS (SELECT doc_id, flatten(list(ids ORDER BY spot)) AS ids FROM placed JOIN coded USING (word) GROUP BY doc_id)"""
SQL["p8_ids"] = _IDS + """
    SELECT d.doc_id, coalesce(w.ids, CAST([] AS INTEGER[])) AS ids FROM documents d LEFT JOIN whole w USING (doc_id)"""
SQL["p8_decoded"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"

# DuckDB counts edits in bytes: each letter beyond ASCII of the five languages is put as one unused ASCII character.
_LETTERS = "".join(c for c in map(chr, range(0xDF, 0x1EFA)) if c.islower() and (c in "ßàáâãäæçèéêëìíîïñòóôõöùúûüýÿăđĩũœơư" or 0x1EA0 <= ord(c)))
_CODES = "".join(c for c in map(chr, range(1, 128)) if not (c.islower() or c.isdigit()))
assert len(_LETTERS) <= len(_CODES)
_CODE = "translate({}, '" + _LETTERS + "', '" + _CODES[: len(_LETTERS)].replace("'", "''") + "')"

_REPEATS = r"""
    WITH d AS (SELECT DISTINCT ON (transcript_id, sequence_number) * FROM source_segments),
    v AS (SELECT *, regexp_replace(coalesce(text, ''), '[\x{ad}\x{34f}\x{61c}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}]', '', 'g') AS seen FROM d),
    r AS (SELECT *, regexp_replace(lower(seen), '[^\p{L}\p{N}]', '', 'g') AS x, array_to_string(regexp_extract_all(seen, '\d+'), ' ') AS g FROM v),
    l AS (SELECT *, lag(x) OVER w AS px, lag(g) OVER w AS pg, lag(end_ms) OVER w AS pe FROM r WINDOW w AS (PARTITION BY transcript_id ORDER BY sequence_number)),
    j AS (SELECT *, CASE WHEN x <> '' AND px <> '' AND g = pg AND start_ms - pe <= 250
                          AND (x = px OR (length(x) >= 20 AND length(px) >= 20 AND levenshtein(@x, @px) <= 2)) THEN 0 ELSE 1 END AS opens FROM l),
    n AS (SELECT *, sum(opens) OVER (PARTITION BY transcript_id ORDER BY sequence_number ROWS UNBOUNDED PRECEDING) AS k FROM j),
    runs AS (SELECT transcript_id, min(sequence_number) AS first_number, max(sequence_number) AS last_number, CAST(count(*) AS INTEGER) AS cues,
                    min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(end_ms) - min(start_ms) AS duration_ms
             FROM n GROUP BY transcript_id, k HAVING count(*) > 1)
"""
_REPEATS = _REPEATS.replace("@x", _CODE.format("x")).replace("@px", _CODE.format("px"))
SQL["p7_found"] = _REPEATS + "SELECT transcript_id, first_number, last_number FROM runs"
SQL["p7_runs"] = _REPEATS + "SELECT * FROM runs"
SQL["p7_counts"] = _REPEATS + """
    SELECT transcript_id, count(*) AS source_segment_count,
           coalesce((SELECT CAST(sum(cues - 1) AS BIGINT) FROM runs WHERE runs.transcript_id = d.transcript_id), 0) AS removed_duplicate_count
    FROM d GROUP BY transcript_id"""
