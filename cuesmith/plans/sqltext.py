"""Pieces of SQL that several modules share."""

from __future__ import annotations

# The Unicode White_Space property, for RE2.
WS = r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}', ' ', 'g'))"


def tokens(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w))"


def shorten(c: str, n: int) -> str:
    s = squeeze(c)
    return f"CASE WHEN length({s}) <= {n} THEN {s} ELSE rtrim(substr({s}, 1, {n - 3})) || '...' END"


def clock(seconds: str) -> str:
    whole = f"greatest(CAST(floor(coalesce({seconds}, 0)) AS BIGINT), 0)"
    return f"(CASE WHEN {whole} // 60 < 10 THEN '0' ELSE '' END || CAST({whole} // 60 AS VARCHAR) || ':' || lpad(CAST({whole} % 60 AS VARCHAR), 2, '0'))"


SEGMENTS = "seg AS (SELECT DISTINCT id, transcript_id, sequence_number, original_text, normalized_text, start_ms, end_ms FROM transcript_segments)"
MESSAGES = "msg AS (SELECT DISTINCT message_id, video_id, question, answer, answer_language, retrieval_mode, groundedness_warning FROM chat_messages)"
