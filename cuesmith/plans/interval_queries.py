"""Queries and SQL for merged periods and gaps."""

from __future__ import annotations

from ..operators import intervals
from ..tables import table


def _cues(spark, folder):
    return table(spark, folder, "transcript_segments").select("transcript_id", "start_ms", "end_ms")


def p1_found(spark, folder):
    return intervals.gaps(_cues(spark, folder))


def p1_periods(spark, folder):
    return intervals.periods(_cues(spark, folder))


def p1_summary(spark, folder):
    return intervals.summary(_cues(spark, folder))


QUERIES = {"p1_found": p1_found, "p1_periods": p1_periods, "p1_summary": p1_summary}

_ISLANDS = """
WITH c AS (SELECT DISTINCT transcript_id, start_ms, end_ms FROM transcript_segments
           WHERE start_ms IS NOT NULL AND end_ms > start_ms),
     m AS (SELECT *, max(end_ms) OVER (PARTITION BY transcript_id ORDER BY start_ms, end_ms
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM c),
     g AS (SELECT transcript_id, until AS gap_start_ms, start_ms AS gap_end_ms FROM m WHERE start_ms > until),
     n AS (SELECT *, sum(CASE WHEN until IS NULL OR start_ms > until THEN 1 ELSE 0 END)
                     OVER (PARTITION BY transcript_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS k FROM m),
     p AS (SELECT transcript_id, min(start_ms) AS period_start_ms, max(end_ms) AS period_end_ms FROM n GROUP BY transcript_id, k)
"""

SQL = {
    "p1_found": _ISLANDS + "SELECT transcript_id, gap_start_ms, gap_end_ms FROM g",
    "p1_periods": _ISLANDS + "SELECT transcript_id, period_start_ms, period_end_ms FROM p",
    "p1_summary": _ISLANDS
    + """
    SELECT a.transcript_id, a.span_ms, a.covered_ms, coalesce(b.largest_gap_ms, 0) AS largest_gap_ms, coalesce(b.gap_count, 0) AS gap_count
    FROM (SELECT transcript_id, max(period_end_ms) - min(period_start_ms) AS span_ms,
                 CAST(sum(period_end_ms - period_start_ms) AS BIGINT) AS covered_ms FROM p GROUP BY transcript_id) a
    LEFT JOIN (SELECT transcript_id, max(gap_end_ms - gap_start_ms) AS largest_gap_ms, count(*) AS gap_count FROM g GROUP BY transcript_id) b
    USING (transcript_id)""",
}
