"""Reading cues from subtitle payloads: ``vtt``, ``ttml`` and ``srv3``."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze

MOST_CHARS = 5_000_000
CLOCK = r"(?:\d+:)?\d{1,2}:\d{2}[.,]\d{3}"
CUES = "key string, text string, start_ms bigint, end_ms bigint"


def clock_ms(shown: Column) -> Column:
    """``H:MM:SS.mmm`` or ``MM:SS.mmm`` in milliseconds."""
    parts = F.split(F.replace(shown, F.lit(","), F.lit(".")), ":")
    n = F.size(parts)
    at = lambda i: F.coalesce(F.try_element_at(parts, n - i).cast("double"), F.lit(0.0))
    hours = F.when(n >= 3, at(2)).otherwise(0.0)
    return F.bround((hours * 3600 + at(1) * 60 + at(0)) * 1000).cast("long")


def clean_markup(text: Column) -> Column:
    """Tags dropped, the five entities of XML decoded, blanks single."""
    plain = F.regexp_replace(text, "<[^>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(sign))
    return squeeze(plain)


def parse_vtt(payloads: DataFrame) -> DataFrame:
    """``key, text, start_ms, end_ms`` of ``key, payload``: blocks between blank lines that hold a timing line.

    Cues without text or with an end not after the start are left out; so are payloads that are too long.
    """
    blocks = payloads.where(F.char_length("payload") <= MOST_CHARS).select("key", F.explode(F.split(F.replace(F.col("payload"), F.lit("\r\n"), F.lit("\n")), "\n[ \\t]*\n")).alias("block"))
    timing = rf"({CLOCK})[ \t]+-->[ \t]+({CLOCK})[^\n]*\n?"
    part = lambda i: F.regexp_extract("block", timing, i)
    found = blocks.where(F.col("block").rlike(timing)).select("key", clean_markup(F.regexp_extract("block", f"(?s){timing}(.*)", 3)).alias("text"), clock_ms(part(1)).alias("start_ms"), clock_ms(part(2)).alias("end_ms"))
    return found.where("text <> '' AND start_ms >= 0 AND end_ms > start_ms")


def offset_ms(shown: str) -> int:
    """``1.5s``, ``200ms`` or a clock time in milliseconds, halves to even."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)(ms|s)", shown.strip())
    if m:
        return round(float(m[1]) * (1 if m[2] == "ms" else 1000))
    parts = [float(p) for p in shown.strip().replace(",", ".").split(":")]
    if not 2 <= len(parts) <= 3:
        raise ValueError(f"no time: {shown}")
    return round(sum(p * 60**i for i, p in enumerate(reversed(parts))) * 1000)


def xml_cues(payload: str, kind: str) -> list[tuple[str, int, int]]:
    """Cues of a TTML or SRV3 document; one with a bad or missing time or none at all is an error."""
    root = ElementTree.fromstring(payload)
    out = []
    for node in root.iter():
        name = node.tag.rsplit("}", 1)[-1]
        text = " ".join(html.unescape("".join(node.itertext())).split())
        get = {k.rsplit("}", 1)[-1]: v for k, v in node.attrib.items()}.get
        if kind == "ttml" and name == "p":
            start = offset_ms(get("begin") or "")
            end = offset_ms(get("end")) if get("end") else start + offset_ms(get("dur") or "")
        elif kind == "srv3" and name == "p" and get("t"):
            start = int(get("t"))
            end = start + int(get("d") or 0)
        elif kind == "srv3" and name == "text" and get("start"):
            start = round(float(get("start")) * 1000)
            end = start + round(float(get("dur") or 0) * 1000)
        else:
            continue
        if end <= start:
            raise ValueError("a cue ends before it starts")
        if text:
            out.append((text, start, end))
    if not out:
        raise ValueError("no usable cues")
    return out


def parse_xml(payloads: DataFrame, kind: str) -> DataFrame:
    """``key, text, start_ms, end_ms, error``: the cues of each payload, or one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, payload in zip(rows["key"], rows["payload"]):
                try:
                    if payload is None or len(payload) > MOST_CHARS:
                        raise ValueError("no payload" if payload is None else "payload too long")
                    out += [(key, t, a, b, None) for t, a, b in xml_cues(payload, kind)]
                except (ValueError, TypeError, ElementTree.ParseError) as e:
                    out.append((key, None, None, None, str(e)[:200] or type(e).__name__))
            yield pd.DataFrame(out, columns=["key", "text", "start_ms", "end_ms", "error"]).astype({"start_ms": "Int64", "end_ms": "Int64"})

    return payloads.select("key", "payload").mapInPandas(run, CUES + ", error string")


def parse_subtitles(payloads: DataFrame) -> DataFrame:
    """Cues of ``key, format, payload``, each by its own format; an unknown format is an error row."""
    vtt = payloads.where("format = 'vtt'")
    read = parse_vtt(vtt)
    empty = vtt.join(read.select(F.col("key").alias("__k")).distinct(), F.col("key") == F.col("__k"), "left_anti")
    out = read.withColumn("error", F.lit(None).cast("string")).unionByName(_error(empty, "no usable cues"))
    for kind in ("ttml", "srv3"):
        out = out.unionByName(parse_xml(payloads.where(F.col("format") == kind), kind))
    unknown = payloads.where(~F.coalesce(F.col("format").isin("vtt", "ttml", "srv3"), F.lit(False)))
    return out.unionByName(_error(unknown, "unknown format"))


def _error(rows: DataFrame, text: str) -> DataFrame:
    none = F.lit(None)
    return rows.select("key", none.cast("string").alias("text"), none.cast("long").alias("start_ms"), none.cast("long").alias("end_ms"), F.lit(text).alias("error"))


def video_identity(url: Column) -> Column:
    """``struct<id, canonical>`` of a video address, null for others."""
    ident = "([A-Za-z0-9_-]{11})"
    hosts = r"^https?://(?:www\.|m\.)?"
    ways = (rf"{hosts}youtube\.com/watch\?(?:[^#]*&)?v={ident}(?:[&#].*)?$", rf"^https?://youtu\.be/{ident}(?:[/?#].*)?$", rf"{hosts}youtube\.com/(?:embed|shorts|live)/{ident}(?:[/?#].*)?$")
    found = F.coalesce(*[F.nullif(F.regexp_extract(F.trim(url), w, 1), F.lit("")) for w in ways])
    return F.when(found.isNotNull(), F.struct(found.alias("id"), F.concat(F.lit("https://www.youtube.com/watch?v="), found).alias("canonical")))
