"""Markup, JSON and frame rules as column expressions (EX14, EX17, EX18, EX27, R6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_comments(text: Column, begin: str = "<%--", end: str = "--%>") -> Column:
    """Text without comments between two marks that hold no letters."""
    return F.regexp_replace(text, f"(?s){begin}.*?{end}", "")


def matches(text: Column, pattern: str, *groups: int) -> Column:
    """Array of structs ``g1, g2, ...`` of the wanted groups of every match."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups]
    return F.arrays_zip(*parts)


def attributes(raw: Column) -> Column:
    """Map of a tag's attributes; of repeated names the last counts."""
    pairs = matches(raw, r"""(\w+)=["']([^"']*)["']""", 1, 2)
    return F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["g1"]), F.create_map(p["g1"], p["g2"])))


def llm_answer(text: Column) -> Column:
    """``summary`` (100 characters at most) and ``tags`` (5 at most) of a model's answer, fenced or not; empty if it is no JSON."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", ""))
    parsed = F.from_json(bare, "summary string, tags array<string>", {"mode": "PERMISSIVE"})
    return F.struct(F.substring(F.coalesce(parsed["summary"], F.lit("")), 1, 100).alias("summary"), F.slice(F.coalesce(parsed["tags"], F.array().cast("array<string>")), 1, 5).alias("tags"))


def event_frames(stream: Column) -> Column:
    """JSON payloads of a text/event-stream body: frames end at a blank line, ``data:`` is cut off, bad JSON is left out."""
    frames = F.transform(F.split(stream, "\n\n"), lambda f: F.trim(f))
    data = F.transform(F.filter(frames, lambda f: f.startswith("data:")), lambda f: F.trim(F.substring(f, 6, 1 << 30)))
    return F.filter(data, lambda x: F.try_parse_json(x).isNotNull())
