"""Files to units: encoding, the table of extractors, and the pass over a DataFrame (SC3, SC8, SC9)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..schemas import UNIT
from . import java, javascript, jsp, xmlunits

#: Encodings in the order they are tried.
ENCODINGS = ("utf-8", "cp932", "gb2312", "cp1252", "latin-1")


def encoding_of(raw: bytes) -> str:
    """The first encoding that reads all bytes."""
    for name in ENCODINGS:
        try:
            raw.decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return ENCODINGS[-1]


def decode(raw: bytes) -> str:
    return raw.decode(encoding_of(raw), "replace")


Extractor = Callable[[bytes, Settings], list[dict]]
_EXTRACTORS: dict[str, Extractor] = {
    "java": lambda raw, s: java.parse(decode(raw), s),
    "javascript": lambda raw, s: javascript.parse(decode(raw), s),
    "jsp": lambda raw, s: jsp.parse(decode(raw), s),
    "xml": lambda raw, s: xmlunits.parse(raw, s),
}


def register_extractor(language: str, extractor: Extractor) -> None:
    """Add or replace the extractor of a language; jobs planned from now on use it."""
    _EXTRACTORS[language] = extractor


def extract(files: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Units of ``repo_id, file_path, language, content`` rows.

    A row for each unit with ``ordinal`` (its place in the file) and all columns of
    :data:`UNIT`; a file that can't be read gives one row with ``error`` and no unit.
    Files go through in Arrow batches; no file meets another.
    """
    table = dict(_EXTRACTORS)
    names = ["repo_id", "file_path", "ordinal", "error", *[f.split()[0] for f in UNIT.replace("array<struct<name:string,line:int>>", "calls_type").split(", ")]]

    def run(batches):
        for batch in batches:
            rows = []
            for repo, path, language, content in batch[["repo_id", "file_path", "language", "content"]].itertuples(index=False):
                try:
                    made = table[language](bytes(content), settings) if language in table else []
                    rows += [{"repo_id": repo, "file_path": path, "ordinal": i, "error": None, **u} for i, u in enumerate(made)]
                except Exception as e:  # noqa: BLE001  one bad file is a row of its own, not a failed job
                    rows.append({"repo_id": repo, "file_path": path, "ordinal": -1, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=names).astype({"repo_id": "int64", "ordinal": "int32"}).replace({float("nan"): None}) if rows else pd.DataFrame(columns=names)

    return files.select("repo_id", "file_path", "language", "content").mapInPandas(run, f"repo_id bigint, file_path string, ordinal int, error string, {UNIT}")


def encodings(files: DataFrame) -> DataFrame:
    """``file_path, n_bytes, encoding`` of ``file_path, content`` rows (SC8)."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"file_path": batch["file_path"], "n_bytes": batch["content"].map(len).astype("int64"), "encoding": batch["content"].map(lambda raw: encoding_of(bytes(raw)))})

    return files.select("file_path", "content").mapInPandas(run, "file_path string, n_bytes bigint, encoding string")


def units(extracted: DataFrame) -> DataFrame:
    return extracted.where("error is null").drop("error")


def rejects(extracted: DataFrame) -> DataFrame:
    return extracted.where("error is not null").select("repo_id", "file_path", "error")


def edges(extracted: DataFrame) -> DataFrame:
    """``repo_id, file_path, caller, callee, call_line``: the first line of each pair (K3, Q6)."""
    calls = units(extracted).select("repo_id", "file_path", F.col("qualified_name").alias("caller"), F.explode("calls").alias("c"))
    return calls.groupBy("repo_id", "file_path", "caller", F.col("c.name").alias("callee")).agg(F.min("c.line").alias("call_line"))
