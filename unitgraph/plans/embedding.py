"""Embeddings and language models as protocols, with deterministic defaults (SC16, F16)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import context_text, point_id, signature_text


class Embedder(Protocol):
    dimensions: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """Rows of unit length (or zero for a text without words)."""


class LlmClient(Protocol):
    def generate(self, prompt: str) -> str: ...


class HashingEmbedder:
    """Words hashed to signed buckets; no model, the same everywhere."""

    def __init__(self, dimensions: int = 256):
        self.dimensions = dimensions

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[(h >> 1) % self.dimensions] += 1 if h & 1 else -1
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(lengths > 0, lengths, 1)


class TemplateLlm:
    """Answers with the prompt's first line: a stand-in where no model is."""

    def generate(self, prompt: str) -> str:
        return prompt.split("\n", 1)[0]


def embed(text: Column, embedder: Embedder, batch: int = 256) -> Column:
    """Vector of a text column: an iterator pandas UDF, so that a model is loaded once a worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            texts = series.fillna("").tolist()
            parts = [embedder.encode(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            yield pd.Series([list(map(float, v)) for p in parts for v in p], dtype=object)

    return run(text)


def unit_vectors(units: DataFrame, embedder: Embedder) -> DataFrame:
    """Two vectors of each unit, in collections ``signatures`` and ``context``."""
    columns = [F.col(c) for c in ("signature", "name", "comment", "param_names", "body_text")]
    texts = F.explode(F.array(F.struct(F.lit("signatures").alias("collection"), signature_text(columns[0], columns[1]).alias("text")), F.struct(F.lit("context").alias("collection"), context_text(*columns).alias("text"))))
    rows = units.select(point_id(F.col("repo_id"), F.col("qualified_name")).alias("id"), "repo_id", "language", "file_path", "qualified_name", texts.alias("t"))
    return rows.select("id", "repo_id", "language", "file_path", "qualified_name", "t.collection", embed(F.col("t.text"), embedder).alias("vector"))


def generate(prompts: DataFrame, client: Callable[[], LlmClient], prompt_col: str = "prompt") -> DataFrame:
    """``prompts`` with ``answer``; ``client`` makes a client, once a task. An error becomes an empty answer and ``error``."""
    schema = ", ".join(f"`{c}` {t}" for c, t in prompts.dtypes) + ", answer string, error string"

    def run(batches):
        own = client()
        for batch in batches:
            answers, errors = [], []
            for prompt in batch[prompt_col]:
                try:
                    answers.append(own.generate(prompt))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a failed call is data
                    answers.append("")
                    errors.append(str(e))
            yield batch.assign(answer=answers, error=errors)

    return prompts.mapInPandas(run, schema)
