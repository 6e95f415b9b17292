"""Models that work on the memory's texts: what they must offer, and deterministic ones that need no network."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class TextModel(Protocol):
    def complete(self, prompt: str) -> str: ...


class HashEmbedder:
    """Words hashed to signed places, at length 1; a text without words gives zeros."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", (t or "").lower()):
                h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                out[i, (h >> 1) % self.dim] += 1 if h & 1 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0)


class FirstSentence:
    """The first sentence of the prompt's last paragraph, at most 200 characters."""

    def complete(self, prompt: str) -> str:
        text = (prompt or "").strip().rsplit("\n\n", 1)[-1]
        return re.split(r"(?<=[.!?])\s", text, maxsplit=1)[0][:200]


def embed_missing(rows: DataFrame, cache: DataFrame, embedder: Embedder, text: str = "content", batch: int = 100) -> DataFrame:
    """(hash, embedding) of the texts that the cache (hash, embedding) lacks: each text once, in batches, by executors."""
    hashed = rows.where(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256).alias("hash"), F.col(text).alias("text"))
    missing = hashed.join(cache.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                yield pd.DataFrame({"hash": part["hash"], "embedding": list(embedder.embed(part["text"].tolist()).astype(np.float32))})

    return missing.mapInPandas(run, "hash string, embedding array<float>")


def complete_each(rows: DataFrame, key: str, prompt: str, model: TextModel) -> DataFrame:
    """(key, answer) of each prompt."""
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "answer": [model.complete(p) for p in pdf[prompt]]})

    return rows.select(key, prompt).mapInPandas(run, f"{key} {kind}, answer string")
