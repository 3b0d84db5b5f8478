"""Embeddings of descriptions, from any provider.

A provider turns a list of texts into a list of vectors (or None where it fails).
The default needs no network: it hashes character trigrams to signed dimensions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.errors import ConfigError
from schemaloom.store import GraphStore

Provider = Callable[[list[str]], list[list[float] | None]]


def hashing_provider(dimensions: int = 64) -> Provider:
    """Unit vectors of hashed character trigrams; the same text always gives the same vector."""

    def embed(texts: list[str]) -> list[list[float] | None]:
        out = []
        for text in texts:
            v = [0.0] * dimensions
            padded = f"  {text.lower()}  "
            for i in range(len(padded) - 2):
                h = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "little")
                v[h % dimensions] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v))
            out.append([x / norm for x in v] if norm else None)
        return out

    return embed


def candidates(nodes: DataFrame, *, min_length: int = 1) -> DataFrame:
    """Nodes with a description of the least length and no embedding yet."""
    return nodes.filter(F.col("description").isNotNull() & F.col("embedding").isNull() & (F.length("description") >= min_length))


def _vectors(provider: Provider, texts: list[str]) -> list[list[float] | None]:
    """One request for all texts; if it fails, one for each, so that a bad text costs no other its vector."""
    try:
        vectors = provider(texts)
    except Exception:
        return [None] if len(texts) == 1 else [v for t in texts for v in _vectors(provider, [t])]
    if len(vectors) != len(texts):
        raise ValueError(f"the provider gave {len(vectors)} vectors for {len(texts)} texts")
    return vectors


def dimensions(provider: Provider) -> int:
    """Length of the provider's vectors, asked with one short text."""
    vector = provider(["probe"])[0]
    if vector is None:
        raise ConfigError("the provider gave no vector")
    return len(vector)


def embedded(rows: DataFrame, provider: Provider, *, text: str = "description", batch_size: int = 100) -> DataFrame:
    """(id, embedding), in batches on the executors; a provider's failure leaves NULL."""

    def run(parts):
        for pdf in parts:
            for s in range(0, len(pdf), batch_size):
                some = pdf.iloc[s : s + batch_size]
                vectors = _vectors(provider, some["text"].tolist())
                yield pd.DataFrame({"id": some["id"], "embedding": vectors})

    return rows.select("id", F.col(text).alias("text")).mapInPandas(run, "id string, embedding array<float>")


def enrich(store: GraphStore, labels: list[str], provider: Provider, *, batch_size: int = 100, min_length: int = 1) -> None:
    """Embed what lacks an embedding and write it back by id."""
    for label in labels:
        store.set_embeddings(label, embedded(candidates(store.nodes(label), min_length=min_length), provider, batch_size=batch_size))
