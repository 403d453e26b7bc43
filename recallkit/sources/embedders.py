"""Embedding providers: what turns texts into vectors, run once per worker on batches."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Takes texts, gives their vectors in the same order.
Provider = Callable[[Sequence[str]], list[list[float]]]


def hash_vectors(texts: Sequence[str], dimension: int = 16) -> list[list[float]]:
    """Deterministic vectors: equal texts have equal ones. For tests."""
    found = []
    for text in texts:
        seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "little") % 2**31
        draw = random.Random(seed)
        found.append([draw.uniform(-1, 1) for _ in range(dimension)])
    return found


#: Answers of a service after which a request is made again.
RETRYABLE = frozenset({429, 500, 502, 503, 504})


def retryable(error: BaseException) -> bool:
    """Whether a request may be made again: it timed out, or its answer (``status_code``, of the error or its
    ``response``) says so."""
    answers = (error, getattr(error, "response", None))
    codes = (getattr(x, name, None) for x in answers for name in ("status_code", "status", "code"))
    return isinstance(error, (TimeoutError, ConnectionError)) or any(c in RETRYABLE for c in codes if isinstance(c, int))


def with_retries(provider: Provider, tries: int = 5, wait: float = 0.5, chunk: int = 100) -> Provider:
    """Requests of at most ``chunk`` texts, repeated with doubling waits while their errors are :func:`retryable`."""

    def call(texts: Sequence[str]) -> list[list[float]]:
        found: list[list[float]] = []
        for at in range(0, len(texts), chunk):
            for attempt in range(tries):
                try:
                    found += provider(texts[at : at + chunk])
                    break
                except Exception as error:
                    if attempt + 1 == tries or not retryable(error):
                        raise
                    time.sleep(wait * 2**attempt)
        return found

    return call


def embed(rows: DataFrame, provider: Provider = hash_vectors, text_col: str = "content") -> DataFrame:
    """``rows`` with ``embedding`` of the text, batch by batch; an old vector is replaced."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(provider([t or "" for t in texts]), index=texts.index)

    return rows.drop("embedding").withColumn("embedding", vectors(text_col))
