"""The full-text tokenizer: no marks, lower case, runs of letters and digits."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SEPARATOR = re.compile(r"[\W_]+")


def tokens_of(text: str) -> list[str]:
    """Tokens of a text; a run of letters without blanks is one token in any script."""
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
        for mark in {c for c in set(text) if unicodedata.category(c) == "Mn"}:
            text = text.replace(mark, "")
    return [t for t in _SEPARATOR.split(text.lower()) if t]


def query_phrases(query: str) -> list[list[str]]:
    """Each word of a query as a phrase of one or more tokens; all must occur."""
    return [tokens for word in query.split() if (tokens := tokens_of(word))]


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokenize(text: pd.Series) -> pd.Series:
    return text.map(lambda t: tokens_of(t) if t else [])


def occurrences(tokens: list[str], phrase: list[str]) -> int:
    """How often a phrase occurs at adjacent positions."""
    first, *rest = phrase
    found = tokens.count(first)
    if not rest or not found:
        return found
    return sum(tokens[i : i + len(phrase)] == phrase for i, t in enumerate(tokens) if t == first)


def phrase_counts(text: Column, phrases: Sequence[list[str]]) -> Column:
    """``dl, tf``: tokens of a text, and occurrences of each phrase; tokens stay in the worker."""
    phrases = [list(p) for p in phrases]
    kind = T.StructType([T.StructField("dl", T.IntegerType()), T.StructField("tf", T.ArrayType(T.IntegerType()))])

    @F.pandas_udf(kind)
    def counts(texts: pd.Series) -> pd.DataFrame:
        lengths, found = [], []
        for one in texts:
            tokens = tokens_of(one) if one else []
            lengths.append(len(tokens))
            found.append([occurrences(tokens, p) for p in phrases])
        return pd.DataFrame({"dl": lengths, "tf": found})

    return counts(text)
