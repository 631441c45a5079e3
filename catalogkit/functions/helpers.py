"""Vectorised helpers for what column expressions cannot say."""

from __future__ import annotations

import difflib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """H5: compatibility form; the helper only sees texts that are not ASCII."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.coalesce(F.when(plain, text), _nfkc(F.when(~plain, text)))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in seen:
            seen[pair] = difflib.SequenceMatcher(None, *pair).ratio()
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """H1: share of matching blocks of two texts (order of arguments matters); null if either is null."""
    return _ratio(a, b)


def similarity_bound(a: Column, b: Column) -> Column:
    """The most that ``similarity`` can be, from the lengths alone."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2 * F.least(F.length(a), F.length(b)) / total)


@F.pandas_udf(T.StringType())
def _fingerprint(size: pd.Series, head: pd.Series, tail: pd.Series) -> pd.Series:
    out = []
    for n, a, b in zip(size, head, tail):
        if n is None or a is None or b is None:
            out.append(None)
            continue
        total = np.array([n], np.int64).view(np.uint64)
        for part in (a, b):
            words = np.frombuffer(part[: len(part) // 8 * 8], "<u8")
            total = total + words.sum(dtype=np.uint64)
        out.append(f"{int(total[0]):016x}")
    return pd.Series(out)


def oshash(size: Column, head: Column, tail: Column) -> Column:
    """Size plus the little-endian 64-bit words of both ends, modulo 2^64, in hex."""
    return _fingerprint(size, head, tail)
