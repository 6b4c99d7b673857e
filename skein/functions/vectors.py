"""Vector functions."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def cosine(left: Column, right: Column) -> Column:
    """Summed from left to right in double precision; 0 for empty vectors, other lengths and zero norms."""
    norms = F.sqrt(_dot(left, left)) * F.sqrt(_dot(right, right))
    fits = (F.size(left) > 0) & (F.size(left) == F.size(right))
    return F.when(fits & (norms > 0), _dot(left, right) / norms).otherwise(F.lit(0.0))


def decode_vector(payload: bytes | str | None) -> list[float]:
    """A JSON list, or little-endian 32-bit floats."""
    data = payload.encode() if isinstance(payload, str) else payload or b""
    if data.lstrip()[:1] == b"[":
        return [float(x) for x in json.loads(data)]
    if not data or len(data) % 4:
        raise ValueError(f"vector payload of {len(data)} bytes")
    return np.frombuffer(data, "<f4").astype("f8").tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decode_vectors(payload: pd.Series) -> pd.Series:
    return payload.map(decode_vector)
