"""Peak lists as base64 of interleaved big-endian 32-bit floats, and back; binary arrays of scan files."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def peaks_to_base64(mz: pd.Series, intensity: pd.Series) -> pd.Series:
    """Of two arrays of the same length per row."""

    def one(m, i):
        if m is None or i is None:
            return None
        return base64.b64encode(np.column_stack([m, i]).astype(">f4").tobytes()).decode()

    return pd.Series([one(m, i) for m, i in zip(mz, intensity, strict=True)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("mz", T.DoubleType()), T.StructField("intensity", T.DoubleType())])))
def base64_to_peaks(text: pd.Series) -> pd.Series:
    def one(t):
        if t is None:
            return None
        pairs = np.frombuffer(base64.b64decode(t), ">f4").reshape(-1, 2).astype(float)
        return [{"mz": m, "intensity": i} for m, i in pairs.tolist()]

    return text.map(one)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decode_binary(text: pd.Series, bits: pd.Series, compressed: pd.Series) -> pd.Series:
    """Little-endian floats of 32 or 64 bits, in zlib if so marked."""

    def one(t, b, z):
        if t is None:
            return None
        raw = base64.b64decode(t)
        return np.frombuffer(zlib.decompress(raw) if z else raw, "<f4" if b == 32 else "<f8").astype(float)

    return pd.Series([one(*r) for r in zip(text, bits, compressed, strict=True)])


@F.pandas_udf(T.StringType())
def doubles_to_base64(values: pd.Series) -> pd.Series:
    """Arrays as little-endian 64-bit floats, uncompressed."""
    return values.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f8").tobytes()).decode())
