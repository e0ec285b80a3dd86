"""Vector columns (ARRAY of numbers), in built-in functions where these suffice."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """The vector over its length; null for a vector of length 0."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a)))


@F.pandas_udf(T.StringType())
def to_base64(vectors: pd.Series) -> pd.Series:
    """The vector's components as 32-bit floats, in base 64."""
    return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, np.float32).tobytes()).decode())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_base64(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else np.frombuffer(base64.b64decode(t), np.float32))


@F.pandas_udf(T.StringType())
def vector_id(vectors: pd.Series) -> pd.Series:
    """MD5 of the components as 32-bit floats."""
    return vectors.map(lambda v: None if v is None else hashlib.md5(np.asarray(v, np.float32).tobytes()).hexdigest())
