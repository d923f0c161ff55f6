"""Hashes that Spark lacks, as Arrow-batched functions: SHA3-256 and xxHash64 with seed 0."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F, types as T


@F.pandas_udf(T.StringType())
def sha3_256(values: pd.Series) -> pd.Series:
    import hashlib

    return values.map(lambda x: None if x is None else hashlib.sha3_256(x.encode() if isinstance(x, str) else bytes(x)).hexdigest())


@F.pandas_udf(T.LongType())
def xxhash64_seed0(values: pd.Series) -> pd.Series:
    import xxhash

    def one(x):
        h = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else bytes(x))
        return h - (1 << 64) if h >= 1 << 63 else h

    return values.map(lambda x: None if x is None else one(x)).astype("Int64")
