"""Digests that the JVM has no function for, in Arrow batches."""

from __future__ import annotations

import base64
import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def handle_of(symbol_id: str) -> str:
    return "s_" + base64.urlsafe_b64encode(hashlib.blake2b(symbol_id.encode(), digest_size=16).digest()).decode().rstrip("=")


def fingerprint_of(symbol_id: str, start: int, end: int, line: int, content_hash: str) -> str:
    return hashlib.blake2b(f"{symbol_id}\n{start}\n{end}\n{line}\n{content_hash}".encode(), digest_size=8).hexdigest()


@F.pandas_udf(StringType())
def _handles(ids: pd.Series) -> pd.Series:
    return ids.map(lambda x: None if x is None else handle_of(x))


def symbol_handle(symbol_id: Column) -> Column:
    return _handles(symbol_id)


def parse_continuation(token: Column) -> Column:
    """handle, line, fingerprint of c_<22>@<line>:<16 hex>; null for any other text."""
    pattern = r"^c_([A-Za-z0-9_-]{22})@([1-9][0-9]{0,7}):([0-9a-f]{16})$"
    made = F.struct(F.concat(F.lit("s_"), F.regexp_extract(token, pattern, 1)).alias("handle"), F.regexp_extract(token, pattern, 2).try_cast("int").alias("line"), F.regexp_extract(token, pattern, 3).alias("fingerprint"))
    return F.when(token.rlike(pattern), made)
