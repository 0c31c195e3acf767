"""Content addresses: SHA-256 over canonical JSON (sorted keys, compact separators)."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def canonical_digest(payload: pd.Series) -> pd.Series:
    """Digest of a JSON text, independent of key order and spacing; null for null, raises on malformed JSON."""
    dump = lambda v: json.dumps(json.loads(v), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    return payload.map(lambda v: hashlib.sha256(dump(v).encode()).hexdigest(), na_action="ignore")
