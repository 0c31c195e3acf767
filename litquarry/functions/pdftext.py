"""Identifiers in the typography of extracted pages."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .identifiers import extract_dois

_DASHES = str.maketrans(dict.fromkeys("‐‑‒–—−⁃", "-"))
_TAIL = r"[-._;()/:<>#?A-Za-z0-9]+"
# A DOI with white space beside its own punctuation; a digit must follow a break after a separator.
_SPACED = re.compile(rf"(?<![\w/])10\s*\.\s*\d{{4,9}}\s*/\s*{_TAIL}(?:\s*[-./]\s*{_TAIL}|(?<=[./-])\s+(?!10\s*\.\s*\d)(?=\d){_TAIL})*")


@F.pandas_udf(StringType())
def _mended(texts: pd.Series) -> pd.Series:
    def mend(t: str) -> str:
        t = unicodedata.normalize("NFKC", t).translate(_DASHES)
        return _SPACED.sub(lambda m: re.sub(r"\s+", "", m.group()), t)

    return texts.map(mend, na_action="ignore")


def extract_pdf_dois(c: Column) -> Column:
    """DOIs of page text: widths and dashes folded, spaces inside a DOI closed, prose untouched. Filter by ``may_hold_doi`` first, as every row given goes through Python."""
    return extract_dois(_mended(c))


def may_hold_doi(c: Column) -> Column:
    return c.rlike(r"[1１][0０]\s*[.．]\s*[0-9０-９]{4}")
