"""Splitting oversized texts at natural boundaries, with overlap between consecutive pieces.

Method: a recursive hierarchy of separators. A text over the limit is split at section breaks; a part that is still too long is
split at paragraphs, then lines, sentences, words and finally characters. The parts are packed greedily: a piece ends at the last
part that fits, the next piece starts exactly ``overlap`` characters before that end. Parts are at most ``limit - overlap`` long,
so every piece moves on and none is over the limit. Pieces are slices of the stored text: leaving out the overlaps gives it back.

Defined results: null and empty texts give no piece; a text within the limit is one piece; an overlap of the limit or more counts
as one less than the limit; a null or non-positive limit means no limit. Lengths are in code points. Extra columns are ignored.
Only texts over the limit leave the JVM.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# From the strongest boundary to the weakest; a part ends where a match ends.
LEVELS = [
    re.compile(r"\f|\n[^\S\n]*\n(?=[^\S\n]*(?:#{1,6} |(?:\d+(?:\.\d+)*\.?|[IVX]+\.)[^\S\n]+[^\W\d_])[^\n]{0,80}(?:\n|\Z))"),
    re.compile(r"\n[^\S\n]*(?:\r?\n[^\S\n]*)+"),
    re.compile(r"(?<=[.!?;:])[\"'”’)\]]*\r?\n|\r?\n(?=[-*•] )"),
    re.compile(r"(?:[.!?…]+[\"'”’)\]]*(?=\s+[^a-zß-öø-ÿа-я])|[。！？；]+[”’」』）]*)\s*"),
    re.compile(r"[;:,，、]\s+|[，、：]"),
    re.compile(r"\s+"),
]


def bounds(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of every piece of ``text``."""
    n = len(text)
    if n == 0:
        return []
    if limit <= 0 or n <= limit:
        return [(0, n)]
    overlap = max(0, min(overlap, limit - 1))
    most = limit - overlap
    parts = [(0, n)]
    for level in LEVELS:
        if all(b - a <= most for a, b in parts):
            break
        finer = []
        for a, b in parts:
            if b - a <= most:
                finer.append((a, b))
                continue
            at = a
            for m in level.finditer(text, a, b):
                if m.end() > at:
                    finer.append((at, m.end()))
                    at = m.end()
            if at < b:
                finer.append((at, b))
        parts = finer
    ends = []
    for a, b in parts:
        while b - a > most:
            cut = a + most
            back = cut  # not between a letter and its marks, unless they alone fill a part
            while back > a and (unicodedata.combining(text[back]) or text[back] in "‍️"):
                back -= 1
            cut = back if back > a else cut
            ends.append(cut)
            a = cut
        ends.append(b)
    out, start, i = [], 0, 0
    while True:
        while i + 1 < len(ends) and ends[i + 1] <= start + limit:
            i += 1
        out.append((start, ends[i]))
        if ends[i] >= n:
            return out
        start = ends[i] - overlap
        i += 1


def split_texts(df: DataFrame, id_col: str, text_col: str, limit_col: str, overlap_col: str) -> DataFrame:
    """``id_col, piece_no, start_char, end_char, piece`` of every text, numbered from 0."""
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(limit_col).alias("most"), F.coalesce(F.col(overlap_col), F.lit(0)).alias("lap")).filter("text <> ''")
    fits = "most is null or most <= 0 or length(text) <= most"

    def run(frames):
        for f in frames:
            rows = []
            for i, text, most, lap in zip(f["id"], f["text"], f["most"], f["lap"]):
                rows += [(i, k, a, b, text[a:b]) for k, (a, b) in enumerate(bounds(text, int(most), int(lap)))]
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=["id", "piece_no", "start_char", "end_char", "piece"])
                    rows = []
            yield pd.DataFrame(rows, columns=["id", "piece_no", "start_char", "end_char", "piece"])

    whole = src.filter(fits).select("id", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("start_char"), F.length("text").cast("long").alias("end_char"), F.col("text").alias("piece"))
    cut = src.filter(f"not ({fits})").mapInPandas(run, f"id {kind}, piece_no int, start_char long, end_char long, piece string")
    return whole.unionByName(cut).withColumnRenamed("id", id_col)


def oversized(pieces: DataFrame, id_col: str) -> DataFrame:
    """Ids of the texts that had to be cut: those with a second piece."""
    return pieces.filter("piece_no = 1").select(id_col)
