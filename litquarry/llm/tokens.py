"""Whole-corpus encoding with a public byte-level BPE vocabulary.

Method: forced-boundary splitting. A byte pair that occurs inside no vocabulary token can never be merged across, so it
marks a certain cut. Certain cuts of the tokenizer's own splitting pattern (before white space that follows other text) and
those byte pairs divide a text into fragments; each distinct fragment is encoded once on its own and the ids are
concatenated. Merges are local and ordered by rank, so encoding the fragments independently gives the ids of the whole text.

Defined results: null and empty texts give the empty list; blank texts are encoded like any other; a repeated row gets its
own row; strings that spell special tokens are ordinary text. Columns of the input beyond the id and the text are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TOKENIZER_DIR = "/opt/tokenizers"

# Fixed value: the splitting pattern of the byte_bpe vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPACE = "\t-\r \x85\xa0  -     　"
_SEGMENT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_MEMO_LIMIT = 400_000


class ForcedBoundaryEncoder:
    """Encoder over a rank file; memoises segments so that repeated words cost one dictionary look-up."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        inside = np.zeros(65536, dtype=bool)
        for token in self.ranks:
            b = np.frombuffer(token, dtype=np.uint8).astype(np.int64)
            inside[b[:-1] * 256 + b[1:]] = True
        self.mergeable = inside
        self.pattern = regex.compile(PATTERN)
        self.cuts_at = bytes(~inside)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.merged: dict[bytes, list[int]] = {}

    def fragments(self, piece: bytes) -> list[bytes]:
        """Cut at every byte pair that lies inside no vocabulary token."""
        n = len(piece)
        if n < 64:
            at, cuts = self.cuts_at, []
            for i in range(1, n):
                if at[piece[i - 1] << 8 | piece[i]]:
                    cuts.append(i)
            return [piece[i:j] for i, j in zip([0, *cuts], [*cuts, n])]
        b = np.frombuffer(piece, dtype=np.uint8).astype(np.int64)
        cuts = np.flatnonzero(~self.mergeable[b[:-1] * 256 + b[1:]]) + 1
        edges = [0, *cuts.tolist(), len(piece)]
        return [piece[i:j] for i, j in zip(edges, edges[1:])]

    def merge(self, fragment: bytes) -> list[int]:
        """Byte-pair merges of one fragment by ascending rank."""
        ranks = self.ranks
        whole = ranks.get(fragment)
        if whole is not None:
            return [whole]
        if len(fragment) > 400:
            return self._merge_long(fragment)
        parts = [fragment[i : i + 1] for i in range(len(fragment))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, fragment: bytes) -> list[int]:
        """The same merges with a heap over a linked list: n log n for fragments without a cut."""
        import heapq

        ranks, n = self.ranks, len(fragment)
        parts: list[bytes | None] = [fragment[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(fragment[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] = parts[i] + parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                joined = parts[i] + parts[after[i]]
                if (r := ranks.get(joined)) is not None:
                    heapq.heappush(heap, (r, i, len(joined)))
            if before[i] >= 0:
                joined = parts[before[i]] + parts[i]
                if (r := ranks.get(joined)) is not None:
                    heapq.heappush(heap, (r, before[i], len(joined)))
        return [ranks[p] for p in parts if p is not None]

    def segment(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.pattern.findall(text):
            for fragment in self.fragments(piece.encode("utf-8", "replace")):
                got = self.merged.get(fragment)
                if got is None:
                    got = self.merge(fragment)
                    if len(fragment) <= 64:
                        if len(self.merged) >= _MEMO_LIMIT:
                            self.merged.clear()
                        self.merged[fragment] = got
                out += got
        ids = tuple(out)
        if len(self.memo) >= _MEMO_LIMIT:
            self.memo.clear()
        if len(text) <= 64:
            self.memo[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, segment = self.memo.get, self.segment
        return list(chain.from_iterable([memo(s) or segment(s) for s in _SEGMENT.findall(text)]))


    def count(self, text: str | None) -> int:
        """Number of ids of a text, without putting them in one list."""
        if not isinstance(text, str):
            return 0
        memo, segment = self.memo.get, self.segment
        return sum([len(memo(s) or segment(s)) for s in _SEGMENT.findall(text)])


@lru_cache(maxsize=4)
def encoder(path: str) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(path)


def tokenizer_path(name: str, folder: str = DEFAULT_TOKENIZER_DIR) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_TOKENIZER_DIR) -> DataFrame:
    """``id_col, ids array<int>``: one narrow pass, no shuffle; the vocabulary file is read once per Python worker."""
    path = tokenizer_path(tokenizer, folder)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            encoded = [enc.encode(t) for t in texts]
            offsets = np.zeros(len(texts) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in encoded], out=offsets[1:])
            values = pa.array(np.fromiter(chain.from_iterable(encoded), dtype=np.int32, count=int(offsets[-1])))
            ids = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text_col: str, out_col: str = "tokens", tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_TOKENIZER_DIR) -> DataFrame:
    """Adds the number of ids of ``text_col`` without sending the ids back; 0 for null and empty texts."""
    path = tokenizer_path(tokenizer, folder)

    @F.pandas_udf("long")
    def sizes(texts: pd.Series) -> pd.Series:
        enc = encoder(path)
        return pd.Series([enc.count(t) for t in texts], dtype="int64")

    return df.withColumn(out_col, sizes(F.col(text_col)))
