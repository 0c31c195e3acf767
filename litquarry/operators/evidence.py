"""Evidence locations: fallbacks, unique places, greedy suppression, order of parts, Markdown packs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litquarry.functions.text import markdown_escape
from litquarry.operators.slots import held, marked

# Odd numbers that spread bits, and characters hashed at once, about.
BASE, SCATTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
STRETCH = 1 << 19
# Fixed value: a text has hundreds of runs for one quote, so the bitmap is made for so many times the quotes.
THIN = 64


def with_fallbacks(rows: DataFrame, levels: list[tuple[str, DataFrame, list[str]]], out: str, otherwise: str = "none") -> DataFrame:
    """The strongest level at which a row is found; every level is an equi-join on its own key."""
    label = F.lit(otherwise)
    for i in range(len(levels) - 1, -1, -1):
        name, known, on = levels[i]
        rows = rows.join(known.select(*on, F.lit(True).alias(f"_{name}")), on, "left")
        label = F.when(F.col(f"_{name}"), name).otherwise(label)
    return rows.withColumn(out, label).drop(*[f"_{n}" for n, _, _ in levels])


def rolling(cp: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` code points, put together from runs of powers of two."""
    power, run, out, done = BASE, cp.astype(np.uint64) * SCATTER, None, 0
    while True:
        if length >> done & 1:
            # ``out`` covers the lowest ``length % 2**done`` code points of each run.
            k = length & (1 << done) - 1
            out = run if out is None else out[: len(out) - (1 << done)] * power + run[k:] if len(out) > 1 << done else out[:0]
        done += 1
        if length >> done == 0:
            out = out ^ out >> np.uint64(29)
            return out * SCATTER
        half = 1 << done - 1
        run = run[:-half] * power + run[half:] if len(run) > half else run[:0]
        power = np.uint64(int(power) ** 2 % (1 << 64))


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def salted(hashes: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The hashes in the source that ``salt`` stands for."""
    x = (hashes ^ salt.astype(np.uint64)) * SCATTER
    return (x ^ x >> np.uint64(32)).view(np.int64)


def unique_location(quotes: DataFrame, blocks: DataFrame, source: str, quote: str, text: str, quote_id: str, block_id: str) -> DataFrame:
    """The block of a quote that occurs in one block of its source only, and there once.

    Every run of a text that is as long as a quote is hashed; those that a bitmap of the quotes' hashes holds are joined with the quotes
    as strings. So a large source costs its length, not its quotes times its blocks. The work grows with the number of different lengths of
    quotes. Null and empty quotes are nowhere; occurrences in a block are counted without overlap.
    """
    asked = quotes.filter(F.length(quote) > 0).select(F.col(source).alias("_source"), F.col(quote).alias("_quote"), F.col(quote_id).alias("_id"))
    known = asked.select("_source", "_quote").filter("_source is not null").distinct()
    found = known.groupBy(F.length("_quote").alias("n")).count().collect()  # a row for each length
    lengths = sorted(r["n"] for r in found)

    def hashed(batches):
        for b in batches:
            salt, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            out = np.zeros(len(texts), np.uint64)
            for n in set(map(len, texts)):
                own = [k for k, t in enumerate(texts) if len(t) == n]
                out[own] = rolling(code_points([texts[k] for k in own]), n)[::n]
            yield pa.RecordBatch.from_arrays([pa.array(salted(out, salt))], names=["h"])

    bits = quotes.sparkSession.sparkContext.broadcast(marked(known.select(F.xxhash64("_source"), "_quote").mapInArrow(hashed, "h bigint"), THIN * sum(r["count"] for r in found)))

    def runs(batches):
        for b in batches:
            b = pa.Table.from_batches([b])
            ends = np.cumsum([len(t) for t in b.column(2).to_pylist()])
            cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(STRETCH, ends[-1] if len(ends) else 0, STRETCH)), len(ends)])
            for lo, hi in zip(cuts, cuts[1:]):
                yield run_of(b.slice(lo, hi - lo))

    def run_of(b):
        texts = b.column(2).to_pylist()
        cp, edge = code_points(texts), np.cumsum([0, *map(len, texts)])
        row = np.repeat(np.arange(len(texts)), np.diff(edge))
        salt = b.column(1).to_numpy()
        got: dict[tuple[int, str], list[int]] = {}
        for n in lengths:
            h = rolling(cp, n)
            at = np.flatnonzero(row[: len(h)] == row[n - 1 :])
            for p in at[held(salted(h[at], salt[row[at]]), bits.value)].tolist():
                r = int(row[p])
                start = p - int(edge[r])
                seen = got.setdefault((r, texts[r][start : start + n]), [0, -n])
                if start >= seen[1] + n:
                    seen[0], seen[1] = seen[0] + 1, start
        take = pa.array([r for r, _ in got], type=pa.int64())
        columns = [b.column(0).take(take), b.column(3).take(take), pa.array([q for _, q in got], type=pa.string()), pa.array([n for n, _ in got.values()], type=pa.int64())]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["_source", "_block", "_quote", "_n"])

    kinds = dict(blocks.dtypes)
    texts = blocks.filter(F.col(source).isNotNull() & F.col(text).isNotNull()).select(F.col(source).alias("_source"), F.xxhash64(source).alias("_salt"), F.col(text).alias("_text"), F.col(block_id).alias("_block"))
    held_by = texts.mapInArrow(runs, f"_source {kinds[source]}, _block {kinds[block_id]}, _quote string, _n bigint").groupBy("_source", "_quote").agg(F.count("*").alias("_blocks"), F.min("_n").alias("_n"), F.min("_block").alias("_block"))
    hit = asked.join(held_by, ["_source", "_quote"]).groupBy("_id").agg(F.sum("_blocks").alias("_blocks"), F.min("_n").alias("_n"), F.min("_block").alias("_block"))
    return hit.filter("_blocks = 1 and _n = 1").select(F.col("_id").alias(quote_id), F.col("_block").alias(block_id))


def keep_greedily(hits: DataFrame, key: str, id_col: str, blocks_col: str, score_col: str) -> DataFrame:
    """From the best score on, a hit is hidden when at least half of the smaller block set is already kept. The fold runs over the hits of
    one artifact that a query matched."""

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([score_col, id_col], ascending=[False, True])
        kept: list[set] = []
        flags = []
        for blocks in f[blocks_col]:
            b = set(blocks)
            ok = all(2 * len(b & k) < min(len(b), len(k)) for k in kept)
            flags.append(ok)
            if ok:
                kept.append(b)
        return f.assign(kept=flags)

    schema = ", ".join(f"`{c}` {t}" for c, t in hits.dtypes) + ", kept boolean"
    return hits.groupBy(key).applyInPandas(fold, schema)


def in_order(have: Column, want: Column) -> Column:
    """Whether ``want`` is a subsequence of ``have``."""
    at = F.aggregate(have, F.lit(0), lambda k, x: F.when((k < F.size(want)) & x.eqNullSafe(F.get(want, k)), k + 1).otherwise(k))
    return at == F.size(want)


def pack_markdown(blocks: DataFrame, key: str, title: str, order: list[str], page: str, text: str) -> DataFrame:
    """One Markdown text per document: a heading, then the blocks by page with their place."""
    line = F.struct(*order, F.concat(F.lit("- p. "), F.col(page).cast("string"), F.lit(": "), markdown_escape(F.col(text))).alias("line"))
    g = blocks.filter(F.col(text).isNotNull()).groupBy(key).agg(F.first(title, ignorenulls=True).alias("_t"), F.array_sort(F.collect_list(line)).alias("_l"))
    return g.select(key, F.concat(F.lit("# "), markdown_escape(F.coalesce("_t", F.col(key).cast("string"))), F.lit("\n\n"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).alias("markdown"))
