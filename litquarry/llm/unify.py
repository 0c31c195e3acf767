"""One consistent form for text that looks the same but is stored with different characters.

Method: the UTF-8 of a whole Arrow batch becomes one numpy array of code points. Lookup tables give each code point's class and
the offset and length of its expansion; one gather replaces all characters, then marks are ordered and composed by vectorised
passes. No string operation runs per row.

What is made equal: width variants, ligatures and other joined characters, compatibility ideographs and radicals, spaces of every
width, hyphen variants, invisible characters, decomposed accents and conjoining letters, look-alike letters of other scripts.
What stays: letter case, accents, punctuation, raised and lowered digits, mathematical alphabets, markup, line breaks.

A look-alike letter takes the script of its word, decided by the letters that occur in one script only; a word without such
letters takes the script that prevails in the text, Latin where none does. Equal-looking texts share those letters, so they get
equal forms.

Defined results: null stays null, the empty text stays empty, a text of invisible characters only becomes empty; rows are kept one to one.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litquarry.session import written

SIZE = 0x110000
RUN_BYTES = 1 << 19
FOLDED_TAGS = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
# Characters drawn like another one, in the order of the plain letters.
LATIN_CYRILLIC = ("ABCEHIJKMOPSTXYaceijopsxyhdqwvlGQWVY", "АВСЕНІЈКМОРЅТХУасеіјорѕхуһԁԛԝѵӏԌԚԜѴҮ")
LATIN_GREEK = ("ABEHIKMNOPTXYZov", "ΑΒΕΗΙΚΜΝΟΡΤΧΥΖον")
# Drawn like Latin letters in other blocks (phonetic, Armenian, Cherokee, Lisu), in the order of the plain letters; read as Latin in texts that hold Latin letters.
LATIN_OTHER = (
    "gogOUADEGHJKLMPRSTVWZbABCDEFGHIJKLMNOPRSTUVWXYZ",
    "ɡօցՕՍᎪᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃᏏꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ",
)
HYPHENS = "‐‑"
# Visible although their decomposition is of a folded kind.
KEPT = "ſ"


@lru_cache(maxsize=1)
def tables() -> SimpleNamespace:
    """Lookup tables over all code points, derived from the character database of the running Python."""
    drop = np.zeros(SIZE, dtype=bool)
    ccc = np.zeros(SIZE, dtype=np.uint8)
    length = np.ones(SIZE, dtype=np.int32)
    start = np.arange(SIZE, dtype=np.int64)
    pool: list[int] = []
    pairs: dict[tuple[int, int], int] = {}
    letter = np.zeros(SIZE, dtype=bool)
    width = np.ones(SIZE, dtype=np.int8)
    width[0x80:], width[0x800:], width[0x10000:] = 2, 3, 4
    hyphens, kept = {ord(c) for c in HYPHENS}, {ord(c) for c in KEPT}

    def expand(c: int) -> list[int]:
        if c in hyphens:
            return [0x2D]
        if 0xAC00 <= c <= 0xD7A3:
            return [c]  # syllables stay composed
        d = unicodedata.decomposition(chr(c))
        if not d or c in kept:
            return [c]
        tag, *rest = d.split() if d[0] == "<" else ("", *d.split())
        if tag and tag not in FOLDED_TAGS:
            return [c]
        parts = [int(x, 16) for x in rest]
        if tag == "<compat>" and parts[0] == 0x20 and len(parts) > 1:
            return [c]  # spacing accents
        out = [x for p in parts for x in expand(p)]
        if not tag and len(out) > 1 and any(unicodedata.combining(chr(x)) == 0 for x in out[1:]):
            return [c]  # a composition of two letters stays as it is
        return out

    # Planes 4 to 13 hold no characters, 15 and 16 only private ones.
    for c in (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE0200)):
        s = chr(c)
        kind = unicodedata.category(s)
        if kind in ("Cn", "Co"):
            continue
        ccc[c] = unicodedata.combining(s)
        letter[c] = kind[0] in "LM"
        if (kind == "Cf" and c != 0xAD) or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c == 0x34F or (kind == "Cc" and s not in "\t\n\r"):
            drop[c] = True
        elif kind == "Zs" or c == 9:
            pool.append(0x20)
            start[c] = -len(pool)
        else:
            out = expand(c)
            if out != [c]:
                start[c], length[c] = -(len(pool) + 1), len(out)
                pool += out
            d = unicodedata.decomposition(s)
            if d and d[0] != "<" and len(d.split()) == 2 and unicodedata.normalize("NFC", s) == s:
                a, b = (int(x, 16) for x in d.split())
                pairs[a, b] = c
    folded = np.arange(SIZE, dtype=np.int32)  # look-alike -> Latin
    script = np.zeros(SIZE, dtype=np.int8)  # of letters that occur in one script only: 1 Latin, 2 Cyrillic, 3 Greek
    for low, high, n in ((0x41, 0x250, 1), (0x400, 0x530, 2), (0x370, 0x400, 3)):
        script[low:high] = np.where(letter[low:high], n, 0)
    back = {n: np.arange(SIZE, dtype=np.int32) for n in (2, 3)}
    for n, (plain, like) in ((2, LATIN_CYRILLIC), (3, LATIN_GREEK)):
        for a, b in zip(plain, like):
            folded[ord(b)], back[n][ord(a)] = ord(a), ord(b)
            script[ord(a)] = script[ord(b)] = 0
    other = np.arange(SIZE, dtype=np.int32)
    other[[ord(c) for c in LATIN_OTHER[1]]] = [ord(c) for c in LATIN_OTHER[0]]
    keys = np.array([(a << 21) | b for a, b in pairs], dtype=np.int64)
    order = np.argsort(keys)
    return SimpleNamespace(drop=drop, ccc=ccc, length=length, start=start, pool=np.array(pool, dtype=np.int64), folded=folded, other=other, script=script, back=back, letter=letter, width=width, keys=keys[order], made=np.array(list(pairs.values()), dtype=np.int64)[order])


def compose(cp: np.ndarray, row: np.ndarray, t: SimpleNamespace) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order of marks, then composition; also of conjoining Hangul letters."""
    ccc = t.ccc[cp]
    n = len(cp)
    if n and (ccc > 0).any():
        at = np.arange(n)
        is_start = ccc == 0
        is_start |= np.r_[True, row[1:] != row[:-1]]
        base = np.maximum.accumulate(np.where(is_start, at, 0))
        marks = np.flatnonzero(ccc > 0)  # those before the first letter of a text are ordered among themselves
        order = marks[np.lexsort((marks, ccc[marks], base[marks]))]
        cp[marks] = cp[order]
        ccc[marks] = ccc[order]
        alive = np.ones(n, dtype=bool)
        stuck = np.zeros(n, dtype=np.uint8)
        step = marks - base[marks]
        for k in range(1, int(step.max(initial=0)) + 1):
            m = marks[step == k]
            b = base[m]
            key = (cp[b] << 21) | cp[m]
            i = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
            ok = (t.keys[i] == key) & ((stuck[b] == 0) | (stuck[b] < ccc[m])) & (t.ccc[cp[b]] == 0)
            cp[b[ok]] = t.made[i[ok]]
            alive[m[ok]] = False
            stuck[b[~ok]] = ccc[m[~ok]]
        cp, row = cp[alive], row[alive]
    jamo = (cp >= 0x1100) & (cp < 0x1200)
    if jamo.any() and len(cp) > 1:
        lead = np.flatnonzero((cp[:-1] >= 0x1100) & (cp[:-1] < 0x1113) & (cp[1:] >= 0x1161) & (cp[1:] < 0x1176) & (row[:-1] == row[1:]))
        cp[lead] = 0xAC00 + ((cp[lead] - 0x1100) * 21 + cp[lead + 1] - 0x1161) * 28
        alive = np.ones(len(cp), dtype=bool)
        alive[lead + 1] = False
        cp, row = cp[alive], row[alive]
        tail = np.flatnonzero((cp[:-1] >= 0xAC00) & (cp[:-1] <= 0xD7A3) & ((cp[:-1] - 0xAC00) % 28 == 0) & (cp[1:] > 0x11A7) & (cp[1:] < 0x11C3) & (row[:-1] == row[1:]))
        cp[tail] += cp[tail + 1] - 0x11A7
        alive = np.ones(len(cp), dtype=bool)
        alive[tail + 1] = False
        cp, row = cp[alive], row[alive]
    return cp, row


def by_script(cp: np.ndarray, row: np.ndarray, rows: int, t: SimpleNamespace) -> np.ndarray:
    """Gives look-alike letters the script of their word."""
    strange = t.other[cp] != cp
    if strange.any():
        latin = np.bincount(row, weights=(cp < 128) & t.letter[cp], minlength=rows) > 0
        cp = np.where(strange & latin[row], t.other[cp], cp)
    script = t.script[cp]
    if not ((t.folded[cp] != cp) | (script > 1)).any():
        return cp
    letter = t.letter[cp]
    edge = np.r_[True, (letter[1:] != letter[:-1]) | (row[1:] != row[:-1])]
    word = np.cumsum(edge) - 1
    words = int(word[-1]) + 1
    per_word = np.stack([np.bincount(word, weights=script == n, minlength=words) for n in (1, 2, 3)])
    per_row = np.stack([np.bincount(row, weights=script == n, minlength=rows) for n in (1, 2, 3)])
    chosen = np.where(per_word.max(axis=0) > 0, per_word.argmax(axis=0), per_row.argmax(axis=0)[row[edge]]) + 1
    of = chosen[word]
    out = t.folded[cp].astype(np.int64)
    for n in (2, 3):
        pick = of == n
        out[pick] = t.back[n][out[pick]]
    return out


def unify_codepoints(cp: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Unified code points and their rows; ``row`` is the non-decreasing row number of every code point."""
    t = tables()
    # A soft hyphen shows only at the end of a line.
    soft = cp == 0xAD
    if soft.any():
        ends = np.zeros(len(cp), dtype=bool)
        ends[:-1] = (cp[1:] == 10) | (cp[1:] == 13)
        ends[:-1] &= row[:-1] == row[1:]
        cp = np.where(soft & ends, 0x2D, cp)
        keep = ~(soft & ~ends)
        cp, row = cp[keep], row[keep]
    # A carriage return with its line feed is one line break.
    cr = cp == 13
    if cr.any():
        pair = np.zeros(len(cp), dtype=bool)
        pair[:-1] = cr[:-1] & (cp[1:] == 10) & (row[:-1] == row[1:])
        cp = np.where(cr & ~pair, 10, cp)
        cp, row = cp[~pair], row[~pair]
    keep = ~t.drop[cp]
    cp, row = cp[keep], row[keep]
    if not len(cp):
        return cp, row
    start, length = t.start[cp], t.length[cp].astype(np.int64)
    if (start < 0).any():
        offset = np.cumsum(length) - length
        source = np.repeat(np.arange(len(cp)), length)
        inner = np.arange(len(source)) - offset[source]
        s = start[source]
        cp = np.where(s < 0, t.pool[np.where(s < 0, -s - 1 + inner, 0)], s)
        row = row[source]
    cp, row = compose(by_script(cp.astype(np.int64), row, rows, t), row, t)
    return cp, row


def unify_arrow(texts: pa.Array) -> pa.Array:
    """The unified form of an Arrow string array, worked on in runs of about ``RUN_BYTES`` to bound the memory of the arrays."""
    texts = texts.cast(pa.large_string())
    rows = len(texts)
    if not rows:
        return texts.cast(pa.string())
    edge = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + rows + 1]
    run = (edge[1:] - edge[0]) // RUN_BYTES
    cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), rows]
    return pa.concat_arrays([_unify_run(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])


def _unify_run(texts: pa.Array) -> pa.Array:
    rows = len(texts)
    _, offsets, data = texts.buffers()
    edge = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + rows + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[edge[0] : edge[-1]] if data is not None else np.zeros(0, np.uint8)
    valid = np.asarray(texts.is_valid())
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    starts = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    row = np.repeat(np.arange(rows), np.diff(starts[edge - edge[0]]))
    cp, row = unify_codepoints(cp, row, rows)
    size = np.bincount(row, weights=tables().width[cp], minlength=rows).astype(np.int64)
    out = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
    made = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out), pa.py_buffer(np.packbits(valid, bitorder="little").tobytes()))
    return made.cast(pa.string())


def unify_text(df: DataFrame, text_col: str, out_col: str = "unified") -> DataFrame:
    """``df`` with the unified form of ``text_col`` in ``out_col``; one narrow Arrow pass."""

    @F.arrow_udf("string")
    def unified(texts: pa.Array) -> pa.Array:
        return unify_arrow(texts)

    return df.withColumn(out_col, unified(F.col(text_col)))


def lookalike_keys(texts: DataFrame) -> DataFrame:
    """``src_table, id, key, form`` of rows (``src_table, id, text``) whose key has several stored forms; key and form are hashes of 16 bytes, made before anything is shuffled."""
    base = unify_text(texts.filter("text is not null and text <> ''"), "text").select("src_table", "id", F.md5("unified").alias("key"), F.md5("text").alias("form"))
    base = written(base)  # read several times; the narrow hashes are written once instead of unifying the texts again
    several = base.groupBy("src_table", "key").agg(F.min("form").alias("low"), F.max("form").alias("high")).filter("low <> high").select("src_table", "key")
    return base.join(several, ["src_table", "key"], "left_semi")


def lookalike_classes(texts: DataFrame) -> DataFrame:
    """``src_table, id, class_id, forms``: every row that looks like a differently stored one, with the least id of its class and the number of stored forms; copies are not paired."""
    rows = lookalike_keys(texts)
    classes = rows.groupBy("src_table", "key").agg(F.min("id").alias("class_id"), F.count_distinct("form").alias("forms"))
    return rows.join(classes, ["src_table", "key"]).select("src_table", "id", "class_id", "forms")


def lookalike_pairs(texts: DataFrame, hot: int = 5_000, salts: int = 16) -> DataFrame:
    """``src_table, id_a, id_b`` of rows (``src_table, id, text``) whose texts look the same and are stored differently.

    Keys with a single stored form are dropped by a map-side combined min/max, so copies never meet; forms of one key are then paired
    form by form, and rows are attached to both ends. A form with more than ``hot`` rows is salted at the second end, so the work follows the
    number of result rows and no form is held by one task.
    """
    rows = lookalike_keys(texts)
    on = ["src_table", "key"]
    forms = rows.groupBy(*on, "form").agg(F.count("*").alias("n"))
    pairs = forms.select(*on, F.col("form").alias("form_a")).join(forms.select(*on, F.col("form").alias("form_b"), "n"), on).filter("form_a < form_b")
    left = rows.select(*on, F.col("form").alias("form_a"), F.col("id").alias("x"))
    crowded = forms.filter(F.col("n") > hot).select(*on, F.col("form").alias("form_b"), F.lit(True).alias("crowded"))  # a few: each has many rows
    right = rows.select(*on, F.col("form").alias("form_b"), F.col("id").alias("y")).join(crowded, [*on, "form_b"], "left")
    right = right.withColumn("salt", F.when(F.col("crowded"), F.pmod(F.hash("y"), F.lit(salts))).otherwise(0)).drop("crowded")
    ends = pairs.join(left, [*on, "form_a"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > hot, salts - 1).otherwise(0))))
    return ends.join(right, [*on, "form_b", "salt"]).select("src_table", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
