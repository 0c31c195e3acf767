"""Classifiers as ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Section names of the first level.
SECTIONS = ["introduction", "methods", "results", "discussion", "conclusion", "conclusions", "references", "results and discussion", "materials and methods", "abstract"]


# Thresholds of headings and blocks: fixed values.
def heading_shape(t: Column) -> Column:
    """Text that may be a heading: letters prevail, few digits and commas, no closing punctuation, no address."""
    count = lambda p: F.length(F.regexp_replace(t, p, ""))
    letters, digits = count(r"[^\p{L}]"), count("[^0-9]")
    commas = F.length(t) - count(",")
    return (letters >= 3) & (letters >= 0.4 * F.length(t)) & (digits <= F.greatest(F.lit(1.0), letters / 4.0)) & ~t.rlike("[.;,]$") & (commas < 2) & ~t.rlike("https?://|@")


def heading_level(t: Column) -> Column:
    """Depth of a dotted number up to 5, 2 for roman numbers and letters, 1 for known names, else 2."""
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)*)", 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    return F.when(t.rlike(r"^[0-9]+(?:\.[0-9]+)*\.?\s"), F.least(dots + 1, F.lit(5))).when(t.rlike(r"^(?:[IVX]+|[A-Z])\.\s"), 2).when(F.lower(F.trim(t)).isin(SECTIONS), 1).otherwise(2)


def block_kind(text: Column, font: Column, median: Column, bold: Column) -> Column:
    """caption, reference, equation, heading or paragraph, in that order."""
    caption = text.rlike(r"^(?i:fig(?:ure)?\.?|table|scheme|图|表)\s*[0-9]+")
    reference = text.rlike(r"^\[[0-9]+\]\s")
    greek = F.regexp_count(text, F.lit("[α-ωΑ-Ω∑∫√∂∇≈≤≥]"))
    equation = ((greek >= 2) & (F.length(text) <= 160)) | text.rlike(r"^\s*\S{1,8}\s*=\s*.+\([0-9]+\)\s*$")
    short = (F.length(text) <= 120) & (F.size(F.split(F.trim(text), r"\s+")) <= 14)
    big = (font >= 1.35 * median) | (bold & (font >= 1.02 * median)) | F.lower(F.trim(text)).isin(SECTIONS)
    return F.when(caption, "caption").when(reference, "reference").when(equation, "equation").when(short & heading_shape(text) & big, "heading").otherwise("paragraph")


# The role of an attachment by the words of its label or file name. First words, then second words that follow after
# blanks, hyphens or underscores (none: the first stand alone); the first role that is met holds.
ROLES = {
    "PEER_REVIEW": [("peer", "review"), ("review", "file history"), ("审稿", "")],
    "REPORTING_SUMMARY": [("reporting", "summary checklist")],
    "SOURCE_DATA": [("source", "data"), ("原始数据", "")],
    "SUPPLEMENT": [
        ("supplementary supplemental supplement", "information material data file appendix table tables figure figures"),
        ("supporting", "information material data"),
        ("补充信息 补充材料", ""),
    ],
}
# Beginnings of the file names of supplements, after a slash or underscore.
SUPPLEMENT_FILES = ["moesm[0-9]+[_-]esm", "suppinfo", "supporting_info"]


def attachment_role(label: Column, path: Column) -> Column:
    """Role of an attachment from its label and the path of its address (decoded); null where nothing tells it."""
    t = F.lower(F.concat_ws(" ", label, F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)))
    role = F.when(F.lit(False), "")
    for name, pairs in ROLES.items():
        met = F.lit(False)
        for first, second in pairs:
            follow = f"[ _\\t-]*(?:{'|'.join(second.split())})" if second else ""
            met = met | t.rlike(f"(?:{'|'.join(first.split())}){follow}")
        if name == "SUPPLEMENT":
            met = met | t.rlike(f"(?:^|[/_])(?:{'|'.join(SUPPLEMENT_FILES)})")
        role = role.when(met, name)
    return role


def by_precedence(rows: DataFrame, key: str, rules: list[tuple[Column, str]], otherwise: str, out: str = "status") -> DataFrame:
    """The strongest label any row of a key earns."""
    rank = F.lit(len(rules))
    for k in range(len(rules) - 1, -1, -1):
        rank = F.when(rules[k][0], k).otherwise(rank)
    labels = F.array(*[F.lit(v) for _, v in rules], F.lit(otherwise))
    return rows.groupBy(key).agg(F.min(rank).alias("_r")).select(key, F.element_at(labels, F.col("_r") + 1).alias(out))


def gate(rules: list[tuple[Column, str]], passed: str = "OK") -> Column:
    """The first check that fails."""
    c = F.when(F.lit(False), "")
    for bad, code in rules:
        c = c.when(F.coalesce(bad, F.lit(True)), code)
    return c.otherwise(passed)
