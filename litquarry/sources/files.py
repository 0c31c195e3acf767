"""File sources and sinks: sidecar scans, input lists, spreadsheets cell by cell, chunk and table exports."""

from __future__ import annotations

import re
import zipfile
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from litquarry.functions.classify import gate
from litquarry.functions.identifiers import normalize_doi
from litquarry.functions.text import csv_guard, markdown_escape
from litquarry.operators.windows import carry

SIDECAR = "schema string, status string, acquired_at string, target struct<doi:string,expected_title:string>, retrieval struct<sha256:string>, pdf_validation struct<valid_pdf:boolean,page_count:int>, identity_validation struct<status:string,document_role:string>, _corrupt string"


def scan_sidecars(spark: SparkSession, root: str, suffix: str = "*.acquisition.json") -> DataFrame:
    """Every sidecar below ``root`` with its path; unreadable ones stay as rows with their text in ``_corrupt``."""
    r = spark.read.schema(SIDECAR).option("recursiveFileLookup", True).option("pathGlobFilter", suffix).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return r.json(root).withColumn("path", F.input_file_name())


def gate_code(sidecars: DataFrame) -> DataFrame:
    """The first check a record fails that shows in the record itself, or OK; ``parser_gate`` has all checks, with the file."""
    return sidecars.withColumn(
        "gate_code",
        gate(
            [
                (F.col("_corrupt").isNotNull(), "UNREADABLE_SIDECAR"),
                (F.col("schema").isNull(), "UNKNOWN_SCHEMA"),
                (F.col("status") != "VERIFIED", "NOT_VERIFIED"),
                (~F.col("retrieval.sha256").rlike("^[0-9a-f]{64}$"), "BAD_HASH"),
                (~F.col("pdf_validation.valid_pdf"), "INVALID_PDF"),
                (F.col("pdf_validation.page_count") <= 0, "NO_PAGES"),
                (normalize_doi(F.col("target.doi")).isNull(), "BAD_DOI"),
                (F.col("identity_validation.status") != "MATCH", "IDENTITY_MISMATCH"),
                (F.col("identity_validation.document_role") != "ARTICLE", "NOT_AN_ARTICLE"),
            ]
        ),
    )


# The checks of a record before its file is parsed, in their order.
GATE_CODES = [
    "PDF_NOT_FOUND", "UNVERIFIED_PATH", "SIDECAR_NOT_FOUND", "INVALID_SIDECAR", "UNKNOWN_SIDECAR_SCHEMA", "STATUS_NOT_VERIFIED", "PDF_VALIDATION_FAILED", "IDENTITY_NOT_MATCHED", "DOCUMENT_NOT_ARTICLE",
    "DOI_MISMATCH", "INVALID_RECORDED_HASH", "PDF_HASH_MISMATCH", "PDF_UNREADABLE", "PAGE_COUNT_MISMATCH",
]


def parser_gate(sidecars: DataFrame, schemas: list[str] | None = None, local: str = "") -> DataFrame:
    """The first check a record fails, or OK.

    ``sidecars`` has the fields of ``SIDECAR``, ``_corrupt`` and ``path``; with them, as far as they are known, ``file_path``, ``file_sha256`` and
    ``file_pages`` of the file found for the record (null: not read) and ``asked_doi``. ``schemas``: the names that are accepted (none given: any);
    ``local``: the one of files registered by hand, which are REGISTERED and DECLARED instead of VERIFIED and MATCH, may be supplements of a
    named parent, and need a title where they have no DOI.
    """
    have = set(sidecars.columns)
    col = lambda n, kind="string": F.col(n) if n in have else F.lit(None).cast(kind)
    flag = lambda c: F.coalesce(c, F.lit(False))
    mine = flag(F.col("schema") == local) if local else F.lit(False)
    doi, asked = normalize_doi(F.col("target.doi")), normalize_doi(col("asked_doi"))
    role, parent = F.col("identity_validation.document_role"), col("parent_sha256")
    hash_, real = F.lower(F.col("retrieval.sha256")), F.lower(col("file_sha256"))
    known = flag(F.col("schema").isin(schemas)) if schemas else F.col("schema").isNotNull()
    supplement = mine & flag(role == "SUPPLEMENT") & flag(parent.rlike("^[0-9a-fA-F]{64}$"))
    nameless = F.col("target.doi").isNull() & (F.coalesce(F.trim("target.expected_title"), F.lit("")) == "")
    no_file = col("file_path").isNull() if "file_path" in have else F.lit(False)
    checks = [
        (no_file, "PDF_NOT_FOUND"),
        (flag(F.lower(col("file_path")).rlike("(?:^|[/\\\\])_unverified(?:[/\\\\]|$)")), "UNVERIFIED_PATH"),
        (F.col("path").isNull() if "path" in have else F.lit(False), "SIDECAR_NOT_FOUND"),
        (F.col("_corrupt").isNotNull(), "INVALID_SIDECAR"),
        (~known, "UNKNOWN_SIDECAR_SCHEMA"),
        (~flag(F.col("status") == F.when(mine, "REGISTERED").otherwise("VERIFIED")), "STATUS_NOT_VERIFIED"),
        (~flag(F.col("pdf_validation.valid_pdf")), "PDF_VALIDATION_FAILED"),
        (~flag(F.col("identity_validation.status") == F.when(mine, "DECLARED").otherwise("MATCH")), "IDENTITY_NOT_MATCHED"),
        (~(flag(role == "ARTICLE") & ~(mine & parent.isNotNull()) | supplement), "DOCUMENT_NOT_ARTICLE"),
        (F.col("target.doi").isNotNull() & doi.isNull() | asked.isNotNull() & ~asked.eqNullSafe(doi), "DOI_MISMATCH"),
        (nameless, "IDENTITY_NOT_MATCHED"),
        (~flag(hash_.rlike("^[0-9a-f]{64}$")), "INVALID_RECORDED_HASH"),
        (flag(real != hash_), "PDF_HASH_MISMATCH"),
        (F.coalesce(F.col("pdf_validation.page_count") < 1, F.lit(True)), "INVALID_SIDECAR"),
        (flag(col("file_pages", "int") < 0), "PDF_UNREADABLE"),
        (flag(col("file_pages", "int") != F.col("pdf_validation.page_count")), "PAGE_COUNT_MISMATCH"),
    ]
    return sidecars.withColumn("gate_code", gate(checks))


def scan_corpus(spark: SparkSession, root: str, schemas: list[str] | None = None) -> DataFrame:
    """Every record below ``root`` with the file of its hash and the check it fails; files without a record are rows with SIDECAR_NOT_FOUND.

    Files are hashed where they lie, in tasks; a record and a file meet by hash, so moved files are found. Copies of a file are one row with the least path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root).select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("file_sha256"))
    files = files.groupBy("file_sha256").agg(F.min("file_path").alias("file_path"), F.count("*").alias("copies"))
    records = scan_sidecars(spark, root)
    x = records.withColumn("file_sha256", F.lower("retrieval.sha256")).join(files, "file_sha256", "full_outer")
    return parser_gate(x, schemas)


FIELDS = ["doi", "title", "authors", "journal", "year", "volume", "issue", "pages", "cnki_id", "folder", "filename", "tags"]


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """A list of requests by its suffix - lines of text, a JSON array, or CSV - as rows ``line, doi, title, ..., tags, error``.

    ``line`` counts the entries from 1. A row without DOI and title, or with a year that has not four digits, keeps its place and says so in ``error``.
    """
    suffix = path.lower().rsplit(".", 1)[-1]
    if suffix == "csv":
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    elif suffix == "json":
        text = spark.read.option("wholetext", True).text(path)
        items = text.select(F.posexplode(F.from_json("value", "array<string>")).alias("_n", "_item"))
        fields = ", ".join(f"{c} string" for c in FIELDS)
        raw = items.select("_n", F.coalesce(F.from_json("_item", fields), F.struct(*[(F.trim("_item") if c == "doi" else F.lit(None).cast("string")).alias(c) for c in FIELDS])).alias("r"), "_item")
        raw = raw.select("_n", *[(F.when(~F.col("_item").startswith("{"), F.trim("_item")).otherwise(F.col("r.doi")) if c == "doi" else F.when(F.col("_item").startswith("{"), F.col(f"r.{c}"))).alias(c) for c in FIELDS])
    else:
        raw = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^\ufeff", "")).alias("doi")).filter("doi <> '' and not startswith(doi, '#')")
    raw = raw.withColumn("_n", F.monotonically_increasing_id()) if "_n" not in raw.columns else raw
    raw = raw.select("_n", *[(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in FIELDS])
    listed = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.filter(F.transform(F.split(c, ";"), lambda v: F.trim(v)), lambda v: v != ""))
    error = F.when(F.col("doi").isNull() & F.col("title").isNull(), "neither doi nor title").when(~F.coalesce(F.col("year").rlike("^[0-9]{4}$"), F.lit(True)), "the year has not four digits").when(F.col("doi").isNotNull() & normalize_doi(F.col("doi")).isNull(), "not a doi")
    out = raw.withColumn("error", error).withColumn("doi", normalize_doi(F.col("doi"))).withColumn("year", F.col("year").try_cast("int")).withColumn("authors", listed(F.col("authors"))).withColumn("tags", listed(F.col("tags")))
    w = Window.orderBy("_n")  # a list of requests is one file that people wrote
    return out.withColumn("line", F.row_number().over(w)).select("line", *FIELDS, "error")


def read_doi_list(spark: SparkSession, path: str) -> DataFrame:
    """One identifier per line; blank lines and comments are skipped, malformed ones stay with a null ``doi``."""
    t = spark.read.text(path).select(F.trim("value").alias("input"), F.input_file_name().alias("path")).filter("input <> '' and not startswith(input, '#')")
    return t.withColumn("doi", normalize_doi(F.col("input")))


def read_placed_list(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Pasted lists: ``## group`` and ``### subgroup`` headings place the lines below them, ``[group]`` starts anew, ``key=value`` columns after a bar or tab override, a malformed heading poisons its lines."""
    t = F.trim(F.col(text))
    parent = F.when(t.rlike(r"^##\s+\S"), F.trim(F.regexp_replace(t, r"^##\s+", ""))).when(t.rlike(r"^\[[^\]]+\]$"), F.regexp_extract(t, r"^\[([^\]]+)\]$", 1)).when(t.rlike(r"^##\s*$"), F.lit("\x00bad"))
    child = F.when(t.rlike(r"^###\s+\S"), F.trim(F.regexp_replace(t, r"^###\s+", ""))).when(parent.isNotNull(), F.lit("")).when(t.rlike(r"^###\s*$"), F.lit("\x00bad"))
    x = carry(carry(lines, [key], [F.col(order)], parent, "_p"), [key], [F.col(order)], child, "_c")
    rows = x.filter(~t.rlike(r"^#{2,3}(?:\s|$)|^\[[^\]]+\]$|^\s*$"))
    field = lambda n: F.when(t.rlike(f"[|\\t]\\s*{n}="), F.trim(F.regexp_extract(t, f"[|\\t]\\s*{n}=([^|\\t]*)", 1)))
    place = F.concat_ws("/", F.when(F.col("_p") != "", F.col("_p")), F.when(F.col("_c") != "", F.col("_c")))
    return rows.select(
        key,
        order,
        F.trim(F.regexp_extract(t, r"^([^|\t]*)", 1)).alias("input"),
        F.when(field("folder") == "/", F.lit("")).otherwise(F.coalesce(field("folder"), place)).alias("folder"),
        F.filter(F.transform(F.split(F.coalesce(field("tags"), F.lit("")), "[;,]"), lambda v: F.trim(v)), lambda v: v != "").alias("tags"),
        F.coalesce(F.col("_p").contains("\x00bad") | F.col("_c").contains("\x00bad"), F.lit(False)).alias("bad_heading"),
    )


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def xlsx_cells(data: bytes, most_cells: int = 1_000_000, most_bytes: int = 1 << 29):
    """Rows ``(sheet, cell, row, column, kind, value, formula)`` of every populated cell; raises beyond the limits, never cuts."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > most_bytes:
            raise ValueError("the workbook unpacks to more than the limit")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        n = 0
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            target = targets[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
            for c in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{{{_NS['m']}}}c"):
                kind, v, f, inline = c.get("t", "n"), c.find("m:v", _NS), c.find("m:f", _NS), c.find("m:is", _NS)
                if v is None and f is None and inline is None:
                    continue
                n += 1
                if n > most_cells:
                    raise ValueError("the workbook has more cells than the limit")
                value = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else v.text if v is not None else None
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                name, number = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                column = 0
                for x in name:
                    column = column * 26 + ord(x) - 64
                yield sheet.get("name"), c.get("r"), int(number), column, {"s": "text", "inlineStr": "text", "str": "text", "b": "boolean", "e": "error"}.get(kind, "number"), value, None if f is None else f.text or ""


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from glob import glob

        return [InputPartition(p) for p in sorted(glob(self.path))]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            for row in xlsx_cells(f.read()):
                yield (partition.value, *row)


class XlsxCells(DataSource):
    """``spark.dataSource.register(XlsxCells)``, then ``spark.read.format("xlsx_cells").load(glob)``: one partition per workbook."""

    @classmethod
    def name(cls):
        return "xlsx_cells"

    def schema(self):
        return "path string, sheet string, cell string, row int, column int, kind string, value string, formula string"

    def reader(self, schema):
        return _Reader(self.options["path"])


def write_chunks(chunks: DataFrame, path: str, form: str = "jsonl") -> None:
    """Chunk export; an existing target is never overwritten."""
    if form == "jsonl":
        chunks.write.mode("errorifexists").json(path)
    elif form == "markdown":
        chunks.select(F.concat(F.lit("## "), markdown_escape(F.coalesce("heading", F.lit(""))), F.lit("\n\n"), F.col("text"), F.lit("\n")).alias("value")).write.mode("errorifexists").text(path)
    else:
        raise ValueError("form is jsonl or markdown")


def write_table(results: DataFrame, path: str, record: list[str], field: str, value: str, fields: list[str]) -> None:
    """Long results as a CSV with a column per field; cells a spreadsheet would run are guarded."""
    wide = results.groupBy(*record).pivot(field, fields).agg(F.first(value))
    wide.select([csv_guard(F.col(f"`{c}`").cast("string")).alias(c) for c in wide.columns]).write.mode("errorifexists").option("header", True).option("quoteAll", True).csv(path)
