"""Registry payloads (landed JSON) to one schema of records and of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litquarry.functions.identifiers import canonical_url, normalize_doi

_DATE = "struct<`date-parts`:array<array<int>>>"
CROSSREF = f"DOI string, title array<string>, author array<struct<given:string,family:string,name:string>>, `container-title` array<string>, ISSN array<string>, published {_DATE}, `published-online` {_DATE}, `published-print` {_DATE}, issued {_DATE}, publisher string, type string, volume string, issue string, page string, URL string, link array<struct<URL:string,`content-type`:string,`content-version`:string,`intended-application`:string>>"
DATACITE = "doi string, titles array<struct<title:string>>, creators array<struct<name:string,givenName:string,familyName:string>>, publisher string, publicationYear int, container struct<title:string,volume:string,issue:string,firstPage:string,lastPage:string>, relatedItems array<struct<relationType:string,titles:array<struct<title:string>>,volume:string,issue:string,firstPage:string>>, types struct<resourceTypeGeneral:string,resourceType:string>, url string"
OPENALEX = "doi string, best_oa_location struct<pdf_url:string,landing_page_url:string>, locations array<struct<is_oa:boolean,pdf_url:string,landing_page_url:string,version:string,license:string,source:struct<display_name:string,type:string>>>"
UNPAYWALL = "doi string, oa_locations array<struct<url_for_pdf:string,url_for_landing_page:string,version:string,host_type:string,license:string,is_best:boolean>>"
# Names of versions in the registries.
VERSIONS = {"publishedVersion": "published", "acceptedVersion": "accepted", "submittedVersion": "submitted", "vor": "published", "am": "accepted", "sm": "submitted"}


def _version(c: Column) -> Column:
    out = F.lit("unknown")
    for k, v in VERSIONS.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def _date(c: Column) -> Column:
    """``YYYY[-MM[-DD]]`` of date parts; null where there is no year."""
    parts = F.filter(c["date-parts"][0], lambda x: x.isNotNull())
    padded = F.transform(parts, lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0")))
    return F.when(F.size(parts) > 0, F.array_join(F.slice(padded, 1, 3), "-"))


def _filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def crossref_records(raw: DataFrame, payload: str) -> DataFrame:
    """One record per payload; unreadable payloads give nulls and stay as rows."""
    w = raw.withColumn("w", F.from_json(payload, CROSSREF))
    person = lambda a: F.coalesce(_filled(F.concat_ws(" ", a["given"], a["family"])), _filled(a["name"]))
    return w.select(
        normalize_doi(F.col("w.DOI")).alias("doi"),
        _filled(F.get("w.title", F.lit(0))).alias("title"),
        F.filter(F.transform("w.author", person), lambda x: x.isNotNull()).alias("authors"),
        _filled(F.get(F.col("w.`container-title`"), F.lit(0))).alias("journal"),
        F.array_distinct("w.ISSN").alias("issn"),
        F.coalesce(*[_date(F.col(f"w.`{k}`")) for k in ("published", "published-online", "published-print", "issued")]).alias("published_date"),
        F.col("w.publisher").alias("publisher"),
        F.col("w.type").alias("work_type"),
        "w.volume",
        "w.issue",
        F.col("w.page").alias("pages"),
        F.col("w.URL").alias("url"),
        F.array_distinct(F.transform("w.link", lambda x: F.struct(x["URL"].alias("url"), x["content-type"].alias("content_type")))).alias("links"),
        (F.col("w").isNull() | F.col("w.DOI").isNull()).alias("rejected"),
    )


def datacite_records(raw: DataFrame, payload: str) -> DataFrame:
    """Publication facts come from the related item the work is published in, else from the container."""
    w = raw.withColumn("w", F.from_json(payload, DATACITE)).withColumn("i", F.get(F.filter("w.relatedItems", lambda x: x["relationType"] == "IsPublishedIn"), F.lit(0)))
    person = lambda a: F.coalesce(_filled(F.concat_ws(" ", a["givenName"], a["familyName"])), _filled(a["name"]))
    return w.select(
        normalize_doi(F.col("w.doi")).alias("doi"),
        _filled(F.get("w.titles", F.lit(0))["title"]).alias("title"),
        F.filter(F.transform("w.creators", person), lambda x: x.isNotNull()).alias("authors"),
        F.coalesce(_filled(F.get("i.titles", F.lit(0))["title"]), _filled(F.col("w.container.title"))).alias("journal"),
        F.coalesce("i.volume", "w.container.volume").alias("volume"),
        F.coalesce("i.issue", "w.container.issue").alias("issue"),
        F.coalesce("i.firstPage", F.concat_ws("-", "w.container.firstPage", "w.container.lastPage")).alias("pages"),
        F.col("w.publicationYear").alias("year"),
        F.coalesce(_filled(F.col("w.types.resourceType")), _filled(F.col("w.types.resourceTypeGeneral"))).alias("work_type"),
        "w.publisher",
        (F.col("w").isNull() | F.col("w.doi").isNull()).alias("rejected"),
    )


def _candidates(x: DataFrame, doi: Column, landing: Column, pdf: Column, extra: list[Column]) -> DataFrame:
    """A row for the file and one for the landing page where that is another address."""
    both = F.array(F.struct(F.lit("pdf").alias("url_type"), canonical_url(pdf).alias("url")), F.struct(F.lit("landing").alias("url_type"), canonical_url(F.when(landing.isNull() | ~landing.eqNullSafe(pdf), landing)).alias("url")))
    y = x.select(normalize_doi(doi).alias("doi"), F.explode(F.filter(both, lambda c: c["url"].isNotNull())).alias("c"), *extra)
    return y.select("doi", "c.url", "c.url_type", *[c for c in y.columns if c not in ("doi", "c")])


def openalex_candidates(raw: DataFrame, payload: str) -> DataFrame:
    x = raw.withColumn("w", F.from_json(payload, OPENALEX)).withColumn("l", F.explode("w.locations"))
    kind = F.col("l.source.type")
    best = F.coalesce((F.col("l.landing_page_url") == F.col("w.best_oa_location.landing_page_url")) | (F.col("l.pdf_url") == F.col("w.best_oa_location.pdf_url")), F.lit(False))
    extra = [F.lit("openalex").alias("provider"), F.when(F.col("l.is_oa"), "open").otherwise("unknown").alias("access_type"), _version(F.col("l.version")).alias("version"), F.when(kind == "repository", "repository").when(kind.isin("journal", "conference", "book series", "ebook platform"), "publisher").otherwise("unknown").alias("host_type"), F.col("l.license").alias("license"), F.col("l.source.display_name").alias("source_name"), best.alias("is_best")]
    return _candidates(x, F.col("w.doi"), F.col("l.landing_page_url"), F.col("l.pdf_url"), extra)


def unpaywall_candidates(raw: DataFrame, payload: str) -> DataFrame:
    x = raw.withColumn("w", F.from_json(payload, UNPAYWALL)).withColumn("l", F.explode("w.oa_locations"))
    extra = [F.lit("unpaywall").alias("provider"), F.lit("open").alias("access_type"), _version(F.col("l.version")).alias("version"), F.coalesce("l.host_type", F.lit("unknown")).alias("host_type"), F.col("l.license").alias("license"), F.lit(None).cast("string").alias("source_name"), F.coalesce("l.is_best", F.lit(False)).alias("is_best")]
    return _candidates(x, F.col("w.doi"), F.col("l.url_for_landing_page"), F.col("l.url_for_pdf"), extra)
