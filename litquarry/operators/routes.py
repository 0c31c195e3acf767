"""Routes to a paper's file: scores, order, alternatives, what a fetch leads on to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litquarry.functions.identifiers import looks_like_pdf_url

# What a browser adds to a route, by barrier, host, kind of address and source.
BARRIER, CANONICAL, AUXILIARY, SECURE = 1000, 700, -800, 5
HOST_SCORE = {"PUBLISHER": 200, "RESOLVER": 100, "REPOSITORY": 50}
KIND_SCORE = {"LANDING_PAGE": 40, "PDF": 300, "UNKNOWN": 20}
# Resolutions a page of routes may be opened from, and the host and path of an advertisement that looks like a file.
EXPANDABLE = ["RESOLVED", "NO_FILE_CANDIDATES"]
AD_HOST, AD_PATH = "a.cnki.net", "/gw/api/get/pdf/ads/"


def _scored(c: Column, scores: dict[str, int]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in scores.items() for x in pair])[c], F.lit(0))


def browser_score(barrier: Column, host_type: Column, url_type: Column, url: Column, source: Column, auxiliary: Column) -> Column:
    """How much a browser may add to a route that plain fetching did not bring to its end."""
    flag = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return flag(barrier, BARRIER) + _scored(host_type, HOST_SCORE) + _scored(url_type, KIND_SCORE) + flag(F.lower(url).startswith("https:"), SECURE) + flag(source.startswith("Publisher canonical"), CANONICAL) + flag(auxiliary, AUXILIARY)


def is_advertisement(url: Column) -> Column:
    host, path = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PATH"))
    return F.coalesce((F.regexp_replace(F.lower(host), r"\.+$", "") == AD_HOST) & F.lower(path).startswith(AD_PATH), F.lit(False))


def https_upgrades(routes: DataFrame, key: str, url: str) -> DataFrame:
    """The routes and, for plain ones whose https form is not among the key's routes, that form; ``upgraded`` tells them apart."""
    new = routes.filter(F.lower(F.col(url)).startswith("http://")).withColumn(url, F.concat(F.lit("https://"), F.substring(F.col(url), 8, 1 << 30)))
    new = new.dropDuplicates([key, url]).join(routes.select(key, url).distinct(), [key, url], "left_anti")
    return routes.withColumn("upgraded", F.lit(False)).unionByName(new.select(*routes.columns).withColumn("upgraded", F.lit(True)))


def initial_routes(routes: DataFrame, url: str) -> DataFrame:
    """One row per try in order: the https form of a plain route comes right before it."""
    secure = F.when(F.lower(F.col(url)).startswith("http://"), F.concat(F.lit("https://"), F.substring(F.col(url), 8, 1 << 30)))
    tries = F.array_compact(F.array(F.when(secure.isNotNull(), F.struct(secure.alias("url"), F.lit("HTTPS_UPGRADE").alias("method"))), F.struct(F.col(url).alias("url"), F.lit("DISCOVERY").alias("method"))))
    return routes.select(*[c for c in routes.columns if c != url], F.posexplode(tries).alias("attempt", "t")).select("*", F.col("t.url").alias(url), "t.method").drop("t")


def page_route(url: Column) -> Column:
    """Addresses that may be pages: neither files nor resources of a page."""
    decoded = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    resource = decoded.rlike(r"(?i)\.(?:css|js|png|jpe?g|gif|svg|webp|ico|woff2?|ttf|zip|gz|mp4|mp3|xml|json)(?:[?#]|$)")
    return F.when(url.rlike("(?i)^https?://") & ~looks_like_pdf_url(decoded) & ~resource, url)


def page_behind_file(content_type: Column, asked: Column, final: Column) -> Column:
    """Whether a file route that brought no file led to a page: by its content type, or redirected to something that is no file."""
    t = F.lower(F.coalesce(content_type, F.lit("")))
    file = F.lower(F.substring_index(final, "?", 1)).endswith(".pdf")
    return t.contains("html") | t.startswith("text/") | ((asked != final) & ~file)


def inherited_host_type(url: Column, page: Column, parent: Column, parent_type: Column) -> Column:
    """Host type a derived address takes over: of its parent on the parent's host, of a publisher or repository on the page's host."""
    host = lambda c: F.coalesce(F.lower(F.try_parse_url(c, F.lit("HOST"))), F.lit(""))
    mine = host(url)
    return F.when((mine != "") & (mine == host(parent)), parent_type).when((mine != "") & (mine == host(page)) & parent_type.isin("PUBLISHER", "REPOSITORY"), parent_type).otherwise("UNKNOWN")
