"""HTML pages to title, base, metadata, links, JSON-LD and visible text; routes derived from them."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litquarry.functions.identifiers import looks_like_pdf_url, normalize_doi

SCHEMA = "struct<title:string,base_href:string,metadata:array<struct<name:string,content:string>>,links:array<struct<href:string,text:string,rel:string>>,json_ld:array<string>,visible_text:string>"
HIDDEN = {"script", "style", "template", "noscript", "head", "svg"}
BLOCKS = {"p", "div", "li", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "nav", "footer", "header", "table", "ul", "ol"}
# Metadata names that carry a DOI or a title, the latter by falling precedence; base priorities of derived files.
DOI_NAMES = ["citation_doi", "dc.identifier", "dc.identifier.doi", "prism.doi", "bepress_citation_doi"]
TITLE_NAMES = ["citation_title", "dc.title", "bepress_citation_title", "og:title", "twitter:title"]
PRIORITY = {"citation_meta": 920, "other_meta": 880, "link": 840, "anchor": 760}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.base, self.meta, self.links, self.ld, self.text = "", None, [], [], [], []
        self.hidden, self.in_title, self.in_ld, self.anchor = 0, False, False, None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "title":
            self.in_title = True
        elif tag == "base" and "href" in a and self.base is None:
            self.base = a["href"]
        elif tag == "meta" and (a.get("name") or a.get("property")) and "content" in a:
            self.meta.append(((a.get("name") or a.get("property")).lower(), a["content"]))
        elif tag == "link" and a.get("href"):
            self.links.append([a["href"], "", a.get("rel", "").lower()])
        elif tag == "a" and a.get("href"):
            self.anchor = [a["href"], "", "a"]
            self.links.append(self.anchor)
        elif tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.in_ld = True
            self.ld.append("")
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag == "a":
            self.anchor = None
        elif tag == "script":
            self.in_ld = False
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in BLOCKS:
            self.text.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif self.in_ld:
            self.ld[-1] += data
        elif not self.hidden:
            self.text.append(data)
        if self.anchor is not None:
            self.anchor[1] += data


def read_page(text: str | None) -> dict | None:
    if text is None:
        return None
    r = _Reader()
    try:
        r.feed(text)
        r.close()
    except Exception:  # a broken page is read as far as it goes
        pass
    lines = (" ".join(x.split()) for x in "".join(r.text).split("\n"))
    squeeze = lambda s: " ".join(s.split())
    return {"title": squeeze(r.title), "base_href": r.base, "metadata": [{"name": k, "content": v} for k, v in r.meta], "links": [{"href": h, "text": squeeze(t), "rel": rel} for h, t, rel in r.links], "json_ld": r.ld, "visible_text": "\n".join(x for x in lines if x)}


def parse_pages(pages: DataFrame, html_col: str, out: str = "parsed") -> DataFrame:
    """Adds the parse as a struct; null for null."""

    @F.pandas_udf(SCHEMA)
    def parsed(texts: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys(("title", "base_href", "metadata", "links", "json_ld", "visible_text"))
        return pd.DataFrame([read_page(t) or empty for t in texts], columns=list(empty))

    return pages.withColumn(out, F.when(F.col(html_col).isNotNull(), parsed(html_col)))


def absolute(href: Column, base: Column) -> Column:
    """Resolves relative addresses."""

    @F.pandas_udf("string")
    def resolve(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([urljoin(y, x) if isinstance(x, str) and isinstance(y, str) else x for x, y in zip(h, b)], dtype=object)

    return resolve(href, base)


def page_dois(metadata: Column) -> Column:
    """Distinct DOIs of a page's metadata, in order."""
    picked = F.filter(metadata, lambda m: F.lower(m["name"]).isin(DOI_NAMES))
    return F.array_distinct(F.filter(F.transform(picked, lambda m: normalize_doi(m["content"])), lambda d: d.isNotNull()))


def page_title(metadata: Column) -> Column:
    """The metadata title of highest precedence that is not empty."""
    def pick(name: str) -> Column:
        found = F.filter(metadata, lambda m: (F.lower(m["name"]) == name) & (F.trim(m["content"]) != ""))
        return F.get(F.transform(found, lambda m: F.trim(m["content"])), 0)

    return F.coalesce(*[pick(n) for n in TITLE_NAMES])


def derive_files(pages: DataFrame, page_id: str, parsed: str, url: str, most: int | None = None) -> DataFrame:
    """File routes of every page: metadata, link and anchor addresses that look like files, each address once with its best priority, ranked per page with first seen first among equals; all of them, or the best ``most``."""
    p = pages.select(page_id, F.coalesce(F.col(f"{parsed}.base_href"), F.col(url)).alias("_base"), F.col(f"{parsed}.metadata").alias("_m"), F.col(f"{parsed}.links").alias("_l"))
    meta = p.select(page_id, "_base", F.posexplode("_m").alias("position", "m")).filter(F.lower("m.name").like("%pdf_url")).select(page_id, "_base", "position", F.col("m.content").alias("href"), F.when(F.lower("m.name").startswith("citation"), "citation_meta").otherwise("other_meta").alias("method"))
    links = p.select(page_id, "_base", F.posexplode("_l").alias("position", "l")).filter(looks_like_pdf_url(F.col("l.href")) | (F.lower("l.text") == "pdf")).select(page_id, "_base", (F.col("position") + 10000).alias("position"), F.col("l.href").alias("href"), F.when(F.col("l.rel") == "a", "anchor").otherwise("link").alias("method"))
    rows = meta.unionByName(links).withColumn("url", absolute(F.col("href"), F.col("_base")))
    base = F.lit(0)
    for k, v in PRIORITY.items():
        base = F.when(F.col("method") == k, v).otherwise(base)
    rows = rows.withColumn("priority", base + F.when(F.col("url").startswith("https://"), 20).otherwise(0) - F.when(F.lower("url").rlike("suppl|moesm|_si_"), 500).otherwise(0))
    best = rows.groupBy(page_id, "url").agg(F.max("priority").alias("priority"), F.min("position").alias("position"), F.array_sort(F.collect_set("method")).alias("evidence"))
    w = Window.partitionBy(page_id).orderBy(F.desc("priority"), "position")
    best = best.withColumn("rank", F.row_number().over(w))
    return best if most is None else best.filter(F.col("rank") <= most)
