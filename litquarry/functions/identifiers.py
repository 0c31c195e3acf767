"""Identifier and URL functions as column expressions; they stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pairs that wrap a whole identifier, closers that may be left over, punctuation that ends prose.
WRAPPERS = [('"', '"'), ("'", "'"), ("[", "]"), ("(", ")"), ("{", "}"), ("（", "）"), ("【", "】"), ("“", "”"), ("‘", "’"), ("《", "》")]
CLOSERS = [("(", ")"), ("[", "]"), ("{", "}")]
ENDINGS = r"[.,;，。；\s]+$"
DOI = r"10\.[0-9]{4,9}/[-._;()/:<>#?A-Za-z0-9]+"
# Punctuation of Chinese prose that ends a DOI.
PROSE_ENDS = "，。；、！？（）【】《》“”‘’：…"
RESOLVERS = ("doi.org", "dx.doi.org", "doi.example")
RESOLVER_HOSTS = ("doi.org", "www.doi.org", "dx.doi.org", "hdl.handle.net", "handle.net")
INDEX_HOSTS = ("pubmed.ncbi.nlm.nih.gov", "doaj.org", "www.doaj.org")


def bind(c: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(c), lambda x: f(x))[0]


def _peel(c: Column) -> Column:
    """One pass: closing punctuation, one matched pair, closers without an opener."""
    opening = "".join(left for left, _ in WRAPPERS)

    def unwrap(x: Column) -> Column:
        inner = F.trim(x.substr(F.lit(2), F.length(x) - 2))
        pairs = reduce(lambda a, b: a | b, [x.startswith(left) & x.endswith(right) for left, right in WRAPPERS])
        return F.when((F.length(x) >= 2) & F.lit(opening).contains(x.substr(F.lit(1), F.lit(1))) & pairs, inner).otherwise(x)

    def unclose(x: Column, left: str, right: str) -> Column:
        count = lambda s: F.length(x) - F.length(F.replace(x, F.lit(s), F.lit("")))
        return F.when(x.endswith(right) & (count(right) > count(left)), F.rtrim(x.substr(F.lit(1), F.length(x) - 1))).otherwise(x)

    c = bind(F.regexp_replace(F.trim(c), ENDINGS, ""), unwrap)
    for left, right in CLOSERS:
        c = bind(c, lambda x, left=left, right=right: unclose(x, left, right))
    return c


def clean_identifier(c: Column) -> Column:
    """Wrappers and closing punctuation taken off until nothing changes: a pass takes a layer, and there are no more layers than characters around the identifier."""
    around = lambda x: F.length(F.regexp_extract(x, r"^[^0-9A-Za-z]*", 0)) + F.length(F.regexp_extract(x, r"[^0-9A-Za-z]*$", 0))
    return F.when(around(c) == 0, c).otherwise(F.aggregate(F.sequence(F.lit(0), around(c)), c, lambda x, _: _peel(x)))


def looks_like_doi(c: Column) -> Column:
    """A bare DOI without surroundings; null for null."""
    return c.rlike(f"^{DOI}$") & ~c.rlike(r"[.,;，。；]$")


def normalize_doi(c: Column, resolvers: tuple[str, ...] = RESOLVERS) -> Column:
    """Lower-case bare DOI of a DOI, a labelled DOI or a resolver address; null where there is none."""
    hosts = "|".join(h.replace(".", r"\.") for h in resolvers)
    address = f"^(?i:https?://)?(?i:{hosts})/+"

    def resolve(x: Column) -> Column:
        path = F.regexp_replace(F.regexp_replace(x, address, ""), r"[?#].*$", "")
        return F.when(x.rlike(address), F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)).otherwise(x)

    unlabel = lambda x: F.regexp_replace(x, r"^(?:(?i:doi)\s*[:：]\s*)+", "")
    bare = bind(bind(c, clean_identifier), lambda x: bind(unlabel(x), clean_identifier))
    return bind(bind(bind(bare, resolve), clean_identifier), lambda x: F.when(looks_like_doi(x), F.lower(x)))


def extract_dois(c: Column) -> Column:
    """Distinct DOIs of prose in order of appearance; CJK punctuation ends a DOI."""
    searchable = F.translate(c, PROSE_ENDS, " " * len(PROSE_ENDS))
    found = F.regexp_extract_all(searchable, F.lit(f"(?:^|[^A-Za-z0-9_/])((?:(?i:https?://)?(?i:dx\\.)?(?i:doi\\.org)/)?{DOI})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: normalize_doi(x)), lambda x: x.isNotNull()))


def url_part(c: Column, part: str) -> Column:
    return F.try_parse_url(c, F.lit(part))


def canonical_url(c: Column) -> Column:
    """Absolute http(s) address without wrapper and fragment; scheme and host in lower case, resolvers under one https name."""
    c = F.trim(c)
    c = F.regexp_replace(c, r"^\[[^\]]*\]\((https?://.+)\)$", "$1")
    for left, right in (("<", ">"), ('"', '"'), ("'", "'")):
        c = F.when(c.startswith(left) & c.endswith(right) & (F.length(c) >= 2), F.trim(c.substr(F.lit(2), F.length(c) - 2))).otherwise(c)
    pattern = r"^(https?)://([^/?#@\s]+)((?:/[^\s#?]*)?)((?:\?[^\s#]*)?)(?:#\S*)?$"
    valid = c.rlike(f"(?i){pattern}")
    part = lambda k: F.regexp_extract(c, f"(?i){pattern}", k)
    host = F.lower(part(2))
    name = F.regexp_replace(host, r"\.?(:[0-9]+)?$", "")
    port = F.regexp_extract(host, r"(:[0-9]+)$", 1)
    resolver = name.isin("doi.org", "dx.doi.org", "www.doi.org", "hdl.handle.net")
    alias = F.when(name.isin("dx.doi.org", "www.doi.org"), F.lit("doi.org")).otherwise(name)
    return F.when(valid, F.concat(F.when(resolver, F.lit("https")).otherwise(F.lower(part(1))), F.lit("://"), F.when(resolver, F.concat(alias, port)).otherwise(host), part(3), part(4)))


def url_host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"(?i)^https?://([^/?#:]+)", 1)), r"\.$", "")


def host_type(url: Column, reported: Column) -> Column:
    """The kind of host the address shows, else the reported one."""
    host, path = url_host(url), F.lower(F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1))
    return (
        F.when(host.isin(*RESOLVER_HOSTS), F.lit("resolver"))
        .when(host.isin(*INDEX_HOSTS), F.lit("index"))
        .when(host == "pmc.ncbi.nlm.nih.gov", F.lit("repository"))
        .when((host == "www.ncbi.nlm.nih.gov") & path.startswith("/pmc/"), F.lit("repository"))
        .when((host == "www.ncbi.nlm.nih.gov") & path.startswith("/pubmed"), F.lit("index"))
        .otherwise(reported)
    )


def https_alternative(c: Column) -> Column:
    """The https form of an http address; null for others."""
    return F.when(c.rlike("(?i)^http://"), F.regexp_replace(c, "(?i)^http://", "https://"))


def redact_url(c: Column) -> Column:
    """Address without user, query values, challenge paths and session ids."""
    c = F.regexp_replace(c, r"#.*$", "")
    c = F.regexp_replace(c, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")
    c = F.regexp_replace(c, r"([?&][^=&#]*)=[^&#]*", "$1=%5Bredacted%5D")
    c = F.regexp_replace(c, r"(?i)(/cdn-cgi/challenge-platform)(?:/[^?#]*)?", "$1/[redacted]")
    return F.regexp_replace(c, r"(?i);(?:jsessionid|phpsessid|sessionid)=[^;/?]*", ";sessionid=[redacted]")


def looks_like_pdf_url(c: Column) -> Column:
    return c.rlike(r"(?i)(?:\.pdf(?:$|[?#;])|/pdf(?:/|$|[?#])|/epdf/|[?&](?:format|type|download)=pdf)")


def embedded_target(c: Column) -> Column:
    """Target of a redirect carried in the query."""
    names = ("url", "target", "redirect", "redirecturi", "redirect_uri", "returnurl", "goto")
    picks = [F.regexp_extract(c, f"(?i)[?&]{n}=([^&#]+)", 1) for n in names]
    raw = F.coalesce(*[F.when(p != "", p) for p in picks])
    return F.coalesce(F.try_url_decode(raw), raw)


def issn_valid(c: Column) -> Column:
    """ISSN with a right check digit (weights 8..2, X is 10)."""
    d = F.regexp_replace(F.upper(F.trim(c)), "[^0-9X]", "")
    total = reduce(lambda a, b: a + b, [F.substring(d, i + 1, 1).try_cast("int") * (8 - i) for i in range(7)])
    last = F.when(F.substring(d, 8, 1) == "X", F.lit(10)).otherwise(F.substring(d, 8, 1).try_cast("int"))
    return d.rlike("^[0-9]{7}[0-9X]$") & ((total + last) % 11 == 0)


def compact_key(c: Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def field_key(c: Column) -> Column:
    """Compact key; a number loses its leading zeros."""
    k = compact_key(c)
    return F.when(k.rlike("^[0-9]+$"), F.regexp_replace(k, "^0+(?=[0-9])", "")).otherwise(k)


def journal_aliases(c: Column) -> Column:
    """The name, and main title and bracketed part of ``main (other)``."""
    main = F.trim(F.regexp_extract(c, r"^([^(（]+)[(（]([^)）]+)[)）]\s*$", 1))
    inner = F.trim(F.regexp_extract(c, r"^([^(（]+)[(（]([^)）]+)[)）]\s*$", 2))
    return F.array_distinct(F.filter(F.array(F.trim(c), main, inner), lambda x: x != ""))


def first_page(c: Column) -> Column:
    return F.regexp_extract(c, r"([0-9]+)", 1)


def page_range(c: Column) -> Column:
    """Struct of first and last page; a single page is its own end."""
    a, b = F.regexp_extract(c, r"([0-9]+)", 1).try_cast("int"), F.regexp_extract(c, r"[0-9]+\s*[-–—]\s*([0-9]+)", 1).try_cast("int")
    return F.struct(a.alias("first"), F.coalesce(b, a).alias("last"))


def unsafe_folder(c: Column) -> Column:
    """Names a file system reserves, empty parts, parents and absolute paths."""
    return c.rlike(r"^\s*$|^[/\\]|^[A-Za-z]:|(?:^|[/\\])\.{1,2}(?:[/\\]|$)|[<>:\"|?*\x00-\x1f]|[/\\]{2,}|(?i)(?:^|[/\\])(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\.[^/\\]*)?(?:[/\\]|$)")


def public_host(c: Column) -> Column:
    """Neither a local name nor a private or reserved address."""
    host = url_host(c)
    private = host.rlike(r"^(?:localhost|.*\.localhost|.*\.local|.*\.internal|0\..*|10\..*|127\..*|169\.254\..*|192\.168\..*|172\.(?:1[6-9]|2[0-9]|3[01])\..*|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\..*|22[4-9]\..*|2[3-5][0-9]\..*|\[.*)$")
    return (host != "") & ~private
