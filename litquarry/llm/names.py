"""Linking variant spellings of names to an authority list.

Method: every authority entry is rewritten in all the ways people write it - nicknames, initials, dropped or shortened middle
names, legal-form abbreviations, acronyms, token order, transliteration, one-letter deletions - and every written name is reduced to
its own canonical form (plus its one-letter deletions). The forms are exploded and equi-joined. A form's rarity is one over the number of
entries that have it; an entry's score for a name is the greatest of rarity times the weight of the kind of rewriting over their common
forms, and its confidence the share of its score in those of all entries the name meets. Entries with more than half of it link. A link
through deletions is confirmed by edit distance (one insertion, deletion, substitution or swap) and refused where the differing
token is itself an established name: one in nearly as many distinct author lists as the entry's token, or a regular syllable pair of a romanised name.

Work is done on distinct written names; the authority side is joined by the optimiser's choice. Defined results: null elements,
null or empty arrays give nothing; titles, degree marks, footnote marks and brackets around a name are ignored; a written name equal
to the preferred name keeps its link with kind ``exact``; one that fits several entries equally gives no link.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litquarry.session import spread, written

from .unify import unify_arrow

# Common short forms of given names.
NICKNAMES = {
    "alexander": "alex sasha sandy xander", "anneliese": "anne anni liese", "anthony": "tony ant", "bartholomew": "bart barty", "benedikt": "ben benny", "charlotte": "lotte charlie lottie", "cornelius": "kees corny neil",
    "dorothea": "dora thea dot dorothy", "edward": "ed ned ted eddie teddy", "elizabeth": "liz beth lisa betty eliza lizzie libby", "evangeline": "eva evie angie", "francisco": "paco pancho frank", "frederick": "fred freddie fritz rick",
    "gabriela": "gabi gaby", "guillermo": "memo guille willy", "harriet": "hattie harry", "henrietta": "etta hettie henni", "ignatius": "iggy nate ignaz", "isabella": "isa bella izzy", "james": "jim jimmy jamie", "johannes": "hannes jo jan hans johann",
    "katherine": "kate kathy katie kat", "kristoffer": "kris chris stoffer", "leonard": "len leo lenny", "ludmila": "mila lyuda luda", "margaret": "maggie meg peggy greta", "matthias": "matti matt hias", "michael": "mike mick misha",
    "nikolai": "niko kolya nick", "octavia": "tavi tavia", "patricia": "pat trish patty tricia", "richard": "rick dick rich", "robert": "rob bob bobby bert", "rosalind": "ros rosa rosie", "samuel": "sam sammy", "susanna": "sue sanna susi suzy",
    "theodore": "theo ted teddy", "ulrich": "uli ulli", "valentina": "valya tina val", "vincent": "vin vince vinny", "wilhelmina": "mina willa minna", "william": "bill will billy liam", "yevgenia": "zhenya genia jenya", "zacharias": "zach zack zak",
    "abigail": "abby gail", "albert": "al bert", "andrew": "andy drew", "barbara": "barb babs", "catherine": "cathy kate", "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny", "david": "dave", "deborah": "deb debbie",
    "dmitri": "dima mitya", "eleanor": "ellie nell nora", "eugene": "gene", "gregory": "greg", "jacob": "jake", "jennifer": "jen jenny", "jonathan": "jon", "joseph": "joe", "josephine": "jo josie", "lawrence": "larry", "nathaniel": "nat nate",
    "nicholas": "nick nico", "pamela": "pam", "peter": "pete", "philip": "phil", "rebecca": "becky", "ronald": "ron", "stephen": "steve", "thomas": "tom", "timothy": "tim", "victoria": "vicky tori", "vladimir": "vova volodya",
}
# Words for kinds of organisations and their short forms.
LEGAL = {"inst": "institute", "acad": "academy", "ctr": "centre", "cent": "centre", "center": "centre", "lab": "laboratory", "labs": "laboratory", "cons": "consortium", "univ": "university", "dept": "department", "fac": "faculty", "soc": "society"}
KINDS = set(LEGAL.values())
STOP = {"of", "for", "the", "and", "de", "des", "du", "der", "für", "la", "el", "in", "at"}
_TITLE = re.compile(r"^(?:(?:prof|dr|ing|mr|mrs|ms|herr|frau|sir|dipl|mag|doc|assoc|asst)\b\.?\s*)+")
_DEGREE = re.compile(r"(?:,?\s+(?:ph\.?\s?d|m\.?d|m\.?sc|b\.?sc|jr|sr|dsc|iii?|esq)\.?)+$")
_MARK = re.compile(r"[*†‡§¶#✉⁰¹²³⁴-⁹0-9]+|\s*\((?:corresponding|author|corr|ed|eds|editor|presenter|deceased)[^)]*\)")
_INITIALS = re.compile(r"^(?:[^\W\d_]\.?[-\s]?){1,4}$")
_HAN = re.compile(r"^[㐀-鿿·\s]{2,}$")
_SYLLABLE = r"(?:zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?(?:iang|iong|uang|ang|eng|ing|ong|iao|ian|uai|uan|ai|ei|ao|ou|an|en|in|un|ia|ie|iu|ua|ui|uo|ue|er|a|o|e|i|u|v)"
_PINYIN = re.compile(rf"^({_SYLLABLE})({_SYLLABLE})$")
_BARE = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i", "’": "'", "`": "'"})


def bare(s: str) -> str:
    """Lower case without accents."""
    if s.isascii():
        return s.lower().replace("`", "'")
    s = unicodedata.normalize("NFD", s.casefold().translate(_BARE))
    return "".join(c for c in s if not unicodedata.combining(c))


def spelled(s: str) -> str:
    """Umlauts written out."""
    return bare(s.casefold().replace("ö", "oe").replace("ä", "ae").replace("ü", "ue").replace("ø", "oe").replace("å", "aa"))


def deletions(s: str) -> set[str]:
    return {s} | {s[:i] + s[i + 1 :] for i in range(len(s))}


def one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _strip(s: str) -> str:
    s = _MARK.sub("", unicodedata.normalize("NFC", s))
    low = re.sub(r"\s+", " ", s).strip(" ,;")
    for rx in (_TITLE, _DEGREE):
        m = rx.search(low.casefold())
        if m:
            low = low[m.end() :] if m.start() == 0 else low[: m.start()]
    return low.strip(" ,;")


def _letters(token: str) -> str:
    return "".join(c for c in bare(token) if c.isalpha())


def readings(s: str) -> list[tuple[str, list[str], bool]]:
    """(family, given tokens, given is initials) for each way a person's name can be read."""
    if "," in s:
        fam, rest = (x.strip() for x in s.split(",", 1))
        orders = [(fam, rest)]
    else:
        t = s.split()
        if len(t) < 2:
            return []
        if re.fullmatch(r"(?:[^\W\d_]\.?-?){1,3}", t[-1]) and (t[-1].isupper() or "." in t[-1]) and len(_letters(t[-1])) <= 3 and len(t[0]) > 2 and (len(t) == 2 or not t[-2].endswith(".")) and len(t[0].rstrip(".")) > len(_letters(t[-1])):
            return [(re.sub(r"[^a-z' -]", "", bare(t[0])), t[1:], True)]
        orders = [(t[-1], " ".join(t[:-1])), (t[0], " ".join(t[1:]))]
        if len(t) >= 3:  # a family name of two words
            orders.append((" ".join(t[-2:]), " ".join(t[:-2])))
    out = []
    for fam, rest in orders:
        family = re.sub(r"[^a-z' -]", "", bare(fam))
        tokens = [x for x in re.split(r"[\s]+", rest) if x]
        if not family or not tokens:
            continue
        initials = all(re.fullmatch(r"(?:[^\W\d_]\.-?)+|[^\W\d_]", x) or (x.isupper() and len(x) <= 3 and not s.isupper()) for x in tokens)
        out.append((family, tokens, initials))
    return out


def written_forms(s: str) -> list[tuple[str, str, str]]:
    """(form, kind, detail) of a written name: one canonical form per reading, and deletion forms."""
    s = _strip(s)
    if not s:
        return []
    if _HAN.match(s):
        return [("H|" + re.sub(r"[\s·]", "", s), "native", "")]
    out: list[tuple[str, str, str]] = []
    low = [w for w in re.split(r"[^\w']+", bare(s)) if w and w not in STOP]
    kinds = any(LEGAL.get(w, w) in KINDS for w in low)
    if kinds or len(low) >= 4:
        full = [LEGAL.get(w, w) for w in low]
        out.append(("O|" + " ".join(sorted(w[:3] for w in full)), "organisation", " ".join(full)))
        out += [("o|" + d, "organisation_typo", " ".join(full)) for d in deletions(" ".join(full))]
        if kinds:
            return out
    m = re.fullmatch(r"([A-Z]{3,6})(?:\s*[(,]\s*([^\W\d_]+)\)?)?", s)
    if m:
        return [("A|" + m.group(1).lower(), "acronym", bare(m.group(2) or ""))]
    for family, tokens, initials in readings(s):
        if initials:
            letters = "".join(_letters(x) for x in tokens)
            out.append((f"P|{family}|i:{letters}", "initials", ""))
            out += [(f"p|{letters[0]}|{d}", "initials_typo", family) for d in deletions(family)]
            continue
        given = _letters(tokens[0])
        rest = [_letters(x) for x in tokens[1:] if _letters(x)]
        middle = "".join(x[0] for x in rest) if rest and all(len(x) == 1 for x in rest) else " ".join(rest)
        out.append((f"P|{family}|{given}|{middle}", "full" if not middle else "full_middle", f"{family} {given}"))
        if rest:
            out.append((f"P|{family}|{''.join([given, *rest])}|", "joined", ""))
        if "," in s or " " not in family:
            out += [(f"q|{middle}|{d}", "full_typo", f"{family} {given}") for d in deletions(f"{family} {given}")]
    return out


def authority_forms(name: str, native: str | None, kind: str) -> list[tuple[str, str]]:
    """(form, detail) of every rewriting of an authority entry."""
    out: set[tuple[str, str]] = set()
    if kind == "organisation":
        low = [w for w in re.split(r"[^\w']+", bare(name)) if w and w not in STOP]
        kinds = [w for w in low if w in KINDS]
        full = " ".join(low)
        out.add(("O|" + " ".join(sorted(w[:3] for w in low)), full))
        out.add(("A|" + "".join(w[0] for w in low), full))
        orders = [low]
        if kinds and kinds[0] in low[1:]:
            i = low.index(kinds[0])
            orders += [low[i:] + low[:i], low[:i] + low[i + 1 :] + [kinds[0]]]
        for o in orders:
            out |= {("o|" + d, " ".join(o)) for d in deletions(" ".join(o))}
        return sorted(out)
    if native:
        out.add(("H|" + re.sub(r"[\s·]", "", native), ""))
    t = name.split()
    given, middles = bare(t[0]), [bare(x) for x in t[1:-1]]
    syllables = _PINYIN.match(given) if native else None
    families = {(t[-1], tuple(middles))}
    if len(t) >= 4:  # two family names: both, or the first of them
        families |= {(" ".join(t[-2:]), tuple(middles[:-1])), (t[-2], tuple(middles[:-1]))}
    for family, middles in {(re.sub(r"[^a-z' -]", "", f(w)), m) for w, m in families for f in (bare, spelled)}:
        for g in [given, *NICKNAMES.get(given, "").split()]:
            for middle in {"", "".join(m[0] for m in middles), " ".join(middles)}:
                out.add((f"P|{family}|{g}|{middle}", f"{family} {g}"))
                out |= {(f"q|{middle}|{d}", f"{family} {g}") for d in deletions(f"{family} {g}")}
        starts = {given[0], given[0] + "".join(m[0] for m in middles)}
        if syllables:
            starts.add(syllables.group(1)[0] + syllables.group(2)[0])
        out |= {(f"P|{family}|i:{i}", "") for i in starts}
        out |= {(f"p|{i[0]}|{d}", family) for i in starts for d in deletions(family)}
        if middles:  # the middle name written out and joined, as in a double given name
            out.add((f"P|{family}|{given}{''.join(middles)}|", ""))
    return sorted(out)


RANK = {"exact": 0, "native": 1, "full": 1, "full_middle": 1, "joined": 2, "initials": 2, "organisation": 2, "acronym": 3, "full_typo": 4, "organisation_typo": 4, "initials_typo": 5}


def _confirm(kind: str, mine: str, theirs: str) -> bool:
    if kind == "organisation":
        a, b = sorted(mine.split()), sorted(theirs.split())
        return len(a) == len(b) and all(x.startswith(y) or y.startswith(x) for x, y in zip(a, b))
    if kind == "acronym":
        return not mine or theirs.split()[0].startswith(mine)
    if kind.endswith("_typo"):
        return mine != theirs and one_edit(mine, theirs)
    return True


def link_names(named: DataFrame, authority: DataFrame, established: float = 0.05) -> DataFrame:
    """``written_name, author_id, kind, confidence`` for the distinct names of ``named`` (a column ``name``, and ``list_key`` of the author list it stands in).

    ``established``: a token in more than this share of the author lists that have the entry's token, and in more than three, is a name of its own, no slip.
    Lists are counted once, however often they are repeated or redelivered; without ``list_key`` each written name counts once.
    """

    @F.pandas_udf("array<struct<form:string,kind:string,detail:string>>")
    def forms(names: pd.Series) -> pd.Series:
        clean = unify_arrow(pa.array(names.tolist(), type=pa.string())).to_pylist()
        return pd.Series([[{"form": f, "kind": k, "detail": d} for f, k, d in written_forms(n)] if n else [] for n in clean])

    @F.pandas_udf("array<struct<form:string,theirs:string>>")
    def rewritings(names: pd.Series, natives: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([[{"form": f, "theirs": d} for f, d in authority_forms(n, v, k)] if n else [] for n, v, k in zip(names, natives, kinds)])

    @F.pandas_udf("boolean")
    def confirmed(kind: pd.Series, mine: pd.Series, theirs: pd.Series) -> pd.Series:
        return pd.Series([_confirm(*x) for x in zip(kind, mine, theirs)], dtype=bool)

    @F.pandas_udf("boolean")
    def regular(token: pd.Series) -> pd.Series:
        return token.map(lambda t: bool(t and _PINYIN.match(t))).astype(bool)

    names = named.filter("name is not null and trim(name) <> ''").groupBy("name").agg((F.count_distinct("list_key") if "list_key" in named.columns else F.lit(1)).alias("uses"))
    # Written once: the forms are read three times, and making them is the dear part.
    mine = written(spread(names).withColumn("f", forms("name"))).select("name", "uses", F.inline("f"))
    auth = authority.withColumn("f", F.explode(rewritings("preferred_name", "native_name", "kind"))).select("author_id", "preferred_name", F.col("native_name").isNotNull().alias("romanised"), "f.*")
    # Written, so that its true size decides whether it is broadcast.
    auth = written(auth.join(auth.groupBy("form").agg((1 / F.count_distinct("author_id")).alias("rarity")), "form"))
    hits = mine.drop("uses").withColumn("form", F.xxhash64("form")).join(auth.withColumn("form", F.xxhash64("form")), "form").filter(confirmed("kind", "detail", "theirs"))
    hits = written(hits.drop("form"))  # a small part of the forms, read twice
    # How established the differing token of a slip is, against the entry's own token.
    token = F.explode(F.split("detail", " ")).alias("token")
    people = mine.filter("form like 'P|%' and kind in ('full', 'full_middle', 'joined')").filter("detail <> ''")
    counts = people.select("name", token, "uses").distinct().groupBy("token").agg(F.sum("uses").alias("n"))
    slips = hits.filter("kind in ('full_typo', 'initials_typo')").select("name", "author_id", "romanised", "detail", "theirs").distinct()
    pairs = slips.select("name", "author_id", "romanised", F.explode(F.arrays_zip(F.split("detail", " ").alias("x"), F.split("theirs", " ").alias("y"))).alias("z")).select("name", "author_id", "romanised", F.col("z.x").alias("token"), F.col("z.y").alias("other")).filter("token <> other")
    judged = pairs.join(counts, "token", "left").join(counts.select(F.col("token").alias("other"), F.col("n").alias("m")), "other", "left")
    bad = judged.filter((F.coalesce("n", F.lit(0)) > F.greatest(established * F.coalesce("m", F.lit(0)), F.lit(3))) | (F.col("romanised") & regular("token"))).select("name", "author_id").distinct().withColumn("refused", F.lit(True))
    hits = hits.join(bad, ["name", "author_id"], "left").filter(F.col("refused").isNull() | ~F.col("kind").like("%_typo"))
    rank = F.when(F.col("name") == F.col("preferred_name"), 0)
    for k, r in RANK.items():
        rank = rank.when(F.col("kind") == k, r)
    score = F.pow(F.lit(4.0), -rank) * F.when(rank == 0, 1.0).otherwise(F.col("rarity"))
    best = hits.select("name", "author_id", F.when(rank == 0, "exact").otherwise(F.col("kind")).alias("kind"), score.alias("score")).groupBy("name", "author_id").agg(F.max(F.struct("score", "kind")).alias("b"))
    w = Window.partitionBy("name")  # a name fits a handful of entries at most: the window holds its candidates
    best = best.select("name", "author_id", "b.kind", (F.col("b.score") / F.sum("b.score").over(w)).alias("share"))
    return best.filter("share > 0.5").select("name", "author_id", "kind", F.round("share", 4).alias("confidence"))


def name_elements(df: DataFrame, src_table: str, id_col: str, authors_col: str = "authors") -> DataFrame:
    """One row for every element of the author lists; copies of a list share its ``list_key``."""
    return df.select(F.lit(src_table).alias("src_table"), F.col(id_col).alias("row_id"), F.xxhash64(authors_col).alias("list_key"), F.posexplode(authors_col).alias("author_pos", "name")).withColumn("author_pos", F.col("author_pos").cast("bigint"))


def link_elements(elements: DataFrame, authority: DataFrame) -> DataFrame:
    """Every element with the entry it stands for."""
    links = link_names(elements.select("name", "list_key"), authority)
    return elements.drop("list_key").join(links, "name")
