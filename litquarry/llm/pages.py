"""Pages without an article of their own: template residue, filler, error messages, script notices.

Method: the page is reduced to the sentences of its body (title, menus, headers and footers aside). Detectors of phrases sort each
sentence into placeholder, filler, error, notice or prose; prose with a word that messages use too is in doubt. The terms of address
slug and title are compared with those of the body, and bodies over hosts and titles. Evidence against a page is that its body
matches neither its title nor its address, that such a body of at most two sentences of prose repeats, digits aside, under several
titles on several hosts, and that a detector fired. A page is excluded when all of it is found, or when no sentence is
certainly prose and none is in doubt, or two of the three speak against those in doubt. Bodies are compared whole.

Defined results: PDF responses and pages with neither text nor parse are never excluded; where only a parse was kept its visible text
counts; an empty body (nothing but title, menus and footers) is excluded; cut bodies are read as far as they go.
"""

from __future__ import annotations

import hashlib
import html
import re

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litquarry.session import written

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|title|head|svg)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_CHROME = re.compile(r"<(nav|footer|header|aside|menu|h1|form|button|select)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BLOCK = re.compile(r"</?(?:p|div|section|article|li|ul|ol|td|tr|table|h[2-6]|br|blockquote|pre|main|body|html|noscript|dd|dt|figure|figcaption)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>|<[^>]*\Z")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+(?=\S)|(?<=[。！？；])")
_PLACEHOLDER = re.compile(
    r"\{\{.*?\}\}|\{%.*?%\}|\$\{[^}]*\}|#\{[^}]*\}|\[\[.*?\]\]|\[%.*?%\]|%%[\w.]+%%|%\([\w.]+\)s|<%.*?%>|<<[\w.]+>>|@@[\w.]+@@|__[\w.]+__|\{\d*:?[\w.]+\}|\{\}|\[(?:insert|enter|your) [^\]]*\]|\[[\w. ]+ not set\]"
    r"|\([\w.]+ goes here\)|\bTODO\b:?\s*[\w.]*|\b(?:undefined|null|NaN)\s+[\w.]+|\bFIXME\b|\bTBD\b"
)
_LABEL = re.compile(r"\b(?:authors?|abstract|cite as|title|keywords|doi|journal|published|zusammenfassung|autoren|résumé|auteurs|resumen|autores|摘要|作者|关键词)\s*[:：]", re.I)
# Stems of the words of the usual blind text.
_LOREM = set("lorem ipsum dolor amet conse adipi elit sed eius tempo incid labor magna aliqu enim minim venia quis nostr exerc ullam nisi commo conse duis aute irure repre volup velit esse cillu fugia nulla paria excep sint occae cupid proid sunt culpa offic deser mollit anim porta pulvi eget dapib dapis nibh viver rhonc ligul lectu ornat morbi massa felis donec ante sapie vesti vestr fauci curs cursu vari varis variu massa integ matti nunc orci phare susci sagit tortor turpi ultri urna vitae vivam volut augue biben blandi congu crass diam digni dictu eros etiam facil fermen gravi hendr iacul impe inter justo lacin lacus laore leo libe lobor maece magni males mauri metus moles neque nec non odio pede pelle phasel place posue preti purus quam risus rutru sem sempe senec sociis soll susp tellu tincid tris vehic vel venen".split())
_FILLER = re.compile(
    r"\b(?:sample|dummy|filler|placeholder|blind|test) (?:text|article|copy|content|paragraph|page)|placeholder\b|goes here|(?:\btest\b[\s.,]*){2,}|\basdf|x{4,}|to be (?:supplied|written|added|replaced)|replace before|insert \w+ (?:paragraph|text|here)|mustertext|blindtext|platzhalter|"
    r"hier steht (?:später|demnächst|bald)|texte? (?:provisoire|factice|d'exemple)|à remplacer|(?:votre|your|ihr|su) (?:résumé|abstract|resumen|text\w*)\b.{0,12}(?:ici|here|aquí|hier)|texto? de (?:ejemplo|muestra|prueba|relleno)|escrib[ae] aquí|saisissez|hier eingeben|type here|write here|schreiben sie hier|contenido de ejemplo|aquí (?:va|irá)|示例|占位|测试|请在此|待补充|待填写|demo (?:text|content)|lipsum",
    re.I,
)
# Phrases of messages, which are not said of anything else.
_NOTICE = re.compile(
    r"(?:java ?script|scripting|\bscripts?|\bskripte?|\bcookies?)\b.{0,40}\b(?:enabled?|disabled|required|requires?|needed|needs?|(?:turned|switched|is|are) (?:on|off)|blocked|allowed|deaktivier\w*|désactivé\w*|desactivad\w*|activad\w*|activé\w*|aktivier\w*|nötig|erforderlich|nécessaires?|necesarios?)|"
    r"\b(?:enable|turn on|activate|allow|requires?|needs?|uses?|accept|activez|activar?|active|aktivieren|erlauben|autorise[rz]|permitir?|nécessite|requiere|necesita|benötigt|braucht)\b.{0,30}(?:java|script|skript|cookie)|"
    r"your browser|browser settings|ihr(?:en)? browser|votre navigateur|su navegador|浏览器|启用|脚本|verifying (?:that )?you|captcha|just a moment|checking your|one moment|please wait|bitte warten|un instant|请稍候|^\W*loading\b|loading ?(?:…|\.\.)|wird geladen|chargement|cargando|加载中|"
    r"ejecutar scripts|turn it on|\bturn(?:ing)?\b.{0,20}script|this may take|(?:are|you're|being) (?:a )?human|(?:not|are) a robot|without (?:java|script)|sans (?:java|script)|ohne (?:java|skript)|sin (?:java|script)",
    re.I,
)
_ERROR = re.compile(
    r"\b(?:4|5)\d\d\b\s*[–—:-]\s*[^\W\d]|not found|nicht gefunden|introuvable|no (?:se )?(?:ha )?encontr|n'existe|not (?:here|registered)\b|has not been registered|could not be (?:located|reached|loaded|found)|access (?:to this|denied)|(?:request|access|connection) (?:was |is |has been )?(?:refused|denied|blocked)|"
    r"did not answer|timed out|too many requests|went wrong|oops|\bsorry\b[,.!]|we(?: are|'re) sorry|unexpected (?:condition|error)|(?:an?|the|following|server|database|fatal|interner?|unerwarteter|ein|une) (?:error|fehler|erreur)\b.{0,30}(?:occur|happen|code|id\b|auf|surven|produ)|"
    r"\b(?:fatal|server|database|syntax|runtime|application) error\b|\b(?:error|fehler|erreur|errore?)\s*[:#]?\s*\d{3}|error (?:code|id|page|message)|internal server|serverfehler|erreur interne|error interno|traceback|exception in|uncaught|typeerror|keyerror|valueerror|nullpointer|sqlstate|stack trace|line \d+, in|"
    r"(?:down|under|für|wegen|en|por) (?:for )?(?:maintenance|wartung|mantenimiento)|re-?index|come back|try (?:again|the search)|versuchen sie|réessay|int[eé]nt[ea]lo|reint[eé]nt|bad gateway|gateway time|engineers? (?:have|has) been|team wurde|équipe a été|equipo ha sido|address was typed|prüfen sie|vérifiez|compruebe|verifique|followed a link|"
    r"browse all issues|help desk|previous page|table of contents|session (?:has )?(?:expired|ended|timed)|sitzung|votre session|su sesión|reference:? #?[0-9a-f]{6,}|your request|this link|page you (?:asked|requested)|we can(?:'|no)t find|no articles are available|no existe|fue movido|was moved|wurde verschoben|a été déplacé|"
    r"temporarily unavailable|(?:service|site|server|seite|dienst|servicio|page)\b.{0,30}(?:unavailable|indisponible|no disponible|nicht (?:vorhanden|verfügbar|erreichbar))|vorübergehend nicht|momentan nicht|页面不存在|不存在|服务器|错误|重试|无法(?:找到|访问|显示)|拒绝访问|访问被|已?过期|超时|未找到|找不到|稍后|返回首页|检查网址|网址|管理员|пожалуйста|ошибка|не найден|"
    r"the (?:link|page|paper|article|record|identifier)\b.{0,30}\b(?:moved|removed|withdrawn from this site|missing|gone|entered|expired)|seite wurde|page (?:demandée|est)|la página|suscríb|suscripci|abonnez|abonnement|log ?in to|sign in to|revise la dirección|buscador|nuestro equipo|notre équipe|unser team|our team|l'adresse (?:a|que|est|sa)|die adresse|the address (?:was|you|may|is)",
    re.I,
)
# Words that messages use and other texts too: a sentence of prose that holds one is in doubt until the page decides.
_WEAK = re.compile(
    r"java ?script|scripting|\bscripts?\b|\bskript\w*|\bcookies?\b|\bhuman\b|\brobot|验证|\b(?:error|fehler|erreur|errore)\b|\bsorry\b|not available|nicht (?:vorhanden|verfügbar|erreichbar)|refused|denied|forbidden|verweigert|refusé|denegad|expired|abgelaufen|expiré|caducad|timed? ?out|\bexception\b|maintenance|wartung|mantenimiento|"
    r"gateway|\bsession\b|temporarily|unavailable|indisponible|no disponible|vorübergehend|momentan|维护|无法|拒绝|l'adresse|the address|abonn|suscri|\((?:4|5)\d\d\)|\b(?:4|5)\d\d\b\s*[–—:-]",
    re.I,
)
_WORD = re.compile(r"[㐀-鿿]|[^\W\d_]{2,}")


def blocks(text: str | None, visible: str | None, title: str | None) -> tuple[list[str], str]:
    """Text blocks of the body and the title."""
    if isinstance(text, str) and text.strip():
        t = title if isinstance(title, str) else ""
        if m := re.search(r"<title[^>]*>(.*?)(?:</title|\Z)", text, re.S | re.I):
            t = html.unescape(m.group(1))
        body = _CHROME.sub("\n", _DROP.sub("\n", text))
        body = _TAG.sub(" ", _BLOCK.sub("\n", body))
        return [b for b in (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in body.split("\n")) if b], t.strip()
    if isinstance(visible, str):
        t = title.strip() if isinstance(title, str) else ""
        return [b for b in (re.sub(r"\s+", " ", x).strip() for x in visible.split("\n")) if b], t
    return [], ""


def _loose(rx: re.Pattern) -> str:
    """A pattern of the linear-time engine that matches wherever ``rx`` does: without word edges."""
    return rx.pattern.replace(r"\b", "")


_ANY = "|".join(_loose(x) for x in (_PLACEHOLDER, _LABEL, _FILLER, _NOTICE, _ERROR, _WEAK))
_ENDED = re.compile(r"[.!?。！？；;:：][\"'”’)\]]*$")
# What messages call the thing that is not there.
_PLACES = set("access archive article articles artikel browser fehler journal library loading moment paper papers reader readers server service session website".split())
KINDS = ("prose", "doubt", "placeholder", "filler", "notice", "error", "chrome")


def sort_sentence(s: str, title: str, touched: bool = True) -> str:
    """One of ``KINDS``. ``touched``: whether any detector may match; ``doubt``: prose with a word that messages use too."""
    if title and title in s:
        s = s.replace(title, " ").strip()
    marked = touched and _PLACEHOLDER.search(s) is not None
    bare = _LABEL.sub(" ", _PLACEHOLDER.sub(" ", s)) if touched else s
    if bare.strip(" .:;,-–—|()[]\"'") == "" and s:
        return "placeholder" if marked else "chrome"
    words = _WORD.findall(bare)
    low = [w.lower() for w in words]
    if len(low) >= 2 and (sum(w[:5] in _LOREM or w[:4] in _LOREM or w in _LOREM for w in low) >= 0.6 * len(low) or low[-1] == low[-2] and re.search(r"\b(\w+)\b[\s.]+\1\b[\s.]*$", bare)):
        return "filler"
    if touched:
        for kind, rx in (("filler", _FILLER), ("notice", _NOTICE), ("error", _ERROR)):
            if rx.search(bare):
                return kind
        if marked and len(words) < 6:
            return "placeholder"
    han = sum("㐀" <= w <= "鿿" for w in words)
    prose = (len(words) >= 4 or han >= 8) and _ENDED.search(bare.strip()) or len(words) >= 14 and han < 3 or han >= 24
    if touched and _WEAK.search(bare):
        return "doubt" if prose else "chrome"
    return "prose" if prose else "chrome"


def judge_all(texts, visibles, titles, urls) -> pd.DataFrame:
    """For every page the counts of sentence kinds, the shares of title and slug terms found in the body, and a digest of the digit-masked body for comparison."""
    bodies = [blocks(*x) for x in zip(texts, visibles, titles)]
    sentences = [[[x.strip() for x in _SENTENCE.split(b) if x and x.strip()] if not (t and b == t) else [] for b in parts] for parts, t in bodies]
    flat = pa.array([x for page in sentences for b in page for x in b], type=pa.string())
    touched = iter(pc.match_substring_regex(flat, _ANY, ignore_case=True).to_pylist())
    rows = []
    for (parts, t), page, url in zip(bodies, sentences, urls):
        counts = dict.fromkeys(KINDS, 0)
        mine = set(w.lower() for w in _WORD.findall(t))
        slug = set(re.findall(r"[a-z]{4,}", re.sub(r"^https?://[^/]*", "", str(url or "").lower())))
        # A sentence about the page's own topic is no plain message, unless the title is one itself.
        topic = set() if any(x.search(t) for x in (_ERROR, _NOTICE, _WEAK)) else {w for w in mine if len(w) >= 5 and w not in _PLACES}
        for b in page:
            kinds = [sort_sentence(x, t, next(touched)) for x in b]
            kinds = ["doubt" if k in ("error", "notice") and topic and not topic.isdisjoint(w.lower() for w in _WORD.findall(x)) else k for k, x in zip(kinds, b)]
            residue = [k for k in kinds if k in ("error", "notice")]
            if residue and len(kinds) <= 3:  # a short message is one thing
                kinds = [residue[0] if k in ("prose", "doubt") else k for k in kinds]
            for k in kinds:
                counts[k] += 1
        body = " ".join(b for b in parts if b != t)
        terms = set(w.lower() for w in _WORD.findall(body))
        share = lambda a: round(len(a & terms) / len(a), 3) if a else 0.0  # noqa: E731, B023
        masked = re.sub(r"\d+|\b[0-9a-f]{6,}\b", "#", body)
        rows.append((*counts.values(), share(mine), share(slug), hashlib.md5(masked.encode("utf-8", "replace")).hexdigest() if masked else ""))
    return pd.DataFrame(rows, columns=[*KINDS, "title_match", "slug_match", "body"])


def judge_pages(pages: DataFrame, parses: DataFrame, least_hosts: int = 3) -> DataFrame:
    """``page_id``, the counts of sentence kinds, the term matches, how widely the body repeats, the evidence, and ``excluded``."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(frames):
        for f in frames:
            yield pd.concat([f[["page_id", "host", "title_key"]], judge_all(f["text"], f["visible_text"], f["parsed_title"], f["url"])], axis=1)

    p = pages.filter(~F.coalesce("is_pdf_response", F.lit(False))).select("page_id", "text", F.coalesce("final_url", "requested_url").alias("url"))
    h = parses.select("page_id", F.col("title").alias("parsed_title"), "visible_text")
    x = p.join(h, "page_id", "left").filter("text is not null or visible_text is not null")
    x = x.select("page_id", F.xxhash64(F.lower(F.regexp_extract("url", r"^https?://([^/:]+)", 1))).alias("host"), F.xxhash64(F.coalesce("parsed_title", "url")).alias("title_key"), "text", "visible_text", "parsed_title", "url")
    counts = ", ".join(f"{k} int" for k in KINDS)
    x = written(x.mapInPandas(run, f"page_id {kind}, host bigint, title_key bigint, {counts}, title_match double, slug_match double, body string"))
    # Only bodies that match neither title nor address are compared; copies are combined before the shuffle.
    foreign = (F.col("title_match") < 0.2) & (F.col("slug_match") < 0.2)
    loose = x.filter(foreign & (F.col("body") != "") & (F.col("prose") <= 2)).groupBy("body").agg(F.approx_count_distinct("host").alias("hosts"), F.approx_count_distinct("title_key").alias("titles"))
    repeated = loose.filter((F.col("hosts") >= least_hosts) & (F.col("titles") >= least_hosts))
    x = x.join(repeated, "body", "left")
    residue = F.col("placeholder") + F.col("filler") + F.col("notice") + F.col("error")
    x = x.withColumn("evidence", (foreign.cast("int") + F.col("hosts").isNotNull().cast("int") + (residue > 0).cast("int")))
    silent = (F.col("prose") == 0) & ((F.col("doubt") == 0) | (F.col("evidence") >= 2))
    return x.withColumn("excluded", silent | (F.col("evidence") == 3)).drop("body", "title_key", "host")


def excluded_pages(pages: DataFrame, parses: DataFrame) -> DataFrame:
    return judge_pages(pages, parses).filter("excluded").select("page_id")
