"""Noise of scanned pages: words broken across lines, misread characters, running headers and page numbers; repair and reflow.

Method: the corpus gives a vocabulary of words above a relative frequency (so at most ``1 / FLOOR`` of them) and of word pairs. Each
word outside it, or rare in it, is run as a Levenshtein automaton - with the merges and splits of optical recognition as further
transitions - against a trie of the vocabulary, which retrieves every candidate within one edit, and within two known confusions for
words of seven letters or more. Candidates are ranked by frequency, by the neighbouring words and by whether recognition is known
to confuse the characters; one that recognition does not explain counts only where the neighbours on both sides call for it. Then page
furniture is removed, broken words are joined, and lines are reflowed into paragraphs.

A running header, a footer or a page number lies at the edge of its page. It stands in the outer margin and is set apart (off the leading
of the body, in another size, or a page label), or one of the two holds and it repeats, digits aside, at that edge of other pages.

Fragments are ordered by page, column and height; a line's neighbours are found in windows over one page and, across pages, by a
join on the page number, so no artifact is gathered in one task. Redelivered lines share their neighbours and each gets its rows.

Defined results: null and blank texts have no noise; wrong characters in furniture are not misreads; a word of any length is read; a hyphen before a joining word (and, und, et, ...) stands for an omitted half and is no break.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litquarry.session import spread, written

from .unify import unify_arrow

FLOOR = 1e-6
LEAST = 4
# Points: where the outer margins begin, and where the second column does.
TOP, BOTTOM, COLUMN = 785.0, 62.0, 285.0
MEMO = 400_000
HYPHEN = "-‐‑¬­"
# What recognition writes, and what stood there.
SINGLE = {"1": "il", "0": "o", "5": "s", "9": "g", "6": "b", "c": "e", "f": "t", "v": "y", "(": "c", "8": "b", "!": "il", "|": "il", "$": "s"}
MERGED = [("ii", "u"), ("cl", "d"), ("li", "h"), ("rn", "m"), ("vv", "w"), ("m", "in"), ("n", "ri"), ("d", "cl"), ("m", "ni"), ("nn", "m"), ("tl", "d"), ("lc", "k")]
MERGED_BY: dict[str, list[tuple[str, str]]] = {}
for _bad, _good in MERGED:
    MERGED_BY.setdefault(_bad[0], []).append((_bad, _good))
NOISE = "^~*■�"
JOINERS = set("and or nor und oder bzw sowie bis et ou y o u e to à as и или".split())
_PUNCT = ".,;:()[]{}“”„\"'’‘!?%…<>«»。，；：、（）"
_NUMBER = re.compile(r"(?:[\dOlSB]+[.,:/])*[\dOlSB]+")
_LABEL = re.compile(r"^(?:[–—-]\s*[\dOlSIB]{1,5}\s*[–—-]|(?:page|seite|página|pagina|p\.?|第)\s*[\dOlSIB]{1,5}(?:\s*(?:of|von|de|sur|/|页，?共)\s*[\dOlSIB]{1,5})?\s*页?|S?[\dOlSIB]{1,5}|[ivxlIVXL]{1,6}|\d{1,4}\s{1,}\|.*|.*\|\s*\d{1,4})$", re.I)
_NAMES = re.compile(r"^[A-ZÀ-Þ][\w(^~*■�'’.-]{2,}(?: (?:and|und|et|y) [A-ZÀ-Þ][\w(^~*■�'’.-]{2,}| et al\.?)?(?:\s*(?:/|:).*)?$")
_JOURNAL = re.compile(r"(?:, Vol\. ?[\dOlSB]+|[.\w] [\dOlSB]{1,3} \([\dOlSB]{4}\)(?:[ ,]+[\dOlSB–-]+)?|/ .*\. [\dOlSB]{1,3}(?: \([\dOlSB]{4}\))?)\.?$")


_TOKEN = re.compile(r"[^\s\-–—/.,;:()\[\]{}“”„\"!?%…<>«»。，；：、（）]+")
_SIGNS = re.compile(r"[■�]|[^\W\d_][\^~*]+[^\W\d_]")
_OPENED = re.compile(r"\w\(\w")
_CLEAN = _PUNCT.replace("(", "")
# Where a token is read in parts: at dashes and slashes, and between ideographs and other letters.
_PARTS = re.compile(r"[-–—/]|(?<=[㐀-鿿])(?=[^\W㐀-鿿])|(?<=[^\W㐀-鿿])(?=[㐀-鿿])")
GOOD, BAD, ASK = 0, 1, 2


class Lexicon:
    """The vocabulary as a trie, with counts of words and word pairs; ``CALLED`` pairs make a neighbour call for a word."""

    CALLED = 3

    END = ""

    def __init__(self, counts: dict[str, int], pairs: dict[str, int], total: int):
        self.counts, self.pairs, self.total = counts, pairs, max(1, total)
        self.root: dict = {}
        for w in counts:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[self.END] = w
        after: dict[str, set] = {}
        before: dict[str, set] = {}
        for pair, times in pairs.items():
            if times >= self.CALLED:
                a, b = pair.split(" ")
                after.setdefault(a, set()).add(b)
                before.setdefault(b, set()).add(a)
        self.after, self.before = after, before
        self.common = max(50, total * 1e-4)
        self.memo: dict[str, dict[str, tuple]] = {}
        self.verdicts: dict[str, int] = {}
        self.good: set[str] = set()

    def around(self, word: str) -> dict[str, tuple[tuple[str, str], ...]]:
        """Every vocabulary word within one insertion, deletion, substitution, merge or split: the automaton of distance one."""
        n, end, out = len(word), self.END, {}

        def follow(node, i: int, edit: tuple[str, str]) -> None:
            for c in word[i:]:
                node = node.get(c)
                if node is None:
                    return
            w = node.get(end)
            if w is not None and (w not in out or self._likely((edit,)) > self._likely(out[w])):
                out[w] = (edit,)

        node = self.root
        for i in range(n + 1):
            c = word[i] if i < n else end
            after = word[i + 1] if i + 1 < n else end
            for x, child in node.items():
                if x:
                    if after in child and c and x != c:
                        follow(child, i + 1, (c, x))
                    if c in child:
                        follow(child, i, ("", x))
            if not c:
                break
            if after in node:
                follow(node, i + 1, (c, ""))
            for bad, good in MERGED_BY.get(c, ()):
                if word.startswith(bad, i):
                    m = node
                    for x in good:
                        m = m.get(x)
                        if m is None:
                            break
                    else:
                        follow(m, i + len(bad), (bad, good))
            node = node.get(c)
            if node is None:
                break
        if node is not None and end in node:
            out[node[end]] = ()
        return out

    def retrieve(self, word: str, most: int, every: bool = False) -> dict[str, tuple[tuple[str, str], ...]]:
        """Every vocabulary word within ``most`` edits, merges and splits counting as one, with its cheapest edits.

        ``every``: all edits of the Levenshtein automaton; else only its transitions that recognition is known to cause.
        """
        if every and most == 1:
            return self.around(word)
        n, end = len(word), self.END
        out: dict[str, tuple] = {}
        stack = [(self.root, 0, ())]
        seen = set()
        while stack:
            node, i, edits = stack.pop()
            key = (id(node), i, len(edits)) if not every else (id(node), i, edits)
            if key in seen:
                continue
            seen.add(key)
            if i == n and end in node:
                w = node[end]
                if w not in out or len(edits) < len(out[w]) or self._likely(edits) > self._likely(out[w]):
                    out[w] = edits
            if i < n and word[i] in node:
                stack.append((node[word[i]], i + 1, edits))
            if len(edits) < most:
                c = word[i] if i < n else ""
                if every or c in NOISE and c:
                    for x, child in node.items():
                        if x == end:
                            continue
                        if i < n and x != c:
                            stack.append((child, i + 1, (*edits, (c, x))))
                        if every:
                            stack.append((child, i, (*edits, ("", x))))
                    if every and i < n:
                        stack.append((node, i + 1, (*edits, (c, ""))))
                else:
                    for x in SINGLE.get(c, ""):
                        if x in node:
                            stack.append((node[x], i + 1, (*edits, (c, x))))
                for bad, good in MERGED_BY.get(c, ()):
                    if word.startswith(bad, i):
                        m = node
                        for x in good:
                            m = m.get(x)
                            if m is None:
                                break
                        if m is not None:
                            stack.append((m, i + len(bad), (*edits, (bad, good))))
        return out

    @staticmethod
    def _likely(edits) -> int:
        return sum(1 for bad, good in edits if bad in NOISE and bad or good and (good in SINGLE.get(bad, "") or (bad, good) in MERGED))

    def explained(self, low: str) -> dict[str, tuple]:
        """All readings of an unknown or rare word that known confusions explain, with their edits; remembered."""
        got = self.memo.get(low)
        if got is None:
            got = {w: e for w, e in self.retrieve(low, 1).items() if e}
            if not got and low not in self.counts and len(low) >= 7:
                got = {w: e for w, e in self.retrieve(low, 2).items() if e}
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[low] = got
        return got

    def called_for(self, low: str, before: str, after: str) -> dict[str, tuple]:
        """All readings one edit away that the neighbours on both sides call for. The automaton runs only where some word stands between such neighbours."""
        between = self.after.get(before, frozenset()) & self.before.get(after, frozenset())
        return {w: e for w, e in self.around(low).items() if e and w in between} if between else {}

    def near(self, w: str, before: str, after: str) -> tuple[int, int]:
        """How often the word follows the one neighbour and precedes the other."""
        return self.pairs.get(f"{before} {w}", 0), self.pairs.get(f"{w} {after}", 0)

    def best(self, word: str, before: str = "", after: str = "") -> tuple[str, bool] | None:
        """The best reading of a word that is not what it should be, and whether recognition explains it; None where it stands."""
        low = word.lower()
        mine = self.counts.get(low, 0)
        if mine >= self.common or len(low) < 3 and not any(c in NOISE for c in low):
            return None
        pool = {w: e for w, e in self.explained(low).items() if self.counts[w] >= (30 * mine if mine else 1)}
        explained = bool(pool)
        if not pool and not mine and len(low) >= 5 and before and after:
            pool = self.called_for(low, before, after)
        if not pool:
            return None
        score = lambda w: math.log(self.counts[w]) + sum(2 * math.log1p(n) for n in self.near(w, before, after)) - 3 * len(pool[w])
        return max(sorted(pool), key=score), explained

    def misread(self, core: str) -> bool:
        """Whether a word or number shows a wrong character, whatever stands beside it."""
        return self.verdict(core) == BAD

    def verdict(self, core: str) -> int:
        """``GOOD``, ``BAD``, or ``ASK`` for an unknown word whose nearest words recognition does not explain."""
        got = self.verdicts.get(core)
        if got is None:
            if len(self.verdicts) >= MEMO:
                self.verdicts.clear()
            got = self._verdict(core)
            if len(core) <= 64:
                self.verdicts[core] = got
        return got

    def _verdict(self, core: str) -> int:
        letters = sum(c.isalpha() for c in core)
        digits = sum(c.isdigit() for c in core)
        if any(c in NOISE for c in core) and letters >= 2:
            if _SIGNS.search(core):
                return BAD
            bare = core.strip("*")
            return BAD if (len(bare) == len(core) or bare.lower() not in self.counts) and self.best(bare) is not None else GOOD
        if "�" in core or "■" in core:
            return BAD
        if digits:
            if letters == 0 or core in ("O2", "O3"):
                return GOOD
            if _NUMBER.fullmatch(core) and (core[0] in "lO" and core[1:2].isdigit() or re.search(r"\d[.,]?[OlSB]", core) or core[0] == "B" and core[1:2].isdigit() and "." in core):
                return BAD
            if re.fullmatch(r"[A-Z]{2}\d*[OlSB]\d+|[A-Z]{2}\d+[OlSB]\d*", core) and len(core) >= 5 or re.fullmatch(r"ds\.[\dOlSB]*[OlSB][\dOlSB]*", core):
                return BAD
            if letters >= 2 and re.search(r"[^\W\d_]", core):
                if re.search(r"[a-zà-ÿ][01569]+[a-zà-ÿ]", core) and core[0].isalpha() and letters >= 2 * digits:
                    return BAD
                return BAD if self.best(core) is not None and not re.search(r"\d{2}", core) else GOOD
            return GOOD
        if "(" in core:
            return BAD if re.search(r"[^\W\d_]\([a-zà-ÿ]", core) and ")" not in core else GOOD
        if letters < 3:
            return GOOD
        if self.best(core) is not None:
            return BAD
        return ASK if self.pairs and len(core) >= 5 and core.lower() not in self.counts else GOOD

    def token(self, raw: str) -> int:
        """The verdict on a token as it stands between spaces; it depends on nothing else, so good ones are remembered as they stand."""
        out = self._token(raw)
        if out == GOOD and len(raw) <= 64:
            if len(self.good) >= MEMO:
                self.good.clear()
            self.good.add(raw)
        return out

    def _token(self, raw: str) -> int:
        if raw[:1] == "(" and ")" not in raw and len(raw) > 4:
            rest = raw[1:].strip(_PUNCT).lower()
            if rest not in self.counts and "c" + rest in self.counts:
                return BAD
        core = core_of(raw)
        if not core or core.startswith(("http", "10.")) or self.counts.get(core.lower(), 0) >= self.common:
            return GOOD
        parts = _PARTS.split(core)
        got = {self.verdict(p) for p in parts if p}
        return BAD if BAD in got else ASK if got == {ASK} and len(parts) == 1 else GOOD


def core_of(raw: str) -> str:
    """A token without the punctuation around it."""
    return raw.strip(_CLEAN if _OPENED.search(raw) else _PUNCT)


def read_line(text: str, lex: Lexicon, head: str = "", tail: str = "") -> bool:
    """Whether a line holds a misread. ``head``: what precedes its first word in a broken word, ``tail``: what follows its last."""
    tokens = text.split()
    if not head and not tail and lex.good.issuperset(tokens):
        return False
    for k, raw in enumerate(tokens):
        if k == 0 and head:
            rest = raw.strip(_PUNCT)
            part = re.split(r"[-–—/]", rest)[0]
            if _half_wrong(head, part, lex, False):
                return True
            raw = rest[len(part) :]
        if k == len(tokens) - 1 and tail:
            core = raw.rstrip(HYPHEN).lstrip(_PUNCT)
            part = re.split(r"[-–—/]", core)[-1]
            if _half_wrong(part, tail, lex, True):
                return True
            raw = core[: len(core) - len(part)]
        if raw in lex.good:
            continue
        got = lex.token(raw)
        if got == BAD:
            return True
        if got == ASK and 0 < k < len(tokens) - 1 and lex.best(core_of(raw), core_of(tokens[k - 1]).lower(), core_of(tokens[k + 1]).lower()):
            return True
    return False


def _half_wrong(left: str, right: str, lex: Lexicon, want_left: bool) -> bool:
    """Whether the wanted half of a broken word is misread."""
    mine = left if want_left else right
    if any(c in "■�" for c in mine) or re.search(r"[^\W\d_][\^~*]|[\^~*][^\W\d_]", mine) or re.search(r"[a-zà-ÿ][01569]|[01569][a-zà-ÿ]", mine) and mine[-1:].isalpha() | mine[:1].isalpha():
        return True
    joined = (left + right).lower()
    if joined in lex.counts or len(joined) < 4 or (left.lower() in lex.counts and right.lower() in lex.counts):
        return lex.misread(mine) if joined not in lex.counts else False
    got = lex.best(joined)
    if got is None:
        return False
    target = got[0]
    i = 0
    while i < min(len(joined), len(target)) and joined[i] == target[i]:
        i += 1
    return (i < len(left)) == want_left


def broken(line: str, following: str) -> bool:
    """Whether ``line`` ends inside a word that ``following`` continues."""
    a, b = line.rstrip(), following.strip()
    if len(a) < 2 or a[-1] not in HYPHEN or not a[-2].isalnum():
        return False
    if not b or not b[0].isalnum():
        return False
    first = re.split(r"[\s,.;:)]", b, maxsplit=1)[0].lower()
    return first not in JOINERS


def furniture_lines(lines: list[str]) -> set[int]:
    """Numbers of the lines of a block that are page furniture."""
    out: set[int] = set()
    filled = [i for i, x in enumerate(lines) if x.strip()]
    if len(filled) < 2:
        return out
    width = max(len(lines[i]) for i in filled)
    texts = [lines[i].strip() for i in filled]

    def interrupts(i: int) -> bool:
        """The text before goes on after the line."""
        prev = next((lines[j].rstrip() for j in reversed(filled[:i]) if j not in out), "")
        return bool(prev) and not _ENDED_BEFORE.search(prev) and any(j not in out and not _LABEL.match(x) for j, x in zip(filled[i + 1 :], texts[i + 1 :]))

    for i, s in enumerate(texts):
        if len(s) <= 40 and _LABEL.match(s) and (len(s) > 3 or not s.isalpha() or s.lower() == s or s.upper() == s):
            if i < len(texts) - 1 or not re.fullmatch(r"[\dOlSIB]{1,5}", s, re.I):
                out.add(filled[i])
        elif len(s) > 40 and "|" in s and _LABEL.match(s):
            out.add(filled[i])
    for i, (k, s) in enumerate(zip(filled, texts)):
        if k in out or _ENDED.search(s) and not s.endswith("et al."):
            continue
        short = len(s) < 0.8 * width
        title = short and s[:1].isupper()
        paged = "  " in s and bool(_PAGED.search(s))
        if not (title or paged):
            # Only a name or journal line at the edge or beside other furniture may still be one.
            if i not in (0, len(texts) - 1) and not ((i and filled[i - 1] in out) or filled[i + 1] in out):
                continue
        near = (i > 0 and filled[i - 1] in out) or (i + 1 < len(filled) and filled[i + 1] in out)
        shape = bool(_NAMES.match(s)) or bool(_JOURNAL.search(s)) or (s.upper() == s and sum(c.isalpha() for c in s) >= 6 and not _HAN.search(s)) or ("  " in s and bool(_BESIDE.search(s)))
        # A line broken although the next word would have fitted is no line of running text.
        after = next((x.split()[0] for j, x in zip(filled[i + 1 :], texts[i + 1 :]) if j not in out), "")
        early = title and bool(after) and s[-1] not in HYPHEN and len(s) + 1 + len(after) <= 0.95 * width and len(s) < 0.75 * width
        edge = shape and i in (0, len(filled) - 1) and len(s) < 0.75 * width
        if paged or edge or early or (shape and near) or (title and (near or shape) and (interrupts(i) or near and shape)):
            out.add(k)
    return out


_ENDED = re.compile(r"[.!?。！？；]$")
_ENDED_BEFORE = re.compile(r"[.!?:;。！？；][\"'”’)\]]*$")
_PAGED = re.compile(r"^[\dOlSB]{1,4}\s{2,}\S|\S\s{2,}[\dOlSB]{1,4}$")
_BESIDE = re.compile(r"^\d{1,4}\s{2,}\S|\S\s{2,}\d{1,4}$")
_HAN = re.compile(r"[㐀-鿿]")


_SOFT = re.compile("\xad(?=[ \t]*(?:\r?\n|$))")
# What unification leaves alone: ASCII, precomposed Latin letters, common signs and ideographs. Other texts go through it.
# Greek letters beside Latin ones may be look-alikes.
_GREEK = "ΓΔΘΛΞΠΣΦΨΩα-γδ-ημλξπ-ω"
_UNUSUAL = re.compile(f"[^\t\n\x20-\x7e°±×¬·µÀ-ÖØ-öø-ĲĴ-ĿŁ-ňŊ-ž{_GREEK}–—“”‘’…−₀-₉■�㐀-鿿。，；：、！？𝐀-𝟿]|[A-Za-z][{_GREEK}]|[{_GREEK}][A-Za-z]")


def _clean(values) -> list[str]:
    """Unified texts; a soft hyphen at the end of a line keeps showing."""
    out = [v if isinstance(v, str) else None for v in values]
    odd = [i for i, v in enumerate(out) if v is not None and not v.isascii() and _UNUSUAL.search(v)]
    if odd:
        kept = [_SOFT.sub("¬", out[i]) for i in odd]
        for i, v in zip(odd, unify_arrow(pa.array(kept, type=pa.string())).to_pylist()):
            out[i] = v
    return out


def build_lexicon(texts: DataFrame) -> Lexicon:
    """The vocabulary and the word pairs of a column ``text`` over its distinct lines. A line that is repeated or redelivered counts once, so copies do not vouch for their own misreads; they
    are dropped before the shuffle. Words and pairs below the relative floor stay on the executors, so the driver gets at most ``1 / FLOOR`` of each."""

    def count(frames):
        held, size = [], 0

        def counted():
            """Words and pairs of the lines held, as arrays of word numbers."""
            text = "\n".join(t if t[-1] not in HYPHEN else t[: max(t.rfind(" "), 0)] for t in held).lower()
            codes, words = pd.factorize(np.array([*_WORDS_AND_LINES.findall(text), "\n"], dtype=object))
            line = int(codes[-1])
            keep = np.array([w != "\n" and not _NO_WORD.search(w) for w in words])
            n = np.bincount(codes, minlength=len(words))
            total = len(codes) - int(n[line])
            a, b = codes[:-1].astype(np.int64), codes[1:].astype(np.int64)
            both = keep[a] & keep[b]
            couple, times = np.unique(a[both] * len(words) + b[both], return_counts=True)
            one = np.flatnonzero(keep)
            two = words[couple // len(words)] + " " + words[couple % len(words)] if len(couple) else []
            return pd.DataFrame({"kind": [0] + [1] * len(one) + [2] * len(couple), "w": ["", *words[one], *two], "n": [total, *n[one], *times]})

        for f in frames:
            lines = [x for x in (t.strip() for t in _clean(f["text"]) if t) if x]
            held += lines
            size += sum(map(len, lines))
            if size > 1 << 23:
                yield counted()
                held, size = [], 0
        yield counted()

    lines = texts.select(F.explode(F.split("text", r"\r\n?|\n")).alias("text")).select(F.trim("text").alias("text")).filter("text <> ''").distinct()
    counts = written(lines.mapInPandas(count, "kind int, w string, n bigint").groupBy("kind", "w").agg(F.sum("n").alias("n")).filter(f"kind = 0 or n >= {LEAST}"))
    total = counts.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    floor = max(LEAST, math.ceil(total * FLOOR))
    got = counts.filter((F.col("kind") > 0) & (F.col("n") >= floor)).toPandas()
    ones, twos = got[got["kind"] == 1], got[got["kind"] == 2]
    return Lexicon(dict(zip(ones["w"], map(int, ones["n"]))), dict(zip(twos["w"], map(int, twos["n"]))), int(total))


_WORDS_AND_LINES = re.compile(_TOKEN.pattern + "|\n")
# What no word of the vocabulary holds.
_NO_WORD = re.compile(r"[\d\^~*■�(|!$_=&]|^[\W_]*$")
_WORKER: dict[int, Lexicon] = {}


def _shared(spark, lex: Lexicon):
    """A broadcast of the counts; every Python worker builds its trie once."""
    b = spark.sparkContext.broadcast((lex.counts, lex.pairs, lex.total))
    key = b._jbroadcast.id()  # the broadcast's own number in the application

    def get() -> Lexicon:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = Lexicon(*b.value)
        return _WORKER[key]

    return get


# A line end that may break a word.
ENDS = r"[-\x{2010}\x{2011}\x{ac}\x{ad}\x{ff0d}][\s\x{a0}\x{2000}-\x{200f}\x{202f}\x{2060}\x{2063}\x{3000}\x{feff}]*$"
# A page label, a roman or arabic number among signs, as the whole line.
_LABEL_SQL = r"(?i)^\s*(?:[–—-]?\s*[\dOlSIBivx]{1,6}\s*[–—-]?|(?:page|seite|página|pagina|p\.?|第)\s*[\dOlSIB]{1,5}(?:\s*(?:of|von|de|sur|/|页，?共)\s*[\dOlSIB]{1,5})?\s*页?)\s*$"


def fragment_lines(fragments: DataFrame) -> DataFrame:
    """Distinct lines in reading order: their place, whether they are page furniture, and, for the lines of the body, what tells where paragraphs begin and the neighbours:
    ``before_h`` and ``after_h`` are null where there is none; ``before`` and ``after`` are texts that may share a broken word with the line."""
    filled = fragments.filter("text is not null and trim(text) <> ''")
    lines = filled.select("artifact_id", "page", (F.col("x") >= COLUMN).cast("int").alias("col"), F.col("y"), "x", "text", F.coalesce("bold", F.lit(False)).alias("bold"), "font_size").dropDuplicates(["artifact_id", "page", "x", "y", "text"])
    w = Window.partitionBy("artifact_id", "page").orderBy("col", F.desc("y"), "x", "text")  # the lines of one page
    paged, pageful = Window.partitionBy("artifact_id", "page"), Window.partitionBy("artifact_id", "page", "col")
    outer = (F.col("y") >= TOP) | (F.col("y") <= BOTTOM)
    lines = (
        lines.withColumn("outer", outer)
        .withColumn("down", F.when(F.lead("col").over(w) == F.col("col"), F.col("y") - F.lead("y").over(w)))
        .withColumn("up", F.when(F.lag("col").over(w) == F.col("col"), F.lag("y").over(w) - F.col("y")))
        .withColumn("leading", F.min(F.when((F.col("down") > 3) & ~F.col("outer") & ~F.lead("outer").over(w), F.col("down"))).over(paged))
        .withColumn("from_top", F.max("y").over(paged) - F.col("y"))
        .withColumn("from_bottom", F.col("y") - F.min("y").over(paged))
        .withColumn("inward", F.when(F.col("from_top") <= F.col("from_bottom"), F.lead("font_size").over(w)).otherwise(F.lag("font_size").over(w)))
    )
    near_edge = F.coalesce(F.least("from_top", "from_bottom") < 0.6 * F.col("leading"), F.col("outer"))
    gap = F.when(F.col("from_top") <= F.col("from_bottom"), F.col("down")).otherwise(F.col("up"))
    off = F.coalesce((gap < 0.85 * F.col("leading")) | (gap > 1.15 * F.col("leading")), F.lit(True))
    off = off | (F.abs(F.col("font_size") - F.col("inward")) > 0.5)
    label = F.col("text").rlike(_LABEL_SQL)
    sure = near_edge & F.col("outer") & (off | label)
    lines = lines.withColumn("sure", sure).withColumn("open", near_edge & ~F.col("sure") & (F.col("outer") | (off & F.col("leading").isNotNull()))).withColumn("side", F.col("from_top") <= F.col("from_bottom"))
    lines = lines.withColumn("own", F.when(~F.col("sure"), F.col("text")))
    over = "over (partition by artifact_id, page order by col, y desc, x, text)"
    lines = lines.withColumn("b", F.expr(f"lag(own) ignore nulls {over}")).withColumn("n", F.expr(f"lead(own) ignore nulls {over}")).withColumn("beside", F.expr(f"lag(open) {over}") | F.expr(f"lead(open) {over}"))
    lines = lines.withColumn("left_edge", F.min(F.when(~F.col("sure"), F.col("x"))).over(pageful)).withColumn("prev_bold", F.expr(f"lag(if(sure, null, bold)) ignore nulls {over}"))
    # Of the neighbours only texts that may share a broken word are kept, and a hash of each: null where there is none on the page.
    hyphened = lambda c: F.col(c).rlike(ENDS)
    lines = lines.select(
        "artifact_id", "page", "col", "y", "x", "text", "bold", F.col("sure").alias("furniture"), "open", F.coalesce("beside", F.lit(False)).alias("beside"), "side", "left_edge", "prev_bold",
        F.when(F.col("b").isNotNull(), F.xxhash64("b")).alias("before_h"), F.when(F.col("n").isNotNull(), F.xxhash64("n")).alias("after_h"), F.when(hyphened("b"), F.col("b")).alias("before"), F.when(hyphened("text"), F.col("n")).alias("after"),
    )
    lines = written(lines)
    # Doubtful lines at an edge are furniture where they repeat, digits aside, at that edge of other pages of the artifact.
    edges = lines.filter("furniture or open").select("artifact_id", "page", "side", "open", F.xxhash64(F.regexp_replace(F.lower(F.trim("text")), r"\d+", "#")).alias("key"), F.xxhash64("text").alias("h"))
    again = edges.groupBy("artifact_id", "side", "key").agg(F.min("page").alias("a"), F.max("page").alias("b")).filter("a < b").select("artifact_id", "side", "key")
    confirmed = edges.filter("open").join(again, ["artifact_id", "side", "key"], "left_semi").groupBy("artifact_id", "page").agg(F.collect_set("h").alias("confirmed"))  # edge lines of one page
    is_one = lambda h: F.coalesce(F.array_contains("confirmed", h), F.lit(False))
    doubtful = lines.filter("open or beside").join(confirmed, ["artifact_id", "page"], "left").withColumn("furniture", F.col("furniture") | (F.col("open") & is_one(F.xxhash64("text"))))
    for side in ("before", "after"):
        gone = is_one(F.col(f"{side}_h"))
        doubtful = doubtful.withColumn(side, F.when(~gone, F.col(side))).withColumn(f"{side}_h", F.when(~gone, F.col(f"{side}_h")))
    lines = lines.filter("not (open or beside)").unionByName(doubtful.drop("confirmed")).drop("open", "beside", "side")
    # The lines at the ends of a page have their other neighbour on the next one.
    first, last = "not furniture and before_h is null", "not furniture and after_h is null"
    inner, ends = lines.filter(f"not ({first}) and not ({last})"), lines.filter(f"({first}) or ({last})")
    ends = ends.join(lines.filter(first).select("artifact_id", (F.col("page") - 1).alias("page"), F.col("text").alias("next_first")), ["artifact_id", "page"], "left")
    ends = ends.join(lines.filter(last).select("artifact_id", (F.col("page") + 1).alias("page"), F.col("text").alias("prev_last")), ["artifact_id", "page"], "left")
    takes_after, takes_before = F.col("after_h").isNull() & F.col("next_first").isNotNull(), F.col("before_h").isNull() & F.col("prev_last").isNotNull()
    ends = ends.withColumn("after", F.when(takes_after & hyphened("text"), F.col("next_first")).otherwise(F.col("after"))).withColumn("before", F.when(takes_before & hyphened("prev_last"), F.col("prev_last")).otherwise(F.col("before")))
    ends = ends.withColumn("after_h", F.when(takes_after, F.xxhash64("next_first")).otherwise(F.col("after_h"))).withColumn("before_h", F.when(takes_before, F.xxhash64("prev_last")).otherwise(F.col("before_h")))
    return inner.unionByName(ends.select(*inner.columns))


def _line_noise(text: str, before: str | None, after: str | None, lex: Lexicon) -> list[str]:
    out = []
    before, after = before or "", after or ""
    cut = broken(text, after)
    if cut:
        out.append("hyphen_break")
    head = before.rstrip().rstrip(HYPHEN).split()[-1].lstrip(_PUNCT) if broken(before, text) and before.split() else ""
    head = re.split(r"[-–—/]", head)[-1]
    tail = re.split(r"[-–—/]", after.split()[0].strip(_PUNCT))[0] if cut and after.split() else ""
    if read_line(text, lex, head, tail):
        out.append("misread")
    return out


_AT_END = re.compile(r"[-‐‑¬­]\s*\n")


def _block_noise(text: str, lex: Lexicon) -> list[str]:
    lines = text.split("\n")
    furniture = furniture_lines(lines)
    found = {"furniture"} if furniture else set()
    if _AT_END.search(text) is None:
        # No line ends inside a word, so every token is read as it stands.
        if lex.good.issuperset(text.split()):
            return sorted(found)
    kept = [x for k, x in enumerate(lines) if k not in furniture and x.strip()]
    for k, x in enumerate(kept):
        found |= set(_line_noise(x, kept[k - 1] if k else "", kept[k + 1] if k + 1 < len(kept) else "", lex))
        if {"misread", "hyphen_break"} <= found:
            break
    return sorted(found)


def find_noise(fragments: DataFrame, hits: DataFrame) -> DataFrame:
    """``src_table, row_id, noise``: one row for each kind of noise a row holds."""
    spark = fragments.sparkSession
    get = _shared(spark, build_lexicon(fragments.select("text").unionByName(hits.select("text"))))

    @F.pandas_udf("array<string>")
    def line_noise(text: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        lex = get()
        return pd.Series([_line_noise(t, b, a, lex) if t else [] for t, b, a in zip(_clean(text), _clean(before), _clean(after))])

    @F.pandas_udf("array<string>")
    def block_noise(text: pd.Series) -> pd.Series:
        lex = get()
        return pd.Series([_block_noise(t, lex) if t else [] for t in _clean(text)])

    place = ["a", "page", "x", "y", "h"]  # of a line; hashes instead of the strings
    hashes = F.xxhash64("artifact_id").alias("a"), F.xxhash64("text").alias("h")
    rows = fragments.filter("text is not null and trim(text) <> ''").select(*hashes, "page", "x", "y", "fragment_id")
    lines = fragment_lines(fragments).select(*hashes, "page", "x", "y", "furniture", F.when(~F.col("furniture"), F.col("text")).alias("text"), "before", "after")
    lines = spread(lines).withColumn("found", line_noise("text", "before", "after")).select(*place, F.when(F.col("furniture"), F.array(F.lit("furniture"))).otherwise(F.col("found")).alias("noise")).filter(F.size("noise") > 0)
    body = rows.join(lines, place).select(F.lit("fragment").alias("src_table"), F.col("fragment_id").alias("row_id"), F.explode("noise").alias("noise"))
    blocks = hits.filter("text is not null and trim(text) <> ''").select(F.lit("search_hit").alias("src_table"), F.col("hit_id").alias("row_id"), F.explode(block_noise("text")).alias("noise"))
    return body.unionByName(blocks)


def mend(lines: list[str], lex: Lexicon) -> str:
    """One paragraph of its lines: broken words joined, misread words read again."""
    text = ""
    for k, line in enumerate(lines):
        s = line.strip()
        if not s:
            continue
        if text and broken(text, s):
            head = re.split(r"[\s–—/]", text.rstrip(HYPHEN))[-1].lstrip(_PUNCT)
            first = re.split(r"[\s,.;:)–—/]", s, maxsplit=1)[0]
            whole = lex.counts.get((head + first).lower(), 0) or lex.best(head + first) is not None
            parts = all(p.lower() in lex.counts for p in (head.split("-")[-1], first.split("-")[0]))
            text = text.rstrip(HYPHEN) + ("-" if (not whole and parts) or not first[:1].islower() else "") + s
        else:
            text = f"{text} {s}" if text and not _HAN.match(s[:1]) else text + s
    words = text.split(" ")
    for k, raw in enumerate(words):
        if raw in lex.good or lex.token(raw) == GOOD:
            continue
        core = core_of(raw)
        before = core_of(words[k - 1]).lower() if k else ""
        after = core_of(words[k + 1]).lower() if k + 1 < len(words) else ""
        if _NUMBER.fullmatch(core):
            new = core.translate(str.maketrans("OlSB", "0158"))
        else:
            got = lex.best(core, before, after)
            if not got:
                continue
            new = got[0].upper() if core.isupper() else got[0][:1].upper() + got[0][1:] if core[0].isupper() else got[0]
        words[k] = raw.replace(core, new, 1)
    return " ".join(words)


def repair_hits(hits: DataFrame, lex: Lexicon) -> DataFrame:
    """``hit_id, repaired``: paragraphs separated by blank lines; null texts stay null."""
    get = _shared(hits.sparkSession, lex)

    @F.pandas_udf("string")
    def repaired(texts: pd.Series) -> pd.Series:
        lex, out = get(), []
        for t in _clean(texts):
            if not t:
                out.append(t)
                continue
            lines = t.split("\n")
            furniture = furniture_lines(lines)
            groups: list[list[str]] = [[]]
            for k, x in enumerate(lines):
                if k in furniture:
                    continue
                if not x.strip():
                    # A blank line beside furniture does not end a paragraph.
                    if groups[-1] and not (furniture & {k - 1, k + 1, k - 2, k + 2}):
                        groups.append([])
                    continue
                groups[-1].append(x)
            out.append("\n\n".join(mend(g, lex) for g in groups if g))
        return pd.Series(out, dtype=object)

    return hits.select("hit_id", repaired("text").alias("repaired"))


def paragraph_owners(pages: DataFrame) -> DataFrame:
    """For every page (``artifact_id, page, last_no``) the page at or before it on which its last paragraph begins, and that paragraph's number.

    Pages on which none begins point to the one before; pointers are doubled until all have arrived, so long runs take few joins and no
    artifact is gathered in one task.
    """
    begins = F.col("last_no") > 0
    p = written(pages.select("artifact_id", "page", F.when(begins, F.col("page")).otherwise(F.col("page") - 1).alias("owner"), F.when(begins, F.col("last_no")).alias("owner_no")))
    while p.filter("owner_no is null").limit(1).count():
        step = p.select("artifact_id", F.col("page").alias("owner"), F.col("owner").alias("_o"), F.col("owner_no").alias("_n"))
        ahead = p.filter("owner_no is null").join(step, ["artifact_id", "owner"], "left")
        # A page without a predecessor keeps its own lines.
        ahead = ahead.select("artifact_id", "page", F.coalesce("_o", "page").alias("owner"), F.when(F.col("_o").isNull(), 0).otherwise(F.col("_n")).alias("owner_no"))
        p = written(p.filter("owner_no is not null").unionByName(ahead))
    return p


def repair_fragments(fragments: DataFrame, lex: Lexicon) -> DataFrame:
    """``artifact_id, page, paragraph_no, text``: the paragraphs of every artifact in reading order, named by the page they begin on.

    A paragraph begins at an indented line, a heading, after a heading, or at the top of a page whose predecessor is not there; a
    page's opening lines without such a beginning belong to the last paragraph of the nearest earlier page on which one begins.
    """
    get = _shared(fragments.sparkSession, lex)
    lines = fragment_lines(fragments).filter("not furniture")
    w = Window.partitionBy("artifact_id", "page").orderBy("col", F.desc("y"), "x", "text")
    begins = (F.col("x") - F.col("left_edge") > 6) | F.col("bold") | F.coalesce("prev_bold", F.lit(False))
    lines = lines.withColumn("begins", begins.cast("int")).withColumn("line_no", F.row_number().over(w))
    lines = lines.withColumn("begins", F.when((F.col("line_no") == 1) & F.col("before_h").isNull(), 1).otherwise(F.col("begins"))).withColumn("no", F.sum("begins").over(w))
    lines = written(lines)
    owner = paragraph_owners(lines.groupBy("artifact_id", "page").agg(F.max("no").alias("last_no")))
    # The lines before a page's first beginning go on from the last paragraph of the nearest earlier page on which one begins.
    lines = lines.join(owner.select("artifact_id", (F.col("page") + 1).alias("page"), "owner", "owner_no"), ["artifact_id", "page"], "left")
    carried = (F.col("no") == 0) & F.col("owner").isNotNull()
    lines = lines.withColumn("p", F.when(carried, F.col("owner")).otherwise(F.col("page"))).withColumn("n", F.when(carried, F.col("owner_no")).otherwise(F.col("no")))
    groups = lines.groupBy("artifact_id", F.col("p").alias("page"), F.col("n").alias("paragraph_no")).agg(F.sort_array(F.collect_list(F.struct(F.col("page").alias("pg"), "line_no", "text"))).alias("ls"))

    @F.pandas_udf("string")
    def mended(ls: pd.Series) -> pd.Series:
        lex = get()
        return pd.Series([mend([t or "" for t in _clean([x["text"] for x in one])], lex) for one in ls], dtype=object)

    return spread(groups).select("artifact_id", "page", "paragraph_no", mended("ls").alias("text"))
