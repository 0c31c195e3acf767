"""Literal query language: parsing on the driver, containment and score as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import search_view

# What counts as a number in a query, and the parts of the score.
NUMERIC = re.compile(r"[+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:e[+-]?\d+)?%?")
PHRASE_SCORE, DECIMALS = 2, 6


def split_query(query: str) -> list[str]:
    """Pieces of a query: a quote opens a phrase that runs to the next quote, white space ends a bare word."""
    pieces, piece, quoted = [], "", False
    for c in query:
        if c == '"':
            pieces.append(piece)
            piece, quoted = "", not quoted
        elif c.isspace() and not quoted:
            pieces.append(piece)
            piece = ""
        else:
            piece += c
    if quoted:
        raise ValueError(f"no closing quote in {query!r}")
    return [*pieces, piece]


def terms_of(query: str, exact: bool = False) -> list[str]:
    """Distinct terms in their search view and order; ``exact`` takes the whole query as one. Raises where none is left."""
    pieces = [query or ""] if exact else split_query(query or "")
    terms = list(dict.fromkeys(t for t in map(search_view, pieces) if t))
    if not terms:
        raise ValueError("nothing to search for")
    return terms


def contains(text: Column, term: str) -> Column:
    """Substring test; a number matches a whole magnitude only, with its sign where one is given."""
    if not NUMERIC.fullmatch(term):
        return F.instr(text, term) > 0
    before = r"(?<![0-9.])" + ("(?<![+-])" if term[0] in "+-" else "") + r"(?<![0-9]e)(?<![0-9]e[+-])"
    return text.rlike(before + re.escape(term).replace("%", "%") + r"(?![0-9]|\.[0-9])(?!e[+-]?[0-9])")


def may_meet(raw: Column, terms: list[str], mode: str, full: bool) -> Column:
    """A test of the raw text that every text meeting the query passes, before the view is made.

    A word of ASCII letters can enter the view only from the text in lower case, by a joined line break, or from characters beyond ASCII.
    """
    beyond = raw.rlike(r"-\s*\n" + (r"|[^\x00-\x7f]" if full else ""))
    tests = [F.instr(F.lower(raw), t) > 0 for t in terms if re.fullmatch("[a-z]+", t)]
    if not tests or mode == "or" and len(tests) < len(terms):
        return F.lit(True)
    met = tests[0]
    for t in tests[1:]:
        met = met & t if mode == "and" else met | t
    return met | beyond


def score(text: Column, terms: list[str], mode: str = "and") -> Column:
    """2 for the phrase, plus the share of matched terms, plus their density; null where the query is not met."""
    if mode not in ("and", "or"):
        raise ValueError("mode is and or or")
    matched = sum(contains(text, t).cast("int") for t in terms)
    met = matched == len(terms) if mode == "and" else matched > 0
    phrase = F.when(F.instr(text, " ".join(terms)) > 0, PHRASE_SCORE).otherwise(0)
    return F.when(met, F.round(phrase + matched / F.lit(float(len(terms))) + matched / F.greatest(F.length(text), F.lit(1)).cast("double"), DECIMALS))
