"""Text operators: rule-logged cleaning, splitters, token windows and tokenisation."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let
from pyspark.sql.types import StringType

# Lines and preambles that are no part of a document, by the name that is logged. The
# flags read as Unicode, unix lines, any case and, where lines are meant, one line.
BOILERPLATE = (
    (
        "transcript_disclosure_preamble",
        r"(?Udi)\A\s*TRANSCRIPT\s+FEDERAL OPEN MARKET COMMITTEE MEETING[\s\S]*?All information deleted in this manner is exempt from disclosure under applicable provisions of the Freedom of Information Act\.\s*",
    ),
    ("staff_statements_heading", r"(?Udim)^\s*Staff Statements Appended to the Transcript\s*$"),
    ("content_modified_line", r"(?Udim)^\s*Content\s+last\s+modified\s+\d{1,2}/\d{1,2}/\d{2,4}\.?\s*$"),
    (
        "conference_call_heading",
        r"(?Udim)^\s*Conference Call of (?:the\s+)?Federal Open Market Committee on [A-Za-z]+\s+\d{1,2},\s+\d{4}(?:,?\s+at\s+\d{1,2}:\d{2}\s*(?:a\.m\.|p\.m\.))?\s*$",
    ),
    ("meeting_heading", r"(?Udim)^\s*Meeting of (?:the\s+)?Federal Open Market Committee [A-Za-z]+\s+\d{1,2}(?:[-–]\d{1,2})?,\s+\d{4}\s*$"),
)


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """HTML entities resolved and compatibility forms composed; the one step the JVM has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", html.unescape(t)))


def strip_rules(text: Column) -> tuple[Column, Column]:
    """Text without boilerplate, and the names of the rules that took something out, in order."""
    names = []
    for name, pattern in BOILERPLATE:
        names.append(F.when(text.rlike(pattern), F.lit(name)))
        text = F.regexp_replace(text, pattern, "")
    return text, F.array_compact(F.array(*names))


def tidy(text: Column) -> Column:
    """Byte-order marks out, wrapped words joined, blanks and empty lines collapsed, controls out."""
    text = F.replace(F.replace(text, F.lit("﻿"), F.lit("")), F.lit("ï»¿"), F.lit(""))
    for pattern, put in (
        (r"(?U)(\w)-\s*\n\s*(\w)", "$1$2"),
        (r"[ \t]+\n", "\n"),
        (r"\n{3,}", "\n\n"),
        (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),
        (r"[ \t]{2,}", " "),
        (r"(?U)^\s+|\s+$", ""),
    ):
        text = F.regexp_replace(text, pattern, put)
    return text


def clean(text: Column, resolve: bool = True) -> tuple[Column, Column]:
    """Cleaned text and the names of matched rules; ``resolve`` also resolves entities and forms."""
    text = F.coalesce(text, F.lit(""))
    bare, rules = strip_rules(unescaped(text) if resolve else text)
    return tidy(bare), rules


def diagnostics(raw: Column, cleaned: Column) -> dict[str, Column]:
    """Lengths, characters removed (never below 0) and their share (0 of an empty text)."""
    before, after = F.length(F.coalesce(raw, F.lit(""))).cast("long"), F.length(cleaned).cast("long")
    removed = F.greatest(before - after, F.lit(0).cast("long"))
    return {
        "raw_text_length": before,
        "cleaned_text_length": after,
        "characters_removed": removed,
        "removal_ratio": F.coalesce(F.try_divide(removed.cast("double"), before.cast("double")), F.lit(0.0)),
    }


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def paragraphs(text: Column) -> Column:
    """Parts between blank lines."""
    return _trimmed(F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), r"\n\s*\n"))


def sentences_by_stop(text: Column) -> Column:
    """Parts after a full stop, exclamation or question mark and white space."""
    return _trimmed(F.split(text, r"(?U)(?<=[.!?])\s+"))


def sentences_by_line(text: Column) -> Column:
    """Lines, cut after a stop where a capital, digit or quotation mark follows."""
    flat = F.regexp_replace(text, r"[\t\r ]+", " ")
    cut = F.flatten(F.transform(F.split(flat, r"\n+"), lambda line: F.split(line, r"(?<=[.!?])\s+(?=[A-Z0-9\"“'])")))
    return _trimmed(cut)


def token_windows(tokens: Column, max_length: int, stride: int, specials: int = 2) -> Column:
    """Windows of content tokens that overlap by ``stride``; the last one reaches the end."""
    capacity = max_length - specials
    if capacity < 1 or not 0 <= stride < capacity:
        raise ValueError("a window needs room for content and must advance")
    step = capacity - stride

    def cut(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(own) - stride - 1, F.lit(0)), F.lit(step))
        return F.when(F.size(own) > 0, F.transform(starts, lambda i: F.slice(own, i + 1, F.lit(capacity))))

    return let(tokens, cut)


def words(text: Column, stop_words: tuple[str, ...], longer_than: int = 2) -> Column:
    """Letters and digits in lower case, without stop words and very short words."""
    bare = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-zA-Z0-9]+", " "))
    return F.filter(F.split(F.trim(bare), " +"), lambda w: (F.length(w) > longer_than) & ~w.isin(*stop_words))


def label_tokens(label: Column) -> Column:
    """The distinct words of a label, in lower case."""
    bare = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9]+", " ")
    return F.array_distinct(F.filter(F.split(F.trim(bare), " "), lambda w: w != ""))


def best_category(tokens: Column, categories: dict[str, tuple[str, ...]], default: str, threshold: float = 0.30, enough: int = 3) -> Column:
    """The category whose words overlap most (Jaccard), those with ``enough`` common words first; ties go to
    the one listed first, and below the threshold to ``default``."""
    scored = []
    for i, (name, own) in enumerate(categories.items()):
        theirs = F.array(*(F.lit(w) for w in own))
        inter = F.size(F.array_intersect(tokens, theirs))
        share = F.coalesce(F.try_divide(inter.cast("double"), F.size(F.array_union(tokens, theirs)).cast("double")), F.lit(0.0))
        scored.append(F.struct((inter >= enough).alias("enough"), share.alias("share"), F.lit(-i).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scored))
    return F.when((F.size(tokens) > 0) & (best["share"] >= threshold), best["name"]).otherwise(F.lit(default))
