"""Text rules as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ventide import config as C

# Marks left by text extraction, and the shapes of lines.
SOFT_BREAK = "￾"
BAD_EQUALS = "¼"
MATH_ITALIC = r"[\x{1D400}-\x{1D7FF}]"
FORMULA_NOTE = " [formula not recoverable from PDF] "
NUMERIC_TOKEN = r"^[-+]?[\d.,:%()/]+$"
ROMAN = r"^\s*[IVXL]+\.\s+\S"
OUTLINE = r"^\s*(?:[IVXL]+\.|[A-Z]\.|\d+\.)\s+\S"
CONTENTS = r"\.{3,}|\s\d{1,3}\s*$"
REFERENCE = r"(?i)\bet al\b|\d{4};|\bp\s*=|\bn\s*="
# Three more short tokens decide; an open count would recurse once a token of a long line.
SHORT_TOKENS = r"(?:\b(\S{1,4})\b[ ]+)(?:\S{1,4}[ ]+){3}"
GRADED = (r"(?is)We\s+(recommend|suggest)\b((?:(?!We\s+(?:recommend|suggest)).){0,600}?)"
          r"\((strong|conditional|weak)\s+recommendation,\s*"
          r"(very\s+low|low|moderate|high)\s+certainty\)")


def line_key(c: Column) -> Column:
    """Identity of a line: lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def statement_key(c: Column) -> Column:
    """A line key that keeps two numbers apart: "1-23" and "12-3" are different statements."""
    inner = r"(?<=[a-z])[^a-z0-9]+|^[^a-z0-9]+|[^a-z0-9]++(?![0-9])"
    return F.regexp_replace(F.regexp_replace(F.lower(c), inner, ""), "[^a-z0-9]+", " ")


def mask_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\d+", "#")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t]+", " "))


def tokens(c: Column) -> Column:
    """Blank-separated tokens."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def numeric_share(c: Column) -> Column:
    """Share of tokens that are numbers or number-like."""
    all_ = tokens(c)
    hits = F.size(F.filter(all_, lambda t: t.rlike(NUMERIC_TOKEN)))
    return F.when(F.size(all_) > 0, hits / F.size(all_)).otherwise(0.0)


def table_like(c: Column) -> Column:
    enough = word_count(c) >= 3
    return enough & ((numeric_share(c) >= 0.4) | c.rlike(SHORT_TOKENS))


def heading_like(c: Column) -> Column:
    """Shape of a heading: short, starts a phrase, no sentence end, no contents entry."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return (
        (F.length(c) > 0)
        & (word_count(c) <= 14)
        & ~c.rlike(r"[.;,]$")
        & ~c.rlike(CONTENTS)
        & c.rlike(r"^[\p{Lu}\p{Nd}]")
        & (letters >= 3)
        & ~table_like(c)
        & ~c.rlike(REFERENCE)
    )


# Styled mathematical letters and digits, and the plain ones that compatibility folding gives.
_STYLED = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x1D400, 0x1D800)}
_STYLED = {styled: plain for styled, plain in _STYLED.items() if plain != styled}


def _fold(c: Column) -> Column:
    return F.translate(c, "".join(_STYLED), "".join(_STYLED.values()))


def repair_glyphs(c: Column, folds: bool = True) -> Column:
    """Undo known extraction defects: a wrong equals sign, dead formulas, styled letters,
    control characters."""
    fixed = F.replace(c, F.lit(BAD_EQUALS), F.lit("="))
    run = f"{MATH_ITALIC}{{{C.MATH_ITALIC_MAX_RUN + 1},}}"
    fixed = F.regexp_replace(fixed, run, FORMULA_NOTE.replace("[", r"\[").replace("]", r"\]"))
    if folds:
        fixed = F.when(fixed.rlike(MATH_ITALIC), _fold(fixed)).otherwise(fixed)
    return F.regexp_replace(fixed, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")


def anchor_hits(text: Column, terms: Column) -> Column:
    """Mentions of any term, bounded by non-alphanumerics, ignoring case."""
    def hits(term: Column) -> Column:
        escaped = F.regexp_replace(F.lower(term), r"([^\p{L}\p{N}\s])", r"\\$1")
        pattern = F.concat(F.lit("(?<![a-z0-9])"), escaped, F.lit("(?![a-z0-9])"))
        return F.regexp_count(F.lower(text), pattern)

    return F.aggregate(F.transform(terms, hits), F.lit(0), lambda a, n: a + n)
