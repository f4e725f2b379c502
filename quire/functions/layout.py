"""What a span's or line's text, font and place say about it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as maths, those that alone suggest it, bullets, and patterns.
MATHS = r"[=+\-−×÷/^()\[\]{}0-9.,%$≤≥≠≈∑∫√·•]"
STRONG = r"[∑∫√≤≥≠≈×÷⁄·∞±→∂∏σµ]"
GREEK = r"[∑∫√≤≥≠≈×÷⁄·∞±→∂∏σµ\x{0370}-\x{03FF}\x{0300}-\x{036F}]"
BULLET = r"^[□❑▪■◾◼●◦‣•◻☐∙‚]"
COPYRIGHT = r"(?i)For candidate use only|©\s*CFA|©\s*\d{4}|All rights reserved|\bISBN\b"
LABEL = r"^[A-Za-z0-9]{1,2}[.)]$"
NUMBER = r"^[$()–—−\-\d.,%\s]+$"
CURRENCY = r"(?<![A-Za-z])[A-Z]{2,4}(?=[\d(.])"
FORMULA_HEAD = r"^[A-Za-z][A-Za-z0-9]{0,4}\s*="


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def once(value: Column, use) -> Column:  # noqa: ANN001
    """``use`` of a value that is worked out once: a column that a lambda reads from outside may be put in its place
    there, and would be worked out for each element."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def signs(text: Column, pattern: str) -> Column:
    """How many single characters are of the pattern, without a list of them."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def is_copyright(text: Column) -> Column:
    return text.rlike(COPYRIGHT)


def is_heading_font(font: Column) -> Column:
    return F.lower(font).rlike("bold|black|cond|italic")


def is_code_font(font: Column) -> Column:
    return F.lower(font).rlike("courier|mono|consol")


def is_bold(font: Column, flags: Column) -> Column:
    return F.lower(font).rlike("bold|black") | (flags.bitwiseAND(16) != 0)


def is_italic(font: Column, flags: Column) -> Column:
    return F.lower(font).rlike("italic|oblique") | (flags.bitwiseAND(2) != 0)


def is_superscript(flags: Column) -> Column:
    return flags.bitwiseAND(1) != 0


def num_cell(text: Column) -> Column:
    """A cell of digits and marks, or one after its currency codes are taken off."""
    bare = F.regexp_replace(text, CURRENCY, "")
    plain = lambda t: t.rlike(NUMBER) & t.rlike(r"\d")
    return plain(text) | ((bare != text) & plain(bare))


def formula_like(text: Column) -> Column:
    """A formula or a piece of one; a sentence has more than two long words."""
    t = F.trim(text)
    maths, letters, words, long = signs(t, f"{MATHS}+"), signs(t, r"\p{L}+"), _count(t, "[A-Za-z]{2,}"), _count(t, "[A-Za-z]{4,}")
    short = (F.length(t) <= 50) & ((t.rlike(FORMULA_HEAD) & (maths >= F.greatest(F.lit(2.0), letters * 0.4))) | ((words <= 1) & (maths / F.greatest(F.length(t), F.lit(1)) > 0.55)))
    anchored = (t.rlike(STRONG) | F.contains(t, F.lit("="))) & (maths >= 3) & (long <= 2)
    return (t != "") & (short | anchored | ((long == 0) & (maths >= 3) & (words <= 3)))


def mathish(text: Column, size: Column, flags: Column, body: Column) -> Column:
    """A superscript, a size far from the body's, or a short piece with a strong sign."""
    t = F.trim(text)
    off = (body > 0) & (F.abs(size - body) > body * 0.25)
    sign = t.rlike(GREEK) & (_count(t, "[A-Za-z]") <= 2) & (F.length(t) <= 12)
    return (t != "") & (is_superscript(flags) | off | sign)


def attachable(text: Column) -> Column:
    t = F.trim(text)
    return (t != "") & (F.length(t) <= 4) & ~t.rlike("[A-Za-z]{2,}")


def bullet(text: Column) -> Column:
    t = F.trim(text)
    return (F.length(t) <= 2) & t.rlike(BULLET)


def label(text: Column) -> Column:
    return F.trim(text).rlike(LABEL)
