"""Inline markers of a text: ``<b> <i> <sup>`` tags and ``{vN}`` placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How placeholders and tags are spelt.
HOLDER = r"\{v(\d+)\}"
TAG = r"</?(?:b|i|sup)>"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def placeholders(text: Column | str) -> Column:
    """The placeholders of a text, sorted as strings."""
    return F.array_sort(F.regexp_extract_all(_c(text), F.lit(HOLDER), F.lit(1)))


def squeezed(text: Column) -> Column:
    """Runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def strip(text: Column | str) -> Column:
    """The text without markers: tags leave nothing, a placeholder a blank."""
    return squeezed(F.regexp_replace(F.regexp_replace(_c(text), TAG, ""), HOLDER, " "))


def untranslated(vi: Column | str) -> Column:
    """Fewer characters above U+0100 than three or 2 % of the length; an empty text is untranslated."""
    bare = strip(vi)
    high = F.length(F.regexp_replace(bare, r"[\x{0000}-\x{0100}]", ""))
    return (F.length(bare) == 0) | (high < F.greatest(F.lit(3.0), F.length(bare) * 0.02))


def check(en: Column | str, vi: Column | str) -> Column:
    """The translation repaired, or null if it is empty or lost, gained or doubled a placeholder of its source.

    Escaped tags are restored.  Where the source has placeholders, bent ones such as ``( v1 )`` are straightened and
    the sorted lists must be equal; where it has none, invented ones go.  Tags that don't pair or that the source
    lacks go too."""
    source, text = _c(en), F.regexp_replace(_c(vi), r"&lt;(/?(?:b|i|sup))&gt;", "<$1>")
    held = placeholders(source)
    straight = F.regexp_replace(text, r"[{(\[（【]\s*[vV]\s*(\d+)\s*[})\]）】]", "{v$1}")
    text = F.when(F.size(held) > 0, straight).otherwise(F.regexp_replace(text, HOLDER, ""))
    bad = (F.size(held) > 0) & (placeholders(text) != held)
    for name in ("b", "i", "sup"):
        opened, closed = F.regexp_count(text, F.lit(f"<{name}>")), F.regexp_count(text, F.lit(f"</{name}>"))
        wrong = (opened != closed) | (opened > 0) & ~F.contains(source, F.lit(f"<{name}>"))
        text = F.when(wrong, F.regexp_replace(text, f"</?{name}>", "")).otherwise(text)
    text = squeezed(text)
    return F.when(bad | (text == ""), F.lit(None)).otherwise(text)
