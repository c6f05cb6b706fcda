"""Text preparation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a cut may end on, those trimmed off after it, and the white space that counts.
SENTENCE_ENDS = ".!?…"
SOFT_ENDS = " ,;:\"')]}"
TRIMMED = " ,;:"
#: Unicode white space, as a Java character class.
SPACE = r"[\u0009-\u000d\u001c- \u0085   -     　]"


def normalize_whitespace(text: Column) -> Column:
    """Runs of white space become one blank; none is left at the ends."""
    return F.btrim(F.regexp_replace(text, SPACE + "+", " "))


def embed_text(title: Column, text: Column) -> Column:
    """What is embedded of a document: title, full stop, text. Null where either is null."""
    return F.concat(title, F.lit(". "), text)


def default_url(url: Column) -> Column:
    return F.coalesce(url, F.lit(""))


def long_enough(text: Column, min_chars: int) -> Column:
    """At least ``min_chars`` code points once white space is normalized; false for null."""
    return F.coalesce(F.length(normalize_whitespace(text)) >= min_chars, F.lit(False))


def trim_snippet(text: Column, max_chars: int = 500, already_cut: bool | Column = False) -> Column:
    """A snippet of at most ``max_chars`` that ends cleanly.

    Shorter texts stay as they are; so do texts of exactly that length that weren't
    cut before. Otherwise the cut keeps a sentence end, or goes back to a word
    boundary in its last two fifths, loses trailing separators and gets an
    ellipsis. Negative sizes count as 0. Null stays null.
    """
    m = max(max_chars, 0)
    cut_before = F.lit(already_cut) if isinstance(already_cut, bool) else already_cut
    whole = (F.length(text) < m) | ((F.length(text) == m) & ~cut_before)
    cut = F.regexp_replace(F.substring(text, 1, m), SPACE + r"+\z", "") if m else F.substring(text, 1, 0)
    last = F.substring(cut, -1, 1)
    clean = (F.length(cut) == 0) | last.isin(*SENTENCE_ENDS)
    back = F.length(cut) - F.locate(" ", F.reverse(cut))  # 0-based place of the last blank
    at_word = F.when(~last.isin(*SOFT_ENDS) & (F.locate(" ", cut) > 0) & (back > 0.6 * m), cut.substr(F.lit(1), back)).otherwise(cut)
    bare = F.regexp_replace(at_word, r"[ ,;:]+\z", "")
    short = F.when(F.length(bare) > m - 1, bare.substr(F.lit(1), F.lit(max(m - 1, 0)))).otherwise(bare)
    return F.when(whole, text).when(clean, cut).otherwise(F.concat(short, F.lit("…")))


def radius_norm(score: Column, low: Column, high: Column, inverted: bool) -> Column:
    """Min-max norm of a score for display: 0.35 where all are alike; inverted for similarities."""
    span = high - low
    x = (score - low) / F.when(span < 1e-6, F.lit(None)).otherwise(span)
    return F.when(span < 1e-6, F.lit(0.35)).otherwise(1 - x if inverted else x)
