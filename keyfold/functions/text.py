"""Text expressions: cleaning, tokens, stop words, padding. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------
NO_DESCRIPTION = "без описания"
BAD_TEXT = "name error"
SYMBOLS = "[!@#$_“”¨«»®´·º½¾¿¡§£₤‘’]"
VOCABULARY_FILTER = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
SEQUENCE_LENGTH = 300
VOCABULARY_CAP = 100_000

# White space as Python's str.split sees it: the Unicode class and the four separator controls.
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(text: str | Column) -> Column:
    """Collapse runs of white space to one blank and strip both ends."""
    return F.trim(F.regexp_replace(_column(text), _SPACE, " "))


def title_description(title: str | Column = "title", description: str | Column = "description") -> Column:
    """Both texts with a blank between; if either is NULL, the whole is the default text."""
    return F.coalesce(F.concat(_column(title), F.lit(" "), _column(description)), F.lit(NO_DESCRIPTION))


def clean(text: str | Column) -> Column:
    """Lower-case, delete symbols, squeeze white space; a NULL becomes the fallback text."""
    stripped = F.regexp_replace(F.lower(_column(text).cast("string")), SYMBOLS, "")
    return F.coalesce(squeeze(stripped), F.lit(BAD_TEXT))


def words(text: str | Column) -> Column:
    """White-space separated words; an empty text has none."""
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


def vocabulary_words(text: str | Column) -> Column:
    """Words as the vocabulary sees them: lower case, filtered punctuation acts as a separator."""
    spaced = F.translate(F.lower(_column(text)), VOCABULARY_FILTER, " " * len(VOCABULARY_FILTER))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def remove_stopwords(text: str | Column, stopwords: Sequence[str]) -> Column:
    kept = F.filter(words(text), lambda w: ~w.isin(list(stopwords)))
    return F.array_join(kept, " ")


def pad_front(sequence: str | Column, length: int, value: int | float = 0) -> Column:
    """Fixed-length array: zeros in front of a short sequence, the last values of a long one."""
    padding = F.array_repeat(F.lit(value), length)
    return F.slice(F.concat(padding, _column(sequence)), -length, length)
