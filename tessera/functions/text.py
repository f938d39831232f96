"""Text cleaning and tokenising as native column expressions (no Python in the row path)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cleaning patterns, which decide every result. The order of the alternatives matters: punctuation
# goes before user names and links, so "@user" leaves "user", while "#tag" goes as a whole.
NON_ASCII = r"[^\x00-\x7F]+"
NOISE = r"<[^>]+>|#\w+|[^\w\s]|_|@\w+|https*://\S+|www.\S+"
SPACES = r"\s+"

MAX_TERM = 30


def clean(text: Column) -> Column:
    """Lower case, ASCII only, markup and punctuation blanked, spaces collapsed. Null gives null."""
    return F.trim(F.regexp_replace(_without_noise(text), SPACES, " "))


def _without_noise(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), NON_ASCII, " "), NOISE, " ")


def tokens(text: Column, stop_words: Sequence[str] | None = None, stem: bool = False) -> Column:
    """Array of cleaned tokens. Null and blank texts give an empty array.

    Stop words go before stemming. Only ``stem`` needs Python (one Arrow call a batch).
    """
    # the words of the cleaned text, without collapsing its spaces first
    out = F.filter(F.split(F.coalesce(_without_noise(text), F.lit("")), SPACES), lambda t: t != "")
    if stop_words:
        out = F.filter(out, lambda t: ~t.isin(sorted(set(stop_words))))
    if stem:
        from tessera.functions.stemmer import stem_tokens

        out = stem_tokens(out)
    return out


def token_count(text: Column) -> Column:
    """Words between single spaces of a cleaned text; 0 for null and blank."""
    return F.size(tokens(text))


def index_term(term: Column) -> Column:
    """Terms are stored cut to 30 characters."""
    return F.substring(term, 1, MAX_TERM)


def parse_posting(text: Column) -> Column:
    """``"doc:tf"`` to a struct; malformed strings give null fields."""
    parts = F.split(text, ":")
    return F.struct(
        parts[0].try_cast("long").alias("doc_id"),
        F.get(parts, F.lit(1)).try_cast("int").alias("tf"),
    )
