"""Bounded, repeatable samples to fit models on. Counts and statistics of a result never come from here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30
#: Most characters of a sample; texts of more than an eighth of it are not chosen, since they would crowd out the rest.
CHARACTERS = 1 << 24


def texts(rows: DataFrame, text: str, order: str, n: int, characters: int = CHARACTERS) -> list[str]:
    """At most n non-empty texts of at most ``characters`` together, those with the smallest hash of ``order`` and text: the
    same on every run.

    A threshold on the hash, from the number of rows, leaves about three times n rows before the order is looked at, so
    what is gathered does not grow with the table. Lengths come first, and only the texts they leave room for follow.
    """
    total = rows.count()
    size = F.length(text)
    hashed = rows.select(F.col(text).alias("t"), F.pmod(F.xxhash64(order, text), F.lit(_STEPS)).alias("h"), size.alias("n"))
    chosen = hashed.filter((F.col("n") > 0) & (F.col("n") <= max(1, characters // 8)))
    if total > 3 * n:
        chosen = chosen.filter(F.col("h") < int(_STEPS * 3 * n / total))
    last, room = -1, characters
    for row in chosen.select("h", "n").orderBy("h", "n").limit(n).collect():
        room -= row["n"]
        if room < 0:
            break
        last = row["h"]
    found = chosen.filter(F.col("h") <= last).select("h", "t").collect()
    return [t for _, t in sorted((r["h"], r["t"]) for r in found)][:n]
