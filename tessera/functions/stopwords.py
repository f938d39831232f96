"""Stop words: a short built-in list of English function words, and readers for longer lists."""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import Path

# English function words. A longer list is a parameter (``read_stop_words``).
ENGLISH = frozenset(
    """
    a about above after again against all am an and any are as at be because been before being below between both but
    by can cannot could did do does doing down during each few for from further had has have having he her here hers
    herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once
    only or other ought our ours ourselves out over own same she should so some such than that the their theirs them
    themselves then there these they this those through to too under until up very was we were what when where which
    while who whom why will with would you your yours yourself yourselves
    """.split()
)

_MATCHABLE = re.compile(r"[a-z0-9]+")


def merge_stop_words(*lists: Iterable[str]) -> list[str]:
    """Union of lists in code point order, without entries that no cleaned token can equal."""
    return sorted({w for words in lists for w in (x.strip().lower() for x in words) if _MATCHABLE.fullmatch(w)})


def read_stop_words(*paths: str | Path) -> list[str]:
    """One word a line; several files are merged."""
    return merge_stop_words(*(Path(p).read_text(encoding="utf-8").splitlines() for p in paths))
