"""Problem 4: text decoded in another encoding than it was written in, by a hidden Markov model.

One state stands for clean text and one for each encoding pair (written in, read as). A character is emitted given the
one before it; the tables of the clean state are counted on all sound texts, those of a pair on the same texts put through
that pair, by tasks. The best path (Viterbi) labels every character; each labelled span gets its state's inverse
transform, and a span that does not survive the inverse exactly is left as it is.

Pure ASCII emits alike in all states, so texts without other characters are clean without a look, and a text is clean
without a search where even the largest gains any state could draw from it do not pay for entering one.
"""

from __future__ import annotations

import collections
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import cut, release

#: Texts of a source, and of them in capitals, that its counts over all its texts are scaled to; characters of lines rich in
#: characters beyond ASCII that those of the other states are scaled to.
MASS, CAPITALS, SHARE = 2_000, 200, 400_000
#: Scaled counts from which a pair or a word is known, and from which a pair has its own row.
OFTEN, LEAST = 0.5, 0.25
#: Characters of a piece.
PIECE = 1024

# The encoding pairs (written in, read as, how often in turn).
PAIRS = (
    ("utf-8", "latin-1", 1), ("utf-8", "cp1252", 1), ("utf-8", "cp1250", 1), ("utf-8", "cp1251", 1), ("utf-8", "cp1253", 1),
    ("utf-8", "cp1254", 1), ("utf-8", "cp1256", 1), ("utf-8", "cp437", 1), ("utf-8", "cp850", 1), ("utf-8", "cp852", 1),
    ("utf-8", "cp866", 1), ("utf-8", "koi8-r", 1), ("utf-8", "mac_roman", 1), ("utf-8", "cp874", 1), ("utf-8", "iso8859-2", 1),
    ("utf-8", "iso8859-7", 1), ("utf-8", "gbk", 1), ("utf-8", "cp932", 1), ("utf-8", "big5", 1), ("utf-8", "cp949", 1),
    ("utf-8", "latin-1", 2), ("utf-8", "cp1252", 2), ("utf-8", "cp1251", 2), ("utf-8", "cp1252", 3), ("utf-8", "latin-1", 3),
    ("cp1251", "cp1252", 1), ("cp1251", "latin-1", 1), ("cp1251", "koi8-r", 1), ("cp1251", "cp866", 1), ("koi8-r", "cp1251", 1),
    ("koi8-r", "cp1252", 1), ("koi8-r", "latin-1", 1), ("koi8-r", "cp866", 1), ("cp866", "cp1251", 1), ("cp866", "cp1252", 1),
    ("cp866", "latin-1", 1), ("cp866", "koi8-r", 1), ("iso8859-5", "cp1251", 1), ("cp1252", "cp850", 1), ("cp1252", "cp437", 1),
    ("cp1252", "cp1251", 1), ("cp1252", "cp1250", 1), ("cp1252", "mac_roman", 1), ("cp1252", "cp1253", 1), ("cp1252", "cp852", 1),
    ("cp850", "cp1252", 1), ("cp850", "latin-1", 1), ("cp437", "cp1252", 1), ("mac_roman", "cp1252", 1), ("mac_roman", "latin-1", 1),
    ("cp1250", "cp1252", 1), ("cp1250", "latin-1", 1), ("iso8859-2", "cp1252", 1), ("iso8859-2", "latin-1", 1), ("iso8859-2", "cp1250", 1),
    ("cp1250", "iso8859-2", 1), ("cp1250", "cp852", 1), ("cp852", "cp1250", 1), ("cp1253", "cp1252", 1), ("cp1253", "latin-1", 1),
    ("cp1256", "cp1252", 1), ("cp1256", "latin-1", 1), ("cp874", "cp1252", 1), ("cp874", "latin-1", 1), ("gbk", "cp1252", 1),
    ("gbk", "latin-1", 1), ("cp932", "cp1252", 1), ("cp932", "latin-1", 1), ("euc_jp", "cp1252", 1), ("euc_jp", "latin-1", 1),
    ("big5", "latin-1", 1), ("big5", "cp1252", 1), ("gbk", "cp932", 1), ("cp932", "gbk", 1), ("euc_jp", "gbk", 1), ("euc_jp", "cp932", 1),
)

Pair = tuple[str, str, int]

#: Replacement characters, whose original is lost.
LOST = "�"
_WIDE = ("gbk", "cp932", "big5", "cp949", "euc_jp")
_BLOCKS = (
    (0x80, 0x700), (0x900, 0x980), (0xE00, 0xE80), (0x2000, 0x2070), (0x20A0, 0x20C0), (0x2100, 0x2150), (0x2190, 0x2400),
    (0x2500, 0x2600), (0x3000, 0x3100), (0xF8FF, 0xF900), (0xFB00, 0xFB07), (0xFF00, 0xFFF0),
)
_SPECIAL = {0xFFFD: 5, 0xFEFF: 6}
COMMON, RARE, OTHER, EDGE = 7, 8, 9, 10
_LOST = re.compile(LOST)
_WORD = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[^\x00-\x7F]+")
_CUT = re.compile(rb"(?<=[\xc2-\xf4]) |(?<=[\xe0-\xf4][\x80-\xbf]) ")
_FIRST = 11
_CLASS = {c: "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " " if c.isspace() else "." for c in map(chr, range(128))}

#: Characters that are labelled at once; longer texts take several windows and give the same path.
WINDOW = 1 << 14

ENTER, LEAVE = 10.0, 4.0
#: What a repaired span must gain in clean log likelihood.
MARGIN = 4.0
#: Least share of its characters that sound texts must have shown after the same neighbour.
KNOWN = 0.75


@lru_cache(maxsize=None)
def _table(codec: str) -> tuple[str, ...]:
    """Characters of the 256 bytes; undefined bytes stay control characters, as lenient readers leave them."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@lru_cache(maxsize=None)
def _back(codec: str) -> dict[int, int]:
    return {ord(c): b for b, c in reversed(list(enumerate(_table(codec)))) if len(c) == 1}


def garble(text: str, pair: Pair) -> str:
    """What a reader in the wrong encoding sees; characters the first encoding lacks are dropped."""
    written, read, times = pair
    for _ in range(times):
        data = text.encode(written, "ignore")
        text = data.decode(read, "replace") if read in _WIDE else data.decode("latin-1").translate(dict(enumerate(_table(read))))
    return text


def restore(text: str, pair: Pair) -> str | None:
    """The text as first written, or null where the way back is not exact. A plain blank within a UTF-8 sequence, where it
    cannot be, is taken for the no-break space that white-space cleaning made it from."""
    written, read, times = pair
    try:
        for _ in range(times):
            if read in _WIDE:
                data = text.encode(read)
            else:
                back = _back(read)
                data = bytes(back[ord(c)] for c in text)
            if written == "utf-8":
                data = _CUT.sub(b"\xa0", data)
            text = data.decode(written)
    except (UnicodeError, KeyError):
        return None
    return text


@lru_cache(maxsize=2)
def _symbols(known: str) -> np.ndarray:
    """Symbol of every code point: ASCII classes, single characters of small scripts, and frequent or other ideographs."""
    out = np.full(0x110000, OTHER, dtype=np.int16)
    for c in range(128):
        ch = chr(c)
        out[c] = 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 3 if ch.isspace() else 4
    at = _FIRST
    for low, high in _BLOCKS:
        out[low:high] = np.arange(at, at + high - low)
        at += high - low
    out[0x3400:0xA000] = RARE
    out[0xAC00:0xD7B0] = RARE
    out[0xE000:0xF8FF] = OTHER
    out[0xF900:0xFB00] = RARE
    for ch in known:
        if out[ord(ch)] == RARE:
            out[ord(ch)] = COMMON
    for c, s in _SPECIAL.items():
        out[c] = s
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@dataclass(frozen=True)
class Model:
    """symbols by code point; keys: known pairs of symbols, sorted; gains: log odds against the clean state, by known pair
    and state; single: the same by symbol, for unknown pairs; clean, clean_single: log probabilities of the clean state;
    known: whether sound texts hold the pair; enter: what entering each state costs; words: those of sound texts that are
    not ASCII, in lower case."""

    symbols: np.ndarray
    keys: np.ndarray
    gains: np.ndarray
    single: np.ndarray
    clean: np.ndarray
    clean_single: np.ndarray
    known: np.ndarray
    enter: np.ndarray
    words: frozenset[str]
    pairs: tuple[Pair, ...]

    @property
    def size(self) -> int:
        return self.single.shape[0]


Table = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Counts:
    """symbols by code point; states: what each encoding pair makes of sound texts, as single symbols, keys of pairs of
    symbols, and how often these occur; clean: the same of the sound texts; words: those that are not ASCII."""

    symbols: np.ndarray
    states: tuple[Table, ...]
    pairs: tuple[Pair, ...]
    clean: Table
    words: frozenset[str]


def _observed(texts: list[str]) -> pa.RecordBatch:
    """What the tables need of sound texts, as rows of (kind, value, rich, plain) that are summed up: pieces are runs of
    characters beyond ASCII between the classes of their neighbours, counted by whether their line is rich in such
    characters; then words, ideographs and totals."""
    found: dict[tuple[str, str], list[int]] = collections.defaultdict(lambda: [0, 0])
    words: collections.Counter[str] = collections.Counter()
    lines: tuple[list[str], list[str]] = ([], [])
    for text in texts:
        if not text or LOST in text:
            continue
        found["total", "texts"][0] += 1
        for line in [text] if text.isascii() else text.split("\n"):
            if line.isascii():
                lines[1].append(line)
                continue
            runs = list(_ODD.finditer(line))
            side = int(sum(m.end() - m.start() for m in runs) * 20 <= len(line))
            lines[side].append(line)
            words.update(w.lower() for w in _WORD.findall(line) if not w.isascii())
            for m in runs:
                start, end = m.span()
                around = _CLASS[line[start - 1]] if start else " ", _CLASS[line[end]] if end < len(line) else " "
                for i in range(start, end, PIECE):  # the parts of a very long run share a character
                    piece = (around[0] if i == start else "") + line[i : min(end, i + PIECE + 1)] + (around[1] if i + PIECE >= end else "")
                    found["piece", piece][side] += 1
    for side in (0, 1):
        s = _symbols("")[code_points("\n".join([*lines[side], ""]))]
        for symbol, n in enumerate(np.bincount(s, minlength=5)[:5]):
            found["total", str(symbol)][side] += int(n)
        found["total", "characters"][side] += len(s)
        for c, n in collections.Counter("".join("".join(_ODD.findall(x)) for x in lines[side])).items():
            if _symbols("")[ord(c)] == RARE:
                found["ideograph", c][side] += n
    for word, n in words.items():
        found["word", word][0] += n
    return pa.RecordBatch.from_pydict(
        {"kind": [k for k, _ in found], "value": [v for _, v in found], "rich": [n for n, _ in found.values()], "plain": [n for _, n in found.values()]},
        schema=pa.schema([("kind", pa.string()), ("value", pa.string()), ("rich", pa.int64()), ("plain", pa.int64())]),
    )


@dataclass(frozen=True)
class Weights:
    """What an occurrence counts: in the clean state, there in capitals (which keep capital letters within words from looking
    strange), in the other states on lines rich in characters beyond ASCII, on others, and in capitals; alike: by how much less what reads alike in both encodings, since lines rich in such
    characters have a larger share there than in the clean state and it would seem to speak for damage."""

    clean: float
    capitals: float
    rich: float
    plain: float
    capitals_there: float
    alike: float


def _weights(totals: dict[str, tuple[int, int]], mass: int) -> Weights:
    """Every text counts; larger collections are scaled to the mass that the smoothing and the costs were settled at."""
    texts, (rich, plain) = max(1, totals.get("texts", (0, 0))[0]), totals.get("characters", (0, 0))
    capitals = min(1.0, CAPITALS / texts)
    share = lambda most, n: min(1.0, most / max(1.0, n))
    a, b, c = share(SHARE, rich), share(SHARE / 2, plain), capitals * share(SHARE / 4, (rich + plain) * capitals)
    alike = min(1.0, (a * rich + b * plain + c * (rich + plain)) / max(1.0, a * (rich + plain)))
    return Weights(min(1.0, mass / texts), capitals, a, b, c, alike)


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(at, np.concatenate(n), minlength=len(every))


def _keyed(symbols: np.ndarray, pieces: list[str], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of symbols within pieces, and single symbols beyond ASCII as -1 - symbol, with their weights."""
    code = code_points("\n".join(pieces))
    s, each = symbols[code].astype(np.int64), weight[np.cumsum(code == 10)]
    pair = np.flatnonzero(((s[:-1] > 4) | (s[1:] > 4)) & (code[:-1] != 10) & (code[1:] != 10))
    one = np.flatnonzero(s > 4)
    return _summed([s[pair] * (int(symbols.max()) + 1) + s[pair + 1], -1 - s[one]], [each[pair], each[one]])


class _Neighbours:
    """Characters of pieces and pairs of neighbours, with their weights: all that is needed where each character is read by
    itself."""

    def __init__(self, symbols: np.ndarray, pieces: list[str], weight: np.ndarray) -> None:
        code = code_points("\n".join(pieces))
        each = weight[np.cumsum(code == 10)]
        chars, at = np.unique(code, return_inverse=True)
        inside = np.flatnonzero((code[:-1] != 10) & (code[1:] != 10))
        pair, self.n = _summed([at[inside] * len(chars) + at[inside + 1]], [each[inside]])
        self.before, self.after = np.divmod(pair, max(1, len(chars)))
        self.chars, self.one, self.symbols = [chr(c) for c in chars], np.bincount(at, each, minlength=len(chars)), symbols
        self.line = self.chars.index("\n") if "\n" in self.chars else -1

    def read(self, pair: Pair, alike: float) -> tuple[np.ndarray, np.ndarray]:
        """As ``_keyed`` of what the pair makes of the pieces; characters the first encoding lacks give nothing."""
        own = [c for i, c in enumerate(self.chars) if i != self.line]
        read = garble("\n".join(own), pair).split("\n")
        read = read if len(read) == len(own) else [garble(c, pair) for c in own]
        if self.line >= 0:
            read.insert(self.line, "")
        same = np.array([x == c and not c.isascii() for x, c in zip(read, self.chars)])
        keys, n = self._keys(read, self.one * np.where(same, alike, 1.0), self.n * np.where(same[self.before] | same[self.after], alike, 1.0))
        if pair[0] == "utf-8":  # after white-space cleaning
            blank = np.array(["\xa0" in x for x in read])
            more, m = self._keys([x.replace("\xa0", " ") for x in read], self.one * blank / 4, self.n * (blank[self.before] | blank[self.after]) / 4)
            keys, n = keys + more, n + m
        return _summed(keys, n)

    def _keys(self, read: list[str], one: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        size, there = int(self.symbols.max()) + 1, np.array([bool(x) for x in read])
        edge = lambda i: self.symbols[[ord(x[i]) if x else 0 for x in read]].astype(np.int64)
        first, last = edge(0)[self.after], edge(-1)[self.before]
        met = there[self.before] & there[self.after] & ((first > 4) | (last > 4)) & (n > 0)
        s = self.symbols[code_points("".join(read))].astype(np.int64)
        of = np.repeat(np.arange(len(read)), [len(x) for x in read])
        within = np.flatnonzero((of[:-1] == of[1:]) & ((s[:-1] > 4) | (s[1:] > 4)))
        odd = np.flatnonzero(s > 4)
        return [last[met] * size + first[met], s[within] * size + s[within + 1], -1 - s[odd]], [n[met], one[of[within]], one[of[odd]]]


def _tabled(symbols: np.ndarray, pairs: tuple[Pair, ...], w: Weights, batch: pa.RecordBatch, states: bool) -> pa.RecordBatch:
    """state (-1 for clean), key, n of some pieces."""
    own = batch.column(0).to_pylist()
    rich, plain = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False), dtype=np.float64) for i in (1, 2))
    pieces = own + [x.upper() for x in own]
    parts = [(-1, *_keyed(symbols, pieces, np.concatenate([(rich + plain) * w.clean, (rich + plain) * w.capitals])))] if own else []
    weight = np.concatenate([rich * w.rich + plain * w.plain, (rich + plain) * w.capitals_there])
    neighbours = _Neighbours(symbols, pieces, weight) if states and own else None
    for state, pair in enumerate(pairs if neighbours else ()):
        if pair[1] not in _WIDE:
            parts.append((state, *neighbours.read(pair, w.alike)))
            continue
        # how a character is read depends on those before it
        read, each = pieces, weight
        if pair[0] != "utf-8":
            beyond = ["".join(_ODD.findall(x)) for x in pieces]
            at = [i for i, o in enumerate(beyond) if len(o.encode(pair[0], "ignore").decode(pair[0], "ignore")) == len(o)]
            read, each = [pieces[i] for i in at], weight[at]
        made = garble("\n".join(read), pair).split("\n")
        made = made if len(made) == len(read) else [garble(x, pair).replace("\n", " ") for x in read]
        if pair[0] == "utf-8":
            blank = [i for i, x in enumerate(made) if "\xa0" in x]
            made, each = made + [made[i].replace("\xa0", " ") for i in blank], np.concatenate([each, each[blank] / 4])
        if read:
            parts.append((state, *_keyed(symbols, made, each)))
    columns = zip(*((np.full(len(k), state, np.int32), k, n) for state, k, n in parts)) if parts else [np.zeros(0, t) for t in (np.int32, np.int64, np.float64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if parts else c) for c in columns], names=["state", "key", "n"])


def _gathered(rows: pa.Table, state: int, size: int, ascii_: np.ndarray) -> Table:
    keys, n = (rows[c].to_numpy()[rows["state"].to_numpy() == state] for c in ("key", "n"))
    one = np.zeros(size)
    one[:5] = ascii_
    one[-1 - keys[keys < 0]] = n[keys < 0]
    order = np.argsort(keys[keys >= 0])
    return one, keys[keys >= 0][order], n[keys >= 0][order]


def _ascii(totals: dict[str, tuple[int, int]], rich: float, plain: float, capitals: float) -> np.ndarray:
    """Weights of the five classes of ASCII characters."""
    n = np.array([totals.get(str(i), (0, 0)) for i in range(5)], dtype=np.float64)
    upper = n.sum(axis=1)
    upper[1], upper[0] = upper[0] + upper[1], 0
    return n @ [rich, plain] + upper * capitals


def _counts(symbols: np.ndarray, totals: dict, w: Weights, rows: pa.Table, words: frozenset[str], pairs: tuple[Pair, ...]) -> Counts:
    size = int(symbols.max()) + 1
    there = _ascii(totals, w.rich, w.plain, w.capitals_there)
    states = tuple(_gathered(rows, i, size, there) for i in range(len(pairs)))
    return Counts(symbols, states, pairs, _gathered(rows, -1, size, _ascii(totals, w.clean, w.clean, w.capitals)), words)


def fit(texts: list[str], pairs: tuple[Pair, ...] = PAIRS) -> Model:
    """A model from sound texts at hand."""
    seen = pa.Table.from_batches([_observed(texts)])
    of = lambda kind: [r for r in seen.to_pylist() if r["kind"] == kind]
    totals = {r["value"]: (r["rich"], r["plain"]) for r in of("total")}
    w = _weights(totals, MASS)
    symbols = _symbols("".join(r["value"] for r in of("ideograph") if (r["rich"] + r["plain"]) * w.clean >= 1.5))
    batch = pa.RecordBatch.from_pylist([{k: r[k] for k in ("value", "rich", "plain")} for r in of("piece")], schema=pa.schema([("value", pa.string()), ("rich", pa.int64()), ("plain", pa.int64())]))
    rows = pa.Table.from_batches([_tabled(symbols, pairs, w, batch, True)])
    words = frozenset(r["value"] for r in of("word") if r["rich"] * w.clean >= OFTEN)
    return _model(_counts(symbols, totals, w, rows.filter(pc.greater_equal(rows["n"], LEAST)), words, pairs))


def _model(counts: Counts, seen: dict[Pair, int] | None = None, weight: float = 2.0) -> Model:
    """The model of counts. ``seen`` counts spans of each pair in labelled texts, from which the costs of entering a state
    follow."""
    tables, size = [counts.clean, *counts.states], int(counts.symbols.max()) + 1
    all_keys = np.unique(np.concatenate([[0], *(t[1] for t in tables)]).astype(np.int64))  # never without a row
    single, gains = np.empty((size, len(tables))), np.empty((len(all_keys), len(tables)))
    for i, (one, keys, n) in enumerate(tables):
        floor = 0.3 if i == 0 else 1e-4
        u = (one + floor) / (one.sum() + floor * size)
        prev = np.bincount(keys // size, weights=n, minlength=size)
        prev[:5] = one[:5]
        cells = np.zeros(len(all_keys))
        cells[np.searchsorted(all_keys, keys)] = n
        gains[:, i] = np.log((cells + weight * u[all_keys % size]) / (prev[all_keys // size] + weight))
        single[:, i] = np.log(u)
    # replacement characters are told by themselves, not by a state
    gains[(all_keys % size == 5) | (all_keys // size == 5)] = 0
    single[5] = 0
    known = np.isin(all_keys, tables[0][1][tables[0][2] >= OFTEN]) & (all_keys % size != RARE) & (all_keys // size != RARE)
    found = np.array([(seen or {}).get(p, 0) for p in counts.pairs], dtype=np.float64) + 0.3
    enter = ENTER - np.log(found / found.mean()) / 2 if seen else np.full(len(found), ENTER)
    f = lambda x: x.astype(np.float32)
    return Model(counts.symbols, all_keys, f(gains[:, 1:] - gains[:, :1]), f(single[:, 1:] - single[:, :1]), f(gains[:, 0]), f(single[:, 0]), known, f(enter), counts.words, counts.pairs)


class Labeller:
    """Viterbi over batches of texts."""

    def __init__(self, model: Model) -> None:
        self.model = model
        k = model.size
        self.rows = np.full(k * k, -1, dtype=np.int32)
        self.rows[model.keys] = np.arange(len(model.keys), dtype=np.int32)
        self.least = float(model.enter.min())
        self.most = np.maximum(model.gains.max(axis=1), 0)
        self.most_single = np.maximum(model.single.max(axis=1), 0)

    def _gain(self, key: np.ndarray) -> np.ndarray:
        row = self.rows[key]
        out = self.model.gains[row]
        unknown = row < 0
        if unknown.any():
            out[unknown] = self.model.single[key[unknown] % self.model.size]
        return out

    def steps(self, text: str, before: int = 3) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions whose emission differs between states (a character beyond ASCII, or the one after it), their pairs,
        and the last symbol. ``before``: the symbol before the text."""
        s = self.model.symbols[code_points(text)].astype(np.int64)
        previous = np.concatenate([[before], s[:-1]])
        where = np.flatnonzero((s > 4) | (previous > 4))
        return where, previous[where] * self.model.size + s[where], int(s[-1]) if len(s) else before

    def windows(self, text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(start, positions, pairs) of stretches of bounded length, as ``steps`` of the whole text would give them."""
        last = 3
        for start in range(0, len(text), WINDOW):
            where, key, last = self.steps(text[start : start + WINDOW], last)
            yield start, where, key

    def label(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text the spans (start, end, state) that are not clean. State -1 is that of lost characters: it alone emits
        the replacement character, and nothing else, so every path takes it there and only there."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        todo = []
        for i, text in enumerate(texts):
            if not text or text.isascii():
                continue
            bound, first = 0.0, None
            for start, where, key in self.windows(text):
                row = self.rows[key]
                bound += float(np.where(row >= 0, self.most[row], self.most_single[key % self.model.size]).sum())
                first = (i, where, key) if start == 0 else first
            if bound > self.least:
                if len(text) <= WINDOW:
                    todo.append(first)
                else:
                    out[i].extend(self._search_long(text))
            out[i].extend((m.start(), m.end(), -1) for m in _LOST.finditer(text))
        todo.sort(key=lambda x: len(x[1]))
        at = 0
        while at < len(todo):
            # texts of like length together, within bounded memory
            n = max(1, min(64, 400_000 // max(1, len(todo[min(at + 63, len(todo) - 1)][1]))))
            group = todo[at : at + n]
            at += n
            self._search(group, out)
        return out

    def _forward(self, key: np.ndarray, value: np.ndarray, clean: np.float32) -> tuple[np.ndarray, np.float32, np.ndarray, np.ndarray]:
        """Viterbi over one stretch of one text from given scores: scores at its end, and for each step which states were
        entered from clean and which state clean text came from (or -1)."""
        came, left = np.zeros((len(key), len(value)), dtype=bool), np.full(len(key), -1, dtype=np.int16)
        for t, gain in enumerate(self._gain(key)):
            best = int(value.argmax())
            top = value[best] - np.float32(LEAVE)
            enter = clean - self.model.enter
            came[t] = enter > value
            value = np.where(came[t], enter, value) + gain
            if top > clean:
                left[t], clean = best, top
        return value, clean, came, left

    def _search_long(self, text: str) -> list[tuple[int, int, int]]:
        """The best path of a text of any length in bounded memory: scores are kept where windows meet, and the windows are
        gone through again from the last to the first, each with its own way back."""
        value, clean = np.full(len(self.model.pairs), -np.inf, dtype=np.float32), np.float32(0)
        kept = []
        for start, _, key in self.windows(text):
            kept.append((start, value, clean, int(self.model.symbols[ord(text[start - 1])]) if start else 3))
            value, clean = self._forward(key, value, clean)[:2]
        state, end = int(value.argmax()), None
        state = state if value[state] > clean else -1
        spans = []
        later: int | None = None  # the position of the step after, where clean text may have come from a state
        for start, value, clean, before in reversed(kept):
            where, key, _ = self.steps(text[start : start + WINDOW], before)
            _, _, came, left = self._forward(key, value, clean)
            for t in range(len(key) - 1, -1, -1):
                here = start + int(where[t])
                if later is not None:  # left at the step after this one
                    end, later = here + 1, None
                if state < 0:
                    if left[t] >= 0:
                        state, later = int(left[t]), here
                    continue
                if end is None:
                    end = here + 1
                if came[t, state]:
                    spans.append((here, end, state))
                    state, end = -1, None
        return spans[::-1]

    def _search(self, group: list, out: list) -> None:
        longest = max(len(w) for _, w, _ in group)
        states = len(self.model.pairs)
        n = len(group)
        clean = np.zeros(n, dtype=np.float32)
        value = np.full((n, states), -np.inf, dtype=np.float32)
        came = np.zeros((longest, n, states), dtype=bool)  # entered from clean at this step
        left = np.full((longest, n), -1, dtype=np.int16)  # the state clean text came from, or -1
        keys = np.zeros((longest, n), dtype=np.int64)
        lengths = np.array([len(w) for _, w, _ in group])
        for j, (_, w, key) in enumerate(group):
            keys[: len(w), j] = key
        for t in range(longest):
            gain = self._gain(keys[t])
            best = value.argmax(axis=1)
            top = value[np.arange(n), best] - LEAVE
            enter = clean[:, None] - self.model.enter
            entered = enter > value
            value = np.where(entered, enter, value) + gain
            came[t] = entered
            leave = top > clean
            left[t] = np.where(leave, best, -1)
            clean = np.where(leave, top, clean)
            if t + 1 in lengths:
                for j in np.flatnonzero(lengths == t + 1):
                    state = int(value[j].argmax())
                    self._trace(group[j], j, t, state if value[j, state] > clean[j] else -1, came, left, out)

    def _trace(self, item: tuple, j: int, t: int, state: int, came: np.ndarray, left: np.ndarray, out: list) -> None:
        i, where, _ = item
        end = None
        spans = []
        while t >= 0:
            if state < 0:
                if left[t, j] >= 0:
                    state, end = int(left[t, j]), int(where[t - 1]) + 1 if t else None
                t -= 1
                continue
            if end is None:
                end = int(where[t]) + 1
            if came[t, j, state]:
                spans.append((int(where[t]), end, state))
                state, end = -1, None
            t -= 1
        out[i].extend(spans[::-1])


    def likelihood(self, text: str) -> tuple[float, float]:
        """Clean log likelihood of the characters that tell states apart, and the share of them known after their neighbour."""
        value, known, n = 0.0, 0, 0
        for _, _, key in self.windows(text):
            row = self.rows[key]
            value += float(np.where(row >= 0, self.model.clean[row], self.model.clean_single[key % self.model.size]).sum())
            known += int(((row >= 0) & self.model.known[row]).sum())
            n += len(key)
        return value, known / n if n else 1.0

    def stands(self, text: str, a: int, b: int, state: int, original: str, was: float) -> bool:
        """Whether an exact original is believable. Bytes that happen to be sound UTF-8 are proof enough; other encodings
        read anything as something, so a span of few different characters must give words that sound texts have."""
        pair = self.model.pairs[state]
        before, after = text[max(0, a - 2) : a], text[b : b + 3]
        value, known = self.likelihood(before + original + after)
        if value - was < MARGIN:
            return False
        if pair[0] == "utf-8":
            return True
        if known < KNOWN:
            return False
        distinct = len({c for c in text[a:b] if not c.isascii()})
        if distinct > 2 or pair[0] in _WIDE:
            return distinct > 2
        low = max(0, a - 40)
        around = text[low:a] + original + text[b : b + 40]
        start, end = a - low, a - low + len(original)
        touched = [m.group().lower() for m in _WORD.finditer(around) if m.start() < end and m.end() > start and not m.group().isascii()]
        familiar = [w in self.model.words for w in touched]
        return known == 1.0 and all(familiar) or distinct == 2 and any(familiar)

    def _rivals(self, text: str, state: int, most: int = 8) -> list[int]:
        """The state, then others by what they gain from the text."""
        total = sum(self._gain(key).sum(axis=0) for _, _, key in self.windows(text))
        return [state, *(int(s) for s in np.argsort(-total)[:most] if s != state)]

    def checked(self, text: str, span: tuple[int, int, int]) -> tuple[int, int, int, str | None] | None:
        """The span with its original. The original is null where it is lost or not exactly restorable; no span comes
        back where undoing the damage would not make the text more likely. The span's own state is tried first, then
        those that fit it next best, each also over adjoining characters its wrong encoding could have given."""
        a, b, state = span
        while a < b and text[a].isascii():
            a += 1
        while b > a and text[b - 1].isascii():
            b -= 1
        if a == b:
            return None
        if state < 0:
            return a, b, state, None
        for s in self._rivals(text[a:b], state):
            low, high = self._widened(text, a, b, s)
            for x, y in dict.fromkeys([(a, b), (low, high)]):
                was, _ = self.likelihood(text[max(0, x - 2) : y + 3])
                # a second byte of a wide encoding may be ASCII, and a no-break space may have become a blank
                more = y < len(text) and (self.model.pairs[s][0] in _WIDE or self.model.pairs[s][0] == "utf-8" and text[y] == " ")
                for end in (y, y + 1) if more else (y,):
                    original = restore(text[x:end], self.model.pairs[s])
                    if original is not None and self.stands(text, x, end, s, original, was):
                        return x, end, s, original
        if restore(text[a:b], self.model.pairs[state]) is not None or len(set("".join(_ODD.findall(text[a:b])))) < 3:
            return None
        partly, kept = salvage(text[a:b], self.model.pairs[state])
        before, after = text[max(0, a - 2) : a], text[b : b + 3]
        value, known = self.likelihood(before + partly + after)
        was, _ = self.likelihood(before + text[a:b] + after)
        if kept >= 0.5 and value - was >= MARGIN and known >= KNOWN and _alike(text[a:b], partly) < 0.5:
            return a, b, state, None
        return None

    def _widened(self, text: str, a: int, b: int, state: int) -> tuple[int, int]:
        read = self.model.pairs[state][1]
        if read in _WIDE:
            fits = lambda c: not c.isascii() and c != LOST
        else:
            back = _back(read)
            fits = lambda c: not c.isascii() and ord(c) in back
        while a > 0 and fits(text[a - 1]):
            a -= 1
        while b < len(text) and fits(text[b]):
            b += 1
        return a, b

    def damage(self, texts: list[str], labels: list[list[tuple[int, int, int]]] | None = None) -> list[list[tuple[int, int, int, str | None]]]:
        """For each text its checked spans, in order and without overlaps. Spans a few characters apart are first taken
        as one, then each by itself."""
        out = []
        for text, spans in zip(texts, self.label(texts) if labels is None else labels):
            good, at = [], 0
            groups: list[list[tuple[int, int, int]]] = []
            for span in sorted(spans):
                if groups and span[2] >= 0 and groups[-1][-1][2] >= 0 and span[0] - groups[-1][-1][1] <= 3:
                    groups[-1].append(span)
                else:
                    groups.append([span])
            for group in groups:
                longest = max(group, key=lambda x: x[1] - x[0])
                whole = (group[0][0], group[-1][1], longest[2])
                first = self.checked(text, whole) if whole[0] >= at else None
                if first and (first[3] is not None or len(group) == 1):
                    found = [first]
                else:
                    found = [x for x in (self.checked(text, s) for s in group if s[0] >= at) if x] if len(group) > 1 else []
                    found = found or ([first] if first else [])
                for x in found:
                    if x[0] >= at:
                        good.append(x)
                        at = x[1]
            out.append(good)
        return out


def _alike(text: str, other: str) -> float:
    """Share of the characters beyond ASCII that the other text has, too."""
    odd, there = "".join(_ODD.findall(text)), set(other)
    return sum(c in there for c in odd) / max(1, len(odd))


def salvage(text: str, pair: Pair) -> tuple[str, float]:
    """What is left of the original when undecodable bytes are dropped, and the share of bytes that were decodable."""
    written, read, times = pair
    kept = 1.0
    for _ in range(times):
        if read in _WIDE:
            data = text.encode(read, "ignore")
        else:
            back = _back(read)
            data = bytes(back[ord(c)] for c in text if ord(c) in back)
        if not data:
            return "", 0.0
        text = data.decode(written, "ignore")
        beyond = lambda b: sum(x > 127 for x in b)
        kept *= beyond(text.encode(written, "ignore")) / max(1, beyond(data))
    return text, kept


def repaired(text: str, spans: list[tuple[int, int, int, str | None]]) -> tuple[str, bool]:
    """The text with its spans put right, and whether all of them could be."""
    out, at = [], 0
    for a, b, _, original in spans:
        out += [text[at:a], text[a:b] if original is None else original]
        at = b
    return "".join([*out, text[at:]]), all(x[3] is not None for x in spans)


_SEEN = "kind string, value string, rich bigint, plain bigint"


def _observing(model=None) -> Callable:
    """Observations of the texts of a task. With a model only of those in which no span stands the check, and besides how
    often each pair was found."""
    cache: list[Labeller] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is not None and not cache:
            cache.append(Labeller(model.value))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if cache:
                labels = cache[0].label(texts)
                spans, pairs = cache[0].damage(texts, labels), cache[0].model.pairs
                # long stretches that were labelled but did not stand the check may be damage of another kind: neither clean nor seen
                doubtful = [any(len({c for c in t[a:b] if not c.isascii()}) > 5 and restore(t[a:b], pairs[s]) != t[a:b] for a, b, s in x if s >= 0) for t, x in zip(texts, labels)]
                seen = collections.Counter(str(s[2]) for x in spans for s in x if s[2] >= 0)
                texts = [t for t, s, d in zip(texts, spans, doubtful) if not s and not d]
                n = len(seen)
                yield pa.RecordBatch.from_arrays([pa.array(["pair"] * n, pa.string()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([0] * n, pa.int64())], names=["kind", "value", "rich", "plain"])
            for i in range(0, len(texts), 500):
                yield _observed(texts[i : i + 500])

    return run


def _tabling(shared, states: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 5_000):
                yield _tabled(*shared.value, batch.slice(i, 5_000), states)

    return run


def _source(rows: DataFrame, text: str, mass: int, base: Counts | None, model: Model | None, pairs: tuple[Pair, ...]) -> tuple[Counts, dict[Pair, float]]:
    """Counts over all texts of a source, and how often each pair was found there, scaled alike. What comes to the driver are totals, ideographs, and
    words and pairs of symbols frequent enough to count, whose number the mass bounds."""
    send = rows.sparkSession.sparkContext.broadcast
    texts = rows.select(F.col(text).alias("text")).filter(F.length("text") > 0)
    found = texts.mapInArrow(_observing(None if model is None else send(model)), _SEEN)
    kept = cut(found.groupBy("kind", "value").agg(F.sum("rich").alias("rich"), F.sum("plain").alias("plain")))
    few = {(r["kind"], r["value"]): (r["rich"], r["plain"]) for r in kept.filter("kind IN ('total', 'pair')").collect()}
    totals = {v: n for (k, v), n in few.items() if k == "total"}
    w = _weights(totals, mass)
    often = lambda kind, least: [r["value"] for r in kept.filter((F.col("kind") == kind) & ((F.col("rich") + F.col("plain")) * F.lit(w.clean) >= least)).select("value").collect()]
    symbols = _symbols("".join(sorted(often("ideograph", 1.5)))) if base is None else base.symbols
    tabled = kept.filter("kind = 'piece'").select("value", "rich", "plain").mapInArrow(_tabling(send((symbols, pairs, w)), base is None), "state int, key bigint, n double")
    summed = tabled.groupBy("state", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST).toArrow()
    counts = _counts(symbols, totals, w, summed, frozenset(often("word", OFTEN)), pairs)
    release(kept)
    return counts, {pairs[int(v)]: n[0] * w.clean for (k, v), n in few.items() if k == "pair"}


def _with(counts: Counts, more: Counts) -> Counts:
    """The counts with a further source in the clean state."""
    (one, keys, n), (other, other_keys, m) = counts.clean, more.clean
    every, at = np.unique(np.concatenate([keys, other_keys]), return_inverse=True)
    return replace(counts, clean=(one + other, every, np.bincount(at, np.concatenate([n, m]), minlength=len(every))), words=counts.words | more.words)


def _labelled(model, restoring: bool) -> Callable:
    cache: list[Labeller] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(Labeller(model.value))
        labeller = cache[0]
        pairs = labeller.model.pairs
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows, names, fixed, sound = [], [], [], []
            for i, spans in enumerate(labeller.damage(texts)):
                if not spans:
                    continue
                rows.append(i)
                names.append(", ".join(dict.fromkeys("lost" if x[2] < 0 else "{}>{}x{}".format(*pairs[x[2]]) for x in spans)))
                text, whole = repaired(texts[i], spans) if restoring else (None, None)
                fixed.append(text)
                sound.append(whole)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(fixed, pa.string()), pa.array(sound, pa.bool_())],
                names=["key", "damage", "restored", "complete"],
            )

    return run


def train(sound: tuple[DataFrame, str, str], others: list[tuple[DataFrame, str, str]], mass: int = MASS) -> Model:
    """Tables counted on all sound texts, then with those texts of each other source in which no span stands the check as
    further clean ones, and the other states as frequent as found there. Sources are (rows, text column, key column)."""
    base, _ = _source(*sound[:2], mass, None, None, PAIRS)
    first, counts, seen = _model(base), base, collections.Counter()
    for rows, text, _ in others:
        more, found = _source(rows, text, mass, base, first, PAIRS)
        counts = _with(counts, more)
        seen.update(found)
    return _model(counts, dict(seen))


def damaged(records: DataFrame, key: str, text: str, model: Model, restoring: bool = True) -> DataFrame:
    """key, damage, restored, complete of every row whose text has a span that is not clean.

    ``damage`` names the encoding pairs found (``lost``: replacement characters), ``restored`` is the text with every
    span that can be put back exactly, ``complete`` tells whether all could. Null, empty and ASCII texts are clean.
    Repeated rows come out as often as they stand there. Other columns are ignored.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)
    rows = records.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    odd = rows.filter(F.col("text").rlike(r"[^\x00-\x7F]"))
    return odd.mapInArrow(_labelled(shared, restoring), "key string, damage string, restored string, complete boolean")
