"""Problem 8: sentence boundaries, by a maximum-entropy classifier over candidate boundaries.

Blank lines, list items and (in Thai) blanks settle themselves. Every other place after a mark that may end a sentence is
a candidate, which the classifier judges by the token before it, its case, length, digits and script, the marks and
closing quotes themselves, and the token after. It is trained on reliable boundaries of a bounded sample: ends of
paragraphs, with the start of the next paragraph as what follows, against places where the text visibly goes on, and
against tokens that stand before a mark often but never at the end of a paragraph.
"""

from __future__ import annotations

import collections
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import sampling

#: Most texts the classifier is trained on.
SAMPLE = 5_000
#: A token seen so often before a mark, and never at the end of a paragraph, does not end sentences.
OFTEN = 40

# Abbreviations that a name, a number or the rest of the sentence follows.
ABBREVIATIONS = frozenset(
    """
    dr mr mrs ms prof st mt sr sra dra sig dott prof.ssa mme mlle m gen col capt lt sgt rev hon no nos vol fig figs sec ch
    pp p pag pág art cf vs viz approx aprox env ca bzw ok np tj ul nr abb s z.b e.g i.e p.ex avda av núm n.º bd rue tel
    jan feb mar apr jun jul aug sep sept oct nov dec г ул д кв рис стр см т.е тыс чел им гл κ κα π.χ σελ डॉ श्री ดร พ.ศ د
    """.split()
)

# Month names, in the languages whose ordinal numbers take a full stop.
MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())

_END = r"[.!?…。！？｡؟۔।॥]+"
_CLOSERS = "”’\"')]}»›」』）】〉》"
_BLANK_LINE = re.compile(r"\r?\n(?:[^\S\n]*\r?\n)+")
_LINE = re.compile(r"[^\n]*\n?")
_BULLET = re.compile(r"[^\S\n]*(?:([•▪‣·*◦-])|(\d{1,3})[.)])[^\S\n]+(?=\S)")
_THAI_BLANK = re.compile(r"(?<=[ก-๛])[\d.,%]*(\s+)(?=\S)")
_TOKEN = re.compile(rf"({_END})|[“„”«»‹›‘’\"()\[\]{{}}「」『』（）【】]")
_LETTERS = re.compile(r"\w+")
_BEFORE = re.compile(r"[^\s“„”«»‹›‘\"()\[\]{}「」『』（）【】,;:—–]+$")
_PAIRS = {"“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’", "(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "【": "】"}
_CLOSING = frozenset(_PAIRS.values())
_OPENERS = "“„«‹‘([{「『（【¿¡"


@dataclass(frozen=True)
class Model:
    """weights by feature; finals: for tokens seen often, how they stand to ends of paragraphs."""

    weights: dict[str, float]
    finals: dict[str, str]


@dataclass
class Candidate:
    """A place where a sentence may end. ``end`` follows the closing marks; ``inside``: within quotes or brackets that
    opened in mid-sentence; ``mid``: the closing marks close such quotes or brackets."""

    start: int
    end: int
    token: str
    marks: str
    closers: str
    space: str
    following: str
    inside: bool
    mid: bool = False


def _cjk(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "豈" <= c <= "﫿" or "ｦ" <= c <= "ﾟ"


def kind(word: str) -> str:
    """What a following token starts with."""
    c = word[:1]
    if not c:
        return "end"
    if _cjk(c):
        return "cjk"
    if "฀" <= c <= "๿":
        return "thai"
    if c.isupper():
        return "month" if _LETTERS.match(word).group() in MONTHS else "upper"
    if c.islower():
        return "camel" if len(word) > 2 and word[1].isupper() and word[2].islower() else "lower"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "caseless"
    if c in _OPENERS or c == '"':
        inner = word.lstrip(_OPENERS + '"')
        return "open-lower" if inner[:1].islower() and kind(inner) == "lower" else "open"
    if c in ",;:" or c in "،؛，、；：":
        return "comma"
    if c in "—–-":
        rest = kind(word[1:].lstrip())
        return "dash-open" if rest in ("upper", "open", "cjk", "caseless", "camel") else "dash"
    return "other"


def shape(token: str) -> str:
    bare = token.strip(".")
    if not bare:
        return "none"
    if any(x.isdigit() for x in bare) and not any(x.isalpha() for x in bare):
        return f"number{min(len(bare), 3)}"
    if len(bare) == 1:
        return "initial" if bare.isupper() else "letter"
    if "." in bare:
        return "dotted"
    return ("title" if bare[0].isupper() else "word") + str(min(len(bare), 5))


def segments(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, item) of what a blank line or a list item's own line separates."""
    out, at = [], 0
    for m in [*_BLANK_LINE.finditer(text), None]:
        end = m.start() if m else len(text)
        if "\n" in text[at:end] or _BULLET.match(text, at, end):
            out += _lines(text, at, end)
        elif end > at:
            out.append((at, end, False))
        at = m.end() if m else end
    return out


def _lines(text: str, low: int, high: int) -> list[tuple[int, int, bool]]:
    """A block divided at list items: bullets next to other items or first in the block, numbers counting on."""
    starts = [m.start() for m in _LINE.finditer(text, low, high) if m.end() > m.start()]
    marks = [_BULLET.match(text, s, high) for s in starts]
    labels = [(m[1] or int(m[2])) if m else None for m in marks]
    nexts = [None] * len(labels)  # the label of the next line that has one
    for i in range(len(labels) - 2, -1, -1):
        nexts[i] = nexts[i + 1] if labels[i + 1] is None else labels[i + 1]
    written = re.compile(r"\S").search(text, low, high)
    first = written.start() if written else high
    out, begin, item, last = [], low, False, None
    for i, (s, m) in enumerate(zip(starts, marks)):
        label = labels[i]
        if m:
            alone, after = i == 0 or s <= first, nexts[i]
            if m[1]:
                good = alone or last == label or after == label or label in "•▪‣◦"
            else:
                good = last == label - 1 if isinstance(last, int) else alone or after == label + 1
            label = label if good else None
        if label is not None:
            if s > begin:
                out.append((begin, s, item))
            begin, item, last = s, True, label
    out.append((begin, high, item))
    return out


def candidates(text: str, low: int, high: int) -> list[Candidate]:
    """Candidates of one segment, in order. Marks within numbers, addresses and the like are none."""
    out: list[Candidate] = []
    stack: list[tuple[str, bool]] = []  # the mark that closes, and whether it opened in mid-sentence
    waiting: collections.Counter = collections.Counter()  # closing marks on the stack
    enclosing = 0  # those on the stack that opened in mid-sentence
    last_at: dict[str, int] = {}  # where a mark stands last in the segment
    begun, seen = False, low  # whether the stretch since the last candidate has begun, and up to where that was looked at

    def close(mark: str) -> bool:
        nonlocal enclosing
        while True:
            top, middle = stack.pop()
            waiting[top] -= 1
            enclosing -= middle
            if top == mark:
                return middle

    at = low
    while m := _TOKEN.search(text, at, high):
        at = m.end()
        c = m.group()
        if m[1] is None:
            if c == '"' or c == "’" or c == "“" or c in _CLOSING:
                before = text[m.start() - 1 : m.start()]
                if waiting[c]:
                    close(c)
                    continue
                if c != "“" and not (c == '"' and (not before.strip() or before in _OPENERS)):
                    continue
            wanted = _PAIRS.get(c, c)
            if wanted not in last_at:
                last_at[wanted] = text.rfind(wanted, low, high)
            if last_at[wanted] >= at:
                begun = begun or bool(text[seen : m.start()].strip())
                seen = m.start()
                stack.append((wanted, begun))
                waiting[wanted] += 1
                enclosing += begun
            continue
        end, mid = at, False
        # closing marks belong to the sentence they close
        while end < high:
            ch = text[end]
            if ch in _CLOSERS or ch == "“":
                expected = waiting[ch] > 0
                if not expected and (ch == "“" or ch in "’'\"" and text[end + 1 : end + 2].isalnum()):
                    break
                if expected:
                    mid = close(ch) or mid
                end += 1
            elif ch in " \u00a0\u202f" and text[end + 1 : end + 2] in ("»", "›") and waiting[text[end + 1]] > 0:
                mid = close(text[end + 1]) or mid
                end += 2
            else:
                break
        at = end
        rest = end
        while rest < high and text[rest].isspace():
            rest += 1
        following = text[rest : min(high, rest + 14)]
        marks = m.group()
        if rest == end and following and end == m.end():
            # no blank and no closing mark: only a following capital, ideograph or opening mark is a candidate
            k = kind(following)
            if marks == "." and following[1:2] == "." and following[0].isupper():
                continue  # initials written together
            if marks[-1] in ".!?…" and k not in ("upper", "month", "cjk", "open", "camel", "thai", "open-lower"):
                continue
        before = _BEFORE.search(text, max(low, m.start() - 40), m.start())
        token = before.group() if before else ""
        space = "none" if rest == end else "blank"
        inside = enclosing > 0
        out.append(Candidate(m.start(), end, token, marks, text[m.end() : end].strip(), space, following, inside, mid))
        begun, seen = False, end
    return out


def _marks(marks: str) -> str:
    if set(marks) <= {".", "…"} and (len(marks) > 1 or marks == "…"):
        return "…" if marks != "……" else "……"
    if set(marks) <= {"!", "?"} or marks[0] in "!?":
        return marks[0]
    return marks[0]


def _key(c: Candidate) -> str:
    """What is counted against ends of paragraphs: the token before a full stop, or marks and closers together."""
    if c.marks == "." and not c.closers:
        s = shape(c.token)
        return s if s in ("initial", "letter", "none") or s.startswith("number") else "w:" + c.token.lower()
    return f"m:{_marks(c.marks)}{c.closers}"


def features(c: Candidate, finals: dict[str, str]) -> list[str]:
    k, t, s = kind(c.following), _marks(c.marks), shape(c.token)
    final = finals.get(_key(c), "unknown")
    word = c.token.lower() if t == "." else ""
    rare = "w:" + word not in finals
    listed = word.strip(".") in ABBREVIATIONS if t == "." and not c.closers else False
    return [
        "1", f"t={t}", f"k={k}", f"t={t}&k={k}", f"c={c.closers}&k={k}", f"s={s}&k={k}&t={t}&sp={c.space}", f"f={final}", f"f={final}&k={k}",
        f"sp={c.space}&k={k}&t={t}", f"l={listed}", f"l={listed}&k={k}", f"l={listed}&f={final}", f"w={'' if rare else word}", f"w={'' if rare else word}&k={k}", f"m={c.mid}&k={k}",
    ]


def _paragraphs(text: str) -> list[list[Candidate]]:
    return [candidates(text, a, b) for a, b, item in segments(text) if not item]


def _minimum(loss: Callable, w: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton descent with step halving."""
    value, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, alphas = g.copy(), []
        for step, change, rho in reversed(past):
            alphas.append(rho * (step @ d))
            d -= alphas[-1] * change
        if past:
            step, change, rho = past[-1]
            d *= 1 / (rho * (change @ change))
        for (step, change, rho), alpha in zip(past, reversed(alphas)):
            d += (alpha - rho * (change @ d)) * step
        size, slope = (1.0 if past else 1 / max(1.0, float(np.abs(g).sum()))), g @ d
        while True:
            v = w - size * d
            new, h = loss(v)
            if new <= value - 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        step, change = v - w, h - g
        if value - new < 1e-7 * max(1.0, abs(value)):
            return v
        if step @ change > 1e-12:
            past = [*past[-memory + 1 :], (step, change, 1 / (step @ change))]
        w, value, g = v, new, h
    return w


def train(texts: list[str], rounds: int = 150, ridge: float = 0.02) -> Model:
    """Weights from reliable boundaries of the texts. Without any text only the listed abbreviations speak."""
    seen, ends = collections.Counter(), collections.Counter()
    examples: list[tuple[Candidate, bool | None]] = []
    for text in texts:
        parts = [(a, b, candidates(text, a, b)) for a, b, item in segments(text) if not item and text[a:b].strip()]
        for i, (_, b, found) in enumerate(parts):
            for j, c in enumerate(found):
                if c.inside:
                    continue
                k = kind(c.following)
                if k == "end":
                    if j < len(found) - 1 or i + 1 == len(parts):
                        ends[_key(c)] += 1
                        continue
                    a, stop, _ = parts[i + 1]
                    nxt = text[a:stop].lstrip()[:14]
                    wide = _cjk(nxt[:1]) or c.marks[-1] in "。！？"
                    ends[_key(c)] += 1
                    examples.append((Candidate(c.start, c.end, c.token, c.marks, c.closers, "none" if wide else "blank", nxt, False, c.mid), True))
                elif k in ("lower", "comma", "dash", "open-lower"):
                    examples.append((c, False))
                else:
                    seen[_key(c)] += 1
                    examples.append((c, None))
    finals = {}
    for key in seen | ends:
        if seen[key] + ends[key] >= 10:
            finals[key] = "some" if ends[key] else "never" if seen[key] >= OFTEN else "rarely"
    rows: collections.Counter = collections.Counter()
    for c, label in examples:
        if label is None:
            if finals.get(_key(c)) != "never":
                continue
            label = False
        rows[(tuple(features(c, finals)), label)] += 1
    # the listed abbreviations, before capitals and numbers, and the plainest ends of all
    for word in sorted(ABBREVIATIONS):
        for nxt in ("Xx", "7"):
            rows[(tuple(features(Candidate(0, 0, word, ".", "", "blank", nxt, False), finals)), False)] += 2
    for word in ("7", "12"):
        rows[(tuple(features(Candidate(0, 0, word, ".", "", "blank", "Mai", False), finals)), False)] += 200
    for word, space in (("A", "none"), ("A.B", "none"), ("Ph", "none")):
        rows[(tuple(features(Candidate(0, 0, word, ".", "", space, "X", False), finals)), False)] += 200
    for word in ("A", "b"):
        rows[(tuple(features(Candidate(0, 0, word, ".", "", "blank", "Xx", False), finals)), False)] += 200
    for mark in "。？！":
        for closer in "”」』":
            rows[(tuple(features(Candidate(0, 0, "", mark, closer, "none", "一", False), finals)), False)] += 200
    for closer in ")]”»":
        for nxt in ("xx", ","):
            rows[(tuple(features(Candidate(0, 0, "words", ".", closer, "blank", nxt, False, True), finals)), False)] += 200
    for mark, nxt, space in ((".", "Xx", "blank"), ("!", "Xx", "blank"), ("?", "Xx", "blank"), ("…", "Xx", "blank"), (".", "7", "blank"), ("。", "一", "none"), ("！", "一", "none"), ("？", "一", "none"), ("।", "क", "blank"), ("؟", "ا", "blank"), (".", "ا", "blank"), (".", "一", "none"), ("?", "一", "none"), ("!", "Xx", "none"), ("?", "Xx", "none"), (".", "“X", "blank"), (".", "eXx", "blank"), (".", "Xx", "none"), (".", "—Xx", "blank")):
        for token in ("two", "four", "words", "Four", "Words") if mark == "." else ("words",):
            rows[(tuple(features(Candidate(0, 0, token, mark, "", space, nxt, False), finals)), True)] += 200
    names = {f: i for i, f in enumerate(sorted({f for fs, _ in rows for f in fs}))}
    x = np.array([[names[f] for f in fs] for fs, _ in rows])
    y = np.array([label for _, label in rows], dtype=np.float64)
    n = np.sqrt(np.array(list(rows.values()), dtype=np.float64))  # templates repeat; their weight grows slower than they do

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = w[x].sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        g = np.bincount(x.ravel(), weights=np.repeat((p - y) * n, x.shape[1]), minlength=len(names)) + ridge * w
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + ridge * (w @ w) / 2), g

    w = _minimum(loss, np.zeros(len(names)), rounds)
    return Model({f: float(w[i]) for f, i in names.items()}, finals)


class Splitter:
    """Sentences of texts; judgements on like contexts are remembered."""

    def __init__(self, model: Model, limit: int = 300_000) -> None:
        self.model = model
        self.known: dict[tuple, bool] = {}
        self.limit = limit

    def ends(self, c: Candidate) -> bool:
        if c.inside or c.following == "" and c.space == "none":
            return not c.inside
        k = kind(c.following)
        key = (c.token, c.marks, c.closers, c.space, k, c.mid)
        found = self.known.get(key)
        if found is None:
            if len(self.known) > self.limit:
                self.known.clear()
            weights = self.model.weights
            found = self.known[key] = sum(weights.get(f, 0.0) for f in features(c, self.model.finals)) > 0
        return found

    def split(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of every sentence, without white space at either end."""
        out = []
        for low, high, item in segments(text):
            cuts = [] if item else [c.end for c in candidates(text, low, high) if self.ends(c)]
            if not item:
                cuts += [m.start(1) for m in _THAI_BLANK.finditer(text, low, high)]
            a = low
            for b in [*sorted(set(cuts)), high]:
                start, end = a, b
                while start < end and text[start].isspace():
                    start += 1
                while end > start and text[end - 1].isspace():
                    end -= 1
                if start < end:
                    out.append((start, end))
                a = b
        return out


def _split(model) -> Callable:
    cache: list[Splitter] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(Splitter(model.value))
        for batch in batches:
            ids, starts, ends = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in cache[0].split(text) if text else ():
                    ids.append(doc)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "start_pos", "end_pos"])

    return run


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """A classifier from at most ``sample`` non-empty texts, the same ones on every run."""
    return train(sampling.texts(documents, "text", "doc_id", sample))


def sentences(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, start_pos, end_pos: one row for each sentence of documents(doc_id, text), in code points from 0.

    Null, empty and blank texts give no row. One pass without a shuffle; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") > 0)
    return rows.mapInArrow(_split(shared), "doc_id bigint, start_pos int, end_pos int")
