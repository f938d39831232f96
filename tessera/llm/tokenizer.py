"""Problem 6: encoding a corpus with a public byte-level tokenizer.

Texts are encoded in Arrow batches, in one reading and without a shuffle. Longer ones are cut into pieces, which threads of
the task encode in parallel (the tokenizer works outside the interpreter's lock). A cut before a single blank between two
non-blanks is one where the tokenizer always divides. Where a stretch offers none, it is cut in the middle and the two
encodings are joined by tree concatenation: a window of tokens around the join is encoded again, and grows until its first
and last tokens equal those of both sides. Two adjacent tokens of a byte-pair encoding are valid in any context or in
none, so agreement at both ends makes the result that of the whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts with more characters than this are cut, into pieces of about this size.
PIECE = 1 << 14
#: Pieces of one text that are encoded at once.
THREADS = 4
#: Tokens from which what is ready of a batch goes out.
BATCH_TOKENS = 1 << 21
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how the tokenizer divides a text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoding(ranks_path: str = DEFAULT_RANKS):
    """The tokenizer, loaded once a worker. Strings that look like special tokens are ordinary text."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("tessera", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, ranks_path: str = DEFAULT_RANKS) -> np.ndarray:
    return encoding(ranks_path).encode_to_numpy(text, disallowed_special=())


def cuts(text: str, piece: int = PIECE) -> list[tuple[int, bool]]:
    """Where to cut a text, and whether the join needs a window. Every piece has at least one and at most ``piece`` characters."""
    out, at = [], 0
    while len(text) - at > piece:
        low, high = at + piece // 2, at + piece
        found = None
        for m in _SAFE.finditer(text, low, high):
            found = m.start()
        out.append((high if found is None else found, found is None))
        at = out[-1][0]
    return out


def join(left: np.ndarray, right: np.ndarray, ranks_path: str = DEFAULT_RANKS, width: int = 8) -> np.ndarray:
    """The encoding of two adjacent texts from their own encodings."""
    codec = encoding(ranks_path)

    def whole(tokens: np.ndarray) -> str | None:
        try:
            return codec.decode_bytes(tokens.tolist()).decode("utf-8")
        except UnicodeDecodeError:
            return None

    while True:
        a, b = left[-width:], right[:width]
        all_left, all_right = width >= len(left), width >= len(right)
        text = whole(np.concatenate([a, b]))
        if text is not None:  # else the window starts or ends within a character
            middle = codec.encode_to_numpy(text, disallowed_special=())
            starts = all_left or (len(middle) > 1 and (middle[:2] == a[:2]).all() if len(a) > 1 else False)
            ends = all_right or (len(middle) > 1 and (middle[-2:] == b[-2:]).all() if len(b) > 1 else False)
            if starts and ends:
                return np.concatenate([left[: len(left) - len(a)], middle, right[len(b) :]])
        width *= 2


def concatenate(pieces: list[np.ndarray], soft: list[bool], ranks_path: str = DEFAULT_RANKS) -> np.ndarray:
    """Joins neighbours pairwise in rounds. ``soft[i]`` tells whether the cut before piece i needs a window."""
    pieces, soft = list(pieces), list(soft)
    while len(pieces) > 1:
        merged, kept = [], []
        for i in range(0, len(pieces), 2):
            pair = pieces[i : i + 2]
            if len(pair) == 1:
                merged.append(pair[0])
            else:
                merged.append(join(*pair, ranks_path) if soft[i + 1] else np.concatenate(pair))
            kept.append(soft[i])
        pieces, soft = merged, kept
    return pieces[0] if pieces else np.empty(0, dtype=np.uint32)


def _id_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode_long(text: str, ranks_path: str = DEFAULT_RANKS, piece: int = PIECE, pool: ThreadPoolExecutor | None = None) -> np.ndarray:
    """The encoding of a text of any length, equal to that of the whole at once."""
    if len(text) <= piece:
        return encode(text, ranks_path)
    where = cuts(text, piece)
    edges = [0, *(p for p, _ in where), len(text)]
    parts = (text[a:b] for a, b in zip(edges, edges[1:]))
    coded = (pool.map if pool else map)(lambda part: encode(part, ranks_path), parts)
    return concatenate(list(coded), [False, *(s for _, s in where)], ranks_path)


def _over_texts(shape: Callable[[list[np.ndarray]], pa.Array], name: str, ranks_path: str, piece: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(THREADS) as pool:
            for batch in batches:
                ids: list[np.ndarray] = []
                at, held = 0, 0
                for i, text in enumerate(batch.column(1).to_pylist()):
                    ids.append(encode_long(text, ranks_path, piece, pool) if text else np.empty(0, dtype=np.uint32))
                    held += len(ids[-1])
                    if held > BATCH_TOKENS or i == batch.num_rows - 1:  # a batch of long texts goes out in parts
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), shape(ids)], names=["doc_id", name])
                        ids, at, held = [], i + 1, 0

    return run


def token_ids(documents: DataFrame, ranks_path: str = DEFAULT_RANKS, piece: int = PIECE) -> DataFrame:
    """doc_id, ids of every row of documents(doc_id, text), without special tokens. doc_id must be unique.

    Null and empty texts give an empty list; blanks, ends of lines and strings that look like special tokens are text
    like any other. Other columns are ignored.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_over_texts(_id_lists, "ids", ranks_path, piece), "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, ranks_path: str = DEFAULT_RANKS, piece: int = PIECE) -> DataFrame:
    """doc_id, n_tokens: the lengths of ``token_ids``, with only the lengths leaving Python."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lengths = lambda ids: pa.array([len(i) for i in ids], pa.int32())
    return rows.mapInArrow(_over_texts(lengths, "n_tokens", ranks_path, piece), "doc_id bigint, n_tokens int")
