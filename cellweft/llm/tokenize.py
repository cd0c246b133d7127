"""Byte-level BPE over a whole corpus with a public vocabulary.

Text is split by the vocabulary's pattern; each piece is encoded by a contiguous rank array: the boundaries of its parts and, for
each neighbouring two, the rank of their union. The smallest rank is found by a scan, its boundary deleted and the two ranks beside it
refreshed. Pieces repeat, so each worker keeps those it has met; long pieces (over ``SHORT`` bytes) use the same merges from a heap.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = 1 << 60
SHORT = 256
#: Pieces a worker remembers; beyond it the memory starts anew, with the same results.
KEEP = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 of the bytes and the rank on each line. The rank is the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def public_path(name: str) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def merge_short(b: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by scans over the rank array."""
    get = ranks.get
    at = list(range(len(b) + 1))
    near = [get(b[i:i + 2], NO_RANK) for i in range(len(b) - 1)]
    while near:
        least = min(near)
        if least == NO_RANK:
            break
        i = near.index(least)
        del at[i + 1], near[i]
        if i < len(near):
            near[i] = get(b[at[i]:at[i + 2]], NO_RANK)
        if i:
            near[i - 1] = get(b[at[i - 1]:at[i + 1]], NO_RANK)
    return [ranks[b[x:y]] for x, y in zip(at, at[1:])]


def merge_long(b: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges (smallest rank, leftmost first) with a heap and linked parts: n log n for a piece of n bytes."""
    n = len(b)
    get = ranks.get
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(b[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != e:
            continue  # one of the parts has changed since
        alive[j] = False
        end[i] = e
        if e < n:
            prev[e] = i
            if (r := get(b[i:end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if (h := prev[i]) >= 0 and (r := get(b[h:e])) is not None:
            heapq.heappush(heap, (r, h, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[b[i:end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts; special tokens in a text are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex

        self.ranks, self.split, self.known = ranks, regex.compile(pattern).findall, {}

    def piece(self, word: str) -> list[int]:
        b = word.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(b)
        if whole is not None:
            return [whole]
        return merge_short(b, self.ranks) if len(b) <= SHORT else merge_long(b, self.ranks)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, extend = self.known, out.extend
        for w in self.split(text):
            ids = known.get(w)
            if ids is None:
                ids = self.piece(w)
                if len(w) <= SHORT:
                    if len(known) >= KEEP:
                        known.clear()
                    known[w] = ids
            extend(ids)
        return out


_ENCODERS: dict[int, Encoder] = {}


def _on_workers(path: str, df: DataFrame) -> Callable[[], Encoder]:
    """An encoder per worker process. The vocabulary (under 1 MB) is read on the driver, so executors need no file."""
    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def encoder() -> Encoder:
        name = hash(shared.value)
        if name not in _ENCODERS:
            _ENCODERS[name] = Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())})
        return _ENCODERS[name]

    return encoder


def encoded(documents: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """(id_col, ids array<int>): the ids of every text; an empty or null text has an empty list. Row for row, no shuffle.

    ``path`` is a ``.tiktoken`` rank file, by default the public byte_bpe_50k. Repeated rows are encoded each.
    """
    encoder = _on_workers(path or public_path("byte_bpe_50k.tiktoken"), documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for b in batches:
            ids: list[int] = []
            ends = np.zeros(b.num_rows + 1, dtype=np.int32)
            for i, t in enumerate(b.column(1).to_pylist()):
                if t:
                    ids += enc.encode(t)
                ends[i + 1] = len(ids)
            flat = pa.array(np.array(ids, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], [id_col, "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decoded(ids: list[int], ranks: dict[bytes, int]) -> str:
    """The text of ids: the round trip of :meth:`Encoder.encode`."""
    back = {v: k for k, v in ranks.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "surrogatepass")
