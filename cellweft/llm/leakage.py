"""Held-out test passages inside a training corpus.

Greedy string tiling. Windows of ``min_words`` words of both sides are hashed by a rolling (Karp-Rabin) hash; windows with a hash in
common are seeds, joined on it. For each document and item with a seed, the longest common runs are marked again and again, none
overlapping another, so passages that were reordered or interrupted are all found; every run is compared word by word, so a chance
hash never counts. Coverage is the share of an item's words that lie in marked runs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.session import cut, fits_broadcast

#: Characters without a form of their own (soft hyphen, zero-width characters, joiners, byte order mark).
INVISIBLE = "­​‌‍‎‏⁠﻿"
_GONE = dict.fromkeys(map(ord, INVISIBLE))
_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Seeds up to this size are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def words_of(text: str | None) -> list[str]:
    """Words of a text: tags and invisible characters removed, then runs of letters and digits without case, accents or Unicode form.

    ß equals ss (by case folding). Null and empty texts have none.
    """
    if not text:
        return []
    t = _TAG.sub("", text).translate(_GONE)
    if not t.isascii():
        t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", t).casefold())
        t = "".join(c for c in t if not unicodedata.combining(c))
        return _WORD.findall(t)
    return _WORD.findall(t.lower())


_WORD_HASH: dict[str, int] = {}


def _word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    if len(_WORD_HASH) > 500_000:
        _WORD_HASH.clear()
    got = _WORD_HASH
    for w in set(words).difference(got):
        got[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter((got[w] for w in words), dtype=np.uint64, count=len(words))


#: Powers of the base and of its inverse modulo 2**64, as many as texts needed so far.
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        m = 1 << max(10, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
                steps = np.full(m, base, dtype=np.uint64)
                steps[0] = 1
                _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Karp-Rabin hashes of a text's windows of any length: running sums modulo 2**64, of which two give the hash of a window."""

    def __init__(self, words: list[str]) -> None:
        x = _word_hashes(words)
        up, self.down = _powers(len(x) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x * up[:len(x)], dtype=np.uint64)])

    def windows(self, n: int) -> np.ndarray:
        """Hashes of the windows of ``n`` words, as int64, in order."""
        k = len(self.sums) - n
        if k <= 0:
            return np.zeros(0, dtype=np.int64)
        with np.errstate(over="ignore"):
            h = (self.sums[n:] - self.sums[:k]) * self.down[:k]
            h ^= h >> np.uint64(29)
        return h.view(np.int64)


def window_hashes(words: list[str], n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` words, as int64; equal windows have equal hashes in every text."""
    return Rolling(words).windows(n) if len(words) >= n else np.zeros(0, dtype=np.int64)


def tiles(a: list[str], b: list[str], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: (start in a, start in b, length), longest first, no word of either side in two tiles.

    Each round finds the greatest length at which unmarked windows of both sides have a hash in common (by bisection, since a
    common run of a length holds common runs of all smaller ones), compares the windows word by word, and marks those of that length
    that do not overlap, from the start of a, each with the earliest place in b that is left. It ends when no run of ``least`` words is
    left. No list of matching pairs is made: of a word that both sides repeat n times only the windows are held. Rounds are
    at most the different lengths of tiles.
    """
    ha, hb = Rolling(a), Rolling(b)
    used_a, used_b = np.zeros(len(a) + 1, dtype=np.int64), np.zeros(len(b) + 1, dtype=np.int64)
    out: list[tuple[int, int, int]] = []

    def free(h: Rolling, marks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        w = h.windows(n)
        at = np.flatnonzero(marks[n:] == marks[:len(marks) - n]) if len(w) else np.zeros(0, dtype=np.int64)
        return at, w[at]

    def common(n: int) -> bool:
        return bool(np.isin(free(hb, used_b, n)[1], free(ha, used_a, n)[1]).any())

    low = min(len(a), len(b))
    while low >= least and common(least):
        lo, hi = least, low
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if common(mid) else (lo, mid - 1)
        n = low = lo
        ia, va = free(ha, used_a, n)
        ib, vb = free(hb, used_b, n)
        both = np.isin(va, vb)
        places: dict[int, list[int]] = {}
        for j, v in zip(ib[::-1].tolist(), vb[::-1].tolist()):
            places.setdefault(v, []).append(j)  # the earliest last
        mark_a, mark_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        end, made = -1, 0
        for i, v in zip(ia[both].tolist(), va[both].tolist()):
            if i < end:
                continue
            left = places[v]
            while left and mark_b[left[-1]:left[-1] + n].any():
                left.pop()
            if left and a[i:i + n] == b[left[-1]:left[-1] + n]:
                j = left.pop()
                mark_a[i:i + n], mark_b[j:j + n] = 1, 1
                out.append((i, j, n))
                end, made = i + n, made + 1
        if not made:
            low = n - 1  # hashes met by chance
        used_a[1:] += np.cumsum(mark_a)
        used_b[1:] += np.cumsum(mark_b)
    return out


def seed_table(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(h, item): hashes of every window of every test item, distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = [np.unique(window_hashes(words_of(t), n)) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs) if hs else np.zeros(0, dtype=np.int64)), b.column("i").take(pa.array(np.repeat(np.arange(len(hs)), [len(h) for h in hs])))], ["h", "item"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"h long, item {kind}").distinct()


def _seeded(docs: DataFrame, hashes: DataFrame, n: int) -> DataFrame:
    """(doc, h): windows of documents whose hash some test item has; a broadcast set filters where the set is small."""
    kind = docs.schema["doc"].dataType.simpleString()
    small = fits_broadcast(hashes, BROADCAST_BYTES)
    known = docs.sparkSession.sparkContext.broadcast(np.unique(hashes.toPandas()["h"].to_numpy(dtype=np.int64))) if small else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = known.value if known is not None else None
        for b in batches:
            at, hs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for i, t in enumerate(b.column("t").to_pylist()):
                h = np.unique(window_hashes(words_of(t), n))
                if only is not None and len(h):
                    h = h[only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h] if len(only) else h[:0]
                at.append(np.full(len(h), i)), hs.append(h)
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(np.concatenate(at))), pa.array(np.concatenate(hs))], ["doc", "h"])

    return docs.mapInArrow(run, f"doc {kind}, h long")


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", min_words: int = 12, min_coverage: float = 0.0) -> DataFrame:
    """(doc, item, n_tiles, longest, words, coverage) of every document and test item that share a run of ``min_words`` words.

    ``words`` are the item's words in tiles and ``coverage`` their share; pairs under ``min_coverage`` are left out. Null and
    empty texts share nothing. Items of fewer than ``min_words`` words cannot be found. Ids must be unique on either side.
    """
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("t")).where("t IS NOT NULL AND t <> ''")
    seeds = cut(seed_table(items, item_id, text, min_words))
    # A window that very many documents repeat is reduced to one row a document and item here, before any text moves.
    pairs = _seeded(docs, seeds.select("h").distinct(), min_words).join(seeds, "h").select("doc", "item").distinct()
    texts = items.select(F.col(item_id).alias("item"), F.col(text).alias("it"))
    cand = cut(pairs)
    with_text = cand.join(docs, "doc").join(texts, "item")
    dk, ik = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[object, list[str]] = {}
        for b in batches:
            rows = []
            last: tuple[object, list[str]] = (None, [])
            for i, (d, it, t, x) in enumerate(zip(b.column("doc").to_pylist(), b.column("item").to_pylist(), b.column("t").to_pylist(), b.column("it").to_pylist())):
                if last[0] != d:
                    last = (d, words_of(t))
                if it not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[it] = words_of(x)
                found = tiles(last[1], known[it], min_words)
                if found:
                    n = sum(f[2] for f in found)
                    rows.append((i, len(found), max(f[2] for f in found), n, n / len(known[it])))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc").take(at), b.column("item").take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.float64())],
                                             ["doc", "item", "n_tiles", "longest", "words", "coverage"])

    out = with_text.select("doc", "item", "t", "it").mapInArrow(run, f"doc {dk}, item {ik}, n_tiles int, longest int, words int, coverage double")
    return out.where(F.col("coverage") >= min_coverage)
