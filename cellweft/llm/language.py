"""Language of documents and of their passages.

Cross-parsing entropy: a suffix automaton of labelled text per language gives, at each character of a text, the length of the
longest run ending there that the language's text contains. A character in a run of length n is 1/n of a phrase, so the sum over a
stretch is the number of phrases that the language needs for it; the language needing fewest, by length, wins. A shortest-path
search over words with a price for each change of language cuts texts into passages. Automata of all languages are one
pair of tables, and many texts step through them at once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.functions.keys import trimmed
from cellweft.session import cut

_TAG = re.compile(r"<[^<>]*>")
_BLANK = re.compile(r"\s+")
_WORD = re.compile(r"[^\W_]+")
#: Soft hyphen, zero-width characters, joiners, byte order mark.
_GONE = dict.fromkeys(map(ord, "­​‌‍‎‏⁠﻿"))
#: Chunks of a text are stepped through side by side. Each begins this many characters early; one whose match then reaches back to its
#: beginning is stepped again from as far as any match can reach, so lengths do not depend on chunks.
LEAD = 64
CHUNK = 480
#: Characters parsed at a time; longer texts are parsed in parts that end between words.
PART = 200_000
#: Characters of texts that are parsed together; many small steps cost more than few large ones.
GROUP = 2_000_000
#: Words times texts whose shortest paths are searched side by side.
CELLS = 250_000


#: Of the characters of the basic plane: letters, and letters or digits. Others (pictographs and the like) count as neither.
_ALPHA = np.array([chr(i).isalpha() for i in range(1 << 16)] + [False])
_ALNUM = np.array([chr(i).isalnum() for i in range(1 << 16)] + [False])


def _points(text: str) -> np.ndarray:
    """Code points, those beyond the basic plane as 65536."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32), 1 << 16)


@dataclass(frozen=True)
class LanguageParams:
    """``sample_docs``, ``snippet`` and ``sample_chars`` bound the labelled text that automata are built from; answers cover all rows."""

    sample_docs: int = 120
    #: Characters taken from the middle of a sampled document.
    snippet: int = 500
    sample_chars: int = 36_000
    clean_rounds: int = 2
    #: Price of changing language, in phrases.
    change: float = 1.6
    #: Phrases a letter costs in no language: a stretch dearer than this in every language has none.
    none: float = 0.4
    #: Least confidence times words of a passage; weaker ones (a few invented words, say) are in no language. 0 keeps all.
    min_evidence: float = 3.0
    #: Passages of a sample under this share of their language's median confidence teach nothing.
    clean_share: float = 0.6
    #: Words a passage needs.
    min_words: int = 8
    seed: int = 3


def plain(text: str | None) -> str:
    """Text as it is compared: composed form, lower case, single blanks, without tags and invisible characters."""
    if not text:
        return ""
    t = _BLANK.sub(" ", _TAG.sub("", text).translate(_GONE))
    return (t if t.isascii() else unicodedata.normalize("NFC", t)).lower()


def words(text: str) -> list[tuple[int, int]]:
    """Spans of runs of letters and digits."""
    return [m.span() for m in _WORD.finditer(text)]


class Automaton:
    """A suffix automaton with complete transition tables over a small alphabet.

    ``to[s, c]`` is the state after character c, ``cap[s, c]`` the length the match is cut to first: matches only shrink to the
    longest suffix that continues with c. Symbol 0 stands for characters that no language's sample has.
    """

    def __init__(self, codes: np.ndarray) -> None:
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes.tolist():
            if c == 0:
                last = 0  # a break: matches never run across it
                continue
            known = nxt[last].get(c)
            if known is not None:  # after a break the state may exist
                if length[known] == length[last] + 1:
                    last = known
                    continue
                clone = len(nxt)
                nxt.append(dict(nxt[known])), link.append(link[known]), length.append(length[last] + 1)
                link[known] = clone
                p = last
                while p != -1 and nxt[p].get(c) == known:
                    nxt[p][c] = clone
                    p = link[p]
                last = clone
                continue
            cur = len(nxt)
            nxt.append({}), link.append(0), length.append(length[last] + 1)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
                    link[q] = link[cur] = clone
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
            last = cur
        self.nxt, self.link, self.length = nxt, link, length

    def fill(self, to: np.ndarray, cap: np.ndarray) -> int:
        """Write the tables into the first rows of ``to`` and ``cap``; gives how many."""
        nxt, link, length, n = self.nxt, self.link, self.length, len(self.nxt)
        to[0], cap[0] = 0, -1
        for s in np.argsort(np.array(length), kind="stable").tolist():  # a link is shorter than its state, so it is complete already
            if s:
                to[s], cap[s] = to[link[s]], cap[link[s]]
            if nxt[s]:
                c = np.fromiter(nxt[s].keys(), dtype=np.int64)
                to[s, c] = np.fromiter(nxt[s].values(), dtype=np.int32)
                cap[s, c] = min(length[s], 30000)
        return n


class Languages:
    """Automata of several languages over one alphabet. ``samples``: per language a list of (plain) labelled texts."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.names = sorted(samples)
        letters = sorted({c for ts in samples.values() for t in ts for c in t if c.isalpha() and ord(c) < 1 << 16})
        self.codes = {c: i + 2 for i, c in enumerate(letters)}  # 0 breaks, 1 is a space
        self.table = self._lookup()
        size = len(letters) + 2
        self.longest = max((len(t) for ts in samples.values() for t in ts), default=0)
        # A text of n letters has at most 2 n states. Pages that are not filled take no memory.
        most = sum(2 * len(t) + 2 for ts in samples.values() for t in ts) + 2 * len(self.names)
        to, cap, at, self.start = np.empty((most, size), dtype=np.int32), np.empty((most, size), dtype=np.int16), 0, []
        for n in self.names:
            a = Automaton(np.concatenate([np.r_[0, self.coded(t)] for t in samples[n]] or [np.zeros(1, dtype=np.int64)]))
            k = a.fill(to[at:], cap[at:])
            to[at:at + k] = (to[at:at + k] + at) * size
            self.start.append(at)
            at += k
        self.to, self.cap = to[:at].reshape(-1), cap[:at].reshape(-1)
        self.size, self.start = size, np.array(self.start) * size

    def _lookup(self) -> np.ndarray:
        t = np.where(_ALNUM, 0, 1)
        for c, i in self.codes.items():
            t[min(ord(c), 1 << 16)] = i
        return t

    def coded(self, text: str) -> np.ndarray:
        """Symbols of a text: letters of the alphabet, 1 for white space, punctuation and other signs, 0 for digits and other letters."""
        return self.table[_points(text)]

    def matches(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Per text a (languages x characters) array of match lengths."""
        k = len(self.names)
        out = [np.zeros((k, len(t)), dtype=np.int16) for t in texts]
        pieces = [(i, s, max(0, s - LEAD), min(len(t), s + CHUNK)) for i, t in enumerate(texts) for s in range(0, len(t), CHUNK)]
        while pieces:
            pieces.sort(key=lambda p: p[2] - p[3])
            again = []
            for g in range(0, len(pieces), 2048):
                part = pieces[g:g + 2048]
                got = self._step(texts, part)
                for x, (i, s, a, e) in enumerate(part):
                    if a and s - a < self.longest and got[s - a, :, x].max() > s - a:
                        again.append((i, s, max(0, s - self.longest), e))
                    else:
                        out[i][:, s:e] = got[s - a:e - a, :, x].T
            pieces = again
        return out

    def _step(self, texts: list[np.ndarray], part: list[tuple[int, int, int, int]]) -> np.ndarray:
        """(steps x languages x pieces) match lengths of pieces in lock-step, longest first."""
        k, steps = len(self.names), part[0][3] - part[0][2]
        m = np.zeros((steps, len(part)), dtype=np.int32)
        for x, (i, _, a, e) in enumerate(part):
            m[:e - a, x] = texts[i][a:e]
        size = np.array([e - a for _, _, a, e in part])
        state = np.repeat(self.start[:, None], len(part), axis=1)
        length = np.zeros((k, len(part)), dtype=np.int16)
        got = np.zeros((steps, k, len(part)), dtype=np.int16)
        for s in range(steps):
            n = int(np.searchsorted(-size, -s, side="left"))  # pieces longer than s come first
            at = state[:, :n] + m[s, :n]
            length[:, :n] = np.minimum(length[:, :n], self.cap[at]) + 1
            state[:, :n] = self.to[at]
            got[s, :, :n] = length[:, :n]
        return got

    def _parts(self, text: str) -> list[tuple[int, int]]:
        """Spans of at most about PART characters that end between words."""
        out, a = [], 0
        while len(text) - a > PART:
            e = a + PART
            while e < len(text) and (text[e].isalnum() and text[e - 1].isalnum()):
                e += 1
            out.append((a, e))
            a = e
        return [*out, (a, len(text))]

    def phrases(self, texts: list[str]) -> list[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
        """Per text: word spans, (words x languages) phrases needed, and letters per word. A word of digits needs none."""
        todo = [(i, a, e) for i, t in enumerate(texts) for a, e in self._parts(t)][::-1]
        res: list[list] = [[[], [np.zeros((0, len(self.names)))], [np.zeros(0)]] for _ in texts]
        while todo:
            batch, size = [], 0
            while todo and (not batch or size + todo[-1][2] - todo[-1][1] <= GROUP):
                batch.append(todo.pop())
                size += batch[-1][2] - batch[-1][1]
            # Parts begin as much earlier as a match can reach back.
            early = [max(0, a - self.longest) for _, a, _ in batch]
            coded = [self.coded(texts[i][b:e]) for (i, _, e), b in zip(batch, early)]
            for (i, a, e), b, m in zip(batch, early, self.matches(coded)):
                t = texts[i][a:e]
                spans = words(t)
                if not spans:
                    continue
                letter = _ALPHA[_points(t)]
                cost = np.where(letter[None, :], 1.0 / np.maximum(m[:, a - b:], 1), 0.0)
                run = np.concatenate([np.zeros((len(self.names), 1)), cost.cumsum(axis=1)], axis=1)
                n = np.concatenate([[0], letter.cumsum()])
                x, y = np.array([s[0] for s in spans]), np.array([s[1] for s in spans])
                res[i][0] += [(p + a, q + a) for p, q in spans] if a else spans
                res[i][1].append((run[:, y] - run[:, x]).T)
                res[i][2].append((n[y] - n[x]).astype(float))
        return [(s, c[1] if len(c) == 2 else np.concatenate(c), n[1] if len(n) == 2 else np.concatenate(n)) for s, c, n in res]


Passage = tuple[int, int, int, float]


def passages(parsed: list[tuple[np.ndarray, np.ndarray]], p: LanguageParams) -> list[list[Passage]]:
    """Per text, given (words x languages) phrases and letters per word: (first word, past last word, language, confidence).

    The cheapest way to divide words among languages, found for all texts in lock-step. Language -1 is none. Confidence is
    the share by which the next best language would need more phrases for the passage.
    """
    order = sorted(range(len(parsed)), key=lambda i: -len(parsed[i][1]))
    order = [i for i in order if len(parsed[i][1])]
    out: list[list[Passage]] = [[] for _ in parsed]
    g = 0
    while g < len(order):
        # As many texts as the longest of them leaves room for; one longer than that goes alone.
        group = order[g:g + max(1, min(512, CELLS // len(parsed[order[g]][1])))]
        g += len(group)
        size = np.array([len(parsed[i][1]) for i in group])
        steps, k = int(size[0]), parsed[group[0]][0].shape[1]
        cost = np.zeros((steps, len(group), k + 1))
        for x, i in enumerate(group):
            cost[:size[x], x, :k], cost[:size[x], x, k] = parsed[i][0], p.none * parsed[i][1]
        back = np.zeros((steps, len(group), k + 1), dtype=np.int8)
        best, stay = cost[0].copy(), np.arange(k + 1)[None, :]
        live = np.searchsorted(-size, -np.arange(steps), side="left")
        for s in range(1, steps):
            b = best[:live[s]]
            low = b.argmin(axis=1)[:, None]
            changed = np.take_along_axis(b, low, 1) + p.change
            back[s, :live[s]] = np.where(changed < b, low, stay)
            best[:live[s]] = np.minimum(b, changed) + cost[s, :live[s]]
        path = np.zeros((steps, len(group)), dtype=np.int8)
        now = best.argmin(axis=1)
        for s in range(steps - 1, -1, -1):
            at = np.arange(live[s])
            path[s, :live[s]] = now[at]
            now[at] = back[s, at, now[at]] if s else now[at]
        for x, i in enumerate(group):
            way, c = path[:size[x], x], parsed[i][0]
            edge = np.flatnonzero(np.r_[True, way[1:] != way[:-1], True]).tolist()
            for a, e in zip(edge[:-1], edge[1:]):
                lang = int(way[a]) if way[a] < k else -1
                total = c[a:e].sum(axis=0)
                other = np.delete(total, lang).min() if lang >= 0 and k > 1 else 0.0
                out[i].append((a, e, lang, float(1 - total[lang] / other) if lang >= 0 and other > 0 else 0.0))
    return out


def labelled_sample(documents: DataFrame, codes: DataFrame, p: LanguageParams) -> dict[str, list[str]]:
    """At most ``sample_docs`` texts (``sample_chars`` characters) per language, drawn by hash from rows whose label is known.

    The rank limit is applied within tasks first, so a language with most rows sends few.
    """
    known = documents.where("text IS NOT NULL AND length(text) BETWEEN 80 AND 20000").join(
        F.broadcast(codes) if codes.count() < 100_000 else codes, F.lower(trimmed("lang")) == F.col("label"))
    w = Window.partitionBy("lang_code").orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id")
    ids = known.select("lang_code", "doc_id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= p.sample_docs).select("doc_id", "lang_code")
    rows = documents.select("doc_id", "text").join(ids, "doc_id").orderBy("lang_code", "doc_id").collect()  # bounded
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["lang_code"], []).append(plain(r["text"]))
    return {k: _bounded(v, p) for k, v in out.items()}


def _bounded(texts: list[str], p: LanguageParams) -> list[str]:
    out, n = [], 0
    for t in texts:
        at = max(0, (len(t) - p.snippet) // 2)
        out.append(t[at:at + min(p.snippet, p.sample_chars - n)])
        n += len(out[-1])
        if n >= p.sample_chars:
            break
    return out


def cleaned(samples: dict[str, list[str]], p: LanguageParams) -> dict[str, list[str]]:
    """Samples without the passages that labels got wrong and without what is in no language (tables, sequences).

    Each half of the sample judges the other: only passages that the other half's automata give to the label's own language
    stay, and of these the ones about as sure as the language's usual passage. Right labels outnumber wrong ones, so
    their language needs fewer phrases than the strays of another.
    """
    for _ in range(p.clean_rounds):
        halves = [{k: v[h::2] for k, v in samples.items()} for h in (0, 1)]
        kept: dict[str, list[tuple[float, str]]] = {k: [] for k in samples}
        for judge, judged in ((0, 1), (1, 0)):
            lang = Languages({k: v or samples[k] for k, v in halves[judge].items()})
            for k, texts in halves[judged].items():
                parsed = lang.phrases(texts)
                for t, (spans, _, _), found in zip(texts, parsed, passages([x[1:] for x in parsed], p)):
                    kept[k] += [(sure, t[spans[a][0]:spans[e - 1][1]]) for a, e, got, sure in found if got >= 0 and lang.names[got] == k and e - a >= p.min_words]
        for k, found in kept.items():
            if found:
                usual = float(np.median([sure for sure, t in found for _ in range(0, len(t), 50)]))
                samples[k] = [t for sure, t in found if sure >= p.clean_share * usual]
    return samples


_MODELS: dict[int, Languages] = {}


def document_passages(documents: DataFrame, codes: DataFrame, params: LanguageParams | None = None) -> DataFrame:
    """(doc_id, first_word, n_words, lang_code, confidence): the passages of at least ``min_words`` words of every document.

    ``documents``: doc_id, text, lang; ``codes``: label, lang_code. Null, empty and wordless texts, and stretches in no known
    language, give no rows. Without any labelled text there are no languages and no rows.
    """
    p = params or LanguageParams()
    samples = labelled_sample(documents, codes, p)
    spark = documents.sparkSession
    if samples:
        samples = cleaned(samples, p)
    shared = spark.sparkContext.broadcast(samples)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = hash(tuple((k, tuple(v)) for k, v in sorted(shared.value.items())))
        if shared.value and name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = Languages(shared.value)
        lang = _MODELS.get(name)
        for b in batches:
            rows: list[tuple[int, int, int, str, float]] = []
            texts = b.column("text").to_pylist()
            at, group, size = [], [], 0
            for i, t in enumerate([*texts, None]):
                last = i == len(texts)
                if not last and t:
                    at.append(i), group.append(plain(t))
                    size += len(t)
                if group and (last or size > GROUP):
                    parsed = lang.phrases(group) if lang else []
                    for x, found in zip(at, passages([q[1:] for q in parsed], p)):
                        rows += [(x, a, e - a, lang.names[k], c) for a, e, k, c in found if k >= 0 and e - a >= p.min_words and c * (e - a) >= p.min_evidence]
                    at, group, size = [], [], 0
            where = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(where), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.float64())],
                                             ["doc_id", "first_word", "n_words", "lang_code", "confidence"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, first_word int, n_words int, lang_code string, confidence double")


def wrong_labels(documents: DataFrame, found: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc_id, lang_code, n_words, confidence) of each language of the documents whose label does not say all of it.

    Those are documents in several languages, and those whose label is missing, unknown or another language's. ``found`` is
    what :func:`document_passages` gives. Confidence is the mean over passages, weighted by words.
    """
    per = found.groupBy("doc_id", "lang_code").agg(F.sum("n_words").alias("n_words"), (F.sum(F.col("confidence") * F.col("n_words")) / F.sum("n_words")).alias("confidence"))
    per = cut(per)
    several = per.groupBy("doc_id").agg((F.count("*") > 1).alias("several"))
    label = documents.select("doc_id", F.lower(trimmed("lang")).alias("label")).distinct()
    said = label.join(codes.select("label", F.col("lang_code").alias("said")), "label").select("doc_id", "said").distinct()
    j = per.join(several, "doc_id").join(said, (per["doc_id"] == said["doc_id"]) & (per["lang_code"] == said["said"]), "left").select(per["*"], "several", "said")
    return j.where(F.col("several") | F.col("said").isNull()).select("doc_id", "lang_code", "n_words", "confidence")
