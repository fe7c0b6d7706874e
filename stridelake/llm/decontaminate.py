"""Benchmark decontamination with a BM25 inverted index and block-max WAND.

The test items are indexed; every passage of every document is a query.  An
item's BM25 score is divided by the score that its own words get, so one
threshold serves items of any length.  Passages overlap by half and are twice
as long as the longest item, so a copy of an item lies whole in one of them.

A passage is evaluated only if it can reach the threshold.  Frequent terms that
together give no item more than half of it can't decide alone, so the other,
rare terms of the passage must give some item the other half.  Evaluation is document-at-a-time: a pivot
from the terms' maxima, then the maxima of the posting blocks at the pivot,
then full scores.  What is retrieved is verified by the word runs that the
passage shares with the item's question and with its answer.

The index is broadcast.  Items are indexed in shards of at most ``SHARD_BYTES``
of text, and one shard after another meets the documents, so the broadcast is
bounded however many items there are.  The number of items, their mean and greatest length and
each term's number of items are counted over all items first, so a score, and the cut of the passages,
is the same in however many shards the items are.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm import _text as X
from stridelake.llm._store import cut

THRESHOLD = 0.6
OVERLAP = 0.8
RUN = 3
K1, B = 1.2, 0.75
POSTINGS = 32
LEAST_PASSAGE = 64
LEAST_ITEM = 2  # words; an item of one word has no answer to verify
SHARD_BYTES = 32 << 20
BLOCK_BYTES = 2 << 20
LUT_BITS = 20

#: Letters, digits and all bytes of non-ASCII characters make words; A-Z count as a-z.
_WORD = np.full(256, 0x20, np.uint8)
_WORD[0x30:0x3A] = np.arange(0x30, 0x3A)
_WORD[0x61:0x7B] = np.arange(0x61, 0x7B)
_WORD[0x41:0x5B] = np.arange(0x61, 0x7B)
_WORD[0x80:] = np.arange(0x80, 0x100)


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, h, first = X.words(_WORD[raw], offsets)
    return h, first


def _runs(h: np.ndarray, n: int) -> set:
    return {tuple(h[i : i + n].tolist()) for i in range(len(h) - n + 1)}


class Stats(NamedTuple):
    """What scores need to know of all items: number, mean and greatest length, and items by term (sorted terms, counts)."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray
    counts: np.ndarray


def stats_of(words: list[np.ndarray]) -> Stats:
    each = [np.unique(w) for w in words]
    terms, counts = np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Stats(len(words), sum(map(len, words)) / max(len(words), 1), max(map(len, words), default=1), terms, counts)


class Index:
    """Postings in blocks, with the best score of every term and of every block."""

    def __init__(self, items: list[tuple[int, str]], stats: Stats | None = None):
        raw, offsets = X.buffers(pa.array([t for _, t in items], pa.string()))
        h, first = _words(raw, offsets)
        words = [h[a:z] for a, z in zip(first[:-1], first[1:], strict=True)]
        kept = [i for i, w in enumerate(words) if len(w) >= LEAST_ITEM]
        self.ids = [items[i][0] for i in kept]
        self.words = [words[i] for i in kept]
        self.parts = [self._split(items[i][1] or "", words[i]) for i in kept]
        self.vocab = np.unique(np.concatenate(self.words)) if kept else np.zeros(0, np.uint64)
        stats = stats or stats_of(self.words)
        if len(self.vocab):
            n, df = stats.n, stats.counts[np.searchsorted(stats.terms, self.vocab)]
            idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        held: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, w in enumerate(self.words):  # an item's figures depend on the item and on ``stats`` alone
            terms, tf = np.unique(np.searchsorted(self.vocab, w), return_counts=True)
            s = idf[terms] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / stats.mean)))
            for t, x in zip(terms.tolist(), (s / s.sum()).tolist(), strict=True):
                held[t].append((i, x))
        self.items, self.scores, self.block_max = [], [], []
        self.best = np.zeros(len(self.vocab))
        for t in range(len(self.vocab)):
            self.items.append([i for i, _ in held[t]])
            self.scores.append([x for _, x in held[t]])
            self.block_max.append(np.maximum.reduceat(self.scores[t], np.arange(0, len(held[t]), POSTINGS)).tolist())
            self.best[t] = max(self.scores[t])
        # frequent terms first: those that give no item more than half of the threshold can't decide alone
        self.essential = np.ones(len(self.vocab), bool)
        weak = np.zeros(len(kept))
        for t in sorted(range(len(self.vocab)), key=lambda t: -len(self.items[t])):
            more = np.array(self.scores[t])
            if (weak[self.items[t]] + more <= THRESHOLD / 2).all():
                weak[self.items[t]] += more
                self.essential[t] = False
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in self.items]))).astype(np.int64)
        self.flat_items = np.array([i for x in self.items for i in x], np.int64)
        self.flat_scores = np.array([v for x in self.scores for v in x])
        self.passage = max(LEAST_PASSAGE, 2 * stats.longest)
        self.lut = np.zeros(1 << LUT_BITS, bool)
        self.lut[(self.vocab >> np.uint64(64 - LUT_BITS)).astype(np.int64)] = True

    @staticmethod
    def _split(text: str, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Question and answer: the lines before the last and the last, or the halves of a single line."""
        lines = [x for x in text.split("\n") if _words(*X.buffers(pa.array([x])))[0].size]
        if len(lines) > 1:
            q = _words(*X.buffers(pa.array(["\n".join(lines[:-1])])))[0]
            return q, words[len(q) :]
        half = (len(words) + 1) // 2
        return words[:half], words[half:]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) of at least ``threshold`` for a set of terms, by block-max WAND."""
        out, cursors = [], []
        for t in terms:
            heapq.heappush(cursors, (self.items[t][0], t, 0))
        eps = 1e-12
        while cursors:
            # pivot: the first item at which the terms' maxima reach the threshold
            cursors.sort()
            bound, pivot = 0.0, None
            for x, (item, t, _) in enumerate(cursors):
                bound += self.best[t]
                if bound + eps >= threshold:
                    pivot = item
                    while x + 1 < len(cursors) and cursors[x + 1][0] == pivot:
                        x += 1
                    break
            if pivot is None:
                break
            front, rest = cursors[: x + 1], cursors[x + 1 :]
            moved, limit, ends = [], 0.0, []
            for _, t, p in front:  # shallow move to the block that may hold the pivot
                posts = self.items[t]
                while p < len(posts) and posts[min(len(posts), (p // POSTINGS + 1) * POSTINGS) - 1] < pivot:
                    p = (p // POSTINGS + 1) * POSTINGS
                if p < len(posts):
                    limit += self.block_max[t][p // POSTINGS]
                    ends.append(posts[min(len(posts), (p // POSTINGS + 1) * POSTINGS) - 1])
                    moved.append((t, p))
            if limit + eps >= threshold:
                gains, target = [], pivot + 1
                for t, p in moved:
                    posts = self.items[t]
                    while p < len(posts) and posts[p] < pivot:
                        p += 1
                    if p < len(posts) and posts[p] == pivot:
                        gains.append((t, self.scores[t][p]))
                score = sum(x for _, x in sorted(gains))  # always in the order of the terms
                if score + eps >= threshold:
                    out.append((pivot, score))
            else:  # no item up to the end of the nearest block can reach it
                target = max(pivot + 1, min([*(e + 1 for e in ends), *(c[0] for c in rest[:1])], default=pivot + 1))
            cursors = rest
            for t, p in moved:
                posts = self.items[t]
                while p < len(posts) and posts[p] < target:
                    p += 1
                if p < len(posts):
                    cursors.append((posts[p], t, p))
        return out

    def overlaps(self, item: int, words: np.ndarray) -> tuple[float, float]:
        """Shares of the runs of ``RUN`` words of question and answer that the passage has."""
        have: dict[int, set] = {}
        out = []
        for part in self.parts[item]:
            n = min(RUN, len(part))
            if n not in have:
                have[n] = _runs(words, n)
            want = _runs(part, n)
            out.append(len(want & have[n]) / len(want))
        return out[0], out[1]

    def matches(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of verified items, best passage of each."""
        hit = np.flatnonzero(self.lut[(h >> np.uint64(64 - LUT_BITS)).astype(np.int64)])
        if not len(hit):
            return
        term = np.searchsorted(self.vocab, h[hit])
        term[term == len(self.vocab)] = 0
        real = self.vocab[term] == h[hit]
        hit, term = hit[real], term[real]
        strong = self.essential[term]
        step = self.passage // 2
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        chunks = -(-np.diff(first) // step)  # passages are pairs of neighbouring chunks
        base = np.concatenate(([0], np.cumsum(chunks + 1)))
        at, known = hit[strong], term[strong]
        cell = base[owner[at]] + (at - first[owner[at]]) // step
        before = cell > base[owner[at]]
        cell, known = np.concatenate((cell, cell[before] - 1)), np.concatenate((known, known[before]))
        many = self.starts[known + 1] - self.starts[known]
        post = np.repeat(self.starts[known] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        pair, back = np.unique(np.repeat(cell, many) * len(self.ids) + self.flat_items[post], return_inverse=True)
        able = np.bincount(back, self.flat_scores[post], len(pair)) >= THRESHOLD / 2 - 1e-9
        worth = np.unique(pair[able] // len(self.ids))
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for c in worth.tolist():
            r = int(np.searchsorted(base, c, "right")) - 1
            lo = int(first[r]) + (c - int(base[r])) * step
            hi = min(int(first[r + 1]), lo + 2 * step)
            if lo >= hi:
                continue
            a, z = np.searchsorted(hit, (lo, hi))
            for item, score in self.search(np.unique(term[a:z]).tolist(), THRESHOLD):
                q, w = self.overlaps(item, h[lo:hi])
                if q >= OVERLAP and w >= OVERLAP:
                    found[r, item] = max(found.get((r, item), (0.0, 0.0, 0.0)), (score, q, w))
        for (r, item), x in sorted(found.items()):
            yield r, item, *x


def _global_stats(items: DataFrame) -> tuple[Stats, DataFrame]:
    """The items' figures without terms, and a table of (term, df), however many items there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = X.buffers(batch.column("text"))
            for lo, hi in X.slices(offsets, BLOCK_BYTES):
                o = offsets[lo : hi + 1]
                h, first = _words(raw[o[0] : o[-1]], o - o[0])
                words = [w for w in (h[a:z] for a, z in zip(first[:-1], first[1:], strict=True)) if len(w) >= LEAST_ITEM]
                if words:
                    each = [np.unique(w) for w in words]
                    size = np.concatenate([np.where(np.arange(len(t)) == 0, len(w), 0) for t, w in zip(each, words, strict=True)])  # a length, once an item
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each).astype(np.int64)), pa.array(size, pa.int64())], names=["term", "size"])

    rows = items.select("text").mapInArrow(run, "term long, size long")
    df = cut(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum((F.col("size") > 0).cast("long")).alias("items"), F.sum("size").alias("words"), F.max("size").alias("longest")), "terms")
    t = df.agg(F.sum("items").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest")).first()
    none = np.zeros(0, np.uint64)
    return Stats(t.n or 0, (t.words or 0) / max(t.n or 0, 1), t.longest or 1, none, none.astype(np.int64)), df.select("term", "df")


def _shard_stats(total: Stats, df: DataFrame, rows: list[tuple[int, str]]) -> Stats:
    """The figures with the counts of one shard's terms."""
    words = _words(*X.buffers(pa.array([t for _, t in rows], pa.string())))[0]
    terms = np.unique(words)
    own = df.sparkSession.createDataFrame(pa.table({"term": terms.astype(np.int64)}))
    got = df.join(own, "term", "left_semi").collect()
    found = np.array([r.term for r in got], np.int64).astype(np.uint64)
    order = np.argsort(found)
    return total._replace(terms=found[order], counts=np.array([r.df for r in got], np.int64)[order])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Return (id, fp, item_id, score, question_overlap, answer_overlap) for each document and test item in it.

    A null or empty text, or item, matches nothing; items of fewer than ``LEAST_ITEM`` words have no
    question and answer to verify and are not indexed.  Items that repeat id and text are one.  Rows are
    judged one by one, so repeated or null ids appear as often as their rows match; a null item's id is the
    smallest long.  ``fp`` is a hash of the text.  An empty table of either kind gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.select("id", F.xxhash64("text").alias("fp"), "text")
    items = benchmark.select(F.coalesce(F.col(item_col).cast("long"), F.lit(-(1 << 63))).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    total = _global_stats(items) if shards > 1 else None
    schema = "id long, fp long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for shard in range(shards):
        rows = sorted((r.item, r.text) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard).collect())
        index = src.sparkSession.sparkContext.broadcast(Index(rows, _shard_stats(*total, rows) if total else None))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            idx = index.value
            for batch in batches:
                raw, offsets = X.buffers(batch.column("text"))
                for lo, hi in X.slices(offsets, BLOCK_BYTES):
                    o = offsets[lo : hi + 1]
                    got = list(idx.matches(*_words(raw[o[0] : o[-1]], o - o[0]))) if idx.ids else []
                    if got:
                        at = pa.array([lo + g[0] for g in got])
                        ids = pa.array([idx.ids[g[1]] for g in got], pa.int64())
                        yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("fp").take(at), ids, *(pa.array([g[c] for g in got], pa.float64()) for c in (2, 3, 4))], names=["id", "fp", "item_id", "score", "question_overlap", "answer_overlap"])

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col)
