"""Removal of repeated word windows with a count-min prefilter.

1. *Sketch.*  Every window of ``k`` words is counted under its anchor: the run
   of ``ANCHOR`` words inside it whose hash is smallest (leftmost of equals).
   Equal windows have equal anchors at equal offsets, so an anchor's count is at least
   that of each window counted under it, and there are far fewer anchors than
   windows.  Tasks count anchors into partition sketches (two rows of cells,
   saturating at two), which travel as sorted cell lists, and are merged
   cell range by cell range.
2. *Prefilter.*  The merged sketch, one bit a cell ("two or more"), overestimates.
   A window whose anchor is estimated unique is unique, and drops out.
3. *Exact grouping.*  The others are grouped by a 96-bit key, made of 64-bit hashes of their words, which
   is as good as 64 bits where two words share a hash.  Within a
   task's ``WINDOW_GROUP`` windows only the earliest occurrence of a key can be the earliest of all, so
   the later ones are settled where they are and one a group and key travels: a window that
   every document has costs its owner an entry for each task, not for each document.  Each
   key's owner marks all but the earliest, and the marks are gathered by document.

The sketch's width follows the number of words up to ``MAX_CELLS``, which bounds
what is broadcast (a quarter of a byte a cell over both rows).  Past that the
filter lets more windows through to the exact grouping; none is lost at any width.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm import _text as X
from stridelake.llm._store import cut, width

WINDOW = 20
ANCHOR = 8
ROWS = 2
MAX_CELLS = 1 << 30
RANGE = 1 << 18  # cells of one merged range
BLOCK_BYTES = 4 << 20
BLOCK_GROUP = 1 << 20  # anchors that share one cell list
WINDOW_GROUP = 1 << 20  # windows that a task settles together
MARK_GROUP = 1 << 20  # marks that are packed together


def _anchors(hashes: np.ndarray, first: np.ndarray, k: int, a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window: its word number in the block, its anchor's hash and word number; last, which windows bring a new anchor."""
    n = len(hashes)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(np.arange(n) + k <= first[rows + 1])
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, np.zeros(0, bool)
    grams = np.zeros(n, np.uint64)
    r, p, h = X.windows(hashes, first, a, 0)
    grams[first[r] + p] = h
    span, low, where, have = k - a + 1, grams.copy(), np.arange(n), 1
    while have < span:  # sliding minimum of whole hashes by doubling, the leftmost of equals
        step = min(have, span - have)
        less = low[step:] < low[: n - step]
        low[: n - step][less] = low[step:][less]
        where[: n - step][less] = where[step:][less]
        have += step
    pos = where[at]
    new = np.ones(len(at), bool)
    new[1:] = pos[1:] != pos[:-1]
    return at, grams[pos], pos, new


def _cells(h: np.ndarray, cells: int) -> list[np.ndarray]:
    bits = np.uint64(64 - (cells.bit_length() - 1))
    return [(x >> bits).astype(np.int64) for x in (X.mix(h), X.mix(h ^ np.uint64(0x5851F42D4C957F2D)))]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, word hashes, first words) for blocks of bounded size."""
    for batch in batches:
        raw, offsets = X.buffers(batch.column("text"))
        for lo, hi in X.slices(offsets, BLOCK_BYTES):
            o = offsets[lo : hi + 1]
            _, _, h, first = X.words(raw[o[0] : o[-1]], o - o[0])
            yield batch.slice(lo, hi - lo), h, first


def _deltas(x: np.ndarray) -> bytes:
    return np.diff(x, prepend=0).astype("<u4").tobytes()


def _sketch(src: DataFrame, k: int, a: int, cells: int) -> DataFrame:
    """Ranges of the merged sketch as packed bits: (part, bits)."""
    ranges = max(1, cells // RANGE)
    step = min(RANGE, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            parts, blobs = [], []
            anchors = np.concatenate(held)
            for row, c in enumerate(_cells(anchors, cells)):
                u, n = np.unique(c, return_counts=True)
                cuts = np.searchsorted(u, np.arange(ranges + 1) * step)
                for g in np.flatnonzero(np.diff(cuts)):
                    lo, hi = cuts[g], cuts[g + 1]
                    parts.append(row * ranges + int(g))
                    here = u[lo:hi] - g * step
                    twice = n[lo:hi] > 1
                    blobs.append(np.array([len(here)], "<u4").tobytes() + here.astype("<u4").tobytes() + np.packbits(twice).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "cells"])

        for _, h, first in _blocks(batches):
            _, anchor, _, new = _anchors(h, first, k, a)
            held.append(anchor[new])
            size += int(new.sum())
            if size >= BLOCK_GROUP:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != part:
                    if part is not None:
                        yield _bits(part, total)
                    part, total = p, np.zeros(step, np.uint8)
                raw = blob.as_buffer()
                n = int(np.frombuffer(raw, "<u4", 1)[0])
                cell = np.frombuffer(raw, "<u4", n, 4)
                twice = np.unpackbits(np.frombuffer(raw, np.uint8, -1, 4 + 4 * n), count=n)
                total[cell] = np.minimum(total[cell] + 1 + twice, 2)
        if part is not None:
            yield _bits(part, total)

    def _bits(part, total):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(total > 1).tobytes()], pa.binary())], names=["part", "bits"])

    lists = src.select("text").mapInArrow(count, "part int, cells binary")
    return lists.repartition(width(src.sparkSession), "part").sortWithinPartitions("part").mapInArrow(merge, "part int, bits binary")


def _marks(src: DataFrame, k: int, a: int, cells: int, sketch: list[tuple[int, bytes]]) -> DataFrame:
    """(id, fp, starts): word numbers of windows that also start earlier, one row for each document that has some.

    Keys are settled by their owners, and the marks then gathered by document in
    packed rows, so rows grow with the documents and not with documents times owners.
    """
    spark = src.sparkSession
    ranges, step = max(1, cells // RANGE), min(RANGE, cells)
    packed = np.zeros(ROWS * cells // 8, np.uint8)
    for part, bits in sketch:
        packed[part * step // 8 : (part + 1) * step // 8] = np.frombuffer(bits, np.uint8)
    shared = spark.sparkContext.broadcast(packed.tobytes())
    owners = 4 * width(spark)

    def flagged(h: np.ndarray) -> np.ndarray:
        bits, hit = np.frombuffer(shared.value, np.uint8), np.ones(len(h), bool)
        for row, c in enumerate(_cells(h, cells)):
            c = c + row * ranges * step
            hit &= (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
        return hit

    names = ["owner", "kind", "blob"]

    def rows_of(owner, kind, blobs):
        return pa.RecordBatch.from_arrays([pa.array(owner, pa.int32()), pa.array([kind] * len(owner), pa.int8()), pa.array(blobs, pa.binary())], names=names)

    def settle_here(held: list, docs: list) -> Iterator[pa.RecordBatch]:
        one, two, r, p = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, fps = (np.concatenate(x) for x in zip(*docs, strict=True))
        order = np.lexsort((p, fps[r], ids[r], two, one))
        o1, o2, od, of, op = one[order], two[order], ids[r][order], fps[r][order], p[order]
        same = np.zeros(len(order), bool)
        same[1:] = (o1[1:] == o1[:-1]) & (o2[1:] == o2[:-1])
        repeat = np.zeros(len(order), bool)  # the very same place, told by a repeated row, isn't earlier
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        repeat[1:] = same[1:] & ((od[1:] != od[lead[1:]]) | (of[1:] != of[lead[1:]]) | (op[1:] != op[lead[1:]]))
        late = order[repeat]
        if len(late):
            late = late[np.lexsort((p[late], fps[r[late]], ids[r[late]]))]
            yield rows_of([int(ids[0] % owners)], 1, [_pack_marks(ids[r[late]], fps[r[late]], p[late])])
        early = np.sort(order[~same])
        to = (one[early] % np.uint64(owners)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        early, to = early[by], to[by]
        cuts = np.flatnonzero(np.diff(to, prepend=-1))
        out, blobs = [], []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(to)), strict=True):
            e = early[lo:hi]
            own, back = np.unique(r[e], return_inverse=True)
            blobs.append(np.array([len(e), len(own)], "<i4").tobytes() + one[e].tobytes() + two[e].tobytes() + back.astype("<i4").tobytes() + p[e].astype("<i4").tobytes() + ids[own].astype("<i8").tobytes() + fps[own].astype("<i8").tobytes())
            out.append(int(to[lo]))
        yield rows_of(out, 0, blobs)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, rows_held, size = [], [], 0, 0
        for rows, h, first in _blocks(batches):
            at, anchor, _, _ = _anchors(h, first, k, a)
            if not len(at):
                continue
            keep = flagged(anchor)
            if not keep.any():
                continue
            r, p, one = X.windows(h, first, k, 0)  # the same windows in the same order as ``at``
            _, _, two = X.windows(h, first, k, 1)
            held.append((one[keep], (two[keep] >> np.uint64(32)).astype(np.uint32), r[keep] + rows_held, p[keep]))
            docs.append(tuple(rows.column(c).to_numpy() for c in ("id", "fp")))
            rows_held += rows.num_rows
            size += len(held[-1][0])
            if size >= WINDOW_GROUP:
                yield from settle_here(held, docs)
                held, docs, rows_held, size = [], [], 0, 0
        if held:
            yield from settle_here(held, docs)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, held, marks = None, [], []
        for batch in batches:
            for o, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind:
                    marks.append(_unpack_marks(blob.as_py()))
                else:
                    if o != owner:
                        if held:
                            marks.append(_settle(held))
                        owner, held = o, []
                    held.append(blob.as_py())
                if sum(len(m[2]) for m in marks) >= MARK_GROUP:
                    yield by_document(marks)
                    marks = []
        if held:
            marks.append(_settle(held))
        if any(len(m[2]) for m in marks):
            yield by_document(marks)

    def by_document(marks: list) -> pa.RecordBatch:
        ids, fps, p = (np.concatenate(x) for x in zip(*marks, strict=True))
        to = (X.mix(ids.astype(np.uint64) ^ X.mix(fps.astype(np.uint64))) % np.uint64(owners)).astype(np.int64)
        order = np.lexsort((p, fps, ids, to))
        ids, fps, p, to = ids[order], fps[order], p[order], to[order]
        cuts = np.flatnonzero(np.diff(to, prepend=-1))
        ends = np.append(cuts[1:], len(to))
        return rows_of(to[cuts].tolist(), 1, [_pack_marks(ids[lo:hi], fps[lo:hi], p[lo:hi]) for lo, hi in zip(cuts, ends, strict=True)])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for g, blob in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if g != group:
                    if held:
                        yield _documents(held)
                    group, held = g, []
                held.append(_unpack_marks(blob.as_py()))
        if held:
            yield _documents(held)

    kind = "owner int, kind byte, blob binary"
    moved = src.select("id", "fp", "text").mapInArrow(local, kind)
    settled = moved.repartition(width(spark), "owner").sortWithinPartitions("owner").mapInArrow(own, kind)
    return settled.repartition(width(spark), "owner").sortWithinPartitions("owner").mapInArrow(gather, "id long, fp long, starts binary")


Marks = tuple[np.ndarray, np.ndarray, np.ndarray]


def _documents(held: list[Marks]) -> pa.RecordBatch:
    """One row for each document: (id, fp, word numbers of its marked windows)."""
    ids, fps, p = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((p, fps, ids))
    ids, fps, p = ids[order], fps[order], p[order]
    cuts = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (fps[1:] != fps[:-1])))) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(ids))
    starts = [p[lo:hi].astype("<i4").tobytes() for lo, hi in zip(cuts, ends, strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(ids[cuts], pa.int64()), pa.array(fps[cuts], pa.int64()), pa.array(starts, pa.binary())], names=["id", "fp", "starts"])


def _pack_marks(ids: np.ndarray, fps: np.ndarray, p: np.ndarray) -> bytes:
    """Marks in order of document; one header for each."""
    cuts = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (fps[1:] != fps[:-1]))))
    n = np.diff(np.append(cuts, len(ids)))
    return np.array([len(cuts)], "<i4").tobytes() + ids[cuts].astype("<i8").tobytes() + fps[cuts].astype("<i8").tobytes() + n.astype("<i4").tobytes() + p.astype("<i4").tobytes()


def _unpack_marks(blob: bytes) -> Marks:
    d = int(np.frombuffer(blob, "<i4", 1)[0])
    ids, fps = np.frombuffer(blob, "<i8", d, 4), np.frombuffer(blob, "<i8", d, 4 + 8 * d)
    n = np.frombuffer(blob, "<i4", d, 4 + 16 * d)
    return np.repeat(ids, n), np.repeat(fps, n), np.frombuffer(blob, "<i4", -1, 4 + 20 * d)


def _settle(held: list[bytes]) -> Marks:
    """Marks of all occurrences of one owner's keys but the earliest."""
    parts = []
    for blob in held:
        n, d = np.frombuffer(blob, "<i4", 2).tolist()
        o = 8
        one = np.frombuffer(blob, "<u8", n, o)
        two = np.frombuffer(blob, "<u4", n, o := o + 8 * n)
        back = np.frombuffer(blob, "<i4", n, o := o + 4 * n)
        p = np.frombuffer(blob, "<i4", n, o := o + 4 * n)
        ids = np.frombuffer(blob, "<i8", d, o := o + 4 * n)
        fps = np.frombuffer(blob, "<i8", d, o + 8 * d)
        parts.append((one, two, ids[back], fps[back], p))
    one, two, ids, fps, p = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((p, fps, ids, two, one))
    one, two, ids, fps, p = (x[order] for x in (one, two, ids, fps, p))
    same = np.zeros(len(one), bool)
    same[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(one))))
    late = same & ((ids != ids[lead]) | (fps != fps[lead]) | (p != p[lead]))
    return ids[late], fps[late], p[late]


def remove_repeats(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """Return per row (id, n_words, n_removed, kept_text).

    A word goes if a window of ``k`` words that covers it also starts earlier:
    in a smaller id, or before it in the same document.  Windows are judged on
    the input.  A null or empty text has no words.  A null id stands after
    every other id.  Rows that repeat an id with another text are further
    documents in the order of a hash of their text; rows that repeat both are one document, and
    each gets that document's result.  An empty table gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.select("own", F.coalesce("own", F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("fp"), "text")
    chars = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    a = min(ANCHOR, k)
    # text of six bytes a word and a new anchor every (k - a + 2) / 2 words fill an eighth of the cells
    wanted = 8 * chars * 2 // (6 * (k - a + 2))
    cells = min(max_cells, max(1 << 16, 1 << int(wanted).bit_length()))
    sketch = [(r.part, bytes(r.bits)) for r in _sketch(src, k, a, cells).toLocalIterator()]
    marks = cut(_marks(src, k, a, cells, sketch), "marks")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                total, gone, kept = [], [], []
                for text, starts in zip(part.column("text"), part.column("starts"), strict=True):
                    words = text.as_py().encode().split()
                    total.append(len(words))
                    if starts.is_valid:
                        p = np.frombuffer(starts.as_buffer(), "<i4")
                        edge = np.bincount(p, minlength=len(words) + 1) - np.bincount(p + k, minlength=len(words) + 1)
                        stay = np.cumsum(edge[:-1]) == 0
                        words = [words[i] for i in np.flatnonzero(stay)]
                    gone.append(total[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column("own"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["own", "n_words", "n_removed", "kept_text"])

    out = src.join(marks.hint("merge"), ["id", "fp"], "left").select("own", "text", "starts").mapInArrow(apply, "own long, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("own", id_col)
