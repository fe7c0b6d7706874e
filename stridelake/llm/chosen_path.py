"""Near-duplicates by a chosen-path set similarity join.

1. A document becomes its set of word shingles, a digest of that set and
   ``COORDS`` minwise tokens.  Documents with the same set form one class; from
   here on a class stands for its documents.
2. ``TREES`` trees branch the classes.  A node chooses coordinates from its own
   path (two at odd levels, one at even levels: 1.41 a level against the
   1 / 0.8 = 1.25 that keeps the chance of a pair at the threshold from
   dying out) and sends each class to the child named by its token there.
3. Each class is first held against three leaders of each of its first nodes.  Pairs
   whose tokens agree often enough are confirmed on their full sets, and
   linked classes get a common component.
4. A node whose classes are all of one component is done: further links would
   change nothing.  Of the others, those of up to ``LEAF`` classes are compared
   exhaustively, between components; larger ones branch again, until they are small
   or done.  Branching parts classes of little likeness at once, but not crowds that are
   nearly near: a node that is still large after ``DEPTH`` levels is dealt in groups of half
   a leaf, and every two groups are compared, so it costs time but no pair and no memory.

A pair at the threshold shares nodes of a tree down to any depth with a chance of about
0.8.  All trees choose from the same ``COORDS`` tokens, so they aren't independent: over the
number of tokens that agree, eight trees miss a pair of similarity 0.80 with a chance of
0.9e-4 and one of 0.82 with 0.2e-4 where four levels are needed, and of 6.6e-4 and 2.1e-4 at
the greatest depth (simulated, 800,000 pairs each).

No node is capped or sampled.  All pairs of a group are never emitted: agreement
is tested where the rows meet.  Where few pairs of a node are promising the pairs
leave the task, and are confirmed one by one; else the node's members do, and are
confirmed together, so what moves grows with the rows.  A block that is confirmed
together has at most ``BLOCK_SHINGLES`` shingles and ``BLOCK_ROWS`` rows; more are cut in
groups, and every two groups make a block.

Texts stay in the table of rows: only those of classes in promising pairs move.  A class
meets its leaders by two bits of each token, which pass all that the tokens would, and is
compared by the low bytes; the first nodes move once for the leaders and once for the open nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.llm import _text as X
from stridelake.llm._store import cut, drop, gathered, width

COORDS = 64  # the bits of a long, as sketches need
TREES = 8
DEPTH = 6
LEAF = 2048
DENSE = 2  # pairs for each row from which a node is confirmed as a whole
BLOCK_SHINGLES = 1 << 19
BLOCK_ROWS = 768
COLUMNS = 4096
BLOCK_BYTES = 2 << 20
FILE_ROWS = 50_000  # of the tables of links
BROADCAST_ENDS = 200_000  # classes of 16 bytes
FILTER_BITS = 1 << 27  # of what stands for more of them: 16 MB
CHUNK_BITS = 1 << 18
#: Agreeing tokens of 64 below which a pair isn't confirmed; at a similarity of 0.8 fewer come with a chance of 3e-6.
AGREE_AT_80 = 36


def agreement(similarity_pct: int) -> int:
    """4.75 standard deviations below the tokens expected to agree at the threshold."""
    j = similarity_pct / 100
    return max(1, int(COORDS * j - 4.75 * (COORDS * j * (1 - j)) ** 0.5))


_A = X.mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = X.mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and the rows' bounds in them.

    A-Z count as a-z.  A row with fewer than ``k`` words has its whole sequence
    as one shingle; a row without words has none.
    """
    _, _, h, first = X.words(raw, offsets, lower=True)
    r, _, s = X.windows(h, first, k)
    n = np.diff(first)
    for few in range(1, k):
        rows = np.flatnonzero(n == few)
        if len(rows):
            acc = np.full(len(rows), few, np.uint64)
            for j in range(few):
                acc = X.mix(acc * np.uint64(0xD6E8FEB86659FD93) + h[first[rows] + j])
            r, s = np.concatenate((r, rows)), np.concatenate((s, acc))
    order = np.lexsort((s, r))
    r, s = r[order], s[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
    r, s = r[new], s[new]
    return s, np.searchsorted(r, np.arange(len(offsets)))


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = X.buffers(batch.column("text"))
            for lo, hi in X.slices(offsets, BLOCK_BYTES):
                o = offsets[lo : hi + 1]
                s, bound = shingle_sets(raw[o[0] : o[-1]], o - o[0], k)
                n = np.diff(bound)
                full = np.flatnonzero(n)
                sig = np.zeros((hi - lo, COORDS), "<u4")
                if len(full):
                    for i in range(COORDS):
                        sig[full, i] = np.minimum.reduceat((s * _A[i] + _B[i]) >> np.uint64(32), bound[full])
                flat = s.astype("<u8").tobytes()
                cls = [hashlib.blake2b(flat[8 * a : 8 * z], digest_size=16).digest() if z > a else None for a, z in zip(bound[:-1], bound[1:], strict=True)]
                planes = sig.view(np.uint8).reshape(-1, COORDS, 4).transpose(0, 2, 1)  # the tokens' low bytes come first
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("fp"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array([x.tobytes() for x in planes], pa.binary()), part.column("text")],
                    names=["id", "fp", "n", "c", "sig", "text"],
                )

    return run


def _chosen(path: np.ndarray, level: int) -> list[np.ndarray]:
    """Coordinates that nodes choose, from their paths alone."""
    picks = [X.mix(path ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(COORDS)]
    if level % 2 == 0:  # the first level is number 0
        step = np.uint64(1) + X.mix(path ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(COORDS - 1)
        picks.append((picks[0] + step) % np.uint64(COORDS))
    return picks


def _children(path: np.ndarray, sig: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, child paths) for rows with paths and tokens."""
    rows, keys = [], []
    at = np.arange(len(path))
    for pick in _chosen(path, level):
        token = sig[at, pick.astype(np.int64)].astype(np.uint64)
        keys.append(X.mix(X.mix(path + np.uint64(0x9E3779B97F4A7C15) * (pick + np.uint64(1))) ^ token))
        rows.append(at)
    return np.concatenate(rows), np.concatenate(keys)


def _bytes(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint8)


def _tokens(col: pa.Array) -> np.ndarray:
    planes = _bytes(col.to_pylist()).reshape(-1, 4, COORDS)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(-1, COORDS)


def _low(sig: str = "sig") -> Column:
    """The tokens' low bytes."""
    return F.substring(sig, 1, COORDS)


def _sketch(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two longs a row: the lowest and the second lowest bit of each token."""
    return tuple(np.packbits((sig >> np.uint32(i) & np.uint32(1)).astype(np.uint8), axis=1, bitorder="little").view("<i8")[:, 0] for i in (0, 1))


_NODE = "node long, c binary, comp binary"


def _emit(batch: pa.RecordBatch, rows: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """The nodes of rows, with the batch's other columns than the tokens and nodes."""
    at, names = pa.array(rows), [n for n in batch.schema.names if n not in ("sig", "node")]
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *(batch.column(n).take(at) for n in names)], names=["node", *names])


def _roots(sketched: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = _tokens(batch.column("sig"))
                if sketched:
                    for name, bits in zip("xy", _sketch(sig), strict=True):
                        batch = batch.append_column(name, pa.array(bits))
                for tree in range(TREES):
                    path = np.full(len(sig), X.mix(np.array([tree + 1], np.uint64))[0], np.uint64)
                    yield _emit(batch, *_children(path, sig, 0))

    return run


def _deeper(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                path = batch.column("node").to_numpy().astype(np.uint64)
                yield _emit(batch, *_children(path, _tokens(batch.column("sig")), level))

    return run


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _stars(classes: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of each class and three leaders of each of its first nodes.

    Two bits of a token agree where the token does, so pairs whose bits agree in fewer than ``least``
    places aren't promising and don't leave the node.
    """
    label = F.coalesce("label", F.lit((1 << 63) - 1))  # the class of the smallest id is a leader
    nodes = classes.select("c", label.alias("label"), "sig").mapInArrow(_roots(True), "node long, c binary, label long, x long, y long")
    node, own = Window.partitionBy("node"), F.struct("c", "x", "y")
    led = nodes.select("*", F.min(own).over(node).alias("l1"), F.max(own).over(node).alias("l2"), F.min(F.struct("label", "c", "x", "y")).over(node).alias("l3"))
    led = led.filter("l1.c <> l2.c").select("c", "x", "y", F.explode(F.array("l1", "l2", F.struct("l3.c", "l3.x", "l3.y"))).alias("l"))
    agree = F.lit(COORDS) - F.bit_count(F.col("x").bitwiseXOR(F.col("l.x")).bitwiseOR(F.col("y").bitwiseXOR(F.col("l.y"))))
    return led.filter(F.col("c") != F.col("l.c")).filter(agree >= least).select(F.least("c", "l.c").alias("a"), F.greatest("c", "l.c").alias("b")).distinct()


def _promising(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose tokens' low bytes agree in ``least`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = _bytes(batch.column("la").to_pylist()) == _bytes(batch.column("lb").to_pylist())
                yield batch.select(["a", "b"]).filter(pa.array(same.reshape(-1, COORDS).sum(axis=1) >= least))

    low = classes.select(F.col("c").alias("a"), _low().alias("la"))
    return pairs.join(low, "a").join(low.toDF("b", "lb"), "b").select("a", "b", "la", "lb").mapInArrow(run, "a binary, b binary")


def _sifted(texts: DataFrame, ends: DataFrame) -> DataFrame:
    """Texts of ``ends`` and of the few other classes that share a bit with one; more ends let more of those through and lose none."""
    bit = F.pmod(F.xxhash64("c"), F.lit(FILTER_BITS)).alias("bit")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            bits = np.sort(batch.column("bit").to_numpy())
            chunks, first = np.unique(bits // CHUNK_BITS, return_index=True)
            for chunk, own in zip(chunks.tolist(), np.split(bits, first[1:]), strict=True):
                held.setdefault(chunk, np.zeros(CHUNK_BITS, bool))[own % CHUNK_BITS] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], names=["chunk", "packed"])

    spark = texts.sparkSession
    chunk = F.floor(F.col("bit") / CHUNK_BITS)
    packed = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in ends.select(bit).repartition(width(spark), chunk).mapInArrow(pack, "chunk long, packed binary").collect():
        at = r.chunk * CHUNK_BITS // 8
        packed[at : at + CHUNK_BITS // 8] = np.frombuffer(r.packed, np.uint8)
    shared = spark.sparkContext.broadcast(packed.tobytes())

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            bits = batch.column("bit").to_numpy()
            hit = packed[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8) & 1
            yield batch.select(["c", "text"]).filter(pa.array(hit.astype(bool)))

    return texts.select("c", "text", bit).mapInArrow(sift, "c binary, text string")


def _texts_of(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """A text of each class in pairs (a, b), b possibly null, from the rows' (c, text); the others' texts needn't move."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).filter("c is not null").distinct()
    # the texts of a class have the same set, so any of them serves
    one = lambda t: t.groupBy("c").agg(F.first("text").alias("text"))
    if ends.count() <= BROADCAST_ENDS:
        return one(texts.join(F.broadcast(ends), "c", "left_semi"))
    return one(_sifted(texts, ends)).join(ends, "c", "left_semi")


def _similar(x: np.ndarray, y: np.ndarray, pct: int) -> bool:
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= pct * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, pct: int, carry: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Columns ``carry`` of the pairs (a, b) whose full sets are similar enough."""
    extra = [c for c in carry if c not in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (ra, oa), (rb, ob) = (X.buffers(batch.column(x)) for x in ("ta", "tb"))
            good = np.zeros(batch.num_rows, bool)
            for lo, hi in X.slices(oa + ob, BLOCK_BYTES):
                sa, ba = shingle_sets(ra[oa[lo] : oa[hi]], oa[lo : hi + 1] - oa[lo], k)
                sb, bb = shingle_sets(rb[ob[lo] : ob[hi]], ob[lo : hi + 1] - ob[lo], k)
                for i in range(hi - lo):
                    good[lo + i] = _similar(sa[ba[i] : ba[i + 1]], sb[bb[i] : bb[i + 1]], pct)
            yield batch.select(list(carry)).filter(pa.array(good))

    t = texts.select(F.col("c").alias("b"), F.col("text").alias("tb"))
    # the second side, which a leader shares with many pairs, comes last and is not moved with them
    both = pairs.join(t.hint("merge"), "b").join(t.toDF("a", "ta").hint("merge"), "a").select("a", "b", *extra, "ta", "tb")
    return both.mapInArrow(run, f"{carry[0]} binary, {carry[1]} binary")


def components(links: DataFrame) -> DataFrame:
    """(c, comp) for every end of a link (a, b): the smallest class reachable, by label propagation with pointer jumping.

    Each round is one query over the table of the round before.
    """
    parts = 1 + links.count() // FILE_ROWS
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = cut(both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "state", parts)
    while True:
        heard = both.join(state.select(F.col("c").alias("b"), "comp"), "b").groupBy(F.col("a").alias("c")).agg(F.min("comp").alias("near"))
        told = state.select("c", F.col("comp").alias("old")).join(heard, "c").select("c", "old", F.least("old", "near").alias("comp"))
        onward = state.select(F.col("c").alias("comp"), F.col("comp").alias("next"))
        after = cut(told.join(onward, "comp").select("c", "old", F.least("comp", "next").alias("comp")), "state", parts)
        drop(state)
        state = after
        if state.filter("old <> comp").isEmpty():
            return state.select("c", "comp")


def _open_nodes(classes: DataFrame, total: int) -> DataFrame | None:
    """Rows (node, i, j, c, comp) of nodes, or of pairs of groups (i, j) of a node, that a task can compare; None if all is done.  ``total``: the classes."""
    rows, found = classes.select("c", "comp", "sig").mapInArrow(_roots(False), _NODE), []
    whole_node = Window.partitionBy("node")
    for level in range(DEPTH + 1):
        sized = rows.select("*", F.count(F.lit(1)).over(whole_node).alias("size"), F.min("comp").over(whole_node).alias("lo"), F.max("comp").over(whole_node).alias("hi"))
        here = cut(gathered(sized.filter("lo <> hi").select("node", "size", "c", "comp"), total), f"open{level}")
        most = here.agg(F.max("size")).first()[0] or 0
        if not most:
            break
        whole = here.filter(F.col("size") <= LEAF) if most > LEAF else here
        found.append(whole.select("node", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "c", "comp"))
        if most <= LEAF:
            break
        large = here.filter(F.col("size") > LEAF)
        if level == DEPTH:
            groups = F.ceil(F.col("size") / max(1, LEAF // 2))
            own = F.pmod(F.xxhash64("c", "node"), groups)
            dealt = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)))
            found.append(dealt.select("node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "c", "comp"))
            break
        rows = large.select("node", "c", "comp").join(classes.select("c", "sig"), "c").select("node", "c", "comp", "sig").mapInArrow(_deeper(level + 1), _NODE)
    return _union(found) if found else None


def _groups(n: np.ndarray) -> list[np.ndarray]:
    """Row numbers in groups of at most half of ``BLOCK_SHINGLES`` and ``BLOCK_ROWS``, or of one longer row."""
    out, held, total = [], [], 0
    for i, m in enumerate(n.tolist()):
        if held and (total + m > BLOCK_SHINGLES // 2 or 2 * len(held) >= BLOCK_ROWS):
            out.append(np.array(held))
            held, total = [], 0
        held.append(i)
        total += m
    return [*out, np.array(held)] if held else out


_FOUND = "block long, a binary, b binary, ca binary, cb binary"


def _residual(nodes: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Promising pairs of classes that share a node but not a component: (block, a, b, ca, cb).

    A node with few such pairs gives them as (null, a, b) with their components.  A
    node with many gives its members in them instead, as (block, class, null, component, null), so what
    leaves a task grows with its rows and not with their square.
    """

    def rows_of(block: list, a: list, b: list, ca: list, cb: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *(pa.array(x, pa.binary()) for x in (a, b, ca, cb))], names=["block", "a", "b", "ca", "cb"])

    def compare(key: tuple, held: list) -> Iterator[pa.RecordBatch]:
        c, comp, n = [h[0] for h in held], [h[1] for h in held], np.array([h[2] for h in held])
        names: dict = {}
        code = np.array([names.setdefault(x, len(names)) for x in comp])
        if len(names) < 2:
            return
        low = _bytes([h[3] for h in held]).reshape(-1, COORDS)
        pairs, member, many = [], np.zeros(len(held), bool), 0
        for lo in range(0, len(held), 64):
            x = np.arange(lo, min(lo + 64, len(held)))
            hit = (low[x][:, None, :] == low[lo:][None, :, :]).sum(axis=2) >= least
            hit &= code[x][:, None] != code[lo:][None, :]
            p, q = np.nonzero(hit)
            later = x[p] < q + lo
            p, q = x[p[later]], q[later] + lo
            member[p] = member[q] = True
            many += len(p)
            pairs.append(np.stack([p, q], axis=1))
        pairs = np.concatenate(pairs)
        if many > DENSE * len(held):
            own = np.flatnonzero(member)
            groups = [own[g] for g in _groups(n[own])]
            alone = [g for g in groups if n[g].sum() > BLOCK_SHINGLES // 2]  # one long row each: its pairs are confirmed two at a time
            fit = [g for g in groups if n[g].sum() <= BLOCK_SHINGLES // 2]
            for x in range(len(fit)):
                for y in range(x, len(fit)) if len(fit) == 1 else range(x + 1, len(fit)):
                    both = (fit[x] if x == y else np.concatenate((fit[x], fit[y]))).tolist()
                    block = int(X.mix(np.array([key[0]], np.int64).astype(np.uint64) ^ X.mix(np.array([(key[1] << 40) ^ (key[2] << 20) ^ (x << 10) ^ y], np.uint64))).astype(np.int64)[0])
                    yield rows_of([block] * len(both), [c[i] for i in both], [None] * len(both), [comp[i] for i in both], [None] * len(both))
            long = np.zeros(len(held), bool)
            for g in alone:
                long[g] = True
            pairs = pairs[long[pairs[:, 0]] | long[pairs[:, 1]]]
        if len(pairs):
            pairs = [(i, j) if c[i] < c[j] else (j, i) for i, j in pairs.tolist()]
            yield rows_of([None] * len(pairs), [c[i] for i, _ in pairs], [c[j] for _, j in pairs], [comp[i] for i, _ in pairs], [comp[j] for _, j in pairs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if r[:3] != key:
                    if len(held) > 1:
                        yield from compare(key, held)
                    key, held = r[:3], []
                held.append(r[3:])
        if len(held) > 1:
            yield from compare(key, held)

    keys = ["node", "i", "j"]
    rows = nodes.join(classes.select("c", "n", _low().alias("low")), "c").select(*keys, "c", "comp", "n", "low")
    return rows.repartition(width(nodes.sparkSession), *keys).sortWithinPartitions(*keys, "c").mapInArrow(run, _FOUND)


def _confirmed_blocks(members: DataFrame, texts: DataFrame, k: int, pct: int) -> DataFrame:
    """Links (ca, cb) between components within blocks (block, a, ca), from all members' full sets.

    Of the links of a block those are given that join components not joined yet.  A
    task holds the sets of one block, not its texts.
    """

    def settle(comp: list, sets: list) -> Iterator[pa.RecordBatch]:
        n = np.array([len(x) for x in sets])
        _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[col] > 1
        row, col = np.repeat(np.arange(len(sets)), n)[shared], col[shared]
        _, col = np.unique(col, return_inverse=True)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
            a, z = np.searchsorted(col, (lo, lo + COLUMNS))
            dense = np.zeros((len(sets), COLUMNS), np.float32)
            dense[row[a:z], col[a:z] - lo] = 1
            both += dense @ dense.T
        both = both.astype(np.int64)
        hit = 100 * both >= pct * (n[:, None] + n[None, :] - both)
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i, j in zip(*np.nonzero(np.triu(hit, 1)), strict=True):
            x, y = find(comp[i]), find(comp[j])
            if x != y:
                root[x] = y
                out.append((comp[i], comp[j]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in out], pa.binary()), pa.array([max(p) for p in out], pa.binary())], names=["ca", "cb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, comp, sets = None, [], []
        for batch in batches:
            blocks, comps = batch.column("block").to_pylist(), batch.column("ca").to_pylist()
            raw, o = X.buffers(batch.column("text"))
            for lo, hi in X.slices(o, BLOCK_BYTES):
                s, bound = shingle_sets(raw[o[lo] : o[hi]], o[lo : hi + 1] - o[lo], k)
                for i in range(lo, hi):
                    if blocks[i] != key:
                        if len(sets) > 1:
                            yield from settle(comp, sets)
                        key, comp, sets = blocks[i], [], []
                    comp.append(comps[i])
                    sets.append(s[bound[i - lo] : bound[i - lo + 1]].copy())
        if len(sets) > 1:
            yield from settle(comp, sets)

    rows = members.select("block", F.col("a").alias("c"), "ca").join(texts.hint("merge"), "c").select("block", "ca", "c", "text")
    rows = rows.repartition(width(members.sparkSession), "block").sortWithinPartitions("block", "c").select("block", "ca", "text")
    return rows.mapInArrow(run, "ca binary, cb binary")


def near_duplicates(docs: DataFrame, k: int = 4, similarity_pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return per row (id, fp, n_shingles, component_id, kept).

    ``component_id`` is the smallest id reachable over links, ``kept`` whether
    the row has it, ``fp`` a hash of the text that tells apart rows sharing an
    id.  A null or empty text has no shingles and is linked with nothing.  Null
    ids are passed over in choosing the smallest; a component of null ids only has a null
    id and keeps its rows.  Repeated rows get the same result each.  An empty
    table gives no rows.
    """
    least = agreement(similarity_pct)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.select("id", F.xxhash64("text").alias("fp"), "text")
    rows = cut(src.mapInArrow(_describe(k), "id long, fp long, n long, c binary, sig binary, text string"), "rows")
    filled = rows.filter("n > 0")
    classes = filled.groupBy("c").agg(F.min("id").alias("label"), F.max("n").alias("n"), F.first("sig").alias("sig"))
    classes = cut(gathered(classes, rows.count()), "classes")
    total = classes.count()  # what follows goes with the classes
    texts = filled.select("c", "text")
    first = cut(gathered(_promising(_stars(classes, least), classes, least), total), "stars")
    links = cut(gathered(_confirmed(first, _texts_of(texts, first), k, similarity_pct), total), "links")
    state = components(links)
    placed = cut(gathered(classes.join(state, "c", "left").withColumn("comp", F.coalesce("comp", "c")), total), "placed")
    drop(classes)  # what follows doesn't read it
    named = placed.select("c", "label", "comp")
    nodes = _open_nodes(placed, total)
    if nodes is not None:
        more = cut(gathered(_residual(nodes, placed, least), total), "residual")
        sparse = more.filter("block is null").select("a", "b", "ca", "cb").distinct().join(first, ["a", "b"], "left_anti")
        texts = _texts_of(texts, more)
        found = _confirmed(sparse, texts, k, similarity_pct, ("ca", "cb")).unionByName(_confirmed_blocks(more.filter("block is not null"), texts, k, similarity_pct))
        links = cut(gathered(found.distinct().toDF("a", "b"), total), "links")
        drop(more)
        if not links.isEmpty():
            joined = components(links).toDF("comp", "to")
            named = named.join(joined, "comp", "left").select("c", "label", F.coalesce("to", "comp").alias("comp"))
    drop(first)
    lowest = named.groupBy("comp").agg(F.min("label").alias("component_id"))
    named = named.join(lowest, "comp").select("c", "component_id")
    out = rows.select("id", "fp", "n", "c").join(named, "c", "left")
    comp = F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "fp", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))
