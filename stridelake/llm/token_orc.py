"""Token ids in ORC: sorted by document id, run-length encoded, indexed and Bloom-filtered.

Documents are dealt out by ranges of their id and sorted before they are
encoded, so each file holds one range in ascending order and the files' ranges
follow each other in the order of ``part``.  ORC's integer encoding packs the ids; its row indexes and
Bloom filters on ``doc_id`` let a point or range read skip stripes and row
groups, and its stripes are read in parallel.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.llm import _text as X
from stridelake.llm._store import cut, new_path, width

END_ID = 0
#: Settings of the files.
ORC_OPTIONS = {
    "orc.compress": "SNAPPY",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
CACHE_WORDS = 500_000
BLOCK_BYTES = 1 << 20
BROADCAST_SPLITS = 100_000

#: Blanks other than a space and a newline; texts with one are encoded as they are.
_ODD = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_NEWLINE = array("I", [198]).tobytes()  # the id of a newline that stands alone


_SLOTS, _COPIES, _LONGEST_COPY = 1 << 22, 3000, 8000


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCache:
    """Encodes whole texts with the tokenizers library, word by word.

    The byte-level pre-tokeniser starts a new piece at a single space and at a
    single newline between words, so pieces never cross them.  Texts are split
    there; words, and texts, that come again are kept as the bytes of their ids, words keyed
    without the space before them, or with the newline that stands in its place.  A word of
    letters is one piece and goes straight to the library's model, any other word
    to the library as a text.  Texts with runs of blanks, with other blanks, or
    with the string of an added token, which the library reads as that token, go to the library as they are.
    """

    def __init__(self, path: str, size: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.lib, self.size = Tokenizer.from_file(path), size
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values() if t.content]
        self.letters = _byte_letters()
        model = self.lib.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # words that come again are kept here
        self.tokenize, self.space = model.tokenize, self.letters[0x20]
        self.known: dict[str, bytes] = {}
        self.copies: dict[str, bytes] = {}
        self.once, self.marked = bytearray(_SLOTS), 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _spell(self, w: str) -> str:
        return w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)

    def _again(self, s: str) -> bool:
        """Whether a string has come before: most come once and aren't worth keeping."""
        slot = hash(s) & (_SLOTS - 1)
        if self.once[slot]:
            return True
        self.once[slot] = 1
        self.marked += 1
        if self.marked > _SLOTS // 2:
            self.once, self.marked = bytearray(_SLOTS), 0
        return False

    def _word(self, w: str) -> bytes:
        """The ids of a word that isn't kept; it is, from the second time on."""
        if w.isalpha() or (w.isascii() and w.isdigit()):  # letters or digits alone are one piece
            piece = self.space + (w if w.isascii() else self._spell(w))
            got = array("I", [t.id for t in self.tokenize(piece)]).tobytes()
        elif w[:1] == "\n" and w[1:].isalpha():
            got = _NEWLINE + array("I", [t.id for t in self.tokenize(self._spell(w[1:]))]).tobytes()
        else:
            end = len(w)
            while end and not w[end - 1].isalnum():
                end -= 1
            if 0 < end < len(w):  # what follows the last letter or digit is a piece of its own
                stem, tail = w[:end], "\n" + w[end:]
                got = (self.known.get(stem) or self._word(stem)) + (self.known.get(tail) or self._word(tail))[4:]
            else:
                got = self._whole(w if w[:1] == "\n" else " " + w)
        if len(w) < 3 or self._again(w):
            if len(self.known) >= self.size:
                self.known.clear()
            self.known[w] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers, without an end id."""
        if not text:
            return b""
        got = self.copies.get(text)
        if got is None:
            got = self._encode(text)
            if len(text) < _LONGEST_COPY and self._again(text):
                if len(self.copies) >= _COPIES:
                    self.copies.clear()
                self.copies[text] = got
        return got

    def _encode(self, text: str) -> bytes:
        if "  " in text or "\n\n" in text or "\n " in text or " \n" in text or any(c in text for c in _ODD) or any(c in text for c in self.added):
            return self._whole(text)
        head, *rest = text.replace("\n", " \n").split(" ")
        get, word = self.known.get, self._word
        first = "\n" + head
        lead = (get(first) or word(first))[4:] if head else b""
        return lead + b"".join([get(w) or word(w) for w in rest])


_CACHES: dict[str, WordCache] = {}


def shared_cache(path: str) -> WordCache:
    """One cache for all tasks that a worker process runs."""
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


def _deal(src: DataFrame, n: int) -> DataFrame:
    """Rows dealt to ``n`` partitions by ranges of ``doc_id``, with the range's number as ``part``; nulls are in the first.

    The ranges' bounds come from the ids alone, so the texts are read once; a
    range partitioner would read them once more to sample them.  An id that is several bounds at
    once, as it has more rows than a range, is dealt by ranges of ``tie``.  Each range is
    given a key that Spark's hash partitioner sends to a partition of its own.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    bounds = src.select(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    if not bounds:
        return src.coalesce(1).withColumn("part", F.lit(0))
    ends = sorted(set(bounds))
    times = [bounds.count(x) for x in ends]
    spark = src.sparkSession
    homes = {r.home: r.key for r in spark.range(40 * n).select(F.col("id").cast("int").alias("key")).groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("home")).agg(F.min("key").alias("key")).collect()}
    keys = [homes.get(i, i) for i in range(len(bounds) + 1)]
    b, steps = F.array(*(F.lit(x).cast("long") for x in ends)), F.sequence(F.lit(1), F.lit(len(ends).bit_length()))

    def halve(s, _):  # the number of bounds below the id, by halving
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = (s["lo"] < s["hi"]) & (F.get(b, mid) < key)
        return F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    src = src.withColumn("at", F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(ends)).alias("hi")), halve, lambda s: s["lo"]))
    below = F.get(F.array(*(F.lit(sum(times[:i])) for i in range(len(ends) + 1))), F.col("at"))
    if max(times) > 1:
        many = F.when(F.get(b, F.col("at")) == key, F.get(F.array(*map(F.lit, times)), F.col("at"))).otherwise(1)
        below = below + F.floor(F.col("tie") / (1 << 32) * many).cast("int")
    src = src.withColumn("part", below).drop("at")
    return src.repartition(n, F.get(F.array(*map(F.lit, keys)), F.col("part")))


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> str:
    """Encode every whole text, append the end id and write (part, doc_id, n_tokens, ids) as ORC under ``path``.

    A null text counts as empty and yields the end id alone.  Rows that repeat
    an id are all written, next to each other, in the order of a hash of their texts; null
    ids come first.  An id may have more rows than a file; the rows of one id and one text share one.
    """
    n = partitions or width(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 32))
    dealt = _deal(src, n).sortWithinPartitions("part", "doc_id", "tie", F.xxhash64("text")).select("part", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = shared_cache(tokenizer_path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for lo, hi in X.slices(X.buffers(batch.column("text"))[1], BLOCK_BYTES):
                part = batch.slice(lo, hi - lo)
                coded = [cache.encode(t) for t in part.column("text").to_pylist()]
                offsets = np.cumsum([0] + [len(c) // 4 + 1 for c in coded], dtype=np.int32)
                flat = np.frombuffer(b"".join([x for c in coded for x in (c, end)]), "<i4")
                yield pa.RecordBatch.from_arrays([part.column("part"), part.column("doc_id"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(offsets, flat)], names=["part", "doc_id", "n_tokens", "ids"])

    dealt.mapInArrow(run, "part int, doc_id long, n_tokens int, ids array<int>").write.options(**ORC_OPTIONS).orc(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows as written; a filter on ``doc_id`` is pushed down to the row indexes and Bloom filters."""
    return spark.read.schema("part int, doc_id long, n_tokens int, ids array<int>").orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: (doc_id, start, n_tokens, ids_crc32).

    ``start`` counts the ids of all documents before it in the files' order: by range, by
    file (a range may have several, numbered as they were written) and by place in the file.  A
    task counts from the start of each file split that it reads, in the order
    of the split's rows.  The splits of a range are summed up in order; the driver gathers one
    total for each range.  The splits' starts are broadcast if they are few, else joined by key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("ids")
            off = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(flat[a:z]) for a, z in zip(off[:-1], off[1:], strict=True)]
            names = batch.column("file").dictionary_encode()
            file, block = names.indices.to_numpy(), batch.column("block").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (file[1:] != file[:-1]) | (block[1:] != block[:-1]))))
            at = np.empty(batch.num_rows, np.int64)
            for lo, hi in zip(cuts, np.append(cuts[1:], batch.num_rows), strict=True):
                key = (names.dictionary[int(file[lo])].as_py(), int(block[lo]))
                base = seen.get(key, 0)
                at[lo:hi] = base + off[lo:hi].astype(np.int64) - int(off[lo])
                seen[key] = base + int(off[hi]) - int(off[lo])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("part", "file", "block", "doc_id")), pa.array(at), pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64())],
                names=["part", "file", "block", "doc_id", "at", "n_tokens", "ids_crc32"],
            )

    # the writer's files of one task differ in the number behind the last dash
    rows = read_tokens(spark, path).select("part", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), "doc_id", "ids")
    rows = cut(rows.mapInArrow(run, "part int, file string, block long, doc_id long, at long, n_tokens long, ids_crc32 long"), "index")
    splits = cut(rows.groupBy("part", "file", "block").agg(F.sum("n_tokens").alias("n")), "splits", 1 + width(spark) // 64)
    total, firsts = 0, []
    for r in splits.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        firsts.append((r.part, total))
        total += r.n
    if not firsts:
        return rows.select("doc_id", F.col("at").alias("start"), "n_tokens", "ids_crc32")
    first = F.get(F.array(*(F.lit(t).cast("long") for _, t in firsts)), F.array_position(F.array(*(F.lit(p) for p, _ in firsts)), F.col("part")).cast("int") - 1)
    order = Window.partitionBy("part").orderBy(F.length("file"), "file", "block")
    starts = splits.select("part", "file", "block", (first + F.sum("n").over(order) - F.col("n")).alias("before"))
    if splits.count() <= BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    return rows.join(starts, ["part", "file", "block"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokens_to_orc(docs: DataFrame, tokenizer_path: str, path: str | None = None, **columns: str) -> DataFrame:
    """Write and read back; see :func:`write_tokens` and :func:`token_index`."""
    spark = docs.sparkSession
    return token_index(spark, write_tokens(docs, tokenizer_path, path or new_path(spark, "tokens"), **columns))
