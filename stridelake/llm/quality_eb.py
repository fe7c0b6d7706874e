"""Document quality by a classifier and hierarchical empirical Bayes.

A logistic model over the make-up of a text (shares of character kinds, word
lengths, repetition) gives each document's evidence.  Hosts and the paths under
them carry a beta posterior of their share of good documents: a path shrinks
towards its host, a host towards the corpus, each with a strength estimated from
how much the sites differ beyond chance.  A document's log-odds
are its own evidence plus the shift of its path's posterior against the corpus.
The posteriors that move a document are those without it (path, host and corpus less its own
evidence), so its evidence counts once and a site of one document adds what its host tells, or nothing.
Where sites don't differ, strengths grow without bound and the shift is nothing.

The classifier is fitted on at most ``SAMPLE`` labelled rows; everything else
(shares, strengths, posteriors) is computed over all documents, by grouped sums
that combine on the map side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.llm import _text as X
from stridelake.llm._store import cut, gathered

SAMPLE = 20_000
THRESHOLD = 0.3  # a document goes only if it is rather sure to be bad
STRONGEST = 1e6
BLOCK_BYTES = 2 << 20

#: The kinds of bytes that are counted.
_KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\x0b\x0c\r", b"!?", b"|", b"#$%&*@^~=_+<>{}[]\\/`", b".,;:'\"()-")
_KIND = np.full(256, len(_KINDS), np.uint8)
for _i, _chars in enumerate(_KINDS):
    _KIND[list(_chars)] = _i
N_KINDS = len(_KINDS) + 1
NAMES = ("lower", "upper", "digit", "space", "newline", "shout", "bar", "symbol", "mark", "other", "words", "word_length", "distinct", "long_words", "top_word", "lines", "echo")
WIDTH = 2 * len(NAMES)


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers for each text; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * N_KINDS + _KIND[raw], minlength=n * N_KINDS).reshape(n, N_KINDS).astype(float)
    starts, ends, h, first = X.words(raw, offsets)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    length = (ends - starts).astype(float)
    order = np.lexsort((h, owner))
    ho, oo = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, oo[new], runs)
    some = np.maximum(count, 1)
    out = np.column_stack(
        [
            kinds / np.maximum(size, 1)[:, None],
            np.log1p(count),
            np.log1p(np.bincount(owner, length, n) / some),
            np.bincount(oo[new], minlength=n) / some,
            np.bincount(owner, length > 20, n) / some,
            top / some,
            np.log1p(kinds[:, 4]),
            np.bincount(owner[1:], (h[1:] == h[:-1]) & (owner[1:] == owner[:-1]), n) / some if len(h) else np.zeros(n),
        ]
    )
    return np.column_stack([out, np.sqrt(out)])


def fit(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1e-2) -> dict[str, np.ndarray]:
    """Newton steps of a ridge logistic model on standardised columns; class weights are even."""
    if not len(y) or y.min() == y.max():
        lean = 4.0 if not len(y) or y.min() == 1 else -4.0  # one class only: nothing to tell apart
        return {"mean": np.zeros(WIDTH), "scale": np.ones(WIDTH), "w": np.zeros(WIDTH), "b": np.float64(lean)}
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge * len(y))
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - penalty * w
        hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
        w += np.linalg.solve(hess, g)
    return {"mean": mean, "scale": scale, "w": w[:-1], "b": w[-1]}


def logits(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    return np.clip((z * model["w"]).sum(axis=1) + model["b"], -12, 12)  # row by row the same whatever the other rows are


def _blocks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        raw, offsets = X.buffers(batch.column("text"))
        for lo, hi in X.slices(offsets, BLOCK_BYTES):
            o = offsets[lo : hi + 1]
            yield batch.slice(lo, hi - lo), features(raw[o[0] : o[-1]], o - o[0])


def train(src: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Fit on at most ``sample`` labelled rows, the first by a hash of their id."""
    picked = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column("quality"), pa.array([v.tobytes() for v in x], pa.binary())], names=["quality", "x"])

    chosen = src.select(F.col("id").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select(F.col("quality").cast("int").alias("quality"), "text")
    got = chosen.mapInArrow(run, "quality int, x binary").collect()
    x = np.array([np.frombuffer(r.x) for r in got]).reshape(-1, WIDTH)
    return fit(x, np.array([1.0 if r.quality > 0 else 0.0 for r in got]))


def _strength(groups: DataFrame, mean: Column, total: float) -> float:
    """Prior weight by the method of moments: how far group shares spread beyond chance."""
    m = mean
    spread = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - m, 2)).alias("between"), F.sum(m * (1 - m)).alias("chance"), F.sum(m * (1 - m) * F.col("n")).alias("unit"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / total).alias("n2")
    ).first()
    if not spread.n or not spread.unit:
        return STRONGEST
    # E[between] = chance + rho * (unit - chance), with rho = 1 / (strength + 1)
    rho = (spread.between - spread.chance) / max(spread.unit - spread.chance, 1e-12)
    return float(min(STRONGEST, max(1.0, 1 / rho - 1))) if rho > 1 / STRONGEST else STRONGEST


def score(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = THRESHOLD, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return per row (id, fp, host, path, p_doc, p_host, p_path, p_quality, kept).

    ``p_host`` and ``p_path`` are the sites' posteriors over all their documents; ``p_quality`` uses
    those without the document itself.  ``host`` defaults to ``source`` and ``path`` to ``lang`` under it; nulls
    are a site of their own.  A null or empty text has no evidence of its own making and
    gets the classifier's verdict on zeros.  Ids may be null or repeated: rows are judged one by one.
    Labelled ids that are missing or repeated do no harm (the lowest label counts); without
    labels of both kinds every document is kept.  ``fp`` is a hash of the text.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    model = src.sparkSession.sparkContext.broadcast(train(src, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _blocks(batches):
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("id", "fp", "host", "path")), pa.array(logits(model.value, x))], names=["id", "fp", "host", "path", "logit"])

    told = src.select("id", F.xxhash64("text").alias("fp"), "host", "path", "text").mapInArrow(run, "id long, fp long, host string, path string, logit double")
    told = cut(told.withColumn("p_doc", 1 / (1 + F.exp(-F.col("logit")))), "evidence")
    paths = cut(gathered(told.groupBy("host", "path").agg(F.sum("p_doc").alias("s"), F.count(F.lit(1)).alias("n")), told.count()), "paths")
    whole = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    total = float(whole.n or 0)
    base = min(max((whole.s or 0.0) / total if total else 0.5, 1e-6), 1 - 1e-6)
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s_host"), F.sum("n").alias("n_host"))
    k_host = _strength(hosts.select(F.col("s_host").alias("s"), F.col("n_host").alias("n")), F.lit(base), max(total, 1.0))
    paths = paths.join(hosts, "host")
    above = (F.lit(k_host * base) + F.col("s_host")) / (F.lit(k_host) + F.col("n_host"))
    k_path = _strength(paths.select("s", "n", above.alias("p_host")), F.col("p_host"), max(total, 1.0))
    sites = cut(paths, "sites")  # joined without a hint: of a hot site only the evidence side grows, which adaptive execution splits
    out = told.join(sites, ["host", "path"])
    rest = min(max((whole.s or 0.0), 0.0), total), max(total - 1, 1.0)
    odds = lambda p: F.log(p / (1 - p))
    inside = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    b = inside((F.lit(rest[0]) - F.col("p_doc")) / F.lit(rest[1])) if total > 1 else F.lit(base)
    host_less = inside((F.lit(k_host) * b + F.col("s_host") - F.col("p_doc")) / (F.lit(k_host) + F.col("n_host") - 1))
    path_less = inside((F.lit(k_path) * F.col("h") + F.col("s") - F.col("p_doc")) / (F.lit(k_path) + F.col("n") - 1))
    out = out.withColumn("b", b).withColumn("h", host_less).withColumn("q", path_less)
    out = out.withColumn("p_host", above).withColumn("p_path", (F.lit(k_path) * F.col("p_host") + F.col("s")) / (F.lit(k_path) + F.col("n")))
    out = out.withColumn("p_quality", 1 / (1 + F.exp(-(F.col("logit") + odds(F.col("q")) - odds(F.col("b"))))))
    return out.select(F.col("id").alias(id_col), "fp", "host", "path", "p_doc", "p_host", "p_path", "p_quality", (F.col("p_quality") >= threshold).alias("kept"))
