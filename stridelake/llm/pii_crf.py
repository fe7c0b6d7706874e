"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans.  The field then labels the suspect tokens of
a whole document (tokens with a digit or an ``@``; all others are clamped to
"outside").  Neighbouring suspect tokens share a chain potential.  A token also
shares a skip potential with the next token, however distant, that repeats it
and with the next one of the same shape, so evidence for one occurrence reaches
the others.  Marginals come from damped loopy message passing, run over all
documents of an Arrow batch at once, each until its messages stand still, so evidence
crosses a whole document and no document depends on the others of its batch.  Confident spans that touch no base span
are added.  Edges grow with the number of suspect tokens, never with its square.

The weights are fitted by likelihood gradients, with the same message passing,
on a bounded sample of documents.  Labels come from the base spans; from context: long mixed
tokens behind a word such as ``token`` or ``key`` are secrets (the word is no feature, so secrets are found
without it too); and from copies of the sample in which addresses and card numbers are written in
forms that the patterns don't match.  So the field adds secrets and such forms.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds and the patterns of the base spans.
KINDS = ("email", "ip", "card", "phone")
_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a leftmost match never starts inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

ALL_KINDS = (*KINDS, "secret")
SECRET = len(KINDS)
LABELS = 1 + len(ALL_KINDS)
#: Words before a secret.
_CONTEXT = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|key|auth|bearer|credential)s?[\"']?\s*(?:=>|:=|[=:])?\s*[\"']?\Z")
LEAST_SECRET = 16
SAMPLE_DOCS = 600
LONGEST_SAMPLE = 20_000  # bytes of a sampled text
ROUNDS = 60  # and two for each suspect token: in so many rounds the largest change halves, or the step does
DAMPING = 0.3
TOLERANCE = 1e-7  # largest change of a log message that stands still
LEAST_STEP = 1e-3  # messages that circle even at this step are taken as they are
CONFIDENCE = 0.9
_LOCAL_SET = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches, leftmost and non-overlapping within a kind, by start and kind."""
    found = []
    if "@" in text:
        free = 0
        for m in _TAIL.finditer(text):  # an address is its tail and the run of local characters before it
            s = at = m.start()
            while s > free and text[s - 1] in _LOCAL_SET:
                s -= 1
            if s < at:
                found.append((s, 0, m.end()))
                free = m.end()
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    found.sort()
    return found


def suspects(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens with a digit or an ``@``; all others are outside for certain."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    out = []
    for at in _hits(text):
        s = e = at
        while s > 0 and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        out.append((s, e))
    return out


_HIT = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")


def _hits(text: str) -> Iterator[int]:
    """The first suspect character of each token that has one."""
    m = _HIT.search(text)
    while m:
        yield m.start()
        gap = _SPACE.search(text, m.end())
        if not gap:
            return
        m = _HIT.search(text, gap.end())


def _features(token: str) -> list[int]:
    """Numbers of the features that hold: presence and counts of character kinds."""
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    dots = token.count(".")
    on = [0, 1 + min(9, digits // 2), 11 + min(4, dots), 16 + min(3, letters // 4), 20 + min(4, len(token) // 8)]
    for k, hit in enumerate(("@" in token, token.startswith("+"), "(" in token, "-" in token, letters == 0, digits > letters, any(c in "#$%&*" for c in token), "@" in token and "." in token.partition("@")[2])):
        if hit:
            on.append(25 + k)
    kinds = ["9" if "0" <= c <= "9" else "a" for c in token if c.isalnum()]
    on.append(33 + min(4, sum(a != b for a, b in zip(kinds, kinds[1:])) // 3))  # how often letters and digits change places
    if "[" in token:
        on.append(38)
    return on


FEATURES = 39


def _key(kind: str, text: str) -> str:
    """The text itself, or its digest if that is shorter."""
    return kind + (text if len(text) <= 64 else "#" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())


def _shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in token))


class Graph:
    """Suspect tokens of several documents with their chain and skip edges."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int, int]] = []  # document number, start, end
        self.rows: list[int] = []
        self.cols: list[int] = []
        self.edges: tuple[list, list] = ([], [])

    def add(self, doc: int, text: str) -> None:
        last: dict[str, int] = {}
        prev = prev_end = -1
        for s, e in suspects(text):
            i, token = len(self.spans), text[s:e]
            self.spans.append((doc, s, e))
            on = _features(token)
            self.rows += [i] * len(on)
            self.cols += on
            if prev >= 0 and s - prev_end <= 2:
                self.edges[0].append((prev, i))
            for key in (_key("=", token.strip(".,;:!?#$%&*()|").lower()), _key("~", _shape(token))):
                if (j := last.get(key, -1)) >= 0:
                    self.edges[1].append((j, i))
                last[key] = i
            prev, prev_end = i, e

    def arrays(self):
        x = (np.array(self.rows, np.int64), np.array(self.cols, np.int64))
        return x, [np.array(e, np.int64).reshape(-1, 2) for e in self.edges]


def _norm(m: np.ndarray) -> np.ndarray:
    m = m - m.max(axis=1, keepdims=True)
    return m - np.log(np.exp(m).sum(axis=1, keepdims=True))


def _send(m: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log messages over edges of potential ``t``; row by row the same whatever the other rows are."""
    e, t = np.exp(m - m.max(axis=1, keepdims=True)), np.exp(t - t.max())
    s = sum(e[:, k : k + 1] * t[k] for k in range(LABELS))
    return np.log(s / sum(s[:, k : k + 1] for k in range(LABELS)))


def marginals(weights: dict[str, np.ndarray], graph: Graph):
    """Loopy message passing: marginals of the nodes, and of the edges by kind."""
    (r, c), edges = graph.arrays()
    n = len(graph.spans)
    unary = np.zeros((n, LABELS))
    np.add.at(unary, r, weights["node"][c])
    sides = [(e[:, 0], e[:, 1], t) for e, t in zip(edges, (weights["chain"], weights["skip"]), strict=True)]
    fwd, back = ([np.zeros((len(a), LABELS)) for a, _, _ in sides] for _ in range(2))
    doc = np.unique([d for d, _, _ in graph.spans], return_inverse=True)[1]
    size = np.bincount(doc)
    step, mark, due = np.full(len(size), 1 - DAMPING), np.full(len(size), np.inf), ROUNDS + 2 * size
    live = [np.arange(len(a)) for a, _, _ in sides]
    at = 0
    while any(map(len, live)):
        belief, change = unary.copy(), np.zeros(len(size))
        for (a, b, _), f, g, x in zip(sides, fwd, back, live, strict=True):
            np.add.at(belief, b[x], f[x])
            np.add.at(belief, a[x], g[x])
        for (a, b, t), f, g, x in zip(sides, fwd, back, live, strict=True):
            if len(x):
                out = _send(belief[a[x]] - g[x], t) - f[x]
                rev = _send(belief[b[x]] - f[x], t.T) - g[x]
                np.maximum.at(change, doc[a[x]], np.maximum(np.abs(out).max(axis=1), np.abs(rev).max(axis=1)))
                by = step[doc[a[x]]][:, None]
                f[x] += by * out
                g[x] += by * rev
        at += 1
        ends = due == at
        step[ends & (change > mark / 2)] /= 2
        mark[ends], due[ends] = change[ends], at + ROUNDS + 2 * size[ends]
        moving = (change > TOLERANCE) & (step >= LEAST_STEP)
        live = [x[moving[doc[a[x]]]] for (a, _, _), x in zip(sides, live, strict=True)]
    belief = unary.copy()
    for (a, b, _), f, g in zip(sides, fwd, back, strict=True):
        np.add.at(belief, b, f)
        np.add.at(belief, a, g)
    pairs = []
    for k, (a, b, t) in enumerate(sides):
        p = (belief[a] - back[k])[:, :, None] + t[None] + (belief[b] - fwd[k])[:, None, :]
        p = np.exp(p - p.max(axis=(1, 2), keepdims=True)) if len(a) else p
        pairs.append(p / p.sum(axis=(1, 2), keepdims=True) if len(a) else p)
    return np.exp(_norm(belief)) if n else belief, pairs


def context_secrets(text: str) -> list[tuple[int, int, int]]:
    """Long tokens of letters and digits behind a word that announces a secret."""
    out = []
    for s, e in suspects(text):
        a, z = _core(text, s, e)
        core = text[a:z]
        if len(core) >= LEAST_SECRET and core.replace("-", "").replace("_", "").isalnum() and any(c.isalpha() for c in core) and any(c.isdigit() for c in core) and _CONTEXT.search(text, max(0, a - 40), a):
            out.append((a, SECRET, z))
    return out


def disguised(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its IP addresses and card numbers in forms that the patterns don't match, and all labels."""
    out, spans, at, size = [], [], 0, 0
    for s, k, e in sorted(base_spans(text) + context_secrets(text)):
        if s < at:
            continue
        piece = text[s:e]
        if k == 1:
            piece = piece.replace(".", "[.]")
        elif k == 2:
            d = re.sub("[^0-9]", "", piece)
            piece = ".".join(d[i : i + 4] for i in range(0, len(d), 4))
        out += [text[at:s], piece]
        size += s - at
        spans.append((size, k, size + len(piece)))
        size, at = size + len(piece), e
    return "".join([*out, text[at:]]), spans


def fit(texts: list[str], steps: int = 120, rate: float = 0.5, decay: float = 1e-3) -> dict[str, np.ndarray]:
    """Weights that maximise the likelihood of the sample's labels, by gradient ascent."""
    graph = Graph()
    by_doc: list[list[tuple[int, int, int]]] = []
    for text in texts:
        other, spans = disguised(text)
        for t, labels in ((text, base_spans(text) + context_secrets(text)), *([(other, spans)] if other != text else [])):
            graph.add(len(by_doc), t)
            by_doc.append(labels)
    gold = np.zeros(len(graph.spans), np.int64)
    for i, (d, s, e) in enumerate(graph.spans):
        gold[i] = next((1 + k for a, k, z in by_doc[d] if a < e and s < z), 0)
    w = {"node": np.zeros((FEATURES, LABELS)), "chain": np.zeros((LABELS, LABELS)), "skip": np.zeros((LABELS, LABELS))}
    w["node"][0, 0] = 2.0  # with nothing to learn from, every token is outside
    if not len(gold):
        return w
    (r, c), edges = graph.arrays()
    seen = {"node": np.zeros((FEATURES, LABELS)), "chain": np.zeros((LABELS, LABELS)), "skip": np.zeros((LABELS, LABELS))}
    np.add.at(seen["node"], (c, gold[r]), 1)
    for name, e in zip(("chain", "skip"), edges, strict=True):
        np.add.at(seen[name], (gold[e[:, 0]], gold[e[:, 1]]), 1)
    speed = {k: np.full(v.shape, 1e-8) for k, v in w.items()}
    for _ in range(steps):
        p, pairs = marginals(w, graph)
        want = {"node": np.zeros((FEATURES, LABELS)), "chain": pairs[0].sum(axis=0), "skip": pairs[1].sum(axis=0)}
        np.add.at(want["node"], c, p[r])
        for k in w:
            g = (seen[k] - want[k]) / len(gold) - decay * w[k]
            speed[k] += g * g
            w[k] += rate * g / np.sqrt(speed[k])
    return w


def _core(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and text[s] in ".,;:!?#$%&*()|<>\"'":
        s += 1
    while e > s and text[e - 1] in ".,;:!?#$%&*()|<>\"'":
        e -= 1
    return s, e


def label_batch(weights: dict[str, np.ndarray], texts: list[str]) -> list[tuple[list, list]]:
    """For each text its base spans and all spans, as (start, kind, end) in order."""
    graph, out = Graph(), []
    for d, text in enumerate(texts):
        base = base_spans(text)
        out.append((base, list(base)))
        graph.add(d, text)
    if graph.spans:
        p, _ = marginals(weights, graph)
        best = p.argmax(axis=1)
        for i in np.flatnonzero((best > 0) & (p.max(axis=1) >= CONFIDENCE)):
            d, s, e = graph.spans[i]
            s, e = _core(texts[d], s, e)
            base, spans = out[d]
            if s < e and not any(a < e and s < z for a, _, z in base):
                spans.append((s, int(best[i]) - 1, e))
        for _, spans in out:
            spans.sort()
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for s, k, e in spans)


BLOCK_CHARS = 2_000_000


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Return per row (id, n_email, n_ip, n_card, n_phone, base_sha256, spans).

    Counts and digest are those of the base spans; ``spans`` has all of them, with added ones of the
    base kinds and of the kind ``secret``.
    Offsets are code points, ends exclusive.  A null text counts as empty; an
    empty text, or one without suspect tokens, has no spans and the digest of
    the empty string.  Rows are independent: repeated ids and null ids give one
    result a row.  The field is fitted on at most ``sample_docs`` rows with a
    digit or an ``@`` and fewer than ``LONGEST_SAMPLE`` bytes, the first in the order of
    a hash of id and text; with none, it adds nothing.  All rows are labelled.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = src.sparkSession
    named = src.filter(F.col("text").rlike("[0-9@]") & (F.octet_length("text") < LONGEST_SAMPLE)).select("text", F.xxhash64("id", "text").alias("h"))
    first = named.select("h").orderBy("h").limit(sample_docs).collect()  # the numbers of the sample, then its texts
    chosen = named.join(F.broadcast(spark.createDataFrame([tuple(r) for r in first], "h long").distinct()), "h") if first else named.limit(0)
    picked = sorted({(r.h, r.text) for r in chosen.groupBy("h").agg(F.min("text").alias("text")).collect()})[:sample_docs]
    weights = spark.sparkContext.broadcast(fit([text for _, text in picked]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            lo = 0
            while lo < len(texts):
                part, size, hi = [], 0, lo
                while hi < len(texts) and (not part or size < BLOCK_CHARS):
                    part.append(texts[hi].as_py())
                    size += len(part[-1])
                    hi += 1
                found = label_batch(weights.value, part)
                base = [_joined(b) for b, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), *(pa.array([sum(x[1] == k for x in b) for b, _ in found], pa.int64()) for k in range(len(KINDS))), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array([_joined(s) for _, s in found])],
                    names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )
                lo = hi

    out = src.mapInArrow(run, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
