"""Action codecs and likelihoods as column expressions."""

from __future__ import annotations

from math import lgamma, log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_bin(v: Column, n: int, low: float = -1.0, high: float = 1.0) -> Column:
    """Bin of a value: clipped, scaled, rounded half to even, clipped again."""
    x = F.least(F.greatest(v.cast("double"), F.lit(low)), F.lit(high))
    return F.least(F.greatest(F.rint((x - low) / (high - low) * (n - 1)), F.lit(0.0)), F.lit(float(n - 1))).cast("int")


def from_bin(b: Column, n: int, low: float = -1.0, high: float = 1.0) -> Column:
    return low + b.cast("double") / (n - 1) * (high - low)


def token_width(n: int) -> int:
    return max(2, len(str(n - 1)))


def bin_tokens(action: Column, n: int) -> Column:
    """An action as bin tokens, as <act_007>."""
    w = token_width(n)
    return F.array_join(F.transform(action, lambda v: F.concat(F.lit("<act_"), F.lpad(to_bin(v, n).cast("string"), w, "0"), F.lit(">"))), "")


def parse_bin_tokens(text: Column, dims: int, n: int) -> Column:
    """(action, ok): the first ``dims`` tokens; too few, or a bin that doesn't exist, give zeros and false."""
    found = F.transform(F.slice(F.regexp_extract_all(text, F.lit(f"<act_([0-9]{{{token_width(n)},}})>"), 1), 1, dims), lambda s: s.try_cast("int"))
    ok = (F.size(found) == dims) & F.forall(found, lambda b: F.coalesce(b < n, F.lit(False)))
    zeros = F.array_repeat(F.lit(0.0), dims)
    return F.struct(F.when(ok, F.transform(found, lambda b: from_bin(b, n))).otherwise(zeros).alias("action"), ok.alias("ok"))


def action_text(action: Column) -> Column:
    """Hundredths, rounded half to even and clipped to [-100, 100], joined by commas."""
    return F.array_join(F.transform(action, lambda v: F.least(F.greatest(F.rint(v * 100), F.lit(-100.0)), F.lit(100.0)).cast("int").cast("string")), ",")


def parse_action(text: Column, dims: int) -> Column:
    """(action, ok) from the first run of ``dims`` whole numbers joined by commas."""
    number = r"[-+]?[0-9]+"
    first = F.regexp_extract(text, "(" + r"\s*,\s*".join([number] * dims) + ")", 1)
    values = F.transform(F.split(first, F.lit(",")), lambda s: F.trim(s).try_cast("int").cast("double") / 100.0)
    ok = (first != "") & (F.size(values) == dims) & F.forall(values, lambda v: v.isNotNull())
    return F.struct(F.when(ok, values).otherwise(F.array_repeat(F.lit(0.0), dims)).alias("action"), F.coalesce(ok, F.lit(False)).alias("ok"))


def valid_action(action: Column, dims: int, slack: float = 0.0) -> Column:
    """Right length, finite, and within [-1, 1] up to a slack."""
    fine = F.forall(action, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= -1.0 - slack) & (v <= 1.0 + slack))
    return F.coalesce((F.size(action) == dims) & fine, F.lit(False))


def soft_targets(b: Column, n: int, sigma: float, radius: int | None = None) -> Column:
    """Gaussian weights of all bins around one, or of a window around it, summing to 1."""
    w = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.exp(-((i - b) * (i - b)) / (2.0 * sigma * sigma)) if radius is None else F.when(F.abs(i - b) <= radius, F.exp(-((i - b) * (i - b)) / (2.0 * sigma * sigma))).otherwise(0.0))
    s = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    return F.transform(w, lambda x: x / s)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    s = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / s)


def greedy_l1(logits: Column, label: Column, n: int) -> Column:
    """Distance in action space between the best bin (the first of equals) and the label's bin."""
    best = F.array_position(logits, F.array_max(logits)) - 1
    return F.abs(from_bin(best, n) - from_bin(label, n))


def student_t_nll(target: Column, mean: Column, log_scale: Column, df: float) -> Column:
    """Negative log-likelihood of a Student t; the degrees of freedom are a parameter, so the gamma terms are constants."""
    z = (target - mean) / F.exp(log_scale)
    const = 0.5 * (log(df) + log(pi)) + lgamma(0.5 * df) - lgamma(0.5 * (df + 1.0))
    return log_scale + const + 0.5 * (df + 1.0) * F.log1p(z * z / df)


def squashed_gaussian_nll(action: Column, mean: Column, log_std: Column, eps: float = 1e-6) -> Column:
    """Negative log-likelihood of a Gaussian squashed by tanh, the action clipped into the open interval."""
    a = F.least(F.greatest(action, F.lit(-1.0 + eps)), F.lit(1.0 - eps))
    z = (F.atanh(a) - mean) / F.exp(log_std)
    return 0.5 * (z * z + 2.0 * log_std + log(2.0 * pi)) + F.log1p(-a * a + eps)
