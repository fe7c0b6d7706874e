"""Text and sequence functions as column expressions: prompts, chat, labels, padding, moves, parsing."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORE = -100
NO_BIN = -1


def render(template: str, values: Mapping[str, Column]) -> Column:
    """A template with {names} filled in; a name without a value is an error. Double braces stand for braces."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{([A-Za-z_][A-Za-z0-9_]*)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        if m[1] is None:
            parts.append(F.lit(m[0][0]))
        elif m[1] not in values:
            raise KeyError(f"the template asks for {m[1]}")
        else:
            parts.append(values[m[1]].cast("string"))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def generation_prompt(prompt: Column, open_user: str = "<user>", close: str = "</turn>", open_reply: str = "<assistant>") -> Column:
    return F.concat(F.lit(open_user), prompt, F.lit(close + open_reply))


def training_chat(prompt: Column, reply: Column, **marks: str) -> Column:
    return F.concat(generation_prompt(prompt, **marks), reply, F.lit(marks.get("close", "</turn>")))


def tag_order(tags: Sequence[str], shuffled: Sequence[str], enabled: bool) -> tuple[str, ...]:
    """The tags, or a given derangement of them."""
    if not enabled:
        return tuple(tags)
    if len(set(tags)) != len(tags) or len(tags) < 2:
        raise ValueError("two or more different tags are needed")
    if sorted(tags) != sorted(shuffled) or any(a == b for a, b in zip(tags, shuffled, strict=True)):
        raise ValueError("the order must move every tag")
    return tuple(shuffled)


def history_block(entries: Column, line) -> Column:
    """A headed block with a line for each history entry, empty without entries."""
    body = F.array_join(F.transform(entries, line), "\n")
    return F.when(F.size(entries) > 0, F.concat(F.lit("\n## History\n"), body)).otherwise(F.lit(""))


def find_sub(values: Column, needle: Column) -> Column:
    """Position (from 0) of the first occurrence of an array in another, -1 if none or if it is empty."""
    last = F.size(values) - F.size(needle)
    at = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(values, i + 1, F.size(needle)) == needle)
    return F.when((F.size(needle) == 0) | (last < 0), -1).otherwise(F.coalesce(F.get(at, F.lit(0)), F.lit(-1)))


def masked_labels(prompt: Column, reply: Column, longest: int) -> Column:
    """Labels of prompt and reply ids: the prompt is ignored; both are cut to ``longest`` from the right."""
    ids = F.concat(F.transform(prompt, lambda _: F.lit(IGNORE)), reply)
    return F.slice(ids, 1, longest)


def bin_labels(ids: Column, needle: Column, bins: Column) -> Column:
    """Bin labels placed where the action's ids first occur, NO_BIN elsewhere."""
    at = find_sub(ids, needle)
    return F.transform(ids, lambda _, i: F.when((at >= 0) & (i >= at) & (i < at + F.size(needle)), F.get(bins, i - at)).otherwise(NO_BIN))


def query_slots(prompt: Column, actions: Column, k: int) -> Column:
    """Multi-token samples: for each action token a slot with its source position and target, in groups of ``k`` behind an anchor."""
    n = F.size(prompt)
    return F.transform(actions, lambda a, i: F.struct((n + F.floor(i / k) * k - 1).cast("int").alias("anchor"), (n + i).cast("int").alias("position"), (i % k).cast("int").alias("offset"), a.alias("target")))


def collate(samples: DataFrame, batch: str, pads: Mapping[str, int]) -> DataFrame:
    """Ragged arrays padded to the longest of their batch; a batch is bounded by its size."""
    w = Window.partitionBy(batch)
    for name, pad in pads.items():
        longest = F.max(F.size(name)).over(w)
        samples = samples.withColumn(f"_{name}", longest)
    for name, pad in pads.items():
        samples = samples.withColumn(name, F.concat(F.col(name), F.array_repeat(F.lit(pad), (F.col(f"_{name}") - F.size(name)).cast("int"))))
    return samples.drop(*(f"_{n}" for n in pads))


def moves(text: Column) -> Column:
    """Moves after the last 'PATH:', none for 'STAY'."""
    up = F.upper(F.trim(text))
    tail = F.trim(F.element_at(F.split(up, F.lit("PATH:")), -1))
    return F.when(F.startswith(tail, F.lit("STAY")), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(tail, F.lit("([UDLR])"), 1))


def single_move(text: Column) -> Column:
    tail = F.element_at(F.split(F.upper(F.trim(text)), F.lit("MOVE:")), -1)
    return F.get(F.regexp_extract_all(tail, F.lit("([UDLR])"), 1), F.lit(0))


def walk(grid: Column, row: Column, col: Column, path: Column) -> Column:
    """(row, col, hit_wall) after moves that stop at the first wall."""
    start = F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"), F.lit(False).alias("hit"))

    def step(at: Column, move: Column) -> Column:
        r = at["row"] + F.when(move == "U", -1).when(move == "D", 1).otherwise(0)
        c = at["col"] + F.when(move == "L", -1).when(move == "R", 1).otherwise(0)
        wall = F.coalesce(F.get(F.get(grid, r), c) == 1, F.lit(True)) | (r < 0) | (c < 0)
        stop = at["hit"] | wall
        return F.struct(F.when(stop, at["row"]).otherwise(r).alias("row"), F.when(stop, at["col"]).otherwise(c).alias("col"), stop.alias("hit"))

    return F.aggregate(path, start, step)


def meminfo(text: Column) -> Column:
    """Map of field to bytes from lines such as 'MemTotal: 16 kB'; other lines are passed over."""
    lines = F.filter(F.transform(F.split(text, F.lit("\n")), lambda s: F.filter(F.split(F.trim(s), F.lit(r"\s+")), lambda x: x != "")), lambda p: (F.size(p) >= 2) & F.endswith(F.get(p, F.lit(0)), F.lit(":")) & F.get(p, F.lit(1)).try_cast("long").isNotNull())
    value = lambda p: F.get(p, F.lit(1)).try_cast("long") * F.when(F.lower(F.get(p, F.lit(2))) == "kb", 1024).otherwise(1)
    return F.map_from_entries(F.transform(lines, lambda p: F.struct(F.rtrim(F.get(p, F.lit(0)), F.lit(":")), value(p))))


GPU_SCHEMA = "index string, name string, memory_used_mib double, memory_total_mib double, utilization_percent double, temperature_c double, power_w double"


def gpu_lines(text: Column) -> Column:
    """Rows of a GPU query in CSV; values that aren't numbers become null."""
    return F.transform(F.filter(F.split(text, F.lit("\n")), lambda s: F.trim(s) != ""), lambda s: _gpu(F.transform(F.split(s, F.lit(",")), lambda v: F.trim(v))))


def _gpu(p: Column) -> Column:
    names = [x.split()[0] for x in GPU_SCHEMA.split(", ")]
    return F.struct(*((F.get(p, F.lit(i)) if i < 2 else F.get(p, F.lit(i)).try_cast("double")).alias(n) for i, n in enumerate(names)))


def percent(c: Column, digits: int = 1) -> Column:
    """A share as text in per cent."""
    return F.concat(F.format_number(F.bround(c * 100, digits), digits), F.lit("%"))


def signed_pp(c: Column) -> Column:
    v = F.bround(c * 100, 1)
    return F.concat(F.when(v >= 0, "+").otherwise(""), F.format_number(v, 1), F.lit(" pp"))


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(1.0))


def range_penalty(c: Column, low: float, high: float) -> Column:
    """How far a value lies outside a range, relative to the range's width."""
    return F.when(c < low, (low - c) / max(high - low, 1e-9)).when(c > high, (c - high) / max(high - low, 1e-9)).otherwise(0.0)


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + b - 1) / b)


def typed_name(path: Column, kind: Column) -> Column:
    """A dataset name with its reward type before the version: name-v3 to name-dense-v3."""
    return F.regexp_replace(path, F.lit(r"^(.*?)(?:-(?:dense|sparse))?-v([0-9]+)$"), F.concat(F.lit("$1-"), kind, F.lit("-v$2")))
