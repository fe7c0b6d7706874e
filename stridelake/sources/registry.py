"""Extension points: families of environments, with loaders, transforms and formatters, and layered settings."""

from __future__ import annotations

import copy
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

Loader = Callable[[SparkSession, str], DataFrame]
Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Family:
    """What the engine needs to know of one family of environments."""

    name: str
    action_dim: int
    variants: Mapping[str, Mapping[str, Any]]
    load: Loader
    transform: Transform | None = None
    format_observation: Callable[[Column], Column] | None = None
    format_action: Callable[[Column], Column] | None = None
    position_goal: Callable[[Column], tuple[Column, Column]] | None = None
    extra: Mapping[str, Any] = field(default_factory=dict)


_FAMILIES: dict[str, Family] = {}


def register(family: Family) -> None:
    if family.name in _FAMILIES:
        raise ValueError(f"{family.name} is registered already")
    _FAMILIES[family.name] = family


def family(name: str) -> Family:
    if name not in _FAMILIES:
        raise KeyError(f"unknown family {name}; known: {sorted(_FAMILIES)}")
    return _FAMILIES[name]


def load_variants(spark: SparkSession, name: str, variants: Sequence[str]) -> DataFrame:
    """Episodes of several variants of a family, transformed and put together."""
    f, out = family(name), None
    for v in variants:
        if v not in f.variants:
            raise KeyError(f"unknown variant {v} of {name}")
        df = f.load(spark, v)
        df = f.transform(df) if f.transform else df
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no variants")
    return out


def variant_table(spark: SparkSession, name: str, facts: Sequence[str]) -> DataFrame:
    """The facts of a family's variants as a small dimension table of strings."""
    f = family(name)
    rows = [(v, *(None if d.get(k) is None else str(d[k]) for k in facts)) for v, d in sorted(f.variants.items())]
    return spark.createDataFrame(rows, "variant string, " + ", ".join(f"{k} string" for k in facts))


def merge_settings(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Layered settings: mappings are merged, lists and other values replaced."""
    out = copy.deepcopy(dict(base))
    for k, v in over.items():
        both = isinstance(v, Mapping) and isinstance(out.get(k), Mapping)
        out[k] = merge_settings(out[k], v) if both else copy.deepcopy(v)
    return out


def drop_setting(settings: Mapping[str, Any], path: str) -> dict[str, Any]:
    """Settings without the key at a dotted path; a missing key is no error."""
    head, _, rest = path.partition(".")
    out = copy.deepcopy(dict(settings))
    if rest and isinstance(out.get(head), Mapping):
        out[head] = drop_setting(out[head], rest)
    elif not rest:
        out.pop(head, None)
    return out
