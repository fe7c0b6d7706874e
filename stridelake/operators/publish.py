"""Corpora as folders of any store that Spark reaches: contracts, staged merges, atomic names, and small text artifacts."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.operators.corpus import canonical_json, content_hash, duplicate_keys

MANIFEST = "manifest.json"
#: The counters of a manifest; everything else is its contract.
COUNTERS = {"complete": False, "generated_map_count": 0, "total_episodes": 0, "total_steps": 0, "content_hash": None}


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_empty(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return not fs.exists(p) or (fs.getFileStatus(p).isDirectory() and not fs.listStatus(p))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Give a finished folder or file its name; an existing name is an error."""
    fs, p = _at(spark, new)
    if fs.exists(p):
        raise FileExistsError(new)
    fs.mkdirs(p.getParent())
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(old), p):
        raise OSError(f"{old} can't be renamed to {new}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text under another name and rename it, so readers see the old text or the new one, never a part."""
    fs, p = _at(spark, path)
    fs.mkdirs(p.getParent())
    staged = f"{path.rpartition('/')[0]}/_{p.getName()}.{uuid.uuid4().hex}"
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(staged), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    uri = spark._jvm.java.net.URI.create(path) if "://" in path or path.startswith("file:") else None
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(*([uri] if uri else []), spark._jsc.hadoopConfiguration())
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), p, options)


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n")


def append_jsonl(spark: SparkSession, folder: str, rows: DataFrame) -> None:
    """Append records to a log, a folder of JSON lines; stores without appends take new files, and a failed job leaves none."""
    rows.write.mode("append").json(folder)


def _scalar(x: Any) -> str:
    return json.dumps(x, ensure_ascii=True) if x is None or isinstance(x, (bool, int, float, str)) else json.dumps(str(x))


def to_yaml(value: Any, depth: int = 0) -> str:
    """Block YAML of nested mappings and lists, keys in their order; strings are quoted, so they are read back as strings."""
    pad = "  " * depth
    if isinstance(value, Mapping):
        items = [(f"{pad}{k if re.fullmatch('[A-Za-z_][A-Za-z0-9_]*', str(k)) else _scalar(str(k))}:", v) for k, v in value.items()]
    elif isinstance(value, (list, tuple)):
        items = [(f"{pad}-", v) for v in value]
    else:
        return f"{pad}{_scalar(value)}\n"
    if not items:
        return pad + ("{}" if isinstance(value, Mapping) else "[]") + "\n"
    return "".join(f"{head}\n{to_yaml(v, depth + 1)}" if isinstance(v, (Mapping, list, tuple)) else f"{head} {_scalar(v)}\n" for head, v in items)


def write_yaml(spark: SparkSession, path: str, value: Any) -> None:
    write_text(spark, path, to_yaml(value))


def contract_of(manifest: Mapping[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in manifest.items() if k not in COUNTERS and not k.startswith("expected_")}


def open_corpus(spark: SparkSession, root: str, name: str, contract: Mapping[str, Any], expected: Mapping[str, int], overwrite: bool = False) -> dict[str, Any]:
    """Create a corpus, or resume one that has exactly this contract.

    A folder whose contract differs, or that has files but no manifest, is an error.  ``overwrite`` empties a folder
    of the derived name only.
    """
    path, manifest = root.rstrip("/"), f"{root.rstrip('/')}/{MANIFEST}"
    if overwrite and exists(spark, path):
        if path.rpartition("/")[2] != name:
            raise ValueError(f"{path} isn't named {name}; it is not overwritten")
        remove(spark, path)
    if exists(spark, manifest):
        found = json.loads(read_text(spark, manifest))
        if canonical_json(contract_of(found)) != canonical_json(dict(contract)):
            raise ValueError("the corpus has another contract")
        return found
    if not is_empty(spark, path):
        raise FileExistsError(f"{path} has files but no manifest")
    made = {**contract, **COUNTERS, **{f"expected_{k}": int(v) for k, v in expected.items()}}
    write_json(spark, manifest, made)
    return made


def append_shard(spark: SparkSession, root: str, shard: DataFrame, keys: Sequence[str], batch: str) -> int:
    """Append a shard to a corpus as the transaction ``batch``; returns the rows it added.

    A batch that is there already adds nothing, so a step that is repeated after a failure is harmless.
    Keys that another batch has are an error.
    """
    data = f"{root.rstrip('/')}/data"
    home = f"{data}/batch={batch}"
    if exists(spark, home):
        return 0
    if duplicate_keys(shard, keys).limit(1).count():
        raise ValueError("keys repeat within the shard")
    if not is_empty(spark, data) and shard.join(spark.read.parquet(data).select(*keys), list(keys), "left_semi").limit(1).count():
        raise ValueError("keys exist already")
    staged = f"{root.rstrip('/')}/_staged/{uuid.uuid4().hex}"
    try:
        shard.write.parquet(staged)
        n = spark.read.parquet(staged).count()
        rename(spark, staged, home)
    finally:
        remove(spark, staged)
    return n


def close_corpus(spark: SparkSession, root: str, group: str, key: str, line: Any, steps: str) -> dict[str, Any]:
    """Count a corpus, hash its contents and mark it complete; too few episodes are an error."""
    path = f"{root.rstrip('/')}/{MANIFEST}"
    manifest, data = json.loads(read_text(spark, path)), spark.read.parquet(f"{root.rstrip('/')}/data")
    t = data.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("groups"), F.sum(steps).alias("steps")).first()
    if t.n != manifest.get("expected_episode_count", t.n):
        raise ValueError(f"{t.n} episodes of {manifest['expected_episode_count']}")
    hashed = content_hash(data.withColumn("_all", F.lit(0)), "_all", key, line).first().content_hash
    done = manifest | {"complete": True, "generated_map_count": t.groups, "total_episodes": t.n, "total_steps": int(t.steps or 0), "content_hash": hashed}
    write_json(spark, path, done)
    return done


def publish_merged(spark: SparkSession, shards: Sequence[str], final: str, keys: Sequence[str]) -> int:
    """Merge shard folders in a workspace beside the final name, then expose it whole; returns the rows.

    An existing final folder, a missing shard and repeated keys are errors; the workspace goes in any case.
    """
    if exists(spark, final):
        raise FileExistsError(final)
    for s in shards:
        if not exists(spark, s):
            raise FileNotFoundError(s)
    parent, _, name = final.rstrip("/").rpartition("/")
    work = f"{parent}/_{name}.publishing-{uuid.uuid4().hex}"
    try:
        spark.read.parquet(*shards).write.parquet(work)
        merged = spark.read.parquet(work)
        if duplicate_keys(merged, keys).limit(1).count():
            raise ValueError("keys repeat over the shards")
        n = merged.count()
        rename(spark, work, final)
    finally:
        remove(spark, work)
    return n


def remove_shard(spark: SparkSession, name: str, path: str, within: str) -> None:
    """Remove one temporary shard, only if it has the name expected and lies below ``within``."""
    fs, p = _at(spark, path)
    home = fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(within)).toString().rstrip("/")
    if p.getName() != name or not fs.makeQualified(p).toString().startswith(home + "/") or ".." in path.split("/"):
        raise ValueError(f"{path} isn't the shard {name} below {within}")
    remove(spark, path)
