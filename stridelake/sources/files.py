"""File sources and sinks: path rules, JSON artifacts, run discovery, signed caches, logs, and optional HDF5."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.operators.corpus import signature

#: Schema of an episode as one row.
EPISODE_SCHEMA = (
    "variant string, episode_idx int, observations array<array<float>>, actions array<array<float>>, rewards array<float>, terminations array<boolean>, truncations array<boolean>, success array<boolean>"
)


def dataset_path(path: str, root: str | None = None, reward: str | None = None, default_reward: str = "sparse") -> str:
    """Where a dataset lies: under a root if it is relative, named by its reward type unless that is the default."""
    if reward and reward != default_reward:
        m = re.fullmatch(r"(.*?)(?:-(?:dense|sparse))?-v([0-9]+)", path)
        if not m:
            raise ValueError(f"{path} has no version to put a reward type before")
        path = f"{m[1]}-{reward}-v{m[2]}"
    return path if root is None or re.match(r"(/|[a-z0-9]+://)", path) else f"{root.rstrip('/')}/{path}"


def check_reward_type(declared: str | None, spec_json: str | None, wanted: str) -> list[str]:
    """Warnings about a dataset without a declared reward type; a declared one that differs is an error."""
    import json

    found = declared or ((json.loads(spec_json).get("kwargs") or {}).get("reward_type") if spec_json else None)
    if found is None:
        return ["the dataset does not declare its reward type"]
    if found != wanted:
        raise ValueError(f"the dataset's rewards are {found}, not {wanted}")
    return []


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = True) -> DataFrame:
    """JSON lines, or one document a file; a broken record fails the scan."""
    r = spark.read.option("mode", "FAILFAST").option("multiLine", not lines)
    return (r.schema(schema) if schema else r).json(path)


def discover(spark: SparkSession, pattern: str, expression: str, names: Sequence[str]) -> DataFrame:
    """Files of a glob with what a regular expression reads from their paths; the listing reads no contents."""
    f = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("size"))
    return f.select("path", "size", *(F.regexp_extract("path", expression, i + 1).alias(n) for i, n in enumerate(names))).filter(F.col("path").rlike(expression))


def unique_match(found: DataFrame, **wanted: str) -> str:
    """The path of the only file with these values; none or several are an error."""
    for k, v in wanted.items():
        found = found.filter(F.col(k) == v)
    rows = found.select("path").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{'no file' if not rows else 'several files'} for {wanted}")
    return rows[0].path


def file_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """SHA-256 of each file, for files that fit a row."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("hash"))


def prefer(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the first source, and those of the second for keys that the first lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


def cached(spark: SparkSession, root: str, payload: Any, build: Callable[[], DataFrame], required: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """A table in a folder named by the signature of what determines it; built when absent or when it lacks required keys."""
    path = f"{root.rstrip('/')}/cache-{signature(payload)}"
    try:
        table = spark.read.parquet(path)
        if required is None or required.select(*keys).join(table.select(*keys), list(keys), "left_anti").isEmpty():
            return table
    except Exception as e:  # Spark's own not-found condition; anything else goes on
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_samples(rows: DataFrame, path: str, readable: str, key: str = "episode_idx", first: int = 3) -> None:
    """All samples as Parquet, and those of the first episodes as JSON lines to look at."""
    rows.write.mode("overwrite").parquet(path)
    few = rows.select(key).distinct().orderBy(key).limit(first)
    rows.join(F.broadcast(few), key, "left_semi").write.mode("overwrite").json(readable)


def write_step_log(steps: DataFrame, path: str, keys: Sequence[str] = ("variant", "episode_idx")) -> None:
    """A text log for each episode, a step a line."""
    line = F.concat_ws("\t", F.col("t").cast("string"), F.col("prompt"), F.col("action"))
    steps.select(*keys, "t", line.alias("value")).repartition(*keys).sortWithinPartitions(*keys, "t").drop("t").write.mode("overwrite").partitionBy(*keys).text(path)


def nth_line(spark: SparkSession, path: str, n: int) -> str:
    """The n-th line (from 0) of one file, by the lines' own order in it."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    row = lines.withColumn("n", F.row_number().over(Window.orderBy("at")) - 1).filter(F.col("n") == n).first()
    if row is None:
        raise IndexError(n)
    return row.value


try:
    import h5py
except ImportError:  # HDF5 input is optional
    h5py = None


def read_tree(node: Any) -> Any:
    """Groups as mappings to any depth, datasets as lists or numbers."""
    if hasattr(node, "keys"):
        return {k: read_tree(node[k]) for k in sorted(node.keys())}
    value = node[()]
    return value.tolist() if hasattr(value, "tolist") else value.decode() if isinstance(value, bytes) else value


def hdf5_trees(spark: SparkSession, files: Sequence[str], schema: str) -> DataFrame:
    """(path, episode_idx, tree): every episode's whole group, nested as ``schema`` says; needs h5py on the executors."""
    if h5py is None:
        raise ImportError("reading HDF5 needs h5py; convert the files to Parquet instead")

    def run(batches: Iterator) -> Iterator:
        import json

        import pandas as pd

        for b in batches:
            for path in b["path"]:
                with h5py.File(path) as f:
                    for k in sorted((k for k in f if k.startswith("episode_")), key=lambda k: int(k.rsplit("_", 1)[1])):
                        yield pd.DataFrame([(path, int(k.rsplit("_", 1)[1]), json.dumps(read_tree(f[k])))], columns=["path", "episode_idx", "tree"])

    names = spark.createDataFrame([(p,) for p in files], "path string").repartition(max(1, len(files)))
    rows = names.mapInPandas(run, "path string, episode_idx int, tree string")
    return rows.withColumn("tree", F.from_json("tree", schema))


def hdf5_episodes(spark: SparkSession, files: Sequence[str], variant: str) -> DataFrame:
    """Episodes of HDF5 files in the order of their numbers, one task a file; needs h5py on the executors."""
    if h5py is None:
        raise ImportError("reading HDF5 needs h5py; convert the files to Parquet instead")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for path in b["path"]:
                with h5py.File(path) as f:
                    groups = sorted((k for k in f if k.startswith("episode_")), key=lambda k: int(k.rsplit("_", 1)[1]))
                    rows = []
                    for k in groups:
                        g = f[k]
                        get = lambda n, g=g: g[n][()].tolist() if n in g else None
                        obs = g["observations"]
                        rows.append((variant, int(k.rsplit("_", 1)[1]), (obs["observation"] if hasattr(obs, "keys") else obs)[()].tolist(), get("actions"), get("rewards"), get("terminations"), get("truncations"), get("infos/success")))
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in EPISODE_SCHEMA.split(", ")])

    names = spark.createDataFrame([(p,) for p in files], "path string").repartition(max(1, len(files)))
    return names.mapInPandas(run, EPISODE_SCHEMA)


def steps_of(episodes: DataFrame) -> DataFrame:
    """One row for each step of episode rows: T actions, with observations before and after each."""
    number = F.sequence(F.lit(0), F.size("actions") - 1)
    e = episodes.filter(F.size("actions") > 0).withColumn("a", F.explode(F.arrays_zip(number.alias("t"), "actions")))
    t = F.col("a.t")
    flag = lambda c: F.coalesce(F.get(F.col(c), t), F.lit(False))
    return e.select("variant", "episode_idx", t.cast("long").alias("t"), F.get("observations", t).alias("observation"), F.get("observations", t + 1).alias("next_observation"), F.col("a.actions").alias("action"), F.get("rewards", t).alias("reward"), flag("terminations").alias("terminated"), flag("truncations").alias("truncated"), flag("success").alias("success"))
