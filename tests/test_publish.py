import json

import pytest
from pyspark.sql import functions as F

from stridelake.functions import geometry as G
from stridelake.operators import publish as P
from stridelake.operators import tasks as K
from stridelake.sources.files import read_tree

CONTRACT = {"kind": "maps", "schema_version": 1, "seed_start": 0, "seed_end": 3, "collection_config": {"a": [1, 2]}}


def shard(spark, seeds, per=2):
    return spark.createDataFrame([(s, t, s * 10 + t, 5 + t) for s in seeds for t in range(per)], "map_seed long, trajectory_index long, episode_index long, step_count long")


def corpus(spark, root, **kw):
    return P.open_corpus(spark, root, "0-3-2", CONTRACT, {"map_count": 3, "episode_count": 6}, **kw)


def test_a_corpus_is_created_filled_resumed_and_closed(spark, tmp_path):
    root, keys = f"{tmp_path}/x/0-3-2", ["map_seed", "trajectory_index"]
    made = corpus(spark, root)
    assert made["complete"] is False and made["expected_episode_count"] == 6 and P.contract_of(made) == CONTRACT
    assert P.append_shard(spark, root, shard(spark, [0, 1]), keys, "a") == 4
    assert P.append_shard(spark, root, shard(spark, [0, 1]), keys, "a") == 0  # a repeated transaction
    with pytest.raises(ValueError, match="exist"):
        P.append_shard(spark, root, shard(spark, [1, 2]), keys, "b")
    with pytest.raises(ValueError, match="repeat"):
        P.append_shard(spark, root, shard(spark, [2, 2]), keys, "b")
    line = F.concat_ws(":", "map_seed", "trajectory_index", "step_count")
    with pytest.raises(ValueError, match="4 episodes of 6"):
        P.close_corpus(spark, root, "map_seed", "episode_index", line, "step_count")
    assert corpus(spark, root) == made
    P.append_shard(spark, root, shard(spark, [2]), keys, "b")
    done = P.close_corpus(spark, root, "map_seed", "episode_index", line, "step_count")
    assert (done["complete"], done["generated_map_count"], done["total_episodes"], done["total_steps"]) == (True, 3, 6, 33)
    assert corpus(spark, root) == done and len(done["content_hash"]) == 64
    assert sorted(p.name for p in (tmp_path / "x/0-3-2").iterdir() if not p.name.startswith((".", "_"))) == ["data", "manifest.json"]


def test_contracts_are_immutable_and_overwriting_is_guarded(spark, tmp_path):
    root = f"{tmp_path}/0-3-2"
    corpus(spark, root)
    with pytest.raises(ValueError, match="another contract"):
        P.open_corpus(spark, root, "0-3-2", CONTRACT | {"seed_end": 4}, {})
    with pytest.raises(ValueError, match="not overwritten"):
        P.open_corpus(spark, root, "other", CONTRACT, {}, overwrite=True)
    assert P.open_corpus(spark, root, "0-3-2", CONTRACT | {"seed_end": 4}, {}, overwrite=True)["seed_end"] == 4
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.txt").write_text("x")
    with pytest.raises(FileExistsError):
        corpus(spark, f"{tmp_path}/files")


def test_shards_are_merged_and_published_whole(spark, tmp_path):
    paths = [f"{tmp_path}/shard-{i}" for i in range(3)]
    for i, p in enumerate(paths):
        shard(spark, [i]).write.parquet(p)
    final, keys = f"{tmp_path}/out/final", ["map_seed", "trajectory_index"]
    with pytest.raises(ValueError, match="repeat"):
        P.publish_merged(spark, [paths[0], paths[0]], final, keys)
    with pytest.raises(FileNotFoundError):
        P.publish_merged(spark, [*paths, f"{tmp_path}/none"], final, keys)
    assert not (tmp_path / "out" / "final").exists()
    assert P.publish_merged(spark, paths, final, keys) == 6 and spark.read.parquet(final).count() == 6
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["final"]
    with pytest.raises(FileExistsError):
        P.publish_merged(spark, paths, final, keys)
    for name, path in (("shard-1", paths[0]), ("final", f"{tmp_path}/out/../out/final"), ("repo", "/tmp/repo")):
        with pytest.raises(ValueError):
            P.remove_shard(spark, name, path, str(tmp_path))
    P.remove_shard(spark, "shard-0", paths[0], str(tmp_path))
    assert not (tmp_path / "shard-0").exists()


def test_texts_are_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/a/b.json"
    for v in ({"z": 1, "a": "é"}, {"b": None}):
        P.write_json(spark, path, v)
        assert json.loads(P.read_text(spark, path)) == v
    P.write_text(spark, f"file://{tmp_path}/a/c.txt", "x")
    assert sorted(p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")) == ["b.json", "c.txt"]
    for i in range(2):
        P.append_jsonl(spark, f"{tmp_path}/log", spark.createDataFrame([(i, "x")], "n int, s string"))
    assert sorted(r.n for r in spark.read.json(f"{tmp_path}/log").collect()) == [0, 1]


def test_yaml():
    got = P.to_yaml({"name": "x: y", "list": [1, [True, None], {"k": 2.5}], "empty": {}, "none": [], "odd key": {"a": "é"}})
    assert got == 'name: "x: y"\nlist:\n  - 1\n  -\n    - true\n    - null\n  -\n    k: 2.5\nempty:\n  {}\nnone:\n  []\n"odd key":\n  a: "\\u00e9"\n'


def test_tasks_are_retried_and_fail_whole(spark):
    tasks = spark.createDataFrame([(i, float(i)) for i in range(20)], "e long, v double").repartition(4)

    def work(row, attempt):
        if row["e"] == 7 or attempt < row["e"] % 3:
            raise ValueError(f"no {attempt}")
        return row["v"]

    got = {r["index"]: r for r in K.run_tasks(tasks, work, "e", retries=2).collect()}
    assert sorted(got) == list(range(20))
    assert all(got[i].attempts == i % 3 + 1 and got[i].ret == i for i in range(20) if i != 7)
    assert (got[7].attempts, got[7].completed, got[7].error, got[7].ret) == (3, False, "ValueError: no 2", 0.0)

    def never(row, attempt):
        raise OSError("no start")

    got = K.run_tasks(tasks.coalesce(1), never, "e", retries=1, failures_to_stop=3).collect()
    assert len(got) == 20 and sum(r.attempts for r in got) == 6 and sum(r.error == "not started" for r in got) == 17


def test_requests_meet_in_batches(spark):
    reqs = spark.range(150).select(F.col("id"), (F.col("id") * 2.0).alias("v")).coalesce(1)
    got = K.answer_in_batches(reqs, lambda p: p["v"] + 1, "id", size=64).collect()
    assert sorted((r.id, r.response) for r in got) == [(i, 2.0 * i + 1) for i in range(150)]
    assert sorted({r.batch_size for r in got}) == [22, 64]


def test_sensing_settings(spark):
    df = spark.createDataFrame([(" V5 ", 0.0), (None, None), ("v1", 2.5)], "v string, t double")
    assert [tuple(r) for r in df.select(G.sensing_version(F.col("v")), G.risk_threshold(F.col("t"))).collect()] == [("v5", 0.0), ("v3", 0.1), ("v1", 2.5)]
    for v, t in (("v9", 0.1), ("", 0.1), ("v1", -0.1), ("v1", float("nan")), ("v1", float("inf"))):
        bad = spark.createDataFrame([(v, t)], "v string, t double")
        with pytest.raises(Exception):
            bad.select(G.sensing_version(F.col("v")), G.risk_threshold(F.col("t"))).collect()


class Leaf:
    def __init__(self, x):
        self.x = x

    def __getitem__(self, _):
        return self.x


def test_nested_groups_are_read_to_any_depth():
    node = {"obs": {"a": {"deep": Leaf([1, 2])}, "b": Leaf([3])}, "top": Leaf(4)}
    assert read_tree(node) == {"obs": {"a": {"deep": [1, 2]}, "b": [3]}, "top": 4}
