import pytest
from pyspark.sql import functions as F

from stridelake.sources import files as S
from stridelake.sources import registry as R


def test_paths():
    assert S.dataset_path("m-v2", "/r") == "/r/m-v2"
    assert S.dataset_path("m-v2", "/r", "dense") == "/r/m-dense-v2"
    assert S.dataset_path("m-sparse-v2", None, "dense") == "m-dense-v2"
    assert S.dataset_path("/abs/m-v2", "/r", "sparse") == "/abs/m-v2"
    assert S.dataset_path("hdfs://n/m-v2", "/r") == "hdfs://n/m-v2"
    with pytest.raises(ValueError):
        S.dataset_path("m", None, "dense")


def test_reward_types():
    assert S.check_reward_type("dense", None, "dense") == []
    assert S.check_reward_type(None, '{"kwargs": {"reward_type": "dense"}}', "dense") == []
    assert S.check_reward_type(None, '{"kwargs": {}}', "dense")
    with pytest.raises(ValueError):
        S.check_reward_type("sparse", None, "dense")


def test_discovery_and_hashes(spark, tmp_path):
    for run in ("a-s0", "a-s1", "b-s0"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "out.json").write_text('{"x": 1}' if run[0] == "a" else '{"x": 2}')
    found = S.discover(spark, f"{tmp_path}/*/out.json", r"/([a-z]+)-s([0-9]+)/out\.json$", ["config", "seed"])
    assert sorted((r.config, r.seed) for r in found.collect()) == [("a", "0"), ("a", "1"), ("b", "0")]
    assert S.unique_match(found, config="b").endswith("b-s0/out.json")
    for wanted in ({"config": "a"}, {"config": "z"}):
        with pytest.raises(ValueError):
            S.unique_match(found, **wanted)
    h = {r.path.split("/")[-2]: r.hash for r in S.file_hashes(spark, f"{tmp_path}/*/out.json").collect()}
    assert h["a-s0"] == h["a-s1"] != h["b-s0"]
    assert sorted(r.x for r in S.read_json(spark, f"{tmp_path}/*/out.json", "x int").collect()) == [1, 1, 2]


def test_signed_caches(spark, tmp_path):
    built = []

    def build(n):
        def run():
            built.append(n)
            return spark.range(n)

        return run

    assert S.cached(spark, str(tmp_path), {"n": 3}, build(3)).count() == 3
    assert S.cached(spark, str(tmp_path), {"n": 3}, build(4)).count() == 3
    assert S.cached(spark, str(tmp_path), {"n": 4}, build(4)).count() == 4
    assert S.cached(spark, str(tmp_path), {"n": 3}, build(5), spark.range(2), ["id"]).count() == 3
    assert S.cached(spark, str(tmp_path), {"n": 3}, build(6), spark.range(6), ["id"]).count() == 6
    assert built == [3, 4, 6]


def test_logs_and_samples(spark, tmp_path):
    rows = spark.createDataFrame([("v", e, t, f"p{t}", f"a{t}") for e in range(5) for t in range(3)], "variant string, episode_idx int, t int, prompt string, action string")
    S.write_step_log(rows, str(tmp_path / "log"))
    got = sorted((tmp_path / "log" / "variant=v" / "episode_idx=2").glob("*.txt"))
    assert got[0].read_text() == "0\tp0\ta0\n1\tp1\ta1\n2\tp2\ta2\n"
    S.write_samples(rows, str(tmp_path / "p"), str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 15 and spark.read.json(str(tmp_path / "j")).count() == 9
    (tmp_path / "x.jsonl").write_text("a\nb\nc\n")
    assert S.nth_line(spark, str(tmp_path / "x.jsonl"), 1) == "b"
    with pytest.raises(IndexError):
        S.nth_line(spark, str(tmp_path / "x.jsonl"), 9)


def test_sources_in_order_of_preference(spark):
    a = spark.createDataFrame([(1, "final")], "k int, src string")
    b = spark.createDataFrame([(1, "checkpoint"), (2, "checkpoint")], "k int, src string")
    assert sorted(map(tuple, S.prefer(a, b, ["k"]).collect())) == [(1, "final"), (2, "checkpoint")]


def test_episode_rows_to_steps(spark):
    e = spark.createDataFrame([("v", 0, [[0.0], [1.0], [2.0]], [[0.1], [0.2]], [1.0, 2.0], [False, True], None, [False, True]), ("v", 1, [[5.0]], [], [], [], [], [])], S.EPISODE_SCHEMA)
    got = S.steps_of(e).orderBy("t").collect()
    assert [(r.t, r.observation, r.next_observation, r.reward, r.terminated, r.truncated, r.success) for r in got] == [(0, [0.0], [1.0], 1.0, False, False, False), (1, [1.0], [2.0], 2.0, True, False, True)]


def test_hdf5_is_optional(spark):
    if S.h5py is None:
        with pytest.raises(ImportError, match="Parquet"):
            S.hdf5_episodes(spark, ["x.h5"], "v")


def test_families(spark):
    R._FAMILIES.clear()
    fam = R.Family("toy", 2, {"a": {"size": 3}, "b": {}}, lambda s, v: s.range(3).withColumn("variant", F.lit(v)), lambda df: df.filter("id > 0"))
    R.register(fam)
    with pytest.raises(ValueError):
        R.register(fam)
    assert R.load_variants(spark, "toy", ["a", "b"]).count() == 4
    assert sorted(map(tuple, R.variant_table(spark, "toy", ["size"]).collect())) == [("a", "3"), ("b", None)]
    for call in (lambda: R.family("x"), lambda: R.load_variants(spark, "toy", ["z"])):
        with pytest.raises(KeyError):
            call()
    R._FAMILIES.clear()


def test_settings():
    base = {"a": {"b": 1, "c": [1, 2]}, "d": 4}
    got = R.merge_settings(base, {"a": {"c": [3]}, "e": None})
    assert got == {"a": {"b": 1, "c": [3]}, "d": 4, "e": None} and base["a"]["c"] == [1, 2]
    assert R.drop_setting(got, "a.b") == {"a": {"c": [3]}, "d": 4, "e": None}
    assert R.drop_setting(got, "x.y") == got
