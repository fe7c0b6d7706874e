import json

import pytest
from pyspark.sql import functions as F

from stridelake.operators import corpus as C
from stridelake.streaming import logs


def index_line(i, seed, traj, steps=4):
    return {"episode_index": i, "episode_group": f"episode_{i}", "map_seed": seed, "trajectory_index": traj, "map_hash": "h", "map_rows": 7, "map_cols": 7, "step_count": steps}


def test_index_scan(spark, tmp_path):
    good = tmp_path / "index.jsonl"
    good.write_text("\n".join([json.dumps(index_line(0, 0, 0)), "", json.dumps(index_line(1, 0, 1))]) + "\n")
    assert C.read_index(spark, str(good)).count() == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"episode_index": 0}\n{broken\n')
    with pytest.raises(Exception):
        C.read_index(spark, str(bad)).collect()


def test_manifest(spark, tmp_path):
    m = tmp_path / "manifest.json"
    m.write_text(json.dumps({"kind": "maps", "schema_version": 2, "complete": False}))
    assert C.read_manifest(spark, str(m), "maps", 2, require_complete=False)["kind"] == "maps"
    for kind, version, complete in (("maps", 2, True), ("other", 2, False), ("maps", 3, False)):
        with pytest.raises(ValueError):
            C.read_manifest(spark, str(m), kind, version, complete)


def test_templates(spark, tmp_path):
    (tmp_path / "b.txt").write_text("two\nlines")
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "c.md").write_text("no")
    assert [(r.template, r.text) for r in C.read_templates(spark, str(tmp_path)).collect()] == [("a", "one"), ("b", "two\nlines")]


def test_numeric_order(spark):
    df = spark.createDataFrame([("episode_10",), ("episode_9",), ("odd",)], "n string")
    assert [r.n for r in df.orderBy(C.numeric_suffix(F.col("n"))).collect()] == ["odd", "episode_9", "episode_10"]


def test_repair_and_validation(spark):
    idx = spark.createDataFrame([index_line(0, 0, 0), index_line(1, 0, 1), index_line(2, 0, 1), index_line(3, 1, 5)], C.INDEX_SCHEMA)
    data = spark.createDataFrame([(0, 0, 4), (0, 1, 9), (2, 0, 4), (1, 5, 4)], "map_seed long, trajectory_index long, step_count long")
    got = {(r.map_seed, r.trajectory_index, r.finding) for r in C.validate_corpus(idx, data, 2).collect()}
    assert got == {(0, 1, "step counts differ"), (0, 1, "repeated key"), (1, 5, "beyond capacity"), (2, 0, "not indexed")}
    found = C.repair_findings(data.select("map_seed"), idx.select("map_seed").filter("map_seed < 1"), "map_seed", "extra", "missing")
    assert {(r.map_seed, r.finding) for r in found.collect()} == {(1, "extra"), (2, "extra")}


def test_appends(spark):
    old = spark.createDataFrame([(0, 0, 0)], "episode_index long, map_seed long, trajectory_index long")
    new = spark.createDataFrame([(1, 1), (1, 0)], "map_seed long, trajectory_index long")
    keys = ["map_seed", "trajectory_index"]
    got = C.append_rows(old, new, keys, "episode_index", keys)
    assert sorted(map(tuple, got.select("episode_index", *keys).collect())) == [(1, 1, 0), (2, 1, 1)]
    for bad in ([(0, 0)], [(1, 1), (1, 1)]):
        with pytest.raises(ValueError):
            C.append_rows(old, spark.createDataFrame(bad, "map_seed long, trajectory_index long"), keys, "episode_index", keys)


def test_content_hash_depends_on_content_only(spark):
    d = spark.range(3000).select(F.lit("g").alias("g"), F.col("id").alias("k"))
    h = lambda x: C.content_hash(x, "g", "k", F.col("k").cast("string")).first().content_hash
    assert h(d) == h(d.repartition(7)) != h(d.filter("k < 2999"))


def test_signatures_and_publishing(spark, tmp_path):
    assert C.signature({"b": 1, "a": [1, "é"]}) == C.signature({"a": [1, "é"], "b": 1}) != C.signature({"a": [1, "e"], "b": 1})
    path = str(tmp_path / "out")
    C.publish(spark.range(3), path, [spark.range(2)])
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception):
        C.publish(spark.range(3), path)


LOG = "run string, ts timestamp, value double"


def write_logs(folder, rows):
    for i, part in enumerate(rows):
        (folder / f"{i}.json").write_text("".join(json.dumps(dict(zip(("run", "ts", "value"), r, strict=True))) + "\n" for r in part))


def drain(frame, mode, name):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_latest_of_a_log(spark, tmp_path):
    write_logs(tmp_path, [[("a", "2024-01-01T00:00:00", 1.0), ("b", "2024-01-01T00:00:09", 5.0)], [("a", "2024-01-01T00:01:00", 2.0)], [("a", "2024-01-01T00:00:30", 9.0)]])
    drain(logs.latest(logs.read_log(spark, str(tmp_path), LOG, 1), "run", "ts", "value"), "complete", "latest")
    assert sorted((r.run, r.value, r.n) for r in spark.table("latest").collect()) == [("a", 2.0, 3), ("b", 5.0, 1)]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    import os

    parts = [[("a", "2024-01-01T00:00:00", 1.0), ("a", "2024-01-01T00:01:00", 3.0)], [("a", "2024-01-01T01:00:00", 7.0)], [("a", "2024-01-01T02:00:00", 8.0)], [("a", "2024-01-01T00:00:30", 100.0), ("a", "2024-01-01T04:00:00", 8.0)], [("a", "2024-01-01T05:00:00", 8.0)]]
    write_logs(tmp_path, parts)
    for i in range(5):
        os.utime(tmp_path / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    drain(logs.windowed(logs.read_log(spark, str(tmp_path), LOG, 1), "ts", "run", "value"), "append", "wins")
    got = sorted((str(r.start)[11:16], r.mean, r.n) for r in spark.table("wins").collect())
    assert got[:2] == [("00:00", 2.0, 2), ("01:00", 7.0, 1)]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    write = logs.append_once(str(tmp_path / "t"))
    write(spark.range(3), 0)
    write(spark.range(3), 0)
    write(spark.range(2), 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5
