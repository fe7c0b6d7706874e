import subprocess
import sys
from pathlib import Path

from stridelake.llm import _store as S


def folder(df):
    return Path(df._cut_path.removeprefix("file:"))


def test_cut_drop_and_release(spark):
    a, b = S.cut(spark.range(5), "a"), S.cut(spark.range(0), "b")
    assert a.count() == 5 and b.count() == 0 and b.columns == ["id"]
    assert folder(a).is_dir() and folder(b).is_dir()
    S.drop(a)
    assert not folder(a).exists() and folder(b).is_dir()
    S.release(spark)
    assert not folder(b).exists()


NAMED = """
from stridelake import build_session
from stridelake.llm._store import shared_root
print("ROOT", shared_root(build_session("t", "local[1]", 1, spark__checkpoint__dir="file:///tmp/named/")))
"""


def test_the_named_folder_is_taken():
    r = subprocess.run([sys.executable, "-c", NAMED], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=100)
    assert "ROOT file:///tmp/named\n" in r.stdout, r.stderr


def test_gathered(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS_A_FILE", 10)
    parts = lambda n, rows: S.gathered(spark.range(0, 1000, 1, n), rows).rdd.getNumPartitions()
    assert parts(64, 1000) == 64 and parts(64, 300) == 31 and parts(64, 5) == 8 and parts(3, 5) == 3
    assert S.gathered(spark.range(0, 1000, 1, 64), 5).agg({"id": "sum"}).first()[0] == 499500
