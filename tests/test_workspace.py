from pathlib import Path

from corvanta.workspace import Workspace, release, shared_dir, small_enough


def test_tables_come_and_go(spark):
    ws = Workspace(spark, "t")
    df = ws.save(spark.range(5), "a")
    assert df.count() == 5 and df.columns == ["id"]
    here = Path(ws.path.removeprefix("file://"))
    assert ws.path.startswith(shared_dir(spark)) and (here / "a").exists()
    ws.save(spark.range(1), "b")
    ws.drop("a")
    assert not (here / "a").exists() and (here / "b").exists()
    release(spark)
    assert not here.exists()


def test_small_enough(spark):
    assert small_enough(spark.range(5), 5) and not small_enough(spark.range(6), 5)


def test_empty_table(spark):
    assert Workspace(spark, "t").save(spark.range(0), "none").count() == 0
