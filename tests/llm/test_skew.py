import pytest

from livgrid.llm import skew, storage
from livgrid.llm.storage import Work


@pytest.mark.parametrize(("least", "most"), [(1000, 100_000), (3, 100_000), (0, 2)])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_frequent_keys_are_taken_apart(spark, monkeypatch, least, most, how):
    monkeypatch.setattr(skew, "LEAST_FREQUENT", least)
    monkeypatch.setattr(skew, "FREQUENT_KEYS", most)
    work = Work(spark, "t")
    rows = [(k % 3 if k < 60 else k, k) for k in range(80)] + [(None, 99), (500, 98)]
    left = work.write(spark.createDataFrame(rows, "key long, v long"), "left")
    right = spark.createDataFrame([(k, f"n{k}") for k in range(1, 79)], "key long, name string")
    got = sorted((tuple(r) for r in skew.join_unique(left, right, ["key"], work, "x", how).select("key", "v", "name").collect()), key=str)
    assert got == sorted((tuple(r) for r in left.join(right, "key", how).select("key", "v", "name").collect()), key=str)
    assert skew.join_unique(left.limit(0), right, ["key"], work, "y", how).count() == 0


def test_tables_of_finished_runs_are_deleted(spark):
    begun = storage.mark()
    work = Work(spark, "t")
    table = work.write(spark.range(3).toDF("i"), "a")
    assert table.count() == 3 and storage.mark() == begun + 1
    storage.drop_since(begun)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work.path)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) and storage.mark() == begun


def test_a_cluster_must_name_the_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint.dir"):
        storage.shared_dir(Session())


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "__x long, __X_ long")
    assert storage.unused(df, "__x") == "__x__" and storage.unused(df, "y") == "y"
