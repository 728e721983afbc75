import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.sources import readers as R
from loomline.sources import tokenfiles as T
from loomline.sources.workspace import new_folder


def test_index_round_trip():
    sizes = np.array([3, 2, 4])
    kind, got, pointers, docs = T.parse_index(T.index_bytes(sizes, np.array([0, 3]), "int32"))
    assert (kind, got.tolist(), pointers.tolist(), docs.tolist()) == ("int32", [3, 2, 4], [0, 12, 20], [0, 3])
    with pytest.raises(ValueError):
        T.parse_index(b"something else")


def test_flat_files(spark):
    blocks = spark.createDataFrame([(i, list(range(10 * i, 10 * i + 10))) for i in range(7)], "block long, ids array<int>")
    folder = new_folder(spark, "flat")
    T.write_flat(blocks, folder, "uint16", 10, 3)
    rows = T.read_flat(spark, folder, 4).collect()
    assert [x for r in sorted(rows) for x in r["ids"]] == list(range(70))
    with pytest.raises(Exception, match="doesn't fit"):
        T.write_flat(blocks.withColumn("ids", F.transform("ids", lambda x: x + 70000)), new_folder(spark, "flat"), "uint16", 10)


def test_indexed_files(spark):
    rows = spark.createDataFrame([(i, [i] * i) for i in range(20)], "id long, ids array<int>")
    folder = new_folder(spark, "indexed")
    T.write_indexed(rows, "id", "ids", folder, parts=3, per_document=4)
    assert sorted(r["ids"] for r in T.read_indexed(spark, folder).collect()) == [[i] * i for i in range(20)]


def test_weighted_list_and_shards(spark):
    rows = R.weighted_sources(spark, "- 1\n- x  # note\n- 2.5\n- 'y'\n").collect()
    assert [(r["path"], r["weight"]) for r in rows] == [("x", 1.0), ("y", 2.5)]
    assert R.shard_names(1, 3, 5, "{:d}-{:02d}") == ["0-01", "0-02"]
    with pytest.raises(ValueError):
        R.shard_names(3, 9, 5)
