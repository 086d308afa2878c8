import os

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from featherloom.session import release, scratch_path, seal, sealed, shared_dir
from featherloom.sources import matrices, samples, tables, vectors


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_triples(spark, tmp_path):
    found = tables.read_triples(spark, write(tmp_path, "t.csv", "1,1,0.5\n3,2,1.5\n"))
    assert {(r["doc"], r["col"], r["value"]) for r in found.collect()} == {(1, 1, 0.5), (2, 3, 1.5)}
    with pytest.raises(Exception):
        tables.read_triples(spark, write(tmp_path, "bad.csv", "1,x,0.5\n")).collect()


def test_labels_follow_line_numbers_over_several_files(spark, tmp_path):
    folder = tmp_path / "labels"
    os.makedirs(folder)
    (folder / "a.txt").write_text("1\n2\n1\n")
    (folder / "b.txt").write_text("2\n")
    (folder / "c.txt").write_text("".join("2\n" if k % 2 else "1\n" for k in range(500)))
    found = {r["doc"]: r["label"] for r in tables.read_labels(spark, str(folder)).collect()}
    assert [found[k] for k in (1, 2, 3, 4)] == [0, 1, 0, 1]
    assert len(found) == 504 and [found[k + 5] for k in range(6)] == [0, 1, 0, 1, 0, 1]


def test_labels_of_a_file_read_in_many_splits(spark, tmp_path):
    path = write(tmp_path, "many.txt", "".join(f"{k % 7}\n" for k in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = {r["line"]: r["value"] for r in tables.numbered_lines(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == {k + 1: str(k % 7) for k in range(3000)}


def test_libsvm(spark, tmp_path):
    path = write(tmp_path, "d.libsvm", "# comment\n1 1:0.5 3:2.0\n\n0 2:1.0\n")
    inferred = vectors.read_libsvm(spark, path)
    assert inferred.first()["features"].size == 3
    fixed = vectors.as_array(vectors.read_libsvm(spark, path, 5)).collect()
    assert fixed[0]["features"] == [0.5, 0.0, 2.0, 0.0, 0.0]
    out = scratch_path(spark, "libsvm")
    vectors.write_libsvm(spark.createDataFrame([(1.0, [0.0, 3.0])], "label DOUBLE, features ARRAY<DOUBLE>"), out)
    assert spark.read.text(out).first()["value"].strip() == "1.0 2:3.0"
    with pytest.raises(Exception):
        vectors.read_libsvm(spark, write(tmp_path, "bad.libsvm", "1 3:1.0 2:1.0\n"), 4).collect()


def test_usable_lines(spark, tmp_path):
    lines = tables.read_lines(spark, write(tmp_path, "l.txt", " a \n\n#b\n # c\nd#\n"))
    assert [r["value"] for r in vectors.usable_lines(lines).collect()] == ["a", "d#"]


def test_entries_and_blank_lines(spark, tmp_path):
    path = write(tmp_path, "e.txt", "1:0.5 4:2\n\n2:1\n")
    kept = vectors.read_entries(spark, path, keep_empty=True)
    assert kept.count() == 3
    found = vectors.read_entries(spark, path).collect()
    assert [[(e["idx"], e["val"]) for e in r["entries"]] for r in found] == [[(0, 0.5), (3, 2.0)], [(1, 1.0)]]


def test_dense_csv_header_and_last_column(spark, tmp_path):
    path = write(tmp_path, "m.csv", "a,b,c\n1,2,3\n4,5,6\n")
    found = vectors.read_dense_csv(spark, path, 3, header=True)
    assert sorted(r["features"] for r in found.collect()) == [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]
    cut = vectors.read_dense_csv(spark, path, 3, header=True, drop_last=True)
    assert sorted(r["features"] for r in cut.collect()) == [[1.0, 2.0], [4.0, 5.0]]


def test_text_layouts(spark, tmp_path):
    labelled = vectors.read_labelled_text(spark, write(tmp_path, "a.txt", "0,1 0 2.5\n"))
    assert labelled.first().asDict() == {"label": 0.0, "features": [1.0, 0.0, 2.5]}
    spaced = vectors.read_spaced(spark, write(tmp_path, "b.txt", "1 0.5 -2\n"))
    assert spaced.first().asDict() == {"label": 1.0, "features": [0.5, -2.0]}
    tabbed = vectors.read_tabbed(spark, write(tmp_path, "c.txt", "7\t0.25\t1\t2\n"))
    assert tabbed.first().asDict() == {"id": 7, "label": 0.25, "features": [1.0, 2.0]}


def test_vector_text(spark, tmp_path):
    text = f"{Vectors.dense([1.0, 2.0])}\n{Vectors.sparse(4, [1, 3], [5.0, 6.0])}\n{Vectors.sparse(2, [], [])}\n"
    found = [r["features"] for r in vectors.read_vectors(spark, write(tmp_path, "v.txt", text)).collect()]
    assert found == [[1.0, 2.0], [0.0, 5.0, 0.0, 6.0], [0.0, 0.0]]
    points = "(1.0,[0.5,2.0])\n(0.0,(3,[2],[4.0]))\n"
    rows = vectors.read_labelled_points(spark, write(tmp_path, "p.txt", points)).collect()
    assert [(r["label"], r["features"]) for r in rows] == [(1.0, [0.5, 2.0]), (0.0, [0.0, 0.0, 4.0])]


def test_matrix_files(spark):
    path = scratch_path(spark, "m")
    cells = spark.createDataFrame([(0, 1, 5), (2, 2, 0)], "i INT, j INT, v INT").repartition(2)
    matrices.write_matrix(cells, path)
    assert matrices.read_matrix(spark, path, 3, 3).collect() == [(0, 1, 5)]
    with pytest.raises(Exception, match="outside"):
        matrices.read_matrix(spark, path, 1, 1).collect()


def test_matrix_values_keep_their_type(spark):
    path = scratch_path(spark, "m")
    big = 2**40
    matrices.write_matrix(spark.createDataFrame([(0, big, 0.5), (1, 1, 2.7), (2, 2, 0.0)], "i BIGINT, j BIGINT, v DOUBLE"), path)
    assert sorted(map(tuple, matrices.read_matrix(spark, path).collect())) == [(0, big, 0.5), (1, 1, 2.7)]


def test_ids_beyond_double_precision(spark, tmp_path):
    tabbed = vectors.read_tabbed(spark, write(tmp_path, "big.txt", "9007199254740993\t1\t2\n"))
    assert tabbed.first()["id"] == 9007199254740993
    triples = tables.read_triples(spark, write(tmp_path, "t.csv", "4294967296,8589934592,1.5\n"))
    assert tuple(triples.first()) == (8589934592, 4294967296, 1.5)


def test_vectors_without_slots(spark, tmp_path):
    text = "(0,[],[])\n[]\n(2,[1],[3.0])\n"
    found = [r["features"] for r in vectors.read_vectors(spark, write(tmp_path, "z.txt", text)).collect()]
    assert found == [[], [], [0.0, 3.0]]


def test_random_samples_are_reproducible(spark):
    a = samples.random_samples(spark, 50, 3, -2.0, 2.0, "rastrigin", seed=1, partitions=2)
    b = samples.random_samples(spark, 50, 3, -2.0, 2.0, "rastrigin", seed=1, partitions=5)
    assert {r["id"]: r["y"] for r in a.collect()} == {r["id"]: r["y"] for r in b.collect()}
    low, high = a.select(F.explode("x").alias("v")).agg(F.min("v"), F.max("v")).first()
    assert -2.0 <= low < high < 2.0
    assert samples.from_memory(spark, [(1,), (2,)], "v INT", 2).count() == 2


def test_sealed_tables_have_no_lineage(spark):
    rows = spark.range(10).withColumn("part", F.col("id") % 2)
    table = seal(rows, "x", partition_by=["part"])
    assert table.columns == ["id", "part"] and table.count() == 10
    assert shared_dir(spark).removeprefix("file:") in table.inputFiles()[0]
    assert sealed(table) is table and sealed(rows) is not rows


class _Session:
    """A session that names no checkpoint folder."""

    def __init__(self, master):
        self.conf = {}
        self.sparkContext = type("Context", (), {"master": master})()


def test_only_local_sessions_get_a_temporary_folder():
    assert shared_dir(_Session("local[4]")) == shared_dir(_Session("local[*]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Session("spark://host:7077"))
    named = _Session("spark://host:7077")
    named.conf = {"spark.checkpoint.dir": "hdfs://shared/ck/"}
    assert shared_dir(named) == "hdfs://shared/ck"


def test_released_tables_are_deleted_and_others_left_alone(spark):
    table = seal(spark.range(3), "gone")
    path = table._sealed_at
    release(spark.range(3))
    release(table)
    with pytest.raises(Exception):
        spark.read.parquet(path)
