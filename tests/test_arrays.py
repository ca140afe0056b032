"""Numpy files as a data source."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.sources import arrays


def rows(df):
    return {r.row: r.v for r in df.collect()}


@pytest.mark.parametrize("kind", ["<f4", "<f8", "<i2", "|u1"])
def test_ranges_of_rows(spark, tmp_path, kind):
    x = (np.arange(103 * 7).reshape(103, 7) % 251).astype(kind)
    np.save(tmp_path / "x.npy", x)
    df = arrays.read_array(spark, str(tmp_path / "x.npy"), range_bytes=10 * 7 * x.itemsize)
    assert df.rdd.getNumPartitions() == 11
    got = rows(df)
    assert len(got) == 103 and np.array([got[i] for i in range(103)]).tolist() == x.astype(float).tolist()


def test_columns_and_other_shapes(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(20, 3, 4))
    np.save(tmp_path / "x.npy", x)
    got = rows(arrays.read_array(spark, f"file://{tmp_path}/x.npy", columns="2:5"))
    assert np.allclose([got[i] for i in range(20)], x.reshape(20, 12)[:, 2:5])
    np.save(tmp_path / "one.npy", np.arange(5.0))
    assert rows(arrays.read_array(spark, str(tmp_path / "one.npy"))) == {i: [float(i)] for i in range(5)}
    np.save(tmp_path / "none.npy", np.zeros((0, 4)))
    assert arrays.read_array(spark, str(tmp_path / "none.npy")).count() == 0


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_members_of_archives(spark, tmp_path, save):
    x, y = np.random.default_rng(1).normal(size=(50, 4)), np.arange(30).reshape(10, 3)
    save(tmp_path / "a.npz", x=x, y=y)
    df = arrays.read_array(spark, str(tmp_path / "a.npz"), member="x", range_bytes=320)
    assert df.rdd.getNumPartitions() == (5 if save is np.savez else 1)
    got = rows(df)
    assert np.array([got[i] for i in range(50)]).tolist() == x.tolist()
    assert rows(arrays.read_array(spark, str(tmp_path / "a.npz"), member="y"))[9] == [27.0, 28.0, 29.0]


def test_what_is_refused(spark, tmp_path):
    (tmp_path / "bad.npy").write_bytes(b"not numpy at all")
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 4))))
    np.save(tmp_path / "o.npy", np.array([1, None], object), allow_pickle=True)
    np.save(tmp_path / "cut.npy", np.ones((30, 4)))
    data = (tmp_path / "cut.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(data[:-8])
    for name in ("bad", "f", "o", "cut"):
        with pytest.raises(Exception, match="npy|Fortran|objects|ends before"):
            arrays.read_array(spark, str(tmp_path / f"{name}.npy")).count() if name != "cut" else arrays.read_array(spark, str(tmp_path / "cut.npy")).collect()


def test_written_by_tasks_and_read_again(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(500, 6)).astype("<f4")
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(500)], "k long, v array<double>").repartition(7)
    index = df.sparkSession.createDataFrame(arrays.write_arrays(df, f"file://{tmp_path}/out", "v", ["k"], 6).collect())
    assert index.agg(F.sum("rows")).first()[0] == 500
    got = rows(arrays.read_parts(spark, f"{tmp_path}/out", index))
    assert np.array([got[i] for i in range(500)]).tolist() == x.astype(float).tolist()
    whole = np.concatenate([np.load(f"{tmp_path}/out/{r.file}") for r in index.orderBy("first").collect()])
    assert (whole == x).all()
    with pytest.raises(Exception, match="wide"):
        arrays.write_arrays(df, f"{tmp_path}/bad", "v", ["k"], 5).collect()
