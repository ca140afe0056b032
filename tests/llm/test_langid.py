"""Language ID: held-out accuracy, folding, and odd inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def net(docs):
    return langid.train(docs)


def test_held_out_accuracy(spark, docs, net):
    pred = langid.identify(docs, net, keep=["doc_id", "lang"]).withColumn("held", langid.held_out()).toPandas()
    assert (pred.held == [zlib.crc32(str(i).encode()) % 4 == 2 for i in pred.doc_id]).all()
    held = pred[pred.held & (pred.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert pred.score.between(0, 1).all()


def test_labels_of_held_out_rows_are_not_read(docs, net):
    other = langid.train(docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang"))))
    assert other.labels == net.labels and all((a == b).all() for a, b in zip(other.filters, net.filters, strict=True))


def test_tables_are_the_convolution(net):
    x = langid._SMALL[np.random.default_rng(0).integers(0, 256, (5, langid.WINDOW + max(langid.WIDTHS) - 1), dtype=np.uint8)]
    h = []
    for w, f in zip(langid.WIDTHS, net.filters, strict=True):
        e = net.embed[x]
        h.append((np.concatenate([e[:, o : o + langid.WINDOW] for o in range(w)], axis=2) @ f).max(axis=1))
    s = np.maximum(np.concatenate(h, axis=1) + net.bias, 0) @ net.out + net.last
    p = np.exp(s - s.max(axis=1, keepdims=True))
    assert net.predict(x) == pytest.approx(p / p.sum(axis=1, keepdims=True), abs=1e-4)


def test_odd_rows(spark, net):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (6, "½ ² ②"), (None, "the and of the"), (5, "der und die " * 20000), (5, "der und die " * 20000)]
    got = langid.identify(spark.createDataFrame([(*r, "zz", 3.0) for r in rows], "doc_id long, text string, lang string, score double"), net).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert [by[k] for k in (1, 2, 3, 6)] == [("und", 0.0)] * 4
    assert by[5][0] == "de" and by[None][0] == "en" and len(got) == 7


def test_every_language_is_learned(spark):
    """More languages than the sample has rows: one row of each, none left out; a hot one does not crowd out the rest."""
    rows = [(i, f"text {'abcdefghij'[i % 10] * 5} {i}", f"l{i % 90:02d}" if i % 3 else "hot") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(df, total=50).labels == ["hot", *sorted({r[2] for r in rows} - {"hot"})]


@pytest.mark.parametrize("key", [None, 9])
def test_languages_of_rows_with_one_id_or_none(spark, key):
    rows = [(key, f"viele deutsche Worte {i}", "xx") for i in range(5000)] + [(10 + i, f"some english words {i}", "yy") for i in range(100)]
    rows += [(key, "always the same row", "zz")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(df, sample_rows=20).labels == ["xx", "yy", "zz"]


def test_windows_of_long_texts_are_drawn_from_all_of_it(spark):
    text = "".join(f"{i:06d} " for i in range(20_000))
    got = spark.createDataFrame([("a", 7, text)], "lang string, mark long, text string").mapInArrow(langid._windows_of(16), "lang string, mark long, x binary, size binary").first()
    x = np.frombuffer(got["x"], np.uint8).reshape(16, -1)
    at = [text.index(bytes(r[: langid.WINDOW]).decode()) for r in x]
    assert at == sorted(set(at)) and at[-1] > len(text) // 2 and (np.frombuffer(got["size"], np.int64) == langid.WINDOW).all()


def test_no_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    net = langid.train(none)
    assert net.labels == [] and langid.identify(none, net).count() == 0
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(one, langid.train(one)).first().lang_pred == "und"
