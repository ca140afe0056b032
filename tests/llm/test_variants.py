"""Spelling variants against brute force."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from spotweave.llm import variants


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(rows, least=7, count=2, misspelt=31, ratio=10):
    c = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(x.lower() if "A" <= x <= "Z" else x for x in w)
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            if misspelt and h % misspelt == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                c[w] += 1
    words = {w: n for w, n in c.items() if n >= count}
    links = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(links[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def pairs(spark, words):
    df = spark.createDataFrame([(i, w, 1) for i, w in enumerate(words)], "no long, word string, n long")
    return sorted((r.word, r.other) for r in variants.near_words(df).collect())


@pytest.mark.parametrize("letters,sizes,n", [("ab", (1, 9), 300), ("abé", (5, 8), 400), ("a", (1, 40), 40), ("abcdefgh", (7, 9), 300)])
def test_all_pairs(spark, letters, sizes, n):
    rng = random.Random(n + len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(n)}
    for w in sorted(words)[::3]:  # plant neighbours
        k = rng.randrange(len(w))
        words |= {w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]} - {""}
    assert pairs(spark, sorted(words)) == sorted((a, b) for a in words for b in words if near(a, b))


def test_long_words(spark):
    rng = random.Random(1)
    w = "".join(rng.choice("abc") for _ in range(20_000))
    words = [w, w[:9000] + "ä" + w[9000:], w[:19_999] + "z", "z" + w, w[1:], w[:5000] + "y" + w[5001:], w + "a", "q" * 7]
    assert pairs(spark, words) == sorted((a, b) for a in words for b in words if near(a, b))


def test_many_words_of_one_stem(spark):
    words = ["constant" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(26 * 26)]
    assert len(pairs(spark, words)) == 676 * 50


def texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 12))) for _ in range(25)]
    rows = []
    for i in range(120):
        out = []
        for _ in range(60):
            w = rng.choice(base[: rng.choice([3, 25])])
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "x", w[k] * 2]) + w[k + 1 :]
            out.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "1", "\n"]).join(out)))
    return rows + [
        (500, None), (501, ""), (502, "123 _ ß× ÷÷÷÷÷÷÷÷ ÀÀÀÀÀÀÀ ÷÷÷÷÷÷÷÷ ÀÀÀÀÀÀÀ"), (None, "wordwithoutid wordwithoutid"), (3, "repeated repeated"), (3, "repeated repeated"),
        (504, "Straßenbahn straßenbahn " * 2000),
    ]


@pytest.mark.parametrize("options", [{}, {"misspelt": None}, {"misspelt": 3, "ratio": 2}, {"least_chars": 4, "least_count": 1, "misspelt": 5, "ratio": 3}])
def test_against_plain(spark, options):
    rows = texts(5)
    df = spark.createDataFrame([(i, t, "x", 2) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = variants.spelling_groups(df, **options)
    names = {"least_chars": "least", "least_count": "count"}
    want = plain(rows, **{names.get(k, k): v for k, v in options.items()})
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert len(want) > 30 and sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want


def test_chains_of_forms(spark):
    links = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(37)] + [("x", "w010"), ("y", "z")]
    got = variants.roots(spark.createDataFrame(links, "word string, form string")).collect()
    assert {r.word: r.root for r in got} == {w: "z" if w == "y" else "w037" for w, _ in links}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert variants.spelling_groups(df).count() == 0
    assert variants.spelling_groups(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).count() == 0


def test_words_met_by_many_tasks(spark):
    df = spark.range(0, 2000, 1, 9).select(F.col("id").alias("doc_id"), F.lit("commonword").alias("text"))
    rows = [(i, "commonword") for i in range(2000)]
    assert sorted(map(tuple, variants.spelling_groups(df).collect())) == plain(rows)


def test_query_agrees_with_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    documents = duckdb.read_parquet(f"{sf}/documents.parquet")
    names = "word, form, root, n, n_near, form_n"
    want = duckdb.query(f"SELECT {names} FROM ({variants.OP12_SQL})").fetchall() if documents is not None else None
    got = [tuple(r) for r in variants.op12_spelling_variants(spark, sf).select(*names.split(", ")).collect()]
    assert len(got) > 1000 and sorted(got, key=repr) == sorted(want, key=repr)
