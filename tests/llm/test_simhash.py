"""SimHash: fingerprints and components against brute force."""

import numpy as np
import pytest
import xxhash

from spotweave.llm import simhash


def plain_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, most=4):
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    small = {}
    for i, x in enumerate(ids):
        small[find(i)] = min(x, small.get(find(i), x))
    return [small[find(i)] for i in range(len(ids))]


def test_gray_rank_inverts_gray_code():
    n = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("seed", range(4))
def test_index_links_like_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    codes = []
    for b in base:
        for _ in range(rng.integers(1, 40)):
            flip = rng.choice(64, rng.integers(0, 7), replace=False)
            codes.append(int(b) ^ sum(1 << int(f) for f in flip))
    codes = np.array(sorted(set(codes)), np.uint64)
    index = simhash.GrayIndex(np.zeros(len(codes), np.int64), codes)
    labels = index.links(4, chunk=64)
    got = [min(int(index.codes[k]) for k in range(len(codes)) if labels[k] == labels[i]) for i in range(len(codes))]
    assert got == plain_components([int(c) for c in index.codes], [int(c) for c in index.codes])


def planted(n, seed=11):
    """Random fingerprints, a tenth of them with a near one, and one dense group."""
    rng = np.random.default_rng(seed)
    codes = [int(x) for x in rng.integers(0, 2**64, n, dtype=np.uint64)]
    codes += [c ^ sum(1 << int(f) for f in rng.choice(64, rng.integers(1, 7), replace=False)) for c in codes[: n // 10]]
    codes += [codes[0] ^ int(sum(1 << int(f) for f in rng.choice(20, rng.integers(1, 5), replace=False))) for _ in range(n // 10)]
    return np.array(sorted(set(codes)), np.uint64)


def all_links(codes, most=4):
    hit = np.concatenate([np.argwhere(np.bitwise_count(codes[k : k + 500, None] ^ codes[None]) <= most) + [k, 0] for k in range(0, len(codes), 500)])
    return simhash.joined(np.arange(len(codes)), hit[:, 0], hit[:, 1])


def test_five_thousand_fingerprints():
    """All links, few comparisons: groups are cut with all below them."""
    codes = planted(4400)
    index = simhash.GrayIndex(np.zeros(len(codes), np.int64), codes)
    labels = index.links(4)
    assert (labels == all_links(index.codes)).all()
    pairs = len(codes) * (len(codes) - 1) // 2
    assert len(codes) > 5000 and index.visited < pairs // 2 and index.pruned > index.visited * 0.8


def test_ranges_hold_every_link(spark):
    """Over ranges of 400: the components are those of one index, and ranges far apart are not paired."""
    codes = planted(2500)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    ranges = simhash.gray_ranges(df, 400, len(codes)).collect()
    assert len(ranges) >= 7 and sum(len(r.codes) // 8 for r in ranges) == len(codes)
    edges = simhash.near_edges(df, range_rows=400).collect()
    at = {int(c): k for k, c in enumerate(codes.view(np.int64))}
    labels = simhash.joined(np.arange(len(codes)), np.array([at[e.a] for e in edges]), np.array([at[e.b] for e in edges]))
    assert (labels == all_links(codes)).all()


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, key long")


def test_documents_against_brute_force(spark):
    rng = np.random.default_rng(1)
    words = ["alpha", "Beta", "gamma", "DELTA", "eps", "zeta", "é", "x1", "the", "of"]
    rows = []
    for i in range(60):
        t = [words[k] for k in rng.integers(0, len(words), 200)]
        rows.append((3 * i, " ".join(t)))
        for j in range(rng.integers(0, 3)):
            u = list(t)
            u[int(rng.integers(0, 200))] = "changed"
            rows.append((1000 + 7 * i + j, "\n".join(u)))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "ONE  two"), (2005, "w " * 5000), (2005, "w " * 5000)]
    for rows_a_range in (None, 7):
        got = simhash.near_duplicates(frame(spark, [(a, b, "clash", 1) for a, b in rows]), range_rows=rows_a_range).toPandas()
        prints = [plain_print(t) for _, t in rows]
        want = sorted(zip([i for i, _ in rows], [f"{p:016x}" for p in prints], plain_components([i for i, _ in rows], prints), strict=True))
        assert sorted(zip(got.doc_id, got.fingerprint, got.component_id, strict=True)) == want


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
