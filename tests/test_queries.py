"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from spotweave.plans import registry

SF = "/root/testdata/sf0.001"
#: Quick ones of every kind; the driver compares all.
NAMES = [
    "labels_canonical_floor", "class_floor", "cohort_summary", "class_summary", "fold_table", "flagship", "sample_quotas", "slide_cap", "variance_donor",
    "mean_pairwise_cosine", "detrended_strata", "benjamini_hochberg", "quartile_table", "set_means", "score_conflicts", "unfolded_panel", "shared_vocabulary", "bbknn_graph", "contingency_agreement",
    "panel_split", "melted_deltas", "attached_pooled_wide", "model_pairs", "condition_pairs", "scope_classes", "contrast_rankings", "matched_strata", "enrichment_order", "pooled_slides", "spot_pixels",
    "enrichment_walk", "permutation_null", "silhouette_label", "bras", "isolated_label_score", "pooled_loso_on_fold", "normalised_counts",
    "artefact_states", "compared_methods", "representation_connectivity",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        path = f"{SF}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(df):
    cols = sorted(df.columns)
    cell = lambda v: float(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    x = df[cols].astype(object).where(df[cols].notna(), None).map(cell)
    return cols, sorted(map(tuple, x.values.tolist()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    assert plain(registry.queries()[name](spark, SF).toPandas()) == plain(con.execute(registry.oracle_sql()[name]).df())


def test_normalised_counts_of_all_genes(spark):
    sf = SF.replace("0.001", "0.01")  # more than 200 genes
    got = registry.queries()["normalised_counts"](spark, sf).toPandas()
    assert got.gene.max() > 200
    want = duckdb.sql(f"""WITH c AS (SELECT l_linenumber::VARCHAR AS sample_id, l_orderkey AS spot, l_partkey AS gene, sum(l_quantity) AS count FROM '{sf}/lineitem.parquet' GROUP BY ALL),
        t AS (SELECT sample_id, spot, sum(count) AS total FROM c GROUP BY ALL) SELECT sample_id, spot, gene, round(ln(1 + count / total * 1e4), 6) AS value FROM c JOIN t USING (sample_id, spot)""").df()
    assert plain(got) == plain(want)


def test_ridge_predicts_every_target(spark):
    got = registry.queries()["ridge_gcv_folds"](spark, SF).groupBy("fold").agg({"target": "collect_set"}).collect()
    assert got and all(sorted(r[1]) == list(range(32)) for r in got)


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.FLAGSHIP in registry.oracle_sql()
