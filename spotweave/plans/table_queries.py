"""Queries on report tables, sources, lookups and checks, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spotweave.functions import ids
from spotweave.functions.labels import is_labelled
from spotweave.functions.lineage import cut, shared_dir
from spotweave.operators import attempts, biosignal, correction, diagnostics, expression, folds, integration, knn, probes, reporting, results, tables
from spotweave.plans import probe_sql as S
from spotweave.plans.base_queries import N_BOOT, _pred, query_table, rounded
from spotweave.plans.cohort import SQL, spots
from spotweave.sources import arrays
from spotweave.sources import tables as sources
from spotweave.sources.artefacts import Artefacts

QUERIES, ORACLE, query = query_table()


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Report tables over scored rows: orders as scores of models (priority), scopes (status), seeds and folds ---------

_SCORED = """WITH r AS (SELECT o_orderpriority AS model, o_orderstatus AS scope, (o_custkey % 3)::VARCHAR AS seed, o_totalprice / 600000 AS f1_score, o_totalprice / 700000 AS ci_lo, o_totalprice / 500000 AS ci_hi,
  CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 4)::VARCHAR END AS fold, o_custkey % 50 AS n_donors, CASE WHEN o_orderkey % 3 = 0 THEN 'macro' ELSE 'other' END AS class, (o_totalprice - 150000) / 600000 AS delta, (o_custkey % 100) / 100 AS p_two_sided FROM orders)
"""


def _scored(spark, sf_dir):
    price = F.col("o_totalprice")
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("scope"), (F.col("o_custkey") % 3).cast("string").alias("seed"), (price / 600000).alias("f1_score"), (price / 700000).alias("ci_lo"), (price / 500000).alias("ci_hi"),
        F.when(F.col("o_orderkey") % 4 > 0, (F.col("o_orderkey") % 4).cast("string")).alias("fold"), (F.col("o_custkey") % 50).alias("n_donors"), F.when(F.col("o_orderkey") % 3 == 0, "macro").otherwise("other").alias("class"),
        ((price - 150000) / 600000).alias("delta"), ((F.col("o_custkey") % 100) / 100).alias("p_two_sided"),
    )


@query(_SCORED + """SELECT model, scope, round(avg(f1_score) FILTER (fold IS NULL), 6) AS mean, round(stddev_pop(f1_score) FILTER (fold IS NULL), 6) AS sd, round(avg(f1_score) FILTER (fold IS NOT NULL), 6) AS fold_mean,
  round(min(f1_score) FILTER (fold IS NOT NULL), 6) AS fold_min, round(max(f1_score) FILTER (fold IS NOT NULL), 6) AS fold_max, round(avg(ci_lo) FILTER (class = 'macro'), 6) AS ci_lo, round(avg(ci_hi) FILTER (class = 'macro'), 6) AS ci_hi FROM r GROUP BY ALL""")
def annotation_scores(spark, sf_dir):
    x = _scored(spark, sf_dir)
    return rounded(tables.annotation_table(x, x.select("model", "scope", "class", "ci_lo", "ci_hi")))


@query(_SCORED + "SELECT model, scope, round(avg(delta), 6) AS delta, round(avg(ci_lo), 6) AS ci_lo, round(avg(ci_hi), 6) AS ci_hi, max(p_two_sided) AS p_two_sided FROM r GROUP BY ALL")
def delta_summary(spark, sf_dir):
    return rounded(tables.delta_table(_scored(spark, sf_dir)))


@query(_SCORED + """, w AS (SELECT model AS method, seed, avg(f1_score) AS score, min(scope) AS note FROM r GROUP BY ALL), d AS (SELECT model AS method, avg(delta) AS delta_f1, max(p_two_sided) AS p_two_sided FROM r WHERE fold IS NULL GROUP BY ALL)
SELECT method, round(avg(score), 6) AS score, round(any_value(delta_f1), 6) AS delta_f1, any_value(p_two_sided) AS p_two_sided FROM w LEFT JOIN d USING (method) GROUP BY method""")
def method_table(spark, sf_dir):
    """Methods collapsed over seeds, with their paired deltas."""
    x = _scored(spark, sf_dir)
    wide = x.groupBy(F.col("model").alias("method"), "seed").agg(F.avg("f1_score").alias("score"))
    return rounded(tables.integration_table(wide, x.where("fold is null").select(F.col("model").alias("method"), F.col("delta").alias("delta_f1"), "p_two_sided"), ["score"]))


@query(_SCORED + ", p AS (SELECT model, seed, avg(f1_score) AS a, max(ci_hi) AS b FROM r GROUP BY ALL) SELECT model, round(avg(a), 6) AS ilisi, round(avg(b), 6) AS kbet FROM p GROUP BY model")
def panel_over_seeds(spark, sf_dir):
    """Panel rows named `model (seed n)` averaged over their seeds."""
    x = _scored(spark, sf_dir).groupBy(F.concat("model", F.lit(" (seed "), "seed", F.lit(")")).alias("representation")).agg(F.avg("f1_score").alias("ilisi"), F.max("ci_hi").alias("kbet"))
    return rounded(results.panel_means(x, ["ilisi", "kbet"]))


@query(_SCORED + "SELECT scope, max(n_donors) AS n_donors FROM r WHERE scope <> 'global' GROUP BY scope")
def organ_donor_counts(spark, sf_dir):
    return tables.organ_donors(_scored(spark, sf_dir))


@query(_SCORED + """, q AS (SELECT model, scope, seed, avg(ci_lo) AS ci_lo, CASE WHEN scope <> 'P' AND seed = '1' THEN max(ci_hi) END AS ci_lo_pooled FROM r GROUP BY model, scope, seed)
SELECT model, scope, seed, round(CASE WHEN bool_or(ci_lo_pooled IS NOT NULL) OVER (PARTITION BY scope) THEN ci_lo_pooled ELSE ci_lo END, 6) AS ci_lo FROM q""")
def preferred_intervals(spark, sf_dir):
    """The pooled interval where its scope has any, else the seed's own."""
    pooled = F.when((F.col("scope") != "P") & (F.col("seed") == "1"), F.max("ci_hi"))
    x = _scored(spark, sf_dir).groupBy("model", "scope", "seed").agg(F.avg("ci_lo").alias("ci_lo"), pooled.alias("ci_lo_pooled"))
    return rounded(tables.preferred(x, ["ci_lo"], "scope").select("model", "scope", "seed", "ci_lo"))


@query(_SCORED + """SELECT scope, class, round(avg(f1_score) FILTER (fold = '1'), 6) AS "1", round(avg(f1_score) FILTER (fold = '2'), 6) AS "2" FROM r GROUP BY ALL""")
def condition_columns(spark, sf_dir):
    return rounded(tables.by_condition(_scored(spark, sf_dir).withColumn("condition", F.col("fold")), ["1", "2"]))


@query(_SCORED + """, b AS (SELECT model, scope, avg(f1_score) AS value, avg(ci_lo) AS ci_lo, avg(ci_hi) AS ci_hi, CASE WHEN scope = 'F' THEN min(ci_lo) END AS ci_lo_pooled, CASE WHEN scope = 'F' THEN max(ci_hi) END AS ci_hi_pooled FROM r GROUP BY model, scope)
SELECT 'eval' AS stage, model, scope, 'f1_score' AS metric, round(value, 6) AS value, round(coalesce(ci_lo_pooled, ci_lo), 6) AS ci_lo, round(coalesce(ci_hi_pooled, ci_hi), 6) AS ci_hi FROM b""")
def melted_intervals(spark, sf_dir):
    first = F.col("scope") == "F"
    x = _scored(spark, sf_dir).groupBy("model", "scope").agg(F.avg("f1_score").alias("value"), F.avg("ci_lo").alias("ci_lo"), F.avg("ci_hi").alias("ci_hi"), F.when(first, F.min("ci_lo")).alias("ci_lo_pooled"), F.when(first, F.max("ci_hi")).alias("ci_hi_pooled"))
    return rounded(results.melt_intervals(x, stage="eval").select("stage", "model", "scope", "metric", "value", "ci_lo", "ci_hi"))


@query(_SCORED + "SELECT DISTINCT scope FROM r WHERE scope NOT IN ('F', 'O')")
def undeclared_scopes(spark, sf_dir):
    return results.undeclared(_scored(spark, sf_dir), "scope", ["F", "O"])


_TESTED = "WITH t AS (SELECT p_partkey AS source, (p_size % 40) / 400 AS padj, p_retailprice / 1000 - 1.4 AS mean_delta, p_retailprice / 1000 - 1.5 AS norm FROM part)\n"


def _tested(spark, sf_dir):
    price = F.col("p_retailprice") / 1000
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), ((F.col("p_size") % 40) / 400).alias("padj"), (price - 1.4).alias("mean_delta"), (price - 1.5).alias("norm"))


@query(_TESTED + "SELECT count(*) AS n_sets, count(*) FILTER (padj < 0.05) AS n_significant, count(*) FILTER (padj < 0.05 AND mean_delta > 0) AS n_up FROM t")
def set_caption_counts(spark, sf_dir):
    return tables.set_counts(_tested(spark, sf_dir))


@query(_TESTED + "SELECT source, round(padj, 6) AS padj, round(norm, 6) AS norm FROM t WHERE padj < 0.05")
def significant_sets(spark, sf_dir):
    return rounded(biosignal.significant(_tested(spark, sf_dir)).select("source", "padj", "norm"))


@query(_TESTED + "SELECT source, round(norm, 6) AS norm FROM t WHERE padj < 0.05 ORDER BY abs(norm) DESC, source LIMIT 6")
def strongest_sets(spark, sf_dir):
    return rounded(biosignal.strongest(biosignal.significant(_tested(spark, sf_dir))).select("source", "norm"))


# Sources and lookups ------------------------------------------------------------------------------------------


@query(SQL + """SELECT spot_key, CASE WHEN sample_id LIKE 'D%' AND region = 1 THEN 'listed-' || donor
  ELSE coalesce(nullif(regexp_extract(sample_id, '^(MW-[A-Za-z])-[0-9]', 1), ''), upper(nullif(regexp_extract(sample_id, '^([A-Za-z]+)[0-9]', 1), '')), sample_id) END AS tissue,
  CASE WHEN sample_id LIKE 'D%' AND region = 1 THEN 'train' ELSE 'test' END AS split FROM spots""")
def registry_lookup(spark, sf_dir):
    """Tissue and split by slide: from the registry where it lists the slide, else from the slide's id."""
    x = spots(spark, sf_dir)
    registry = x.where("sample_id like 'D%' and region = 1").select("sample_id", F.concat(F.lit("listed-"), "donor").alias("tissue"), F.lit("train").alias("split")).distinct()
    return ids.with_registry(x.drop("tissue", "split"), registry).select("spot_key", "tissue", "split")


@query(SQL + """, g AS (SELECT * FROM spots WHERE spot_key % 7 > 0), p AS (SELECT * FROM spots WHERE spot_key % 5 > 0)
SELECT g.dataset_id, g.sample_id, g.spot_id, round(g.gene_features[1]::DOUBLE, 6) AS gene, round(p.patch_features[1]::DOUBLE, 6) AS patch, CASE WHEN g.spot_key % 3 > 0 THEN coalesce(g.annotation_raw, 'UNASSIGNED') ELSE 'UNASSIGNED' END AS annotation,
  CASE WHEN g.spot_key % 3 > 0 THEN g.spot_key % 100 ELSE 0 END AS array_row FROM g JOIN p USING (spot_key)""")
def merged_modalities(spark, sf_dir):
    """Spots that both feature tables have, with their labels where there are any."""
    x, k = spots(spark, sf_dir), ["dataset_id", "sample_id", "spot_id"]
    gene, patch = x.where("spot_key % 7 > 0").select(*k, F.col("gene_features").alias("v")), x.where("spot_key % 5 > 0").select(*k, F.col("patch_features").alias("v"))
    label = x.where("spot_key % 3 > 0").select(*k, F.col("annotation_raw").alias("annotation"), (F.col("spot_key") % 100).alias("array_row"), (F.col("spot_key") % 100).alias("array_col"))
    m = sources.merge_modalities(gene, patch, label)
    return rounded(m.select(*k, F.col("gene_features")[0].cast("double").alias("gene"), F.col("patch_features")[0].cast("double").alias("patch"), "annotation", "array_row"))


@query(SQL + ", m AS (SELECT DISTINCT dataset_id, sample_id FROM spots) SELECT dataset_id, sample_id FROM m WHERE (dataset_id, sample_id) NOT IN (SELECT dataset_id, sample_id FROM spots WHERE is_real)")
def missing_outputs(spark, sf_dir):
    """Slides of the manifest without an output."""
    x = spots(spark, sf_dir)
    return sources.missing_outputs(x.select("dataset_id", "sample_id").distinct(), x.where(is_labelled("annotation")).select("dataset_id", "sample_id").distinct())


@query(SQL + "SELECT split, dataset_id, count(*) AS n, round(sum(gene_features[1]::DOUBLE), 6) AS gene, min(len(patch_features)) AS width FROM spots GROUP BY ALL")
def merged_splits(spark, sf_dir):
    """Both splits written with nested vectors, read as one table with their names."""
    x = spots(spark, sf_dir)
    nest = lambda c: F.array(F.col(c)).alias(c)
    place = f"{shared_dir(spark)}/spotweave-splits-{uuid.uuid4().hex}"
    paths = {s: f"{place}/{s}" for s in ("train", "test")}
    for s, path in paths.items():
        own = x.where(F.col("split") == s)
        own.select("sample_id", "spot_id", F.lit(0).alias("array_row"), F.lit(0).alias("array_col"), "dataset_id", "annotation", nest("gene_features"), nest("patch_features"), F.lit(1).alias("more")).write.parquet(path)
    m = sources.read_merged(spark, paths)
    return rounded(m.groupBy("split", "dataset_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("gene_features")[0].cast("double")).alias("gene"), F.min(F.size("patch_features")).alias("width")))


@query(SQL + """, f AS (SELECT sample_id, spot_id, spot_key, gene_features[1]::DOUBLE AS v FROM spots UNION ALL SELECT sample_id, spot_id, spot_key, gene_features[1]::DOUBLE FROM spots WHERE spot_key % 11 = 0)
SELECT count(*) AS n, count(*) FILTER (spot_key % 13 = 0) AS n_not_finite, count(*) FILTER (spot_key % 17 = 0) AS n_other_width,
  (SELECT count(*) FROM spots WHERE spot_key % 11 = 0) AS n_repeated, count(*) FILTER (spot_key % 19 = 0) AS n_unknown FROM f""")
def verified_features(spark, sf_dir):
    """What is wrong with a feature table into which faults were put by the spots' numbers."""
    x = spots(spark, sf_dir)
    v = F.when(F.col("spot_key") % 13 == 0, F.transform("gene_features", lambda a: F.lit(float("nan")))).otherwise(F.transform("gene_features", lambda a: a.cast("double")))
    v = F.when(F.col("spot_key") % 17 == 0, F.slice(v, 1, 5)).otherwise(v)
    rows = x.unionByName(x.where("spot_key % 11 = 0")).select("sample_id", "spot_id", v.alias("v"))
    return results.verify_features(rows, x.where("spot_key % 19 > 0"), 32)


@query(SQL + """, u AS (SELECT spot_key, gene_features::DOUBLE[] AS a, list_transform(gene_features::DOUBLE[], lambda v, i: v + CASE WHEN i = 1 AND spot_key % 10 = 0 THEN 0.5 ELSE 0 END) AS b FROM spots),
c AS (SELECT list_inner_product(a, b) / sqrt(list_inner_product(a, a) * list_inner_product(b, b)) AS c FROM u) SELECT count(c) AS n, round(min(c), 6) AS least, round(quantile_cont(c, 0.01), 6) AS p01, round(avg(c), 6) AS mean FROM c""")
def refit_cosines(spark, sf_dir):
    x = spots(spark, sf_dir).select("spot_key", F.transform("gene_features", lambda a: a.cast("double")).alias("v"))
    y = x.select("spot_key", F.transform("v", lambda a, i: a + F.when((i == 0) & (F.col("spot_key") % 10 == 0), 0.5).otherwise(0.0)).alias("v"))
    return rounded(results.refit_check(x, y, "spot_key", "v"))


@query(SQL + "SELECT dataset_id, sample_id, spot_id, row_number() OVER (PARTITION BY dataset_id, sample_id ORDER BY spot_id) - 1 AS place, count(*) OVER (PARTITION BY dataset_id, sample_id) AS n_spots FROM spots")
def slide_places(spark, sf_dir):
    """All spots of every slide, in place."""
    return expression.slide_places(spots(spark, sf_dir))


@query("WITH n AS (SELECT p_type AS gene, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part), f AS (SELECT gene, min(place) AS place FROM n GROUP BY gene) SELECT p_partkey, coalesce(f.place, -1) AS place FROM part LEFT JOIN f ON f.gene = CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_type || '?' END")
def gene_lookup(spark, sf_dir):
    """Genes' first places among names that repeat; a third of the genes asked for are there."""
    part = _read(spark, sf_dir, "part")
    names = part.select(F.col("p_type").alias("gene"), "p_partkey")
    from spotweave.operators.ranking import global_rank

    placed = global_rank(names, ["p_partkey"], "place")[0].select("gene", (F.col("place") - 1).alias("place"))
    asked = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.concat("p_type", F.lit("?"))).alias("gene"))
    found = expression.gene_lookup(placed, asked.select("gene").distinct())
    return asked.join(found, "gene").select("p_partkey", "place")


# Diagnostics, probes, targets -----------------------------------------------------------------------------------

_GROUPED = SQL + """, sample AS (SELECT *, CASE WHEN dataset_id = 'cohort_a' THEN regexp_extract(sample_id, '^(D[0-9]+)-', 1) ELSE sample_id END AS patient FROM spots ORDER BY md5(concat_ws('|', '42', 'variance', spot_key)), spot_key LIMIT 50000
), z AS (SELECT c."column", g.grouping, CASE g.grouping WHEN 'sample_id' THEN sample_id WHEN 'patient' THEN patient WHEN 'tissue' THEN tissue ELSE dataset_id END AS g, generate_subscripts(gene_features, 1) AS pos,
  unnest(CASE c."column" WHEN 'gene_features' THEN gene_features ELSE patch_features END)::DOUBLE AS v FROM sample, (SELECT unnest(['gene_features', 'patch_features']) AS "column") c, (SELECT unnest(['sample_id', 'patient', 'tissue', 'dataset_id']) AS grouping) g
), m AS (SELECT "column", grouping, g, pos, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM z GROUP BY ALL
), d AS (SELECT "column", grouping, pos, sum(q) - sum(s) * sum(s) / sum(n) AS t, sum(s * s / n) - sum(s) * sum(s) / sum(n) AS b, sum(n) AS n, count(*) AS groups FROM m GROUP BY ALL)
SELECT "column", grouping, max(n)::BIGINT AS n, max(groups) AS n_groups, round(sum(t), 4) AS total_ss, round(sum(b), 4) AS between_ss, round(sum(t) - sum(b), 4) AS within_ss,
  round(sum(b) / sum(t), 4) AS between_fraction, round((sum(t) - sum(b)) / sum(t), 4) AS within_fraction FROM d GROUP BY ALL"""


@query(_GROUPED)
def variance_table(spark, sf_dir):
    """Variance by slide, patient, tissue and cohort, of a sample of 50,000 rows at most (the operator's own cap)."""
    registry = spark.createDataFrame([("cohort_a", "^(D[0-9]+)-"), ("cohort_b", None)], "dataset_id string, donor_pattern string")
    x = diagnostics.resolved_grouping(spots(spark, sf_dir), "patient", registry)
    return rounded(diagnostics.variance_table(x, ["gene_features", "patch_features"], ["sample_id", "patient", "tissue", "dataset_id"], cap=50_000), 4)


@query(SQL + S.PREDICTIONS + S.scoped() + S.counts() + """
, value AS (
  SELECT scope, class, f AS value FROM counts_m WHERE support > 0 UNION ALL SELECT scope, 'macro', avg(f) FROM counts_m WHERE support > 0 GROUP BY scope
), donors AS (SELECT scope, count(DISTINCT donor) AS n_donors FROM scoped GROUP BY scope)
""" + S.replicates(N_BOOT) + """
SELECT 7 AS seed, v.scope, v.class, round(value, 6) AS value, n_donors, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi, coalesce(nb, 0) AS n_boot FROM value v JOIN donors USING (scope)
LEFT JOIN (SELECT scope, class, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, count(DISTINCT replicate) AS nb FROM draws GROUP BY ALL) USING (scope, class)""")
def scored_prediction(spark, sf_dir):
    """One prediction scored by scope and class, with donor intervals, under its seed."""
    return rounded(reporting.score_prediction(_pred(spark, sf_dir).withColumn("seed", F.lit(7)), ["seed"], N_BOOT))


@query()
def capped_probe(spark, sf_dir):
    """Leave-one-donor-out with at most 40 training rows a fold, classes in proportion."""
    rows = probes.standard_rows(spots(spark, sf_dir), "gene_features")
    return probes.dispatch("loso_donor", rows, cap=40).drop("level")


@query()
def level_ridge(spark, sf_dir):
    """R2 of every target over the held-out rows of a level's folds together."""
    x = spots(spark, sf_dir).where("split = 'test'").withColumnRenamed("spot_key", "key")
    made = cut(biosignal.fold_ridge(x, "gene_features", "patch_features", "donor", min_train=50, min_test=5))
    levels = made.select("fold").distinct().withColumn("level", F.lit("cross_donor"))
    return rounded(biosignal.level_r2(made, levels))


def _combat_sql(rounds: int) -> str:
    return SQL + f""", z AS (SELECT spot_key, sample_id AS b, generate_subscripts(gene_features, 1) - 1 AS pos, unnest(gene_features)::DOUBLE AS v FROM spots
), m AS (SELECT b, pos, count(*)::DOUBLE AS n, sum(v) AS s, sum(v * v) AS q FROM z GROUP BY ALL
), g AS (SELECT pos, sum(s) / sum(n) AS grand, greatest(sum(q - s * s / n) / sum(n), 1e-12) AS pooled FROM m GROUP BY pos
), h AS (SELECT m.*, grand, pooled, (s / n - grand) / sqrt(pooled) AS gamma, greatest((q - s * s / n) / greatest(n - 1, 1) / pooled, 1e-12) AS delta, (q - 2 * s * grand + n * grand * grand) / pooled AS ss, (s - n * grand) / sqrt(pooled) AS sz FROM m JOIN g USING (pos)
), p AS (SELECT b, avg(gamma) AS g0, greatest(var_samp(gamma), 1e-12) AS t2, avg(delta) AS dm, greatest(var_samp(delta), 1e-12) AS dv FROM h GROUP BY b
), k AS (SELECT h.*, g0, t2, (2 * dv + dm * dm) / dv AS ia, (dm * dv + dm * dm * dm) / dv AS ib FROM h JOIN p USING (b)
), it AS (SELECT 0 AS i, b, pos, gamma AS x, delta AS y FROM k UNION ALL
  SELECT i + 1, b, pos, nx, (0.5 * (ss - 2 * nx * sz + n * nx * nx) + ib) / (n / 2 + ia - 1) FROM (SELECT it.i, k.*, (t2 * n * gamma + it.y * g0) / (t2 * n + it.y) AS nx FROM it JOIN k USING (b, pos) WHERE it.i < {rounds})
) SELECT spot_key, pos::INTEGER AS component, round(v / sqrt(y) + grand - (grand + sqrt(pooled) * x) / sqrt(y), 6) AS value FROM z JOIN it USING (b, pos) JOIN g USING (pos) WHERE i = {rounds}"""


@query(_combat_sql(40))
def combat_rounds(spark, sf_dir):
    """The location-and-scale correction after forty rounds of its shrinkage, whether it settled before or not."""
    x = correction.combat(spots(spark, sf_dir), "sample_id", "gene_features", rounds=40, tolerance=0.0)
    return rounded(x.select("spot_key", F.posexplode("z").alias("component", "value")))


@query(SQL + "SELECT DISTINCT level, fold FROM folds WHERE level = 'cross_slide'")
def fold_names(spark, sf_dir):
    """The folds that a protocol on folds is dispatched over."""
    return folds.BUILDERS["cross_slide"](folds.annotated_slides(spots(spark, sf_dir))).select("level", "fold").distinct()


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, round(embedding[3]::DOUBLE, 6) AS first, round(list_sum(embedding[3:10])::DOUBLE, 4) AS total FROM embeddings")
def array_rows(spark, sf_dir):
    """The embeddings written as numpy files by the tasks that hold them, and columns 2 to 9 read back by ranges of rows."""
    place = f"{shared_dir(spark)}/spotweave-arrays-{uuid.uuid4().hex}"
    index = cut(arrays.write_arrays(_read(spark, sf_dir, "embeddings"), place, "embedding", ["vec_id"], 64))
    x = arrays.read_parts(spark, place, index, columns="2:10", range_bytes=1 << 20)
    return x.select("row", F.round(F.col("v")[0], 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query(_SCORED + """SELECT 'scores' AS what, 'there' AS state, count(*) AS n FROM r UNION ALL SELECT 'deltas', 'there', count(*) FROM r WHERE fold IS NULL
UNION ALL SELECT 'intervals', 'pending', 0 UNION ALL SELECT 'ablation', 'pending', 0""")
def artefact_states(spark, sf_dir):
    """Tables of a run that has come half way: two that a stage left, one it leaves only when asked to, one of a stage that has not begun."""
    x = _scored(spark, sf_dir)
    run = Artefacts(spark, f"{shared_dir(spark)}/spotweave-run-{uuid.uuid4().hex}")
    run.write(x, "score", "scores")
    run.write(x.where("fold is null"), "score", "deltas")
    asked = {"scores": run.read("score", "scores", "scores"), "deltas": run.read("score", "deltas", "deltas"), "intervals": run.read("score", "intervals", "intervals", required=False), "ablation": run.read("ablate", "rows", "ablation")}
    out = run.pending_table().select("what", F.lit("pending").alias("state"), F.lit(0).cast("long").alias("n"))
    for name, rows in asked.items():
        if rows is not None:
            out = out.unionByName(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), F.lit("there").alias("state"), "n"))
    return out


@query(f"""WITH RECURSIVE c AS (SELECT * FROM ({_combat_sql(5)})), n AS (SELECT * FROM ({SQL} SELECT spot_key, generate_subscripts(gene_features, 1) - 1 AS component, unnest(gene_features)::DOUBLE AS value FROM spots))
SELECT 'combat' AS method, component, round(avg(value * value), 4) AS square FROM c GROUP BY component UNION ALL SELECT 'none', component::INTEGER, round(avg(value * value), 4) FROM n GROUP BY component""")
def compared_methods(spark, sf_dir):
    """Second moments of every component with and without a correction, each method made once and kept apart from the others' failures."""
    x = spots(spark, sf_dir)
    methods = {
        "none": lambda: x.select(F.col("gene_features").cast("array<double>").alias("z")),
        "combat": lambda: correction.combat(x, "sample_id", "gene_features", rounds=5, tolerance=0.0).select("z"),
    }
    score = lambda df: df.select(F.posexplode("z").alias("component", "value")).groupBy("component").agg(F.round(F.avg(F.col("value") * F.col("value")), 4).alias("square"))
    return attempts.compared(spark, methods, score).drop("crash")


@query(SQL + """, x AS (SELECT 'genes' AS of, spot_key AS key, annotation AS label, gene_features::DOUBLE[] AS x FROM spots WHERE is_real UNION ALL SELECT 'patches', spot_key, annotation, patch_features::DOUBLE[] FROM spots WHERE is_real
), p AS (SELECT of, a.key, b.key AS other, a.label = b.label AS same, row_number() OVER (PARTITION BY of, a.key ORDER BY list_distance(a.x, b.x), b.key) AS r FROM x a JOIN x b USING (of) WHERE a.key <> b.key
), edge AS (SELECT of, key, other FROM p WHERE r < 15 AND same UNION SELECT of, other, key FROM p WHERE r < 15 AND same
), reach AS (SELECT of, key, key AS other FROM x UNION SELECT reach.of, reach.key, edge.other FROM reach JOIN edge ON edge.of = reach.of AND edge.key = reach.other
), part AS (SELECT of, key, min(other) AS part FROM reach GROUP BY ALL), size AS (SELECT of, label, part, count(*) AS n FROM part JOIN x USING (of, key) GROUP BY ALL)
SELECT of AS representation, (SELECT count(*) FROM x WHERE x.of = s.of) AS n_rows, round(avg(share), 6) AS graph_connectivity FROM (SELECT of, label, max(n) / sum(n) AS share FROM size GROUP BY of, label) s GROUP BY of""")
def representation_connectivity(spark, sf_dir):
    """The driver over representations with one metric: how connected each one's neighbour graph is."""
    x = spots(spark, sf_dir).where(is_labelled("annotation"))

    def score(df, column):
        rows = df.select(F.col("spot_key").alias("key"), F.lit("all").alias("batch"), F.col("annotation").alias("label"), F.col(column).cast("array<double>").alias("x"))
        size = integration.GRAPH_SIZES["graph_connectivity"]
        return integration.graph_connectivity(integration.graph_at(knn.padded_graph(rows.select("key", "batch", "x"), size - 1), size), rows)

    out = attempts.scored_representations(x, "spot_key", {"genes": "gene_features", "patches": "patch_features"}, score)
    return rounded(out.drop("embedding"))
