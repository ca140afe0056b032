"""Queries on variance, targets, sets, scores, tables, counts, correction and integration, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.functions.labels import is_labelled
from spotweave.functions.lineage import cut, shared_dir
from spotweave.operators import arms, biosignal, canonical, correction, counts, diagnostics, hvg, integration, knn, linalg, models, nulls, results, reuse, tables
from spotweave.plans.base_queries import query_table, rounded
from spotweave.plans.cohort import SQL, spots

QUERIES, ORACLE, query = query_table()


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Diagnostics ---------------------------------------------------------------------------

_GROUPS = ("sample_id", "donor", "tissue", "dataset_id")
_VARIANCE = SQL + """, z AS (SELECT {g} AS g, generate_subscripts(gene_features, 1) AS pos, unnest(gene_features)::DOUBLE AS v FROM spots
), m AS (SELECT g, pos, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM z GROUP BY ALL
), d AS (SELECT pos, sum(q) - sum(s) * sum(s) / sum(n) AS t, sum(s * s / n) - sum(s) * sum(s) / sum(n) AS b, sum(n) AS n FROM m GROUP BY pos)
SELECT 'gene_features' AS "column", '{g}' AS grouping, max(n)::BIGINT AS n, (SELECT count(DISTINCT g) FROM m) AS n_groups, round(sum(t), 4) AS total_ss, round(sum(b), 4) AS between_ss,
  round(sum(t) - sum(b), 4) AS within_ss, round(sum(b) / sum(t), 4) AS between_fraction, round((sum(t) - sum(b)) / sum(t), 4) AS within_fraction FROM d"""


def _variance(g):
    def run(spark, sf_dir):
        return rounded(diagnostics.variance_split(spots(spark, sf_dir), "gene_features", g), 4)

    run.__name__ = f"variance_{g}"
    return run


for _g in _GROUPS:
    query(_VARIANCE.format(g=_g))(_variance(_g))


@query("""WITH u AS (SELECT generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS v FROM embeddings),
s AS (SELECT pos, sum(v) AS s FROM u GROUP BY pos), n AS (SELECT count(*) AS n FROM embeddings)
SELECT n, round(((SELECT sum(s * s) FROM s) - (SELECT sum(v * v) FROM u)) / (n * (n - 1)), 6) AS mean_pairwise_cosine FROM n""")
def mean_pairwise_cosine(spark, sf_dir):
    return rounded(diagnostics.mean_pairwise_cosine(_read(spark, sf_dir, "embeddings"), "embedding"))


@query(SQL + """, p AS (SELECT generate_subscripts(gene_features, 1) - 1 AS component, unnest(gene_features)::DOUBLE AS a, unnest(patch_features)::DOUBLE AS b FROM spots)
SELECT component::INTEGER AS component, round(abs(corr(a, b)), 6) AS correlation FROM p GROUP BY component""")
def matching_correlation(spark, sf_dir):
    return rounded(diagnostics.matching_correlation(spots(spark, sf_dir), "gene_features", "patch_features"))


@query()
def effective_rank(spark, sf_dir):
    x = spots(spark, sf_dir)
    rows = [(c, linalg.effective_rank(x, c)) for c in ("gene_features", "patch_features")]
    return rounded(spark.createDataFrame(rows, "column string, eff_rank double"))


@query()
def effective_rank_bootstrap(spark, sf_dir):
    return rounded(diagnostics.effective_rank_table(spots(spark, sf_dir), "gene_features", 8000, 5))


@query()
def effective_rank_controls(spark, sf_dir):
    return rounded(diagnostics.control_ranks(spots(spark, sf_dir), "gene_features", "spot_key", 8))


@query()
def cca_spectrum(spark, sf_dir):
    """Canonical correlations of the views against both nulls, and the shares that slides do not explain."""
    return rounded(canonical.spectrum_rows(spots(spark, sf_dir), "gene_features", "patch_features", "sample_id", "spot_key"))


@query()
def cca_ceiling(spark, sf_dir):
    """The whole canonical diagnostic in a row."""
    return rounded(canonical.ceiling(spots(spark, sf_dir), "gene_features", "patch_features", "sample_id", "donor", "spot_key", min_test=10))


@query()
def cca_leave_one_slide_out(spark, sf_dir):
    return rounded(diagnostics.leave_one_slide_out(spots(spark, sf_dir), "gene_features", "patch_features", "sample_id", "donor", min_test=10))


@query()
def pca_gene(spark, sf_dir):
    x = models.pca_embedding(spots(spark, sf_dir), "gene_features", 4, "split = 'train'")
    return rounded(x.select("spot_key", F.posexplode("z").alias("component", "value")))


# Targets and sets ----------------------------------------------------------------------

_PREDICTED = """WITH p AS (SELECT l_linenumber AS level, l_partkey AS gene, l_extendedprice AS y, l_quantity * 1500 AS g FROM lineitem),
r AS (SELECT level, gene, count(*) AS n, CASE WHEN sum(y * y) - sum(y) * sum(y) / count(*) > 1e-12 * greatest(sum(y * y), 1) THEN 1 - sum((y - g) * (y - g)) / (sum(y * y) - sum(y) * sum(y) / count(*)) END AS r2 FROM p GROUP BY ALL)
"""


def _r2(spark, sf_dir):
    x = _read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("level"), F.col("l_partkey").alias("gene"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("g"))
    return biosignal.r2_by_target(x, ["level", "gene"], "y", "g")


@query(_PREDICTED + "SELECT level, gene, n, round(r2, 4) AS r2 FROM r WHERE n > 3")
def r2_by_target(spark, sf_dir):
    return rounded(_r2(spark, sf_dir).where("n > 3"), 4)


_GENES = """WITH s AS (SELECT l_partkey AS target, avg(l_discount) AS value, avg(l_quantity) AS baseline, avg(l_tax) AS other FROM lineitem GROUP BY 1)
"""


def _genes(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("target")).agg(F.avg("l_discount").alias("value"), F.avg("l_quantity").alias("baseline"), F.avg("l_tax").alias("other"))


@query(_GENES + """, t AS (SELECT *, ntile(5) OVER (ORDER BY round(baseline, 6), target) - 1 AS stratum FROM s)
SELECT target, stratum::INTEGER AS stratum, round(value - avg(value) OVER (PARTITION BY stratum), 6) AS detrended FROM t""")
def detrended_strata(spark, sf_dir):
    x = _genes(spark, sf_dir).withColumn("baseline", F.round("baseline", 6))
    return rounded(biosignal.detrended(x, "baseline", "value", "target", 5).select("target", "stratum", "detrended"))


@query(_GENES + """, q AS (SELECT target, round(other, 6) AS p, count(*) OVER () AS m, row_number() OVER (ORDER BY round(other, 6), target) AS r FROM s)
SELECT target, p, round(least(1, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS padj FROM q""")
def benjamini_hochberg(spark, sf_dir):
    x = _genes(spark, sf_dir).select("target", F.round("other", 6).alias("p"))
    return rounded(biosignal.benjamini_hochberg(x, "p"))


@query(_GENES + """, x AS (SELECT round(baseline, 6) AS v, round(value - other, 6) AS d FROM s), e AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM x)
SELECT (CASE WHEN v <= a THEN 1 WHEN v <= b THEN 2 WHEN v <= c THEN 3 ELSE 4 END)::INTEGER AS quartile, count(*) AS n_genes, min(v) AS frozen_r2_min, max(v) AS frozen_r2_max,
  round(avg(d), 6) AS mean_delta_r2, round(100 * avg((d > 0)::INT), 6) AS pct_improved FROM x, e GROUP BY 1""")
def quartile_table(spark, sf_dir):
    x = _genes(spark, sf_dir).select(F.round("baseline", 6).alias("r2_frozen"), F.round(F.col("value") - F.col("other"), 6).alias("delta_r2"))
    return rounded(biosignal.quartiles(x))


_SETS = _GENES + """, net AS (SELECT DISTINCT p_brand AS source, p_partkey AS target FROM part), mem0 AS (SELECT source, target, value FROM net JOIN s USING (target)),
mem AS (SELECT * FROM mem0 WHERE source IN (SELECT source FROM mem0 GROUP BY source HAVING count(*) >= 5))
"""


def _members(spark, sf_dir):
    net = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("target"))
    g = cut(_genes(spark, sf_dir))  # read several times by every test
    return net, g, biosignal.set_members(net, g, 5)


@query(_SETS + "SELECT source, count(*) AS set_size, round(avg(value), 6) AS mean, round((SELECT avg(value) FROM s), 6) AS background, round(avg(value) - (SELECT avg(value) FROM s), 6) AS mean_delta FROM mem GROUP BY source")
def set_means(spark, sf_dir):
    _, g, m = _members(spark, sf_dir)
    return rounded(biosignal.set_means(m, g))


@query(_SETS + "SELECT count(*) AS n_targets, count(s.target) AS n_covered, count(s.target) / count(*) AS coverage FROM (SELECT DISTINCT target FROM net) n LEFT JOIN s USING (target)")
def set_coverage(spark, sf_dir):
    net, g, _ = _members(spark, sf_dir)
    return biosignal.coverage(net, g)


@query(_SETS + """, x AS (SELECT target, value, unnest(range(5))::INTEGER AS replicate FROM s), a AS (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY target) AS r FROM x),
b AS (SELECT replicate, value AS moved, row_number() OVER (PARTITION BY replicate ORDER BY substr(md5(concat_ws('|', '42', 'null', replicate // 4, target)), 8 * (replicate % 4) + 1, 8), target) AS r FROM x)
SELECT mem.source, a.replicate, round(avg(moved), 6) AS value FROM mem JOIN a USING (target) JOIN b ON a.replicate = b.replicate AND a.r = b.r GROUP BY ALL""")
def permutation_null(spark, sf_dir):
    _, g, m = _members(spark, sf_dir)
    return rounded(biosignal.permutation_null(m, g, 5))


_NULL = """, x AS (SELECT target, value, {s} AS stratum, unnest(range({n}))::INTEGER AS replicate FROM s), a AS (SELECT *, row_number() OVER (PARTITION BY replicate, stratum ORDER BY target) AS r FROM x),
b0 AS (SELECT replicate, stratum, value AS moved, row_number() OVER (PARTITION BY replicate, stratum ORDER BY substr(md5(concat_ws('|', '42', 'null', replicate // 4, target)), 8 * (replicate % 4) + 1, 8), target) AS r FROM x),
nul AS (SELECT mem.source, a.replicate, avg(moved) AS value FROM mem JOIN a USING (target) JOIN b0 ON a.replicate = b0.replicate AND a.stratum = b0.stratum AND a.r = b0.r GROUP BY ALL)
"""
_TESTS = """, o AS (SELECT source, count(*) AS set_size, avg(value) AS mean FROM mem GROUP BY source), e AS (SELECT source, avg(value) AS expected FROM nul GROUP BY source),
p AS (SELECT source, greatest(avg((abs(nul.value - expected) >= abs(mean - expected) - 1e-9 * (abs(mean) + abs(expected)))::INT), 1.0 / {n}) AS pval FROM nul JOIN o USING (source) JOIN e USING (source) GROUP BY source),
q AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY pval) AS r FROM p), b AS (SELECT avg(value) AS background FROM s)
SELECT source, set_size, round(mean, 6) AS mean, round(background, 6) AS background, round(mean - background, 6) AS mean_delta, round(expected, 6) AS expected, round(pval, 6) AS pval,
  round(least(1, min(pval * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS padj FROM q JOIN o USING (source) JOIN e USING (source), b"""
N_NULL = 10_000


@query(_SETS + _NULL.format(s="0", n=N_NULL) + _TESTS.format(n=N_NULL))
def set_mean_tests(spark, sf_dir):
    _, g, m = _members(spark, sf_dir)
    return rounded(biosignal.set_mean_tests(m, g, N_NULL))


@query(_SETS.replace("SELECT l_partkey AS target", "SELECT *, ntile(5) OVER (ORDER BY baseline, target) AS st FROM (SELECT l_partkey AS target").replace("FROM lineitem GROUP BY 1)", "FROM lineitem GROUP BY 1))") + _NULL.format(s="st", n=N_NULL) + _TESTS.format(n=N_NULL))
def matched_null(spark, sf_dir):
    _, g, m = _members(spark, sf_dir)
    x = biosignal.strata(g, "baseline", "target", 5)
    return rounded(biosignal.set_mean_tests(m, x, N_NULL, stratum="stratum"))


@query(_SETS + """, k AS (SELECT target, value AS v, row_number() OVER (ORDER BY value DESC, target) AS r FROM s), n AS (SELECT count(*) AS n FROM s),
h AS (SELECT source, r, abs(v) AS w, count(*) OVER (PARTITION BY source) AS k, sum(abs(v)) OVER (PARTITION BY source) AS t, row_number() OVER (PARTITION BY source ORDER BY r) AS i,
  sum(abs(v)) OVER (PARTITION BY source ORDER BY r ROWS UNBOUNDED PRECEDING) AS c FROM mem JOIN k USING (target)),
p AS (SELECT source, k, (c - w) / t - (r - i) / (n - k) AS v, 2 * r AS pos FROM h, n UNION ALL SELECT source, k, c / t - (r - i) / (n - k), 2 * r + 1 FROM h, n)
SELECT source, any_value(k) AS set_size, round(arg_max(v, struct_pack(a := abs(v), b := -pos)), 6) AS es FROM p GROUP BY source""")
def enrichment_walk(spark, sf_dir):
    """The running-sum scores alone, without their null."""
    _, g, m = _members(spark, sf_dir)
    _, hits, total = nulls.ranking_hits(g, m)
    return rounded(nulls.running_scores(hits, total))


@query()
def enrichment(spark, sf_dir):
    net, g, _ = _members(spark, sf_dir)
    return rounded(biosignal.enrichment_scores(g, net, times=N_NULL))


@query()
def ridge_gcv_folds(spark, sf_dir):
    x = spots(spark, sf_dir).where("split = 'test'").withColumnRenamed("spot_key", "key")
    return rounded(biosignal.r2_by_target(biosignal.fold_ridge(x, "gene_features", "patch_features", "donor"), ["fold", "target"], "truth", "guess"))


# Scores --------------------------------------------------------------------------------

_SCORES = """WITH a AS (SELECT o_orderpriority AS model, o_orderstatus AS scope, avg(o_totalprice) / 1e6 AS accuracy, stddev_pop(o_totalprice) / 1e6 AS f1_score FROM orders GROUP BY ALL),
b AS (SELECT model, scope, accuracy + CASE WHEN scope = 'F' THEN 0.01 ELSE 0 END AS accuracy, f1_score FROM a),
long AS (SELECT 'eval' AS stage, 'eval.csv' AS source, model, scope, 'accuracy' AS metric, accuracy AS value FROM a UNION ALL SELECT 'eval', 'eval.csv', model, scope, 'f1_score', f1_score FROM a
 UNION ALL SELECT 'integrate', 'int.csv', CASE WHEN model = '1-URGENT' THEN 'urgent' ELSE model END, scope, 'accuracy', accuracy FROM b UNION ALL SELECT 'integrate', 'int.csv', CASE WHEN model = '1-URGENT' THEN 'urgent' ELSE model END, scope, 'f1_score', f1_score FROM b)
"""
_ALIASES = {("integrate", "urgent"): "1-URGENT"}


def _scores(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("scope"))
    a = o.agg((F.avg("o_totalprice") / 1e6).alias("accuracy"), (F.stddev_pop("o_totalprice") / 1e6).alias("f1_score"))
    b = a.withColumn("accuracy", F.col("accuracy") + F.when(F.col("scope") == "F", 0.01).otherwise(0.0)).withColumn("model", F.when(F.col("model") == "1-URGENT", "urgent").otherwise(F.col("model")))
    return results.union_scores(results.melt_points(a, stage="eval", source="eval.csv"), results.melt_points(b, stage="integrate", source="int.csv"))


@query(_SCORES + "SELECT stage, source, model, scope, metric, round(value, 6) AS value FROM long")
def melted_scores(spark, sf_dir):
    return rounded(_scores(spark, sf_dir).select("stage", "source", "model", "scope", "metric", "value"))


@query(_SCORES + """, c AS (SELECT CASE WHEN model = 'urgent' THEN '1-URGENT' ELSE model END AS model, source, scope, metric, value FROM long)
SELECT model, scope, metric, count(DISTINCT source) AS n_sources, round(max(value) - min(value), 6) AS spread FROM c GROUP BY ALL HAVING count(DISTINCT source) >= 2 AND max(value) - min(value) > 5e-4""")
def score_conflicts(spark, sf_dir):
    return rounded(results.conflicts(_scores(spark, sf_dir), aliases=_ALIASES).select("model", "scope", "metric", "n_sources", "spread"))


@query(_SCORES + """, c AS (SELECT CASE WHEN model = 'urgent' THEN '1-URGENT' ELSE model END AS model, source, scope, metric FROM long), k AS (SELECT model, scope, metric, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM c GROUP BY ALL HAVING count(DISTINCT source) >= 2)
SELECT sources, count(*) AS n_cells FROM k GROUP BY sources""")
def score_cross_checks(spark, sf_dir):
    return results.cross_checks(_scores(spark, sf_dir), aliases=_ALIASES)


@query("SELECT 'integrate' AS stage, 'nobody' AS model, 'nothing' AS target")
def idle_aliases(spark, sf_dir):
    return results.idle_aliases(_scores(spark, sf_dir), {**_ALIASES, ("integrate", "nobody"): "nothing"})


@query("""WITH w AS (SELECT o_orderpriority AS model, avg(o_totalprice) AS x, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*)::DOUBLE AS n FROM orders GROUP BY 1)
SELECT model, 'f1_score' AS metric, 'global' AS scope, 'cross_donor' AS level, round(x, 4) AS value, lo AS ci_lo, hi AS ci_hi FROM w UNION ALL SELECT model, 'batch/ilisi', NULL, NULL, n, NULL, NULL FROM w""")
def unfolded_panel(spark, sf_dir):
    x = _read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.avg("o_totalprice").alias("f1/global/cross_donor"), F.min("o_totalprice").alias("f1/global/cross_donor_lo"), F.max("o_totalprice").alias("f1/global/cross_donor_hi"), F.count(F.lit(1)).alias("batch/ilisi"))
    return rounded(results.unfold_wide(x), 4)


# Tables --------------------------------------------------------------------------------

_ORDERS = "SELECT o_orderpriority AS model, o_orderstatus AS scope, o_orderstatus AS protocol, o_totalprice AS f1_score, o_custkey AS n_donors FROM orders"


def _results(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("scope"), F.col("o_orderstatus").alias("protocol"), F.col("o_totalprice").alias("f1_score"), F.col("o_custkey").alias("n_donors"))


@query(f"SELECT model, protocol, scope, round(avg(f1_score), 4) AS mean, round(stddev_samp(f1_score), 4) AS sd, count(f1_score) AS n FROM ({_ORDERS}) GROUP BY ALL")
def headline_table(spark, sf_dir):
    return rounded(tables.headline(_results(spark, sf_dir)), 4)


@query(f"""SELECT model, round(avg(f1_score) FILTER (scope = 'F'), 4) AS "F_f1", max(n_donors) FILTER (scope = 'F') AS "F_donors", round(avg(f1_score) FILTER (scope = 'O'), 4) AS "O_f1", max(n_donors) FILTER (scope = 'O') AS "O_donors" FROM ({_ORDERS}) GROUP BY model""")
def organ_table(spark, sf_dir):
    return rounded(tables.per_organ(_results(spark, sf_dir), ["F", "O"]), 4)


@query("""WITH p AS (SELECT o_orderpriority AS class, o_orderstatus AS scope, o_custkey % 3 AS seed, count(*) AS support, avg(o_totalprice / 600000) AS recall, avg(o_totalprice / 550000) AS precision FROM orders GROUP BY ALL),
x AS (SELECT class, seed, sum(recall * support) AS tp, sum(support - recall * support) AS fn, sum(CASE WHEN precision > 0 THEN recall * support / precision - recall * support ELSE 0 END) AS fp FROM p GROUP BY ALL)
SELECT class, round(avg(CASE WHEN 2 * tp + fn + fp > 0 THEN 2 * tp / (2 * tp + fn + fp) ELSE 0 END), 6) AS f1_score, count(*) AS n_seeds FROM x GROUP BY class""")
def micro_pooled_f1(spark, sf_dir):
    p = _read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("scope"), (F.col("o_custkey") % 3).alias("seed")).agg(F.count(F.lit(1)).alias("support"), F.avg(F.col("o_totalprice") / 600000).alias("recall"), F.avg(F.col("o_totalprice") / 550000).alias("precision"))
    return rounded(tables.micro_pooled(p, []))


@query("SELECT m AS model, row_number() OVER (ORDER BY coalesce(nullif(list_position(['5-LOW', '2-HIGH'], m), 0), 99), m)::INTEGER AS rank FROM (SELECT DISTINCT o_orderpriority AS m FROM orders)")
def model_order(spark, sf_dir):
    return tables.model_order(_results(spark, sf_dir).select("model").distinct(), ["5-LOW", "2-HIGH"])


# Counts --------------------------------------------------------------------------------

_COUNTS = "WITH c AS (SELECT l_linenumber::VARCHAR AS sample_id, l_orderkey AS spot, l_partkey AS gene, sum(l_quantity) AS count FROM lineitem GROUP BY ALL)\n"


def _counts(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("string").alias("sample_id"), F.col("l_orderkey").alias("spot"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("count"))


@query(_COUNTS + "SELECT gene, count(*) FILTER (count > 0) AS n_expressed FROM c GROUP BY gene HAVING count(DISTINCT sample_id) = (SELECT count(DISTINCT sample_id) FROM c) AND count(*) FILTER (count > 0) >= 20")
def shared_vocabulary(spark, sf_dir):
    return counts.vocabulary(_counts(spark, sf_dir), 20)


@query(_COUNTS + ", g AS (SELECT gene FROM c GROUP BY gene HAVING count(*) FILTER (count > 0) >= 25), k AS (SELECT * FROM c WHERE gene IN (SELECT gene FROM g)) SELECT gene, count(*) AS n FROM k WHERE gene IN (SELECT gene FROM k WHERE count > 0 GROUP BY gene HAVING count(DISTINCT sample_id) = (SELECT count(DISTINCT sample_id) FROM k)) GROUP BY gene")
def prepared_counts(spark, sf_dir):
    return counts.prepared(_counts(spark, sf_dir), 25, "sample_id").groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


@query(_COUNTS + ", t AS (SELECT sample_id, spot, sum(count) AS total FROM c GROUP BY ALL) SELECT sample_id, spot, gene, round(ln(1 + count / total * 1e4), 6) AS value FROM c JOIN t USING (sample_id, spot)")
def normalised_counts(spark, sf_dir):
    c = _counts(spark, sf_dir)
    x = counts.expression(c.select("sample_id", "spot").distinct(), c, c.select("gene").distinct())
    return rounded(x.select("sample_id", "spot", F.explode("genes").alias("gene", "value")))


def _dispersion_sql(by: str = "", t: str = "") -> str:
    """View score{t}: (by, gene, mean, score), the quadratic fit by Cramer's rule on sums. t ends the names of its views."""
    g = by + ", " if by else ""
    det = lambda a: f"({a[0]}*({a[4]}*{a[8]}-{a[5]}*{a[7]})-{a[1]}*({a[3]}*{a[8]}-{a[5]}*{a[6]})+{a[2]}*({a[3]}*{a[7]}-{a[4]}*{a[6]}))"
    grid = ["x0", "x1", "x2", "x1", "x2", "x3", "x2", "x3", "x4"]
    swapped = [[("y" + str(k // 3)) if k % 3 == c else grid[k] for k in range(9)] for c in range(3)]
    fit = ", ".join(f"{det(swapped[c])} / {det(grid)} AS c{c}" for c in range(3))
    return f""", size{t} AS (SELECT count(DISTINCT spot)::DOUBLE AS n FROM c
), mom{t} AS (SELECT {g}gene, sum(count)::DOUBLE / any_value(n) AS mean, (sum(count * count) - sum(count) * sum(count) / any_value(n)) / (any_value(n) - 1) AS var, any_value(n) AS n FROM c, size{t} GROUP BY {g}gene
), lg{t} AS (SELECT *, log10(mean) - (SELECT avg(log10(mean)) FROM mom{t} WHERE mean > 0 AND var > 0) AS lx, log10(var) AS ly FROM mom{t} WHERE mean > 0 AND var > 0
), sums{t} AS (SELECT {", ".join(f"sum(lx ** {k}) AS x{k}" for k in range(5))}, {", ".join(f"sum(lx ** {k} * ly) AS y{k}" for k in range(3))} FROM lg{t}
), fit{t} AS (SELECT {fit} FROM sums{t}
), sd{t} AS (SELECT lg{t}.*, sqrt(10 ** (c0 + c1 * lx + c2 * lx * lx)) AS sd FROM lg{t}, fit{t}
), score{t} AS (SELECT {g}gene, any_value(mean) AS mean, (sum(least((count - mean) / sd, sqrt(n)) ** 2) + (any_value(n) - count(*)) * (any_value(mean) / any_value(sd)) ** 2) / (any_value(n) - 1) AS score
  FROM c JOIN sd{t} USING ({g}gene) GROUP BY {g}gene)
"""


@query(_COUNTS + _dispersion_sql() + "SELECT gene, round(mean, 6) AS mean, round(score, 6) AS score FROM score")
def gene_dispersion(spark, sf_dir):
    c = _counts(spark, sf_dir)
    return rounded(counts.dispersion(c, c.select("spot").distinct().count()))


@query(_COUNTS + _dispersion_sql(t="_all") + _dispersion_sql("sample_id") + """, own AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, gene) AS r FROM score), shared AS (
  SELECT gene FROM own WHERE r <= 40 GROUP BY gene ORDER BY count(*) DESC, avg(r), gene LIMIT 20)
SELECT gene, 'global' AS strategy FROM (SELECT gene FROM score_all ORDER BY score DESC, gene LIMIT 40) UNION ALL SELECT DISTINCT gene, 'per_slide' FROM own WHERE r <= 40
UNION ALL SELECT gene, 'mixed' FROM (SELECT gene FROM shared UNION SELECT gene FROM own WHERE r <= 20)""")
def selected_genes(spark, sf_dir):
    c = cut(_counts(spark, sf_dir))  # read by every strategy, twice by each
    n = c.select("spot").distinct().count()
    out = None
    for s in ("global", "per_slide", "mixed"):
        x = counts.select_genes(c, n, 40, s).withColumn("strategy", F.lit(s))
        out = x if out is None else out.unionByName(x)
    return out


# Spots of several genes: orders as spots of five slides, of which three are the fit split.
_BASKETS = """WITH every AS (SELECT (l_orderkey % 5)::VARCHAR AS sample_id, l_orderkey AS spot, l_partkey AS gene, sum(l_quantity) AS count FROM lineitem GROUP BY ALL
), shared AS (SELECT gene FROM every GROUP BY gene HAVING count(DISTINCT sample_id) = (SELECT count(DISTINCT sample_id) FROM every) AND count(*) FILTER (count > 0) >= 3
), own AS (SELECT * FROM every WHERE sample_id IN ('0', '1', '2')
), c AS (SELECT * FROM own WHERE gene IN (SELECT gene FROM shared))
"""
_KEPT = 120


def _baskets(spark, sf_dir):
    c = _read(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 5).cast("string").alias("sample_id"), F.col("l_orderkey").alias("spot"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("count"))
    every = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spot"))
    c = cut(c)  # read several times: the vocabulary, the ranking and the rows
    gone = every.select((F.col("spot") * -1).alias("spot")).where("spot % 50 = 0")  # spots that no slide's counts have
    spots_ = every.unionByName(gone).select((F.abs("spot") % 5).cast("string").alias("sample_id"), "spot")
    return c, spots_, spots_.where("sample_id in ('0', '1', '2')")


@query(_BASKETS + _dispersion_sql().replace("AS n FROM c\n", "AS n FROM own\n") + f""", top AS (SELECT gene, score FROM score ORDER BY score DESC, gene LIMIT {_KEPT}
), n AS (SELECT count(DISTINCT (sample_id, spot)) AS n FROM own), t AS (SELECT sample_id, spot, sum(count) AS total FROM own GROUP BY ALL
), v AS (SELECT gene, ln(1 + count / total * 1e4) AS v FROM own JOIN t USING (sample_id, spot) WHERE gene IN (SELECT gene FROM top)
), m AS (SELECT gene, sum(v) / any_value(n) AS mean, sum(v * v) / any_value(n) AS square FROM v, n GROUP BY gene)
SELECT gene, (row_number() OVER (ORDER BY gene) - 1)::INTEGER AS place, round(score, 5) AS score, round(mean, 6) AS mean, round(sqrt(square - mean * mean), 6) AS sd FROM top JOIN m USING (gene)""")
def hvg_scaler(spark, sf_dir):
    """The genes that the count baseline keeps, and their scaler on the fit spots."""
    c, _, fit = _baskets(spark, sf_dir)
    genes = hvg.ranked_genes(c, fit, _KEPT, 3)
    rows = hvg.sparse_rows(c.join(fit, hvg.SPOT, "left_semi"), genes)
    out = genes.join(hvg.gene_scaler(rows, genes.count()), "place").select("gene", "place", F.round("score", 5).alias("score"), "mean", "sd")
    return rounded(out)


@query()
def hvg_pca(spark, sf_dir):
    """Components of all spots, fitted on the fit spots' counts; spots without counts are zeros."""
    c, every, fit = _baskets(spark, sf_dir)
    z = hvg.HvgPca(_KEPT, 4, 3).fit(c, fit).embed(c, every)
    return rounded(z.select("sample_id", "spot", "found", F.posexplode("z").alias("component", "value")))


@query("SELECT p_partkey, p_brand, CASE WHEN r = 0 THEN p_brand ELSE p_brand || '-' || r END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS r FROM part)")
def unique_names(spark, sf_dir):
    return counts.unique_names(_read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey")


# Correction, integration, ablation -----------------------------------------------------


@query()
def combat(spark, sf_dir):
    x = correction.combat(spots(spark, sf_dir), "sample_id", "gene_features")
    return rounded(x.select("spot_key", F.posexplode("z").alias("component", "value")))


@query()
def harmony(spark, sf_dir):
    x = correction.harmony(spots(spark, sf_dir), "spot_key", "donor", "gene_features")
    return rounded(x.select("spot_key", F.posexplode("z").alias("component", "value")), 4)


_NEAR = SQL + """, x AS (SELECT spot_key AS key, {batch} AS batch, gene_features::DOUBLE[] AS x FROM spots), p AS (SELECT a.key, b.key AS other, b.batch, list_distance(a.x, b.x) AS dist FROM x a JOIN x b ON a.key <> b.key),
n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY key, batch ORDER BY dist, other) <= {k})
SELECT key, row_number() OVER (PARTITION BY key ORDER BY dist, other)::INTEGER AS rank, other, round(dist, 6) AS dist FROM n UNION ALL SELECT key, 0, key, 0 FROM x"""


@query(_NEAR.format(batch="tissue", k=3))
def bbknn_graph(spark, sf_dir):
    return rounded(correction.bbknn(spots(spark, sf_dir), "spot_key", "tissue", "gene_features"))


@query(_NEAR.format(batch="'all'", k=15))
def neighbour_graph(spark, sf_dir):
    return rounded(knn.padded_graph(_keyed(spark, sf_dir), 15))


def _keyed(spark, sf_dir):
    return spots(spark, sf_dir).select(F.col("spot_key").alias("key"), F.col("tissue").alias("batch"), F.col("gene_features").cast("array<double>").alias("x"))


@query()
def integration_panel(spark, sf_dir):
    """Ten metrics of the location-and-scale correction, one neighbour graph behind four of them."""
    x = correction.combat(spots(spark, sf_dir).where(is_labelled("annotation")), "sample_id", "gene_features")
    return rounded(integration.panel(x, "spot_key", "sample_id", "annotation", "z", before="gene_features"), 4)


@query(SQL + """, x AS (SELECT spot_key AS key, annotation AS label, gene_features::DOUBLE[] AS x FROM spots WHERE is_real
), p AS (SELECT a.key, b.key AS other, a.label = b.label AS same, row_number() OVER (PARTITION BY a.key ORDER BY list_distance(a.x, b.x), b.key) AS r FROM x a JOIN x b ON a.key <> b.key
), edge AS (SELECT key, other FROM p WHERE r < 15 AND same UNION SELECT other, key FROM p WHERE r < 15 AND same
), reach AS (SELECT key, key AS other FROM x UNION SELECT reach.key, edge.other FROM reach JOIN edge ON edge.key = reach.other
), part AS (SELECT key, min(other) AS part FROM reach GROUP BY key), size AS (SELECT label, part, count(*) AS n FROM part JOIN x USING (key) GROUP BY ALL)
SELECT round(avg(share), 6) AS graph_connectivity FROM (SELECT label, max(n) / sum(n) AS share FROM size GROUP BY label)""")
def graph_connectivity(spark, sf_dir):
    x = spots(spark, sf_dir).where(is_labelled("annotation"))
    rows = x.select(F.col("spot_key").alias("key"), F.lit("all").alias("batch"), F.col("annotation").alias("label"), F.col("gene_features").cast("array<double>").alias("x"))
    graph = knn.padded_graph(rows.select("key", "batch", "x"), max(integration.GRAPH_SIZES.values()) - 1)
    return rounded(integration.graph_connectivity(integration.graph_at(graph, integration.GRAPH_SIZES["graph_connectivity"]), rows))


@query(SQL + """, x AS (SELECT sample_id, count(*) AS n, avg(gene_features[1]::DOUBLE) AS first, sum(patch_features[1]::DOUBLE) AS patch FROM spots GROUP BY ALL)
SELECT sample_id, n, round(patch, 6) AS patch_sum, 32 AS width, 0.0 AS moved_mean FROM x""")
def corrected_arm(spark, sf_dir):
    """A corrected arm by slide: rows, the untouched block's sum, the corrected block's width, and how far its overall mean moved."""
    x = spots(spark, sf_dir)
    y, _, _ = arms.resolved(x, "combat_pca", "spot_key", "gene_features", "sample_id", F.col("split") == "train", components=0)
    mean = lambda df, name: df.select(F.posexplode("gene_features").alias("p", "v")).groupBy("p").agg(F.avg(F.col("v").cast("double")).alias(name))
    # the correction keeps the overall location, up to its shrinkage
    moved = mean(x, "a").join(mean(y, "b"), "p").agg(F.round(F.max(F.abs(F.col("a") - F.col("b"))), 1).alias("moved_mean"))
    by = y.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("patch_features")[0].cast("double")), 6).alias("patch_sum"), F.max(F.size("gene_features")).alias("width"))
    return by.join(F.broadcast(moved))  # one row


@query(SQL + "SELECT tissue, annotation, count(*) AS n, round(sum(gene_features[1]::DOUBLE), 6) AS first FROM spots WHERE is_real GROUP BY ALL")
def reused_result(spark, sf_dir):
    """A result stored under the fingerprint of its rows, then asked for again: the second asking makes nothing."""
    x = spots(spark, sf_dir).where(is_labelled("annotation")).select("spot_key", "tissue", "annotation", "gene_features")
    store = reuse.ResultStore(spark, f"{shared_dir(spark)}/spotweave-results")
    make = lambda: x.groupBy("tissue", "annotation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("gene_features")[0].cast("double")), 6).alias("first"))
    rows = reuse.fingerprint(x)
    store.reuse("class_sums", {"by": "tissue, annotation"}, rows, make)
    return store.require("class_sums", {"by": "tissue, annotation"}, reuse.fingerprint(x.repartition(3)))


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), x AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c),
j AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi, sum(n * (n - 1) / 2) AS i, any_value(t) AS t FROM x), pa AS (SELECT sum(m * (m - 1) / 2) AS p, -sum(m / t * ln(m / t)) AS h FROM (SELECT DISTINCT a, na AS m, t FROM x)), pb AS (SELECT sum(m * (m - 1) / 2) AS p, -sum(m / t * ln(m / t)) AS h FROM (SELECT DISTINCT b, nb AS m, t FROM x))
SELECT round(mi / ((pa.h + pb.h) / 2), 6) AS nmi, round((i - pa.p * pb.p / (t * (t - 1) / 2)) / ((pa.p + pb.p) / 2 - pa.p * pb.p / (t * (t - 1) / 2)), 6) AS ari FROM j, pa, pb""")
def contingency_agreement(spark, sf_dir):
    c = _read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(integration.contingency_scores(c))


@query(SQL + """, a AS (SELECT spot_key, sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY spot_key) AS r FROM spots),
b AS (SELECT patch_features, sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY md5(concat_ws('|', '42', 'patch', spot_key)), spot_key) AS r FROM spots)
SELECT spot_key, generate_subscripts(patch_features, 1) - 1 AS pos, round(unnest(patch_features)::DOUBLE, 6) AS value FROM a JOIN b USING (sample_id, r)""")
def patches_within_sample(spark, sf_dir):
    x = models.transform_patches(spots(spark, sf_dir), "within_sample", "patch_features", "sample_id", "spot_key")
    return rounded(x.select("spot_key", F.posexplode("patch_features").alias("pos", "value")).withColumn("value", F.col("value").cast("double")))


@query()
def patches_gaussian(spark, sf_dir):
    x = models.transform_patches(spots(spark, sf_dir), "gaussian", "patch_features", "sample_id", "spot_key")
    return rounded(x.select("spot_key", F.posexplode("patch_features").alias("pos", "value")))


@query()
def autoencoder(spark, sf_dir):
    x = spots(spark, sf_dir)
    net = models.Autoencoder(latent=4, hidden=16, epochs=10, batches=4).fit(x.where("split = 'train'"), "gene_features", "patch_features", "spot_key")
    return rounded(net.transform(x, "gene_features", "spot_key").select("key", F.posexplode("z").alias("component", "value")), 4)


@query()
def domain_adversarial(spark, sf_dir):
    """The latent layer of the network that is kept from telling slides apart."""
    x = spots(spark, sf_dir)
    net = models.DomainAdversarial(latent=4, hidden=16, judge=8, epochs=10, batches=4).fit(x.where("split = 'test'"), "gene_features", "patch_features", "spot_key", "sample_id", "tissue")
    return rounded(net.transform(x, "gene_features", "spot_key").select("key", F.posexplode("z").alias("component", "value")), 4)
