"""Queries on reporting, contrasts, pooled expression and geometry, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.functions import geometry
from spotweave.functions.labels import is_labelled
from spotweave.operators import contrasts, expression, folds, integration, probes, reporting, results, silhouette
from spotweave.plans import probe_sql as S
from spotweave.plans.base_queries import _rows, _slides, query_table, rounded
from spotweave.plans.cohort import SQL, spots

QUERIES, ORACLE, query = query_table()


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Panels and scores ---------------------------------------------------------------------

_NAMES = ("iLISI", "kBET", "graph_connectivity", "PCR comparison", "BRAS", "silhouette_batch", "isolated_labels", "KMeans NMI", "kmeans_ari", "silhouette_label", "cLISI", "Batch correction", "bio_conservation", "Total", "n_spots", "n_batches", "error", "new_metric")
_PANEL = f"""WITH o AS (SELECT DISTINCT o_orderpriority AS model FROM orders), m AS (SELECT model, unnest({list(_NAMES)}) AS metric FROM o),
k AS (SELECT *, replace(lower(metric), ' ', '_') AS n FROM m)
"""


def _panel(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model")).distinct().withColumn("metric", F.explode(F.array(*map(F.lit, _NAMES))))


_SPLIT = _PANEL + """, p AS (SELECT model, metric, CASE WHEN n IN ('ilisi', 'kbet', 'graph_connectivity', 'pcr_comparison', 'bras', 'silhouette_batch') THEN 'batch'
  WHEN n IN ('isolated_labels', 'kmeans_nmi', 'kmeans_ari', 'silhouette_label', 'clisi') THEN 'bio' ELSE 'other' END AS panel FROM k
  WHERE n NOT IN ('batch_correction', 'bio_conservation', 'total', 'n_spots', 'n_batches', 'error'))
"""


@query(_SPLIT + "SELECT * FROM p")
def panel_split(spark, sf_dir):
    return integration.split_panels(_panel(spark, sf_dir))


@query(_SPLIT + "SELECT *, panel || '/' || metric AS \"column\" FROM p")
def panel_columns(spark, sf_dir):
    return reporting.panel_columns(integration.split_panels(_panel(spark, sf_dir)))


_DELTAS = """WITH d AS (SELECT o_orderpriority AS method, o_orderstatus AS scope, avg(o_totalprice) / 1e6 AS delta_f1, min(o_totalprice) / 1e6 AS ci_lo, max(o_totalprice) / 1e6 AS ci_hi,
  (count(*) % 100) / 100.0 AS p_two_sided, CASE WHEN o_orderstatus = 'F' THEN min(o_totalprice) / 2e6 END AS ci_lo_pooled, CASE WHEN o_orderstatus = 'F' THEN max(o_totalprice) / 2e6 END AS ci_hi_pooled,
  CASE WHEN o_orderstatus = 'F' THEN 0.5 END AS p_two_sided_pooled, count(DISTINCT o_custkey) AS n_donors, count(*) AS n_boot FROM orders GROUP BY o_orderpriority, o_orderstatus)
"""


def _deltas(spark, sf_dir):
    f = F.col("scope") == "F"
    x = _read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("scope")).agg(
        (F.avg("o_totalprice") / 1e6).alias("delta_f1"), (F.min("o_totalprice") / 1e6).alias("ci_lo"), (F.max("o_totalprice") / 1e6).alias("ci_hi"),
        (F.count(F.lit(1)) % 100 / 100.0).alias("p_two_sided"), F.countDistinct("o_custkey").alias("n_donors"), F.count(F.lit(1)).alias("n_boot"),
    )
    return x.withColumns({"ci_lo_pooled": F.when(f, F.col("ci_lo") / 2), "ci_hi_pooled": F.when(f, F.col("ci_hi") / 2), "p_two_sided_pooled": F.when(f, F.lit(0.5))})


@query(_DELTAS + """SELECT 'ablate' AS stage, method AS model, scope, 'macro' AS class, 'pooled' AS fold, 'delta_f1' AS metric, round(delta_f1, 6) AS value, round(coalesce(ci_lo_pooled, ci_lo), 6) AS ci_lo,
  round(coalesce(ci_hi_pooled, ci_hi), 6) AS ci_hi, round(coalesce(p_two_sided_pooled, p_two_sided), 6)::DOUBLE AS p_two_sided, n_donors::DOUBLE AS n_donors, n_boot::DOUBLE AS n_boot, 'deltas.csv' AS source FROM d""")
def melted_deltas(spark, sf_dir):
    x = results.melt_deltas(_deltas(spark, sf_dir), stage="ablate", source="deltas.csv")
    return rounded(x.select("stage", "model", "scope", "class", "fold", "metric", "value", "ci_lo", "ci_hi", "p_two_sided", "n_donors", "n_boot", "source"))


@query("""SELECT 'diagnose' AS stage, o_orderstatus AS model, o_orderpriority AS condition, 'cohort' AS scope, 'macro' AS class, 'eff_rank' AS metric, round(avg(o_totalprice) / 1e4, 6) AS value
FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def melted_ranks(spark, sf_dir):
    x = _read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("column"), F.col("o_orderpriority").alias("variant")).agg((F.avg("o_totalprice") / 1e4).alias("eff_rank"))
    return rounded(results.melt_effective_rank(x).select("stage", "model", "condition", "scope", "class", "metric", "value"))


@query(_DELTAS + "SELECT run_name, model, scope, round(delta_f1, 6) AS value FROM (SELECT 'a' AS run_name, method AS model, scope, delta_f1 FROM d UNION ALL SELECT 'b', method, scope, delta_f1 FROM d WHERE scope = 'F')")
def union_of_runs(spark, sf_dir):
    x = results.melt_deltas(_deltas(spark, sf_dir), stage="ablate", source="deltas.csv")
    return rounded(results.check_runs({"a": x, "b": x.where("scope = 'F'")}).select("run_name", "model", "scope", "value"))


@query(_DELTAS + "SELECT d.method, d.scope, round(d.ci_lo, 6) AS ci_lo, round(p.lo, 6) AS ci_lo_pooled, round(p.hi, 6) AS ci_hi_pooled FROM d LEFT JOIN (SELECT scope, min(ci_lo) AS lo, max(ci_hi) AS hi FROM d WHERE scope <> 'P' GROUP BY scope) p USING (scope)")
def attached_pooled(spark, sf_dir):
    d = _deltas(spark, sf_dir)
    p = d.where("scope <> 'P'").groupBy("scope").agg(F.min("ci_lo").alias("ci_lo_pooled"), F.max("ci_hi").alias("ci_hi_pooled"))
    return rounded(reporting.attach_pooled(d.select("method", "scope", "ci_lo"), p, ["scope"]).select("method", "scope", "ci_lo", "ci_lo_pooled", "ci_hi_pooled"))


@query(_DELTAS + """SELECT method, round(avg(delta_f1) FILTER (scope = 'F'), 6) AS "f1/F/cross_donor", round(min(ci_lo) FILTER (scope = 'F'), 6) AS "f1/F/cross_donor_lo_pooled", round(max(ci_hi) FILTER (scope = 'F'), 6) AS "f1/F/cross_donor_hi_pooled",
  max(n_boot) FILTER (scope = 'F') AS "f1/F/cross_donor_n_seeds" FROM d GROUP BY method""")
def attached_pooled_wide(spark, sf_dir):
    d = _deltas(spark, sf_dir)
    wide = d.where("scope = 'F'").groupBy("method").agg(F.avg("delta_f1").alias("f1/F/cross_donor"))
    pooled = d.select("method", F.lit("cross_donor").alias("level"), "scope", F.col("ci_lo").alias("ci_lo_pooled"), F.col("ci_hi").alias("ci_hi_pooled"), F.col("n_boot").alias("n_seeds_pooled"))
    out = reporting.attach_pooled_wide(wide, pooled)
    return out.select("method", *[(F.round(F.col(f"`{c}`"), 6) if t == "double" else F.col(f"`{c}`")).alias(c) for c, t in out.dtypes if c != "method"])


@query(_DELTAS + "SELECT scope AS class, method AS condition, round(avg(coalesce(ci_lo_pooled, ci_lo)), 6) AS lo, round(avg(coalesce(ci_hi_pooled, ci_hi)), 6) AS hi FROM d WHERE scope IN ('F', 'O') GROUP BY ALL")
def mean_intervals(spark, sf_dir):
    d = _deltas(spark, sf_dir).where("scope in ('F', 'O')")
    rows = d.select(F.lit("skin").alias("scope"), F.col("scope").alias("class"), F.col("method").alias("condition"), F.coalesce("ci_lo_pooled", "ci_lo").alias("ci_lo"), F.coalesce("ci_hi_pooled", "ci_hi").alias("ci_hi"))
    return rounded(reporting.mean_intervals(rows, "skin"))


@query("SELECT o_orderstatus AS protocol, 'x' AS level, o_orderpriority AS scope, round(avg(o_totalprice) FILTER (o_custkey % 2 = 0), 4) AS \"none\", round(avg(o_totalprice) FILTER (o_custkey % 2 = 1), 4) AS shuffled FROM orders GROUP BY ALL")
def condition_summary(spark, sf_dir):
    x = _read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("protocol"), F.lit("x").alias("level"), F.col("o_orderpriority").alias("scope"), F.when(F.col("o_custkey") % 2 == 0, "none").otherwise("shuffled").alias("condition"), F.col("o_totalprice").alias("f1_score"))
    whole = x.withColumn("scope", F.lit("global"))
    return rounded(reporting.condition_summary(x.unionByName(whole), ["none", "shuffled"]), 4)


_DISTANCES = SQL + """, v AS (SELECT spot_key AS key, {scope} AS scope, {label} AS label, gene_features AS x FROM spots WHERE is_real),
d AS (SELECT a.scope, a.key, a.label AS own, b.label, sum(CASE WHEN a.key = b.key THEN 0 ELSE list_distance(a.x::DOUBLE[], b.x::DOUBLE[]) END) AS total, count(*) AS n FROM v a JOIN v b ON a.scope = b.scope GROUP BY ALL)
"""
_SILHOUETTE = """, m AS (SELECT scope, key, own, max(total) FILTER (label = own) AS t, max(n) FILTER (label = own) AS m, {between}(total / n) FILTER (label <> own) AS b FROM {d} GROUP BY ALL),
s AS (SELECT scope, key, own, CASE WHEN m > 1 THEN (b - t / (m - 1)) / greatest(b, t / (m - 1)) ELSE 0 END AS s FROM m WHERE b IS NOT NULL)
"""


def _labelled(spark, sf_dir):
    return spots(spark, sf_dir).where(is_labelled("annotation"))


@query(_DISTANCES.format(scope="'all'", label="annotation") + _SILHOUETTE.format(between="min", d="d") + "SELECT round((avg(s) + 1) / 2, 6) AS silhouette_label FROM s")
def silhouette_label(spark, sf_dir):
    return rounded(silhouette.silhouette_label(_labelled(spark, sf_dir), "spot_key", "annotation", "gene_features"))


@query(_DISTANCES.format(scope="annotation", label="donor") + _SILHOUETTE.format(between="avg", d="d") + "SELECT round(avg(v), 6) AS bras FROM (SELECT avg(1 - abs(s)) AS v FROM s GROUP BY scope)")
def bras(spark, sf_dir):
    return rounded(silhouette.bras(_labelled(spark, sf_dir), "spot_key", "donor", "annotation", "gene_features"))


@query(_DISTANCES.format(scope="'all'", label="annotation") + """, held AS (SELECT annotation AS own, count(DISTINCT sample_id) AS k FROM spots WHERE is_real GROUP BY ALL), few AS (SELECT own FROM held WHERE k = (SELECT min(k) FROM held)),
two AS (SELECT scope, key, own, CASE WHEN label = own THEN own ELSE '-' END AS label, sum(total) AS total, sum(n) AS n FROM d WHERE own IN (SELECT own FROM few) GROUP BY ALL)""" + _SILHOUETTE.format(between="min", d="two") + "SELECT round(avg(v), 6) AS isolated_labels FROM (SELECT (avg(s) + 1) / 2 AS v FROM s GROUP BY own)")
def isolated_label_score(spark, sf_dir):
    return rounded(silhouette.isolated_label_score(_labelled(spark, sf_dir), "spot_key", "sample_id", "annotation", "gene_features"))


# Paired predictions --------------------------------------------------------------------

_MADE = """, made AS (SELECT 1 AS seed, 'loso' AS protocol, tissue AS level, key, y_true, y_pred FROM pred), other AS (
  SELECT 1 AS seed, 'loso' AS protocol, tissue AS level, key, y_true, y_true AS y_pred FROM pred WHERE tissue <> 'lung' OR key % 7 <> 0)
"""


def _made(spark, sf_dir):
    from spotweave.functions.lineage import cut

    x = cut(probes.leave_one_out(_rows(spark, sf_dir), "donor")).select(F.lit(1).alias("seed"), F.lit("loso").alias("protocol"), F.col("tissue").alias("level"), "key", "y_true", "y_pred")
    return x, x.where("level <> 'lung' or key % 7 <> 0").withColumn("y_pred", F.col("y_true"))


@query(SQL + S.PREDICTIONS + _MADE + "SELECT made.level, made.key, made.y_true, other.y_pred AS y_pred_a, made.y_pred AS y_pred_b, 'pca' AS reference FROM made JOIN other USING (level, key) WHERE made.level <> 'lung'")
def model_pairs(spark, sf_dir):
    """A model that lacks rows of one level is compared on the others only."""
    base, other = _made(spark, sf_dir)
    pred = base.withColumn("model", F.lit("pca")).unionByName(other.withColumn("model", F.lit("cdan")))
    return reporting.model_pairs(pred, ["pca", "cdan", "majority"]).select("level", "key", "y_true", "y_pred_a", "y_pred_b", "reference")


@query(SQL + S.PREDICTIONS + _MADE + "SELECT 'shuffled' AS condition, made.level, made.key, made.y_pred AS y_pred_a, other.y_pred AS y_pred_b, 'none' AS reference FROM made JOIN other USING (level, key) WHERE made.level <> 'lung'")
def condition_pairs(spark, sf_dir):
    base, other = _made(spark, sf_dir)
    pred = base.withColumn("condition", F.lit("none")).unionByName(other.withColumn("condition", F.lit("shuffled")))
    return reporting.condition_pairs(pred).select("condition", "level", "key", "y_pred_a", "y_pred_b", "reference")


@query(SQL + S.PREDICTIONS + """, classes AS (SELECT unnest(['Tumor', 'Stroma', 'NOR', 'TLS', 'INFL', 'LN', 'rare']) AS class), t AS (SELECT DISTINCT tissue FROM pred),
f AS (SELECT tissue AS scope, class FROM t, classes UNION SELECT 'global', tissue || ' | ' || class FROM t, classes), seen AS (SELECT DISTINCT tissue AS scope, y_true AS class FROM pred UNION SELECT 'global', tissue || ' | ' || y_true FROM pred)
SELECT scope, class, (scope, class) IN (SELECT (scope, class) FROM seen) AS scored FROM f""")
def scope_classes(spark, sf_dir):
    pred = probes.leave_one_out(_rows(spark, sf_dir), "donor", majority=True)
    known = probes.with_scopes(pred).select("scope", F.col("y_true").alias("class"))
    return reporting.scope_classes(pred, ["Tumor", "Stroma", "NOR", "TLS", "INFL", "LN", "rare"], known)


# Held-out protocols on other groups ----------------------------------------------------


def _grouped(group: str, where: str = "") -> str:
    """The prediction views for leaving one `group` out of its tissue, on the slides of `where`."""
    head, tail = S.PREDICTIONS.split("), long AS", 1)
    head = head.replace("h.donor", f"h.{group}").replace("DISTINCT tissue, donor FROM slides", f"DISTINCT tissue, {group} FROM slides WHERE true {where}")
    head = head.replace(f"s.donor = h.{group}", f"s.{group} = h.{group}").replace("count(DISTINCT donor) FROM slides x WHERE", f"count(DISTINCT {group}) FROM slides x WHERE true {where} AND")
    return head + where.replace("sample_id IN", "s.sample_id IN") + "\n), long AS" + tail


_COUNTED = S.scoped() + S.counts() + S.MACRO.format(by="scope") + """, any_value(n_donors) AS n_donors, any_value(n_slides) AS n_slides
FROM counts_m JOIN (SELECT scope, count(DISTINCT donor) AS n_donors, count(DISTINCT sample_id) AS n_slides FROM scoped GROUP BY scope) USING (scope) GROUP BY scope"""
_ONE_FOLD = "AND sample_id IN (SELECT sample_id FROM folds WHERE fold = 'cross_donor__skin__eval_D0')"
ORACLE["pooled_loso"] = SQL + _grouped("sample_id") + _COUNTED
ORACLE["pooled_loso_on_fold"] = SQL + _grouped("sample_id", _ONE_FOLD) + _COUNTED




def _protocol(name: str, level: str, members: str) -> str:
    """Members of one protocol's folds, named by protocol and level."""
    return f"SELECT '{name}' AS protocol, {level} AS level, m.* REPLACE ('{name}' || chr(1) || {level} || chr(1) || fold AS fold) FROM ({members}) m"


def _members(group: str) -> str:
    view = _grouped(group).split("), long AS", 1)[0]
    return view[view.index("SELECT") :].replace("s.gene_features AS z", "s.gene_features AS z, '' AS level0").replace(f"h.{group} AS held, ", "")


_ON_FOLDS = "SELECT s.spot_key AS key, s.annotation, s.tissue, s.donor, s.sample_id, f.fold, f.role, s.gene_features AS z, f.level AS level0 FROM spots s JOIN folds f USING (sample_id) WHERE s.is_real"
_ALL = f""", members AS (
  {_protocol("loso_donor", "'donor'", _members("donor"))}
  UNION ALL BY NAME {_protocol("pooled_loso", "'sample_id'", _members("sample_id"))}
  UNION ALL BY NAME {_protocol("heldout_donor", "level0", _ON_FOLDS)}
"""
_BY = "protocol, level, scope"
_ALL_SCOPED = """, pred2 AS (SELECT split_part(fold, chr(1), 1) AS protocol, split_part(fold, chr(1), 2) AS level, * FROM pred), scoped AS (
  SELECT protocol, level, 'global' AS scope, donor, sample_id, tissue || ' | ' || y_true AS y_true, tissue || ' | ' || y_pred AS y_pred FROM pred2
  UNION ALL SELECT protocol, level, tissue, donor, sample_id, y_true, y_pred FROM pred2)
"""
ORACLE["all_protocols"] = (
    SQL + _ALL + S.PREDICTIONS[S.PREDICTIONS.index("), long AS") :] + _ALL_SCOPED + S.counts("scoped", "counts", _BY) + S.MACRO.format(by=_BY)
    + f""", any_value(n_donors) AS n_donors, any_value(n_slides) AS n_slides FROM counts_m
JOIN (SELECT {_BY}, count(DISTINCT donor) AS n_donors, count(DISTINCT sample_id) AS n_slides FROM scoped GROUP BY ALL) USING (protocol, level, scope) GROUP BY {_BY}"""
)


# Contrasts -----------------------------------------------------------------------------

_R2 = """WITH g AS (SELECT l_partkey AS target, avg(l_discount) AS r2_refined, CASE WHEN count(*) > 2 THEN avg(l_tax) END AS r2_frozen, avg(l_quantity) / 100 AS r2_pca_control FROM lineitem GROUP BY 1)
"""


def _targets(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("target")).agg(F.avg("l_discount").alias("r2_refined"), F.when(F.count(F.lit(1)) > 2, F.round(F.avg("l_tax"), 6)).alias("r2_frozen"), (F.avg("l_quantity") / 100).alias("r2_pca_control"))


@query(_R2.replace("avg(l_tax)", "round(avg(l_tax), 6)") + """, x AS (SELECT 'guided_vs_frozen' AS contrast, target::VARCHAR AS target, r2_refined - r2_frozen AS value, r2_frozen AS b FROM g WHERE r2_frozen IS NOT NULL
  UNION ALL SELECT 'guided_vs_capacity', target::VARCHAR, r2_refined - r2_pca_control, r2_frozen FROM g WHERE r2_frozen IS NOT NULL), t AS (SELECT *, ntile(5) OVER (PARTITION BY contrast ORDER BY b, target) AS s FROM x)
SELECT contrast, false AS detrended, target, round(value, 9) AS value FROM x UNION ALL SELECT contrast, true, target, round(value - avg(value) OVER (PARTITION BY contrast, s), 9) FROM t""")
def contrast_rankings(spark, sf_dir):
    return rounded(contrasts.rankings(_targets(spark, sf_dir), ["guided_vs_frozen", "guided_vs_capacity"], 5), 9)


@query(_R2.replace("avg(l_tax)", "round(avg(l_tax), 6)") + """SELECT 'all' AS kind, target, ntile(4) OVER (ORDER BY round(r2_pca_control, 6), target)::INTEGER - 1 AS stratum FROM g UNION ALL SELECT 'short', target, NULL FROM g""")
def matched_strata(spark, sf_dir):
    """Strata of a baseline that all targets have, and of one that some lack."""
    g = _targets(spark, sf_dir)
    s = g.select("target", F.col("r2_refined").alias("value"))
    full = contrasts.matched_strata(s, g.select("target", F.round("r2_pca_control", 6).alias("baseline")), 4)
    short = contrasts.matched_strata(s, g.where("target % 5 > 0").select("target", F.col("r2_pca_control").alias("baseline")), 4)
    return full.select(F.lit("all").alias("kind"), "target", "stratum").unionByName(short.select(F.lit("short").alias("kind"), "target", "stratum"))


@query("SELECT p_partkey AS source, row_number() OVER (ORDER BY (p_size % 5) NULLS LAST, CASE WHEN p_size % 7 > 0 THEN p_size % 7 END NULLS LAST, round(p_retailprice, 2) NULLS LAST, p_partkey)::INTEGER AS rank FROM part")
def enrichment_order(spark, sf_dir):
    x = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), (F.col("p_size") % 5).cast("double").alias("padj"), F.when(F.col("p_size") % 7 > 0, F.col("p_size") % 7).otherwise(float("nan")).cast("double").alias("pval"), F.round("p_retailprice", 2).alias("norm"))
    return contrasts.enrichment_order(x).select("source", "rank")


@query(SQL + "SELECT level, row_number() OVER (ORDER BY list_position(['cross_donor', 'nowhere', 'cross_replicate'], level))::INTEGER AS place FROM (SELECT DISTINCT level FROM folds) WHERE level IN ('cross_donor', 'nowhere', 'cross_replicate')")
def levels_to_draw(spark, sf_dir):
    return contrasts.levels_to_draw(folds.generate(_slides(spark, sf_dir)), ["cross_donor", "nowhere", "cross_replicate"])


# Pooled expression ---------------------------------------------------------------------


@query("""WITH c AS (SELECT l_linenumber::VARCHAR AS sample_id, l_orderkey AS spot, 'ENSG' || (l_partkey % 1000) AS gene, sum(l_quantity) AS count FROM lineitem GROUP BY ALL),
s AS (SELECT gene FROM c GROUP BY gene HAVING count(DISTINCT sample_id) = (SELECT count(DISTINCT sample_id) FROM c)) SELECT sample_id, spot, gene, count FROM c WHERE gene IN (SELECT gene FROM s)""")
def pooled_slides(spark, sf_dir):
    x = _read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("string").alias("sample_id"), F.col("l_orderkey").alias("spot"), F.concat(F.lit("ENSG"), (F.col("l_partkey") % 1000).cast("string"), F.lit("."), (F.col("l_suppkey") % 3).cast("string")).alias("gene"), F.col("l_quantity").alias("count"))
    return expression.pooled_slides(x)


@query(SQL + "SELECT spot_key, sample_id FROM spots WHERE spot_key IN (SELECT spot_key FROM spots WHERE tissue = 'skin')")
def reindexed_rows(spark, sf_dir):
    x = spots(spark, sf_dir)
    return expression.reindexed(x, x.where("tissue = 'skin'").select("spot_key"), "spot_key").select("spot_key", "sample_id")


@query(SQL + "SELECT spot_key, place FROM (SELECT spot_key, (row_number() OVER (ORDER BY sample_id, spot_key) - 1)::INTEGER AS place FROM spots) WHERE place % 10 = 3")
def rows_at_places(spark, sf_dir):
    x = spots(spark, sf_dir)
    places = spark.range(3, x.count(), 10).select(F.col("id").alias("place"))
    return expression.at_places(x, ["sample_id", "spot_key"], places).select("spot_key", "place")


@query(SQL + "SELECT dataset_id, sample_id, count(*) AS n_spots, min(spot_id) AS first_spot, max(spot_id) AS last_spot FROM spots GROUP BY ALL")
def slide_spots(spark, sf_dir):
    return expression.spots_by_slide(spots(spark, sf_dir))


@query(SQL + """, n AS (SELECT annotation, count(*) AS n FROM spots WHERE is_real GROUP BY ALL), q0 AS (SELECT *, sum(n) OVER () AS total, floor(n * 60 / sum(n) OVER ()) AS share, n * 60 / sum(n) OVER () - floor(n * 60 / sum(n) OVER ()) AS rest FROM n
), q AS (SELECT annotation, (CASE WHEN total <= 60 THEN n ELSE share + CASE WHEN row_number() OVER (ORDER BY rest DESC, md5(concat_ws('|', '7', 'remainder', annotation))) <= 60 - sum(share) OVER () THEN 1 ELSE 0 END END)::BIGINT AS quota FROM q0)
SELECT spot_key, annotation FROM (SELECT *, row_number() OVER (PARTITION BY annotation ORDER BY md5(concat_ws('|', '7', 'stratified', spot_key)), spot_key) AS r FROM spots WHERE is_real) JOIN q USING (annotation) WHERE r <= quota""")
def scoring_rows(spark, sf_dir):
    return expression.scoring_rows(spots(spark, sf_dir), "spot_key", 60, seed=7).select("spot_key", "annotation")


@query("SELECT c_custkey AS spot, round(2.5 * (c_custkey % 50) - 0.5 * (c_custkey // 50) + 10, 4) AS image_x, round(0.25 * (c_custkey % 50) + 1.5 * (c_custkey // 50) - 4, 4) AS image_y FROM customer")
def spot_pixels(spark, sf_dir):
    """Landmarks under a known map; the fitted map brings the spots where they belong."""
    x = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("spot"), (F.col("c_custkey") % 50).alias("col"), F.floor(F.col("c_custkey") / 50).alias("row"))
    marks = x.select("col", "row", (2.5 * F.col("col") - 0.5 * F.col("row") + 10).alias("image_x"), (0.25 * F.col("col") + 1.5 * F.col("row") - 4).alias("image_y"))
    out = geometry.spot_pixels(x.withColumnsRenamed({"col": "array_col", "row": "array_row"}), geometry.fit_affine(marks))
    return rounded(out.select("spot", "image_x", "image_y"), 4)
