"""Queries on labels, cohort, folds, probes, sampling and bootstrap, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.functions.keys import digest
from spotweave.functions.lineage import cut
from spotweave.functions.labels import canonical, class_support, classes, is_labelled
from spotweave.operators import bootstrap, cohort, folds, probes, sampling
from spotweave.plans import probe_sql as S
from spotweave.plans.cohort import SQL, raw_spots, spots

N_BOOT = 2000


def query_table():
    """Two empty tables, of queries and of SQL by name, and the decorator that fills them."""
    found, oracle = {}, {}

    def query(sql: str | None = None):
        def add(f):
            found[f.__name__] = f
            if sql is not None:
                oracle[f.__name__] = sql
            return f

        return add

    return found, oracle, query


QUERIES, ORACLE, query = query_table()


def rounded(df, digits: int = 6):
    """Doubles rounded, so that the order of sums does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _rows(spark, sf_dir):
    return probes.standard_rows(spots(spark, sf_dir), "gene_features")


def _pred(spark, sf_dir):
    return probes.leave_one_out(_rows(spark, sf_dir), "donor")


def _slides(spark, sf_dir):
    return folds.annotated_slides(spots(spark, sf_dir))


# Labels and cohort ---------------------------------------------------------------------


@query(SQL + "SELECT spot_key, spot_id, sample_id, dataset_id, split, tissue, donor, region, replicate, annotation_raw, annotation, annotation_floored, is_real FROM spots")
def labels_canonical_floor(spark, sf_dir):
    x = spots(spark, sf_dir)
    return x.select("spot_key", "spot_id", "sample_id", "dataset_id", "split", "tissue", "donor", "region", "replicate", "annotation_raw", "annotation", "annotation_floored", is_labelled("annotation").alias("is_real"))


@query(SQL + "SELECT DISTINCT annotation0 AS class FROM labelled WHERE real0")
def real_classes(spark, sf_dir):
    return classes(raw_spots(spark, sf_dir).withColumn("annotation", canonical("annotation_raw")))


@query(SQL + """SELECT tissue, annotation0 AS annotation, count(*) AS n_spots, count(DISTINCT sample_id) AS n_slides,
  CASE WHEN count(*) < 10 THEN 'spots' WHEN count(DISTINCT sample_id) < 2 THEN 'slides' END AS below FROM labelled WHERE real0 GROUP BY ALL""")
def class_floor(spark, sf_dir):
    return class_support(spots(spark, sf_dir, floor=False), 10, 2)


@query(SQL + """SELECT sample_id, min(dataset_id) AS dataset_id, min(tissue) AS tissue, min(donor) AS donor, min(region) AS region, min(replicate) AS replicate,
  min(split) AS split, count(*) AS n_spots, count(*) FILTER (is_real) AS n_annotated, count(DISTINCT annotation) FILTER (is_real) AS n_classes,
  coalesce(string_agg(DISTINCT annotation, '|' ORDER BY annotation) FILTER (is_real), '') AS classes FROM spots GROUP BY sample_id""")
def cohort_summary(spark, sf_dir):
    return cohort.cohort_table(spots(spark, sf_dir))


@query(SQL + """, c AS (SELECT *, CASE WHEN annotation_floored <> '' THEN annotation_floored ELSE annotation END AS class FROM spots WHERE is_real OR annotation_floored <> '')
SELECT coalesce(tissue, 'ALL') AS tissue, class AS annotation, string_agg(DISTINCT annotation_raw, '|' ORDER BY annotation_raw) AS raw_labels, count(*) AS n_spots,
  count(DISTINCT sample_id) AS n_slides, bool_or(annotation_floored = '') AS scored FROM c GROUP BY GROUPING SETS ((tissue, class), (class))""")
def class_summary(spark, sf_dir):
    return cohort.class_table(spots(spark, sf_dir))


@query(SQL + "SELECT split, tissue, count(*) AS n_spots, count(DISTINCT sample_id) AS n_slides, count(DISTINCT donor) AS n_donors, count(*) FILTER (is_real) AS n_annotated FROM spots GROUP BY ALL")
def run_summary(spark, sf_dir):
    return cohort.run_summary(spots(spark, sf_dir))


@query(SQL + """, c AS (SELECT dataset_id, tissue, split, donor, sample_id, count(*) AS n FROM spots GROUP BY ALL),
t AS (SELECT dataset_id, tissue, split, count(DISTINCT donor) AS n_donors, count(*) AS n_samples, sum(n)::BIGINT AS n_spots FROM c GROUP BY ALL)
SELECT *, (sum(n_spots) OVER (PARTITION BY tissue))::BIGINT AS organ_spots FROM t""")
def dataset_summary(spark, sf_dir):
    return cohort.dataset_table(cohort.cohort_table(spots(spark, sf_dir)))


@query(SQL + "SELECT spot_key, sample_id FROM spots WHERE sample_id IN ('D0-1-1', 'D1-2-1', 'D2-1-2') AND sample_id NOT IN ('D1-2-1')")
def selected_samples(spark, sf_dir):
    return cohort.select_rows(spots(spark, sf_dir), ["D0-1-1", "D1-2-1", "D2-1-2"], ["D1-2-1"]).select("spot_key", "sample_id")


@query(SQL + "SELECT spot_key, tissue FROM spots WHERE split = 'train'")
def split_filter(spark, sf_dir):
    return cohort.split_rows(spots(spark, sf_dir), "train").select("spot_key", "tissue")


# Folds ---------------------------------------------------------------------------------


@query(SQL + "SELECT level, fold, role, sample_id FROM folds")
def fold_rows(spark, sf_dir):
    return folds.generate(_slides(spark, sf_dir))


@query(SQL + """SELECT level, fold, coalesce(string_agg(sample_id, '|' ORDER BY sample_id) FILTER (role = 'train'), '') AS train_sample_ids,
  coalesce(string_agg(sample_id, '|' ORDER BY sample_id) FILTER (role = 'eval'), '') AS eval_sample_ids FROM folds GROUP BY ALL""")
def fold_table(spark, sf_dir):
    return folds.fold_lists(folds.generate(_slides(spark, sf_dir)))


@query(SQL + "SELECT level, fold, string_agg(DISTINCT donor, '|' ORDER BY donor) AS eval_donors FROM folds JOIN slides USING (sample_id) WHERE role = 'eval' GROUP BY ALL")
def fold_eval_donors(spark, sf_dir):
    s = _slides(spark, sf_dir)
    return folds.eval_donors(folds.generate(s), s)


@query(SQL + """, d AS (SELECT DISTINCT tissue, donor FROM slides), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY tissue ORDER BY md5(concat_ws('|', '42', 'donor-cap', tissue, donor)), donor) <= 1)
SELECT f.* FROM folds f JOIN k ON f.fold = 'cross_donor__' || k.tissue || '__eval_' || k.donor""")
def fold_donor_cap(spark, sf_dir):
    return folds.cross_donor(_slides(spark, sf_dir), most=1)


@query(SQL + """SELECT f.level, f.fold, f.role, f.sample_id FROM folds f JOIN (SELECT level, fold FROM folds JOIN slides USING (sample_id) WHERE role = 'eval'
  GROUP BY ALL HAVING bool_and(tissue IN ('skin', 'lung'))) g USING (level, fold)""")
def fold_tissue_scope(spark, sf_dir):
    s = _slides(spark, sf_dir)
    return folds.scoped_folds(folds.generate(s), s, ["skin", "lung"])


@query(SQL + """, h AS (SELECT sample_id, string_agg(DISTINCT level, '|' ORDER BY level) AS h FROM folds WHERE role = 'eval' GROUP BY ALL),
c AS (SELECT tissue, donor, region, replicate, sample_id, count(*) FILTER (is_real) AS n_annotated, count(DISTINCT annotation) FILTER (is_real) AS n_classes FROM spots GROUP BY ALL)
SELECT c.*, coalesce(h, '') AS held_out_in, count(*) OVER (PARTITION BY tissue) AS tissue_rows, count(*) OVER (PARTITION BY tissue, donor) AS donor_rows,
  count(*) OVER (PARTITION BY tissue, donor, region) AS region_rows FROM c LEFT JOIN h USING (sample_id)""")
def fold_hierarchy(spark, sf_dir):
    x = spots(spark, sf_dir)
    return folds.held_out_in(folds.generate(folds.annotated_slides(x)), cohort.cohort_table(x))


# Probes --------------------------------------------------------------------------------


@query(SQL + S.PREDICTIONS + "SELECT fold, key, tissue, donor, sample_id, y_true, y_pred, n_train FROM pred")
def knn_predictions(spark, sf_dir):
    return _pred(spark, sf_dir).drop("level")


@query(SQL + S.PREDICTIONS + S.scoped() + S.counts() + S.MACRO.format(by="scope") + """, any_value(n_donors) AS n_donors, any_value(n_slides) AS n_slides
FROM counts_m JOIN (SELECT scope, count(DISTINCT donor) AS n_donors, count(DISTINCT sample_id) AS n_slides FROM scoped GROUP BY scope) USING (scope) GROUP BY scope""")
def flagship(spark, sf_dir):
    """5-NN label transfer, leave one donor out within its tissue, macro metrics per scope."""
    return rounded(probes.metric_rows(_pred(spark, sf_dir)))


@query(SQL + S.PREDICTIONS + S.scoped() + S.counts() + "SELECT scope, class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, support::BIGINT AS support FROM counts_m WHERE support > 0")
def per_class_metrics(spark, sf_dir):
    return rounded(probes.per_class_rows(_pred(spark, sf_dir)))


@query(SQL + S.PREDICTIONS + S.scoped() + "SELECT scope, y_true, y_pred, count(*) AS n FROM scoped GROUP BY ALL")
def confusion_counts(spark, sf_dir):
    return probes.confusion(probes.with_scopes(_pred(spark, sf_dir)), ["scope"])


@query(SQL + S.PREDICTIONS + S.scoped() + "SELECT scope, string_agg(DISTINCT y_true, ',' ORDER BY y_true) AS classes FROM scoped GROUP BY scope")
def score_vocabulary(spark, sf_dir):
    return probes.vocabulary(_pred(spark, sf_dir))


@query(SQL + S.PREDICTIONS + S.counts("pred", "counts", "fold, tissue") + S.MACRO.format(by="fold, tissue") + "FROM counts_m WHERE support > 0 GROUP BY fold, tissue")
def fold_scores(spark, sf_dir):
    return rounded(probes.fold_metrics(_pred(spark, sf_dir))).drop("level")


@query(SQL + S.PREDICTIONS + S.scoped() + S.counts() + S.MACRO.format(by="scope") + """, any_value(nd) AS n_donors, any_value(ns) AS n_slides, any_value(nt) AS n_train, any_value(nf) AS n_folds
FROM counts_m JOIN (SELECT scope, count(DISTINCT donor) AS nd, count(DISTINCT sample_id) AS ns FROM scoped GROUP BY scope) USING (scope),
  (SELECT floor(avg(n_train))::BIGINT AS nt, count(*) AS nf FROM (SELECT DISTINCT fold, n_train FROM pred)) GROUP BY scope""")
def pooled_folds(spark, sf_dir):
    return rounded(probes.pooled(_pred(spark, sf_dir))).drop("level")


@query(SQL + S.PREDICTIONS + S.MAJORITY + "SELECT fold, key, tissue, donor, sample_id, y_true, y_pred, n_train FROM major")
def majority_predictions(spark, sf_dir):
    return probes.leave_one_out(_rows(spark, sf_dir), "donor", majority=True).drop("level")


def _fold_sql(level):
    members = f"""
, members AS (
  SELECT s.spot_key AS key, s.annotation, s.tissue, s.donor, s.sample_id, f.fold, f.role, s.gene_features AS z FROM spots s JOIN folds f USING (sample_id) WHERE s.is_real AND f.level = '{level}'
)"""
    return SQL + members + S.PREDICTIONS[S.PREDICTIONS.index("), long AS") + 1 :] + "SELECT fold, key, tissue, donor, sample_id, y_true, y_pred, n_train FROM pred"


def _on_level(level):
    def run(spark, sf_dir):
        rows = folds.BUILDERS[level](_slides(spark, sf_dir))
        return probes.on_folds(_rows(spark, sf_dir), rows).drop("level")

    run.__name__ = f"heldout_{level}"
    return run


for _level in folds.LEVELS:
    query(_fold_sql(_level))(_on_level(_level))


@query()
def pooled_loso(spark, sf_dir):
    return rounded(probes.metric_rows(probes.leave_one_out(_rows(spark, sf_dir), "sample_id")))


@query()
def pooled_loso_on_fold(spark, sf_dir):
    rows = folds.cross_donor(_slides(spark, sf_dir))
    return rounded(probes.metric_rows(probes.leave_one_out_on_fold(_rows(spark, sf_dir), rows, "cross_donor", "cross_donor__skin__eval_D0")))


@query()
def all_protocols(spark, sf_dir):
    pred = probes.run_protocols(_rows(spark, sf_dir), folds.generate(_slides(spark, sf_dir)))
    return rounded(probes.metric_rows(pred, ["protocol", "level"]))


# Sampling ------------------------------------------------------------------------------


@query(SQL + "SELECT spot_key FROM spots ORDER BY md5(concat_ws('|', '42', 'uniform', spot_key)), spot_key LIMIT 100")
def uniform_sample(spark, sf_dir):
    return sampling.uniform_sample(spots(spark, sf_dir), "spot_key", 100).select("spot_key")


_STRATA = """, n AS (SELECT annotation, count(*) AS n FROM spots WHERE is_real GROUP BY ALL), q0 AS (
  SELECT *, sum(n) OVER () AS total, floor(n * 90 / sum(n) OVER ()) AS share, n * 90 / sum(n) OVER () - floor(n * 90 / sum(n) OVER ()) AS rest FROM n
), q AS (
  SELECT annotation, n, (CASE WHEN total <= 90 THEN n ELSE share + CASE WHEN row_number() OVER (ORDER BY rest DESC, md5(concat_ws('|', '42', 'remainder', annotation))) <= 90 - sum(share) OVER () THEN 1 ELSE 0 END END)::BIGINT AS quota FROM q0
)
"""


@query(SQL + _STRATA + "SELECT annotation, n, quota FROM q")
def sample_quotas(spark, sf_dir):
    x = spots(spark, sf_dir).where(is_labelled("annotation")).groupBy("annotation").agg(F.count(F.lit(1)).alias("n"))
    return sampling.stratum_quotas(x, "annotation", 90)


@query(SQL + _STRATA + """SELECT spot_key, annotation FROM (SELECT *, row_number() OVER (PARTITION BY annotation ORDER BY md5(concat_ws('|', '42', 'stratified', spot_key)), spot_key) AS r
  FROM spots WHERE is_real) JOIN q USING (annotation) WHERE r <= quota""")
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(spots(spark, sf_dir).where(is_labelled("annotation")), "spot_key", "annotation", 90).select("spot_key", "annotation")


@query(SQL + """SELECT spot_key, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY md5(concat_ws('|', '42', 'cap', spot_key)), spot_key) AS r,
  greatest(1, round_even(count(*) OVER (PARTITION BY sample_id) * 0.25, 0)) AS quota FROM spots) WHERE r <= quota""")
def slide_cap(spark, sf_dir):
    return sampling.proportional_cap(spots(spark, sf_dir), "spot_key", "sample_id", 0.25).select("spot_key", "sample_id")


@query(SQL + """SELECT spot_key, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '42', 'validation', spot_key)), spot_key) <= greatest(2, floor(0.1 * count(*) OVER ())) THEN 'val' ELSE 'train' END AS part FROM spots""")
def train_validation(spark, sf_dir):
    return sampling.train_validation(spots(spark, sf_dir), "spot_key", 0.1).select("spot_key", "part")


@query(SQL + """, a AS (SELECT spot_key, sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY spot_key) AS r FROM spots),
b AS (SELECT spot_key AS moved, sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY md5(concat_ws('|', '42', 'permute', spot_key)), spot_key) AS r FROM spots)
SELECT spot_key, sample_id, moved FROM a JOIN b USING (sample_id, r)""")
def permuted_within(spark, sf_dir):
    x = spots(spark, sf_dir).select("spot_key", "sample_id", F.col("spot_key").alias("moved"))
    return sampling.permuted(x, "spot_key", "moved", ["sample_id"])


@query("SELECT l_partkey, round(sum(l_quantity), 6) AS score FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, 1 LIMIT 50")
def top_scores(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_partkey").agg(F.sum("l_quantity").alias("score"))
    return rounded(sampling.top_n(x, "score", "l_partkey", 50))


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat_ws('|', '42', 'cap', event_id)), event_id) AS r, greatest(1, round_even(count(*) OVER (PARTITION BY event_type) * 0.01, 0)) AS q FROM events) WHERE r <= q")
def event_cap(spark, sf_dir):
    return sampling.proportional_cap(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "event_type", 0.01).select("event_id", "event_type")


# Bootstrap -----------------------------------------------------------------------------

_POINT = """
, value AS (
  SELECT scope, class, f AS value FROM counts_m WHERE support > 0
  UNION ALL SELECT scope, 'macro', avg(f) FROM counts_m WHERE support > 0 GROUP BY scope
), donors AS (SELECT scope, count(DISTINCT donor) AS n_donors FROM scoped GROUP BY scope)
"""


@query(SQL + S.PREDICTIONS + S.scoped() + S.counts() + _POINT + S.replicates(N_BOOT) + """
SELECT v.scope, v.class, round(value, 6) AS value, n_donors, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi, coalesce(nb, 0) AS n_boot FROM value v JOIN donors USING (scope)
LEFT JOIN (SELECT scope, class, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, count(DISTINCT replicate) AS nb FROM draws GROUP BY ALL) USING (scope, class)""")
def donor_bootstrap(spark, sf_dir):
    return rounded(bootstrap.bootstrap_rows(cut(_pred(spark, sf_dir)), N_BOOT))


@query(SQL + S.PREDICTIONS + S.MAJORITY + S.scoped() + S.scoped("major", "other") + S.counts() + S.counts("other", "oc") + S.replicates(N_BOOT) + S.replicates(N_BOOT, "other", "od") + """
, va AS (SELECT scope, class, f FROM counts_m WHERE support > 0 UNION ALL SELECT scope, 'macro', avg(f) FROM counts_m WHERE support > 0 GROUP BY scope
), vb AS (SELECT scope, class, f FROM oc_m WHERE support > 0 UNION ALL SELECT scope, 'macro', avg(f) FROM oc_m WHERE support > 0 GROUP BY scope
), d AS (SELECT scope, class, a.value - b.value AS d FROM draws a JOIN od b USING (scope, replicate, class)
), ci AS (SELECT scope, class, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, least(1, 2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT))) AS p FROM d GROUP BY ALL)
SELECT scope, class, round(va.f - vb.f, 6) AS delta, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi, round(p, 6) AS p_two_sided FROM va JOIN vb USING (scope, class) LEFT JOIN ci USING (scope, class)""")
def paired_delta(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    both = probes.paired(probes.leave_one_out(rows, "donor"), probes.leave_one_out(rows, "donor", majority=True), ["fold", "key"])
    return rounded(bootstrap.delta_rows(cut(both), N_BOOT))


@query(SQL + S.PREDICTIONS + S.counts("pred", "counts", "tissue") + S.counts("pred", "dc", "tissue, donor") + f"""
, organs AS (SELECT tissue, donor, row_number() OVER (PARTITION BY tissue ORDER BY donor) - 1 AS i, count(*) OVER (PARTITION BY tissue) AS n_donors FROM (SELECT DISTINCT tissue, donor FROM pred)
), t AS (SELECT tissue, n_donors, row_number() OVER (ORDER BY tissue) - 1 AS o, count(*) OVER () AS n_organs FROM (SELECT DISTINCT tissue, n_donors FROM organs)
), slots AS (SELECT replicate, slot, {S.number("'42'", "'organ'", "replicate", "slot")} % n_organs AS o FROM (SELECT n_organs, unnest(range({N_BOOT})) AS replicate FROM t WHERE o = 0 AND n_organs >= 2) q, LATERAL (SELECT unnest(range(q.n_organs)) AS slot)
), d0 AS (SELECT s.replicate, s.slot, t.tissue, t.n_donors FROM slots s JOIN t USING (o)
), d1 AS (SELECT replicate, slot, tissue, {S.number("'42'", "'organ-donor'", "replicate", "slot", "draw")} % n_donors AS i FROM d0, LATERAL (SELECT unnest(range(d0.n_donors)) AS draw)
), w AS (SELECT replicate, slot, tissue, donor, count(*) AS w FROM d1 JOIN organs USING (tissue, i) GROUP BY ALL
), sc AS (SELECT tissue, class FROM dc GROUP BY ALL HAVING sum(support) > 0
), sums AS (SELECT replicate, slot, tissue, class, sum(tp * w) AS tp, sum(support * w) AS s, sum(predicted * w) AS p FROM dc JOIN sc USING (tissue, class) JOIN w USING (tissue, donor) GROUP BY ALL
), organ AS (SELECT replicate, slot, sum(CASE WHEN s + p > 0 THEN 2 * tp / (s + p) ELSE 0 END) / any_value(n) AS f FROM sums JOIN (SELECT tissue, count(*) AS n FROM sc GROUP BY ALL) USING (tissue) GROUP BY ALL
), r AS (SELECT replicate, avg(f) AS value FROM organ GROUP BY ALL
), v AS (SELECT tissue, avg(f) AS f FROM counts_m WHERE support > 0 GROUP BY tissue)
SELECT (SELECT round(avg(f), 6) FROM v) AS value, (SELECT count(*) FROM v) AS n_organs, round(quantile_cont(value, 0.025), 6) AS ci_lo, round(quantile_cont(value, 0.975), 6) AS ci_hi, count(*) AS n_boot FROM r""")
def balanced_bootstrap(spark, sf_dir):
    return rounded(bootstrap.balanced_row(cut(_pred(spark, sf_dir)), N_BOOT))


@query(SQL + S.PREDICTIONS + S.scoped() + S.replicates(N_BOOT) + """
, two AS (SELECT 1 AS seed, * FROM draws UNION ALL SELECT 2, scope, replicate, class, value * 0.9 FROM draws)
SELECT scope, class, round(quantile_cont(value, 0.025), 6) AS ci_lo_pooled, round(quantile_cont(value, 0.975), 6) AS ci_hi_pooled, count(DISTINCT seed) AS n_seeds_pooled FROM two GROUP BY ALL""")
def pooled_draws(spark, sf_dir):
    draws = bootstrap.replicate_scores(probes.with_scopes(cut(_pred(spark, sf_dir))), ["scope"], N_BOOT)
    two = draws.withColumn("seed", F.lit(1)).unionByName(draws.withColumn("value", F.col("value") * 0.9).withColumn("seed", F.lit(2)))
    return rounded(bootstrap.pooled_interval(two, ["scope", "class"]))


@query()
def digest_order(spark, sf_dir):
    return spots(spark, sf_dir).select("spot_key", digest(42, "uniform", "spot_key").alias("digest"))


ORACLE["digest_order"] = "SELECT vec_id AS spot_key, md5(concat_ws('|', '42', 'uniform', vec_id)) AS digest FROM embeddings"
