"""DuckDB texts of the probe queries, as views to add after the cohort's."""

#: Leave-one-donor-out 5-NN on gene features: view pred.
PREDICTIONS = """
, members AS (
  SELECT s.spot_key AS key, s.annotation, s.tissue, s.donor, s.sample_id, h.donor AS held, s.tissue || '|' || h.donor AS fold,
         CASE WHEN s.donor = h.donor THEN 'eval' ELSE 'train' END AS role, s.gene_features AS z
  FROM spots s JOIN (SELECT DISTINCT tissue, donor FROM slides) h USING (tissue)
  WHERE s.is_real AND (SELECT count(DISTINCT donor) FROM slides x WHERE x.tissue = s.tissue) >= 2
), long AS (
  SELECT fold, role, key, generate_subscripts(z, 1) AS pos, unnest(z)::DOUBLE AS v FROM members
), scale AS (
  SELECT fold, pos, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-8 THEN 1 ELSE stddev_pop(v) END AS d FROM long WHERE role = 'train' GROUP BY ALL
), x AS (
  SELECT fold, role, key, list((v - m) / d ORDER BY pos) AS x FROM long JOIN scale USING (fold, pos) GROUP BY ALL
), pairs AS (
  SELECT a.fold, a.key, b.key AS other, list_distance(a.x, b.x) AS dist FROM x a JOIN x b ON a.fold = b.fold AND a.role = 'eval' AND b.role = 'train'
), near AS (
  SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY fold, key ORDER BY dist, other) <= 5
), votes AS (
  SELECT n.fold, n.key, m.annotation, count(*) AS n FROM near n JOIN members m ON n.fold = m.fold AND n.other = m.key GROUP BY ALL
), guess AS (
  SELECT fold, key, annotation AS y_pred FROM votes QUALIFY row_number() OVER (PARTITION BY fold, key ORDER BY n DESC, annotation) = 1
), sizes AS (
  SELECT fold, count(*) AS n_train FROM members WHERE role = 'train' GROUP BY fold
), pred AS (
  SELECT m.fold, m.key, m.tissue, m.donor, m.sample_id, m.annotation AS y_true, g.y_pred, n_train
  FROM members m JOIN guess g USING (fold, key) JOIN sizes USING (fold) WHERE m.role = 'eval'
)
"""

#: Majority predictions on the same folds: view major.
MAJORITY = """
, freq AS (
  SELECT fold, annotation, count(*) AS n FROM members WHERE role = 'train' GROUP BY ALL
), top AS (
  SELECT fold, annotation AS y_pred FROM freq QUALIFY row_number() OVER (PARTITION BY fold ORDER BY n DESC, annotation) = 1
), major AS (
  SELECT m.fold, m.key, m.tissue, m.donor, m.sample_id, m.annotation AS y_true, top.y_pred, n_train
  FROM members m JOIN top USING (fold) JOIN sizes USING (fold) WHERE m.role = 'eval'
)
"""


def scoped(source: str = "pred", name: str = "scoped") -> str:
    return f"""
, {name} AS (
  SELECT 'global' AS scope, fold, key, tissue, donor, sample_id, tissue || ' | ' || y_true AS y_true, tissue || ' | ' || y_pred AS y_pred FROM {source}
  UNION ALL SELECT tissue, fold, key, tissue, donor, sample_id, y_true, y_pred FROM {source}
)
"""


def counts(source: str = "scoped", name: str = "counts", by: str = "scope") -> str:
    """Per class: tp, support, predicted, and precision, recall, f1."""
    return f"""
, {name}0 AS (
  SELECT {by}, y_true AS class, count(*) FILTER (y_true = y_pred) AS tp, count(*) AS support, 0 AS predicted FROM {source} GROUP BY ALL
  UNION ALL SELECT {by}, y_pred, 0, 0, count(*) FROM {source} GROUP BY ALL
), {name} AS (
  SELECT {by}, class, sum(tp)::DOUBLE AS tp, sum(support)::DOUBLE AS support, sum(predicted)::DOUBLE AS predicted FROM {name}0 GROUP BY ALL
), {name}_m AS (
  SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r,
         CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f FROM {name}
)
"""


MACRO = """
SELECT {by}, count(*) FILTER (support > 0) AS n_classes_scored, round(sum(tp) / sum(support), 6) AS accuracy,
  round(avg(p) FILTER (support > 0), 6) AS precision, round(avg(r) FILTER (support > 0), 6) AS recall, round(avg(f) FILTER (support > 0), 6) AS f1_score,
  sum(support)::BIGINT AS n_test
"""


def number(*parts: str) -> str:
    """The first 32 bits of md5(seed|purpose|parts)."""
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8))::BIGINT"


def replicates(n: int, source: str = "scoped", name: str = "draws") -> str:
    """Per scope, replicate and class (with macro): the F1 of weighted donor sums."""
    return f"""
, {name}_donors AS (
  SELECT scope, donor, row_number() OVER (PARTITION BY scope ORDER BY donor) - 1 AS i, count(*) OVER (PARTITION BY scope) AS n_donors
  FROM (SELECT DISTINCT scope, donor FROM {source})
), {name}_picks AS (
  SELECT scope, replicate, {number("'42'", "'donor'", "replicate", "draw")} % n_donors AS i
  FROM (SELECT scope, n_donors, unnest(range({n})) AS replicate FROM {name}_donors WHERE i = 0 AND n_donors >= 2) q, LATERAL (SELECT unnest(range(q.n_donors)) AS draw)
), {name}_w AS (
  SELECT p.scope, replicate, donor, count(*) AS w FROM {name}_picks p JOIN {name}_donors d USING (scope, i) GROUP BY ALL
)
""" + counts(source, f"{name}_c", "scope, donor") + f"""
, {name}_scored AS (
  SELECT scope, class FROM {name}_c GROUP BY ALL HAVING sum(support) > 0
), {name}_sums AS (
  SELECT scope, replicate, class, sum(tp * w) AS tp, sum(support * w) AS s, sum(predicted * w) AS p
  FROM {name}_c JOIN {name}_scored USING (scope, class) JOIN {name}_w USING (scope, donor) GROUP BY ALL
), {name}_each AS (
  SELECT g.scope, g.replicate, sc.class, coalesce(CASE WHEN s + p > 0 THEN 2 * tp / (s + p) ELSE 0 END, 0) AS value
  FROM (SELECT DISTINCT scope, replicate FROM {name}_w) g JOIN {name}_scored sc USING (scope) LEFT JOIN {name}_sums x USING (scope, replicate, class)
), {name} AS (
  SELECT * FROM {name}_each UNION ALL SELECT scope, replicate, 'macro', avg(value) FROM {name}_each GROUP BY ALL
)
"""
