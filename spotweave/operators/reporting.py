"""Joining what is scored in parts: pooled intervals onto rows, paired predictions, wide columns, scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.functions.lineage import cut
from spotweave.operators import bootstrap, probes

#: The condition that the others are compared with.
REFERENCE = "none"
#: What names one prediction, and what a pooled interval is one for.
PREDICTION = ("seed", "protocol", "level")
POOL = ("protocol", "level", "scope", "class")


def attach_pooled(rows: DataFrame, pooled: DataFrame, by: list[str]) -> DataFrame:
    """Pooled columns (ci_lo_pooled, ci_hi_pooled, n_seeds_pooled, p_two_sided_pooled where there) on every row of their group; null elsewhere."""
    own = [c for c in pooled.columns if c.endswith("_pooled")]
    return rows.join(pooled.select(*by, *own), by, "left")


def attach_pooled_wide(rows: DataFrame, pooled: DataFrame, by: list[str] = ("method",)) -> DataFrame:
    """Pooled intervals (method, level, scope) as columns f1/<scope>/<level>_lo_pooled, _hi_pooled, _n_seeds of wide rows.

    Only for columns that the rows have. The columns are read off the rows, so the pivot knows its values.
    """
    points = [c.split("/") for c in rows.columns if c.startswith("f1/") and c.count("/") == 2 and not c.endswith(("_lo", "_hi", "_n_donors", "_pooled", "_n_seeds"))]
    names = {"ci_lo_pooled": "lo_pooled", "ci_hi_pooled": "hi_pooled", "n_seeds_pooled": "n_seeds"}
    pick = lambda scope, level, c: F.max(F.when((F.col("scope") == scope) & (F.col("level") == level), F.col(c)))
    cells = [pick(scope, level, c).alias(f"f1/{scope}/{level}_{end}") for _, scope, level in points for c, end in names.items()]
    return rows.join(pooled.groupBy(*by).agg(*cells), list(by), "left") if cells else rows


def same_rows(pred: DataFrame, reference: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """Pairs of predictions on identical rows: pred's rows with y_pred_a (its own) and y_pred_b (the reference's).

    A group of `by` whose rows or truths differ from the reference's is left out whole, and none is refused.
    """
    a = pred.withColumnRenamed("y_pred", "y_pred_a")
    b = reference.select(*by, key, F.col("y_true").alias("_true"), F.col("y_pred").alias("y_pred_b"))
    both = a.join(b, [*by, key])
    n = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    met = n(both.where("y_true = _true"), "_met").join(n(a, "_a"), by).join(n(b, "_b"), by).where("_met = _a and _met = _b")
    return both.drop("_true").join(met.select(*by), by, "left_semi")


def model_pairs(pred: DataFrame, models: list[str], corrections: tuple = ("harmony", "combat", "bbknn")) -> DataFrame:
    """Every model's predictions beside those of its reference model; the majority model and references have no pair."""
    out = None
    for model in models:
        reference = probes.reference_model(model, corrections, tuple(models))
        if model in ("majority", reference):
            continue
        one = same_rows(pred.where(F.col("model") == model), pred.where(F.col("model") == reference), list(PREDICTION))
        one = one.withColumn("reference", F.lit(reference))
        out = one if out is None else out.unionByName(one)
    return out


def condition_pairs(pred: DataFrame, reference: str = REFERENCE) -> DataFrame:
    """Every condition's predictions (y_pred_b) beside those of the reference condition (y_pred_a), which comes first in the delta."""
    other = pred.where(F.col("condition") != reference)
    names = other.select("condition").distinct()
    base = pred.where(F.col("condition") == reference).drop("condition").join(F.broadcast(names))  # a row per condition
    pairs = same_rows(other, base, ["condition", *PREDICTION])
    rest = [c for c in pairs.columns if c not in ("y_pred_a", "y_pred_b")]
    return pairs.select(*rest, F.col("y_pred_b").alias("y_pred_a"), F.col("y_pred_a").alias("y_pred_b"), F.lit(reference).alias("reference"))


def score_prediction(pred: DataFrame, by: list[str], times: int, seed: int = 42) -> DataFrame:
    """Each prediction (a group of `by`) scored: a row per scope and class, the macro among them, with its F1, donors and interval."""
    return bootstrap.bootstrap_rows(cut(pred), times, seed, by)


def scope_classes(pred: DataFrame, classes: list[str], vocabulary: DataFrame) -> DataFrame:
    """(scope, class, scored): the full vocabulary of every scope, and the part of it that the macro average runs over.

    The global scope has a cell for each organ and class. Scored are the classes of `vocabulary` (scope, class)
    that occur in the scope's truth; where none is known, those that occur.
    """
    spans = pred.select("tissue").distinct()
    named = pred.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    cells = spans.join(F.broadcast(named))  # a row per declared class
    full = cells.select(F.col("tissue").alias("scope"), "class").unionByName(cells.select(F.lit("global").alias("scope"), F.concat_ws(" | ", "tissue", "class").alias("class"))).distinct()
    seen = probes.with_scopes(pred.select("tissue", "y_true", F.col("y_true").alias("y_pred"))).select("scope", F.col("y_true").alias("class")).distinct()
    known = vocabulary.select("scope", "class").distinct().withColumn("_known", F.lit(True))
    x = full.withColumn("_full", F.lit(True)).join(seen.withColumn("_seen", F.lit(True)), ["scope", "class"], "full").join(known, ["scope", "class"], "left")
    scored = F.coalesce(F.col("_full") & F.col("_seen") & F.col("_known"), F.lit(False))
    none = ~F.bool_or(scored).over(Window.partitionBy("scope"))
    x = x.withColumn("scored", scored | (none & F.coalesce("_seen", F.lit(False))))
    return x.where("_full or scored").select("scope", "class", "scored")


def condition_summary(results: DataFrame, conditions: list[str]) -> DataFrame:
    """Mean macro-F1 of every protocol, level and scope, a column for each condition; the global scope only where there is no other."""
    means = results.groupBy("protocol", "level", "scope").pivot("condition", conditions).agg(F.avg("f1_score"))
    lone = F.bool_and(F.col("scope") == "global").over(Window.partitionBy())  # a row per protocol, level and scope
    return means.withColumn("_lone", lone).where(F.col("_lone") | (F.col("scope") != "global")).drop("_lone")


def panel_columns(panel: DataFrame, name: str = "metric") -> DataFrame:
    """Metrics with their panel (batch, bio, other) as prefixed names: batch/ilisi."""
    return panel.withColumn("column", F.concat_ws("/", "panel", name))


def wide_scopes(columns: list[str]) -> list[str]:
    """The scopes that wide columns f1/<scope>/<level> name, the global one first; of f1/<level> alone, the global one."""
    f1 = [c.split("/") for c in columns if c.startswith("f1/")]
    found = {c[1] for c in f1 if len(c) > 2}
    return sorted(found, key=lambda s: (s != "global", s)) if found else ["global"] * bool(f1)


def mean_intervals(rows: DataFrame, scope: str, by: list[str] = ("class", "condition")) -> DataFrame:
    """Mean interval of every class and condition in one scope; the pooled interval where the rows have it."""
    ends = ("ci_lo_pooled", "ci_hi_pooled") if "ci_lo_pooled" in rows.columns else ("ci_lo", "ci_hi")
    return rows.where(F.col("scope") == scope).groupBy(*by).agg(F.avg(ends[0]).alias("lo"), F.avg(ends[1]).alias("hi"))
