"""One long table of scores: melts into it, conflicts in it, and what it was checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of the score frame, in order.
SCHEMA = (
    "run_name", "substrate", "stage", "model", "condition", "seed", "protocol", "level", "fold", "scope",
    "class", "metric", "value", "ci_lo", "ci_hi", "p_two_sided", "n_donors", "n_boot", "source",
)
NUMBERS = ("value", "ci_lo", "ci_hi", "p_two_sided", "n_donors", "n_boot")
#: What makes two scores the same quantity.
CELL = ("run_name", "substrate", "model", "condition", "seed", "protocol", "level", "fold", "scope", "class", "metric")
POINTS = ("accuracy", "precision", "recall", "f1_score")


def score_frame(df: DataFrame) -> DataFrame:
    """The fixed columns: absent ones null, others dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast("double" if c in NUMBERS else "string").alias(c) for c in SCHEMA])


def union_scores(*frames: DataFrame) -> DataFrame:
    out = score_frame(frames[0])
    for f in frames[1:]:
        out = out.unionByName(score_frame(f))
    return out


def melt_points(df: DataFrame, **labels: str) -> DataFrame:
    """Point metrics to rows; a metric that is null or NaN gives none."""
    ids = [c for c in df.columns if c not in POINTS]
    x = df.unpivot(ids, [c for c in POINTS if c in df.columns], "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    return score_frame(x.withColumns({k: F.lit(v) for k, v in labels.items()}))


def melt_intervals(df: DataFrame, **labels: str) -> DataFrame:
    """Bootstrap rows; the pooled interval wins where there is one."""
    have = set(df.columns)
    pick = lambda c: F.coalesce(*[F.col(n) for n in (f"{c}_pooled", c) if n in have]).alias(c)
    x = df.select(*[c for c in df.columns if not c.startswith("ci_")], pick("ci_lo"), pick("ci_hi")).withColumn("metric", F.lit("f1_score"))
    return score_frame(x.withColumns({k: F.lit(v) for k, v in labels.items()}))


def melt_deltas(df: DataFrame, **labels: str) -> DataFrame:
    """Delta rows of either naming: delta or delta_f1, model or method. A row with a pooled interval takes it and the pooled p."""
    have = set(df.columns)
    one = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None))
    pooled = F.col("ci_lo_pooled").isNotNull() & ~F.isnan("ci_lo_pooled") if "ci_lo_pooled" in have else F.lit(False)
    pick = lambda c: F.when(pooled, one(f"{c}_pooled", *([c] if c == "p_two_sided" else []))).otherwise(one(c))
    x = df.withColumns({
        "value": one("delta", "delta_f1"), "model": F.coalesce(one("model", "method").cast("string"), F.lit("")), "metric": F.lit("delta_f1"),
        "fold": F.lit("pooled"), "class": F.coalesce(one("class").cast("string"), F.lit("macro")), **{c: pick(c) for c in ("ci_lo", "ci_hi", "p_two_sided")},
    })
    return score_frame(x.withColumns({k: F.lit(v) for k, v in labels.items()}))


def melt_effective_rank(df: DataFrame, **labels: str) -> DataFrame:
    """Effective ranks (column, variant, eff_rank) as scores of the whole cohort."""
    x = df.select(F.col("column").alias("model"), F.col("variant").alias("condition"), F.col("eff_rank").alias("value"))
    fixed = {"scope": "cohort", "class": "macro", "metric": "eff_rank", "stage": "diagnose", **labels}
    return score_frame(x.withColumns({k: F.lit(v) for k, v in fixed.items()}))


def union_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """The scores of several runs, each row with its run's name."""
    return union_scores(*[df.withColumn("run_name", F.lit(name)) for name, df in sorted(runs.items())])


def check_runs(runs: dict[str, DataFrame], tolerance: float = 5e-4, aliases=None) -> DataFrame:
    """Scores of all runs, or an error: no scores, a cell with two values, or an alias that compared nothing."""
    df = union_runs(runs)
    if df.isEmpty():
        refuse("scores", "no run has any")
    refuse_conflicts(df, tolerance=tolerance, aliases=aliases)
    idle = idle_aliases(df, aliases).first() if aliases else None
    if idle:
        refuse("scores", f"the alias {idle['stage']}/{idle['model']} compared nothing", f"it stands for {idle['target']}")
    return df


def unfold_wide(df: DataFrame, key: str = "method") -> DataFrame:
    """batch/x, bio/x and f1/<scope>/<level> columns to rows; a column with a _lo sibling is a point with its interval."""
    wide = [c for c in df.columns if c.count("/")]
    ends = ("_lo", "_hi", "_n_donors", "_lo_pooled", "_hi_pooled", "_n_seeds")
    points = [c for c in wide if not c.endswith(ends)]
    have = set(df.columns)
    cell = lambda c, *n: F.coalesce(*[F.col(f"`{c}{x}`").cast("double") for x in n if f"{c}{x}" in have], F.lit(None).cast("double"))
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value"), cell(c, "_lo_pooled", "_lo").alias("ci_lo"), cell(c, "_hi_pooled", "_hi").alias("ci_hi")) for c in points])
    x = df.select(F.col(key).alias("model"), F.explode(rows).alias("r")).select("model", "r.*").where("value is not null")
    p = F.split("name", "/")
    f1 = p[0] == "f1"
    return x.select("model", F.when(f1, "f1_score").otherwise(F.col("name")).alias("metric"), F.when(f1, p[1]).alias("scope"), F.when(f1, F.get(p, 2)).alias("level"), "value", "ci_lo", "ci_hi")


def panel_seeds(df: DataFrame, name: str = "representation") -> DataFrame:
    """`model (seed n)` to model and seed."""
    form = r"^(.*?)(?: \(seed (\d+)\))?$"
    seed = F.regexp_extract(name, form, 2)
    return df.withColumn("model", F.regexp_extract(name, form, 1)).withColumn("seed", F.when(seed != "", seed))


def panel_means(df: DataFrame, metrics: list[str], name: str = "representation") -> DataFrame:
    """Panel metrics averaged over a model's seeds."""
    return panel_seeds(df, name).groupBy("model").agg(*[F.avg(m).alias(m) for m in metrics])


def comparable(df: DataFrame, aliases: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Aliases of (stage, model) resolved, null values dropped, null keys as ''."""
    model = F.col("model")
    for (stage, name), to in (aliases or {}).items():
        model = F.when((F.col("stage") == stage) & (F.col("model") == name), F.lit(to)).otherwise(model)
    x = df.withColumn("model", model).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return x.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CELL})


def conflicts(df: DataFrame, tolerance: float = 5e-4, aliases=None) -> DataFrame:
    """Cells that two or more sources give with values further apart than the tolerance."""
    x = comparable(df, aliases).groupBy(*CELL).agg(
        F.countDistinct("source").alias("n_sources"), (F.max("value") - F.min("value")).alias("spread"),
        F.array_join(F.array_sort(F.collect_set(F.concat("source", F.lit("="), F.format_number("value", 6)))), "; ").alias("values"),
    )
    return x.where((F.col("n_sources") >= 2) & (F.col("spread") > tolerance))


def cross_checks(df: DataFrame, aliases=None) -> DataFrame:
    """How many cells each set of sources agrees on being asked about."""
    x = comparable(df, aliases).groupBy(*CELL).agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"), F.countDistinct("source").alias("n_sources"))
    return x.where("n_sources >= 2").groupBy("sources").agg(F.count(F.lit(1)).alias("n_cells"))


def idle_aliases(df: DataFrame, aliases: dict[tuple[str, str], str]) -> DataFrame:
    """Aliases that compare nothing: no other stage has a cell of the name they resolve to."""
    x = df.where(F.col("value").isNotNull()).withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CELL})
    names = df.sparkSession.createDataFrame([(s, m, t) for (s, m), t in aliases.items()], "stage string, model string, target string")
    rest = [c for c in CELL if c != "model"]
    a = x.join(F.broadcast(names), ["stage", "model"]).select("stage", F.col("model").alias("alias"), F.col("target").alias("model"), *rest)  # a row per alias
    b = x.select(F.col("stage").alias("other"), *CELL).distinct()
    met = a.join(b, [*CELL]).where("other <> stage").select("stage", F.col("alias").alias("model")).distinct()
    return names.join(met, ["stage", "model"], "left_anti")


class Refused(ValueError):
    """A result that must not be used."""


def refuse(what: str, why: str, hint: str = "") -> None:
    raise Refused(f"{what}: {why}" + (f" ({hint})" if hint else ""))


def refuse_conflicts(df: DataFrame, **options) -> DataFrame:
    """The scores themselves, or an error naming the first conflict."""
    first = conflicts(df, **options).first()
    if first:
        refuse("scores", f"{first['n_sources']} sources differ by {first['spread']:.4f}", first["values"])
    return df


def undeclared(df: DataFrame, column: str, declared: list[str]) -> DataFrame:
    """Values of a column that are not declared."""
    return df.select(column).distinct().where(~F.col(column).isin(*declared))


def verify_features(features: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """Data quality of a feature table (sample_id, spot_id, v): what is not finite, repeated, unknown or of another width."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ids = features.groupBy("sample_id", "spot_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("n_repeated"))
    gone = features.join(known.select("sample_id", "spot_id").distinct(), ["sample_id", "spot_id"], "left_anti").agg(F.count(F.lit(1)).alias("n_unknown"))
    own = features.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_not_finite"), F.count_if(F.size("v") != width).alias("n_other_width"))
    return own.join(ids).join(gone)


def refit_check(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """Row cosine of two fits on the same rows: its least, first percentile and mean."""
    from spotweave.functions.vectors import dot, unit

    x = a.select(key, unit(F.col(vector)).alias("u")).join(b.select(key, unit(F.col(vector)).alias("w")), key)
    return x.select(dot(F.col("u"), F.col("w")).alias("c")).agg(F.count("c").alias("n"), F.min("c").alias("least"), F.percentile("c", 0.01).alias("p01"), F.avg("c").alias("mean"))
