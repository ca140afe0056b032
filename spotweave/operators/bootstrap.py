"""Group bootstrap on additive confusion counts.

Confusion counts add up over donors, so a replicate is a weighted sum of per-donor counts:
the plans hold replicates x donors x classes rows, never replicates x spots. Picks come from
md5 digests and index the scope's own sorted donors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.functions.keys import digest_number, ratio
from spotweave.operators.probes import class_counts, class_metrics, confusion, macro_metrics, with_scopes


def donor_index(scoped: DataFrame, by: list[str]) -> DataFrame:
    """(by, donor, i, n_donors): a dense index of every scope's sorted donors."""
    d = scoped.select(*by, "donor").distinct()
    return d.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("donor")) - 1).withColumn("n_donors", F.count(F.lit(1)).over(Window.partitionBy(*by)))


def picks(index: DataFrame, by: list[str], n_boot: int, seed: int = 42) -> DataFrame:
    """(by, replicate, donor, w): donors drawn with replacement, as often as there are donors; scopes with one draw none."""
    sizes = index.where("i = 0 and n_donors >= 2").select(*by, "n_donors")
    draws = sizes.select(*by, "n_donors", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("replicate"))
    draws = draws.select("*", F.explode(F.sequence(F.lit(0), (F.col("n_donors") - 1).cast("int"))).alias("draw"))
    i = digest_number(seed, "donor", "replicate", "draw") % F.col("n_donors")
    w = draws.select(*by, "replicate", i.cast("int").alias("i")).groupBy(*by, "replicate", "i").agg(F.count(F.lit(1)).alias("w"))
    return w.join(index.select(*by, "i", "donor"), [*by, "i"]).drop("i")


def _donor_counts(scoped: DataFrame, by: list[str], guess: str = "y_pred") -> DataFrame:
    cells = confusion(scoped.withColumn("y_pred", F.col(guess)), [*by, "donor"])
    return class_counts(cells, [*by, "donor"])


def replicate_scores(scoped: DataFrame, by: list[str], n_boot: int, seed: int = 42, guess: str = "y_pred") -> DataFrame:
    """(by, replicate, class, value): F1 of every scored class, and their mean as class `macro`, in every replicate."""
    counts = _donor_counts(scoped, by, guess)
    scored = counts.groupBy(*by, "class").agg(F.sum("support").alias("_s")).where("_s > 0").drop("_s")
    counts = counts.join(scored, [*by, "class"], "left_semi")
    w = picks(donor_index(scoped, by), by, n_boot, seed)
    sums = counts.join(w, [*by, "donor"]).groupBy(*by, "replicate", "class").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("tp", "support", "predicted")])
    # a class that no picked donor has counts as 0 in the mean
    n = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n_scored"))
    f1 = sums.withColumn("value", ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))).join(n, by)
    macro = f1.groupBy(*by, "replicate").agg((F.sum("value") / F.first("n_scored")).alias("value")).withColumn("class", F.lit("macro"))
    grid = w.select(*by, "replicate").distinct().join(scored, by)
    each = grid.join(f1.select(*by, "replicate", "class", "value"), [*by, "replicate", "class"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    cols = [*by, "replicate", "class", "value"]
    return each.select(*cols).unionByName(macro.select(*cols))


def interval(draws: DataFrame, by: list[str], ci: float = 0.95) -> DataFrame:
    """Percentile interval of the draws."""
    lo, hi = (1 - ci) / 2, 1 - (1 - ci) / 2
    return draws.groupBy(*by).agg(F.percentile("value", lo).alias("ci_lo"), F.percentile("value", hi).alias("ci_hi"), F.countDistinct("replicate").alias("n_boot"))


def point_scores(scoped: DataFrame, by: list[str]) -> DataFrame:
    """(by, class, value) of the data themselves."""
    per = class_metrics(class_counts(confusion(scoped, by), by)).where("support > 0")
    macro = macro_metrics(per, by).select(*by, F.lit("macro").alias("class"), F.col("f1_score").alias("value"))
    return per.select(*by, "class", F.col("f1_score").alias("value")).unionByName(macro)


def bootstrap_rows(pred: DataFrame, n_boot: int = 200, seed: int = 42, by: list[str] = (), ci: float = 0.95) -> DataFrame:
    """Point value and interval for every scope and class; one donor, or no replicates, gives no interval."""
    keys = [*by, "scope"]
    scoped = with_scopes(pred)
    value = point_scores(scoped, keys)
    donors = scoped.groupBy(*keys).agg(F.countDistinct("donor").alias("n_donors"))
    out = value.join(donors, keys)
    if n_boot <= 0:
        return out.select("*", F.lit(None).cast("double").alias("ci_lo"), F.lit(None).cast("double").alias("ci_hi"), F.lit(0).cast("long").alias("n_boot"))
    ranges = interval(replicate_scores(scoped, keys, n_boot, seed), [*keys, "class"], ci)
    return out.join(ranges, [*keys, "class"], "left").withColumn("n_boot", F.coalesce("n_boot", F.lit(0)))


def two_sided(deltas: DataFrame, by: list[str], ci: float = 0.95) -> DataFrame:
    """Interval of paired deltas and p = min(1, 2 min(P(d <= 0), P(d >= 0)))."""
    lo, hi = (1 - ci) / 2, 1 - (1 - ci) / 2
    d = F.col("value")
    p = F.least(F.lit(1.0), 2 * F.least(F.avg((d <= 0).cast("double")), F.avg((d >= 0).cast("double"))))
    return deltas.groupBy(*by).agg(F.percentile("value", lo).alias("ci_lo"), F.percentile("value", hi).alias("ci_hi"), p.alias("p_two_sided"))


def delta_rows(both: DataFrame, n_boot: int = 200, seed: int = 42, by: list[str] = ()) -> DataFrame:
    """Paired difference a - b for every scope and class, on the same picks."""
    keys = [*by, "scope"]
    a = with_scopes(both.withColumn("y_pred", F.col("y_pred_a")))
    b = with_scopes(both.withColumn("y_pred", F.col("y_pred_b")))
    point = point_scores(a, keys).withColumnRenamed("value", "va").join(point_scores(b, keys).withColumnRenamed("value", "vb"), [*keys, "class"])
    k = [*keys, "replicate", "class"]
    draws = replicate_scores(a, keys, n_boot, seed).withColumnRenamed("value", "va").join(replicate_scores(b, keys, n_boot, seed).withColumnRenamed("value", "vb"), k)
    ranges = two_sided(draws.withColumn("value", F.col("va") - F.col("vb")), [*keys, "class"])
    return point.select(*keys, "class", (F.col("va") - F.col("vb")).alias("delta")).join(ranges, [*keys, "class"], "left")


def balanced_draws(pred: DataFrame, n_boot: int = 200, seed: int = 42) -> DataFrame:
    """(replicate, value): organs with replacement, donors with replacement within; the mean of the organs' macro F1."""
    organs = donor_index(pred, ["tissue"])
    table = organs.select("tissue", "n_donors").distinct().withColumn("o", F.row_number().over(Window.orderBy("tissue")) - 1).withColumn("n_organs", F.count(F.lit(1)).over(Window.partitionBy()))
    slots = table.where("o = 0 and n_organs >= 2").select("n_organs", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("replicate"))
    slots = slots.select("*", F.explode(F.sequence(F.lit(0), (F.col("n_organs") - 1).cast("int"))).alias("slot"))
    slots = slots.select("replicate", "slot", (digest_number(seed, "organ", "replicate", "slot") % F.col("n_organs")).cast("int").alias("o")).join(table.select("o", "tissue", "n_donors"), "o")
    draws = slots.select("*", F.explode(F.sequence(F.lit(0), (F.col("n_donors") - 1).cast("int"))).alias("draw"))
    draws = draws.withColumn("i", (digest_number(seed, "organ-donor", "replicate", "slot", "draw") % F.col("n_donors")).cast("int"))
    w = draws.groupBy("replicate", "slot", "tissue", "i").agg(F.count(F.lit(1)).alias("w")).join(organs.select("tissue", "i", "donor"), ["tissue", "i"])
    counts = _donor_counts(pred, ["tissue"])
    scored = counts.groupBy("tissue", "class").agg(F.sum("support").alias("_s")).where("_s > 0").drop("_s")
    n = scored.groupBy("tissue").agg(F.count(F.lit(1)).alias("n_scored"))
    sums = counts.join(scored, ["tissue", "class"], "left_semi").join(w, ["tissue", "donor"]).groupBy("replicate", "slot", "tissue", "class").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("tp", "support", "predicted")])
    organ = sums.withColumn("f", ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))).join(n, "tissue").groupBy("replicate", "slot").agg((F.sum("f") / F.first("n_scored")).alias("f"))
    return organ.groupBy("replicate").agg(F.avg("f").alias("value"))


def balanced_row(pred: DataFrame, n_boot: int = 200, seed: int = 42) -> DataFrame:
    """The organ-balanced macro F1, its interval and how many organs it averages."""
    per = macro_metrics(class_metrics(class_counts(confusion(pred, ["tissue"]), ["tissue"])).where("support > 0"), ["tissue"])
    value = per.agg(F.avg("f1_score").alias("value"), F.count(F.lit(1)).alias("n_organs"))
    ranges = balanced_draws(pred, n_boot, seed).agg(F.percentile("value", 0.025).alias("ci_lo"), F.percentile("value", 0.975).alias("ci_hi"), F.count(F.lit(1)).alias("n_boot"))
    return value.join(ranges)


def balanced_rows(pred: DataFrame, by: str, n_boot: int = 200, seed: int = 42) -> DataFrame:
    """balanced_row of every value of `by` (a level or a protocol), with that value."""
    out = None
    for r in sorted(pred.select(by).distinct().collect()):  # a row per level
        own = balanced_row(pred.where(F.col(by) == r[by]), n_boot, seed).withColumn(by, F.lit(r[by]))
        out = own if out is None else out.unionByName(own)
    return out if out is not None else balanced_row(pred, n_boot, seed).withColumn(by, F.lit(None).cast("string")).limit(0)


def pooled_interval(draws: DataFrame, by: list[str], run: str = "seed", with_p: bool = False) -> DataFrame:
    """Interval of the union of several runs' draws, and how many runs there are."""
    lo, hi = F.percentile("value", 0.025).alias("ci_lo_pooled"), F.percentile("value", 0.975).alias("ci_hi_pooled")
    d = F.col("value")
    p = [F.least(F.lit(1.0), 2 * F.least(F.avg((d <= 0).cast("double")), F.avg((d >= 0).cast("double")))).alias("p_two_sided_pooled")] if with_p else []
    return draws.groupBy(*by).agg(lo, hi, F.countDistinct(run).alias("n_seeds_pooled"), *p)


def mean_interval(values: DataFrame, by: list[str], key: str, n_boot: int, seed: int = 42, ci: float = 0.95) -> DataFrame:
    """Bootstrap interval of the mean of `value` in each group: members are drawn by index with replacement."""
    w = Window.partitionBy(*by)
    x = values.withColumn("i", F.row_number().over(w.orderBy(key)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    draws = x.where("i = 0").select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("replicate"))
    draws = draws.select("*", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("draw"))
    draws = draws.withColumn("i", (digest_number(seed, "member", *by, "replicate", "draw") % F.col("n")).cast("int"))
    means = draws.select(*by, "replicate", "i").join(x.select(*by, "i", "value"), [*by, "i"]).groupBy(*by, "replicate").agg(F.avg("value").alias("value"))
    return interval(means, by, ci)
