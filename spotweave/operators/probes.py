"""Label-transfer probes: who trains on whom, train-only standardisation, prediction, metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.functions.keys import digest, ratio
from spotweave.functions.labels import is_labelled
from spotweave.functions.lineage import cut
from spotweave.functions.vectors import standardised
from spotweave.operators.knn import nearest, vote
from spotweave.operators.neighbour_index import leave_one_out_neighbours
from spotweave.operators.ranking import rank_within as rank_rows_within
from spotweave.operators.results import refuse

TINY = 1e-8


def moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, pos, n, s, q): additive moments of every dimension of z, summed in batches before anything is shuffled."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def run(batches):
        for batch in batches:
            z = batch.column("z")
            some = batch.filter(z.is_valid())
            z, sizes = some.column("z"), np.diff(some.column("z").offsets.to_numpy())
            if not sizes.sum():
                continue
            keys = [some.column(c).dictionary_encode() for c in by]
            group = np.zeros(len(sizes), np.int64)
            for k in keys:
                codes = k.indices.fill_null(len(k.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
                group = group * (len(k.dictionary) + 1) + codes
            _, first, group = np.unique(group, return_index=True, return_inverse=True)
            wide = int(sizes.max())
            flat = z.flatten()
            v = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            good = flat.is_valid().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.repeat(group * wide, sizes) + np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n, s, q = (np.bincount(at, w, len(first) * wide) for w in (good, v, v * v))
            real = np.flatnonzero(n)
            own = pa.array(first[real // wide])
            columns = [some.column(c).take(own) for c in by]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((real % wide).astype(np.int32)), pa.array(n[real].astype(np.int64)), pa.array(s[real]), pa.array(q[real])], names=[*by, "pos", "n", "s", "q"])

    found = rows.select(*by, F.col("z").cast("array<double>").alias("z")).mapInArrow(run, f"{kinds}, pos int, n long, s double, q double")
    return found.groupBy(*by, "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def scaling(m: DataFrame, by: list[str]) -> DataFrame:
    """Moments to (by, mean, sd) arrays; population deviation, below 1e-8 it is 1."""
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    x = m.where("n > 0").select(*by, "pos", mean.alias("m"), F.when(sd < TINY, 1.0).otherwise(sd).alias("d"))
    x = x.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "m", "d"))).alias("a"))
    return x.select(*by, F.col("a.m").alias("mean"), F.col("a.d").alias("sd"))


def fold_members(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Annotated rows with the fold and role they have by slide."""
    return rows.where(is_labelled("annotation")).join(folds.select("level", "fold", "role", "sample_id"), "sample_id")


def group_members(rows: DataFrame, group: str) -> DataFrame:
    """Leave-one-group-out inside a tissue: each group of a tissue with two or more is a fold, the others train."""
    x = rows.where(is_labelled("annotation"))
    groups = x.select("tissue", F.col(group).alias("held")).distinct()
    many = groups.groupBy("tissue").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    groups = groups.join(many, "tissue", "left_semi").withColumn("fold", F.concat_ws("|", "tissue", "held"))
    out = x.join(groups, "tissue")
    return out.withColumn("role", F.when(F.col(group) == F.col("held"), "eval").otherwise("train")).withColumn("level", F.lit(group)).drop("held")


def capped_train(train: DataFrame, fold: str, cap: int, seed: int = 42) -> DataFrame:
    """At most `cap` training rows of every fold, its classes in proportion: floor shares, then the largest remainders, rows by digest."""
    n = train.groupBy(fold, "annotation").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(fold)  # a row per class
    exact = F.col("_n") * F.lit(cap) / F.col("_all")
    x = n.withColumn("_all", F.sum("_n").over(own)).withColumn("_share", F.floor(exact)).withColumn("_rest", exact - F.floor(exact))
    x = x.withColumn("_short", F.lit(cap) - F.sum("_share").over(own)).withColumn("_r", F.row_number().over(own.orderBy(F.desc("_rest"), digest(seed, "remainder", "annotation"))))
    quota = F.when(F.col("_all") <= cap, F.col("_n")).otherwise(F.col("_share") + (F.col("_r") <= F.col("_short")).cast("long"))
    quotas = x.select(fold, "annotation", quota.alias("_quota"))
    ranked = rank_rows_within(train, [fold, "annotation"], [digest(seed, "stratified", "key"), "key"], "_place").drop("_n")
    return ranked.join(quotas, [fold, "annotation"]).where("_place <= _quota").drop("_place", "_quota")


def predict(members: DataFrame, k: int = 5, majority: bool = False, cap: int | None = None) -> DataFrame:
    """Predictions of every evaluated row of every fold in one plan.

    members: level, fold, role, key, z, annotation, tissue, donor, sample_id. The scaling is of
    the fold's training rows. A fold without a side predicts nothing. `cap` bounds the training rows of a fold, its classes in
    proportion; the majority is taken of all. Returns level, fold, key,
    tissue, donor, sample_id, y_true, y_pred, n_train.
    """
    members = members.withColumn("_f", F.concat_ws("\u0001", "level", "fold"))
    train, test = members.where("role = 'train'"), members.where("role = 'eval'")
    if cap is not None and not majority:
        train = cut(capped_train(train, "_f", cap))
    sizes = train.groupBy("_f").agg(F.count(F.lit(1)).alias("n_train"))
    if majority:
        n = train.groupBy("_f", "annotation").count()
        guess = n.groupBy("_f").agg(F.min_by("annotation", F.struct(-F.col("count"), F.col("annotation"))).alias("y_pred"))
        out = test.join(guess, "_f")
    else:
        scale = scaling(moments(train, ["_f"]), ["_f"])
        x = standardised(F.col("z"), F.col("mean"), F.col("sd"))
        a = test.join(scale, "_f").select("_f", "key", x.alias("x"))
        b = train.join(scale, "_f").select("_f", "key", F.col("annotation").alias("label"), x.alias("x"))
        guess = vote(nearest(a, b, k, fold="_f"), fold="_f")
        out = test.join(guess, ["_f", "key"])
    return out.join(sizes, "_f").select("level", "fold", "key", "tissue", "donor", "sample_id", F.col("annotation").alias("y_true"), "y_pred", "n_train")


def with_scopes(pred: DataFrame) -> DataFrame:
    """Every row once for the global scope, with the organ in its labels, and once for its tissue."""
    x = pred.withColumn("scope", F.explode(F.array(F.lit("global"), F.col("tissue"))))
    name = lambda c: F.when(F.col("scope") == "global", F.concat_ws(" | ", "tissue", c)).otherwise(F.col(c))
    return x.withColumn("y_true", name("y_true")).withColumn("y_pred", name("y_pred"))


def confusion(scoped: DataFrame, by: list[str]) -> DataFrame:
    """(by, y_true, y_pred, n)."""
    return scoped.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def class_counts(cells: DataFrame, by: list[str], weight: str = "n") -> DataFrame:
    """Confusion cells to (by, class, tp, support, predicted)."""
    w = F.col(weight)
    x = cells.select(*by, F.explode(F.array(F.struct(F.col("y_true").alias("class"), w.alias("support"), (w * 0).alias("predicted")), F.struct(F.col("y_pred").alias("class"), (w * 0).alias("support"), w.alias("predicted")))).alias("e"), F.when(F.col("y_true") == F.col("y_pred"), w).otherwise(w * 0).alias("hit"))
    return x.groupBy(*by, "e.class").agg((F.sum("hit") / 2).cast("double").alias("tp"), F.sum("e.support").cast("double").alias("support"), F.sum("e.predicted").cast("double").alias("predicted"))


def class_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every class; 0 where a denominator is 0."""
    tp, s, p = F.col("tp"), F.col("support"), F.col("predicted")
    return counts.withColumn("precision", ratio(tp, p)).withColumn("recall", ratio(tp, s)).withColumn("f1_score", ratio(2 * tp, s + p))


def macro_metrics(per_class: DataFrame, by: list[str]) -> DataFrame:
    """Macro averages over the classes that occur in the truth, and accuracy."""
    real = F.col("support") > 0
    mean = lambda c: F.avg(F.when(real, F.col(c))).alias(c)
    return per_class.groupBy(*by).agg(F.count_if(real).alias("n_classes_scored"), ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), mean("precision"), mean("recall"), mean("f1_score"), F.sum("support").cast("long").alias("n_test"))


def metric_rows(pred: DataFrame, by: list[str] = ()) -> DataFrame:
    """Macro metrics per scope with the donors and slides behind them. The predictions are written once."""
    scoped = with_scopes(cut(pred))
    keys = [*by, "scope"]
    macro = macro_metrics(class_metrics(class_counts(confusion(scoped, keys), keys)), keys)
    return macro.join(scoped.groupBy(*keys).agg(F.countDistinct("donor").alias("n_donors"), F.countDistinct("sample_id").alias("n_slides")), keys)


def per_class_rows(pred: DataFrame, by: list[str] = ()) -> DataFrame:
    """Metrics of every class that occurs in the truth, per scope."""
    keys = [*by, "scope"]
    return class_metrics(class_counts(confusion(with_scopes(pred), keys), keys)).where("support > 0").select(*keys, "class", "precision", "recall", "f1_score", F.col("support").cast("long").alias("support"))


def fold_metrics(pred: DataFrame) -> DataFrame:
    """Each fold scored on the classes that are known in its own tissues' pooled truth."""
    scoped = pred.withColumn("scope", F.col("tissue"))
    known = scoped.select("level", "tissue", F.col("y_true").alias("class")).distinct()
    keys = ["level", "fold", "tissue"]
    counts = class_counts(confusion(scoped, keys), keys)
    present = counts.join(known, ["level", "tissue", "class"], "left_semi").where("support > 0")
    return macro_metrics(class_metrics(present), keys)


def pooled(pred: DataFrame) -> DataFrame:
    """Folds of a level taken together; n_train is the whole part of their mean."""
    pred = cut(pred)
    n = pred.select("level", "fold", "n_train").distinct().groupBy("level").agg(F.floor(F.avg("n_train")).alias("n_train"), F.count(F.lit(1)).alias("n_folds"))
    return metric_rows(pred, ["level"]).join(n, "level")


def vocabulary(pred: DataFrame) -> DataFrame:
    """Score vocabulary per scope, from the truth alone."""
    return with_scopes(pred).groupBy("scope").agg(F.array_join(F.array_sort(F.collect_set("y_true")), ",").alias("classes"))


def paired(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Two predictions on identical rows, y_pred_a and y_pred_b; any row without its partner is an error."""
    x = a.withColumnRenamed("y_pred", "y_pred_a")
    y = b.select(*key, F.col("y_pred").alias("y_pred_b"))
    if not x.join(y, key, "left_anti").isEmpty() or not y.join(x, key, "left_anti").isEmpty():
        raise ValueError("the two predictions are not of the same rows")
    return x.join(y, key)


def reference_model(model: str, corrections: tuple = ("harmony", "combat", "bbknn"), models: tuple = ()) -> str:
    """The model that another is compared with: a corrected arm with its own corrected pca if that is in the run, else pca."""
    head, _, _ = model.partition("_")
    own = f"{head}_pca"
    return own if head in corrections and own in models and model != own else "pca"


def leave_one_out(rows: DataFrame, group: str, k: int = 5, majority: bool = False, cap: int | None = None) -> DataFrame:
    """loso_donor and pooled_loso: leave one group out within each tissue.

    Neighbours come from one index per tissue that serves all its folds, so no row is copied for a fold; a majority, and training
    rows that a cap bounds for each fold, go by the folds' own rows.
    """
    if majority or cap is not None:
        return predict(group_members(cut(rows), group), k, majority, cap)
    own = cut(rows.where(is_labelled("annotation")).withColumn("_unit", F.col(group).cast("string")))
    found, folds = leave_one_out_neighbours(own.select("key", F.col("tissue").alias("domain"), F.col("_unit").alias("unit"), F.col("annotation").alias("label"), "z"), k)
    guess = vote(found, fold="domain").select(F.col("domain").alias("tissue"), "key", "y_pred")
    sizes = folds.select(F.col("domain").alias("tissue"), F.col("unit").alias("_unit"), "n_train")
    out = own.join(guess, ["tissue", "key"]).join(F.broadcast(sizes), ["tissue", "_unit"])  # a row per fold
    return out.select(F.lit(group).alias("level"), F.concat_ws("|", "tissue", "_unit").alias("fold"), "key", "tissue", "donor", "sample_id", F.col("annotation").alias("y_true"), "y_pred", "n_train")


def on_folds(rows: DataFrame, folds: DataFrame, k: int = 5, majority: bool = False, cap: int | None = None) -> DataFrame:
    """heldout_donor: train on a fold's train slides, test on its eval slides."""
    return predict(fold_members(cut(rows), cut(folds)), k, majority, cap)


def leave_one_out_on_fold(rows: DataFrame, folds: DataFrame, level: str, fold: str, k: int = 5) -> DataFrame:
    """pooled_loso over the slides of one fold, both roles."""
    some = folds.where((F.col("level") == level) & (F.col("fold") == fold)).select("sample_id").distinct()
    return leave_one_out(rows.join(some, "sample_id", "left_semi"), "sample_id", k)


PROTOCOLS = {"loso_donor": lambda rows, folds, **o: leave_one_out(rows, "donor", **o), "pooled_loso": lambda rows, folds, **o: leave_one_out(rows, "sample_id", **o), "heldout_donor": on_folds, "pooled_loso_on_fold": leave_one_out_on_fold}
#: Those that read folds; the last one reads a single fold, named by level and fold.
FOLD_PROTOCOLS = ("heldout_donor", "pooled_loso_on_fold")


def dispatch(protocol: str, rows: DataFrame, folds: DataFrame | None = None, **options) -> DataFrame:
    """Predictions of a protocol by its name; one that reads folds is refused without them."""
    if protocol not in PROTOCOLS:
        refuse(f"the protocol {protocol}", "there is none of this name", f"any of {sorted(PROTOCOLS)}")
    if protocol in FOLD_PROTOCOLS and folds is None:
        refuse(f"the protocol {protocol}", "it needs folds")
    return PROTOCOLS[protocol](rows, folds, **options)


def run_protocols(rows: DataFrame, folds: DataFrame, protocols=("loso_donor", "pooled_loso", "heldout_donor"), **options) -> DataFrame:
    """All protocols in one frame; one that scores nothing is an error."""
    out = None
    for name in protocols:
        pred = dispatch(name, rows, folds, **options).withColumn("protocol", F.lit(name))
        out = pred if out is None else out.unionByName(pred)
    done = {r["protocol"] for r in out.select("protocol").distinct().collect()}
    if done != set(protocols):
        raise ValueError(f"nothing was scored by {sorted(set(protocols) - done)}")
    return out


def standard_rows(spots: DataFrame, vector: str, key: str = "spot_key") -> DataFrame:
    """The columns that probes read, with the vector as z."""
    return spots.select(F.col(key).alias("key"), F.col(vector).alias("z"), "annotation", "tissue", "donor", "sample_id", "region", "replicate")


def rank_within(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
