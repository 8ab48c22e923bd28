"""Scores as aggregates over a table of predictions. Errors are negated, so that more is better."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(predictions: DataFrame, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by, truth, prediction, n)``, only pairs that occur."""
    return predictions.groupBy(*by, F.col(truth).alias("truth"), "prediction").agg(F.count(F.lit(1)).alias("n"))


def normalised(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts with their share of the row of the same truth."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "truth")))


def per_class(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, class, tp, support, predicted, f1)`` for every class that occurs on either side."""
    hit = F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = counts.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("class"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))).alias("s")).select(*by, "s.*")
    summed = sides.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    return summed.withColumn("f1", 2 * F.col("tp") / (F.col("support") + F.col("predicted")))


def classification(predictions: DataFrame, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by, f1_weighted, f1_macro, f1_micro, accuracy, n)``."""
    classes = per_class(confusion(predictions, truth, by), by)
    n = F.sum("support")
    accuracy = F.sum("tp") / n
    return classes.groupBy(*by).agg((F.sum(F.col("support") * F.col("f1")) / n).alias("f1_weighted"), F.avg("f1").alias("f1_macro"), accuracy.alias("f1_micro"), accuracy.alias("accuracy"), n.alias("n"))


def regression(predictions: DataFrame, truth: str | Sequence[str], by: Sequence[str] = (), predicted: str | Sequence[str] = "prediction") -> DataFrame:
    """``(by, r2, neg_mse, neg_rmse, neg_mae, n)``; several targets average evenly, rmse is of the averaged mse."""
    pairs = list(zip([truth] if isinstance(truth, str) else truth, [predicted] if isinstance(predicted, str) else predicted, strict=True))
    mean = lambda parts: sum(parts[1:], parts[0]) / len(parts)
    errors = [F.avg((F.col(t) - F.col(p)) ** 2) for t, p in pairs]
    r2 = mean([1 - F.try_divide(e, F.var_pop(t)) for e, (t, _) in zip(errors, pairs, strict=True)])
    mae = mean([F.avg(F.abs(F.col(t) - F.col(p))) for t, p in pairs])
    return predictions.groupBy(*by).agg(r2.alias("r2"), (-mean(errors)).alias("neg_mse"), (-F.sqrt(mean(errors))).alias("neg_rmse"), (-mae).alias("neg_mae"), F.count(F.lit(1)).alias("n"))


def multilabel(predictions: DataFrame, truth: Sequence[str], predicted: Sequence[str]) -> DataFrame:
    """``(f1_samples, f1_macro, f1_micro, neg_hamming, subset_accuracy)`` of 0/1 columns; 0 / 0 counts 0."""
    pairs = [(F.col(t).cast("int"), F.col(p).cast("int")) for t, p in zip(truth, predicted, strict=True)]
    add = lambda cs: sum(cs[1:], cs[0])
    both, t_n, p_n = add([t * p for t, p in pairs]), add([t for t, _ in pairs]), add([p for _, p in pairs])
    own = F.coalesce(F.try_divide(2.0 * both, t_n + p_n), F.lit(0.0))
    macro = add([F.coalesce(F.try_divide(2.0 * F.sum(t * p), F.sum(t) + F.sum(p)), F.lit(0.0)) for t, p in pairs]) / len(pairs)
    wrong = add([(t != p).cast("int") for t, p in pairs])
    return predictions.agg(F.avg(own).alias("f1_samples"), macro.alias("f1_macro"), F.coalesce(F.try_divide(2.0 * F.sum(both), F.sum(t_n) + F.sum(p_n)), F.lit(0.0)).alias("f1_micro"), (-F.avg(wrong) / len(pairs)).alias("neg_hamming"), F.avg((wrong == 0).cast("double")).alias("subset_accuracy"))


def average_precision(scored: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by, ap)``: precision at each distinct score, weighted by the recall it adds; equal scores go together.

    Scores are counted first, so the window runs over distinct scores, not over samples; round scores that
    are nearly all distinct, or give ``by``, where they are too many for one task.
    """
    tied = scored.groupBy(*by, score).agg(F.sum(F.col(truth).cast("long")).alias("_tp"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    down = w.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    curve = tied.withColumns({"_above": F.sum("_tp").over(down), "_seen": F.sum("_n").over(down), "_all": F.sum("_tp").over(w)})
    return curve.groupBy(*by).agg(F.sum(F.col("_above") / F.col("_seen") * F.try_divide("_tp", "_all")).alias("ap"))


def multilabel_average_precision(scored: DataFrame, sample: str, truth: Sequence[str], score: Sequence[str]) -> DataFrame:
    """``(ap_macro, ap_micro, ap_samples)``: the mean over labels, of all pairs pooled, the mean over samples.

    Labels or samples without a positive count 0.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("label"), F.col(t).cast("int").alias("y"), F.col(s).cast("double").alias("s")) for i, (t, s) in enumerate(zip(truth, score, strict=True))])).alias("p")
    each = scored.select(F.col(sample).alias("_sample"), pairs).select("_sample", "p.*")
    mean = lambda by: average_precision(each, "y", "s", [by]).agg(F.avg(F.coalesce("ap", F.lit(0.0))).alias("m"))
    return mean("label").select(F.col("m").alias("ap_macro")).join(average_precision(each, "y", "s").select(F.col("ap").alias("ap_micro"))).join(mean("_sample").select(F.col("m").alias("ap_samples")))


def combined_confusion(counts: DataFrame, by: str) -> DataFrame:
    """``(truth, prediction, mean, sem)`` of row-normalised matrices over ``by`` (folds, seeds); absent cells are 0."""
    shares = normalised(counts, [by])
    n = F.lit(counts.select(by).distinct().count())
    mean = F.sum("share") / n
    return shares.groupBy("truth", "prediction").agg(mean.alias("mean"), (F.sqrt(F.greatest(F.sum(F.col("share") ** 2) / n - mean**2, F.lit(0.0))) / F.sqrt(n)).alias("sem"))


#: Name of a score to the table that holds it and its column there.
_CLASSIFICATION = {"f1": "f1_weighted", "f1_weighted": "f1_weighted", "f1_macro": "f1_macro", "f1_micro": "f1_micro", "accuracy": "accuracy"}
_REGRESSION = {"r2": "r2", "r2_score": "r2", "mse": "neg_mse", "neg_mean_squared_error": "neg_mse", "rmse": "neg_rmse", "neg_root_mean_squared_error": "neg_rmse", "mae": "neg_mae", "neg_mean_absolute_error": "neg_mae"}


_MULTILABEL = {"f1_samples": "f1_samples", "hamming_loss": "neg_hamming", "subset_accuracy": "subset_accuracy"}


#: Scores of probabilities.
_PRECISION = ("ap_macro", "ap_micro", "ap_samples")


def _precision(predictions: DataFrame, truth: str | Sequence[str]) -> DataFrame:
    """Of several 0/1 targets with ``probability__<target>`` (its last entry is that of 1), or of one target whose
    ``probability`` stands in the order of its ascending labels, each against the rest. Samples are rows."""
    rows = predictions.withColumn("_sample", F.monotonically_increasing_id())
    if not isinstance(truth, str):
        names = list(truth)
        pairs = [(F.col(t).cast("int"), F.element_at(f"probability__{t}", -1)) for t in names]
    else:
        labels = [r[0] for r in rows.select(truth).where(F.col(truth).isNotNull()).distinct().orderBy(truth).collect()]
        pairs = [((F.col(truth) == F.lit(x)).cast("int"), F.get("probability", i)) for i, x in enumerate(labels)]
    columns = [c for i, (t, p) in enumerate(pairs) for c in (t.alias(f"t{i}"), p.alias(f"p{i}"))]
    n = range(len(pairs))
    return multilabel_average_precision(rows.select("_sample", *columns), "_sample", [f"t{i}" for i in n], [f"p{i}" for i in n])


def score_table(name: str, predictions: DataFrame, truth: str | Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by, score)``. Several targets are read from ``prediction__<target>``."""
    if name in _PRECISION:
        if by:
            raise ValueError("average precision has no groups; filter first")
        return _precision(predictions, truth).select(F.col(name).alias("score"))
    if not isinstance(truth, str) and name in {*_MULTILABEL, "f1_macro", "f1_micro"}:
        if by:
            raise ValueError("multilabel scores have no groups; filter first")
        return multilabel(predictions, truth, [f"prediction__{t}" for t in truth]).select(F.col(_MULTILABEL.get(name, name)).alias("score"))
    if name in _CLASSIFICATION:
        return classification(predictions, truth, by).select(*by, F.col(_CLASSIFICATION[name]).alias("score"))
    if name in _REGRESSION:
        predicted = "prediction" if isinstance(truth, str) else [f"prediction__{t}" for t in truth]
        return regression(predictions, truth, by, predicted).select(*by, F.col(_REGRESSION[name]).alias("score"))
    raise ValueError(f"unknown score {name!r}")


def scorer(name: str | Callable) -> Callable[[DataFrame, str], float]:
    if callable(name):
        return name

    def score(predictions: DataFrame, truth: str | Sequence[str]) -> float:
        row = score_table(name, predictions, truth).first()
        return float("nan") if row is None or row["score"] is None else float(row["score"])

    return score


def sem(values: str | Column, ddof: int = 0) -> Column:
    """The standard error of the mean."""
    return (F.stddev_pop(values) if ddof == 0 else F.stddev_samp(values)) / F.sqrt(F.count(values))
