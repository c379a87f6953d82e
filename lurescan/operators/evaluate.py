"""Evaluation of scores. Input: a table with ``y`` (0/1) and ``p``.

Cumulative sums never sort everything in one task: rows are first counted per distinct score, then
summed inside ranges of bounded length, with the range totals added as offsets (``ranked``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import add
from .ranked import ROWS_PER_RANGE, running

GRID = 10_000


def metrics_at(scores: DataFrame, t: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates of the verdict ``p >= t`` (E1), one row per group."""
    counts = scores.groupBy(*by).agg(
        F.expr(f"count_if(p >= {t!r}D AND y = 1)").alias("tp"),
        F.expr(f"count_if(p >= {t!r}D AND y = 0)").alias("fp"),
        F.expr(f"count_if(p < {t!r}D AND y = 1)").alias("fn"),
        F.expr(f"count_if(p < {t!r}D AND y = 0)").alias("tn"),
    )
    raw = add(counts, {"_pr": "tp / greatest(tp + fp, 1)", "_re": "tp / greatest(tp + fn, 1)"})
    return raw.selectExpr(
        *by, "tp", "fp", "fn", "tn",
        "round((tp + tn) / greatest(tp + fp + fn + tn, 1), 4) AS accuracy",
        "round(_pr, 4) AS precision",
        "round(_re, 4) AS recall",
        "round(2 * _pr * _re / greatest(_pr + _re, 1e-9D), 4) AS f1",
        "round(fp / greatest(fp + tn, 1), 4) AS false_positive_rate",
    )


def confusion(scores: DataFrame, t: float = 0.5) -> DataFrame:
    """Four cells, empty ones included."""
    m = metrics_at(scores, t)
    return m.selectExpr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (y, predicted, n)")


def cumulative(scores: DataFrame, by: tuple[str, ...] = (), rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Per group and distinct score: ``pos``, ``neg`` at it and ``cum_pos``, ``cum_neg`` at or above it."""
    per_score = scores.where("p IS NOT NULL").groupBy(*by, "p").agg(
        F.expr("count_if(y = 1)").alias("pos"), F.expr("count_if(y = 0)").alias("neg")
    )
    return running(per_score, "p DESC", {"cum_pos": "pos", "cum_neg": "neg"}, by, rows_per_range)


def roc_auc(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve with ties counted half (E2), one row per group; null for a group of one class."""
    area = cumulative(scores, by).groupBy(*by).agg(
        F.expr("sum(CAST(neg AS DOUBLE) * (cum_pos - pos + pos / 2))").alias("_area"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )
    return area.selectExpr(*by, "positives", "negatives", "round(try_divide(_area, CAST(positives AS DOUBLE) * negatives), 6) AS roc_auc")


def _with_totals(scores: DataFrame) -> DataFrame:
    totals = scores.where("p IS NOT NULL").agg(F.expr("count_if(y = 1)").alias("_P"), F.expr("count_if(y = 0)").alias("_N"))
    one = add(cumulative(scores), {"_one": "1"})
    return one.join(F.broadcast(add(totals, {"_one": "1"})), "_one")  # a single row of totals


def roc_curve(scores: DataFrame) -> DataFrame:
    """One point per distinct score."""
    return _with_totals(scores).selectExpr("p AS threshold", "cum_neg / greatest(_N, 1) AS fpr", "cum_pos / greatest(_P, 1) AS tpr")


def pr_curve(scores: DataFrame) -> DataFrame:
    """One point per distinct score."""
    return _with_totals(scores).selectExpr(
        "p AS threshold", "cum_pos / (cum_pos + cum_neg) AS precision", "cum_pos / greatest(_P, 1) AS recall"
    )


def threshold_for_fpr(scores: DataFrame, target: float = 0.02) -> DataFrame:
    """Smallest threshold of 0.5 or more, on a 1e-4 grid, that at most ``target`` of the benign scores
    reach (E3). Missing scores count nowhere. One shuffle of at most 10,001 groups."""
    low = f"CAST(floor(p * {GRID}) AS INT)"
    # floor of the product may fall one cell short of a grid value
    cell = f"least(greatest(IF(p >= ({low} + 1) / {GRID}D, {low} + 1, {low}), 0), {GRID})"
    counts = scores.where("y = 0 AND p IS NOT NULL").groupBy(F.expr(cell).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.selectExpr("sum(n) AS total", "1 AS one")
    cells = counts.sparkSession.range(GRID // 2, GRID + 1).selectExpr("CAST(id AS INT) AS cell", "1 AS one")
    reach = cells.join(counts, "cell", "left").selectExpr(
        "cell", "one", "sum(coalesce(n, 0)) OVER (ORDER BY cell DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached"
    )
    fits = reach.join(F.broadcast(total), "one").agg(
        F.expr(f"min(IF(reached <= floor({target!r}D * total), cell, NULL))").alias("_cell"), F.max("total").alias("benign")
    )
    return fits.selectExpr("coalesce(benign, 0) AS benign", f"IF(benign IS NULL, 0.5D, coalesce(_cell / {GRID}D, 1D)) AS threshold")


def share_at(scores: DataFrame, thresholds, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Share of scores at or above each threshold per group (A16), in one pass."""
    thresholds = list(thresholds)
    sums = scores.groupBy(*by).agg(
        F.count("p").alias("n"), *[F.expr(f"count_if(p >= {t!r}D)").alias(f"_{i}") for i, t in enumerate(thresholds)]
    )
    rows = ", ".join(f"{t!r}D, _{i}" for i, t in enumerate(thresholds))
    return sums.selectExpr(*by, "n", f"stack({len(thresholds)}, {rows}) AS (threshold, reached)").selectExpr(
        *by, "threshold", "n", "reached", "round(reached / greatest(n, 1), 4) AS share"
    )


def sweep(scores: DataFrame, thresholds) -> DataFrame:
    """Recall and false-positive rate per threshold (E5), in one pass."""
    thresholds = list(thresholds)
    sums = scores.agg(
        F.expr("count_if(y = 1)").alias("_P"),
        F.expr("count_if(y = 0)").alias("_N"),
        *[F.expr(f"count_if(p >= {t!r}D AND y = {y})").alias(f"_{y}_{i}") for i, t in enumerate(thresholds) for y in (0, 1)],
    )
    rows = ", ".join(f"{t!r}D, _1_{i}, _0_{i}" for i, t in enumerate(thresholds))
    return sums.selectExpr("_P", "_N", f"stack({len(thresholds)}, {rows}) AS (threshold, tp, fp)").selectExpr(
        "threshold", "round(tp / greatest(_P, 1), 4) AS recall", "round(fp / greatest(_N, 1), 4) AS false_positive_rate"
    )


def compare_thresholds(scores: DataFrame, t: float) -> DataFrame:
    """Metrics at 0.5 and at ``t`` side by side, one row per metric (E9); the area is the same at both."""
    names = ("accuracy", "precision", "recall", "f1", "false_positive_rate")
    long = lambda at, col: metrics_at(scores, at).selectExpr(
        f"stack({len(names)}, {', '.join(f"'{n}', {n}" for n in names)}) AS (metric, {col})"
    )
    area = roc_auc(scores).selectExpr("'roc_auc' AS metric", "roc_auc AS at_half", "roc_auc AS at_threshold")
    return area.unionByName(long(0.5, "at_half").join(long(t, "at_threshold"), "metric"))


def top_mistakes(scores: DataFrame, k: int = 8) -> DataFrame:
    """The most confident mistakes of each kind (W3): benign rows with high scores, phishing with low."""
    cols = ["y", "url_id", "url", "p"]
    benign = scores.where("y = 0").orderBy(F.desc("p"), "url_id").limit(k)
    missed = scores.where("y = 1").orderBy("p", "url_id").limit(k)
    return benign.select(*cols).unionByName(missed.select(*cols))


def top_scored(scores: DataFrame, k: int = 10) -> DataFrame:
    """Highest scores of a source."""
    return scores.orderBy(F.desc("p"), "url_id").limit(k)
