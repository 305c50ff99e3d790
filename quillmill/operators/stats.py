"""Classification metrics, ranks, intervals by resampling, corrections for many tests.

Draws come from a counter hash of (seed, replicate, position), so any engine gives the same ones. What is resampled is
first summed to its clusters; a replicate's sums are products of how often it draws each place and the places' values
(`resample`): neither rows of the data nor draws are rows of a replicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import hash_draw
from quillmill.operators.ordered import at_places, placed, running, within
from quillmill.operators.resample import drawn_sums
from quillmill.sources.scratch import stored

#: Draws that one row of a replicate stands for, before they are made.
DRAWS = 1 << 16


def point_metrics(df: DataFrame, by: list[str], truth: str = "label", decision: str = "decision", delta: str = "delta") -> DataFrame:
    """Per group: counts, accuracy, precision, recall, macro F1 (0/0 is 0), net delta a pair."""
    a, t = F.col(decision) == "Accept", F.col(truth) == "Accept"
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(a & t).alias("tp"), F.count_if(a & ~t).alias("fp"), F.count_if(~a & t).alias("fn"), F.count_if(~a & ~t).alias("tn"), F.sum(F.when(a, F.col(delta)).otherwise(0.0)).alias("gain"))
    return out.withColumns(rates()).drop("gain")


def rates() -> dict[str, Column]:
    c = F.col
    safe = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    f1 = lambda x: safe(2 * x, 2 * x + c("fp") + c("fn"))
    return {"accuracy": safe(c("tp") + c("tn"), c("n")), "accept_precision": safe(c("tp"), c("tp") + c("fp")), "accept_recall": safe(c("tp"), c("tp") + c("fn")), "macro_f1": (f1(c("tp")) + f1(c("tn"))) / 2, "net_delta": safe(c("gain"), c("n"))}


def probability_metrics(df: DataFrame, by: list[str], p: str = "p", truth: str = "y") -> DataFrame:
    """Per group: coverage at 0.5, negative log likelihood, Brier score, precision (null without accepted)."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    hit = F.col(p) > 0.5
    return df.groupBy(*by).agg(F.avg(hit.cast("double")).alias("coverage"), F.avg(-F.log(F.when(F.col(truth) == 1, q).otherwise(1 - q))).alias("nll"), F.avg(F.pow(F.col(p) - F.col(truth), 2)).alias("brier"), F.try_divide(F.count_if(hit & (F.col(truth) == 1)), F.count_if(hit)).alias("precision"))


def average_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Adds the rank of a value, ties sharing their mean rank: ranks of distinct values from running counts, joined back."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    ranks = within(n, by, [F.col(value)], {"__upto": F.col("__n")}).select(*by, value, (F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(ranks, [*by, value])


def auc(df: DataFrame, by: list[str], score: str, truth: str) -> DataFrame:
    """Per group: area under the curve by ranks, ties half; null with one class only. Only counts by distinct score are sorted."""
    n = df.groupBy(*by, score).agg(F.sum(truth).alias("pos"), F.sum(1 - F.col(truth)).alias("neg"))
    return _area(within(n, by, [F.col(score)], {"upto": F.col("neg")}).withColumn("below", F.col("upto") - F.col("neg")), by)


def auc_of_counts(n: DataFrame, by: list[str], score: str) -> DataFrame:
    """The area under the curve of a table (by..., score, pos, neg) of many groups, such as replicates."""
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    return _area(n.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0))), by)


def _area(s: DataFrame, by: list[str]) -> DataFrame:
    return s.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Per group: correlation of average ranks; null if either is constant."""
    r = average_ranks(average_ranks(df, by, x, "__rx"), by, y, "__ry")
    return r.groupBy(*by).agg(F.when((F.min("__rx") < F.max("__rx")) & (F.min("__ry") < F.max("__ry")), F.corr("__rx", "__ry")).alias("spearman"))


def calibration_error(df: DataFrame, by: list[str], confidence: str, correct: str, bins: int = 15) -> DataFrame:
    """Per group: mean gap of confidence and accuracy over equal bins, weighted by rows."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    each = df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(confidence).alias("c"), F.sum(correct).alias("k"))
    return each.groupBy(*by).agg((F.sum(F.abs(F.col("c") - F.col("k"))) / F.sum("n")).alias("ece"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def numbered(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds place (from 0) in order within by, and n, the number of places."""
    w = Window.partitionBy(*by)
    return df.withColumn("place", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))


def replicates(groups: DataFrame, by: list[str], b: int, seed: int) -> DataFrame:
    """by..., replicate, place: n draws a replicate for each group of a table (by..., n).

    Blocks of draws are dealt over all tasks before the draws are made: a group's draws are the work of many.
    """
    each = groups.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("replicate"))
    blocks = each.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1, F.lit(DRAWS).cast("long")))).repartition(*by, "replicate", "first")
    draws = blocks.withColumn("i", F.explode(F.sequence("first", F.least(F.col("first") + DRAWS, F.col("n").cast("long")) - 1)))
    return draws.select(*by, "replicate", hash_draw(F.col("n"), F.lit(seed), F.col("replicate"), F.col("i")).alias("place"))


def resampled_sums(clusters: DataFrame, by: list[str], sums: list[str], order: str, b: int, seed: int, shared: list[str] | None = None) -> DataFrame:
    """by..., replicate and the sums over each replicate's clusters.

    shared: the groups among by whose members see the same draws (all models of a study, say); draws are made for these.
    """
    shared = by if shared is None else shared
    kept = stored(clusters.select(*by, order, *sums), "clusters")
    sizes = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy(*shared).agg(F.max("n").alias("n"))
    places = placed(kept, [F.col(order)], "place", by)
    return drawn_sums(places.join(most, shared) if shared else places.crossJoin(F.broadcast(most)), by, sums, b, seed)


def paired_bootstrap(pairs: DataFrame, by: list[str], a: str, b: str, order: str, n_resamples: int = 2000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Per group: n, means, difference, percentile interval and two-sided p of mean(a - b). No pairs give no row."""
    d = stored(pairs.select(*by, order, a, b).withColumn("__d", F.col(a) - F.col(b)), "pairs")
    point = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg("__d").alias("diff"))
    means = resampled_sums(d.select(*by, order, "__d"), by, ["__d"], order, n_resamples, seed).join(point.select(*by, "n", "diff"), by).withColumn("m", F.col("__d") / F.col("n"))
    low, high = max(0, int(alpha / 2 * n_resamples) - 1), min(n_resamples - 1, int((1 - alpha / 2) * n_resamples))
    s = F.array_sort(F.collect_list("m"))  # n_resamples values, whatever the data's size
    opposite = F.count_if(F.when(F.col("diff") >= 0, F.col("m") <= 0).otherwise(F.col("m") >= 0))
    ci = means.groupBy(*by).agg(F.get(s, F.lit(low)).alias("ci_low"), F.get(s, F.lit(high)).alias("ci_high"), F.least(F.lit(1.0), 2 * opposite / n_resamples).alias("p"))
    return point.join(ci, by)


def clustered_intervals(rows: DataFrame, model: str, cluster: str, n_resamples: int, seed: int) -> DataFrame:
    """model, accuracy interval over resampled clusters, the same draws for all models; rows(model, cluster, correct)."""
    sums = rows.groupBy(model, cluster).agg(F.sum("correct").alias("correct"), F.count(F.lit(1)).alias("rows"))
    acc = resampled_sums(sums, [model], ["correct", "rows"], cluster, n_resamples, seed, shared=[])
    q = acc.withColumn("x", F.col("correct") / F.col("rows")).groupBy(model).agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return q.select(model, F.get("q", F.lit(0)).alias("ci_low"), F.get("q", F.lit(1)).alias("ci_high"))


def clustered_auc(rows: DataFrame, model: str, cluster: str, score: str, truth: str, n_resamples: int = 2000, seed: int = 0) -> DataFrame:
    """model, interval of the area under the curve over resampled clusters, valid: the replicates with both classes, which alone count.

    All models see the same draws from the clusters of all rows. What is resampled are counts by cluster and score.
    """
    counts = stored(rows.groupBy(model, cluster, score).agg(F.sum(truth).alias("pos"), F.sum(1 - F.col(truth)).alias("neg")), "counts")
    places = placed(counts.select(cluster).distinct(), [F.col(cluster)], "place")
    sized = counts.join(places, cluster).crossJoin(F.broadcast(places.agg(F.count(F.lit(1)).alias("n"))))
    each = drawn_sums(sized, [model, score], ["pos", "neg"], n_resamples, seed)
    found = auc_of_counts(each, [model, "replicate"], score).groupBy(model).agg(F.percentile("auc", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("auc").alias("valid"))
    return found.select(model, F.get("q", F.lit(0)).alias("ci_low"), F.get("q", F.lit(1)).alias("ci_high"), "valid")


def clustered_f1(rows: DataFrame, model: str, cluster: str, truth: str, predicted: str, n_resamples: int = 2000, seed: int = 0) -> DataFrame:
    """model, interval of F1 over resampled clusters, valid: the replicates that have any positive, which alone count.

    Rows whose prediction is null are unresolved and left out of each replicate. All models see the same draws.
    """
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    sums = rows.where(F.col(predicted).isNotNull()).groupBy(model, cluster).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    each = resampled_sums(sums, [model], ["tp", "fp", "fn"], cluster, n_resamples, seed, shared=[])
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    found = each.withColumn("f1", f1).groupBy(model).agg(F.percentile("f1", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("f1").alias("valid"))
    return found.select(model, F.get("q", F.lit(0)).alias("ci_low"), F.get("q", F.lit(1)).alias("ci_high"), "valid")


def clustered_statistic(sums: DataFrame, by: list[str], cluster: str, names: list[str], statistic: Column, n_resamples: int = 2000, seed: int = 0) -> DataFrame:
    """by..., interval of a statistic of sums over resampled clusters; sums has a row (by, cluster, names...) for each cluster."""
    each = resampled_sums(sums, by, names, cluster, n_resamples, seed).withColumn("x", statistic)
    return each.groupBy(*by).agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(*by, F.get("q", F.lit(0)).alias("ci_low"), F.get("q", F.lit(1)).alias("ci_high"))


def paired_model_differences(rows: DataFrame, model: str, cluster: str, n_resamples: int, seed: int) -> DataFrame:
    """first, second, mean difference and interval of accuracy between all pairs of models, over shared draws."""
    sums = rows.groupBy(model, cluster).agg(F.sum("correct").alias("correct"), F.count(F.lit(1)).alias("rows"))
    acc = resampled_sums(sums, [model], ["correct", "rows"], cluster, n_resamples, seed, shared=[]).select(model, "replicate", (F.col("correct") / F.col("rows")).alias("x"))
    acc = stored(acc, "replicates")
    a, b = acc.select(F.col(model).alias("first"), "replicate", F.col("x").alias("xa")), acc.select(F.col(model).alias("second"), "replicate", F.col("x").alias("xb"))
    d = a.join(b, "replicate").where(F.col("first") < F.col("second")).withColumn("d", F.col("xa") - F.col("xb"))
    return d.groupBy("first", "second").agg(F.avg("d").alias("mean_diff"), F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select("first", "second", "mean_diff", F.get("q", F.lit(0)).alias("ci_low"), F.get("q", F.lit(1)).alias("ci_high"))


def holm(tests: DataFrame, family: list[str], p: str, tie: str) -> DataFrame:
    """Adds p_adjusted: step-down over a family of tests."""
    w = Window.partitionBy(*family).orderBy(p, tie)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = (m - F.row_number().over(w) + 1) * F.col(p)
    return tests.withColumn("__s", step).withColumn("p_adjusted", F.least(F.lit(1.0), F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("__s")


def order_variance(values: DataFrame, order: str, value: str) -> DataFrame:
    """One row: mean and population deviation of the orders' means, and their number."""
    means = values.groupBy(order).agg(F.avg(value).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.when(F.count("m") > 1, F.stddev_pop("m")).otherwise(0.0).alias("std"), F.count("m").alias("n_orders"))


def nearest_rank(df: DataFrame, by: list[str], value: str, q: float = 0.95) -> DataFrame:
    """Per group: mean, median, and the sorted value at max(0, int(q n) - 1), of non-null values."""
    middle, n = (F.col("__all") - 1) / 2, F.col("__all")
    found = at_places(df, by, value, {"low": F.floor(middle), "high": F.ceil(middle), "nearest": F.greatest(F.lit(0), F.floor(F.lit(q) * n) - 1)})
    return df.groupBy(*by).agg(F.avg(value).alias("mean")).join(found.select(*by, ((F.col("low") + F.col("high")) / 2).alias("median"), "nearest"), by)


def best_threshold(df: DataFrame, score: str, good: str, least: int = 20) -> DataFrame:
    """One row: of all distinct scores as inclusive thresholds that accept enough, the one of best precision, then most accepted."""
    n = df.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("k"))
    upto = running(n, [F.col(score).desc()], {"accepted": F.col("n"), "hits": F.col("k")})
    c = upto.select(F.col(score).alias("threshold"), "accepted", "hits").where(F.col("accepted") >= least).withColumn("precision", F.col("hits") / F.col("accepted"))
    return c.agg(F.max_by(F.struct("threshold", "accepted", "hits", "precision"), F.struct("precision", "accepted")).alias("x")).select("x.*")


def best_setting(table: DataFrame, total: str, tau: str) -> DataFrame:
    """The row of largest total (to six digits); ties go to the larger tau, none counting as -1."""
    return table.orderBy(F.round(total, 6).desc(), F.coalesce(tau, F.lit(-1.0)).desc()).limit(1)


def temperature(scores: DataFrame, grid: list[float]) -> DataFrame:
    """One row: the temperature of a grid with the least mean negative log likelihood of rows(margin, y)."""
    g = scores.select("margin", "y", F.explode(F.array(*map(F.lit, grid))).alias("t"))
    z = F.when(F.col("y") == 1, F.col("margin")).otherwise(-F.col("margin")) / F.col("t")
    each = g.groupBy("t").agg(F.avg(F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))).alias("nll"))
    return each.orderBy(F.round("nll", 12), "t").limit(1)
