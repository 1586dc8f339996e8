"""Group tests, rank statistics and agreement of labelings. Statistics come from aggregates; p values from a few numbers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.columns import ratio
from weekloom.operators.ordering import running_counts

c = F.col


def average_ranks(df: DataFrame, value: str, *, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """(by, value, n, rank) for each distinct value: rank is the mean rank of its ties."""
    return running_counts(df, value, by=by, buckets=buckets).select(*(by or []), value, "n", (c("upto") - (c("n") - 1) / 2).alias("rank"))


def anova(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """One-way F for each column."""
    long = df.unpivot([group], columns, "metric", "v").where("v IS NOT NULL")
    g = long.groupBy("metric", group).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(c("v") * c("v")).alias("ss"))
    t = g.groupBy("metric").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(c("s") * c("s") / c("n")).alias("b"))
    between, within = c("b") - c("s") * c("s") / c("n"), c("ss") - c("b")
    return t.select("metric", "k", "n", ratio(between / (c("k") - 1), within / (c("n") - c("k"))).alias("f"))


def kruskal(df: DataFrame, group: str, value: str, *, least: int = 5) -> DataFrame:
    """Kruskal-Wallis H with tie correction and eta squared, over groups of ``least`` rows."""
    sizes = df.where(c(value).isNotNull()).groupBy(group).agg(F.count("*").alias("_k")).where(c("_k") >= least)
    rows = df.join(sizes.select(group), group, "left_semi").select(group, value)
    ranks = average_ranks(rows, value)
    tie = ranks.agg(F.sum(c("n") * c("n") * c("n") - c("n")).alias("ties"), F.sum("n").alias("t"))
    sums = rows.groupBy(group, value).agg(F.count("*").alias("m")).join(ranks.select(value, "rank"), value).groupBy(group).agg(F.sum(c("m") * c("rank")).alias("r"), F.sum("m").alias("m"))
    one = sums.agg(F.sum(c("r") * c("r") / c("m")).alias("q"), F.count("*").alias("k")).crossJoin(tie)
    t = c("t").cast("double")
    h = (12 / (t * (t + 1)) * c("q") - 3 * (t + 1)) / F.nullif(1 - c("ties") / (t * t * t - t), F.lit(0.0))
    return one.select("k", c("t").alias("n"), h.alias("h"), F.greatest((h - c("k") + 1) / (t - c("k")), F.lit(0.0)).alias("eta_squared"))


def mann_whitney(df: DataFrame, value: str, first: Column) -> DataFrame:
    """U of the first group, sizes, and the tie-corrected z."""
    rows = df.where(c(value).isNotNull()).select(c(value), first.alias("_f"))
    ranks = average_ranks(rows, value)
    cells = rows.groupBy(value).agg(F.count_if("_f").alias("a"), F.count("*").alias("m")).join(ranks.select(value, "rank"), value)
    one = cells.agg(F.sum(c("a") * c("rank")).alias("r"), F.sum("a").alias("n1"), F.sum(c("m") - c("a")).alias("n2"), F.sum(c("m") * c("m") * c("m") - c("m")).alias("ties"))
    n1, n2 = c("n1").cast("double"), c("n2").cast("double")
    n, u = n1 + n2, c("r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - c("ties") / (n * (n - 1))))
    return one.select("n1", "n2", u.alias("u"), ratio(u - n1 * n2 / 2, sd).alias("z"))


def welch_t(df: DataFrame, value: str, first: Column) -> DataFrame:
    """Difference of means, Welch t and its degrees of freedom."""
    a, b = F.when(first, c(value)), F.when(~first, c(value))
    va, vb = F.var_samp(a) / F.count(a), F.var_samp(b) / F.count(b)
    t = ratio(F.avg(a) - F.avg(b), F.sqrt(va + vb))
    dof = ratio((va + vb) * (va + vb), va * va / (F.count(a) - 1) + vb * vb / (F.count(b) - 1))
    return df.agg((F.avg(a) - F.avg(b)).alias("difference"), t.alias("t"), dof.alias("df"))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    d = c(a) - c(b)
    return df.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), ratio(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(d))).alias("t"))


def spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """n, Pearson and Spearman of column pairs; null without variance. Ranks are of rows where both are present."""
    out = None
    for x, y in pairs:
        rows = df.where(c(x).isNotNull() & c(y).isNotNull()).select(c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))
        rx = average_ranks(rows, "x").select("x", c("rank").alias("rx"))
        ry = average_ranks(rows, "y").select("y", c("rank").alias("ry"))
        both = rows.join(rx, "x").join(ry, "y").agg(F.count("*").alias("n"), safe_corr("x", "y").alias("pearson"), safe_corr("rx", "ry").alias("spearman")).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", "pearson", "spearman")
        out = both if out is None else out.union(both)
    return out


def safe_corr(x: str, y: str) -> Column:
    """Correlation from moments as an aggregate; null without variance."""
    varied = (F.var_pop(x) > 1e-12) & (F.var_pop(y) > 1e-12)
    return F.when(varied, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """NMI (arithmetic) and ARI of two labelings, from the contingency counts."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    cells = cells.withColumn("r", F.sum("n").over(Window.partitionBy(a))).withColumn("k", F.sum("n").over(Window.partitionBy(b)))
    t = F.sum("n").cast("double")
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(c("n") * F.ln("n")).alias("ra"), F.sum(c("n") * (c("n") - 1) / 2).alias("pa"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(c("n") * F.ln("n")).alias("rb"), F.sum(c("n") * (c("n") - 1) / 2).alias("pb"))
    one = cells.agg(t.alias("t"), F.sum(c("n") * F.ln("n")).alias("j"), F.sum(c("n") * (c("n") - 1) / 2).alias("p")).crossJoin(rows).crossJoin(cols)
    ha, hb = F.ln("t") - c("ra") / c("t"), F.ln("t") - c("rb") / c("t")
    mi = F.ln("t") + (c("j") - c("ra") - c("rb")) / c("t")
    expected = c("pa") * c("pb") / (c("t") * (c("t") - 1) / 2)
    return one.select(F.coalesce(ratio(mi, (ha + hb) / 2), F.lit(1.0)).alias("nmi"), F.coalesce(ratio(c("p") - expected, (c("pa") + c("pb")) / 2 - expected), F.lit(1.0)).alias("ari"))


def bootstrap_interval(df: DataFrame, value: str, *, key: str, replicates: int = 50, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of a mean over Poisson(1) bootstrap replicates; a row's weight comes from a hash of its key and the replicate.

    All replicates are sums of one pass; no row is repeated. Null values don't count.
    """
    # Chances of at most k draws of Poisson(1); more than nine have a chance of 1e-7.
    steps = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975, 0.99999887]
    sums = []
    for k in range(1, replicates + 1):
        u = F.pmod(F.xxhash64(key, F.lit(k)), F.lit(1_000_003)) / 1_000_003.0
        weight = F.when(c(value).isNotNull(), sum(((u >= s).cast("int") for s in steps), F.lit(0)))
        sums.append(ratio(F.sum(weight * c(value)), F.sum(weight)))
    means = df.agg(F.array(*sums).alias("m")).select(F.explode("m").alias("m"))
    q = F.percentile("m", F.array(F.lit(low), F.lit(0.5), F.lit(high)))
    return means.agg(q.alias("q")).select(c("q")[0].alias("low"), c("q")[1].alias("median"), c("q")[2].alias("high"))


def adjusted_mutual_information(df: DataFrame, a: str, b: str, *, most: int = 1_000_000) -> float:
    """AMI of two labelings (arithmetic mean): the expected information of random tables with the same margins is summed over the margins.

    The table of label pairs, not of rows, is worked on in the driver; more than ``most`` pairs are an error.
    """
    from math import lgamma, log

    import numpy as np

    cells = df.groupBy(a, b).agg(F.count("*").alias("n")).limit(most + 1).collect()
    if len(cells) > most:
        raise ValueError(f"more than {most} pairs of labels")
    rows, cols = {}, {}
    for x, y, n in cells:
        rows[x], cols[y] = rows.get(x, 0) + n, cols.get(y, 0) + n
    total = sum(rows.values())
    entropy = lambda m: -sum(n / total * log(n / total) for n in m.values())
    mi = sum(n / total * log(n * total / (rows[x] * cols[y])) for x, y, n in cells)
    expected = 0.0
    f = lambda k: lgamma(k + 1)
    for p in rows.values():
        for q in cols.values():
            # Hypergeometric: beyond 40 standard deviations from the mean the mass is nothing, however many rows there are.
            mean, low, high = p * q / total, max(1, p + q - total), min(p, q)
            sd = (mean * (1 - p / total) * (total - q) / max(total - 1, 1)) ** 0.5
            low, high = max(low, int(mean - 40 * sd - 40)), min(high, int(mean + 40 * sd + 40))
            if low > high:
                continue
            # Log masses by the ratio of neighbours, from one exact value near the mean.
            n = np.arange(low, high + 1, dtype=float)
            step = np.log((p - n[:-1]) * (q - n[:-1]) / ((n[:-1] + 1) * (total - p - q + n[:-1] + 1)))
            at = low + int(np.argmin(np.abs(n - mean)))
            first = f(p) + f(q) + f(total - p) + f(total - q) - f(total) - f(at) - f(p - at) - f(q - at) - f(total - p - q + at)
            ladder = np.r_[0.0, np.cumsum(step)]
            chance = np.exp(first + ladder - ladder[at - low])
            expected += float((n / total * np.log(n * total / (p * q)) * chance).sum())
    top = (entropy(rows) + entropy(cols)) / 2 - expected
    return 1.0 if abs(top) < 1e-15 else (mi - expected) / top


def conditional_agreement(df: DataFrame, a: str, b: str, given: str) -> DataFrame:
    """NMI of two labelings inside each level of a third, averaged by its rows."""
    cells = df.groupBy(given, a, b).agg(F.count("*").alias("n"))
    entropy = lambda x, by: cells.groupBy(given, *by).agg(F.sum("n").alias("n")).groupBy(given).agg(F.sum(c("n") * F.ln("n")).alias(x))
    rows = cells.groupBy(given).agg(F.sum("n").cast("double").alias("t"))
    for x, by in (("ra", [a]), ("rb", [b]), ("rj", [a, b])):
        right = entropy(x, by).withColumnRenamed(given, "_given")
        rows = rows.join(right, c(given).eqNullSafe(c("_given"))).drop("_given")
    ha, hb, hj = (F.ln("t") - c(x) / c("t") for x in ("ra", "rb", "rj"))
    nmi = F.when(ha + hb > 1e-12, (ha + hb - hj) / ((ha + hb) / 2)).otherwise(1.0)
    return rows.agg(ratio(F.sum(nmi * c("t")), F.sum("t")).alias("nmi"))
