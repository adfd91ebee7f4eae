"""Mixing sources to target weights by entropy balancing.

The sizes (words) of the documents of each source have to meet that source's target. Rates r_i are
those closest, in relative entropy, to taking every document once, under a base measure of
size_i + m (m: the source's mean size) with the token share c_i = size_i / (size_i + m) as moment
function. The convex dual has one variable per source; its solution tilts rates exponentially,

    r_i = min(cap, exp(lambda * c_i)),      sum_i size_i * r_i = target.

Documents are first pre-aggregated to a histogram (source, size, count), whose length per source is bounded by
the longest document and not by the rows. Newton steps are distributed: each aggregates the gradient and the
slope of every source's dual over the histogram in one Spark aggregation and moves all multipliers at once, kept
inside a bracket per source; a frame with one row per source is all the state. Sums are decimal and so don't depend on the
order in which tasks end. The rates are rounded into whole copies by error diffusion inside salted buckets of
each source (largest documents first, so that small ones absorb what is left), which keeps each source's words
near its target.

Null text has size 0; null is a source of its own, last in order. Without words all targets are 0.
An empty table gives an empty result. Rows with equal ids, or without one, are treated as separate documents.
The result depends only on the rows, so reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, row_mark, settle

CAP = 3.0
WEIGHTS = (1.0, 2.0, 3.0)
BUCKET_ROWS = 4096
#: A source's words meet its target up to this share of it before rounding.
TOLERANCE = 1e-7
#: Newton steps between writes of the state, and the most writes; a bracket halves at least once a step.
STEPS, ROUNDS = 4, 20


def source_targets(sources: DataFrame, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, has, source_size, n, target from one row per source (has: source is not null).

    Water filling in closed form: with sources in order of size per weight, those whose cap lies below
    the common level are capped, and the level follows from running sums. The frame has one row per
    source, already aggregated, which is what meets in the single window partition.
    """
    order = Window.orderBy(F.col("has").desc(), "source")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("w", pick).withColumn("cap_at", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    filled = Window.orderBy(F.col("cap_at") / F.col("w"), F.col("has").desc(), "source")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap_at").over(before), F.lit(0.0))) / F.col("w_left"))
        .withColumn("open", F.col("level") * F.col("w") <= F.col("cap_at"))
    )
    # The first open source (in order of cap per weight) sets the level of all that follow.
    rows = rows.withColumn("level", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("cap_at")).otherwise(F.least(F.col("cap_at"), F.col("level") * F.col("w")))
    return rows.select("source", "has", "source_size", "n", target.alias("target"))


def _newton_step(hist: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """state(key, target, mean, lo, hi, lam, done) one step on, for all sources together."""
    top = F.lit(math.log(cap))
    size, at = F.col("size").cast("double"), F.col("lam") * F.col("c")
    words = F.col("k") * F.col("size") * F.exp(F.least(at, top))
    total = lambda x: F.sum(x.cast("decimal(38,6)")).cast("double")
    sums = (
        hist.join(state, "key")
        .withColumn("c", size / (size + F.col("mean")))
        .groupBy(*state.columns)
        .agg(total(words).alias("got"), F.coalesce(total(F.when(at < top, words * F.col("c"))), F.lit(0.0)).alias("slope"))
        .withColumn("miss", F.col("got") - F.col("target"))
    )
    low = F.col("miss") < 0
    moved = sums.withColumns({"lo": F.when(low, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(low, F.col("hi")).otherwise(F.col("lam"))})
    step = F.when(F.col("slope") > 0, F.col("lam") - F.col("miss") / F.greatest("slope", F.lit(1e-300)))
    inside = F.coalesce((step > F.col("lo")) & (step < F.col("hi")), F.lit(False))
    done = F.col("done") | (F.abs("miss") <= TOLERANCE * F.greatest("target", F.lit(1.0)))
    following = F.when(F.col("done") | done, F.col("lam")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)
    return moved.select("key", "target", "mean", "lo", "hi", following.alias("lam"), done.alias("done"))


def tilts(hist: DataFrame, goals: DataFrame, cap: float = CAP) -> DataFrame:
    """key, mean, lam from hist(key, size, k) and goals(key, source_size, n, least, target), least the smallest size above 0."""
    live = hist.filter("size > 0").select("key", "size", "k")
    mean = F.col("source_size") / F.col("n")
    top = F.log(F.lit(cap)) * (F.col("least") + mean) / F.col("least")
    full = F.col("target") >= F.lit(cap * (1 - 1e-12)) * F.col("source_size")
    state = goals.filter("source_size > 0").select(
        "key", "target", mean.alias("mean"), F.lit(-1e4).alias("lo"), top.alias("hi"), F.when(full, top).otherwise(F.lit(0.0)).alias("lam"), full.alias("done")
    )
    for _ in range(ROUNDS):
        for _ in range(STEPS):
            state = _newton_step(live, state, cap)
        state = settle(state)
        if not state.filter("not done").head(1):
            break
    return state.select("key", "mean", F.round("lam", 12).alias("lam"))


def diffuse(sizes: np.ndarray, rates: np.ndarray, cap: int) -> np.ndarray:
    """Whole copies for documents in descending size; what rounding gives or takes is passed on."""
    out = np.zeros(len(sizes), dtype=np.int64)
    owed = 0.0
    for i in range(len(sizes)):
        if sizes[i] <= 0:
            continue
        want = owed + sizes[i] * rates[i]
        out[i] = min(cap, max(0, int(np.floor(want / sizes[i] + 0.5))))
        owed = want - out[i] * sizes[i]
    return out


def _rounded(cap: float):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "a", "b"], ascending=[False, True, True, True], kind="stable")
        s = pdf["size"].to_numpy()
        lam, mean = float(pdf["lam"].iloc[0]), float(pdf["mean"].iloc[0])
        c = s / np.maximum(s + mean, 1e-300)
        rates = np.exp(np.minimum(lam * c, np.log(cap)))
        pdf = pdf.assign(copies=diffuse(s, rates, int(cap)))
        pdf["taken"] = pdf["copies"] * pdf["size"]
        return pdf[["doc_id", "a", "b", "size", "source_size", "target", "taken", "copies"]]

    return work


def _balanced(docs: DataFrame, mark: Column, cap: float, weights: tuple[float, ...], bucket_rows: int) -> DataFrame:
    """doc_id, mark, size, source_size, target, taken, copies for every row; mark (a, b) is what stands for the row."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = settle(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), mark.alias("mark")))
    hist = settle(sized.groupBy("key", "source", "size").agg(F.count("*").alias("k")))
    sums = hist.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("k")).alias("source_size"), F.sum("k").alias("n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    sources = settle(sums)
    targets = source_targets(sources.select("source", F.col("source").isNotNull().alias("has"), "source_size", "n"), cap, weights).select(key.alias("key"), "target")
    goals = settle(sources.drop("source").join(targets, "key"))
    # a source without words has no dual: nothing of it can be taken
    solved = settle(goals.drop("least").join(tilts(hist, goals, cap), "key", "left").na.fill({"lam": 0.0, "mean": 1.0}))
    bucket = F.pmod(F.col("mark.a"), F.ceil(F.col("n") / F.lit(bucket_rows)).cast("long"))
    return (
        sized.drop("source")
        .join(solved, "key")
        .select("key", bucket.alias("bucket"), "doc_id", F.col("mark.a").alias("a"), F.col("mark.b").alias("b"), "size", "source_size", "target", "lam", "mean")
        .groupBy("key", "bucket")
        .applyInPandas(_rounded(cap), "doc_id long, a long, b long, size long, source_size long, target double, taken long, copies long")
    )


def balanced(docs: DataFrame, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of docs(doc_id, text, source)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", "source")
    return _balanced(rows, row_mark(rows), cap, weights, bucket_rows).drop("a", "b")


def take_mix(docs: DataFrame, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; rows taken 0 times go.

    A row is known by its whole content, so rows without an id or that share one are taken as the mix says for each.
    Rows that are equal in all columns are merged in map tasks and come out as often as all of them together are taken.
    """
    mark = row_mark(docs)
    copies = _balanced(docs.select("doc_id", "text", "source", mark.alias("__mark")), F.col("__mark"), cap, weights, bucket_rows)
    copies = copies.groupBy(F.struct("a", "b").alias("__mark")).agg(F.sum("copies").cast("int").alias("__copies")).filter("__copies > 0")
    rows = docs.select(mark.alias("__mark"), F.struct(*docs.columns).alias("__row")).groupBy("__mark").agg(F.first("__row").alias("__row"))
    return rows.join(copies, "__mark").select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")
