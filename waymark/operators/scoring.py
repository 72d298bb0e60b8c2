"""Scoring of forecasts against what happened: errors by bucket, events, calibration, ranks.

A scored row has ``pred``, ``actual`` and ``persist`` (the delay held flat), in minutes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.operators.ranks import with_running_totals


def ranked_quantiles(df: DataFrame, group: list[str], value: str, **shares: float) -> DataFrame:
    """The value of rank floor(n * share) + 1 for each group and named share.

    Rows are first counted by distinct value, and the counts summed up by range, so that no task holds all values of a group.
    """
    hist = df.groupBy(*group, value).agg(F.count("*").alias("_c"))
    hist = with_running_totals(hist, group, value, c=F.col("_c"))
    upto, n = F.col("before_c") + F.col("_c"), F.col("all_c")
    pick = lambda q: F.min(F.when(upto >= F.least(F.floor(n * F.lit(float(q))) + 1, n), F.col(value)))
    return hist.groupBy(*group).agg(*(pick(q).alias(name) for name, q in shares.items()))


def error_by_bucket(scored: DataFrame, bucket: Column) -> DataFrame:
    """Count, MAE, median, persistence MAE, gain, bias and P90 of each bucket and of ``all``."""
    err = F.abs(F.col("pred") - F.col("actual"))
    e = scored.select(F.explode(F.array(bucket, F.lit("all"))).alias("bucket"), err.alias("err"), (F.col("pred") - F.col("actual")).alias("bias"), F.abs(F.col("persist") - F.col("actual")).alias("held"))
    sums = e.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("err").alias("mae"), F.avg("held").alias("persist_mae"), F.avg("bias").alias("bias"))
    return sums.join(ranked_quantiles(e, ["bucket"], "err", median=0.5, p90=0.9), "bucket").withColumn("gain", F.col("persist_mae") - F.col("mae"))


def event_detection(scored: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Recall, precision, MAE on events and share of events under-predicted, for each named rule (event, flagged)."""
    one = [F.struct(F.lit(name).alias("rule"), event.alias("event"), flag.alias("flag")) for name, (event, flag) in rules.items()]
    d = scored.select(F.explode(F.array(*one)).alias("r"), F.abs(F.col("pred") - F.col("actual")).alias("err"), (F.col("pred") < F.col("actual")).alias("under"))
    event, flag = F.col("r.event"), F.col("r.flag")
    return d.groupBy("r.rule").agg(
        F.count_if(event).alias("events"),
        (F.count_if(event & flag) / F.nullif(F.count_if(event), F.lit(0))).alias("recall"),
        (F.count_if(event & flag) / F.nullif(F.count_if(flag), F.lit(0))).alias("precision"),
        F.avg(F.when(event, F.col("err"))).alias("event_mae"),
        (F.count_if(event & F.col("under")) / F.nullif(F.count_if(event), F.lit(0))).alias("under_share"),
    )


def rollout_rules(size: float = 30.0) -> dict[str, tuple[Column, Column]]:
    """Rises and falls over ``size`` against persistence; a forecast of half of it counts as seen."""
    rise, told = F.col("actual") - F.col("persist"), F.col("pred") - F.col("persist")
    return {"spike": (rise > size, told > size / 2), "recovery": (-rise > size, -told > size / 2)}


def journey_robust_stats(scored: DataFrame, trip: str, hop: str, trim: float = 0.05) -> DataFrame:
    """A row for the model and one for persistence: of the trips' MAEs (on a grid of 1/100 minute) the mean, rank-picked
    quantiles and trimmed mean, and the number of runaways.

    A trip of at least four forecasts runs away if, in order of hops, its last error is over 40 and more than 20 above
    the middle one.
    """
    one = F.array(F.struct(F.lit("model").alias("series"), F.col("pred").alias("x")), F.struct(F.lit("persistence").alias("series"), F.col("persist").alias("x")))
    d = scored.select(trip, hop, "actual", F.explode(one).alias("s")).select(trip, hop, "s.series", F.abs(F.col("s.x") - F.col("actual")).alias("err"))
    errors = F.transform(F.array_sort(F.collect_list(F.struct(hop, "err"))), lambda x: x["err"])
    d = d.groupBy("series", trip).agg(F.floor(F.avg("err") * 100 + 0.5).cast("long").alias("v"), errors.alias("e"))
    last, middle = F.element_at("e", -1), F.get("e", F.floor(F.size("e") / 2).cast("int"))
    d = d.withColumn("runs_away", (F.size("e") >= 4) & (last > 40) & (last > middle + 20))
    hist = d.groupBy("series", "v").agg(F.count("*").alias("c"), F.count_if("runs_away").alias("r"))
    every = W.partitionBy("series")
    hist = hist.withColumn("n", F.sum("c").over(every)).withColumn("cum", F.sum("c").over(every.orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    cut = F.floor(F.col("n") * F.lit(trim))
    inside = F.greatest(F.lit(0).cast("long"), F.least(F.col("cum"), F.col("n") - cut) - F.greatest(F.col("cum") - F.col("c"), cut))
    at = lambda q: F.min(F.when(F.col("cum") >= F.least(F.floor(F.col("n") * F.lit(q)) + 1, F.col("n")), F.col("v"))) / 100
    return hist.groupBy("series").agg(
        F.sum("c").alias("trips"), (F.sum(F.col("v") * F.col("c")) / F.sum("c") / 100).alias("mean"), at(0.5).alias("median"),
        (F.sum(F.col("v") * inside) / F.sum(inside) / 100).alias("trimmed"), at(0.75).alias("p75"), at(0.9).alias("p90"), F.sum("r").alias("runaways"),
    )


def calibration_table(scored: DataFrame, bucket: Column) -> DataFrame:
    """Mean actual and predicted value of each bucket of the actual, and the share captured in percent."""
    d = scored.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("actual").alias("mean_actual"), F.avg("pred").alias("mean_pred"))
    return d.withColumn("captured_pct", 100 * F.col("mean_pred") / F.nullif(F.col("mean_actual"), F.lit(0.0)))


def threshold_detection(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Hits, false alarms and misses at each threshold, with recall and precision."""
    d = scored.select("pred", "actual", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    big, told = F.col("actual") >= F.col("threshold"), F.col("pred") >= F.col("threshold")
    d = d.groupBy("threshold").agg(F.count_if(big & told).alias("tp"), F.count_if(~big & told).alias("fp"), F.count_if(big & ~told).alias("fn"))
    share = lambda other: F.col("tp") / F.nullif(F.col("tp") + F.col(other), F.lit(0))
    return d.withColumn("recall", share("fn")).withColumn("precision", share("fp"))


def baseline_gain(scored: DataFrame, bucket: Column) -> DataFrame:
    """Per bucket and for ``all``: MAE of the prediction, of zero, of the best constant (the bucket's median) and of persistence."""
    d = scored.select("pred", "actual", "persist", F.explode(F.array(bucket, F.lit("all"))).alias("bucket"))
    constant = ranked_quantiles(d, ["bucket"], "actual", constant=0.5)
    off = lambda x: F.avg(F.abs(x - F.col("actual")))
    return d.join(constant, "bucket").groupBy("bucket").agg(
        F.count("*").alias("n"), off(F.col("pred")).alias("mae"), off(F.lit(0)).alias("mae_zero"), off(F.col("constant")).alias("mae_constant"), off(F.col("persist")).alias("mae_persist")
    )


def duplication_profile(at: DataFrame, keys: list[str], target: str) -> DataFrame:
    """How often a key is supervised: a row per class of group sizes (1, 2-3, 4-7, 8-15, 16+) with its groups, rows and share
    of all rows, and the groups of several rows whose target is the same in all of them."""
    sizes = at.groupBy(*keys).agg(F.count("*").alias("size"), (F.max(target) - F.min(target)).alias("spread"))
    name = F.when(F.col("size") == 1, "1").when(F.col("size") <= 3, "2-3").when(F.col("size") <= 7, "4-7").when(F.col("size") <= 15, "8-15").otherwise("16+")
    same = (F.col("size") > 1) & (F.coalesce("spread", F.lit(0)) == 0)
    d = sizes.groupBy(name.alias("class")).agg(F.count("*").alias("groups"), F.sum("size").alias("rows"), F.count_if(same).alias("constant"))
    return d.withColumn("share", F.col("rows") / F.sum("rows").over(W.partitionBy(F.lit(1))))  # five rows


def group_sizes(at: DataFrame, keys: list[str]) -> DataFrame:
    """One row: groups, rows, and median, P90 and largest size of a group."""
    sizes = at.groupBy(*keys).agg(F.count("*").alias("size")).withColumn("_all", F.lit(1))
    total = sizes.groupBy("_all").agg(F.count("*").alias("groups"), F.sum("size").alias("rows"), F.max("size").alias("largest"))
    return total.join(ranked_quantiles(sizes, ["_all"], "size", median=0.5, p90=0.9), "_all").drop("_all")


def position_in_stand(at: DataFrame, keys: list[str], tick: str, error: Column, shortest: int = 4, cap: int = 9) -> DataFrame:
    """Mean error by the k-th tick of a stand (from 0) counted from its start and from its end, in stands of at least
    ``shortest`` ticks, ticks from ``cap`` on together; and of their first tick, all later ones, and all rows of any stand."""
    w = W.partitionBy(*keys)
    k = lambda order: F.row_number().over(w.orderBy(order)).cast("long") - 1
    d = at.withColumn("_e", error).withColumn("_s", k(F.col(tick))).withColumn("_t", k(F.desc(tick))).withColumn("_long", F.count("*").over(w) >= shortest)
    top = lambda c: F.least(F.col(c), F.lit(cap).cast("long"))
    row = lambda side, k: F.struct(F.lit(side).alias("side"), k.cast("long").alias("k"))
    none = F.lit(None)
    in_long = F.array(row("start", top("_s")), row("end", top("_t")), F.when(F.col("_s") == 0, row("first", none)).otherwise(row("later", none)))
    ends = F.concat(F.array(row("all", none)), F.when(F.col("_long"), in_long).otherwise(F.slice(in_long, 1, 0)))
    return d.select("_e", F.explode(ends).alias("p")).groupBy("p.side", "p.k").agg(F.count("*").alias("n"), F.avg("_e").alias("mae"))


def lift_table(events: DataFrame, flag: Column, size: Column, hold: Column, thresholds: list[float]) -> DataFrame:
    """For all events and for holds only: events over each threshold, how often ``flag`` holds for them and for the others, and
    the ratio. Thresholds that no event exceeds are left out."""
    d = events.select(flag.cast("double").alias("f"), size.alias("s"), hold.alias("h"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    d = d.select("*", F.explode(F.when(F.col("h"), F.array(F.lit("all"), F.lit("holds"))).otherwise(F.array(F.lit("all")))).alias("of"))
    big = F.col("s") > F.col("threshold")
    d = d.groupBy("of", "threshold").agg(F.count_if(big).alias("n_large"), F.avg(F.when(big, F.col("f"))).alias("p_large"), F.avg(F.when(~big, F.col("f"))).alias("p_small"))
    return d.where("n_large > 0").withColumn("lift", F.col("p_large") / F.nullif(F.col("p_small"), F.lit(0.0)))


def auc_single(df: DataFrame, features: list[str], label: Column, top: int = 12, digits: int | None = None) -> DataFrame:
    """The ``top`` features by rank AUC, ties at their average rank, whichever direction is better; constant ones are left out.

    All features are counted by distinct value in one pass, and the counts summed up by range; ``digits`` puts continuous
    ones on a grid of that many decimals, which needs fewer rows but is not needed for exact ranks.
    """
    value = lambda c: F.col(c).cast("double") if digits is None else F.round(F.col(c).cast("double"), digits)
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), value(c).alias("value")) for c in features))
    h = df.select(label.alias("y"), F.inline(cells)).where("value IS NOT NULL").groupBy("feature", "value").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("m"))
    h = with_running_totals(h, ["feature"], "value", m=F.col("m"))
    won = F.sum(F.col("p") * (F.col("before_m") + F.col("m") / 2))
    a = won / F.nullif((F.sum("p") * F.sum("m")).cast("double"), F.lit(0.0))
    found = h.groupBy("feature").agg(F.count("*").alias("_n"), F.greatest(a, 1 - a).alias("auc"), F.sum("p").alias("positives"), F.sum("m").alias("negatives"))
    return found.where("_n > 1").drop("_n").orderBy(F.desc("auc"), "feature").limit(top)


def precision_at_recall(df: DataFrame, score: str, label: Column, recalls: list[float], digits: int | None = None) -> DataFrame:
    """The highest threshold that reaches each recall, and the precision there.

    Rows are counted by distinct score, and the counts summed up by range; ``digits`` puts continuous scores on a grid of
    that many decimals.
    """
    if digits is not None:
        df = df.withColumn(score, F.round(score, digits))
    h = df.groupBy(score).agg(F.count_if(label).alias("p"), F.count("*").alias("c"))
    h = with_running_totals(h, [], score, descending=True, p=F.col("p"), c=F.col("c"))
    h = h.withColumn("tp", F.col("before_p") + F.col("p")).withColumn("told", F.col("before_c") + F.col("c"))
    h = h.withColumn("recall", F.explode(F.array(*map(F.lit, recalls)))).where(F.col("tp") >= F.col("recall") * F.col("all_p"))
    return h.groupBy("recall").agg(F.max(score).alias("threshold"), F.max_by(F.col("tp") / F.col("told"), score).alias("precision"))


def weighted_huber(scored: DataFrame, weight: Column, delta: float = 60.0) -> DataFrame:
    """Huber loss of the error, weighted; one row."""
    e = F.abs(F.col("pred") - F.col("actual")).cast("double")
    loss = F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))
    return scored.agg((F.sum(weight * loss) / F.nullif(F.sum(weight), F.lit(0.0))).alias("loss"))
