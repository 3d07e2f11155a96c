"""Row numbers and exact quantiles by group, without a task that holds a group."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.sources.storage import stored

#: Values that one aggregation buffer may hold, and bins of a counting pass.
SMALL, BINS = 10_000, 1024


def numbered(df: DataFrame, group: list[str], order: list[Column | str], rank: str = "rank", size: str = "size") -> DataFrame:
    """df with rank (from 1, ascending by order) and size of each row's group; null groups count as one.

    Rows are dealt by sampled ranges of (group, order), so a large group lies in many neighbouring
    partitions. Rows are numbered within each; the counts of the partitions before, one row a
    group and partition, are added.
    """
    o = [F.col(x) if isinstance(x, str) else x for x in order]
    keys = [f"__o{i}" for i in range(len(o))]
    d = df.select("*", *(x.alias(k) for x, k in zip(o, keys, strict=True)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(d.repartitionByRange(parts, *group, *keys).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    own = [f"__g{i}" for i in range(len(group))]
    before = counts.withColumns({"__before": F.sum("__c").over(Window.partitionBy(*own).orderBy("__p")) - F.col("__c"), size: F.sum("__c").over(Window.partitionBy(*own))}).drop("__c")
    on = F.col("__part") == F.col("__p")
    for g, k in zip(group, own, strict=True):
        on &= dealt[g].eqNullSafe(before[k])
    here = F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*keys))
    return dealt.join(before, on).withColumn(rank, (here + F.col("__before")).cast("int")).select(*df.columns, rank, size)


def quantiles(df: DataFrame, group: list[str], value: str, wanted: dict[str, float], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """(group, __n, one column for each wanted quantile, interpolated): exact, of the values that aren't null. Groups without a value are left out, null groups count as one; NaN is largest.

    Groups of at most `small` values are aggregated whole. Of larger ones the value at each wanted
    rank is selected: a pass counts the values of a range in `bins` bins, the next one those of
    the bin that holds the rank, until it holds at most `small` values or one distinct value. Nothing is
    sorted or written again, and only counters are shuffled. df is read once for each pass.
    """
    g, names = [f"__g{i}" for i in range(len(group))], list(wanted)
    x = df.select(*(F.col(c).alias(k) for c, k in zip(group, g, strict=True)), F.col(value).cast("double").alias("x")).filter("x is not null")
    sizes = stored(x.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), *_spread()), "quantile-sizes")
    whole, large = x, sizes.filter(F.col("n") > small)
    if not large.isEmpty():
        whole = x.join(sizes.filter(F.col("n") <= small).select(*(F.col(c).alias(f"{c}_") for c in g)), _same(g), "left_semi")
    shares = [float(wanted[k]) for k in names]
    few = whole.groupBy(*g).agg(F.count(F.lit(1)).alias("__n"), F.percentile("x", F.array(*map(F.lit, shares))).alias("q"))
    few = few.select(*g, "__n", *(F.col("q")[i].alias(k) for i, k in enumerate(names)))
    if not large.isEmpty():
        few = few.unionByName(_selected(x, large, g, dict(zip(names, shares, strict=True)), small, bins))
    return stored(few.select(*(F.col(k).alias(c) for c, k in zip(group, g, strict=True)), "__n", *names), "quantiles")


def _same(g: list[str], x: str = "", y: str = "_") -> Column:
    return reduce(and_, (F.col(c + x).eqNullSafe(F.col(c + y)) for c in g), F.lit(True))


def _spread() -> list[Column]:
    """Range and number of the finite values of x, and how many are -infinity or NaN."""
    finite = (F.abs("x") < float("inf")) & ~F.isnan("x")
    held = F.when(finite, F.col("x"))
    return [F.min(held).alias("lo"), F.max(held).alias("hi"), F.count(held).alias("c"), F.count_if(F.col("x") == float("-inf")).alias("below"), F.count_if(F.isnan("x")).alias("nan")]


def _selected(x: DataFrame, large: DataFrame, g: list[str], wanted: dict[str, float], small: int, bins: int) -> DataFrame:
    """quantiles() of groups too large for one buffer, from their sizes and ranges."""
    at = [F.lit(q) * (F.col("n") - 1) for q in wanted.values()]
    ranks = F.array_distinct(F.array(*(f(a).cast("long") + 1 for a in at for f in (F.floor, F.ceil))))
    state = large.select(*g, "n", "nan", "lo", "hi", "c", "below", F.explode(ranks).alias("k"))
    beyond = F.when(F.col("k") <= F.col("below"), float("-inf")).when(F.col("k") > F.col("n") - F.col("nan"), float("nan")).when(F.col("k") > F.col("below") + F.col("c"), float("inf"))
    state = stored(state.withColumn("v", F.coalesce(beyond, F.when(F.col("lo") == F.col("hi"), F.col("lo")))), "quantile-ranges")
    at_bin = F.least(F.lit(bins - 1), F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins))
    ranges = lambda s: s.select(*(F.col(c).alias(f"{c}_") for c in g), "lo", "hi").distinct()
    within = lambda s: x.join(ranges(s), _same(g) & F.col("x").between(F.col("lo"), F.col("hi"))).select(*g, "lo", "hi", "x")
    own = [c for c in state.columns if c not in ("lo", "hi", "c", "below", "v")]
    while not (open_ := state.filter(F.col("v").isNull() & (F.col("c") > small))).isEmpty():
        binned = within(open_).groupBy(*g, "lo", "hi", at_bin.alias("bin")).agg(F.count(F.lit(1)).alias("bc"), F.min("x").alias("blo"), F.max("x").alias("bhi"))
        upto = binned.withColumn("upto", F.sum("bc").over(Window.partitionBy(*g, "lo", "hi").orderBy("bin"))).select(*(F.col(c).alias(f"{c}_") for c in g), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), "bc", "blo", "bhi", "upto")
        rank = F.col("k") - F.col("below")
        found = open_.join(upto, _same([*g, "lo", "hi"]) & (rank > F.col("upto") - F.col("bc")) & (rank <= F.col("upto")))
        next_ = found.select(*own, F.col("blo").alias("lo"), F.col("bhi").alias("hi"), F.col("bc").alias("c"), (F.col("below") + F.col("upto") - F.col("bc")).alias("below"), F.when(F.col("blo") == F.col("bhi"), F.col("blo")).alias("v"))
        state = stored(state.filter(F.col("v").isNotNull() | (F.col("c") <= small)).unionByName(next_), "quantile-ranges")
    rest = within(state.filter("v is null")).groupBy(*g, "lo", "hi").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # at most `small` values each
    rest = rest.select(*(F.col(c).alias(f"{c}_") for c in g), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), "xs")
    v = F.coalesce("v", F.get("xs", (F.col("k") - F.col("below") - 1).cast("int")))
    done = state.join(rest, _same([*g, "lo", "hi"]), "left").groupBy(*g, "n").agg(F.map_from_entries(F.collect_list(F.struct(F.col("k"), v.alias("v")))).alias("of"))
    low = [F.col("of")[F.floor(a).cast("long") + 1] for a in at]
    high = [F.col("of")[F.ceil(a).cast("long") + 1] for a in at]
    mixed = [F.when(lo == hi, lo).otherwise(lo + (a - F.floor(a)) * (hi - lo)) for a, lo, hi in zip(at, low, high, strict=True)]
    return done.select(*g, F.col("n").alias("__n"), *(m.alias(k) for m, k in zip(mixed, wanted, strict=True)))


def with_totals(df: DataFrame, group: str, totals: dict[str, Column]) -> DataFrame:
    """df with aggregates of each row's group: partial aggregation and a join instead of a window."""
    d = stored(df, "totals")
    t = d.groupBy(F.col(group).alias("__tg")).agg(*(x.alias(k) for k, x in totals.items()))
    return d.join(t, d[group].eqNullSafe(t["__tg"])).drop("__tg")
