"""Aggregations, rankings and run comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..lineage import stored


def fat_flags(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From metrics(class, method, lines, cc): methods with fat_method, and classes with fat_class."""
    methods = metrics.withColumn("fat_method", (F.col("lines") > 30) | (F.col("cc") > 10))
    classes = metrics.groupBy("class").agg(F.sum("lines").alias("lines"), F.count("*").alias("methods"))
    return methods, classes.withColumn("fat_class", (F.col("lines") > 300) | (F.col("methods") > 10))


def churn(commits: DataFrame) -> DataFrame:
    """(file, commits, last_changed, last_author) of commits(file, commit_date, author, ord), newest first by ord."""
    first = F.min_by(F.struct("commit_date", "author"), "ord").alias("f")
    return commits.groupBy("file").agg(F.count("*").alias("commits"), first).select("file", "commits", F.col("f.commit_date").alias("last_changed"), F.col("f.author").alias("last_author"))


def risk_rank(metrics: DataFrame, churned: DataFrame, limit: int = 50) -> DataFrame:
    """(file, complexity, commits, risk): the file's highest complexity times its commits; zeros and files without commits are left out."""
    top = metrics.groupBy("file").agg(F.max("cc").alias("complexity")).where("complexity > 0")
    risk = top.join(churned, "file").select("file", "complexity", "commits", (F.col("complexity") * F.col("commits")).alias("risk"))
    return risk.orderBy(F.desc("risk"), "file").limit(limit)


def by_kind(items: DataFrame) -> DataFrame:
    """(blind, kind, n): items(blind, kind) counted in two halves, most first."""
    return items.groupBy("blind", "kind").agg(F.count("*").alias("n")).orderBy("blind", F.desc("n"), "kind")


# Types that have a complexity.
COMPLEX_TYPES = ("action", "action_class", "service", "validation_request", "controller", "job", "command")


def complex_items(nodes: DataFrame, types: Sequence[str] = COMPLEX_TYPES, above: int = 0) -> DataFrame:
    """nodes(id, type, cc) of the types with a complexity above the limit (0, 10 or 15), most complex first; a missing one counts as 0."""
    cc = F.coalesce("cc", F.lit(0))
    return nodes.where(F.col("type").isin(*types) & (cc > above)).orderBy(F.desc("cc"), "id")


def hotspots(items: DataFrame, k: int = 10) -> DataFrame:
    """The k items(id, cc) of the highest complexity; of equal ones the least id."""
    return items.orderBy(F.desc("cc"), "id").limit(k)


def entry_by_kind(entries: DataFrame, order: Sequence[str]) -> DataFrame:
    """(kind, n) in a fixed order of kinds, unknown kinds last."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind")), F.lit(0)), F.lit(len(order) + 1))
    return entries.groupBy("kind").agg(F.count("*").alias("n")).withColumn("place", place).orderBy("place", "kind")


def event_facts(events: DataFrame, listeners: DataFrame, jobs: DataFrame, defer_default: bool = False) -> DataFrame:
    """(event, listeners, orphan, observable_before_commit).

    An event is observable before commit if it is not deferred itself and some
    listener is not both queued and deferred. Unknown listeners run at once.
    """
    known = jobs.select(F.col("fqcn").alias("listener"), "queued", "after_commit")
    late = F.coalesce("queued", F.lit(False)) & F.coalesce("after_commit", F.lit(defer_default))
    heard = listeners.select("event", "listener").distinct().join(known, "listener", "left").groupBy("event").agg(F.count_distinct("listener").alias("listeners"), F.bool_or(~late).alias("_early"))
    out = events.select("event", "deferred").join(heard, "event", "left")
    return out.select("event", F.coalesce("listeners", F.lit(0)).alias("listeners"), F.col("listeners").isNull().alias("orphan"), (~F.col("deferred") & F.coalesce("_early", F.lit(False))).alias("observable_before_commit"))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str, first: int = 0) -> DataFrame:
    """df, stored, with ``name``: its rows' places in the order, from ``first`` on.

    Rows are sorted by ranges and counted in two levels, in a range and over
    the ranges, of which there are as many as shuffle partitions.
    """
    cut = stored(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("_part", "_low", before.alias("_base")))
    return cut.join(sizes, "_part").withColumn(name, F.col("_base") + F.col("_at") - F.col("_low") + first).drop("_part", "_at", "_low", "_base")


BINS = 64


def _upto(by: Sequence[str], order: Sequence[str], size: str):
    """Running sum of size within by, in order."""
    return F.sum(size).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def order_stats(samples: DataFrame, by: Sequence[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(by..., n, low, high, places...): the values at given 0-based places, expressions of ``n``, of each group in order.

    Equal values are counted first. Places are found among the counts in two
    levels, over ``BINS`` ranges of the group's values and then inside the
    ranges that hold a place. The ranges are cut at approximate quantiles of
    the distinct values, so each has about as many whatever their spread, and
    no task orders a whole group; the places are exact. The cuts are stored:
    taken anew they may differ, as they depend on the order in which tasks
    end, and the counts below a range would not be those of the range. Null
    values are left out.
    """
    by = list(by)
    counts = samples.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    cuts = F.percentile_approx("_v", [n / BINS for n in range(1, BINS)], 20 * BINS).alias("_cuts")
    ends = stored(counts.groupBy(*by).agg(F.sum("_c").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), cuts))
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by]
    placed = counts.alias("c").join(ends.alias("e"), reduce(lambda a, b: a & b, same)).select("c.*", "e.n", "e.low", "e.high", below.alias("_bin"))
    bins = placed.groupBy(*by, "_bin").agg(F.sum("_c").alias("_held")).withColumn("_base", _upto(by, ["_bin"], "_held") - F.col("_held"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_bin"]]
    inside = placed.alias("p").join(bins.alias("b"), reduce(lambda a, b: a & b, same)).select("p.*", "b._base", "b._held")
    wanted = reduce(lambda a, b: a | b, [(F.col("_base") <= at) & (at < F.col("_base") + F.col("_held")) for at in places.values()])
    run = inside.where(wanted).withColumn("_before", F.col("_base") + _upto([*by, "_bin"], ["_v"], "_c") - F.col("_c"))
    at = [F.max(F.when((F.col("_before") <= x) & (x < F.col("_before") + F.col("_c")), F.col("_v"))).alias(name) for name, x in places.items()]
    return run.groupBy(*by).agg(F.max("n").alias("n"), F.max("low").alias("low"), F.max("high").alias("high"), *at)


def _nearest(p: float) -> Column:
    """Place of the nearest-rank percentile p: p * (n - 1), rounded half up."""
    return F.floor(p * (F.col("n") - 1) + 0.5)


def _spread(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., reps, median, noise, low, high); see bench_noise."""
    places = {"_a": F.floor((F.col("n") - 1) / 2), "_b": F.floor(F.col("n") / 2), "_p10": _nearest(0.1), "_p90": _nearest(0.9)}
    got = order_stats(samples, by, "ms", places).withColumn("median", (F.col("_a") + F.col("_b")) / 2)
    worst = F.greatest(F.abs(F.col("_p10") - F.col("median")), F.abs(F.col("_p90") - F.col("median"))) / F.nullif("median", F.lit(0.0))
    noise = F.when((F.col("n") < 2) | (F.col("median") <= 0), 0.0).otherwise(worst)
    return got.select(*by, F.col("n").alias("reps"), "median", noise.alias("noise"), "low", "high")


def bench_median(samples: DataFrame) -> DataFrame:
    """(arm, scenario, reps, median) of samples(arm, scenario, ms)."""
    return _spread(samples, ["arm", "scenario"]).select("arm", "scenario", "reps", "median")


def bench_noise(samples: DataFrame) -> DataFrame:
    """(arm, scenario, noise, low, high): the worse of the 10th and 90th nearest-rank percentiles' distance from the median, over it.

    Fewer than two samples or a median of 0 or less give no noise.
    """
    return _spread(samples, ["arm", "scenario"]).select("arm", "scenario", "noise", "low", "high")


def _judged(both: DataFrame) -> DataFrame:
    """both(reps, noise, base, head) with change and verdict, by the repetitions and the noise of the base arm."""
    change = F.when(F.col("base") > 0, (F.col("head") - F.col("base")) / F.col("base")).otherwise(0.0)
    size = F.abs("change")
    verdict = F.when(F.col("reps") < 4, "too few repetitions").when(size <= F.col("noise"), "within noise").when(size >= 0.1, "significant").otherwise("small")
    return both.withColumn("change", change).withColumn("verdict", verdict)


def bench_verdict(samples: DataFrame, base: str, head: str) -> DataFrame:
    """(scenario, change, verdict) of two arms; what the machine could resolve is told by the base arm alone."""
    facts = _spread(samples, ["arm", "scenario"])
    a = facts.where(F.col("arm") == base).select("scenario", "reps", "noise", F.col("median").alias("base"))
    b = facts.where(F.col("arm") == head).select("scenario", F.col("median").alias("head"))
    return _judged(a.join(b, "scenario")).select("scenario", "change", "verdict")


def bench_stability(counts: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """(arm, scenario, stable): whether all repetitions of counts(arm, scenario, key, value) agree on every key."""
    kept = counts.where(~F.col("key").isin(*ignore)) if ignore else counts
    per_key = kept.groupBy("arm", "scenario", "key").agg(F.count_distinct("value").alias("v"))
    return per_key.groupBy("arm", "scenario").agg((F.max("v") <= 1).alias("stable"))


def bench_phases(phases: DataFrame, base: str, head: str, min_ms: float = 1.0) -> DataFrame:
    """(scenario, phase, base_ms, head_ms, noise, change, verdict) of the head arm's phases.

    Phases below min_ms on both arms are left out. Each is held to the noise
    of the base arm's own samples of it; a phase that the base arm lacks, or
    of which its median is 0 or less, has only head_ms.
    """
    facts = _spread(phases, ["arm", "scenario", "phase"])
    b = facts.where(F.col("arm") == head).select("scenario", "phase", F.col("median").alias("head"))
    a = facts.where(F.col("arm") == base).select("scenario", "phase", "reps", "noise", F.col("median").alias("base"))
    both = b.join(a, ["scenario", "phase"], "left").where((F.col("head") >= min_ms) | (F.coalesce("base", F.lit(0.0)) >= min_ms))
    known = lambda c: F.when(F.col("base") > 0, F.col(c))
    return _judged(both).select("scenario", "phase", known("base").alias("base_ms"), F.col("head").alias("head_ms"), *[known(c).alias(c) for c in ("noise", "change", "verdict")])


def timing_summary(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group of samples(ts, ms, ok, status): n, success, throughput, low, mean, high, p50, p95, p99, statuses.

    Percentiles are the first values that a share of the samples does not
    exceed. ``throughput`` is samples a second from the first to the last one,
    null without a span; ``statuses`` is an array of (status, n) by status.
    """
    by = list(by)
    disc = lambda q: F.greatest(F.ceil(F.lit(q) * F.col("n")) - 1, F.lit(0))
    ranks = order_stats(samples, by, "ms", {"p50": disc(0.5), "p95": disc(0.95), "p99": disc(0.99)})
    sums = samples.groupBy(*by, "status").agg(F.count("*").alias("c"), F.sum(F.col("ok").cast("long")).alias("good"), F.sum("ms").alias("total"), F.count("ms").alias("timed"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    span = (F.unix_micros(F.max(F.col("last").cast("timestamp"))) - F.unix_micros(F.min(F.col("first").cast("timestamp")))) / 1e6
    whole = sums.groupBy(*by).agg(
        F.sum("c").alias("samples"),
        (F.sum("good") / F.sum("c")).alias("success"),
        (F.sum("c") / F.nullif(span, F.lit(0.0))).alias("throughput"),
        (F.sum("total") / F.sum("timed")).alias("mean"),
        F.array_sort(F.collect_list(F.struct("status", F.col("c").alias("n")))).alias("statuses"),
    )
    return whole.join(ranks.drop("n"), by, "left").withColumnRenamed("samples", "n").select(*by, "n", "success", "throughput", "low", "mean", "high", "p50", "p95", "p99", "statuses")


def receiver_counts(edges: DataFrame) -> DataFrame:
    """(id, receivers): distinct targets of each source."""
    return edges.groupBy(F.col("source").alias("id")).agg(F.count_distinct("target").alias("receivers"))


def project_summary(nodes: DataFrame, k: int = 10, routes: int = 15) -> DataFrame:
    """(section, name, value) of nodes(id, type, ord, cc, has_n1, fat_method, fat_class).

    Sections: node counts by type, the k most complex nodes, all nodes with
    each smell, and the first ``routes`` routes by ord.
    """
    part = lambda df, section, name, value: df.select(F.lit(section).alias("section"), F.col(name).alias("name"), F.col(value).cast("long").alias("value"))
    out = part(nodes.groupBy("type").agg(F.count("*").alias("n")), "types", "type", "n")
    out = out.union(part(hotspots(nodes.where("cc is not null"), k), "hotspots", "id", "cc"))
    smells = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(c)) for c in ("has_n1", "fat_method", "fat_class")])
    marked = nodes.select("id", "cc", F.explode(F.array_compact(smells)).alias("smell"))
    out = out.union(marked.select("smell", "id", F.col("cc").cast("long")))
    return out.union(part(nodes.where("type = 'route'").orderBy("ord", "id").limit(routes), "routes", "id", "ord"))


def collapse_messages(messages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeated messages as one, at the first position, the label marked ``×n``."""
    out = messages.groupBy(*keys).agg(F.count("*").alias("times"), F.min("pos").alias("pos"))
    return out.withColumn("label", F.when(F.col("times") > 1, F.concat_ws(" ×", "label", F.col("times").cast("string"))).otherwise(F.col("label")))


def dedupe_issues(issues: DataFrame) -> DataFrame:
    """The first issue (ord) of each type and message."""
    return issues.withColumn("_n", F.row_number().over(W.partitionBy("type", "message").orderBy("ord"))).where("_n = 1").drop("_n")


def ops_rollup(ops: DataFrame) -> DataFrame:
    """(level, entry, family, kind, subject, n) of ops(entry, family, kind, table, host).

    The subject is what an operation touches: its table, else its host. Levels:
    operation (entry, family, kind and subject), entry, family (family and
    kind), subject (family and subject) and total; keys beyond a level are null.
    """
    keys = ["entry", "family", "kind", "subject"]
    seen = ops.select("entry", "family", "kind", F.coalesce("table", "host").alias("subject"))
    sums = seen.groupingSets([keys, ["entry"], ["family", "kind"], ["family", "subject"], []], *keys).agg(F.count("*").alias("n"), F.grouping_id(*keys).alias("_g"))
    level = F.when(F.col("_g") == 0, "operation").when(F.col("_g") == 7, "entry").when(F.col("_g") == 9, "family").when(F.col("_g") == 10, "subject").otherwise("total")
    return sums.select(level.alias("level"), *keys, "n")


def path_tree(paths: DataFrame) -> DataFrame:
    """(prefix, direct, total): per path prefix its own entries and all below; an entry that is itself a prefix of others sits inside it."""
    parts = paths.select(F.col("path"), F.split("path", "/").alias("p"))
    parents = parts.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", 1, n), "/"))).alias("prefix"), F.size("p").alias("deep"))
    inner = parents.where("prefix <> path").select("prefix").distinct()
    rows = parents.join(inner, "prefix", "left_semi")
    last = F.size(F.split("prefix", "/"))
    inside = paths.select(F.col("path").alias("prefix")).distinct().join(inner, "prefix", "left_semi").withColumn("_self", F.lit(1))
    marked = rows.join(inside.select(F.col("prefix").alias("path"), "_self"), "path", "left")
    own = (F.col("prefix") == F.col("path")) | ((last == F.col("deep") - 1) & F.col("_self").isNull())
    return marked.groupBy("prefix").agg(F.count_if(own).alias("direct"), F.count("*").alias("total"))


def running(df: DataFrame, group: str, order: str, size: str, name: str, width: int | None = None) -> DataFrame:
    """df, stored, with ``name``: the sum of size up to and with each row of its group, by order.

    The sum is taken in two levels, over ranges of group and order that hold
    about as many rows each, as Spark samples them, and inside each range; so
    no task orders a whole group, however its order is spread. With ``width``
    there are as many ranges as hold so many rows. Rows of equal
    order must not differ in size for the sum to be defined.
    """
    ranges = [max(1, df.count() // width)] if width else []
    cut = stored(df.repartitionByRange(*ranges, F.col(group).asc_nulls_first(), F.col(order).asc_nulls_first()).withColumn("_block", F.spark_partition_id()))
    sums = cut.groupBy(group, "_block").agg(F.sum(size).alias("_held"))
    sums = sums.withColumn("_base", _upto([group], ["_block"], "_held") - F.col("_held")).select(F.col(group).alias("_group"), F.col("_block").alias("_at"), "_base")
    met = cut.join(sums, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_at")))
    return met.withColumn(name, F.col("_base") + _upto([group, "_block"], [order], size)).drop("_block", "_group", "_at", "_base")


def budget_pack(items: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """items with running (sizes so far in the group, by an integer order) and kept (running within the budget)."""
    return running(items, group, order, size, "running").withColumn("kept", F.col("running") <= budget)


def region_index(regions: DataFrame) -> DataFrame:
    """regions(tab, kind, id) with a 1-based index within tab and kind, by id."""
    return regions.withColumn("idx", F.dense_rank().over(W.partitionBy("tab", "kind").orderBy("id")))


def unique_slugs(df: DataFrame, col: str, order: str) -> DataFrame:
    """df with ``unique_slug``: later holders of a slug, by an integer order, get -2, -3 and so on."""
    numbered = running(df.withColumn("_one", F.lit(1)), col, order, "_one", "_n")
    return numbered.withColumn("unique_slug", F.when(F.col("_n") > 1, F.concat_ws("-", col, F.col("_n").cast("string"))).otherwise(F.col(col))).drop("_n", "_one")


def chain_arrows(regions: DataFrame) -> DataFrame:
    """(region, source, target): each member to the next by position."""
    return regions.withColumn("target", F.lead("member").over(W.partitionBy("region").orderBy("pos"))).where("target is not null").select("region", F.col("member").alias("source"), "target")


def topk(df: DataFrame, group: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
