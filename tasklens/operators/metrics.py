"""Counters, histograms with bounded-error quantiles, series and their text format, over lifecycle events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Octaves 2^10 to 2^37 of three parts each, with one bucket below and one above: fixed values.
LOW_BITS, HIGH_BITS, PARTS = 10, 37, 3
OVERFLOW = 1 + (HIGH_BITS - LOW_BITS) * PARTS


def bucket_of(ns: str = "ns"):
    """The bucket of a duration in ns, in exact integer steps."""
    e = f"(length(bin({ns})) - 1)"
    inner = f"1 + ({e} - {LOW_BITS}) * {PARTS} + shiftright(({ns} - shiftleft(1L, {e})) * {PARTS}, {e})"
    return F.expr(f"CASE WHEN {ns} < {1 << LOW_BITS} THEN 0 WHEN {ns} >= {1 << HIGH_BITS} THEN {OVERFLOW} ELSE {inner} END").cast("int")


def histogram(spans: DataFrame) -> DataFrame:
    """bucket, n, total, low, high of spans (kind, ns) for each kind; negative durations are dropped."""
    return spans.where("ns >= 0").groupBy("kind", bucket_of().alias("bucket")).agg(F.count("*").alias("n"), F.sum("ns").alias("total"), F.min("ns").alias("low"), F.max("ns").alias("high"))


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy("kind", "queue", "event").agg(F.count("*").alias("n"), F.sum("duration_us").alias("total_us"))


def gauges(events: DataFrame) -> DataFrame:
    """The last value of each series."""
    return events.groupBy("kind", "queue").agg(F.max_by("duration_us", "seq").alias("last_us"))


def latency(spans: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """count, min, max, integer mean and nearest-rank quantiles from the buckets of each kind, clamped into [min, max]."""
    walk = Window.partitionBy("kind").orderBy("bucket")
    whole = Window.partitionBy("kind")
    h = histogram(spans).withColumn("cum", F.sum("n").over(walk))
    for name, f, column in (("all_n", F.sum, "n"), ("all_total", F.sum, "total"), ("least", F.min, "low"), ("most", F.max, "high")):
        h = h.withColumn(name, f(column).over(whole))
    octave = f"CAST(floor((bucket - 1) / {PARTS}) AS INT) + {LOW_BITS}"
    low = F.expr(f"shiftleft(1L, {octave}) + ceil(shiftleft(1L, {octave}) * pmod(bucket - 1, {PARTS}) / {PARTS})")
    high = F.expr(f"shiftleft(1L, {octave}) + ceil(shiftleft(1L, {octave}) * (pmod(bucket - 1, {PARTS}) + 1) / {PARTS})")
    middle = F.when(F.col("bucket") == 0, F.lit((1 << LOW_BITS) - 1)).when(F.col("bucket") == OVERFLOW, F.lit(1 << HIGH_BITS)).otherwise(F.round(F.sqrt(low.cast("double") * high)))
    h = h.withColumn("guess", F.greatest("least", F.least("most", middle.cast("long"))))
    picked = [F.min(F.when(F.col("cum") >= F.greatest(F.lit(1), F.ceil(q * F.col("all_n"))), F.struct("bucket", "guess")))["guess"].alias(f"p{int(q * 100)}") for q in quantiles]
    return h.groupBy("kind").agg(F.first("all_n").alias("n"), F.first("least").alias("min_ns"), F.first("most").alias("max_ns"), F.expr("first(all_total) div first(all_n)").alias("mean_ns"), *picked)


def latency_or_zero(spans: DataFrame) -> DataFrame:
    """latency over all kinds as one row, of zeros where there is no span."""
    one = latency(spans.withColumn("kind", F.lit("all"))).drop("kind")
    base = spans.sparkSession.range(1).select(F.lit(1).alias("_one"))
    joined = base.join(one.withColumn("_one", F.lit(1)), "_one", "left")  # two frames of one row
    return joined.select(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in one.columns])


def bucket_table(spark: SparkSession) -> DataFrame:
    """bucket, low, high of every bucket between the first and the last."""
    k, first = F.col("bucket"), 1 << LOW_BITS
    base = F.expr(f"shiftleft({first}L, CAST((bucket - 1) div {PARTS} AS INT))")
    edge = lambda part: base + F.expr(f"(shiftleft({first}L, CAST((bucket - 1) div {PARTS} AS INT)) * {part} + {PARTS - 1}) div {PARTS}")
    rows = spark.range(1, OVERFLOW).withColumnRenamed("id", "bucket")
    return rows.select(k.cast("int").alias("bucket"), edge(f"((bucket - 1) % {PARTS})").alias("low"), edge(f"((bucket - 1) % {PARTS} + 1)").alias("high"))


def error_bound(spark: SparkSession) -> DataFrame:
    """bound: the greatest relative error of a bucket's estimate at either of its ends."""
    mid = F.round(F.sqrt(F.col("low").cast("double") * F.col("high")))
    return bucket_table(spark).agg(F.max(F.greatest((mid - F.col("low")) / F.col("low"), (F.col("high") - 1 - mid) / (F.col("high") - 1))).alias("bound"))


def width_tolerance(ns: Column) -> Column:
    """The width of the bucket that a duration is in; 2^LOW_BITS below the first, 0 beyond the last."""
    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.length(F.bin(ns)) - 1).cast("int"))
    return F.when(ns < 1 << LOW_BITS, 1 << LOW_BITS).when(ns >= 1 << HIGH_BITS, 0).otherwise(F.ceil(low / PARTS)).cast("long")


def out_of_range(spans: DataFrame) -> DataFrame:
    """under, over: observations that only the first and the last bucket hold."""
    return spans.where("ns >= 0").agg(F.count_if(F.col("ns") < 1 << LOW_BITS).alias("under"), F.count_if(F.col("ns") >= 1 << HIGH_BITS).alias("over"))


# long-format measurements: seq, name, tags (a map), value


def taxonomy(events: DataFrame) -> DataFrame:
    """seq, kind_of (counter, histogram), name, tags, value: what each lifecycle event adds to."""
    tags = lambda *names: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.coalesce(F.col(n), F.lit("")) for n in names]))
    one = lambda when, name, t, value=F.lit(1.0), kind="counter": F.when(F.col("event") == when, F.struct(F.lit(kind).alias("kind_of"), F.lit(name).alias("name"), t.alias("tags"), value.alias("value")))
    seconds = F.col("duration_us") / 1e6
    made = F.array(
        one("claim", "jobs_claimed", tags("queue")), one("start", "jobs_started", tags("kind", "queue")), one("finish", "jobs_finished", tags("kind", "outcome")),
        one("finish", "job_seconds", tags("kind"), seconds, "histogram"), one("retry", "jobs_retried", tags("kind")),
    )
    found = F.filter(made, lambda x: x.isNotNull())
    return events.select("seq", F.explode(found).alias("m")).select("seq", "m.*")


def series_key(name: str = "name", tags: str = "tags") -> Column:
    """name and the tags in the order of their keys, parted by NUL."""
    pairs = F.array_sort(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("\0"), e["value"])))
    return F.array_join(F.concat(F.array(F.col(name)), pairs), "\0")


def summaries(measured: DataFrame) -> DataFrame:
    """series, n, total."""
    return measured.groupBy(series_key().alias("series")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def bucketed(measured: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """series, le, cumulative of each bound and +Inf: observations of le or less; those beyond the last bound are in +Inf only."""
    counted = [F.count_if(F.col("value") <= b).alias(f"b{k}") for k, b in enumerate(bounds)]
    sums = measured.groupBy(series_key().alias("series")).agg(*counted, F.count("*").alias("n"))
    cells = [F.struct(F.lit(_float(b)).alias("le"), F.col(f"b{k}").alias("cumulative")) for k, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("cumulative"))]
    return sums.select("series", F.explode(F.array(*cells)).alias("c")).select("series", "c.le", "c.cumulative")


def _float(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(x)


def interpolated_quantile(cells: DataFrame, q: float) -> DataFrame:
    """series, value: the q-quantile of cumulative buckets, linear inside a bucket; in +Inf it is the last finite bound."""
    w = Window.partitionBy("series").orderBy("bound")
    finite = F.when(F.col("le") != "+Inf", F.col("le").cast("double"))
    c = cells.withColumn("bound", F.coalesce(finite, F.lit(float("inf")))).withColumn("below", F.coalesce(F.lag("cumulative").over(w), F.lit(0))).withColumn("start", F.coalesce(F.lag("bound").over(w), F.lit(0.0)))
    c = c.withColumn("total", F.max("cumulative").over(Window.partitionBy("series"))).withColumn("rank", F.lit(q) * F.col("total"))
    hit = c.where((F.col("cumulative") >= F.col("rank")) & (F.col("total") > 0))
    first = hit.groupBy("series").agg(F.min(F.struct("bound", "start", "below", "cumulative", "rank")).alias("h"))
    h = F.col("h")
    inside = F.when(h["cumulative"] == h["below"], h["start"]).otherwise(h["start"] + (h["bound"] - h["start"]) * (h["rank"] - h["below"]) / (h["cumulative"] - h["below"]))
    return first.select("series", F.when(h["bound"] == float("inf"), h["start"]).otherwise(inside).alias("value"))


def admitted(measured: DataFrame, most: int) -> DataFrame:
    """series, n, refused of all series: those first seen once `most` others were there are refused, call by call.

    Only one row for each series goes through the window that ranks them.
    """
    per = measured.groupBy(series_key().alias("series")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy("first", "series"))).select("series", "n", (F.col("rank") > most).alias("refused"))


def escaped_label(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def exposition(measured: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """place, line of the text format: a type line for each name, then its series in order; histograms as cumulative buckets."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit('="'), escaped_label(e["value"]), F.lit('"'))), ",")
    keyed = measured.withColumn("labels", labels)
    plain = keyed.where("kind_of = 'counter'").groupBy("name", "labels").agg(F.sum("value").cast("bigint").cast("string").alias("v"))
    lines = plain.select("name", F.lit("counter").alias("type"), F.concat("name", F.lit("{"), "labels", F.lit("} "), "v").alias("line"), F.concat("labels", F.lit("0")).alias("sub"))
    cells = keyed.where("kind_of = 'histogram'").groupBy("name", "labels").agg(*[F.count_if(F.col("value") <= b).alias(f"b{k}") for k, b in enumerate(bounds)], F.count("*").alias("n"))
    cell = [(f"{k:03d}", _float(b), f"b{k}") for k, b in enumerate(bounds)] + [(f"{len(bounds):03d}", "+Inf", "n")]
    rows = [F.struct(F.lit(at).alias("at"), F.concat("name", F.lit("_bucket{"), "labels", F.lit(f',le="{le}"}} '), F.col(c).cast("string")).alias("line")) for at, le, c in cell]
    rows.append(F.struct(F.lit("zzz").alias("at"), F.concat("name", F.lit("_count{"), "labels", F.lit("} "), F.col("n").cast("string")).alias("line")))
    of_hist = cells.select("name", "labels", F.explode(F.array(*rows)).alias("r")).select("name", F.lit("histogram").alias("type"), F.col("r.line").alias("line"), F.concat("labels", "r.at").alias("sub"))
    both = lines.unionByName(of_hist)
    heads = both.select("name", "type").distinct().select("name", "type", F.concat(F.lit("# TYPE "), "name", F.lit(" "), "type").alias("line"), F.lit("").alias("sub"))
    every = both.unionByName(heads)
    # the text of one export: as many rows as series have cells
    return every.select((F.row_number().over(Window.orderBy("name", "sub", "line")) - 1).alias("place"), "line")
