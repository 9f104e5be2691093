"""URL rules by a sort-merge range join, in DataFrame functions only.

Hosts are written with their labels reversed and a closing dot (``a.example.org``: ``org.example.a.``),
so a rule's host and all its subdomains are one interval of keys; a path prefix is one as well. URLs
and interval starts are dealt over ranges of keys, sorted, and swept: a running window holds, for each
nesting depth, the interval opened last, which is the stack of open rules, as intervals of one depth
don't overlap. Hosts are swept first, then the paths under each host that fits.

Ranges are cut by keys of a hashed sample; as a URL's sort key ends with a hash of its row, a host with
any share of all rows is cut as well. An interval goes into each range that it meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import lower_ascii, materialize

#: Sampled keys for each range; they only even out the ranges.
SAMPLE = 32
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_key(host: Column) -> Column:
    return F.encode(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")), "UTF-8")


def cuts(points: DataFrame, ranges: int) -> list[bytes]:
    """At most ``ranges`` - 1 keys that split the points evenly: the keys of the smallest hashes, sorted. Bounded by ``ranges`` alone."""
    taken = points.select("at").orderBy(F.xxhash64("at"), "at").limit(ranges * SAMPLE).collect()
    keys = sorted(bytes(r["at"]) for r in taken)
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def range_of(key: Column, bounds: list[bytes]) -> Column:
    """How many bounds are not above ``key``: a search of a root's worth of bounds, then of one group of them."""
    if not bounds:
        return F.lit(0)
    step = int(len(bounds) ** 0.5) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    lit = lambda b: F.lit(bytearray(b))
    heads = F.array(*[lit(g[0]) for g in groups])
    table = F.array(*[F.array(*map(lit, g)) for g in groups])
    group = F.size(F.filter(heads, lambda b: b <= key))
    return F.when(group == 0, 0).otherwise((group - 1) * step + F.size(F.filter(F.element_at(table, F.greatest(group, F.lit(1))), lambda b: b <= key)))


def sweep(points: DataFrame, intervals: DataFrame, ranges: int) -> DataFrame:
    """Give each point the intervals around it, outermost first.

    ``points`` have a binary ``key`` and a string ``tie``, that tells rows with one key apart;
    ``intervals`` have a binary ``prefix``, unique, and a ``payload``. Adds ``stack``, the payloads of
    the prefixes of ``key``.
    """
    columns = points.columns
    points = points.withColumn("at", F.concat("key", F.lit(bytearray(b"\0")), F.unhex(F.lpad(F.hex(F.xxhash64("tie")), 16, "0"))))
    bounds = cuts(points, ranges)
    shut = F.concat("prefix", F.lit(bytearray(b"\xff")))  # above all that begins with the prefix: no UTF-8 has this byte
    spread = intervals.withColumn("range", F.explode(F.sequence(range_of(F.col("prefix"), bounds), range_of(shut, bounds))))
    both = spread.select("range", "payload", "prefix", F.col("prefix").alias("at"), F.lit(1).alias("step")).unionByName(spread.select("range", "payload", "prefix", shut.alias("at"), F.lit(-1).alias("step")))
    running = Window.partitionBy("range").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0)
    starts = materialize(both.withColumn("depth", F.sum("step").over(running)).filter("step = 1").select("range", "at", "depth", F.struct("prefix", "payload").alias("open")))
    depth = starts.agg(F.max("depth").alias("d")).first()["d"] or 0
    kind = points.schema
    missing = [F.lit(None).cast(kind[c].dataType).alias(c) for c in columns]
    events = starts.select("range", "at", F.lit(0).alias("kind"), "depth", "open", *missing).unionByName(
        points.select(range_of(F.col("at"), bounds).alias("range"), "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast(starts.schema["open"].dataType).alias("open"), *columns)
    )
    sweeping = Window.partitionBy("range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    slots = {f"slot{d}": F.last(F.when(F.col("depth") == d, F.col("open")), ignorenulls=True).over(sweeping) for d in range(1, depth + 1)}
    swept = events.withColumns(slots).filter("kind = 1")
    fits = [F.when(F.startswith(F.col("key"), F.col(f"{s}.prefix")), F.col(f"{s}.payload")) for s in slots]
    if not fits:
        return points.select(*columns, F.array().cast(f"array<{intervals.schema['payload'].dataType.simpleString()}>").alias("stack"))
    return swept.select(*columns, F.array_compact(F.array(*fits)).alias("stack"))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``rules`` (host, path, verdict): a rule fits its host and all subdomains if the path begins with
    its path; the longest rule (host and path together, then the host) wins; where one rule is given
    both verdicts, ``block`` holds. Without a rule that fits, rule is null and verdict ``default``. A
    null url or one without ``://`` has an empty host and path and so fits no rule. Repeated rows are
    judged once and returned as often as they came; empty tables are fine; further columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = rules.select(lower_ascii("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host IS NOT NULL AND host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = known.withColumn("hkey", host_key(F.col("host")))
    url = F.coalesce("url", F.lit(""))
    rows = pages.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.select("*", lower_ascii(F.regexp_extract(url, URL, 1)).alias("host"), F.regexp_extract(url, URL, 2).alias("path"))
    rows = rows.select("*", host_key(F.col("host")).alias("key"), F.concat_ws(" ", F.col("page_id").cast("string"), url).alias("tie"))
    hosts = known.select(F.col("hkey").alias("prefix"), F.col("hkey").alias("payload")).distinct()
    slash = F.lit(bytearray(b"/"))
    fitting = materialize(sweep(rows, hosts, ranges).select("page_id", "url", "copies", "host", "path", "tie", F.explode_outer("stack").alias("hkey")))
    of_host = fitting.filter("hkey IS NOT NULL").withColumn("key", F.concat("hkey", slash, F.encode("path", "UTF-8"))).drop("hkey")
    name = F.concat("host", "path")
    paths = known.select(
        F.concat("hkey", slash, F.encode("path", "UTF-8")).alias("prefix"),
        F.struct(F.length(name).alias("n"), F.length("host").alias("h"), F.col("verdict").alias("verdict"), name.alias("rule")).alias("payload"),
    )
    best = sweep(of_host, paths, ranges).select("page_id", "url", "copies", "host", "path", F.try_element_at("stack", F.lit(-1)).alias("best"))
    none = fitting.filter("hkey IS NULL").select("page_id", "url", "copies", "host", "path", F.lit(None).cast(best.schema["best"].dataType).alias("best"))
    whole = best.unionByName(none).groupBy("page_id", "url", "copies", "host", "path").agg(F.max("best").alias("best"))
    return whole.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
