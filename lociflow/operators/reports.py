"""Figures about the store and its server: intervals, recent ids, subsets and readable names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the codes of server figures and what they mean, in the order in which they are replaced. Fixed values.
READABLE = (
    ("content|activity|guid", "sequence identifier"),
    ("server|mstat|", "fn4 memory"),
    ("server|catwalk|", "catwalk comparison engine "),
    ("server|pcstat|n", "in-memory sequences (preComparer) "),
    ("server|scstat|n", "in-memory sequences (py_seqComparer) "),
    ("interval", "Interval between events (seconds) "),
    ("dstats|guid2neighbour|", "db, guid2neighbour collection (stores similar sequence pairs), "),
    ("dstats|guid2meta|", "db, guid2metadata collection (stores meta data about sequences), "),
    ("dstats|server_monitoring|", "db, server monitoring collection (stores server state information over time), "),
    ("avgObjSize", "Average record size (bytes)"),
    ("count", "Number of records"),
    ("storageSize", "Storage size used (bytes)"),
    ("totalIndexSize", "Total index size"),
    ("available", "Available RAM (bytes)"),
    ("free", "Free RAM (bytes)"),
    ("slab", "slab RAM (bytes)"),
    ("percent", "Percent RAM Used"),
    ("total", "Total system (bytes)"),
    ("used", "Used RAM (bytes)"),
)


def readable(header: Column) -> Column:
    """A code of a server figure in words: each known part is replaced, also within what earlier ones were replaced by, if the code itself holds it."""
    out = header
    for code, words in READABLE:
        out = F.replace(out, F.when(header.contains(code), F.lit(code)).otherwise(F.lit("\1")), F.lit(words))
    return out


def insert_deltas(events: DataFrame) -> DataFrame:
    """``(event_id, delta_usec)``: time to the next event less whole seconds, in microseconds; null for the last one. Events are in order within ranges of time, whose first ones are joined to the ranges before."""
    w = Window.partitionBy("day").orderBy("ts", "event_id")
    rows = events.select("event_id", "ts", F.to_date("ts").alias("day")).withColumn("next", F.lead("ts").over(w))
    firsts = rows.groupBy("day").agg(F.min("ts").alias("first"))
    after = firsts.withColumn("later", F.lead("first").over(Window.orderBy("day"))).select("day", "later")  # one row a day
    rows = rows.join(F.broadcast(after), "day")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return rows.select("event_id", F.pmod(micros(F.coalesce("next", "later")) - micros(F.col("ts")), F.lit(1_000_000)).alias("delta_usec"))


def recent_ids(events: DataFrame, most: int, key: str = "user_id") -> DataFrame:
    """The ``most`` ids with the newest events, newest first."""
    return events.groupBy(key).agg(F.max(F.struct("ts", "event_id")).alias("newest")).orderBy(F.desc("newest")).limit(most).select(key)


def first_ids(samples: DataFrame, most: int) -> DataFrame:
    """The first ``most`` ids in order: those that a model is trained on."""
    return samples.select("sample_id").orderBy("sample_id").limit(most)


def subset(events: DataFrame, column: str, values: list) -> DataFrame:
    return events.where(F.col(column).isin(values))


def columns_of(columns: list[str], stats: str, delta: bool) -> list[str]:
    """Names of telemetry columns of one kind of figures: those that end in |delta, or the absolute ones."""
    return [c for c in columns if c.startswith(f"server|{stats}|") and c.endswith("|delta") == delta]


def storage_audit(degree: DataFrame, samples: DataFrame) -> DataFrame:
    """``(kind, n_samples, n_links)``: samples by whether they have no neighbour, one or several, by the degrees of the linked ones, and how many links these have."""
    rows = samples.select("sample_id").join(degree, "sample_id", "left").select(F.coalesce("degree", F.lit(0)).alias("n"))
    kind = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "single").otherwise("several")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_samples"), F.sum("n").alias("n_links"))


def status(degree: DataFrame, samples: DataFrame, events: DataFrame, now: str) -> DataFrame:
    """One row: links, by the degrees of the linked samples, over 1 + samples, and seconds since the newest event at a given time."""
    ratio = degree.agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("n_edges")).join(samples.agg(F.count("*").alias("n_samples")))
    newest = events.agg(F.max("ts").alias("newest"))
    seconds = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / 1_000_000
    return ratio.join(newest).select(F.round(F.col("n_edges") / (1 + F.col("n_samples")), 9).alias("ratio"), F.round(seconds, 3).alias("seconds_since"))


def log_tail(lines: DataFrame, most: int) -> str:
    """The last lines of ``lines(number, value)``, joined for a web page."""
    rows = lines.orderBy(F.desc("number")).limit(most).collect()
    return "<br />".join(r["value"] for r in reversed(rows))
