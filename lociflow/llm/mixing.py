"""Mixing sources to target weights by entropy balancing; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, null_key

#: Document priorities are integers below 2**60 that are found by levels of bins of 12 bits each.
BITS, LEVEL = 60, 12
#: Rounds in which one document of each source changes sides to bring the source nearer to its target.
REPAIRS = 3
#: Rows of a table of one row per source up to which it is broadcast; larger ones are joined by shuffling.
FEW_SOURCES = 10_000


def word_count(text: str = "text") -> Column:
    """Number of runs of characters that are not ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cyclic_targets(totals: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``target`` for each row of ``totals(k, source, source_size)``.

    Sources by code point, nulls last, weigh ``weights`` in turn and divide ``share`` times all sizes by weight; a target stops at ``most`` times
    its source's size and the excess goes to the others by weight until none is above. With sources ordered by size over weight,
    the level c at which exactly the first ones are full solves this in one pass: target = min(most x size, c x weight).
    The windows here run over one row per source.
    """
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    t = totals.withColumn("weight", cycle).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns(
        {
            "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "all": F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy(F.lit(1))),
        }
    ).withColumn("level", (F.col("all") - F.col("full")) / F.col("open"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.min(F.struct(F.when(fits.isNotNull(), 0).otherwise(1).alias("o"), F.col("cap") / F.col("weight"), fits.alias("level"))).over(Window.partitionBy(F.lit(1)))["level"]
    return t.withColumn("c", level).select("k", "source", "source_size", F.least("cap", F.coalesce(F.col("c") * F.col("weight"), F.col("cap"))).alias("target"))


def multipliers(spark: SparkSession, sizes: DataFrame, targets: DataFrame, most: float, scratch: Scratch, small, rounds: int = 40, near: float = 1e-7) -> DataFrame:
    """``(k, source_size, target, mean, multiplier)``: the dual variable of each source's token constraint, by Newton's method.

    The rates r of documents least far from 1, by the sum of r log r - r + 1, whose tokens r x size add up to a target and that are ``most`` at most, are r = min(most, exp(l x size / mean)): the dual is convex
    in the multiplier l, its gradient the tokens so given less the target, its Hessian the sum of size x size / mean x r over the documents below the bound. Each round is a distributed sum over
    ``sizes(k, size, n)``, and all sources step at once; a step that leaves the bracket of the root is halved into it. The multiplier is null where nothing is due or the bound is reached by all.
    """
    state = targets.withColumns({"mean": F.col("source_size") / F.col("n_docs"), "open": (F.col("target") > 0) & (F.col("target") < most * F.col("source_size"))})
    start = F.when(F.col("open"), F.log(F.col("target") / F.col("source_size"))).otherwise(0.0)
    state = scratch.write(state.withColumns({"l": start, "lo": F.lit(float("-inf")), "hi": F.lit(float("inf")), "off": F.lit(float("inf"))}))
    for _ in range(rounds):
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(most)), F.exp(F.least(F.col("l") * x, F.lit(700.0))))
        inside = F.when(F.col("l") * x < F.log(F.lit(float(most))), F.col("n") * F.col("size") * x * rate).otherwise(0.0)
        sums = sizes.join(small(state.where("open").select("k", "mean", "l")), "k").groupBy("k").agg(F.sum(F.col("n") * F.col("size") * rate).alias("given"), F.sum(inside).alias("slope"))
        s = state.join(sums, "k", "left").withColumns({"off": F.coalesce(F.col("given") - F.col("target"), F.lit(0.0))})
        s = s.withColumns({"lo": F.when(F.col("off") < 0, F.col("l")).otherwise(F.col("lo")), "hi": F.when(F.col("off") > 0, F.col("l")).otherwise(F.col("hi"))})
        step = F.col("l") - F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.when(F.col("slope") > 0, F.col("off") / F.col("slope")).otherwise(4 * F.signum("off"))))
        middle = F.when((F.col("lo") > float("-inf")) & (F.col("hi") < float("inf")), (F.col("lo") + F.col("hi")) / 2).otherwise(step)
        s = s.withColumn("l", F.when(F.col("off") == 0, F.col("l")).when((step > F.col("lo")) & (step < F.col("hi")), step).otherwise(middle)).drop("given", "slope")
        new = scratch.write(s)
        scratch.drop(state)
        state = new
        worst = state.agg(F.max(F.abs("off") / F.greatest("target", F.lit(1.0)))).first()[0]
        if worst is None or worst <= near:
            break
    return state.select("k", "source_size", "target", "mean", F.when(F.col("open"), F.col("l")).alias("multiplier"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """``(doc_id, source, size, source_size, target, rate, copies, taken)`` of every row.

    Entropy balancing: each document's rate is the exponential tilt of ``multipliers`` by its own size. Rates become whole copies: a document
    gets the whole part, and one more if its priority is at or below a threshold of its source. Priorities are a hash of id and text over the rate's remainder, so that documents are taken in
    proportion to it. The threshold is where the running total of sizes by priority comes nearest to the words still due; it is found through levels of binned sums, so that no source is sorted or
    gathered, and ``REPAIRS`` documents per source then change sides where that brings the total nearer. Copies never exceed ``most``.

    A null text has size 0; null sources form a source of their own; documents of size 0 and sources of target 0 contribute nothing. Repeated rows and ids, null ids too, are
    kept: equal rows are told apart by a number of their own, so that as many of them are taken as come nearest to the target. An empty table gives no rows. The result depends on the rows alone,
    not on their order; columns of other names are ignored.
    """
    scratch = Scratch(spark, "mixing")
    chance = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 24) + 0.5) / float(1 << 40)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), null_key(source_col).alias("k"), word_count(text_col).alias("size"), chance.alias("chance"))
    rows = scratch.write(rows.withColumn("number", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 14))))
    sizes = scratch.write(rows.groupBy("k", "size").agg(F.count("*").alias("n"), F.min("source").alias("source")))
    totals = scratch.write(sizes.groupBy("k").agg(F.min("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs")))
    targets = cyclic_targets(totals, weights, share, most).join(totals.select("k", "n_docs"), "k")
    few = totals.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    small = F.broadcast if few else (lambda table: table)  # a table of one row per source
    targets = multipliers(spark, sizes, targets, most, scratch, small)

    rate = F.when(F.col("multiplier").isNotNull(), F.least(F.lit(float(most)), F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("mean"), F.lit(700.0))))).when(F.col("target") > 0, float(most)).otherwise(0.0)
    rows = rows.join(small(targets), "k").withColumn("rate", F.round(rate, 12)).withColumn("whole", F.floor("rate").cast("int")).withColumn("rest", F.col("rate") - F.col("whole"))
    # 45 bits of chance over the remainder, which for a threshold is about 1, and 14 of the row's number
    order = F.when(F.col("rest") > 0, F.least((F.col("chance") / F.col("rest") * float(1 << 40)).cast("long"), F.lit((1 << 45) - 1)))
    rows = scratch.write(rows.withColumn("u", F.shiftleft(order, 14) + F.col("number")).drop("chance", "number", "rest", "mean", "multiplier"))
    due = scratch.write(rows.groupBy("k").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("due")))
    rows = rows.join(small(due), "k")
    open_rows = rows.where("u is not null and size > 0")

    # where the running total by priority passes what is due: in each level's bins within the last one's
    passed = due.select("k", "due", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("bin"))
    for bits in range(BITS - LEVEL, -1, -LEVEL):
        near = small(passed).select("k", F.col("bin").alias("outer"), "before")
        part = open_rows.withColumn("bin", F.shiftright("u", bits)).join(near, "k").where(F.shiftright("bin", LEVEL) == F.col("outer"))
        sums = part.groupBy("k", "bin").agg(F.sum("size").alias("inside"), F.first("before").alias("before"), F.first("due").alias("due"))
        running = F.sum("inside").over(Window.partitionBy("k").orderBy("bin"))
        sums = sums.withColumn("upto", F.col("before") + running).where(F.col("upto") >= F.col("due"))
        passed = scratch.write(sums.groupBy("k").agg(F.min(F.struct("bin", "upto", (F.col("upto") - F.col("inside")).alias("before"), "due")).alias("x")).select("k", "x.bin", "x.upto", "x.before", "x.due"))
    # without a passing bin all open rows are taken
    over = F.abs(F.col("upto") - F.col("due")) <= F.abs(F.col("before") - F.col("due"))
    limits = scratch.write(passed.select("k", (F.col("bin") - F.when(over, 0).otherwise(1)).alias("limit")))

    is_open = F.col("u").isNotNull()
    taken = F.when(is_open & (F.col("due") > 0) & (F.col("u") <= F.coalesce("limit", F.lit((1 << BITS) - 1))), 1).otherwise(0)
    chosen = scratch.write(rows.join(small(limits), "k", "left").withColumn("more", taken).drop("limit"))
    for _ in range(REPAIRS):
        off = scratch.write(chosen.groupBy("k").agg((F.first("due") - F.sum(F.col("more") * F.col("size"))).alias("off")))
        change = F.when(F.col("more") == 1, -F.col("size")).otherwise(F.when(is_open, F.col("size")))
        left = F.abs(F.col("off") - change)
        best = chosen.join(small(off), "k").where(left < F.abs("off")).groupBy("k").agg(F.min(F.struct(left.alias("left"), F.col("u"), F.col("size"))).alias("x"))
        flip = scratch.write(best.select("k", F.col("x.u").alias("flip_u"), F.col("x.size").alias("flip_size")))
        hit = (F.col("u") == F.col("flip_u")) & (F.col("size") == F.col("flip_size"))
        # rows of one priority and size would change sides together
        alone = scratch.write(chosen.join(small(flip), "k").where(hit).groupBy("k", "flip_u", "flip_size").agg(F.count("*").alias("n")).where("n = 1").drop("n"))
        if not alone.limit(1).count():
            break
        new = scratch.write(chosen.join(small(alone), "k", "left").withColumn("more", F.when(hit, 1 - F.col("more")).otherwise(F.col("more"))).drop("flip_u", "flip_size"))
        scratch.drop(chosen)
        chosen = new
    scratch.drop_all_but(chosen)
    copies = F.col("whole") + F.col("more")
    return chosen.select("doc_id", "source", "size", "source_size", "target", "rate", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
