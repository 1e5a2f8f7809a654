"""Mixing sources to target weights by entropy balancing.

Every source has a token target. Among all document rates the mix takes those closest to one
(in Kullback-Leibler divergence, at most CAP) that meet the target: rates exp(lambda * size / scale)
with one multiplier per source, cut at CAP. The convex dual is solved for all sources at once by
Newton steps kept inside a bracket; each step is one distributed aggregation over the table of
distinct (source, size) with counts, which holds everything a rate depends on, so a source with a
third of all rows weighs no more than another. A source that has not settled after STEPS steps is an
error. Rates are then rounded into whole copies: the fraction of a rate against a hash of doc_id,
with a shift per source that histograms of the differences determine. What a source's copies still
miss or exceed is nudged: again and again the copy of one document is added or taken away whose size
comes nearest to it, while that brings the source nearer to its target, NUDGES times at most; so a
source ends within half of its shortest document that can still be added or left out, unless the
last nudge was needed.

Only DataFrame functions are used. Defined cases: a null text has size 0 and is taken in no words;
a null source is a source, the last; sources without words have target 0; repeated rows are rounded
alike; null doc_ids hash alike; texts of any length are counted whole; columns of any name pass
through mixed(); an empty table gives no rows; reruns agree (multipliers are rounded to nine digits,
all sums of words are of integers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_position, discard, materialize, parted, table

CAP, STEPS, TOLERANCE = 3, 60, 1e-6
#: Copies that are added or taken away in each source after rounding, at most.
NUDGES = 8
#: Bins of a rounding histogram; histograms one inside another for all documents, and passes that
#: fill what is missing with documents no larger than that.
BINS, LEVELS, FILLS = 4096, 3, 3


def words(text: Column) -> Column:
    """Number of words of a whole text; null has none."""
    return F.size(parted(text)).cast("long")


def running(df: DataFrame, order: list[Column], **columns: Column) -> DataFrame:
    """df with the sum of each column over all rows that come before in the order, 0 for the first.
    Rows are dealt by ranges of the order, so no task gets them all: the sums of whole ranges (one
    row for each) are added to those within a range."""
    x = df.repartitionByRange(*order).withColumns({f"_{k}": c.cast("long") for k, c in columns.items()})
    x = materialize(x.withColumn("_range", F.spark_partition_id()), "mix-ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = x.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in columns])
    ranges = ranges.select("_range", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in columns])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(F.broadcast(ranges), "_range")  # a row for each partition
    return x.select(*df.columns, *[(F.col(f"_before_{k}") + F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0))).alias(k) for k in columns])


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: sources by code point, null last, weigh 1, 2, 3, repeating, and
    share all words; a target stops at CAP times its source's size and the excess goes to the
    others by weight. This is the level at which min(CAP * size, level * weight) sums to the total,
    found with running sums over the sources in the order in which they reach their cap."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = F.col("source").asc_nulls_last()
    per = running(per, [by_name], place=F.lit(1)).withColumn("weight", F.pmod("place", F.lit(3)) + 1)
    per = per.withColumn("full_at", CAP * F.col("source_size") / F.col("weight"))
    per = materialize(running(per, [F.col("full_at").asc(), by_name], caps=CAP * F.col("source_size"), weights=F.col("weight")), "mix-sources")
    total = per.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left, weight_left = F.lit(float(total["size"] or 0)) - F.col("caps"), F.lit(total["weight"] or 0) - F.col("weights")
    # the level is reached at the first source whose cap lies above it
    at = per.where(F.col("full_at") * weight_left >= left).agg(F.min_by(left / weight_left, F.struct("full_at", -weight_left))).first()[0]
    cap = (CAP * F.col("source_size")).cast("double")
    return per.select("source", "source_size", (cap if at is None else F.least(cap, F.lit(at) * F.col("weight"))).alias("target"))


def _rate(multiplier: Column, x: Column) -> Column:
    return F.least(F.lit(float(CAP)), F.exp(F.least(multiplier * x, F.lit(50.0))))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def multipliers(histogram: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, source_size, target, scale, multiplier by Newton steps on the dual, for all sources.
    histogram: (source, size, n)."""
    scale = histogram.groupBy("source").agg((F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")) / F.sum(F.col("n") * F.col("size"))).alias("scale"), F.min("size").alias("least"))
    w = wanted.select(F.col("source").alias("s"), "source_size", "target")
    state = scale.join(w, _same("source", "s")).drop("s").select(
        "source", "source_size", "target", "scale",
        F.coalesce(F.log(F.when(F.col("target") > 0, F.col("target")) / F.col("source_size")), F.lit(0.0)).alias("x"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"),
        (F.col("source_size") == 0).alias("done"),
    )
    state = materialize(state, "mix-state")
    live = F.col("target") < F.col("source_size") * CAP * (1 - 1e-12)
    for step_ in range(STEPS + 1):
        if (waiting := state.where(~F.col("done")).count()) == 0:
            break
        if step_ == STEPS:
            raise RuntimeError(f"{waiting} sources have not settled after {STEPS} Newton steps")
        s = state.where(live & ~F.col("done")).select(F.col("source").alias("s"), "x", "scale")
        m = F.col("x") * F.col("size") / F.col("scale")
        r = _rate(F.col("x"), F.col("size") / F.col("scale"))
        sums = histogram.where("size > 0").join(s, _same("source", "s")).groupBy("s").agg(
            F.sum(F.col("n") * F.col("size") * r).alias("f"),
            F.sum(F.when(m < F.log(F.lit(float(CAP))), F.col("n") * F.col("size") * (F.col("size") / F.col("scale")) * r).otherwise(0.0)).alias("slope"),
        )
        j = state.join(sums, _same("source", "s"), "left").drop("s")
        lo = F.when(F.col("f") < F.col("target"), F.col("x")).otherwise(F.col("lo"))
        hi = F.when(F.col("f") >= F.col("target"), F.col("x")).otherwise(F.col("hi"))
        step = F.col("x") + F.when(F.col("slope") > 0, (F.log("target") - F.log("f")) * F.col("f") / F.col("slope"))
        inside = (step > lo) & (step < hi)
        far = F.when(F.col("f") < F.col("target"), F.least((lo + hi) / 2, F.abs(lo) * 2 + 1)).otherwise(F.greatest((lo + hi) / 2, -F.abs(hi) * 2 - 1))
        near = F.abs(F.col("f") - F.col("target")) <= TOLERANCE * F.col("target")
        done = F.col("done") | F.col("f").isNull() | near | (F.col("target") <= 0)
        last, state = state, materialize(j.select("source", "source_size", "target", "scale", F.when(done, F.col("x")).otherwise(F.when(inside, step).otherwise(far)).alias("x"), lo.alias("lo"), hi.alias("hi"), done.alias("done")), "mix-state")
        discard(last)
    return state.select("source", "source_size", "target", "scale", F.when(live, F.round("x", 9)).alias("multiplier"))


def _advance(x: DataFrame, at: DataFrame) -> DataFrame:
    """Moves low of every source past the whole bins of [low, low + width) whose documents of at
    most limit words are still missing; width becomes that of the bin in which they are reached."""
    a = at.select(F.col("source").alias("s"), "low", "width", "limit")
    own = x.join(a, _same("source", "s")).where((F.col("size") <= F.col("limit")) & (F.col("v") >= F.col("low")))
    own = own.withColumn("bin", F.floor((F.col("v") - F.col("low")) / F.col("width") * BINS)).where(F.col("bin") < BINS)
    run = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = own.groupBy("s", "bin").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(run))
    bins = bins.join(at.select("source", "missing"), _same("source", "s"))
    fits = F.col("upto") <= F.col("missing")
    reached = bins.groupBy("s").agg(F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("got"), F.min(F.when(~fits, F.col("bin"))).alias("next"))
    step = F.col("width") / BINS
    return at.join(reached, _same("source", "s"), "left").select(
        "source",
        (F.col("missing") - F.coalesce("got", F.lit(0))).alias("missing"),
        (F.col("low") + F.coalesce(F.col("next") * step, F.col("width"))).alias("low"),
        F.when(F.col("next").isNull(), F.lit(1e-12)).otherwise(step).alias("width"),
        "limit",
    )


def nudged(x: DataFrame) -> DataFrame:
    """x(doc_id, row_key, source, size, target, copies) -> source, doc_id, row_key, change: the copies that
    bring each source nearer to its target. A few documents stand for all of a size and number of
    copies (NUDGES of them, as no more can be taken), so the rounds run over a table like the histogram;
    equal rows change together."""
    sums = x.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("missing"))
    rest = materialize(sums, "mix-missing")
    rows = x.where("size > 0").groupBy("source", "size", "copies", "doc_id", "row_key").agg(F.count("*").alias("m"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "row_key"))
    place = F.row_number().over(Window.partitionBy("source", "size", "copies", "m").orderBy("h", "doc_id", "row_key"))
    cells = rows.withColumn("place", place).where(F.col("place") <= NUDGES)
    way = F.explode(F.array(F.when(F.col("copies") < CAP, F.lit(1)), F.when(F.col("copies") > 0, F.lit(-1)))).alias("change")
    cells = cells.select("source", "h", "doc_id", "row_key", (F.col("size") * F.col("m")).alias("words"), way).where("change is not null")
    cells = materialize(cells, "mix-cells")
    found = materialize(cells.select("source", "doc_id", "row_key", "change", "words").limit(0), "mix-nudges")
    for _ in range(NUDGES):  # the same plan each time, whose code is compiled once
        r = rest.select(F.col("source").alias("s"), "missing")
        used = found.select(F.col("source").alias("u"), F.col("doc_id").alias("d"), F.col("row_key").alias("k"))
        free = cells.join(used, _same("source", "u") & _same("doc_id", "d") & (F.col("row_key") == F.col("k")), "left_anti")
        after = F.abs(F.col("missing") - F.col("change") * F.col("words"))
        near = free.join(r, _same("source", "s")).withColumn("after", after).where(F.col("after") < F.abs("missing") - 1e-6)
        best = near.groupBy("source").agg(F.min(F.struct("after", "h", "change", "doc_id", "row_key", "words")).alias("b"))
        best = materialize(best.select("source", "b.doc_id", "b.row_key", "b.change", "b.words"), "mix-nudge")
        if best.isEmpty():
            break
        b = best.select(F.col("source").alias("s"), (F.col("change") * F.col("words")).alias("moved"))
        last, rest = (found, rest), materialize(rest.join(b, _same("source", "s"), "left").select("source", (F.col("missing") - F.coalesce("moved", F.lit(0))).alias("missing")), "mix-missing")
        found = materialize(found.unionByName(best), "mix-nudges")
        discard(*last, best)
    discard(cells, rest)
    return found.groupBy("source", "doc_id", "row_key").agg(F.sum("change").alias("change"))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """One row per row of docs: doc_id, row_key, source, size, source_size, target, rate, copies."""
    # the texts are read once
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))
    held = materialize(held, "mix-sizes")
    histogram = materialize(held.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    state = multipliers(histogram, targets(histogram.select("source", (F.col("size") * F.col("n")).alias("size"))))
    s = state.select(F.col("source").alias("s"), "source_size", "target", "scale", "multiplier")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("multiplier").isNull(), F.lit(float(CAP))).otherwise(_rate(F.col("multiplier"), F.col("size") / F.col("scale")))
    x = held.join(s, _same("source", "s")).drop("s").withColumn("rate", rate)
    x = x.withColumn("whole", F.floor("rate").cast("long"))
    u = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11) / float(1 << 53)
    # an extra copy is taken where v < shift: v in (0, 2), shift near 1
    v = F.when((F.col("whole") < CAP) & (F.col("size") > 0), u - (F.col("rate") - F.col("whole")) + 1.0)
    x = materialize(x.withColumn("v", v), "mix-rates")
    discard(held)
    sums = x.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"), F.max("target").alias("target"))
    missing = (F.col("target") - F.col("sure")).alias("missing")
    at = materialize(sums.select("source", missing, F.lit(0.0).alias("low"), F.lit(2.0).alias("width"), F.lit(1 << 62).alias("limit")), "mix-shift")
    shifts = []
    for k in range(LEVELS + FILLS):
        if k >= LEVELS:  # on from the place reached, with documents that still fit
            at = at.select("source", "missing", "low", (F.lit(2.0) - F.col("low")).alias("width"), F.floor("missing").alias("limit"))
        at = materialize(_advance(x, at), "mix-shift")
        if k >= LEVELS - 1:
            shifts.append(at.select(F.col("source").alias("s"), F.col("low").alias(f"shift{k}"), F.col("limit").alias(f"limit{k}")))
    taken, full = F.lit(False), x
    for k, own in enumerate(shifts, LEVELS - 1):
        x = x.join(own, _same("source", "s")).drop("s")
        taken = taken | ((F.col("v") < F.col(f"shift{k}")) & (F.col("size") <= F.col(f"limit{k}")))
    copies = F.col("whole") + F.when(taken, F.lit(1)).otherwise(F.lit(0))
    x = x.select("doc_id", "row_key", "source", "size", "source_size", "target", "rate", F.when(F.col("size") == 0, F.lit(1)).otherwise(copies).cast("long").alias("copies"))
    x = materialize(x, "mix-rounded")
    discard(full)
    n = nudged(x).select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("row_key").alias("k"), "change")
    x = x.join(n, _same("source", "s") & _same("doc_id", "d") & (F.col("row_key") == F.col("k")), "left")
    return x.select("doc_id", "row_key", "source", "size", "source_size", "target", "rate", (F.col("copies") + F.coalesce("change", F.lit(0))).cast("long").alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it. Texts do not move unless the
    table of rows that are not taken once is too large to send to every task."""
    plain, names, at = by_position(docs)
    decided = materialize(mix(plain.select(*[F.col(at[c]).alias(c) for c in ("doc_id", "text", "source")])), "mix-copies")
    other = decided.where("copies <> 1").groupBy("doc_id", "row_key").agg(F.max("copies").alias("copies"))
    other = other.select(F.col("doc_id").alias("mix_id"), F.col("row_key").alias("mix_key"), "copies")
    on = plain[at["doc_id"]].cast("long").eqNullSafe(other["mix_id"]) & (F.xxhash64(plain[at["text"]]) == other["mix_key"])
    x = plain.join(other, on, "left").withColumn("copies", F.coalesce("copies", F.lit(1))).where("copies > 0")
    x = x.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return x.select(*plain.columns).toDF(*names)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it. Nulls, empty and long texts, ties, repeated rows, empty tables and further columns: as the
    module says."""
    got = mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
