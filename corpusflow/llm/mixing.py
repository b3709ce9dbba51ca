"""Operator 11: mixing sources to target weights by entropy balancing.

Of all rates whose words meet each source's target, with none above CAP, those of least relative entropy to "each document once" are
exponentially tilted by size: rate = min(CAP, exp(lambda * size / scale)). Their multipliers solve a convex dual, one constraint for
each source, by Newton steps kept inside a bracket; a step is one aggregate over the counts of each (source, size), so its cost
follows the distinct sizes and no source, however hot, is brought to one task. Rates become copies by ordered Poisson
rounding: a document's fraction is set against a hash of it, and those below the level at which their source's words are met get one copy
more. The level is found by histograms, BITS bits at a time; documents too long for what is left are passed over, the others may be gone through
again, and what stays open is closed by adding or leaving out single copies, each the one that comes nearest. Words are counted once and the texts are not shuffled; a source's state is one row of a table.

Defined cases: null and blank texts have size 0 and are taken once, for no words; a null source is a source, the last; a null doc_id is a document
like others; equal rows are judged alike, except for the copies that close a gap; sources of no words have target 0; very long texts are counted whole; an
empty table gives no rows; other columns are ignored, whatever their names. Two runs agree: everything follows
from hashes of doc_id and text, never from the order or the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm import _common as C

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often, and no source's target is above so many times its size.
CAP = 3
#: Newton steps end when every source meets its target to this share, or cannot come nearer in float64.
EXACT = 1e-9
STEPS = 60
#: Levels of the rounding are refined by BITS bits, ROUNDS times; ranks lie between 0 and 2.
BITS, ROUNDS = 12, 3
#: Times that the documents of a source are gone through.
PASSES = 6
_SCALE = float(1 << (BITS * ROUNDS - 1))
#: Documents that may close a source's gap after rounding.
FILLS = 6
NEAR = 1e-3


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a hash h in [0, 1) of docs(doc_id, text, source)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        (F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "text"), 11) / float(1 << 53)).alias("h"),
    )


def ranked(sources: DataFrame) -> DataFrame:
    """sources with place, from 0 in code-point order, null last: ranges, and a number inside each range."""
    parts = C.materialize(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "sources")
    before = parts.groupBy("_part").count().select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("_inside", inside).join(before, "_part").withColumn("place", F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources(source, source_size) with target: the sum of all sizes by weight, at most cap times a source's size, the excess to the others by weight."""
    weight: Column = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    state = C.materialize(ranked(sources).withColumns({"weight": weight, "stopped": F.lit(False)}), "weights")
    while True:
        free, weigh, total = state.agg(F.sum("source_size") - F.coalesce(F.sum(F.when(F.col("stopped"), cap * F.col("source_size"))), F.lit(0)), F.sum(F.when(~F.col("stopped"), F.col("weight"))), F.count("*")).first()
        share = F.lit(float(free or 0)) * F.col("weight") / F.lit(float(weigh or 1))
        now = state.withColumn("target", F.when(F.col("stopped"), F.lit(float(cap)) * F.col("source_size")).otherwise(share))
        above = ~F.col("stopped") & (F.col("target") > cap * F.col("source_size"))
        if not total or not now.where(above).limit(1).count():
            return now.select("source", "source_size", "target")
        state = C.materialize(now.withColumn("stopped", F.col("stopped") | above).drop("target"), "weights")


def _rate(lam: Column, full: Column, z: Column, cap: int) -> Column:
    return F.when(full, F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(lam * z)))


def multipliers(counts: DataFrame, state: DataFrame, cap: int = CAP) -> DataFrame:
    """state(source, source_size, target) with lam, scale and full, whether the source is taken cap times; counts(source, size, n) are its documents."""
    scale = counts.groupBy("source").agg(F.try_divide(F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")), F.sum(F.col("n") * F.col("size"))).alias("scale"))
    state = state.alias("s").join(scale.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source"))).select("s.*", F.coalesce("scale", F.lit(1.0)).alias("scale"))
    full = F.col("target") >= cap * F.col("source_size")
    state = C.materialize(state.withColumns({"full": full, "lam": F.lit(0.0), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "open": ~full}), "multipliers")
    for _ in range(STEPS):
        z = F.col("size") / F.col("scale")
        tilt = F.exp(F.col("lam") * z)
        words = F.col("n") * F.col("size")
        moved = state.where("open").alias("s").join(counts.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source"))).select("s.*", "c.size", "c.n")
        sums = moved.groupBy("source").agg(F.sum(words * F.least(F.lit(float(cap)), tilt)).alias("got"), F.sum(F.when(tilt < cap, words * z * tilt).otherwise(0.0)).alias("slope"))
        both = state.alias("s").join(sums.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")), "left").select("s.*", "got", "slope")
        off = F.col("got") - F.col("target")
        low, high = F.when(off < 0, F.col("lam")).otherwise(F.col("low")), F.when(off > 0, F.col("lam")).otherwise(F.col("high"))
        both = both.withColumns({"low": F.when(F.col("open"), low).otherwise(F.col("low")), "high": F.when(F.col("open"), high).otherwise(F.col("high"))})
        # the step is Newton's on the logarithm of the words, which bends less; half the bracket, or twice as far, where it leaves the bracket
        newton = F.col("lam") - F.try_divide(F.log(F.try_divide("got", "target")) * F.col("got"), F.col("slope"))
        inside = (F.col("slope") > 0) & (F.coalesce(newton > F.col("low"), F.lit(True))) & (F.coalesce(newton < F.col("high"), F.lit(True))) & (F.abs(newton - F.col("lam")) <= 8 + 2 * F.abs("lam"))
        other = F.when(F.col("low").isNull(), F.col("high") - 1 - F.abs("high")).when(F.col("high").isNull(), F.col("low") + 1 + F.abs("low")).otherwise((F.col("low") + F.col("high")) / 2)
        done = ~F.col("open") | (F.abs(off) <= EXACT * F.col("target")) | F.coalesce(F.col("high") - F.col("low") <= 1e-14 * F.abs("high"), F.lit(False))
        both = both.withColumns({"lam": F.when(done, F.col("lam")).when(inside, newton).otherwise(other), "open": ~done})
        state = C.materialize(both.drop("got", "slope"), "multipliers")
        if not state.where("open").limit(1).count():
            break
    return state.select("source", "source_size", "target", "scale", "lam", "full")


def _levels(fits: DataFrame, rest: DataFrame) -> DataFrame:
    """source and level: of fits(source, size, rank), those of a rank below the level have together at most rest(source, rest) words, and as many as may be."""
    level = rest.select("source", "rest", F.lit(0).cast("long").alias("level"))
    for k in range(ROUNDS):
        step = 1 << (BITS * (ROUNDS - 1 - k))
        near = fits.alias("r").join(level.alias("l"), F.col("r.source").eqNullSafe(F.col("l.source"))).where((F.col("rank") >= F.col("level")) & (F.col("rank") < F.col("level") + (step << BITS)))
        bins = near.groupBy("l.source", F.floor((F.col("rank") - F.col("level")) / F.lit(step)).cast("long").alias("bin")).agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
        upto = bins.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
        # the first bin that would pass the rest stays open; where none does, all are taken
        cut = upto.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("rest"), F.col("bin"))).alias("bin"), F.sum(F.when(F.col("upto") <= F.col("rest"), F.col("words")).otherwise(0)).alias("words"))
        level = C.materialize(
            level.alias("l").join(cut.alias("c"), F.col("l.source").eqNullSafe(F.col("c.source")), "left").select("l.source", (F.col("rest") - F.coalesce("words", F.lit(0))).alias("rest"), (F.col("level") + F.coalesce("bin", F.lit(1 << BITS)) * F.lit(step)).alias("level")),
            "levels",
        )
    return level.select("source", "level")


def rounded(rated: DataFrame, cap: int = CAP) -> DataFrame:
    """rated(source, size, h, target, rate) with copies, by which each source's words come near its target from below.

    Documents of the lowest ranks get one more copy; the rank is below 1 for the share `rate - floor(rate)` of them. Long ones that would pass
    the target are passed over, and where that leaves a gap the others are gone through again."""
    whole = F.least(F.floor("rate"), F.lit(cap)).cast("long")
    rank = F.floor((F.col("h") - (F.col("rate") - whole) + 1) * F.lit(_SCALE)).cast("long")
    rows = C.materialize(rated.withColumns({"copies": whole, "rank": rank}), "rounded")
    for _ in range(PASSES):
        have = rows.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("words"))
        rest = C.materialize(have.select("source", (F.col("target") - F.col("words")).alias("rest")).where(F.col("rest") > NEAR * F.col("target")), "rest")
        fits = rows.where((F.col("copies") < cap) & (F.col("size") > 0)).alias("r").join(rest.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).where(F.col("size") <= F.col("rest")).select("r.source", "size", "rank")
        if not fits.limit(1).count():
            break
        level = _levels(fits, rest).alias("l").join(rest.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source"))).select("l.source", "level", "rest")
        more = (F.col("rank") < F.col("level")) & (F.col("copies") < cap) & (F.col("size") > 0) & (F.col("size") <= F.col("rest"))
        joined = rows.alias("r").join(level.alias("l"), F.col("r.source").eqNullSafe(F.col("l.source")), "left")
        rows = C.materialize(joined.select(*(f"r.{c}" for c in rows.columns if c != "copies"), (F.col("copies") + F.coalesce(more, F.lit(False)).cast("long")).alias("copies")), "rounded")
    return rows.drop("rank")


def closed(taken: DataFrame, cap: int = CAP, fills: int = FILLS) -> DataFrame:
    """taken with single copies added or left out, one document of a source at a time, each the one that brings its source's words nearest to the target."""
    for _ in range(fills):
        off = F.max("target") - F.sum(F.col("copies") * F.col("size"))
        gap = taken.groupBy("source").agg(off.alias("gap"), F.max("target").alias("t")).where(F.abs("gap") > NEAR * F.col("t")).select("source", "gap")
        sign = F.signum("gap")
        fits = taken.where("size > 0").alias("r").join(gap.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).where((F.col("size") < 2 * F.abs("gap")) & F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0))
        best = fits.groupBy("g.source").agg(F.min(F.struct(F.abs(F.col("gap") - sign * F.col("size")).alias("off"), F.col("h").alias("h"), F.col("row").alias("row"), sign.cast("long").alias("one"))).alias("b")).select("b.row", "b.one")
        best = C.materialize(best, "fills")
        if not best.limit(1).count():
            break
        taken = C.materialize(taken.join(best, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("one", F.lit(0))).drop("one"), "taken")
    return taken


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, rate and copies of docs(doc_id, text, source)."""
    rows = C.materialize(sizes(docs).withColumn("row", F.monotonically_increasing_id()), "sizes")
    counts = C.materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    sources = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    state = multipliers(counts, targets(sources, weights, cap), cap)
    rated = rows.alias("r").join(state.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "source_size", "target", _rate(F.col("lam"), F.col("full"), F.col("size") / F.col("scale"), cap).alias("rate"))
    taken = closed(rounded(rated, cap), cap)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(C.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
