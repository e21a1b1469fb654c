"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Each source has a target of words. Rates of documents are those closest to 1 (in relative entropy, weighted by
documents, between 0 and MOST) whose words sum to the target: rate = min(MOST, exp(lambda * size / mean size)),
where lambda solves the source's convex dual. Newton steps, kept within a bracket, run for all sources at once:
each step is one distributed sum of gradient and curvature over cells. A cell holds a source's documents of one
size (above 2,048 words: of sizes that agree in 11 leading bits), so there are at most some 25,000 cells a source,
however many documents. Rates become whole copies by rounding cumulated rates over the cells from the longest to the
shortest, which leaves a source at most half its longest document away from the target; passes over shorter
documents then take up what is left. Within a cell, the copies that don't go round go to documents in order of a
hash, counted through salted subgroups, so no group of equal sizes meets in one task. Sources may be many, too: they are
numbered by ranges, and the level of the targets is found by distributed sums.

Defined cases: a null text has size 0; documents of size 0 are taken as 0 words (and 1 copy by the stage); long texts are
counted whole; a null source is a source of its own, last in order; repeated rows are separate documents; with no words at all every
target is 0; an empty table gives no rows; reruns agree, as nothing depends on the order of rows: what goes round goes by a
hash of doc_id and text. Columns of any names may stand beside doc_id, text and source; the stage returns them as they are.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.common import WORD_JAVA, cut, packed, small_side
from threadloom.storage import numbered

WEIGHTS = (5, 2, 1)
MOST = 3
NEWTON_STEPS, TOLERANCE = 60, 1e-7
#: Documents a salted subgroup, about; leading bits of a size that a cell keeps; passes that take up what is left.
SUBGROUP, CELL_BITS, FILL_PASSES = 256, 11, 4
#: Subgroups that are counted up together; above them, their sums.
RUN = 4096


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_JAVA)), F.lit(0)).cast("bigint")


def _key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _cell(n: Column) -> Column:
    drop = F.greatest(F.length(F.bin(n)) - CELL_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", n, drop), drop)


def targets(sources: DataFrame) -> DataFrame:
    """k, source, source_size -> with target: weights by the sources' order, stopped at MOST times the size, the excess shared anew.

    Such shares are min(MOST * size, weight * level) for one level. It starts at what the weights alone give; as long as
    sources stop below it, what they leave is shared by the others. All sums are of whole numbers, so reruns agree.
    """
    placed = numbered(sources.withColumn("last", F.isnull("source")), ["last", "source"], "place")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    rows = cut(placed.select("k", "source", "source_size", weight.cast("bigint").alias("w"), (MOST * F.col("source_size")).alias("cap")))
    every, weights = rows.agg(F.sum("source_size"), F.sum("w")).first()
    level = (every or 0) / weights if weights else 0.0
    while level:
        stops = F.col("cap") <= F.col("w") * level
        capped, free = rows.agg(F.sum(F.when(stops, F.col("cap")).otherwise(0)), F.sum(F.when(stops, 0).otherwise(F.col("w")))).first()
        if not free or (every - capped) / free <= level:
            break
        level = (every - capped) / free
    return rows.select("k", "source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.lit(float(level))).alias("target"))


def solve(cells: DataFrame, goals: DataFrame) -> DataFrame:
    """k -> lam. cells: k, m (mean size, over 0), s (words), z (m over the source's mean); goals: k, target. Both cut."""
    far = cells.groupBy("k").agg((math.log(MOST) / F.min("z")).alias("hi"), F.lit(-1e4).alias("lo"), F.sum("s").alias("all"))
    state = goals.join(far, "k").select("k", "target", F.lit(0.0).alias("lam"), "lo", "hi", F.lit(1e300).alias("off"))
    state = cut(state)
    for _ in range(NEWTON_STEPS):
        e = F.exp(F.col("lam") * F.col("z"))
        capped = e >= MOST
        sums = cells.join(small_side(state), "k").groupBy("k").agg(
            F.sum(F.col("s") * F.least(e, F.lit(float(MOST)))).alias("got"), F.sum(F.when(capped, 0.0).otherwise(F.col("s") * F.col("z") * e)).alias("slope"),
            *(F.first(c).alias(c) for c in ("target", "lam", "lo", "hi")))
        gap = F.col("got") - F.col("target")
        sums = sums.withColumn("off", F.abs(gap) / F.greatest("target", F.lit(1.0)))
        sums = sums.withColumn("hi", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))).withColumn("lo", F.when(gap > 0, F.col("lo")).otherwise(F.col("lam")))
        newton = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        safe = F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = cut(sums.select("k", "target", F.when(F.col("off") <= TOLERANCE, F.col("lam")).otherwise(safe).alias("lam"), "lo", "hi", "off"))
        if (state.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.select("k", F.round("lam", 10).alias("lam"))


def _filled(cells: DataFrame) -> DataFrame:
    """One pass that takes up what a source's copies miss, or have too much, from documents of at most that size."""
    own = Window.partitionBy("k")
    cells = cells.withColumn("left", F.col("target") - F.sum(F.col("copies") * F.col("m")).over(own))
    fits = F.col("m") <= F.abs("left")
    room = F.when(F.col("left") > 0, MOST * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
    cells = cells.withColumn("room", F.when(fits, room).otherwise(F.lit(0)))
    before = F.coalesce(F.sum(F.col("room") * F.col("m")).over(own.orderBy(F.desc("m"), "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    take = F.greatest(F.lit(0), F.least(F.col("room"), F.floor((F.abs("left") - before) / F.col("m"))))
    return cells.withColumn("copies", F.col("copies") + F.signum("left").cast("bigint") * take).drop("left", "room")


def plan(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sizes (cut): k, source, size, salt -> (sources with targets, quotas by k, cell and salt).

    A quota gives the copies that each document of its subgroup gets, and how many of its first get one more.
    """
    cells = sizes.groupBy("k", F.col("cell")).agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    cells = cut(cells)
    sums = cells.groupBy("k").agg(F.sum("s").alias("source_size"), F.sum("n").alias("docs"))
    names = sizes.groupBy("k").agg(F.first("source").alias("source"))
    sources = cut(targets(sums.select("k", "source_size").join(names, "k")))
    real = cells.where("s > 0").withColumn("m", F.col("s") / F.col("n")).join(small_side(cut(sums)), "k")
    real = cut(real.select("k", "cell", "n", "s", "m", (F.col("m") * F.col("docs") / F.col("source_size")).alias("z")))
    lam = solve(real, sources.select("k", "target"))
    rate = F.least(F.lit(float(MOST)), F.exp(F.col("lam") * F.col("z")))
    rated = real.join(small_side(cut(lam.join(sources.select("k", "target"), "k"))), "k").withColumn("rate", rate)
    upto = F.sum(F.col("rate") * F.col("n")).over(Window.partitionBy("k").orderBy(F.desc("m"), "cell"))
    rounded = rated.withColumn("upto", F.round(upto)).withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("k").orderBy(F.desc("m"), "cell")), F.lit(0.0)))
    rounded = rounded.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("copies").cast("bigint"), MOST * F.col("n"))))
    for _ in range(FILL_PASSES):
        rounded = _filled(rounded)
    whole = rounded.select("k", "cell", "n", "copies")
    # Subgroups of a cell, by a hash that has the same distribution in every cell.
    parts = sizes.groupBy("k", "cell", "salt").agg(F.count("*").alias("docs"))
    # salt is a fine hash bucket; their documents are counted up within runs of RUN salts, and over these runs.
    parts = cut(parts.withColumn("run", F.floor(F.col("salt") / RUN)))
    runs = parts.groupBy("k", "cell", "run").agg(F.sum("docs").alias("docs"))
    runs = runs.select("k", "cell", "run", (F.sum("docs").over(Window.partitionBy("k", "cell").orderBy("run")) - F.col("docs")).alias("before"))
    merged = parts.join(cut(whole), ["k", "cell"]).join(runs, ["k", "cell", "run"])
    merged = merged.withColumn("upto", F.col("before") + F.sum("docs").over(Window.partitionBy("k", "cell", "run").orderBy("salt")))
    merged = merged.withColumn("each", F.floor(F.col("copies") / F.col("n"))).withColumn("over", F.col("copies") - F.col("each") * F.col("n"))
    part = lambda c: F.floor(c * F.col("over") / F.col("n"))
    quotas = merged.select("k", "cell", "salt", "each", (part(F.col("upto")) - part(F.col("upto") - F.col("docs"))).alias("extra"))
    return sources, cut(quotas)


def _salted(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (k, cell, hash and others) with salt. counts: k, cell, parts of the cells with more than SUBGROUP documents only."""
    out = rows.join(small_side(counts), ["k", "cell"], "left")
    return out.withColumn("salt", F.pmod("hash", F.coalesce("parts", F.lit(1)).cast("bigint"))).drop("parts")


def mixed(docs: DataFrame) -> DataFrame:
    """row (its own columns), size, source_size, target and copies of all rows of docs (doc_id, text, source and others)."""
    ready = docs.select(packed(docs), _key(docs["source"]).alias("k"), size(docs["text"]).alias("size"), F.xxhash64(docs["doc_id"], docs["text"]).alias("hash"))
    ready = ready.withColumn("cell", _cell(F.col("size")))
    slim = cut(ready.select("k", "size", "cell", "hash", F.col("row.source").alias("source")))
    counts = cut(slim.groupBy("k", "cell").agg(F.count("*").alias("n")).where(F.col("n") > SUBGROUP).select("k", "cell", F.ceil(F.col("n") / SUBGROUP).alias("parts")))
    sources, quotas = plan(cut(_salted(slim, counts).select("k", "source", "size", "cell", "salt")))
    rows = _salted(ready, counts).join(small_side(quotas), ["k", "cell", "salt"], "left")
    rank = F.row_number().over(Window.partitionBy("k", "cell", "salt").orderBy("hash", "row.doc_id"))
    rows = rows.withColumn("copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("each") + (rank <= F.col("extra")).cast("bigint")).cast("bigint"))
    about = cut(sources.select("k", "source_size", "target"))
    return rows.join(small_side(about), "k").select("row", "size", "source_size", "target", "copies")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed(docs).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents, each as often as the mix takes it."""
    return mixed(docs).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
