"""Mixing sources to target weights by Pareto order sampling.

A document is due r = min(most, level * (1 + log2(size))) copies: longer ones are
due somewhat more, and its source's level makes the words due add up to the
source's target. floor(r) whole copies are certain; p = r - floor(r) is its
inclusion probability for one more, which differs between documents.

Documents of one source whose sizes lie within a quarter of an octave are a
stratum. A stratum's sample has a fixed size: the sum of its p, rounded so that
the roundings of a source's strata never add up to a whole document. It holds
the stratum's documents with the smallest odds ratios
q = u / (1 - u) / (p / (1 - p)), u random. Where a stratum's head ends is found
by a histogram of q, refined twice, so no stratum is sorted in one task: only
the documents of one last narrow slice are ordered. At last one document a
source may get one copy more or one less, if that brings it nearer to its target.

Rows equal in id, text, size and source are one row with a count until the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_hot, stored, table

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Slices of the ranking variable at each of two levels.
SLICES = 1024
#: Strata an octave of sizes.
STRATA = 4
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    """Number of maximal runs without ASCII white space; null: 0. Spark's split drops no
    trailing field, so the fields that are not empty are the words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weighted_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight``: sources in code-point order, null last, take the weights in turn.

    The rank comes from a range sort and its partition totals (one row per
    partition), not from a window over all sources.
    """
    spark = sizes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    ordered = sizes.repartitionByRange(parts, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ordered = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    totals = sorted(ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first")).collect())
    before, starts = 0, []
    for p, n, first in totals:
        starts.append((p, first - before))
        before += n
    base = spark.createDataFrame(starts or [(0, 0)], "part long, base long")
    rank = F.col("at") - F.col("base")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    return ordered.withColumn("part", part).join(base, "part").withColumn("weight", weight.cast("double")).drop("part", "base", "at")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): weights share all sizes; a target stops at
    ``most`` times its source's size and its excess is shared again by weight.

    Each round is one aggregate over the sources; it ends when none is above.
    """
    s = stored(weighted_sources(sizes, weights), "weighted-sources")
    cap = F.col("source_size") * most
    rest, weight, fixed = 0.0, 0.0, -1
    level = 0.0
    total = s.agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
    if total[2]:
        rest, weight, fixed = float(total[0] or 0), float(total[1]), 0
        while weight > 0:
            level = rest / weight
            at_cap = s.where(cap <= F.col("weight") * F.lit(level)).agg(F.sum(cap), F.sum("weight"), F.count("*")).first()
            if at_cap[2] == fixed:
                break
            fixed = at_cap[2]
            rest, weight = float(total[0]) - float(at_cap[0] or 0), float(total[1]) - float(at_cap[1] or 0)
    return s.select("source", "source_size", F.least(cap.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def measure(size) -> F.Column:
    """What a document's copies are in proportion to."""
    return 1 + F.log2(size.cast("double"))


def random_number(seed: int, *keys) -> F.Column:
    """A number in (0, 1) that depends on the keys alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def source_levels(per: DataFrame, most: int) -> DataFrame:
    """(key, level): the level at which the words due are the source's target.

    ``per`` has key, size, n (documents of that size) and target. Documents at
    the cap are the longest ones, so with sizes in falling order the level is the
    first one that lifts no document below the cap over it. A window's rows are
    the distinct sizes of one source.
    """
    w = Window.partitionBy("key").orderBy(F.desc("size"))
    words = F.col("n") * F.col("size")
    longer = F.coalesce(F.sum(words).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(words * measure(F.col("size"))).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.col("target") - F.lit(most) * longer) / below
    return per.select("key", "size", level.alias("level")).where(F.col("level") * measure(F.col("size")) <= most * (1 + 1e-12)).groupBy("key").agg(F.max_by("level", "size").alias("level"))


def strata_sizes(per: DataFrame, seed: int) -> DataFrame:
    """(stratum, take): the fixed size of each stratum's sample.

    ``per`` has key, stratum, size, n and p. A source's strata are rounded in
    order: each takes what the rounded running sum of the p grows by, from a
    random start.
    """
    sums = per.groupBy("key", "stratum").agg(F.max("size").alias("high"), F.sum(F.col("n") * F.col("p")).alias("due"))
    w = Window.partitionBy("key").orderBy(F.desc("high")).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("due").over(w)
    start = random_number(seed, F.col("key"), F.lit("start"))
    rounded = F.floor(upto + start + 1e-9)
    return sums.withColumn("upto", rounded).withColumn("take", F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("key").orderBy(F.desc("high"))), F.floor(start + 1e-9))).select("stratum", "take")


def _head(rows: DataFrame, slot: F.Column) -> DataFrame:
    """(stratum, slot, before, docs): the first slice whose documents no longer fit, or one
    behind all; before counts the documents of the slices ahead, and docs all rows.

    ``rows`` has stratum, m, take and base. A stratum has at most SLICES slices.
    """
    per = rows.groupBy("stratum", slot.alias("slot")).agg(F.sum("m").alias("n"), F.count("*").alias("rows"), F.max("take").alias("take"), F.max("base").alias("base"))
    w = Window.partitionBy("stratum").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    run = per.withColumn("upto", F.col("base") + F.sum("n").over(w))
    over = F.col("upto") > F.col("take")
    first = F.min_by(F.when(over, F.struct("slot", (F.col("upto") - F.col("n")).alias("before"))), F.when(over, F.col("slot")))
    ends = run.groupBy("stratum").agg(first.alias("x"), F.sum("rows").alias("docs"))
    return ends.select("stratum", F.coalesce("x.slot", F.lit(SLICES).cast("long")).alias("slot"), F.coalesce("x.before", F.lit(0)).alias("before"), "docs")


def mix(df: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every input row, by ``mixed_rows``."""
    return mixed_rows(df, seed, weights, most, id_col, text_col, source_col).drop("twin")


def mixed_rows(df: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", twin_col: str | None = None) -> DataFrame:
    """doc_id, twin, size, source_size, target, taken for every input row.

    twin tells rows of one id apart: a hash of the text, or the long in ``twin_col``.

    taken is the words the mix takes of the document: whole copies, at most
    ``most``. Random numbers hash (seed, id, text, size), so reruns agree, however the
    table is split. Repeated rows, null ids among them, are separate documents;
    of rows equal in id, text and source some may get one copy more than others.
    Null or empty texts have size 0 and take 0; null sources are one source,
    last in order; other columns are left out; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    # A key that is never null, so that all joins are plain equi-joins.
    key = F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(twin_col) if twin_col else F.xxhash64(text)).alias("twin"), word_count(text).alias("size"), key.alias("key"))
    docs = stored(rows.groupBy("doc_id", "twin", "size", "key").agg(F.count("*").alias("m")), "sizes")
    sizes = docs.groupBy("key").agg(F.sum(F.col("m") * F.col("size")).alias("source_size"), F.count("*").alias("docs"))
    sizes = stored(sizes.withColumn("source", F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30))), "source-sizes")
    targets = source_targets(sizes.select("source", "source_size"), weights, most)
    named = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    targets = stored(targets.select(named.alias("key"), "source_size", "target").join(sizes.select("key", "docs"), "key"), "targets")

    live = F.col("size") > 0
    octave = F.floor(F.log2(F.col("size").cast("double")) * STRATA)
    per = docs.where(live).groupBy("key", "size").agg(F.sum("m").alias("n"), F.count("*").alias("docs")).join(targets.select("key", "target"), "key")
    per = stored(per, "distinct-sizes")
    levels = stored(source_levels(per, most), "levels")
    due = F.least(F.col("level") * measure(F.col("size")), F.lit(float(most)))
    per = per.join(levels, "key", "left").withColumn("r", F.coalesce(due, F.lit(float(most)))).withColumn("whole", F.floor(F.col("r") + 1e-9).cast("long"))
    per = per.withColumn("p", F.when(F.col("r") - F.col("whole") > 1e-9, F.col("r") - F.col("whole")).otherwise(F.lit(0.0))).withColumn("stratum", F.concat_ws("|", octave.cast("string"), "key"))
    # Documents of one size and source are one kind.
    per = per.withColumn("kind", F.concat_ws("|", F.col("size").cast("string"), "key"))
    takes = strata_sizes(per, seed)
    kinds = stored(per.select("kind", "stratum", "whole", "p", F.col("docs")).join(takes, "stratum"), "kinds")

    u = random_number(seed, F.col("doc_id"), F.col("twin"), F.col("size"))
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    # z rises with the odds ratio and lies in (0, 1); without a p it is behind all.
    z = F.when(F.col("p") > 0, odds / (1 + odds)).otherwise(F.lit(1.0))
    ranked = stored(join_hot(docs.where(live).withColumn("kind", F.concat_ws("|", F.col("size").cast("string"), "key")), kinds, "kind", "docs").withColumn("z", z).withColumn("base", F.lit(0).cast("long")).drop("kind"), "ranked")
    coarse = F.least(F.floor(F.col("z") * SLICES), F.lit(SLICES - 1))
    fine = F.least(F.floor((F.col("z") * SLICES - coarse) * SLICES), F.lit(SLICES - 1))
    first = stored(_head(ranked, coarse), "head1")
    cut = stored(join_hot(ranked.withColumn("coarse", coarse), first.withColumnsRenamed({"slot": "slot1", "before": "before1"}), "stratum", "docs"), "cut")
    border = cut.where("coarse = slot1").withColumn("base", F.col("before1")).withColumn("fine", fine)
    second = _head(border, F.col("fine")).drop("docs").withColumnsRenamed({"slot": "slot2", "before": "before2"})
    last = border.join(stored(second, "head2"), "stratum")
    # The last slice, about 1 / SLICES^2 of its stratum, is ordered row by row.
    w = Window.partitionBy("stratum", F.col("fine") == F.col("slot2")).orderBy("z", "doc_id", "twin", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before2") + F.coalesce(F.sum("m").over(w), F.lit(0))
    inside = F.when(F.col("fine") < F.col("slot2"), F.col("m")).when(F.col("fine") > F.col("slot2"), F.lit(0)).otherwise(F.least(F.greatest(F.col("take") - ahead, F.lit(0)), F.col("m")))
    columns = ["doc_id", "twin", "size", "key", "m", "whole", "z", "extra"]
    picked = cut.where("coarse != slot1").withColumn("extra", F.when(F.col("coarse") < F.col("slot1"), F.col("m")).otherwise(F.lit(0).cast("long"))).select(*columns)
    picked = stored(picked.unionByName(last.withColumn("extra", inside.cast("long")).select(*columns)), "picked")

    words = picked.groupBy("key").agg(F.sum((F.col("m") * F.col("whole") + F.col("extra")) * F.col("size")).alias("words"))
    gaps = stored(targets.join(words, "key").withColumn("gap", F.col("target") - F.col("words")).select("key", "gap", "docs"), "gaps")
    toward = join_hot(picked, gaps, "key", "docs")
    more = (F.col("gap") > 0) & (F.col("extra") < F.col("m")) & (F.col("whole") < most)
    less = (F.col("gap") < 0) & (F.col("whole") * F.col("m") + F.col("extra") > 0)
    miss = F.abs(F.abs("gap") - F.col("size"))
    best = toward.where((more | less) & (miss < F.abs("gap"))).groupBy("key").agg(F.min(F.struct(miss.alias("miss"), "z", "doc_id", "twin", "size")).alias("best"))
    ends = targets.join(stored(best, "closers"), "key", "left").join(gaps.select("key", F.signum("gap").cast("long").alias("step")), "key", "left")
    full = join_hot(picked.unionByName(docs.where(~live).select("doc_id", "twin", "size", "key", "m", F.lit(0).cast("long").alias("whole"), F.lit(1.0).alias("z"), F.lit(0).cast("long").alias("extra"))), stored(ends, "ends"), "key", "docs")
    closes = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("twin") == F.col("best.twin")) & (F.col("size") == F.col("best.size"))
    full = full.withColumn("extra", F.col("extra") + F.when(F.coalesce(closes, F.lit(False)), F.col("step")).otherwise(F.lit(0)))
    # m rows: the first of them take one copy more (or, with a copy less, one of them takes fewer).
    many = full.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    copies = F.col("whole") + F.when(F.col("at") < F.abs("extra"), F.signum("extra").cast("long")).otherwise(F.lit(0))
    return many.select("doc_id", "twin", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
