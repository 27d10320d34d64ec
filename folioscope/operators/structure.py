"""Linking notes, reading order, duplicates, coverage and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.constants import LIMITS
from folioscope.sources.store import scratch


def link_notes(anchors: DataFrame, notes: DataFrame) -> DataFrame:
    """(page, anchor_ord, note_ord, confidence, method) from anchors and notes (page, ord, marker).

    The first anchor and the first note of a marker are linked (1.0); left-over
    anchors and left-over marked notes are linked in order (0.6).
    """
    first = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy("page", "marker").orderBy("ord")))
    a, n = first(anchors).select("page", "marker", F.col("ord").alias("anchor_ord"), "k"), first(notes).select("page", "marker", F.col("ord").alias("note_ord"), "k")
    exact = a.where("k = 1 and marker is not null").join(n.where("k = 1"), ["page", "marker"]).select("page", "anchor_ord", "note_ord", F.lit(1.0).alias("confidence"), F.lit("exact").alias("method"))
    order = lambda df, c: df.withColumn("i", F.row_number().over(Window.partitionBy("page").orderBy(c)))
    left_a = order(a.select("page", "anchor_ord").join(exact.select("page", "anchor_ord"), ["page", "anchor_ord"], "left_anti"), "anchor_ord")
    left_n = order(n.where("marker is not null").select("page", "note_ord").join(exact.select("page", "note_ord"), ["page", "note_ord"], "left_anti"), "note_ord")
    ordinal = left_a.join(left_n, ["page", "i"]).select("page", "anchor_ord", "note_ord", F.lit(0.6).alias("confidence"), F.lit("ordinal").alias("method"))
    return exact.unionByName(ordinal)


def unlinked(rows: DataFrame, links: DataFrame, ord_col: str) -> DataFrame:
    """Anchors or notes (page, ord) that no link has."""
    return rows.join(links.select("page", F.col(ord_col).alias("ord")), ["page", "ord"], "left_anti")


def continuations(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Unlinked notes: unmarked ones that continue the page before (0.7), and the rest (flagged)."""
    left = unlinked(notes, links, "note_ord")
    goes_on = F.col("marker").isNull() & F.coalesce("continues", F.lit(False))
    return left.select("page", F.col("ord").alias("note_ord"), F.when(goes_on, 0.7).alias("confidence"), F.when(goes_on, "continuation").otherwise("unmatched").alias("method"))


def attach_after_colon(blocks: DataFrame, page: str, order: str, text: str, is_note: Column, may_follow: Column) -> DataFrame:
    """Adds ``attached_to``: the order of a note just before that ends in a colon."""
    w = Window.partitionBy(page).orderBy(order)
    before, note = F.lag(F.rtrim(F.col(text))).over(w), F.lag(is_note).over(w)
    return blocks.withColumn("attached_to", F.when(note & before.rlike("[:：]$") & may_follow, F.lag(order).over(w)))


def repeated_shingles(texts: DataFrame, scope: str, n: int = LIMITS.shingle_words) -> DataFrame:
    """(scope, id, owner): texts with an n-word run that an earlier text of the scope has.

    The owner of a run is the smallest id with it. A text sends its runs as two
    hashes, once: sorted by run and id, each row sees the least id so far, and
    the first row of a run that has a smaller one before it tells its owner.
    """
    # A run is the hash of its words' hashes: no run is ever put together as a text.
    hashed = texts.where((F.size("words") >= n) & F.col(scope).isNotNull()).select(F.col(scope).alias("scope"), "id", F.transform("words", lambda w: F.xxhash64(w)).alias("w"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, F.lit(n)))
    rows = hashed.select("scope", "id", F.explode(F.transform(runs, lambda r: F.struct(F.xxhash64(r).alias("h"), F.hash(r).alias("h2")))).alias("g")).select("scope", "id", "g.h", "g.h2")
    so_far = Window.partitionBy("scope", "h", "h2").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("owner", F.min("id").over(so_far)).where("owner < id").groupBy("scope", "id").agg(F.min("owner").alias("owner"))


def duplicate_runs(blocks: DataFrame, n: int = LIMITS.shingle_words) -> DataFrame:
    """(page, id, owner): blocks whose first repeated run of n words an earlier block of the page has.

    In reading order (pos, then id) a block owns its runs up to the first that
    an earlier block owns; there it is flagged, and its later runs are nobody's. A
    run's owner depends on where earlier blocks stop. If all owned all their runs, each
    would stop at the first run that another has first, so it stops there or later.
    A run's first block that comes to it before that stop owns it for good, and
    every other block of it stops there or earlier. What is left, runs without such
    an owner up to those stops, is settled in rounds: all blocks at once take the
    stop that the round before gives, until none changes; each round
    settles at least the next one in every chain of blocks that depend on each other.
    Only runs of two blocks or more take part, as hashes of 128 bits; all runs are
    moved once. Blocks: page, pos, id, words.
    """
    hashes = [F.transform("words", lambda w: F.xxhash64(w)).alias("w"), F.transform("words", lambda w: F.xxhash64(F.lit(1), w)).alias("v")]
    rows = blocks.where((F.size("words") >= n) & F.col("page").isNotNull()).select("page", F.struct("pos", "id").alias("at"), *hashes)
    run = lambda c, i: F.xxhash64(F.slice(c, i + 1, F.lit(n)))
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(run("w", i).alias("h"), run("v", i).alias("h2")))
    rows = rows.select("page", "at", F.posexplode(runs).alias("i", "run")).select("page", "at", "i", "run.h", "run.h2")
    w = Window.partitionBy("page", "h", "h2").orderBy("at", "i")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.select("*", F.lag("at").over(w).alias("prev"), F.lead("at").over(w).alias("next"), F.first("at").over(so_far).alias("first"), F.first("i").over(so_far).alias("first_i"))
    # A block's first place of a run; the first block's stands for it at its last place, where the next block is seen.
    later = (F.col("first") != F.col("at")) & (F.col("prev") != F.col("at"))
    owner = (F.col("first") == F.col("at")) & F.coalesce(F.col("next") != F.col("at"), F.lit(False))
    rows = seen.where(later | owner).select("page", "h", "h2", "at", F.when(owner, F.col("first_i")).otherwise(F.col("i")).alias("i"), "first", "first_i")
    rows = scratch(rows, "shared-runs")
    least = lambda r, to: r.groupBy("page", "at").agg(F.min(F.struct("i", F.col(to).alias("owner"))).alias("x")).select("page", "at", "x.i", "x.owner")
    low = scratch(least(rows.where("first != at"), "first"), "least-stops")
    open_ = low.select("page", F.col("at").alias("first"), F.col("i").alias("stop"))
    told = rows.join(open_, ["page", "first"], "left").withColumn("sure", F.coalesce(F.col("first_i") < F.col("stop"), F.lit(True)))
    told = scratch(told.select("page", "h", "h2", "at", "i", "first", "sure"), "told-runs")
    sure = scratch(least(told.where("sure and first != at"), "first"), "sure-stops")
    rows = told.where("not sure").join(sure.select("page", "at", F.col("i").alias("most")), ["page", "at"], "left").where("most is null or i < most")
    rows = scratch(rows.select("page", "h", "h2", "at", "i"), "open-runs")
    # A block without an entry here owns all its runs.
    stops = sure
    while not rows.isEmpty():
        owners = rows.join(stops.select("page", "at", F.col("i").alias("stop")), ["page", "at"], "left").where("stop is null or i < stop").groupBy("page", "h", "h2").agg(F.min("at").alias("owner"))
        found = least(rows.join(owners, ["page", "h", "h2"]).where("owner < at").select("page", "at", "i", "owner").unionByName(sure), "owner")
        found = scratch(found, "stops")
        same = found.join(stops, ["page", "at", "i", "owner"]).count()
        if same == found.count() == stops.count():
            break
        stops = found
    return stops.select("page", F.col("at.id").alias("id"), F.col("owner.id").alias("owner"))


def islands(df: DataFrame, by: list[str], order: str, starts: Column) -> DataFrame:
    """Adds ``island``: the running number of rows at which ``starts`` holds."""
    return df.withColumn("island", F.sum(starts.cast("int")).over(Window.partitionBy(*by).orderBy(order)))


def order_note_runs(blocks: DataFrame, page: str, order: str, number: str) -> DataFrame:
    """Adds ``seq``: every contiguous run of numbered notes is put in the order of its numbers."""
    w = Window.partitionBy(page).orderBy(order)
    numbered = F.col(number).isNotNull()
    change = F.coalesce(numbered != F.lag(numbered).over(w), F.lit(True)) | ~numbered
    marked = islands(blocks.withColumn("_new", change), [page], order, F.col("_new"))
    key = Window.partitionBy(page).orderBy("island", F.coalesce(number, F.lit(0)), order)
    return marked.withColumn("seq", F.row_number().over(key)).drop("_new", "island")


def merge_regions(lines: DataFrame, page: str = "page", gap: int = LIMITS.merge_gap) -> DataFrame:
    """Regions of lines (x0, y0, x1, y1, text): a line within ``gap`` of the region above joins it."""
    w = Window.partitionBy(page).orderBy("y0", "x0")
    reach = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = islands(lines.withColumn("_new", F.coalesce(F.col("y0") - reach >= gap, F.lit(True))), [page], "y0", F.col("_new"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda s: s.text)
    return marked.groupBy(page, "island").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), texts.alias("lines")).drop("island")


def coverage(segments: DataFrame, found: Column, by: list[str]) -> DataFrame:
    """Share of segments that are found; 1 without segments."""
    n = F.count("*")
    return segments.groupBy(*by).agg(n.alias("n_segments"), F.round(F.when(n > 0, F.sum(found.cast("int")) / n).otherwise(F.lit(1.0)), 6).alias("coverage"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (structs x0, y0, x1, y1); 0 without area."""
    w = F.greatest(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.lit(0))
    h = F.greatest(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0), F.lit(0))
    union = (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def densest_cluster(words: DataFrame, by: str = "block") -> DataFrame:
    """Matched words (block, line, ...) of the cluster of lines (gap up to 2) with most words."""
    per = words.groupBy(by, "line").agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy("line")
    per = islands(per.withColumn("_new", F.coalesce(F.col("line") - F.lag("line").over(w) > 2, F.lit(True))), [by], "line", F.col("_new"))
    best = per.groupBy(by, "island").agg(F.sum("n").alias("n")).groupBy(by).agg(F.max(F.struct("n", (-F.col("island")).alias("first"))).alias("x"))
    keep = per.join(best, by).where(F.col("island") == -F.col("x.first")).select(by, "line")
    return words.join(keep, [by, "line"], "left_semi")


def line_rects(words: DataFrame, by: str = "block") -> DataFrame:
    """One rectangle a line, right to left: the first line keeps its right end, the last its left."""
    rects = words.groupBy(by, "line", "lx0", "lx1").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    w = Window.partitionBy(by)
    first, last = F.min("line").over(w), F.max("line").over(w)
    return rects.withColumn("x0", F.when(F.col("line") == last, F.col("x0")).otherwise(F.col("lx0"))).withColumn("x1", F.when(F.col("line") == first, F.col("x1")).otherwise(F.col("lx1"))).drop("lx0", "lx1")


def scale_box(box: Column, width: Column, height: Column) -> Column:
    """[y0, x0, y1, x1] in thousandths as pixels."""
    px = lambda v, side: F.round(v * side / 1000).cast("int")
    return F.struct(px(box[1], width).alias("x0"), px(box[0], height).alias("y0"), px(box[3], width).alias("x1"), px(box[2], height).alias("y1"))


def fuse_lanes(rows: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """Of rows with ``ocr`` and ``box`` (structs): the OCR box where both agree, else the other."""
    agree = F.coalesce(iou(F.col("ocr"), F.col("box")) >= least_iou, F.lit(False))
    return rows.withColumn("agree", agree).withColumn("place", F.when(agree | F.col("box").isNull(), F.col("ocr")).otherwise(F.col("box")))


def interpolate(blocks: DataFrame, page: str = "page", order: str = "ord") -> DataFrame:
    """Adds the line range between the nearest aligned neighbours of blocks without lines."""
    before = Window.partitionBy(page).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(page).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    lo, hi = F.last("line_to", ignorenulls=True).over(before), F.first("line_from", ignorenulls=True).over(after)
    return blocks.withColumn("between_from", F.when(F.col("line_from").isNull(), lo + 1)).withColumn("between_to", F.when(F.col("line_from").isNull(), hi - 1))


def interpolated_boxes(blocks: DataFrame, lines: DataFrame, pages: DataFrame, slack: int = 5) -> DataFrame:
    """(page, ord, x0, y0, x1, y1, n_lines): blocks without a box (page, ord, x0, y0, x1, y1) get the lines
    (page, x0, y0, x1, y1) between their nearest neighbours with one, or the page's ends (pages: page, height)."""
    before = Window.partitionBy("page").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("page").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    rows = blocks.withColumn("top", F.coalesce(F.last("y1", ignorenulls=True).over(before), F.lit(0))).withColumn("low", F.first("y0", ignorenulls=True).over(after))
    empty = rows.where("y0 is null").select("page", "ord", "top", "low").join(pages, "page").withColumn("low", F.coalesce("low", "height"))
    hits = empty.join(lines, "page").where((F.col("y0") >= F.col("top") - slack) & (F.col("y1") <= F.col("low") + slack))
    return hits.groupBy("page", "ord").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_lines"))


def marker_point(offset: Column, n_chars: Column, rects: Column) -> Column:
    """(x, y) of a marker at a character offset, on rectangles (x0, y0, x1, y1) of lines read right to
    left; without an offset the middle; null without rectangles."""
    width = lambda r: (r.x1 - r.x0).cast("double")
    total = F.aggregate(rects, F.lit(0.0), lambda s, r: s + width(r))
    target = F.when(offset.isNull(), F.lit(0.5)).otherwise(offset / F.greatest(n_chars, F.lit(1))) * total
    state = lambda target, ahead, done, x, y: F.struct(target.alias("target"), ahead.alias("ahead"), done.alias("done"), x.cast("double").alias("x"), y.cast("double").alias("y"))

    def step(s, r):
        """Each line in turn, until one ends at or beyond the target; the last one in any case."""
        end = s.ahead + width(r)
        return F.when(s.done, s).otherwise(state(s.target, end, F.coalesce(end >= s.target, F.lit(False)), r.x1 - F.least(s.target - s.ahead, width(r)), (r.y0 + r.y1) / 2))

    none = F.lit(None)
    point = F.aggregate(rects, state(target, F.lit(0.0), F.lit(False), none, none), step, lambda s: F.struct(s.x.alias("x"), s.y.alias("y")))
    return F.when(F.size(rects) > 0, point)


def blocks_for_quote(pairs: DataFrame, least: float = 0.6) -> DataFrame:
    """(qid, id): blocks whose key holds the quote's; where none does, the first block with the largest
    share of its words, if that is enough. Pairs: qid, quote, id, pos, key."""
    words = F.split("quote", " ")
    share = F.size(F.filter(words, lambda w: F.array_contains(F.split("key", " "), w))) / F.size(words)
    rows = pairs.where("quote <> ''").withColumn("whole", F.contains("key", F.col("quote"))).withColumn("share", share)
    best = rows.groupBy("qid").agg(F.max("whole").alias("any"), F.max(F.struct("share", (-F.col("pos")).alias("first"), "id")).alias("b"))
    whole = rows.where("whole").select("qid", "id")
    return whole.unionByName(best.where(~F.col("any") & (F.col("b.share") >= least)).select("qid", "b.id"))


def assemble_lines(words: DataFrame) -> DataFrame:
    """OCR words (page, blk, par, line, no, text, conf, x0..y1) as lines with boxes and mean confidence."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda s: s.text), " ")
    return words.groupBy("page", "blk", "par", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("conf").alias("conf"), text.alias("text"))


def overlay(rows: DataFrame, corrections: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Corrections (keys, column) replace values; the original stays beside them."""
    c = corrections.select(*keys, F.col(column).alias("_new"))
    joined = rows.join(c, keys, "left")
    return joined.withColumn(f"original_{column}", F.when(F.col("_new").isNotNull(), F.col(column))).withColumn(column, F.coalesce("_new", column)).drop("_new")
