"""Votes of readers, samples, budgets and rate limits."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.constants import LIMITS
from folioscope.functions import textnorm as N


def vote3(a: Column, b: Column, c: Column, a_conf: Column | None = None, furniture: Column | None = None, stable: bool = False) -> Column:
    """What three readers' forms of a word (null where unread) say about the second's:

    agree: the third prints the same, and the first has its letters (of page furniture it
    needn't); abstain: both have its letters, but the third printed no vowel marks; abstain_a:
    the first has other letters and is unread or under 60 % sure, the others print the same;
    else disputed.
    """
    letters = lambda x: F.coalesce(F.nullif(N.normalize(x, stable=stable), F.lit("")), N.strip_diacritics(x))
    like = lambda x: F.coalesce(letters(x) == letters(b), F.lit(False))
    first = like(a) | (furniture if furniture is not None else F.lit(False))
    unsure = a.isNull() | (F.coalesce(a_conf, F.lit(0.0)) < 60 if a_conf is not None else F.lit(False))
    third, marked = like(c), lambda x: x.rlike(K.VOWEL_MARKS)
    return (
        F.when(~third, "disputed")
        .when(first & (c == b), "agree")
        .when(first & ~marked(c) & marked(b), "abstain")
        .when(~first & unsure & (c == b), "abstain_a")
        .otherwise("disputed")
    )


def dispute_groups(tokens: DataFrame, most: int = 4) -> DataFrame:
    """(block, first, last) of consecutive disputed tokens (block, tok, status), at most ``most`` each."""
    d = tokens.where(F.col("status") == "disputed")
    w = Window.partitionBy("block").orderBy("tok")
    d = d.withColumn("run", F.col("tok") - F.row_number().over(w))
    d = d.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("block", "run").orderBy("tok")) - 1) / most))
    return d.groupBy("block", "run", "part").agg(F.min("tok").alias("first"), F.max("tok").alias("last")).drop("run", "part")


def candidate_readings(groups: DataFrame) -> DataFrame:
    """(block, first, candidates): equal readings of a dispute are one candidate that names its readers.

    groups: block, first, readings (array of reader, text, in order); empty texts are no candidates.
    """
    texts = F.array_distinct(F.transform(F.filter("readings", lambda r: F.coalesce(r.text, F.lit("")) != ""), lambda r: r.text))
    merged = F.transform(texts, lambda t: F.struct(t.alias("text"), F.transform(F.filter("readings", lambda r: r.text == t), lambda r: r.reader).alias("readers")))
    return groups.select("block", "first", merged.alias("candidates"))


def progress(items: DataFrame, spots: DataFrame) -> DataFrame:
    """(page, items_total, items_done, spot_total, spot_done, spot_wrong) from items (page, decision) and spots (page, verdict)."""
    i = items.groupBy("page").agg(F.count("*").alias("items_total"), F.count("decision").alias("items_done"))
    s = spots.groupBy("page").agg(F.count("*").alias("spot_total"), F.count("verdict").alias("spot_done"), F.count_if(F.col("verdict") == "wrong").alias("spot_wrong"))
    counts = [c for c in (*i.columns, *s.columns) if c != "page"]
    return i.join(s, "page", "full").select("page", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def action_counts(reviews: DataFrame, actions: tuple[str, ...] = ("approve", "edit", "remove")) -> DataFrame:
    """One row: how many reviews (action, note) there are, of each action, and with a note."""
    return reviews.agg(F.count("*").alias("reviewed"), *[F.count_if(F.col("action") == a).alias(a) for a in actions], F.count_if(F.coalesce("note", F.lit("")) != "").alias("with_notes"))


#: Cells of a key's range that are counted at once, and into which a cell is cut again.
COARSE, FINE = 64, 1 << 16


def cut_keys(rows: DataFrame, by: str, take: DataFrame, key: str, tie: str) -> DataFrame:
    """(by, cut): the take-th smallest (key, tie) of each group, exactly.

    ``take`` has by and take (from 1 to the group's size) and is small. Keys (at
    least 0) are counted in cells, the cell of the wanted one is cut into finer
    ones and counted again; only the rows of the last cell are ever put in order.
    """
    slim = rows.select(by, F.col(key).alias("k"), F.col(tie).alias("t"))
    slim = slim.withColumn("coarse", F.floor(F.col("k") * COARSE)).withColumn("fine", F.floor((F.col("k") * COARSE - F.col("coarse")) * FINE))

    def crossed(rows: DataFrame, cell: str, due: DataFrame) -> DataFrame:
        """(by, cell, due): the cell in which a group's due-th row is, and how far in it."""
        w = Window.partitionBy(by).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
        counts = rows.groupBy(by, cell).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(w))
        counts = counts.join(F.broadcast(due), by).where((F.col("upto") >= F.col("due")) & (F.col("upto") - F.col("n") < F.col("due")))
        return counts.select(by, cell, (F.col("due") - F.col("upto") + F.col("n")).alias("due"))

    first = crossed(slim, "coarse", take.select(by, F.col("take").alias("due")))
    inside = slim.join(F.broadcast(first.select(by, "coarse")), [by, "coarse"])
    second = crossed(inside, "fine", first.select(by, "due"))
    last = inside.join(F.broadcast(second), [by, "fine"])
    w = Window.partitionBy(by).orderBy("k", "t")
    return last.withColumn("i", F.row_number().over(w)).where(F.col("i") == F.col("due")).select(by, F.struct("k", "t").alias("cut"))


def sample_strata(rows: DataFrame, id_col: str, stratum: str, rates: dict[str, float], weight: Column, seed: int = 1) -> DataFrame:
    """A weighted sample without replacement of each stratum (at least one row), by exponential
    keys -ln(u) / weight from an arithmetic hash of the id; reruns agree.

    A stratum without a rate gives one row. No stratum is ordered: its largest
    sampled key is found by counts (``cut_keys``). Strata are few, like their rates.
    """
    u = (F.pmod((F.col(id_col).cast("long") + seed) * F.lit(2654435761), F.lit(1 << 32)) + 1) / F.lit(float((1 << 32) + 1))
    keyed = rows.where(F.col(stratum).isNotNull()).withColumn("_k", -F.log(u) / weight)
    rate = F.lit(0.0)
    for name, r in rates.items():
        rate = F.when(F.col(stratum) == name, F.lit(r)).otherwise(rate)
    take = rows.groupBy(stratum).agg(F.count("*").alias("_n")).select(stratum, F.greatest(F.floor(F.col("_n") * rate), F.lit(1)).alias("take"))
    cuts = cut_keys(keyed, stratum, take, "_k", id_col)
    kept = keyed.join(F.broadcast(cuts), stratum).where(F.struct(F.col("_k").alias("k"), F.col(id_col).alias("t")) <= F.col("cut"))
    return kept.drop("_k", "cut")


def latest(decisions: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last decision of each key."""
    others = [c for c in decisions.columns if c not in (*keys, at)]
    return decisions.groupBy(*keys).agg(F.max(F.struct(at, *others)).alias("d")).select(*keys, f"d.{at}", *[f"d.{c}" for c in others])


def decide(drafts: DataFrame, decisions: DataFrame, key: str, column: str) -> DataFrame:
    """Drafts with decisions (action remove, approve or edit; value) merged over them."""
    d = decisions.select(key, "action", F.col("value").alias("_v"))
    rows = drafts.join(d, key, "left").where(F.coalesce(F.col("action") != "remove", F.lit(True)))
    return rows.withColumn(column, F.when(F.col("action") == "edit", F.col("_v")).otherwise(F.col(column))).withColumn("verified", F.coalesce(F.col("action").isin("approve", "edit"), F.lit(False))).drop("_v")


def spend(events: DataFrame, since: Column | None = None, stage_prefix: str | None = None) -> DataFrame:
    """One row: the cost of calls that were not cached; missing costs are 0."""
    rows = events.where(~F.coalesce("cached", F.lit(False)))
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    if stage_prefix:
        rows = rows.where(F.col("stage").startswith(stage_prefix))
    return rows.agg(F.coalesce(F.sum(F.coalesce("cost_usd", F.lit(0.0))), F.lit(0.0)).alias("spent"))


def daily_spend(events: DataFrame, cost: Column, cap: float, warn: float = 0.8) -> DataFrame:
    """(day, spent, total, warn, stop): spending by UTC day and in all, against a cap."""
    days = events.groupBy(F.date_trunc("DAY", F.col("ts")).cast("date").alias("day")).agg(F.round(F.sum(F.coalesce(cost, F.lit(0.0))), 2).alias("spent"))
    total = F.round(F.sum("spent").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)), 2)
    return days.withColumn("total", total).withColumn("warn", F.col("total") >= cap * warn).withColumn("stop", F.col("total") >= cap)


def choose_model(total: Column, today: Column, hard: float, daily: float) -> Column:
    return F.when(total >= hard, F.lit(None).cast("string")).when(today >= daily, "fallback").otherwise("main")


def accept(times: list[float], limit: int, seconds: float = 3600.0) -> list[bool]:
    """Which requests a sliding window accepts; rejected ones do not count, and one exactly
    ``seconds`` old still does."""
    kept, out = deque(), []
    for t in times:
        while kept and t - kept[0] > seconds:
            kept.popleft()
        ok = len(kept) < limit
        out.append(ok)
        if ok:
            kept.append(t)
    return out


def rate_limit(events: DataFrame, user: str = "user_id", limit: int = LIMITS.requests_per_hour) -> DataFrame:
    """(event_id, user, ts, allowed). A request depends on which before it were accepted, so
    requests are folded in order; a gap of more than an hour empties the window, so a
    user's requests are folded apart between such gaps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        return pdf.assign(allowed=accept([t.timestamp() for t in pdf["ts"]], limit)).drop(columns=["part"])

    rows = events.select("event_id", F.col(user).alias("user"), F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user").orderBy("ts", "event_id")
    late = F.col("ts").cast("double") - F.lag("ts").over(w).cast("double") > 3600
    rows = rows.withColumn("part", F.sum(F.coalesce(late, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Stretches of fewer requests than the limit need no fold.
    size = F.count("*").over(Window.partitionBy("user", "part"))
    rows = rows.withColumn("size", size)
    few = rows.where(F.col("size") <= limit).select("event_id", "user", "ts", F.lit(True).alias("allowed"))
    many = rows.where(F.col("size") > limit).drop("size").groupBy("user", "part").applyInPandas(run, "event_id long, user long, ts timestamp, allowed boolean")
    return few.unionByName(many)
