"""Error rates, retrieval metrics, set agreement and report tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cer(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's length; 0 for two empty texts."""
    n = F.length(reference)
    return F.when(n > 0, F.levenshtein(reference, hypothesis) / n).otherwise(F.when(F.length(hypothesis) > 0, 1.0).otherwise(0.0))


def word_distance(a: list, b: list) -> int:
    """Edits between two word lists: a row of the distance table at a time, in arrays.

    Within a row, deletions run on from left to right: the smallest of what stands
    there less its place, plus the place.
    """
    numbers: dict = {}
    x = np.array([numbers.setdefault(w, len(numbers)) for w in a], np.int64)
    y = np.array([numbers.setdefault(w, len(numbers)) for w in b], np.int64)
    if len(x) > len(y):
        x, y = y, x
    place = np.arange(len(y) + 1)
    row = place.copy()
    for i, w in enumerate(x, 1):
        new = np.append(i, np.minimum(row[1:] + 1, row[:-1] + (y != w)))
        row = np.minimum.accumulate(new - place) + place
    return int(row[-1])


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word edit distance over the reference's words, for texts of any length, in Arrow batches."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(r, h):
            r, h = (r or "").split(), (h or "").split()
            return word_distance(r, h) / len(r) if r else float(bool(h))

        return pd.Series([one(r, h) for r, h in zip(a, b, strict=True)], dtype=float)

    return run(reference, hypothesis)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(gold: DataFrame, found: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Precision, recall and F1 of distinct items; 0 where a side is empty."""
    g = gold.select(*by, *keys).distinct().withColumn("_g", F.lit(1))
    f = found.select(*by, *keys).distinct().withColumn("_f", F.lit(1))
    both = g.join(f, [*by, *keys], "full").groupBy(*by).agg(F.count("_g").alias("n_gold"), F.count("_f").alias("n_found"), F.count(F.col("_g") + F.col("_f")).alias("n_both"))
    p, r = ratio(F.col("n_both"), F.col("n_found")), ratio(F.col("n_both"), F.col("n_gold"))
    out = both.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6))
    return out.withColumn("f1", F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)), 6))


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """One row: recall at k and mean reciprocal rank of (qid, id, rank) against gold (qid, id)."""
    first = ranked.join(gold, ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("first"))
    rows = gold.select("qid").distinct().join(first, "qid", "left")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 6).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def in_order(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, sorted): is the sequence of values in ascending order?"""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("_ok", F.coalesce(F.col(value) >= F.lag(value).over(w), F.lit(True))).groupBy(by).agg(F.min("_ok").alias("sorted"))


def type_accuracy(matches: DataFrame) -> DataFrame:
    """Share of gold characters whose best match (gold_id, gold_type, type, ratio, n_chars) over
    0.5 has the same type; the first of equal matches counts."""
    best = matches.groupBy("gold_id", "gold_type", "n_chars").agg(F.max(F.struct("ratio", (-F.col("pos")).alias("first"), "type")).alias("m"))
    right = (F.col("m.ratio") > 0.5) & (F.col("m.type") == F.col("gold_type"))
    return best.agg(F.round(ratio(F.sum(F.when(right, F.col("n_chars")).otherwise(0)), F.sum("n_chars")), 6).alias("accuracy"))


def consistency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(n, consistent, share): questions whose runs all agree."""
    one = rows.groupBy(by).agg((F.count_distinct(value) == 1).alias("one"))
    return one.agg(F.count("*").alias("n"), F.count_if("one").alias("consistent"), F.round(F.avg(F.col("one").cast("double")), 6).alias("share"))


def macro_means(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Unweighted means by system."""
    return rows.groupBy(by).agg(*[F.round(F.avg(c), 6).alias(c) for c in columns])


def by_marker(blocks: DataFrame) -> DataFrame:
    """Adds ``seq``: main text in its order, then notes by number; those without one come last."""
    note = (F.col("type") == "footnote").cast("int")
    w = Window.partitionBy("page").orderBy(note, F.when(note == 1, F.coalesce("number", F.lit(999))).otherwise(F.lit(0)), "ord")
    return blocks.withColumn("seq", F.row_number().over(w))


def chunk_hits(ranked: DataFrame, gold_chunks: DataFrame, k: int = 5) -> DataFrame:
    """(qid, chunk_hit): is a gold chunk (qid, id) among the first k?"""
    hit = ranked.where(F.col("rank") <= k).join(gold_chunks, ["qid", "id"], "left_semi").select("qid").distinct().withColumn("chunk_hit", F.lit(True))
    return gold_chunks.select("qid").distinct().join(hit, "qid", "left").withColumn("chunk_hit", F.coalesce("chunk_hit", F.lit(False)))


def context_complete(shown: DataFrame, needs: DataFrame) -> DataFrame:
    """(qid, complete): does one shown unit of a gold page (qid, key, gold) hold one of the needed notes (qid, need)?"""
    hits = needs.join(shown.where("gold"), "qid").where(F.contains("key", F.col("need"))).select("qid").distinct().withColumn("complete", F.lit(True))
    return needs.select("qid").distinct().join(hits, "qid", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))


def behaviour(status: Column) -> Column:
    """What an answer did, from its status."""
    return F.when(status == "referral", "refer").when(status == "abstained", "abstain").when(status.isin("answered", "glossary"), "answer").otherwise(F.coalesce(status, F.lit("error")))


def shown_verses(candidates: DataFrame, cited: DataFrame, badges: DataFrame) -> DataFrame:
    """(qid, verse): verses a reader sees, from checked candidates and badges of quoted blocks
    (qid, book, first, last) and from cited items (qid, book, no)."""
    span = lambda df: df.select("qid", "book", F.explode(F.sequence("first", "last")).alias("no"))
    rows = span(candidates).unionByName(cited.select("qid", "book", "no")).unionByName(span(badges)).distinct()
    return rows.select("qid", F.concat_ws(":", F.col("book").cast("string"), F.col("no").cast("string")).alias("verse"))


def score_answers(answers: DataFrame) -> DataFrame:
    """Adds behaviour, fabricated, cites_gold, required_cited and pass.

    answers: qid, status, allowed, shown (n quotes), verified (n that stand in their source), cited,
    gold, required (arrays of chunks; null where a question has none), unmet (array of rules),
    verse_wanted (boolean), verse_ok (boolean or null).
    """
    did = behaviour(F.col("status"))
    required = F.coalesce("required", F.array().cast("array<string>"))
    cited_all = F.size(F.array_except(required, "cited")) == 0
    share = F.when((F.size(required) > 0) & (did == "answer"), F.size(F.array_intersect(required, F.col("cited"))) / F.size(required))
    gold = F.when((F.size(F.coalesce("gold", F.array().cast("array<string>"))) > 0) & (F.col("status") == "answered"), F.arrays_overlap("gold", "cited"))
    fine = F.when(F.col("verse_wanted"), F.coalesce("verse_ok", F.lit(False))).otherwise(F.array_contains("allowed", did))
    passed = fine & (cited_all | (did != "answer")) & (F.size("unmet") == 0)
    return answers.withColumns({"behaviour": did, "fabricated": F.col("shown") - F.col("verified"), "cites_gold": gold, "required_cited": F.round(share, 6), "pass": passed})


def requirement_rules(req: Column, seen: dict[str, Column]) -> Column:
    """Names of a question's unmet requirements, of eleven kinds.

    ``req`` has, null where not asked: footnotes_all, footnotes_any, quotes_all, verses_shown_all,
    terms_cited_all, referrals_all, terms_en_all (arrays), closest_verse, language (strings),
    external_quran, glossary_explanation (booleans). ``seen``: notes, quotes, verses, closest, terms, urls
    (arrays of keys), external, quran (booleans), english_share (double), blob, explanation (strings).
    """
    none = F.array().cast("array<string>")
    asked = lambda n: F.coalesce(req[n], none)
    missing = lambda n, have, say: F.transform(F.filter(asked(n), lambda x: ~have(x)), lambda x: F.concat(F.lit(say + ": "), x))
    in_array = lambda name: lambda x: F.array_contains(seen[name], x)
    one = lambda cond, say: F.when(F.coalesce(cond, F.lit(False)), F.array(F.lit(say))).otherwise(none)
    return F.concat(
        missing("footnotes_all", in_array("notes"), "note not quoted"),
        one((F.size(asked("footnotes_any")) > 0) & ~F.arrays_overlap(asked("footnotes_any"), seen["notes"]), "none of the notes quoted"),
        missing("quotes_all", lambda x: F.exists(seen["quotes"], lambda q: F.contains(q, x)), "missing quote"),
        missing("verses_shown_all", in_array("verses"), "verse not shown"),
        one(req["closest_verse"].isNotNull() & (seen["closest"] != F.array(req["closest_verse"])), "closest verse not marked"),
        one(F.coalesce(req["external_quran"], F.lit(False)) & ~seen["quran"], "no outside verse cited"),
        missing("terms_cited_all", in_array("terms"), "term not cited"),
        missing("referrals_all", lambda x: seen["external"] & F.array_contains(seen["urls"], x), "referral not shown"),
        one((req["language"] == "en") & (seen["english_share"] < 0.5), "explanation not in English"),
        missing("terms_en_all", lambda x: F.contains(F.lower(seen["blob"]), F.lower(x)), "English term missing"),
        one(F.coalesce(req["glossary_explanation"], F.lit(False)) & (F.coalesce(seen["explanation"], F.lit("")) == ""), "no brief explanation"),
    )


def call_cost(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``cost``: the reported cost, else tokens times price (per million); calls of a retry are left out."""
    events = events.where(~F.coalesce(F.contains("prompt_version", F.lit("-retry")), F.lit(False))) if "prompt_version" in events.columns else events
    tokens = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6
    return events.join(prices, "model", "left").withColumn("cost", F.coalesce("cost_usd", tokens, F.lit(0.0))).drop("input_price", "output_price")


def unmet(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that do not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules]))


def class_report(scores: DataFrame, questions: DataFrame, first_run) -> DataFrame:
    """(metric, value, n): how a run answered, by class of question; a metric without rows is left out.

    scores: run, qid, behaviour, passed, cites_gold (null where not asked), unmet (array), shown,
    fabricated, book, traced; questions: qid, source, expected, required (array or null), asked_for
    (has requirements). All is of ``first_run`` but consistent, the share of questions
    asked in several runs that were answered alike in all of them.
    """
    rows = scores.join(questions, "qid")
    own = rows.where(F.col("run") == first_run)
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    expected, passed = F.col("expected"), F.col("passed")
    shares = {
        "passed": (F.lit(True), passed), "answered_from_book": ((F.col("source") != "official") & (expected == "answer"), passed), "cites_gold": ((expected == "answer") & F.col("cites_gold").isNotNull(), F.col("cites_gold")),
        "abstained": (expected == "abstain", passed), "referred": (expected == "refer", passed), "verse_corrected": (expected == "correct_verse", passed), "all_evidence": (some(F.col("required")), passed), "requirements_met": (F.col("asked_for"), ~some(F.col("unmet"))),
    }
    flag = lambda c: F.coalesce(c, F.lit(False))
    one = lambda name, hits, n: F.struct(F.lit(name).alias("metric"), (hits / F.nullif(n, F.lit(0))).alias("value"), n.cast("long").alias("n"))
    found = [one(name, F.count_if(flag(of) & flag(c)), F.count_if(flag(of))) for name, (of, c) in shares.items()]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    found += [one("quotes_verified", total("shown") - total("fabricated"), total("shown")), one("quotes_traced", total("traced"), total("book"))]
    report = own.agg(F.array(*found).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    runs = rows.groupBy("qid").agg(F.count_distinct("run").alias("runs"), F.count_distinct("behaviour").alias("kinds"), F.count_if(F.col("run") == first_run).alias("own")).where("runs > 1 and own > 0")
    alike = runs.agg(F.lit("consistent").alias("metric"), (F.count_if(F.col("kinds") == 1) / F.nullif(F.count("*"), F.lit(0))).alias("value"), F.count("*").alias("n"))
    return report.unionByName(alike).where("n > 0").select("metric", F.round("value", 6).alias("value"), "n")
