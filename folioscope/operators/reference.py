"""Reference texts, glossaries, gradings and the views that a reader asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.constants import LIMITS

from .gates import padded
from .retrieval import fuse, ranked


def range_text(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, text): the texts of lines (book, no, text) within ranges (id, book, first, last), joined
    in order; null when there are none."""
    hits = ranges.join(lines, "book", "left").where(F.col("no").between(F.col("first"), F.col("last")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda s: s.text), " ")
    return ranges.select("id").distinct().join(hits.groupBy("id").agg(text.alias("text")), "id", "left")


def span_sources(blocks: DataFrame, bracketed: Column, unmarked: Column, furniture: tuple[str, ...] = ("page_header", "page_number")) -> DataFrame:
    """(block_id, kind, span): what to compare with the reference: the whole text of quoting blocks;
    of others the bracketed spans, and unmarked spans that are in none of them."""
    inner = F.array_join(bracketed, " ")
    spans = F.when(F.col("type") == "quran", F.array(F.struct(F.lit("block").alias("kind"), F.col("text").alias("span")))).otherwise(
        F.concat(
            F.transform(bracketed, lambda s: F.struct(F.lit("bracketed").alias("kind"), s.alias("span"))),
            F.transform(F.filter(unmarked, lambda s: ~F.contains(inner, s)), lambda s: F.struct(F.lit("unmarked").alias("kind"), s.alias("span"))),
        )
    )
    return blocks.where(~F.col("type").isin(*furniture)).select("block_id", F.explode(spans).alias("s")).select("block_id", "s.*")


def drop_contained(candidates: DataFrame) -> DataFrame:
    """Candidates (qid, book, first, last, similarity) without those that hold another one whose
    similarity is at least theirs."""
    a, b = candidates.alias("a"), candidates.alias("b")
    holds = (
        (F.col("a.qid") == F.col("b.qid")) & (F.col("a.book") == F.col("b.book")) & (F.col("a.first") <= F.col("b.first")) & (F.col("a.last") >= F.col("b.last"))
        & ((F.col("a.first") < F.col("b.first")) | (F.col("a.last") > F.col("b.last"))) & (F.col("b.similarity") >= F.col("a.similarity"))
    )
    return a.join(b, holds, "left_anti").select("a.*")


def quoted_verdict(candidates: DataFrame, most: int = 4, least: float = 0.6, behind: float = 0.3) -> DataFrame:
    """Keeps a query's exact candidates, else those with an overlap of at least
    max(least, best - behind), at most ``most``; the best one stays in any case."""
    w = Window.partitionBy("qid")
    rows = candidates.withColumn("_exact", F.max((F.col("status") == "exact").cast("int")).over(w)).withColumn("_best", F.max("overlap").over(w))
    order = Window.partitionBy("qid").orderBy(F.desc("overlap"), F.desc("similarity"), "book", "first")
    rows = rows.withColumn("place", F.row_number().over(order))
    near = (F.col("overlap") >= F.greatest(F.lit(least), F.col("_best") - behind)) & (F.col("place") <= most)
    keep = F.when(F.col("_exact") == 1, F.col("status") == "exact").otherwise(near | (F.col("place") == 1))
    return rows.where(keep).withColumn("verdict", F.when(F.col("_exact") == 1, "confirmed").otherwise("candidates")).drop("_exact", "_best")


def pages_with(refs: DataFrame, blocks: DataFrame, book: str, no: Column) -> DataFrame:
    """Distinct pages whose references (block_id, book, first, last) hold a line."""
    hits = refs.where((F.col("book") == book) & no.between(F.col("first"), F.col("last")))
    return hits.join(blocks, "block_id").select("page_id").distinct()


def verse_search(query_words: DataFrame, line_words: DataFrame, weights: DataFrame, dense: DataFrame, depth: int = LIMITS.list_depth, k: int = LIMITS.result_k) -> DataFrame:
    """Lines by the summed weights of the query's distinct words, fused with a dense list."""
    hits = query_words.distinct().join(line_words.distinct(), "word").join(weights, "word").groupBy("qid", "id").agg(F.round(F.sum("idf"), 6).alias("score")).where("score > 0")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("id"))
    lexical = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)
    return fuse([("lexical", lexical), ("dense", ranked(dense, depth))], n=k)


def glossary_request(questions: DataFrame, glossary: DataFrame, intent: str, article: str = "ال") -> DataFrame:
    """(qid, term, equivalent): the first term, in the dictionary's order, that a question asking for
    a translation has as whole words, with or without the article. Glossary: (pos, term, key, equivalent).

    Terms meet questions by their first word; the comparison is exact after that.
    """
    bare = F.regexp_replace("key", f"^{article}", "")
    forms = glossary.select("pos", "term", "equivalent", F.explode(F.array_distinct(F.array(F.col("key"), bare))).alias("form")).withColumn("head", F.element_at(F.split("form", " "), 1))
    asked = questions.where(F.col("question").rlike(intent)).select("qid", "key")
    heads = asked.select("qid", F.col("key").alias("qkey"), F.explode(F.array_distinct(F.split("key", " "))).alias("head"))
    hits = heads.join(forms, "head").where(F.contains(padded(F.col("qkey")), padded(F.col("form"))))
    return hits.groupBy("qid").agg(F.min(F.struct("pos", "term", "equivalent")).alias("g")).select("qid", "g.term", "g.equivalent")


def term_entries(texts: DataFrame, glossary: DataFrame, limit: int = 3, chars: int = 900, article: str = "ال") -> DataFrame:
    """(id, place, term, explanation): terms whose key, with or without the article, is a word of the
    text; in dictionary order, at most ``limit``."""
    forms = glossary.select("pos", "term", F.substring("explanation", 1, chars).alias("explanation"), F.explode(F.array_distinct(F.array(F.col("key"), F.regexp_replace("key", f"^{article}", ""), F.concat(F.lit(article), "key")))).alias("word"))
    hits = texts.select("id", F.explode(F.array_distinct("words")).alias("word")).join(forms, "word").select("id", "pos", "term", "explanation").distinct()
    w = Window.partitionBy("id").orderBy("pos")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("id", "place", "term", "explanation")


def grading(printed: Column, external: Column, external_state: Column, manual: Column, manual_url: Column) -> tuple[Column, Column]:
    """(status, grade): printed before external (automatic or confirmed, unless rejected), before a
    pending external one, before a manual entry with grade and source; else unverified."""
    accepted = external.isNotNull() & external_state.isin("auto", "confirmed")
    pending = external.isNotNull() & (external_state.isNull() | (external_state == "pending"))
    by_hand = manual.isNotNull() & manual_url.isNotNull()
    status = F.when(printed == "in_sahihayn", "in_sahihayn").when(accepted, "external").when(pending, "external_pending").when(by_hand, "manual").otherwise("unverified")
    return status, F.when(status == "in_sahihayn", printed).when(status.isin("external", "external_pending"), external).when(status == "manual", manual)


def budget_status(local: Column, offset: Column, remote: Column, total: float, hard: float, reserve: float, warn: float = 0.8) -> dict[str, Column]:
    """Spending against the budget: the larger of the local log (with its offset) and the remote figure."""
    spent = F.greatest(local + offset, F.coalesce(remote, F.lit(0.0)))
    return {"spent": F.round(spent, 4), "share": F.round(spent / total, 4), "warn": spent >= total * warn, "stop": spent >= hard, "eval_stop": spent >= hard - reserve}


def anchors_to_chunks(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, chunk): the first chunk of each anchor block; chunks: (chunk, block_ids)."""
    first = chunks.select("chunk", F.explode("block_ids").alias("block_id")).groupBy("block_id").agg(F.min("chunk").alias("chunk"))
    return anchors.join(first, "block_id").select("qid", "chunk").distinct()


def note_links(blocks: DataFrame, marker: Column, key: Column) -> DataFrame:
    """(page, marker, head): linked notes as (marker, first three words); the last note of a marker counts."""
    w = Window.partitionBy("page", "marker").orderBy(F.desc("ord"))
    rows = blocks.withColumn("marker", marker).where("marker is not null").withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return rows.select("page", "marker", F.array_join(F.slice(F.split(key, " "), 1, 3), " ").alias("head"))


def page_view(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages (book, no, page_id) with their blocks in order and the pages before and after."""
    w = Window.partitionBy("book").orderBy("no")
    parts = blocks.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "block_id", "type", "text"))).alias("blocks"))
    beside = lambda f, d: F.when(f("no").over(w) == F.col("no") + d, f("page_id").over(w))
    return pages.withColumn("before", beside(F.lag, -1)).withColumn("after", beside(F.lead, 1)).join(parts, "page_id", "left")


def full_page_view(pages: DataFrame, blocks: DataFrame, links: DataFrame, refs: DataFrame, reports: DataFrame) -> DataFrame:
    """``page_view`` with all that a page shows: links (page_id, anchor, note_id, confidence, method),
    refs (block_id, book, first, last, status) of its blocks, and the reports (unit_id, block_ids,
    status, grade) that share a block with it. Each is a sorted array, empty where there is none."""
    of = blocks.select("block_id", "page_id")

    def listed(rows: DataFrame, name: str, *fields: str) -> DataFrame:
        return rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    here = reports.select("unit_id", "status", "grade", F.explode("block_ids").alias("block_id")).join(of, "block_id").drop("block_id").distinct()
    out = page_view(pages, blocks)
    for part in (listed(links, "links", "anchor", "note_id", "confidence", "method"), listed(refs.join(of, "block_id"), "refs", "block_id", "book", "first", "last", "status"), listed(here, "reports", "unit_id", "status", "grade")):
        name = part.columns[-1]
        out = out.join(part, "page_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out


def with_meta(books: DataFrame, meta: DataFrame) -> DataFrame:
    """Books (book, ...) with the map of what is known about each (book, key, value; the last of equal keys by value)."""
    one = meta.groupBy("book", "key").agg(F.max("value").alias("value"))
    maps = one.groupBy("book").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("meta"))
    return books.join(maps, "book", "left").withColumn("meta", F.coalesce("meta", F.create_map().cast("map<string,string>")))


def book_view(pages: DataFrame) -> DataFrame:
    """(book, n_pages, page_ids in order)."""
    return pages.groupBy("book").agg(F.count("*").alias("n_pages"), F.transform(F.array_sort(F.collect_list(F.struct("no", "page_id"))), lambda s: s.page_id).alias("page_ids"))


def page_text(blocks: DataFrame, furniture: tuple[str, ...] = ("page_header", "page_number")) -> DataFrame:
    rows = blocks.where(~F.col("type").isin(*furniture))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s.text), "\n").alias("text"))


def uncovered_lines(lines: DataFrame, score: Column, least_conf: float = 50.0, least_letters: int = 8, least_score: float = 65.0) -> DataFrame:
    """OCR line segments (page, conf, n_segments, key) that the page's text does not hold: sure enough,
    long enough, mostly Arabic letters, with three words of three letters (two where the line has
    several segments), and a low score. ``key`` is the segment's search key."""
    arabic = lambda c: F.regexp_count(c, F.lit("[ء-ي]"))
    letters = arabic(F.col("key"))
    solid = F.greatest(F.length(F.replace("key", F.lit(" "), F.lit(""))), F.lit(1))
    long_words = F.size(F.filter(F.split("key", " "), lambda w: F.length(F.regexp_replace(w, "[^ء-ي]", "")) >= 3))
    needed = F.when(F.col("n_segments") > 1, 2).otherwise(3)
    fit = (F.col("conf") >= least_conf) & (letters >= least_letters) & (letters >= 0.8 * solid) & (long_words >= needed)
    return lines.where(fit).withColumn("score", score).where(F.col("score") < least_score)


def citation(title: Column, author: Column, edition: Column, page: Column) -> Column:
    """Title, author without what is in brackets, edition and page."""
    return F.concat_ws("، ", title, F.split(author, r" \(")[0], edition, F.concat(F.lit("ص "), page.cast("string")))


def graded_view(rows: DataFrame, default: str) -> DataFrame:
    """Reports (unit_id, narrator, status, grade, source) with ``default`` where no grade is known."""
    return rows.select("unit_id", "narrator", "status", F.coalesce("grade", F.lit(default)).alias("grade"), "source")


def baseline_view(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Fixed-size chunks (id, page_id, text) with their page's printed number; null without a page."""
    return chunks.join(pages.select("page_id", "printed"), "page_id", "left").select("id", F.lit("baseline").alias("kind"), "text", "page_id", "printed")


def line_view(lines: DataFrame) -> DataFrame:
    """Pages as their OCR lines (page, no, text) in the engine's order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda s: s.text), "\n")
    return lines.groupBy("page").agg(text.alias("text"), F.count("*").alias("n_lines"))


def passages(hits: DataFrame, units: DataFrame, blocks: DataFrame, notes: DataFrame, verses: DataFrame, pages: DataFrame) -> DataFrame:
    """Hits (qid, id, rank, ...) with all that a reader sees of a unit.

    units: id, kind, crumbs, block_ids; blocks: block_id, page_id, text; notes: anchor,
    note_id, text, attached (array of texts); verses: block_id, ref (of blocks or notes);
    pages: page_id, printed. Adds kind, crumbs, parts (blocks in the unit's order), notes
    (by block and id), refs and printed pages (sorted).
    """
    u = units.select("id", "kind", "crumbs", F.posexplode("block_ids").alias("pos", "block_id"))
    b = u.join(blocks, "block_id").join(pages, "page_id", "left")
    parts = b.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s.text).alias("parts"), F.array_sort(F.collect_set("printed")).alias("printed"), F.first("kind").alias("kind"), F.first("crumbs").alias("crumbs"))
    n = u.select("id", "pos", F.col("block_id").alias("anchor")).join(notes, "anchor")
    with_notes = n.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "note_id", F.concat_ws(" ", "text", F.array_join("attached", " ")).alias("t")))), lambda s: s.t).alias("notes"))
    own = u.select("id", "block_id").unionByName(n.select("id", F.col("note_id").alias("block_id")))
    refs = own.join(verses, "block_id").groupBy("id").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    none = F.array().cast("array<string>")
    out = hits.join(parts, "id").join(with_notes, "id", "left").join(refs, "id", "left")
    return out.withColumn("notes", F.coalesce("notes", none)).withColumn("refs", F.coalesce("refs", none))


def unit_verdicts(units: DataFrame) -> DataFrame:
    """(unit, no): units with a wording or an attribution; ``no`` counts all units before the filter.

    units: book, unit, first (place of its first block), wording, printed (null where absent).
    """
    w = Window.partitionBy("book").orderBy("first")
    return units.withColumn("no", F.row_number().over(w) - 1).where("wording is not null or printed is not null")


def chunk_anchors(chunks: DataFrame, blocks: DataFrame, kind: str = "hadith") -> DataFrame:
    """(chunk, block_id): a chunk's first block of a kind, else its first block. Chunks have block_ids, or are
    rows of chunk, pos (of any type that has an order) and block_id, of which no list has to be made."""
    each = chunks.select("chunk", F.posexplode("block_ids").alias("pos", "block_id")) if "block_ids" in chunks.columns else chunks.select("chunk", "pos", "block_id")
    rows = each.join(blocks.select("block_id", "type"), "block_id", "left")
    return rows.groupBy("chunk").agg(F.min(F.struct((F.coalesce("type", F.lit("")) != kind).alias("other"), "pos", "block_id")).alias("x")).select("chunk", "x.block_id")
