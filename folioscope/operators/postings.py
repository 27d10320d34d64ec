"""A standing inverted index: postings written once, searched by bounds of their blocks.

BLOCK_TEXTS texts that lie together are a block. For each term and block one row
holds the texts' places in the block (delta-coded), how often the term comes in
each, and the largest part of a score that it can give in that block. Rows are
range-sorted by term and block, so a term's rows lie together and a frequent
term's rows are spread over many files.

A search never holds its questions in one place. A question's bound for a block is
the sum of its terms' largest parts; the blocks with the highest bounds are
scored first, and then only those blocks whose bound reaches the n-th best score
found there. Scores are exact, for terms that stand for all words they begin too.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.constants import LIMITS
from folioscope.sources.store import kept, scratch, scratch_path

from .ranking import best, expand_terms, half_up, ranked

#: Texts of a block, questions of a group, terms whose parts are held at once, how many parts that may be, and blocks that are scored first.
BLOCK_TEXTS, QUESTIONS, TERMS, PARTS, FIRST = 1024, 256, 1024, 1 << 20, 2
#: Rounding of scores: bounds are compared with this much slack.
SLACK = 2e-6
#: Terms up to which a search names them in the scan's filter, so that other terms' files aren't read.
NAMED_TERMS = 1000


@dataclass(frozen=True)
class Index:
    """texts (id, key, dl), blocks (block, ids, sizes), postings (term, block, n, most, places, counts)."""

    texts: DataFrame
    blocks: DataFrame
    postings: DataFrame
    terms_path: str
    size: int
    average: float
    k1: float
    b: float

    @cached_property
    def terms(self) -> DataFrame:
        """The dictionary (term, df), written by the first search that expands terms."""
        return kept(self.postings.groupBy("term").agg(F.sum("n").alias("df")), self.terms_path)


def _narrow(parts: np.ndarray, cut: np.ndarray) -> pa.Array:
    """A binary column: slices of one array of numbers, cut at the given element numbers. A slice's
    numbers take one, two or four bytes each, as its largest needs, since a shuffle keeps zeros."""
    n = np.diff(np.append(cut, len(parts)))
    top = np.maximum.reduceat(parts, cut) if len(cut) else parts[:0]
    each = np.repeat(np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4)), n)
    start = np.cumsum(each) - each
    data = np.zeros(int(each.sum()), np.uint8)
    for k in range(4):
        at = each > k
        data[start[at] + k] = parts[at] >> 8 * k & 255
    offsets = np.append(start[cut], len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _widened(column: pa.ChunkedArray, n: np.ndarray) -> np.ndarray:
    """The numbers of all rows of a column made by ``_narrow``, n of each row."""
    rows = column.to_pylist()
    data = np.frombuffer(b"".join(rows), np.uint8)
    each = np.repeat(np.array([len(r) for r in rows], np.int64) // np.maximum(n, 1), n)
    start = np.cumsum(each) - each
    out = data[start].astype(np.int64)
    for k in range(1, 4):
        at = np.flatnonzero(each > k)
        out[at] |= data[start[at] + k].astype(np.int64) << 8 * k
    return out


def _parts(counts: np.ndarray, sizes: np.ndarray, k1: float, b: float, average: float) -> np.ndarray:
    return counts * (k1 + 1) / (counts + k1 * (1 - b + b * sizes / (average or 1)))


_ROWS = "term string, block long, n long, most double, places binary, counts binary, ids binary, sizes binary"
_NAMES = [f.split()[0] for f in _ROWS.split(", ")]


def write_index(texts: DataFrame, path: str, k1: float = LIMITS.bm25_k1, b: float = LIMITS.bm25_b, block_texts: int = BLOCK_TEXTS) -> Index:
    """Builds the index of texts (id, key): keys are words between spaces. Repeated ids are
    separate texts (windows of one unit); null keys have no words; rows without id are left out."""
    spark = texts.sparkSession
    rows = texts.where("id is not null").select(F.col("id").cast("long").alias("id"), F.coalesce("key", F.lit("")).alias("key"))
    rows = kept(rows.withColumn("dl", F.size(F.filter(F.split("key", " "), lambda w: w != ""))), f"{path}/texts")
    size, total = rows.agg(F.count("*"), F.sum("dl")).first()
    average = (total or 0) / max(size, 1)

    def invert(block: pa.Table, number: int) -> pa.Table:
        block = block.sort_by([("id", "ascending"), ("key", "ascending")]).combine_chunks()
        ids, n = block.column("id").to_numpy(), block.num_rows
        words = pc.split_pattern(block.column("key").combine_chunks(), " ")
        parent = np.repeat(np.arange(n), np.diff(words.offsets.to_numpy()))
        coded = words.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        empty = names.index("").as_py()
        real = code != empty
        code, parent = code[real], parent[real]
        sizes = np.bincount(parent, minlength=n)
        pair, counts = np.unique(code * n + parent, return_counts=True)
        term, place = pair // n, pair % n
        cut = np.flatnonzero(np.append(True, term[1:] != term[:-1]))[: len(term)]
        delta = np.diff(place, prepend=0)
        delta[cut] = place[cut]
        most = np.maximum.reduceat(_parts(counts, sizes[place], k1, b, average), cut) if len(cut) else np.empty(0)
        k = len(cut)
        none = pa.nulls(k, pa.binary())
        found = pa.table(
            [names.take(pa.array(term[cut])).cast(pa.string()), pa.array(np.full(k, number)), pa.array(np.diff(np.append(cut, len(term))).astype(np.int64)), pa.array(most), _narrow(delta, cut), _narrow(counts, cut), none, none],
            names=_NAMES,
        )
        own = pa.table([pa.nulls(1, pa.string()), pa.array([number]), pa.array([n]), pa.array([0.0]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([ids.astype("<i8").tobytes()]), pa.array([sizes.astype("<u4").tobytes()])], names=_NAMES)
        return pa.concat_tables([found, own])

    def run(batches):
        number, held = TaskContext.get().partitionId() << 32, []
        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= block_texts:
                some = pa.Table.from_batches(held)
                yield from invert(some.slice(0, block_texts), number).combine_chunks().to_batches()
                number, held = number + 1, some.slice(block_texts).to_batches()
        if sum(x.num_rows for x in held):
            yield from invert(pa.Table.from_batches(held), number).combine_chunks().to_batches()

    # Texts that lie together are a block, so no text is moved, except where there are too few parts for all cores.
    parts, most = rows.select("id", "key"), max(1, -(-size // block_texts))
    least, have = min(most, spark.sparkContext.defaultParallelism), parts.rdd.getNumPartitions()
    parts = parts.repartition(least) if have < least else parts.coalesce(most)
    raw = scratch(parts.mapInArrow(run, _ROWS), "inverted")
    blocks = kept(raw.where("term is null").select("block", "ids", "sizes"), f"{path}/blocks")
    by_term = raw.where("term is not null").select("term", "block", "n", "most", "places", "counts").repartitionByRange("term", "block").sortWithinPartitions("term", "block")
    postings = kept(by_term, f"{path}/postings")
    return Index(rows, blocks, postings, f"{path}/terms", size, average, k1, b)


_STANDING: dict[tuple[str, str], Index] = {}


def standing(spark: SparkSession, name: str, texts, block_texts: int = BLOCK_TEXTS) -> Index:
    """The index that this application has under ``name``; ``texts()`` gives the texts where it has to be written,
    short ones best in blocks of more texts."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _STANDING:
        _STANDING[key] = write_index(texts(), scratch_path(spark, "index"), block_texts=block_texts)
    return _STANDING[key]


def _decode(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, count) of all postings of a table."""
    n = table.column("n").to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    delta, counts = _widened(table.column("places"), n), _widened(table.column("counts"), n)
    place = np.cumsum(delta)
    start = (np.cumsum(n) - n)[n > 0]
    base = np.zeros(len(n), np.int64)
    base[n > 0] = place[start] - delta[start]
    return row, place - base[row], counts


def _rows_of(index: Index, terms: DataFrame) -> DataFrame:
    """The postings of terms (term, ...), with their other columns."""
    few = [r.term for r in terms.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
    rows = index.postings.where(F.col("term").isin(few)) if len(few) <= NAMED_TERMS else index.postings
    return rows.join(terms, "term")


def _term_rows(index: Index, asked: DataFrame, prefix: bool) -> DataFrame:
    """(qterm, block, n, most, places, counts) of the questions' terms; where a term stands for
    several words, they are added up as one."""
    own = asked.select("qterm").distinct()
    if prefix:
        met = scratch(expand_terms(own.select(F.lit(0).alias("qid"), "qterm"), index.terms).select("qterm", "term"), "expansions")
    else:
        met = own.select("qterm", F.col("qterm").alias("term"))
    rows = _rows_of(index, met)
    if not prefix:
        return scratch(rows.select("qterm", "block", "n", "most", "places", "counts"), "term-rows")
    # Only words that share a question's term and block are added up.
    several = met.groupBy("qterm").agg(F.count("*").alias("words")).where("words > 1").select("qterm")
    one = rows.join(several, "qterm", "left_anti").select("qterm", "block", "n", "most", "places", "counts")

    def add(block: pa.Table) -> pa.Table:
        names = block.column("qterm").combine_chunks().dictionary_encode()
        row, place, counts = _decode(block)
        high = int(place.max()) + 1
        pair, inverse = np.unique(names.indices.to_numpy().astype(np.int64)[row] * high + place, return_inverse=True)
        total = np.bincount(inverse, weights=counts).astype(np.int64)
        term, at = pair // high, pair % high
        cut = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        delta = np.diff(at, prepend=0)
        delta[cut] = at[cut]
        # A sum of counts gives at most the sum of what each gives.
        most = np.bincount(names.indices.to_numpy(), weights=block.column("most").to_numpy())
        number = block.column("block")[0].as_py()
        return pa.table([names.dictionary.take(pa.array(term[cut])), pa.array(np.full(len(cut), number)), pa.array(np.diff(np.append(cut, len(term))).astype(np.int64)), pa.array(most[term[cut]]), _narrow(delta, cut), _narrow(total, cut)], names=["qterm", "block", "n", "most", "places", "counts"])

    many = rows.join(several, "qterm").select("qterm", "block", "n", "most", "places", "counts")
    summed = many.groupBy("block").applyInArrow(add, "qterm string, block long, n long, most double, places binary, counts binary")
    return scratch(one.unionByName(summed), "term-rows")


def _scored(index: Index, rows: DataFrame, asked: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(qid, id, score): the n best of each question in each of its blocks (qid, block)."""
    groups = max(1, -(-asked.select("qid").distinct().count() // QUESTIONS))
    group = F.pmod(F.xxhash64("qid"), F.lit(groups)).alias("part")
    open_ = pairs.select("qid", "block", group)
    wants = open_.join(asked, "qid").groupBy("block", "part", "qterm").agg(F.collect_list(F.struct("qid", "weight")).alias("who"))
    met = wants.join(rows, ["qterm", "block"]).select("block", "part", "n", "places", "counts", F.col("who.qid").alias("qids"), F.col("who.weight").alias("weights"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("sizes"))
    heads = open_.select("block", "part").distinct().join(index.blocks, "block")
    none = {c: F.lit(None).cast(t) for c, t in (("n", "long"), ("places", "binary"), ("counts", "binary"), ("qids", "array<long>"), ("weights", "array<double>"))}
    both = met.unionByName(heads.withColumns(none).select(met.columns))
    k1, b, average = index.k1, index.b, index.average

    def score(t: pa.Table) -> pa.Table:
        own = t.filter(pc.is_valid(t.column("ids")))
        ids, sizes = np.frombuffer(own.column("ids")[0].as_py(), "<i8"), np.frombuffer(own.column("sizes")[0].as_py(), "<u4")
        t = t.filter(pc.is_valid(t.column("n"))).combine_chunks()
        who = t.column("qids").combine_chunks()
        qids, question = np.unique(who.flatten().to_numpy(), return_inverse=True)
        weight, offsets = t.column("weights").combine_chunks().flatten().to_numpy(), who.offsets.to_numpy()
        scores = np.zeros((len(ids), len(qids)))
        terms = max(1, min(TERMS, PARTS // max(1, len(ids))))
        for i in range(0, t.num_rows, terms):
            some = t.slice(i, terms)
            row, place, counts = _decode(some)
            part, share = np.zeros((len(ids), some.num_rows)), np.zeros((some.num_rows, len(qids)))
            part[place, row] = _parts(counts, sizes[place], k1, b, average)
            own = slice(offsets[i], offsets[i + some.num_rows])
            share[np.repeat(np.arange(some.num_rows), np.diff(offsets[i : i + some.num_rows + 1])), question[own]] = weight[own]
            scores += part @ share
        scores = np.where(scores > 0, half_up(scores), -np.inf)
        found = [best(scores[:, q], ids, n, distinct=False) for q in range(len(qids))]
        at = np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64)
        column = np.repeat(np.arange(len(qids)), [len(f) for f in found])
        return pa.table([pa.array(qids[column]), pa.array(ids[at]), pa.array(scores[at, column])], names=["qid", "id", "score"])

    return both.groupBy("block", "part").applyInArrow(score, "qid long, id long, score double")


def lexical_rows(index: Index, queries: DataFrame, n: int, prefix: bool = True) -> DataFrame:
    """(qid, id, score, rank): the n best texts of each question (qid, qterm) by BM25, ties to the smaller id.

    Terms of LIMITS.prefix_term_chars letters and more match all words they begin.
    Nulls among questions and terms are left out; a question without hits gives no row.
    """
    asked = scratch(queries.where("qid is not null and qterm is not null").select(F.col("qid").cast("long").alias("qid"), "qterm").distinct(), "asked")
    rows = _term_rows(index, asked, prefix)
    df = rows.groupBy("qterm").agg(F.sum("n").alias("df"))
    raw = F.log((F.lit(index.size) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = scratch(asked.join(df, "qterm").withColumn("weight", F.when(raw > 0, raw).otherwise(F.lit(1e-6))).select("qid", "qterm", "weight"), "weights")
    bounds = asked.join(rows.select("qterm", "block", "most"), "qterm").groupBy("qid", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))
    bounds = scratch(bounds, "bounds")
    first = ranked(bounds.select("qid", F.col("block").alias("id"), F.col("bound").alias("score")), FIRST).select("qid", F.col("id").alias("block"))
    found = scratch(_scored(index, rows, asked, first, n), "first-hits")
    least = found.groupBy("qid").agg(F.sort_array(F.collect_list("score"), False).alias("s")).select("qid", F.when(F.size("s") >= n, F.col("s")[n - 1]).alias("least"))
    rest = bounds.join(least, "qid", "left").where("least is null or bound >= least - " + str(SLACK)).join(first, ["qid", "block"], "left_anti").select("qid", "block")
    found = found.unionByName(_scored(index, rows, asked, rest, n))
    return ranked(found, n)


def lexical_top(index: Index, queries: DataFrame, n: int, prefix: bool = True, windows: int = 1) -> DataFrame:
    """(qid, id, score, rank): ``lexical_rows`` by unit. With several windows a unit, the best
    ``windows`` times n rows are taken, and each unit has the place of its best row."""
    rows = lexical_rows(index, queries, n * windows, prefix)
    return ranked(rows.groupBy("qid", "id").agg(F.max("score").alias("score"), F.min("rank").alias("_at")), n, by=F.col("_at").asc()).drop("_at") if windows > 1 else rows


def without_numbers(key):
    """The key without words of digits (footnote markers are no words of a text)."""
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), key, F.lit(" ")), r"(?U) \d+(?= )", ""))


def phrase_top(index: Index, phrases: DataFrame, most: int = LIMITS.phrase_cap) -> DataFrame:
    """(qid, id, rank): the texts in which a phrase (qid, phrase) stands, as whole words, numbers aside; smallest ids first.

    Texts that hold all words of a phrase come from postings; only their keys are read and compared.
    """
    asked = phrases.where("qid is not null and phrase is not null").select(F.col("qid").cast("long").alias("qid"), "phrase").distinct()
    asked = scratch(asked.withColumn("pid", F.xxhash64("qid", "phrase")).withColumn("words", F.array_distinct(F.split("phrase", " "))), "phrases")
    words = asked.select("pid", F.size("words").alias("of"), F.explode("words").alias("term"))
    rows = _rows_of(index, words)
    whole = rows.groupBy("pid", "block").agg(F.count("*").alias("have"), F.first("of").alias("of")).where("have = of").select("pid", "block")
    rows = rows.join(whole, ["pid", "block"]).select("block", "pid", "of", "n", "places", "counts", F.lit(None).cast("binary").alias("ids"))
    heads = whole.select("block").distinct().join(index.blocks, "block").select("block", *[F.lit(None).cast(t).alias(c) for c, t in (("pid", "long"), ("of", "int"), ("n", "long"), ("places", "binary"), ("counts", "binary"))], "ids")

    def meet(t: pa.Table) -> pa.Table:
        ids = np.frombuffer(t.filter(pc.is_valid(t.column("ids"))).column("ids")[0].as_py(), "<i8")
        t = t.filter(pc.is_valid(t.column("n"))).combine_chunks()
        row, place, _ = _decode(t)
        names, which = np.unique(t.column("pid").to_numpy(), return_inverse=True)
        pair, have = np.unique(which[row] * len(ids) + place, return_counts=True)
        of = np.zeros(len(names), np.int64)
        of[which] = t.column("of").to_numpy()
        pair = pair[have == of[pair // len(ids)]]
        return pa.table([pa.array(names[pair // len(ids)]), pa.array(ids[pair % len(ids)])], names=["pid", "id"])

    # Written, so that few texts found are known to be few, and all texts are only read to meet them.
    met = scratch(rows.unionByName(heads).groupBy("block").applyInArrow(meet, "pid long, id long").distinct(), "met")
    hay = F.concat(F.lit(" "), without_numbers(F.col("key")), F.lit(" "))
    hits = met.join(asked.select("pid", "qid", "phrase"), "pid").join(index.texts.select("id", "key"), "id").where(F.contains(hay, F.concat(F.lit(" "), "phrase", F.lit(" "))))
    return ranked(hits.select("qid", "id").distinct(), most, by=F.col("id").asc())
