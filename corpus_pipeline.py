"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage
before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import join_hot, stored, table, without_keys
from folioscope.llm.jaccard_join import jaccard_classes
from folioscope.llm.mixing import mixed_rows
from folioscope.llm.packing import pack_documents
from folioscope.llm.tokens import SHARED_CHUNKS, tokenizer_path
from folioscope.llm.toxicity import CATEGORIES, category_labels, classify, fit_chain

#: The stages train, compare, draw and cut; SQL can't express the first, third and last.
ORACLE_SQL = None


def _own(docs: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for k in range(len(taken) + 1) if (n := f"{name}_{k}") not in taken) for name in names]


def _digest(docs: DataFrame) -> Column:
    """128 bits of a row's whole content, as hex; nulls are told from values and columns from each other."""
    return F.md5(F.encode(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}), "UTF-8"))


def _half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 16), 16, -10).cast("long")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go.

    Null and empty texts have no words and get the chain's verdict on none; null
    and repeated ids are judged row by row; equal texts get equal verdicts; an
    empty table stays empty; columns of any name stay as they are.
    """
    (verdicts,) = _own(docs, "verdicts")
    chain = fit_chain(docs, category_labels(table(spark, sf_dir, "labels")), list(CATEGORIES))
    toxic = F.element_at(verdicts, list(CATEGORIES).index("toxic") + 1)
    return classify(docs, chain, keep=True, out=verdicts).where(~toxic).drop(verdicts)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that five-word shingles link at 0.8 or more, one stays.

    It is the row with the smallest id, and of rows with that id the one with
    the smallest text hash; of rows equal in both, the one whose whole content has
    the smallest hash, so reruns agree. Rows without id come
    after all ids. Rows are judged one by one, by id and text hash: a repeated id
    whose texts are not linked keeps each of them. Documents without words stay,
    all of them. An empty table stays empty; columns of any name stay as they are.
    """
    place, twin, whole = _own(docs, "place", "twin", "whole")
    text = F.col("text").cast("string")
    keyed = docs.withColumn(place, F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn(twin, F.xxhash64(text, F.lit(42)))
    leaves, found = jaccard_classes(keyed.select(F.col(place).alias("doc_id"), text.alias("text"), F.col(twin).alias("tag")), words=5, num=80, den=100)
    rows = leaves.where("mark is not null").groupBy("mark", "doc_id", "tag").agg(F.count("*").alias("rows"))
    rows = rows.join(found, "mark", "left").withColumn("component", F.coalesce("component", "mark"))
    rows = stored(rows.select("component", F.struct("doc_id", "tag").alias("row"), "rows"), "judged-rows")
    groups = rows.groupBy("component").agg(F.min("row").alias("first"), F.sum("rows").alias("rows"), F.count("*").alias("kinds")).where("rows > 1")
    judged = stored(join_hot(rows.withColumnRenamed("rows", "copies"), groups.drop("rows"), "component", "kinds"), "judged")
    key = [F.col("row.doc_id").alias(place), F.col("row.tag").alias(twin)]
    # Every row of a group goes but its first; where rows equal the first one, one of them comes back.
    gone = stored(judged.where("row != first or copies > 1").select(*key).distinct(), "gone")
    back = stored(judged.where("row = first and copies > 1").select(*key).distinct(), "back")
    sure, open_ = without_keys(keyed, gone, [place, twin])
    kept = sure.unionByName(open_.join(gone, [place, twin], "left_anti"))
    if not back.isEmpty():
        firsts = without_keys(keyed, back, [place, twin])[1].join(back, [place, twin], "left_semi").withColumn(whole, _digest(docs))
        least = stored(firsts.groupBy(place, twin).agg(F.min(whole).alias(whole)), "firsts")
        kept = kept.unionByName(firsts.join(least, [place, twin, whole], "left_semi").dropDuplicates([place, twin]).drop(whole))
    return kept.select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: a document appears as often as the mix takes it.

    The draw hashes a row's whole content, in 128 bits that tell nulls from
    values, so it doesn't depend on the table's layout. Of rows equal in all
    columns, as many are written as all of them take. Documents without words
    take nothing and go. An empty table stays empty; columns of any name and type, maps
    too, stay as they are.
    """
    place, twin, copies, copy = _own(docs, "place", "twin", "copies", "copy")
    keyed = docs.withColumn(twin, _digest(docs)).withColumn(place, _half(F.col(twin), 1)).withColumn(twin, _half(F.col(twin), 17))
    mixed = mixed_rows(keyed, id_col=place, twin_col=twin).where("taken > 0")
    mixed = mixed.groupBy(F.col("doc_id").alias(place), F.col("twin").alias(twin)).agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias(copies))
    # The table of copies grows with the documents, so it is never broadcast.
    once = keyed.join(stored(mixed, "copies").hint("merge"), [place, twin]).dropDuplicates([place, twin])
    return once.withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of at most 2048 tokens.

    Null and empty texts hold the end id only; null and repeated ids and repeated
    rows are packed one by one; an empty table gives no rows; other columns go.
    """
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), memo=SHARED_CHUNKS)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
