"""Bulk-synchronous best-fit packing.

Pieces longer than half the capacity open a sequence each; what they leave are
gaps. The other pieces are taken in bands of length, long ones first, and each
band in supersteps:

* sweep: open pieces and gaps are range-sorted together by size, largest first;
  every partition gives each piece its successor, the smallest gap that holds
  it, and puts what is left of the gap back among its gaps;
* resolve: pieces that found no gap in their partition and gaps that found no
  piece there are ranked; by the counts of both in each partition, the k-th such
  piece takes the k-th gap of the nearest partition of larger gaps;
* update: these gaps shrink, and the next superstep sorts what is still open.

A band's supersteps end when no gap holds any of its pieces; those left then
open new sequences, one after the other in each partition. The driver holds one
row of counts a partition.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, small_batches, stored, table
from .tokens import MEMO_CHUNKS, encoder, tokenizer_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Upper ends of the bands, as parts of the capacity.
BANDS = (2, 4, 16)
#: Rows that a superstep gives one task, and sequences that a task opens, at least.
TASK_ROWS, TASK_SEQUENCES = 20_000, 1024
_GAP, _OPEN, _PLACED = 0, 1, 2


def successor_sweep(capacity: int, own: list[str]):
    """Best fit inside one partition of rows sorted by size, largest first, gaps before pieces.

    Rows: kind, size, sequence_id, offset, then the piece's own columns. Pieces
    leave as placed or open, gaps at the end; open rows get part and rank. Only
    gaps that hold every piece of the partitions behind get a rank.
    """
    names = ["kind", "size", "sequence_id", "offset", "part", "rank", *own]

    def run(batches):
        part = TaskContext.get().partitionId()
        gaps: dict[int, list[int]] = {}
        sizes: list[int] = []  # the gaps there are, ascending
        open_pieces, low, kinds = 0, 0, []

        def give(size: int, sequence: int) -> None:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(sizes, size)
            gaps[size].append(sequence)

        for b in batches:
            if not b.num_rows:
                continue
            kinds = [(f.type) for f in b.schema][4:]
            at, kind, sequence, offset, rank = [], [], [], [], []
            size = b.column(1).to_pylist()
            for i, (k, n, s) in enumerate(zip(b.column(0).to_pylist(), size, b.column(2).to_pylist(), strict=True)):
                if k == _GAP:
                    give(n, s)
                    continue
                at.append(i)
                j = bisect.bisect_left(sizes, n)
                if j == len(sizes):
                    kind.append(_OPEN)
                    sequence.append(None)
                    offset.append(None)
                    rank.append(open_pieces)
                    open_pieces += 1
                    continue
                gap = sizes[j]
                s = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[j]
                if gap > n:
                    give(gap - n, s)
                kind.append(_PLACED)
                sequence.append(s)
                offset.append(capacity - gap)
                rank.append(None)
            low = size[-1]
            pieces = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pieces.column(1), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array([part] * len(at), pa.int32()), pa.array(rank, pa.int64()), *pieces.columns[4:]], names=names)
        left = [(n, s) for n in sizes for s in gaps[n]]
        first = bisect.bisect_left(left, (low, -1 << 63))
        for i in range(0, len(left), 50_000):
            some = left[i : i + 50_000]
            rank = [k - first if k >= first else None for k in range(i, i + len(some))]
            yield pa.RecordBatch.from_arrays([pa.array([_GAP] * len(some), pa.int32()), pa.array([n for n, _ in some], pa.int64()), pa.array([s for _, s in some], pa.int64()), pa.array([None] * len(some), pa.int64()), pa.array([part] * len(some), pa.int32()), pa.array(rank, pa.int64()), *(pa.nulls(len(some), t) for t in kinds)], names=names)

    return run


def resolve(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """Which open pieces take which gaps of partitions with larger ones.

    counts: (part, open pieces, ranked gaps) in order of part. Rows of the
    result: part, first rank, number, gaps' part, gaps' first rank, first slot.
    """
    rows, stack, slot = [], [], 0
    for part, pieces, gaps in counts:
        rank = 0
        while rank < pieces and stack:
            q, first, n = stack.pop()
            take = min(n, pieces - rank)
            rows.append((part, rank, take, q, first, slot))
            rank, slot = rank + take, slot + take
            if take < n:
                stack.append((q, first + take, n - take))
        if gaps:
            stack.append((part, 0, gaps))
    return np.array(rows, np.int64).reshape(-1, 6)


def _slots(swept: DataFrame, plan: np.ndarray, kind: int) -> DataFrame:
    """The open pieces or gaps, with the slot in which ``plan`` matches them; null for the others.

    The plan has at most two rows a partition.
    """
    part, first = (0, 1) if kind == _OPEN else (3, 4)
    rows = [(int(r[part]), int(r[first]), int(r[first] + r[2]), int(r[5] - r[first])) for r in plan]
    spans = F.broadcast(swept.sparkSession.createDataFrame(rows, "_part int, _from long, _to long, _shift long"))
    some = swept.where(F.col("kind") == kind)
    here = (some.part == spans._part) & (some["rank"] >= spans._from) & (some["rank"] < spans._to)
    return some.join(spans, here, "left").withColumn("slot", F.col("rank") + F.col("_shift")).drop("_part", "_from", "_to", "_shift")


def open_sequences(capacity: int, own: list[str]):
    """Pieces, longest first, one after the other into new sequences; a sequence that is left leaves its gap."""
    names = ["kind", "size", "sequence_id", "offset", *own]

    def run(batches):
        sequence, fill, types = None, capacity, []
        for b in batches:
            if not b.num_rows:
                continue
            types = [f.type for f in b.schema][4:]
            sequences, offsets, gaps = [], [], []
            for n, at in zip(b.column(1).to_pylist(), b.column(b.schema.get_field_index("at")).to_pylist(), strict=True):
                if fill + n > capacity:
                    if sequence is not None and fill < capacity:
                        gaps.append((capacity - fill, sequence))
                    sequence, fill = at, 0
                sequences.append(sequence)
                offsets.append(fill)
                fill += n
            k = len(sequences)
            yield pa.RecordBatch.from_arrays([pa.array([_PLACED] * k, pa.int32()), b.column(1), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64()), *b.columns[4:]], names=names)
            if gaps:
                yield free(gaps, types)
        if sequence is not None and fill < capacity:
            yield free([(capacity - fill, sequence)], types)

    def free(gaps, types):
        k = len(gaps)
        return pa.RecordBatch.from_arrays([pa.array([_GAP] * k, pa.int32()), pa.array([g for g, _ in gaps], pa.int64()), pa.array([s for _, s in gaps], pa.int64()), pa.nulls(k, pa.int64()), *(pa.nulls(k, t) for t in types)], names=names)

    return run


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces_of(df: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO_CHUNKS) -> DataFrame:
    """Pieces of all documents, tokenised once: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        encode, end = encoder(path, memo), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for key, ids in zip(b.column(0).to_pylist(), encode.batch(b.column(1)), strict=True):
                raw = ids.tobytes() + end
                rows += [(key, p, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for p, (s, n) in enumerate(cut(len(raw) // 4, capacity))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(columns)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        encode.rest()
        give_back()

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, PIECES)


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces whose length is 1..capacity."""
    spark = pieces.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    columns = pieces.columns
    own = [*columns, "at"]
    # The stored rows keep their number, which is also the number of a sequence that they open.
    with small_batches(spark):  # whole texts go to Python here
        numbered = stored(pieces.withColumn("at", F.monotonically_increasing_id()), "numbered-pieces")
    whole = numbered.select(F.lit(_OPEN).alias("kind"), F.col("length").alias("size"), F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"), *own)
    base = whole.columns
    empty = [F.lit(None).cast(t).alias(c) for c, t in whole.dtypes if c in own]
    wide = ", ".join(f"`{c}` {t}" for c, t in whole.dtypes[:4]) + ", part int, rank long, " + ", ".join(f"`{c}` {t}" for c, t in whole.dtypes[4:])
    narrow = ", ".join(f"`{c}` {t}" for c, t in whole.dtypes)

    def dealt(rows: DataFrame, parts: int) -> DataFrame:
        order = [F.desc("size"), F.col("kind"), F.coalesce("at", "sequence_id")]
        return rows.repartitionByRange(max(1, min(most, parts)), *order).sortWithinPartitions(*order)

    def gap_rows(rows: DataFrame, size, sequence) -> DataFrame:
        return rows.select(F.lit(_GAP).alias("kind"), size.alias("size"), F.col(sequence).alias("sequence_id"), F.lit(None).cast("long").alias("offset"), *empty)

    long = whole.where(F.col("size") * 2 > capacity).withColumn("sequence_id", F.col("at")).withColumn("offset", F.lit(0).cast("long"))
    placed = [long]
    gaps = gap_rows(long.where(F.col("size") < capacity), F.lit(capacity) - F.col("size"), "sequence_id")
    ends = [*(capacity // k for k in BANDS), 0]
    sizes = {r.band: r.n for r in whole.groupBy(sum(((F.col("size") <= e).cast("int") for e in ends[:-1]), F.lit(0)).alias("band")).agg(F.count("*").alias("n")).collect()}
    for band, (high, low) in enumerate(zip(ends, ends[1:], strict=False), 1):
        n = sizes.get(band, 0)
        if not n:
            continue
        todo = whole.where((F.col("size") <= high) & (F.col("size") > low))
        usable, aside = gaps.where(F.col("size") > low), gaps.where(F.col("size") <= low)
        spread = numbered.count() // TASK_ROWS + 1
        while True:
            swept = stored(dealt(todo.unionByName(usable), spread).mapInArrow(successor_sweep(capacity, own), wide), "swept")
            done = F.col("kind") == _PLACED
            placed.append(swept.where(done).select(base))
            counts = swept.groupBy("part").agg(F.count_if(done).alias("placed"), F.count_if(F.col("kind") == _OPEN).alias("open"), F.count_if((F.col("kind") == _GAP) & F.col("rank").isNotNull()).alias("gaps"), F.sum(F.when(F.col("kind") == _OPEN, F.col("size"))).alias("tokens"))
            counts = sorted(counts.collect(), key=lambda r: r.part)
            plan = resolve([(r.part, r.open, r.gaps) for r in counts])
            matched = int(plan[:, 2].sum())
            left = sum(r.open for r in counts) - matched
            pieces_now, gaps_now = _slots(swept, plan, _OPEN), _slots(swept, plan, _GAP)
            todo = pieces_now.where("slot is null").select(base)
            usable = gaps_now.where("slot is null").select(base)
            if matched:
                pairs = pieces_now.where("slot is not null").drop("sequence_id", "offset").join(gaps_now.where("slot is not null").select("slot", F.col("size").alias("gap"), "sequence_id"), "slot")
                pairs = stored(pairs.withColumn("offset", F.lit(capacity) - F.col("gap")), "matched")
                placed.append(pairs.select(base))
                usable = usable.unionByName(gap_rows(pairs.where("gap > size"), F.col("gap") - F.col("size"), "sequence_id"))
            if not left or not matched + sum(r.placed for r in counts):
                break
        gaps = aside.unionByName(usable)
        if left:
            tokens = sum(r.tokens or 0 for r in counts)
            opened = stored(dealt(todo, int(tokens // (capacity * TASK_SEQUENCES)) + 1).mapInArrow(open_sequences(capacity, own), narrow), "opened")
            placed.append(opened.where(F.col("kind") == _PLACED))
            gaps = gaps.unionByName(opened.where(F.col("kind") == _GAP))
    out = placed[0].select(*columns, "sequence_id", "offset")
    for more in placed[1:]:
        out = out.unionByName(more.select(*columns, "sequence_id", "offset"))
    return out


def pack_documents(df: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO_CHUNKS) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens.

    Null and empty texts hold the end id only; null ids are kept; repeated rows
    are packed as often as they come; an empty table gives no rows. Only longer
    documents are cut, however long. Other columns are left out. ``memo`` is how many
    chunks of text a worker remembers in each generation.
    """
    return pack_pieces(pieces_of(df, path, end_id, capacity, id_col, text_col, memo), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
