"""Packing of documents into sequences of a fixed number of tokens: best-two-fit on counts of lengths.

Every text is encoded once; its ids and an end id are cut into pieces, the first of which may be shorter. What a packing
needs to know of a piece is its length, and there are only ``CAPACITY`` lengths. So the plan is made on a table of counts
(a row a length, whatever the input's size): a sequence is filled greedily, the longest piece that fits first; then its smallest
piece is replaced by two unpacked ones whose sum fits the expanded gap more tightly, the tightest pair. The same
sequence comes out again as long as all its lengths last, so it is planned once with its number of repetitions; the result is that of the method
run piece by piece. The plan is a bounded table of runs: so many pieces of a length, from a rank on, go to so
many sequences from a number on, at given offsets.

A piece finds its place by its rank among the pieces of its length: its number inside its task, and the pieces of that
length in tasks before. No piece is moved for that unless the table of these counts outgrows what may be sent to every task.

Cases: a null or empty text is its end id. Repeated documents and ids are packed as often as they occur; null ids stay null.
An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import sent_if_small, shared_folder
from pulsegrid.llm.token_files import encoder_of, slices_of

CAPACITY = 2048
END_ID = 0
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("part", pa.int32()), ("nth", pa.int64())])


# ---- pieces

def cut(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For documents of so many ids: each piece's document, number, start and length."""
    first = (counts - 1) % capacity + 1
    n = (counts - first) // capacity + 1
    doc = np.repeat(np.arange(len(counts)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
    return doc, piece, start, np.where(piece > 0, capacity, first[doc])


def _encode(tokenizer_path: str, capacity: int, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), encoder_of(tokenizer_path)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, hi in slices_of(batch.column(1)):
                ids, counts = encoder.encode(batch.column(1).slice(lo, hi - lo))
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                doc, piece, start, length = cut(counts + 1, capacity)
                # the number of a piece among those of its length so far
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                nth = np.empty(len(order), np.int64)
                nth[order] = np.arange(len(order)) - np.searchsorted(ordered, ordered) + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                edges = np.concatenate([[0], np.cumsum(length)]) * 4
                for a in range(0, len(doc), 10_000):  # a binary array holds less than 2 GB
                    b = min(len(doc), a + 10_000)
                    data = ids[edges[a] // 4:edges[b] // 4].tobytes()
                    blobs = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((edges[a:b + 1] - edges[a]).astype(np.int32)), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(lo, hi - lo).take(pa.array(doc[a:b])), pa.array(piece[a:b], pa.int32()), pa.array(start[a:b], pa.int64()),
                        pa.array(length[a:b], pa.int64()), blobs, pa.array(np.full(b - a, part), pa.int32()), pa.array(nth[a:b])], schema=PIECES)
    return encode


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents, written to the shared folder: (doc_id, piece, start, length, ids, part, nth).

    ``ids`` are little-endian unsigned 32-bit; ``nth`` numbers the pieces of one length inside ``part``, from 0.
    """
    spark = docs.sparkSession
    path = shared_folder(spark, "pieces")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_encode(tokenizer_path, capacity, end_id), "doc_id bigint, piece int, start bigint, length bigint, ids binary, part int, nth bigint")
    found.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(found.schema).parquet(path)


# ---- plan

def best_pair(present: np.ndarray, left: np.ndarray, room: int, above: int) -> tuple[int, int] | None:
    """Two lengths still there whose sum is the largest in (``above``, ``room``]; of equal sums that with the longest piece."""
    if not len(present):
        return None
    at = np.searchsorted(present, room - present, side="right") - 1
    mine = np.arange(len(present))
    fits = (at > mine) | ((at == mine) & (left[present] > 1))
    sums = np.where(fits, present + present[np.maximum(at, 0)], 0)
    k = int(np.argmax(sums))
    return (int(present[at[k]]), int(present[k])) if sums[k] > above else None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> pd.DataFrame:
    """Best-two-fit for ``counts[length]`` pieces.

    Rows (length, rank, per, times, sequence, offsets): from ``rank`` on, ``per`` pieces of that length go to each of ``times`` sequences from
    ``sequence`` on, to ``offsets``.
    """
    left = counts.astype(np.int64).copy()
    given = np.zeros(len(left), np.int64)
    rows, sequence = [], 0
    present = np.flatnonzero(left)
    while len(present):
        gap, fill, lengths = capacity, {}, present.tolist()
        k = len(lengths)
        while k and gap >= lengths[0]:
            k = bisect_right(lengths, gap, 0, k)
            if not k:
                break
            k -= 1
            x = lengths[k]
            fill[x] = min(int(left[x]), gap // x)
            gap -= fill[x] * x
        use, need = dict(fill), dict(fill)
        if gap and sum(fill.values()) > 1:
            smallest = min(fill)
            rest = left.copy()
            for x, n in fill.items():
                rest[x] -= n
            pair = best_pair(present[rest[present] > 0], rest, gap + smallest, smallest)
            if pair:
                use[smallest] -= 1
                for x in pair:
                    use[x], need[x] = use.get(x, 0) + 1, need.get(x, 0) + 1
        use = {x: n for x, n in use.items() if n}
        times = min((int(left[x]) - need[x]) // n + 1 for x, n in use.items())
        offset = 0
        for x, n in sorted(use.items(), reverse=True):
            rows.append((x, int(given[x]), n, times, sequence, [offset + i * x for i in range(n)]))
            offset += n * x
            given[x] += n * times
            left[x] -= n * times
        sequence += times
        if any(not left[x] for x in use):
            present = np.flatnonzero(left)
    return pd.DataFrame(rows, columns=["length", "rank", "per", "times", "sequence", "offsets"])


def places_of(planned: pd.DataFrame):
    """A column function of (length, rank) that gives (sequence_id, offset)."""
    planned = planned.sort_values(["length", "rank"])
    shift = 40  # ranks fit in so many bits
    starts = (planned["length"].to_numpy(np.int64) << shift) + planned["rank"].to_numpy(np.int64)
    per, sequence = planned["per"].to_numpy(np.int64), planned["sequence"].to_numpy(np.int64)
    offsets = np.array([x for row in planned["offsets"] for x in row], np.int64)
    firsts = np.cumsum(per) - per

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy(np.int64) << shift) + rank.to_numpy(np.int64)
        row = np.searchsorted(starts, key, side="right") - 1
        n = key - starts[row]
        return pd.DataFrame({"sequence_id": sequence[row] + n // per[row], "offset": offsets[firsts[row] + n % per[row]]})
    return place


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of ``docs`` with their places: (doc_id, piece, start, length, ids, sequence_id, offset)."""
    pieces = pieces_of(docs, tokenizer_path, capacity, end_id)
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():  # a row a length
        counts[length] = n
    place = places_of(plan(counts, capacity))
    ranked = pieces.join(sent_if_small(before), ["part", "length"])
    at = place("length", F.col("nth") + F.col("before"))
    return ranked.withColumn("_at", at).select("doc_id", "piece", "start", "length", "ids", "_at.sequence_id", "_at.offset")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = pack(docs, public_tokenizers.path(vocabulary))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
