"""Content-defined chunk fingerprints of texts, and how much of one text another holds.

A gear hash over the last 16 bytes marks boundaries. Chunk lengths are normalised: up to
the usual length a boundary needs more zero bits than beyond it, so lengths gather around
the usual one. Boundaries depend on content alone; an edit changes the chunks it touches
and no others. A fingerprint is the set of chunk digests with their lengths; likeness is
the share of its length that the other set holds too.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST, USUAL, MOST = 16, 48, 192
STRICT, LOOSE = 0x7F, 0x0F
GEAR = np.random.default_rng(16).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLOCK = 1 << 20

Chunks = dict[int, int]


def chunk_sets(texts: list[bytes]) -> list[Chunks]:
    """For each text its chunks: digest (32 bits) to length in bytes. Equal texts have equal sets."""
    joined = b"".join(texts)
    gear = GEAR[np.frombuffer(joined, np.uint8)]
    for k in (1, 2, 4, 8):
        shifted = gear.copy()
        shifted[k:] += gear[:-k] << np.uint64(k)
        gear = shifted
    bits = gear >> np.uint64(50)
    strict = np.flatnonzero(bits & np.uint64(STRICT) == 0).tolist()
    loose = np.flatnonzero(bits & np.uint64(LOOSE) == 0).tolist()
    strict.append(len(joined) + MOST)
    loose.append(len(joined) + MOST)
    digest, out, begin = xxhash.xxh32_intdigest, [], 0
    for text in texts:
        found: Chunks = {}
        end, at = begin + len(text), begin
        while at < end:
            # a boundary before LEAST bytes would see bytes of the chunk before
            cut = strict[bisect_left(strict, at + LEAST - 1)] + 1
            if cut > at + USUAL:
                cut = min(loose[bisect_left(loose, at + USUAL)] + 1, at + MOST)
            cut = min(cut, end)
            found[digest(joined[at:cut])] = cut - at
            at = cut
        out.append(found)
        begin = end
    return out


def held(own: Chunks, other: Chunks) -> float:
    """Share of the length of ``own`` that ``other`` has too; two empty sets are alike."""
    if not own:
        return 0.0 if other else 1.0
    return sum(n for k, n in own.items() if k in other) / sum(own.values())


def written(chunks: Chunks) -> str:
    return " ".join(f"{k:08x}:{n}" for k, n in sorted(chunks.items()))


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _compared(ids: list, own: list[str], following: list[str], kind: pa.DataType) -> pa.RecordBatch:
    edited = []
    for text, after in zip(own, following):
        half = len(text) // 2
        edited.append((text[: len(text) - half] + after[:half]).encode())
    first, second, third = chunk_sets([x.encode() for x in own]), chunk_sets(edited), chunk_sets([x.encode() for x in following])
    return pa.RecordBatch.from_arrays([
        pa.array(ids, kind), pa.array([len(x) for x in own], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
        pa.array([written(x) for x in first], pa.string()), pa.array([written(x) for x in second], pa.string()),
        pa.array([held(a, b) for a, b in zip(first, second)], pa.float64()),
        pa.array([held(a, b) for a, b in zip(first, third)], pa.float64()),
    ], ["doc_id", *_NAMES])


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row (bucket, doc_id, text) with the next of its bucket; the last of a bucket is left out."""
    before, ids, own, following, size = None, [], [], [], 0
    kind = None
    for batch in batches:
        kind = batch.column(1).type
        for bucket, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            if before is not None and before[0] == bucket:
                ids.append(before[1])
                own.append(before[2])
                following.append(text)
                size += len(text)
                if size > BLOCK:
                    yield _compared(ids, own, following, kind)
                    ids, own, following, size = [], [], [], 0
            before = (bucket, key, text)
    if ids:
        yield _compared(ids, own, following, kind)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            key, text, after = (batch.column(c).slice(k, 1).to_pylist() for c in range(3))
            yield _compared(key, text, after, batch.column(0).type)


def _range(bounds: list[float], value: Column) -> Column:
    """How many of ``bounds`` (ascending) lie at or below ``value``; 0 for null. A tree of comparisons, no lookup table."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= bounds[middle], between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(bounds))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Per row: fingerprints of its text and of an edit of it, and their likeness.

    The edit puts the first characters of the next document in place of the last half. Next
    is by ascending doc_id (null first), then text; after the last comes the first. Null
    texts are empty; repeated rows each count; a single row is its own next. Documents are
    dealt in ranges of doc_id and read in order, so each text moves once; only the ranges'
    ends (two rows each) are joined. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.1 / ranges)
    placed = docs.withColumn("bucket", _range(sorted(set(bounds)), F.col("doc_id").cast("double")))

    schema = f"doc_id {kind}, {_RESULT}"
    dealt = placed.select("bucket", "doc_id", "text").repartition("bucket").sortWithinPartitions("bucket", "doc_id", "text")
    inner = dealt.mapInArrow(_along, schema)

    ends = placed.groupBy("bucket").agg(F.min(F.struct("doc_id")).alias("a"), F.max(F.struct("doc_id")).alias("b"))
    keys = F.broadcast(ends.select("bucket", F.explode(F.array("a.doc_id", "b.doc_id")).alias("key")).distinct())
    texts = placed.withColumnRenamed("bucket", "__bucket").join(keys, (F.col("__bucket") == F.col("bucket")) & F.col("doc_id").eqNullSafe(F.col("key")), "left_semi")
    rows = F.struct("doc_id", "text")
    edge = texts.groupBy(F.col("__bucket").alias("bucket")).agg(F.min(rows).alias("first"), F.max(rows).alias("last"))
    order = W.orderBy("bucket")
    after = ends.select("bucket", F.lead("bucket").over(order).alias("next"), F.min("bucket").over(W.partitionBy()).alias("wrap"))
    after = after.select("bucket", F.coalesce("next", "wrap").alias("next"))
    joined = edge.select("bucket", "last").join(after, "bucket").join(edge.select(F.col("bucket").alias("next"), "first"), "next")
    outer = joined.select("last.doc_id", "last.text", F.col("first.text").alias("after")).mapInArrow(_pairs, schema)
    return inner.union(outer)
