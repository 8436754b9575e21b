"""Mix sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is dealt by hash into blocks. Its target fixes how many of its blocks the mix
holds (whole epochs, then part of one). A binary tree over the output shards splits these
quotas: at each node a multivariate-hypergeometric draw says how many blocks of each
source go left, so all shards hold exact shares of a well-shuffled whole. A shard then
takes the next blocks of each source's permutation, disjoint from all others, and is
shuffled by itself.

What is planned on the driver has a fixed bound: one row per source (a mix names a target
for each, ``max_sources`` at most) and ``shards * blocks_per_shard`` blocks plus one per
source, whatever the size of the corpus. Documents are never windowed by source: the block
that a target cuts is dealt into ``SLICES`` slices, and only the slice in which the target
falls is put in order, to stop within half a document of the target.

A row is known by all its columns, and equal rows by their number among themselves, so
plans of the same rows agree however these are partitioned, and a row that stands often
is spread over the blocks like any others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscope.runtime import cut_lineage


def word_count(text: str = "text"):
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def target_sizes(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of ``sum(sizes)`` by weight, none above ``most`` times its size; the excess is shared again by weight."""
    target, open_ = [0.0] * len(sizes), [k for k, n in enumerate(sizes) if n]
    left = float(sum(sizes))
    while open_:
        weight = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] > most * sizes[k] * weight]
        if not full:
            for k in open_:
                target[k] = left * weights[k] / weight
            break
        for k in full:
            target[k] = most * sizes[k]
        left -= sum(target[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return target


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks per (shard, source): the quotas, halved down a binary tree by hypergeometric draws."""
    out = np.zeros((shards, len(quotas)), np.int64)
    total = int(quotas.sum())
    bounds = [total * k // shards for k in range(shards + 1)]
    nodes = [(0, shards, quotas)]
    while nodes:
        low, high, own = nodes.pop()
        if high - low == 1:
            out[low] = own
            continue
        middle = (low + high) // 2
        rng, need, left = np.random.default_rng([seed, low, high]), bounds[middle] - bounds[low], np.zeros_like(own)
        rest = int(own.sum())
        for k, n in enumerate(own.tolist()):  # the marginals of the multivariate draw, one after another
            rest -= n
            left[k] = rng.hypergeometric(n, rest, need) if n and need else 0
            need -= int(left[k])
        nodes += [(low, middle, left), (middle, high, own - left)]
    return out


SLICES = 1024
"""Parts of a block that a target cuts."""
EQUAL_ROWS = 4096
"""Equal rows that are numbered in one go; more are dealt anew first."""
_KEY = ["__id", "__source", "__hash"]


@dataclass
class Mix:
    """A planned mix; ``rows`` has a row per document, see ``plan``."""

    rows: DataFrame
    draws: list[tuple[int, int, int, int, bool]] = field(repr=False)  # source number, block, epoch, shard, cut
    shards: int


def _row_hash(docs: DataFrame) -> Column:
    """Hash over all columns of a row: rows with equal doc_id, source and hash are taken for equal."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def _numbered(docs: DataFrame, seed: int) -> DataFrame:
    """A row per document: key, size, ``n`` equal rows and a hash in which equal rows differ by their number."""
    keyed = docs.select(F.col("doc_id").alias("__id"), F.col("source").cast("string").alias("__source"), _row_hash(docs).alias("__hash"), word_count().alias("size"))
    same = cut_lineage(keyed.groupBy(*_KEY).agg(F.max("size").alias("size"), F.count("*").alias("n")))
    number = lambda first, n: F.explode(F.sequence(first, first + n - 1)).alias("copy")
    few = same.where(F.col("n") <= EQUAL_ROWS).select("*", number(F.lit(0).cast("long"), F.col("n")))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(EQUAL_ROWS).cast("long"))).alias("first")
    many = same.where(F.col("n") > EQUAL_ROWS).select("*", starts).repartition("__hash", "first")
    many = many.select(*_KEY, "size", "n", number(F.col("first"), F.least(F.lit(EQUAL_ROWS).cast("long"), F.col("n") - F.col("first"))))
    return few.unionByName(many).withColumn("hash", F.xxhash64("__id", "__source", "__hash", "copy", F.lit(seed)))


def plan(
    docs: DataFrame, weight: Callable[[int, str | None], float], most: float = 3.0, shards: int = 64,
    blocks_per_shard: int = 64, seed: int = 17, max_sources: int = 100_000,
) -> Mix:
    """Plan the mix of ``docs`` (doc_id, text, source): one row per document in ``rows``.

    ``weight(k, source)`` is given the source's number in code-point order, null last. Columns:
    doc_id, source, size (words), source_size, target, shards (the shard of each draw of the
    document, one per epoch that takes it) and taken (words with repeats). Documents without
    words take nothing. Repeated rows are documents of their own; null and repeated ids are
    told apart by the other columns. A source without words has target 0. More than
    ``max_sources`` sources raise.
    """
    spark = docs.sparkSession
    sized = cut_lineage(_numbered(docs, seed))
    found = sized.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources: raise max_sources, or mix by a coarser column")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    targets = target_sizes(sizes, [weight(k, r["source"]) for k, r in enumerate(found)], most)
    total, wanted = sum(sizes), shards * blocks_per_shard
    parts = [max(1, min(r["n"], round(wanted * r["size"] / total) if total else 1)) for r in found]
    sources = spark.createDataFrame(
        [(r["source"], k, n, int(r["size"]), t) for k, (r, n, t) in enumerate(zip(found, parts, targets))],
        "source string, number int, parts int, source_size long, target double",
    )
    dealt = sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("__source"))).withColumn("block", F.pmod("hash", "parts").cast("int"))
    words: list[dict[int, int]] = [{} for _ in found]
    for r in dealt.groupBy("number", "block").agg(F.sum("size").alias("size")).collect():
        words[r["number"]][r["block"]] = r["size"]

    quotas, last, sequences = np.zeros(len(found), np.int64), [], []
    for k, (size, target) in enumerate(zip(sizes, targets)):
        epochs = min(int(target // size), int(most)) if size else 0
        rest = max(0.0, target - epochs * size)
        order_ = [np.random.default_rng([seed, k, e]).permutation(parts[k]).tolist() for e in range(epochs + 1)]
        kept = 0
        while kept < parts[k] and words[k].get(order_[-1][kept], 0) <= rest:
            rest -= words[k].get(order_[-1][kept], 0)
            kept += 1
        taken = [(b, e, False) for e in range(epochs) for b in order_[e]] + [(b, epochs, False) for b in order_[-1][:kept]]
        if kept < parts[k] and rest > 0:
            last.append((k, order_[-1][kept], rest))
            taken.append((order_[-1][kept], epochs, True))
        sequences.append(taken)
        quotas[k] = len(taken)
    shares = split_quotas(quotas, shards, seed)
    draws = []
    for k, taken in enumerate(sequences):
        shard = np.repeat(np.arange(shards), shares[:, k])
        draws += [(k, b, e, int(s), cut) for (b, e, cut), s in zip(taken, shard)]

    cut = spark.createDataFrame(last, "number int, block int, room double")
    rows = dealt.join(F.broadcast(cut), ["number", "block"], "left")
    rows = rows.where("room is null").withColumn("part", F.lit(False)).drop("room").unionByName(_cut_blocks(rows.where("room is not null")))
    by_block: dict[tuple[int, int], list[tuple[int, bool]]] = {}
    for k, b, _, s, is_cut in draws:
        by_block.setdefault((k, b), []).append((s, is_cut))
    drawn = spark.createDataFrame([(*at, d) for at, d in by_block.items()], "number int, block int, draws array<struct<shard:int,cut:boolean>>")
    rows = rows.join(F.broadcast(drawn), ["number", "block"], "left")
    own = F.filter(F.coalesce("draws", F.array().cast("array<struct<shard:int,cut:boolean>>")), lambda d: (F.col("size") > 0) & (~d["cut"] | F.col("part")))
    rows = rows.withColumn("shards", F.transform(own, lambda d: d["shard"]))
    return Mix(rows.select(
        F.col("__id").alias("doc_id"), F.col("__source").alias("source"), "size", "source_size", "target",
        (F.col("size") * F.size("shards")).cast("long").alias("taken"), "shards", "__hash", "n", "hash",
    ), draws, shards)


def _cut_blocks(rows: DataFrame) -> DataFrame:
    """Rows of the blocks that are taken in part, with ``part``: in order of their hash, as long as the room holds half of a document.

    Slices are added up first; whole ones before the end are in, and one per source is put in order.
    """
    width = (1 << 32) // SLICES
    sliced = rows.withColumn("slice", F.floor(F.shiftrightunsigned("hash", 32) / width).cast("int"))
    upto = W.partitionBy("number").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sliced.groupBy("number", "slice").agg(F.sum("size").alias("words"))
    sums = sums.select("number", "slice", "words", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("before"))
    placed = sliced.join(F.broadcast(sums), ["number", "slice"])  # SLICES rows per source at most
    whole = F.col("before") + F.col("words") <= F.col("room")
    edge = ~whole & (F.col("before") < F.col("room"))
    order = W.partitionBy("number", "slice").orderBy("hash", "__id", "__hash").rowsBetween(W.unboundedPreceding, 0)
    inside = placed.where(edge).withColumn("part", F.col("before") + F.sum("size").over(order) - F.col("size") / 2 <= F.col("room"))
    made = placed.where(~edge).withColumn("part", whole).unionByName(inside)
    return made.drop("slice", "words", "before", "room")


def write_order(docs: DataFrame, mix: Mix) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as it is drawn, by shard, shuffled within each.

    ``docs`` are those that the mix was planned for. Equal rows stand for each other: all
    their draws are written from one of them. Columns stay.
    """
    names = docs.columns
    drawn = mix.rows.select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), "__hash", "n", "hash", F.posexplode("shards").alias("__epoch", "__shard")
    ).withColumn("__order", F.xxhash64("hash", "__epoch", "__shard")).drop("hash", "__epoch")
    keyed = docs.withColumn("__row", _row_hash(docs))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").cast("string").eqNullSafe(F.col("__source")) & (F.col("__row") == F.col("__hash"))
    repeats = drawn.where("n > 1").drop("n")
    single = keyed.join(drawn.where("n = 1").drop("n"), same)
    one = keyed.join(repeats.select(*_KEY).distinct(), same, "left_semi").dropDuplicates(["doc_id", "source", "__row"])
    several = one.join(repeats, same)
    mixed = single.unionByName(several).select(*[F.col(f"`{c}`") for c in names], "__shard", "__order")
    return mixed.repartitionByRange(mix.shards, "__shard").sortWithinPartitions("__shard", "__order").select(*names)
