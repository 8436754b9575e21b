"""SimHash near-duplicates: general pigeonhole search on fingerprints.

A fingerprint is one bit per majority of shingle hashes. Fingerprints at ``radius`` or
fewer differing bits are linked; a class is what can be reached over links.

The search splits the 64 bits into parts, correlated bits together, and gives each part a
threshold of its own: with ``sum(threshold + 1) = radius + 1`` two linked fingerprints
differ by no more than the threshold in at least one part. The thresholds come from a
dynamic program over the candidate counts that a sample of fingerprints predicts, so a
part with little entropy is probed less. The plan only moves work between parts: any
plan finds all links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.links import components
from fleetscope.llm.spans import signed
from fleetscope.runtime import cut_lineage

BITS = 64
SAMPLE = 4_000
"""Fingerprints that the plan is fitted on; the index holds all of them."""
PARTS = (2, 3, 4, 5, 6)
"""Numbers of parts that a plan chooses from."""


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words (A-Z lower-cased); fewer words make one run."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())),
        np.uint64, len(words) - width + 1,
    )


def majority(hashes: np.ndarray) -> int:
    """Bit j is set if it is set in more than half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 8192):
        part = np.unpackbits(hashes[first : first + 8192].view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += part.sum(0, dtype=np.int32)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) per row; null and blank texts have fingerprint zero. Extra columns are not read."""
    return _prints(docs.select("doc_id", F.col("text").cast("string")), width, seed)


def _prints(rows: DataFrame, width: int, seed: int) -> DataFrame:
    """``rows`` with a long ``fp`` in place of their string ``text``."""
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            found = np.fromiter(
                (majority(shingle_hashes((t.as_py() or "").encode(), width, seed)) for t in texts), np.uint64, len(texts)
            )
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in others), signed(found)], [*names, "fp"])

    others = [k for k in range(len(rows.columns)) if k != at]
    names = [rows.columns[k] for k in others]
    kinds = [f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names]
    return rows.mapInArrow(run, ", ".join([*kinds, "fp long"]))


@dataclass(frozen=True)
class Plan:
    """Bit masks of the parts and how many bits are varied in each (-1: the part is not probed)."""

    masks: tuple[int, ...]
    thresholds: tuple[int, ...]

    def variations(self) -> list[tuple[int, list[int]]]:
        """For each probed part: its mask, and what to flip, nothing included."""
        out = []
        for mask, most in zip(self.masks, self.thresholds):
            bits = [1 << j for j in range(BITS) if mask >> j & 1]
            flips = [sum(c) for k in range(most + 1) for c in itertools.combinations(bits, k)]
            if flips:
                out.append((mask, flips))
        return out


def group_bits(sample: np.ndarray, parts: int) -> tuple[int, ...]:
    """Masks of ``parts`` equal parts; each bit joins the part it correlates with most."""
    rows = np.unpackbits(sample.view(np.uint8), bitorder="little").reshape(-1, BITS).astype(float)
    rows -= rows.mean(0)
    spread = np.sqrt((rows**2).sum(0)) + 1e-9
    close = np.abs(rows.T @ rows) / np.outer(spread, spread)
    np.fill_diagonal(close, 0)
    free, masks = set(range(BITS)), []
    for k in range(parts):
        size = (BITS * (k + 1)) // parts - (BITS * k) // parts
        order = sorted(free)
        own = [max(order, key=lambda j: close[j, order].max())]
        free.discard(own[0])
        while len(own) < size:
            best = max(sorted(free), key=lambda j: close[j, own].mean())
            own.append(best)
            free.discard(best)
        masks.append(sum(1 << j for j in own))
    return tuple(masks)


def make_plan(sample: np.ndarray, rows: int, radius: int = 3, parts: int | None = None) -> Plan:
    """Parts from correlations, thresholds by dynamic programming on estimated costs.

    The cost of a threshold in a part is one unit per probe and a twentieth per candidate
    pair; candidates are the sample's share of pairs within the threshold, times all pairs.
    Chance alone makes candidates too, so the share is never taken below that of evenly
    spread bits. Without ``parts`` the cheapest of PARTS stands: many short parts for few
    rows, few long ones for many. Of plans that cost the same, the one with fewer probes.
    """
    rows, found = max(rows, 1), []
    for number in (parts,) if parts else PARTS:
        masks = group_bits(sample, number) if len(sample) > 1 else tuple(
            sum(1 << j for j in range(BITS * k // number, BITS * (k + 1) // number)) for k in range(number)
        )
        costs = []
        for mask in masks:
            width, share = mask.bit_count(), np.zeros(radius + 1)
            for x in sample[:1000]:
                near = np.bitwise_count((sample ^ x) & np.uint64(mask))
                share += [np.count_nonzero(near <= t) - 1 for t in range(radius + 1)]
            share /= max(1, len(sample[:1000]) * (len(sample) - 1))
            probes = [sum(comb(width, k) for k in range(t + 1)) for t in range(radius + 1)]
            pairs = [max(s, p / 2.0**width) * rows * rows / 2 for s, p in zip(share, probes)]
            costs.append([(0.0, 0)] + [(rows * p + q / 20, p) for p, q in zip(probes, pairs)])
        best = {0: (0.0, 0, ())}  # units of threshold + 1 that are spent: cost, probes, thresholds
        for cost in costs:
            step: dict[int, tuple[float, int, tuple[int, ...]]] = {}
            for spent, (so_far, probes, chosen) in best.items():
                for units in range(radius + 2 - spent):
                    total = (so_far + cost[units][0], probes + cost[units][1], chosen + (units - 1,))
                    if spent + units not in step or total < step[spent + units]:
                        step[spent + units] = total
            best = step
        found.append((*best[radius + 1][:2], Plan(masks, best[radius + 1][2])))
    return min(found, key=lambda x: x[:2])[2]


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is joined within ``radius``, no more than needed."""
    links, left = [], values
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                got = left[near]
                links.extend((int(at), int(x)) for x in got)
                queue.extend(got)
                left = left[~near]
    return links


def _bucket_links(masks: list[int], radius: int):
    """Map over rows (key, fp) sorted by key: links within each bucket that a fingerprint owns."""

    def of(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[cuts, len(keys)])
        owned = np.zeros(len(keys), bool)
        for mask in masks:
            owned |= (fps & np.uint64(mask)) == keys
        live = np.logical_or.reduceat(owned, cuts) & (sizes > 1)
        two = cuts[live & (sizes == 2)]
        a, b = fps[two], fps[two + 1]
        near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
        found = [np.stack([a[near], b[near]], 1)]
        for first, size in zip(cuts[live & (sizes > 2)].tolist(), sizes[live & (sizes > 2)].tolist()):
            if links := forest(np.unique(fps[first : first + size]), radius):
                found.append(np.array(links, np.uint64))
        return np.unique(np.concatenate(found), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                got = [batch.column(k).to_numpy().view(np.uint64) for k in (0, 1)]
                keys, fps = (np.concatenate(x) for x in zip(held, got))
                last = int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1], "left"))
                held = [keys[last:].copy(), fps[last:].copy()]
                keys, fps = keys[:last], fps[:last]
            else:
                keys, fps = held
            if len(keys):
                links = of(keys, fps)
                yield pa.RecordBatch.from_arrays([signed(links[:, 0].copy()), signed(links[:, 1].copy())], ["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = 3, parts: int | None = None) -> DataFrame:
    """Links (a, b) between different values of ``distinct.fp`` that connect all within ``radius``.

    Each value goes to the buckets of its own parts and of all that lie within the part's
    threshold. A bucket yields a spanning forest of what lies in it, never all pairs, so a
    large group of near copies makes links in proportion to its size. Fewer than two
    values have no links.
    """
    rows = distinct.count()
    if rows < 2:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    sample = distinct.orderBy(F.xxhash64(F.col("fp"))).limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    plan = make_plan(sample.view(np.uint64), rows, radius, parts)
    keys = F.concat(*[_probes(mask, flips) for mask, flips in plan.variations()])
    dealt = distinct.select(F.explode(keys).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    run = _bucket_links([mask for mask, _ in plan.variations()], radius)
    return dealt.mapInArrow(run, "a long, b long")


def _probes(mask: int, flips: list[int]) -> Column:
    """The keys of a part: one literal array, whatever the number of flips."""
    own = F.col("fp").bitwiseAND(F.lit(_long(mask)))
    all_ = F.split(F.lit(",".join(str(_long(x)) for x in flips)), ",").cast("array<bigint>")
    return F.transform(all_, lambda x: x.bitwiseXOR(own))


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _rooted(nodes: DataFrame, radius: int, parts: int | None) -> DataFrame:
    """``nodes`` (one row per ``fp``) with ``root``, a fingerprint that names the class."""
    roots = components(links(nodes.select("fp"), radius, parts), "a", "b")
    found = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return found.select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def classes(prints: DataFrame, radius: int = 3, parts: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of (doc_id, fp): the smallest doc_id reachable over links.

    Equal fingerprints are one node. Rows with a null doc_id belong to their class but do
    not name it, unless it has no other; repeated rows come out as often as they went in.
    """
    prints = cut_lineage(prints)
    labelled = _rooted(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), radius, parts)
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(labelled.select("fp", "root").join(named, "root"), "fp").select("doc_id", "fp", "component_id")


def fingerprint_text(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, width: int = 5, radius: int = 5, parts: int | None = None, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates, the one with the smallest doc_id; columns stay.

    Of rows that share that doc_id the one with the smallest hash of its text stays. Null
    doc_ids stay only where a class has no other. Rows are known by doc_id and hash of the
    text, so a doc_id that is null or stands in several classes is decided in each by itself.
    """
    key = F.xxhash64(F.col("text").cast("string"))
    prints = _prints(docs.select("doc_id", key.alias("text_hash"), F.col("text").cast("string")), width, seed)
    rows = cut_lineage(prints.groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("n")))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min(first).alias("least")))
    kept = _rooted(nodes, radius, parts).groupBy("root").agg(F.min("least").alias("least"))
    kept = cut_lineage(kept.select(F.col("least.doc_id").alias("__kept"), F.col("least.text_hash").alias("__hash"), "least.n"))
    same = F.col("doc_id").eqNullSafe(F.col("__kept")) & (key == F.col("__hash"))
    single = docs.join(kept.where("n = 1").drop("n"), same, "left_semi")
    several = docs.join(kept.where("n > 1").drop("n"), same, "left_semi").withColumn("__hash", key)
    return single.unionByName(several.dropDuplicates(["doc_id", "__hash"]).drop("__hash"))
