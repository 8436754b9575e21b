"""Pack token runs into sequences: linear grouping, few-size configurations, best fit.

Documents become pieces of at most ``size`` tokens. How many pieces there are of each
length is all that packing needs, so the plan is made from at most ``size`` counts,
whatever the corpus holds: large lengths are grouped into groups of equal cardinality and
rounded up to the largest of the group; configurations of few sizes are chosen for least
slack, with as many copies as the groups allow; the actual lengths take the rounded ones'
places; small pieces go by best fit into what is left. The plan is a list of runs: pieces
``rank .. rank + n`` of one length take one place each in sequences ``sequence ..``.
Pieces then look up their place by their number within their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscope.llm.spans import blocks, text_bytes
from fleetscope.llm.tokens import encoder
from fleetscope.runtime import cut_lineage

ENCODE_BYTES = 10 << 20
SLICE_ROWS = 1024


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row: its ids and ``end_id``, cut into pieces.

    All pieces but the first have ``size`` ids. A null or empty text is the end id alone.
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        ids, at = encoder(tokenizer).encode(data, offsets)
        total = np.diff(at) + 1
        n = (total + size - 1) // size
        row = np.repeat(np.arange(len(total)), n)
        number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        head = total - (n - 1) * size
        start = np.where(number == 0, 0, head[row] + (number - 1) * size)
        length = np.where(number == 0, head[row], size)
        crc, kept = np.empty(len(row), np.int64), []
        k = 0
        for i in range(len(total)):
            own = np.r_[ids[at[i] : at[i + 1]], np.uint32(end_id)].astype("<u4")
            for _ in range(n[i]):
                part = own[start[k] : start[k] + length[k]]
                crc[k] = zlib.crc32(part.tobytes())
                if keep_ids:
                    kept.append(part.astype(np.int32))
                k += 1
        columns = [batch.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            columns.append(pa.array(kept, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for first, last in blocks(offsets, ENCODE_BYTES):
                yield cut(batch.slice(first, last - first))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


class Plan:
    """Runs (length, rank, n, sequence, offset); ``sequences`` is their number."""

    def __init__(self, counts: dict[int, int], size: int, groups: int = 400, small: int = 4):
        self.size, self.runs, self.sequences = size, [], 0
        self._used: dict[int, int] = defaultdict(int)
        self._room: dict[int, list[tuple[int, int]]] = defaultdict(list)
        counts = {k: int(n) for k, n in counts.items() if n}
        if size in counts:
            self._place(size, counts[size], self._open(counts[size]), 0)
        large = sorted((k for k in counts if size > k > size // small), reverse=True)
        self._configurations([(k, counts[k]) for k in large], groups)
        for length in sorted((k for k in counts if k <= size // small), reverse=True):
            self._best_fit(length, counts[length])

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _place(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self._used[length], n, sequence, offset))
        self._used[length] += n

    def _configurations(self, lengths: list[tuple[int, int]], groups: int) -> None:
        """Group ``lengths`` (descending), fill sequences with configurations, put actual lengths in."""
        each = -(-sum(n for _, n in lengths) // groups) or 1
        sizes: list[int] = []
        streams: list[list[list[int]]] = []  # per group: [length, pieces left]
        left = 0
        for length, n in lengths:
            while n:
                if not left:
                    if not sizes or sizes[-1] != length:
                        sizes.append(length)
                        streams.append([])
                    left = each
                take = min(n, left)
                if streams[-1] and streams[-1][-1][0] == length:
                    streams[-1][-1][1] += take
                else:
                    streams[-1].append([length, take])
                n, left = n - take, left - take
        demand = [sum(n for _, n in s) for s in streams]
        while any(demand):
            chosen = self._least_slack(sizes, demand)
            copies = min(demand[j] // chosen.count(j) for j in set(chosen))
            for j in chosen:
                demand[j] -= copies
            self._substitute(chosen, streams, copies)

    def _least_slack(self, sizes: list[int], demand: list[int]) -> list[int]:
        """The fullest configuration that holds the largest size still wanted."""
        first = next(j for j, n in enumerate(demand) if n)
        room = self.size - sizes[first]
        usable = [j for j in range(first, len(sizes)) if sizes[j] <= room and demand[j] > (j == first)]
        reach, mask, steps = 1, (1 << room + 1) - 1, []
        for j in usable:
            before = reach
            steps.append((j, before))
            for _ in range(min(demand[j] - (j == first), room // sizes[j])):
                grown = reach | reach << sizes[j] & mask
                if grown == reach:
                    break
                reach = grown
            if reach >> room & 1:
                break
        total, chosen = reach.bit_length() - 1, [first]
        for j, before in reversed(steps):
            while not before >> total & 1:
                chosen.append(j)
                total -= sizes[j]
        return chosen

    def _substitute(self, chosen: list[int], streams: list[list[list[int]]], copies: int) -> None:
        sequence = self._open(copies)
        while copies:
            heads, n = [], copies
            wanted = {j: chosen.count(j) for j in set(chosen)}
            for j, times in wanted.items():
                length, have = streams[j][-1]
                if have >= times:
                    n = min(n, have // times)
                    heads += [[length, j]] * times
                else:  # the last pieces of a length share one sequence with the next length
                    n, need, at = 1, times, len(streams[j]) - 1
                    while need:
                        take = min(need, streams[j][at][1])
                        heads += [[streams[j][at][0], j]] * take
                        need, at = need - take, at - 1
            offset = 0
            for length, j in heads:
                self._place(length, n, sequence, offset)
                offset += length
                k = len(streams[j]) - 1
                while streams[j][k][0] != length:
                    k -= 1
                streams[j][k][1] -= n
            for j in wanted:
                streams[j] = [x for x in streams[j] if x[1]]
            self._room[self.size - offset].append((sequence, n))
            sequence, copies = sequence + n, copies - n

    def _best_fit(self, length: int, n: int) -> None:
        while n:
            room = min((r for r, x in self._room.items() if r >= length and x), default=None)
            if room is None:
                times = self.size // length
                new = n // times or 1
                times = min(times, n)
                sequence = self._open(new)
                for k in range(times):
                    self._place(length, new, sequence, k * length)
                self._room[self.size - times * length].append((sequence, new))
                n -= times * new
                continue
            sequence, have = self._room[room].pop()
            take = min(have, n)
            self._place(length, take, sequence, self.size - room)
            self._room[room - length].append((sequence, take))
            if have > take:
                self._room[room].append((sequence + take, have - take))
            n -= take


def _numbered(found: DataFrame, counts: dict[int, int], size: int) -> DataFrame:
    """``found`` with ``rank``, from 0 within each length. A length is numbered in slices of about a thousand rows."""
    slices = F.array(*[F.lit(max(1, counts.get(k, 0) // SLICE_ROWS)) for k in range(1, size + 1)])
    cut = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(slices, F.col("length").cast("int")))
    sliced = found.withColumn("slice", cut)
    before = W.partitionBy("length").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = sliced.groupBy("length", "slice").agg(F.count("*").alias("n")).select(
        "length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")
    )
    own = W.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sliced.withColumn("place", F.row_number().over(own))
    return ranked.join(shifts, ["length", "slice"]).withColumn("rank", F.col("shift") + F.col("place") - 1).drop("slice", "shift", "place")


def pack(found: DataFrame, size: int, groups: int = 400) -> DataFrame:
    """``found`` (doc_id, piece, length, ids_crc32, ..., each length 1 to ``size``) with ``sequence_id`` and ``offset``.

    The plan (at most ``size`` counts in, some tens of thousands of runs out, however many
    pieces there are) goes with the tasks. No rows give no rows.
    """
    found = cut_lineage(found)
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.array(sorted(Plan(counts, size, groups).runs), np.int64).reshape(-1, 5)
    keys = runs[:, 0] << 44 | runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            values = [batch.column(k) for k in range(batch.num_columns - 1)]
            values += [pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])]
            yield pa.RecordBatch.from_arrays(values, [*names, "sequence_id", "offset"])

    names = [c for c in found.columns if c != "rank"]
    ranked = _numbered(found, counts, size).select(*names, "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
