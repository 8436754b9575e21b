"""Windows that repeat across a corpus: candidates by anchors, dealt to shards, answers brought back.

A window is ``window`` consecutive units (bytes or words) of one text. Its anchor is the
``gram`` units in it with the smallest hash, so equal windows have equal anchors at equal
places. The windows of a text fall into runs that share an anchor; a run's units (its
segment) hold exactly its windows, and every window of the corpus lies in one segment.

1. Texts become chunks (sets of rows, frozen in the shared folder).
2. Chunks ask by anchor which anchors occur twice anywhere, and drop the other runs.
3. Remaining segments, each distinct one once per chunk, go to shards by anchor. All equal
   windows meet in one shard, where an index decides about each window.
4. The answers go back to the chunks.

An anchor in ever different surroundings has as many segments as occurrences. Step 2 also
counts the segments of each anchor, and where they are more than ``Search.most``, step 3 deals its
windows one by one, by a hash of the whole window: equal windows still meet, no anchor is gathered whole.

Nothing grows with a group of copies but the counts of its segments, and no pairs are made.
Hashes only route and name segments of 64 bits; which windows are equal is for the index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from fleetscope.llm.spans import _LETTERS, _powers, blocks, id_bytes, ids_of, mix, span_hashes, text_bytes, word_spans
from fleetscope.runtime import cut_lineage

CHUNK_BYTES = 4 << 20
BUCKETS_PER_PARTITION = 4
"""More, smaller buckets than shuffle partitions: a task holds one at a time."""
RUN_BLOCK = 1 << 18
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)


def packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, int(n) * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


@dataclass(frozen=True)
class Units:
    """Units of several texts: hash values, where each text's begin, and their bytes' places (None for bytes)."""

    letters: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def bytes_between(self, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of the units from ``first`` up to before ``stop``."""
        return (first, stop) if self.starts is None else (self.starts[first], self.ends[stop - 1])


@dataclass(frozen=True)
class Runs:
    """Windows by shared anchor: text, first unit, number of windows, anchor and segment hash."""

    row: np.ndarray
    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    segment: np.ndarray


def units_of(data: np.ndarray, offsets: np.ndarray, words: bool) -> Units:
    if not words:
        return Units(_LETTERS[data], offsets)
    letters, starts, ends, counts = [], [], [], []
    for a, b in blocks(offsets):
        part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        s, e, row = word_spans(part, cuts)
        letters.append(span_hashes(part, s, e))
        starts.append(s + offsets[a])
        ends.append(e + offsets[a])
        counts.append(np.bincount(row, minlength=b - a))
    flat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return Units(flat(letters, np.uint64), np.r_[0, np.cumsum(flat(counts, np.int64))], flat(starts, np.int64), flat(ends, np.int64))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - width + size], x[width - size :]) if size < width else x


def runs_of(units: Units, window: int, gram: int) -> Runs:
    found = []
    for a, b in blocks(units.offsets, RUN_BLOCK):
        base = units.offsets[a]
        letters, offsets = units.letters[base : units.offsets[b]], units.offsets[a : b + 1] - base
        n = len(letters)
        if n < window:
            continue
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(letters * up[:n], out=sums[1:])
        grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        anchors = _least(grams & _HIGH | np.arange(len(grams), dtype=np.uint64), window - gram + 1) & _LOW
        inside = np.zeros(n + 1, np.int32)
        long = np.diff(offsets) >= window
        inside[offsets[:-1][long]] += 1
        inside[offsets[1:][long] - window + 1] -= 1
        valid = np.cumsum(inside[: len(anchors)]) > 0
        same = valid[1:] & valid[:-1] & (anchors[1:] == anchors[:-1])
        begins, ends = valid.copy(), valid.copy()
        begins[1:] &= ~same
        ends[:-1] &= ~same
        first = np.flatnonzero(begins)
        count = np.flatnonzero(ends) - first + 1
        stop = first + count + window - 1
        segment = mix((sums[stop] - sums[first]) * down[first] + count.astype(np.uint64))
        row = np.searchsorted(offsets, first, "right") - 1 + a
        # Anchors are small values by choice: mixed again, they spread over buckets.
        found.append((row, first + base, count, mix(~grams[anchors[first].astype(np.int64)]), segment))
    if not found:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    return Runs(*(np.concatenate(x) for x in zip(*found)))


def singly(units: Units, runs: Runs, split: np.ndarray, window: int) -> Runs:
    """``runs`` in their order, those in ``split`` as one run per window that is its own anchor."""
    times = np.where(split, runs.count, 1)
    which = np.repeat(np.arange(len(times)), times)
    first = runs.first[which] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    alone, anchor, segment = split[which], runs.anchor[which], runs.segment[which]
    up, at = _powers(window)[0][:window], np.flatnonzero(alone)
    for a in range(0, len(at), 1 << 15):
        own = at[a : a + (1 << 15)]
        letters = units.letters[first[own][:, None] + np.arange(window)]
        segment[own] = mix((letters * up).sum(1, dtype=np.uint64) + np.uint64(1))
    anchor[at] = mix(~segment[at])
    return Runs(runs.row[which], first, np.where(alone, 1, runs.count[which]), anchor, segment)


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


@dataclass(frozen=True)
class Search:
    """A kind of window; ``decide`` is the index of a shard (see ``found_windows``), ``kind`` what it says of a window."""

    window: int
    gram: int
    words: bool
    decide: Callable[[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    kind: str
    most: int = 1 << 13
    """Segments of one anchor (distinct ones per chunk) that may go to one bucket."""


@dataclass(frozen=True)
class Chunk:
    ids: list
    data: np.ndarray
    offsets: np.ndarray

    @property
    def keys(self) -> np.ndarray:
        """doc_id as integers; null comes before all."""
        return np.array([-(1 << 63) if x is None else x for x in self.ids], np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, ids, nulls, n, sizes, text) frozen; doc_id is an integer, null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in blocks(offsets, CHUNK_BYTES):
                ids, nulls = id_bytes(batch.column(0).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids]), pa.array([nulls]), pa.array([b - a]),
                    pa.array([packed(np.diff(offsets[a : b + 1]))]), pa.array([packed(data[offsets[a] : offsets[b]])]),
                ], ["ids", "nulls", "n", "sizes", "text"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    made = own.mapInArrow(run, "ids binary, nulls binary, n long, sizes binary, text binary")
    return cut_lineage(made.select(F.monotonically_increasing_id().alias("chunk"), "*"))


def _chunk(r) -> Chunk:
    offsets = np.r_[0, np.cumsum(unpacked(r["sizes"], "i8", r["n"]))]
    return Chunk(ids_of(r["ids"], r["nulls"]), unpacked(r["text"], "u1", offsets[-1]), offsets)


def _anchor_asks(search: Search, buckets: int):
    """Per chunk and bucket: 48 bits of each distinct anchor, and 0 if it is there once, else its distinct segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                chunk = _chunk(r)
                runs = runs_of(units_of(chunk.data, chunk.offsets, search.words), search.window, search.gram)
                keys, which, times = np.unique(runs.anchor >> np.uint64(16), return_inverse=True, return_counts=True)
                segments = np.bincount(which[np.unique(runs.segment, return_index=True)[1]], minlength=len(keys))
                several = np.where(times > 1, segments, 0).astype(np.uint32)
                cut = np.searchsorted(bucket_of(keys << np.uint64(16), buckets), np.arange(buckets + 1))
                rows = []
                for k in range(buckets):
                    own = keys[cut[k] : cut[k + 1]]
                    if len(own):
                        high = np.diff(own >> np.uint64(16), prepend=np.uint64(0)).astype(np.uint32)
                        rows.append((k, r["chunk"], len(own), packed(high), packed((own & np.uint64(0xFFFF)).astype(np.uint16)), packed(several[cut[k] : cut[k + 1]])))
                if rows:
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["bucket", "chunk", "n", "high", "low", "several"])

    return run


def _anchor_answers(search: Search):
    """Per chunk and bucket: bits of the anchors that occur twice, and of those with too many segments (empty if none)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, several = [], []
        for r in rows.itertuples():
            high = np.cumsum(unpacked(r.high, "u4", r.n).astype(np.uint64))
            keys.append(high << np.uint64(16) | unpacked(r.low, "u2", r.n).astype(np.uint64))
            several.append(unpacked(r.several, "u4", r.n))
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        several = np.concatenate(several)
        again = np.bincount(which, weights=1 + (several > 0)) > 1
        many = np.bincount(which, weights=np.maximum(several, 1)) > search.most
        cut = np.cumsum([0] + [len(x) for x in keys])
        bits = lambda x: packed(np.packbits(x))
        return pd.DataFrame({
            "chunk": rows.chunk, "bucket": rows.bucket, "again": [bits(again[which[a:b]]) for a, b in zip(cut, cut[1:])],
            "many": [bits(many[which[a:b]]) if many[which[a:b]].any() else b"" for a, b in zip(cut, cut[1:])],
        })

    return run


def _segment_asks(search: Search, buckets: int):
    """Per chunk and bucket: distinct segments of repeated anchors, with the times they occur and the smallest doc_id."""

    def run(key, own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        chunk = _chunk(own.iloc[0])
        units = units_of(chunk.data, chunk.offsets, search.words)
        runs = runs_of(units, search.window, search.gram)
        keys, which = np.unique(runs.anchor >> np.uint64(16), return_inverse=True)
        cut = np.searchsorted(bucket_of(keys << np.uint64(16), buckets), np.arange(buckets + 1))
        again, many = np.ones(len(keys), bool), np.zeros(len(keys), bool)
        for a in answers.itertuples():
            n = cut[a.bucket + 1] - cut[a.bucket]
            again[cut[a.bucket] : cut[a.bucket + 1]] = np.unpackbits(unpacked(a.again, "u1", (n + 7) // 8), count=n)
            if a.many:
                many[cut[a.bucket] : cut[a.bucket + 1]] = np.unpackbits(unpacked(a.many, "u1", (n + 7) // 8), count=n)
        live = np.flatnonzero(again[which]) if len(which) else np.zeros(0, np.int64)
        split = keys[many]
        if len(split):
            runs = Runs(*(x[live] for x in (runs.row, runs.first, runs.count, runs.anchor, runs.segment)))
            runs = singly(units, runs, many[which[live]], search.window)
            live = np.arange(len(runs.row))
        names, at, inverse, times = np.unique(runs.segment[live], return_index=True, return_inverse=True, return_counts=True)
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, chunk.keys[runs.row[live]])
        at = live[at]
        home = bucket_of(runs.anchor[at], buckets)
        order = np.argsort(home, kind="stable")
        names, at, times, least, home = names[order], at[order], times[order], least[order], home[order]
        begin, stop = units.bytes_between(runs.first[at], runs.first[at] + runs.count[at] + search.window - 1)
        cut, rows, text = np.searchsorted(home, np.arange(buckets + 1)), [], chunk.data.tobytes()
        for k in range(buckets):
            i, j = cut[k], cut[k + 1]
            if i < j:
                joined = b"".join(text[a:b] for a, b in zip(begin[i:j].tolist(), stop[i:j].tolist()))
                rows.append((k, key[0], j - i, len(joined), packed(names[i:j]), packed(runs.count[at[i:j]].astype(np.uint32)), packed((stop - begin)[i:j].astype(np.uint32)),
                             packed(times[i:j].astype(np.uint32)), packed(least[i:j]), pa.compress(joined, codec="zstd", asbytes=True),
                             0 if rows else len(split), b"" if rows else packed(split)))
        return pd.DataFrame(rows, columns=_SEGMENTS)

    return run


_SEGMENTS = ["bucket", "chunk", "n", "size", "names", "windows", "lengths", "times", "least", "text", "n_split", "split"]
_SEGMENT_SCHEMA = "bucket int, chunk long, n long, size long, names binary, windows binary, lengths binary, times binary, least binary, text binary, n_split long, split binary"


def _shard(search: Search):
    """Index the distinct segments of a bucket, decide about their windows, answer each chunk."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts, names, windows, lengths, times, least = [], [], [], [], [], []
        for r in rows.itertuples():
            parts.append(pa.decompress(r.text, r.size, codec="zstd", asbytes=True))
            for out, value, kind in ((names, r.names, "u8"), (windows, r.windows, "u4"), (lengths, r.lengths, "u4"), (times, r.times, "u4"), (least, r.least, "i8")):
                out.append(unpacked(value, kind, r.n).astype(np.uint64 if kind == "u8" else np.int64))
        cut = np.cumsum([0] + [len(x) for x in names])
        windows, lengths = np.concatenate(windows), np.concatenate(lengths)
        distinct, at, which = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
        total = np.bincount(which, weights=np.concatenate(times)).astype(np.int64)
        smallest = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(smallest, which, np.concatenate(least))
        begin = (np.cumsum(lengths) - lengths)[at]
        text = b"".join(parts)
        text = b"".join(text[a : a + n] for a, n in zip(begin.tolist(), lengths[at].tolist()))
        said = search.decide(text, lengths[at], windows[at], total, smallest)
        shift = np.cumsum(windows[at]) - windows[at]
        out = []
        for k, r in enumerate(rows.itertuples()):
            own = which[cut[k] : cut[k + 1]]
            size = windows[cut[k] : cut[k + 1]]
            n = int(size.sum())
            place = np.arange(n) + np.repeat(shift[own] - (np.cumsum(size) - size), size)
            values = said[place]
            change = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            out.append((r.chunk, r.n, n, len(change), r.names, packed(size.astype(np.uint32)), packed(np.diff(np.r_[change, n]).astype(np.uint32)), packed(values[change]), r.n_split, r.split))
        return pd.DataFrame(out, columns=["chunk", "n", "n_windows", "n_steps", "names", "windows", "steps", "said", "n_split", "split"])

    return run


_ANSWER = "chunk long, n long, n_windows long, n_steps long, names binary, windows binary, steps binary, said binary, n_split long, split binary"


def by_bucket(rows: DataFrame, buckets: int) -> GroupedData:
    """``rows`` grouped by bucket, a task for each: few bytes make much work there, so sizes say little."""
    return rows.repartitionById(buckets, F.col("bucket")).groupBy("bucket")


def found_windows(docs: DataFrame, search: Search, finish: Callable[[Chunk, Units, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Rows that ``finish`` makes of each chunk.

    ``search.decide(text, lengths, windows, times, least)`` gets a shard's distinct segments
    (joined bytes and lengths), how many windows each starts, how often each occurs and in
    which smallest doc_id, and returns one value per window. ``finish(chunk, units, row,
    start, said)`` gets the windows of a chunk that have a value: text, first unit, value.
    """
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = chunks(docs)
    asks = chunk.mapInArrow(_anchor_asks(search, buckets), "bucket int, chunk long, n long, high binary, low binary, several binary")
    again = by_bucket(asks, buckets).applyInPandas(_anchor_answers(search), "chunk long, bucket int, again binary, many binary")
    own = chunk.groupBy("chunk")
    segments = own.cogroup(again.groupBy("chunk")).applyInPandas(_segment_asks(search, buckets), _SEGMENT_SCHEMA)
    answers = by_bucket(segments, buckets).applyInPandas(_shard(search), _ANSWER)

    def run(key, own: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        part = _chunk(own.iloc[0])
        units = units_of(part.data, part.offsets, search.words)
        runs = runs_of(units, search.window, search.gram)
        none = np.zeros(0, np.int64)
        names, sizes, values = [none.astype(np.uint64)], [none], [np.zeros(0, search.kind)]
        for a in said.itertuples():
            if a.n_split:
                split = np.isin(runs.anchor >> np.uint64(16), unpacked(a.split, "u8", a.n_split))
                runs = singly(units, runs, split, search.window)
            names.append(unpacked(a.names, "u8", a.n))
            sizes.append(unpacked(a.windows, "u4", a.n).astype(np.int64))
            values.append(np.repeat(unpacked(a.said, search.kind, a.n_steps), unpacked(a.steps, "u4", a.n_steps)))
        names, sizes, values = np.concatenate(names), np.concatenate(sizes), np.concatenate(values)
        shift = np.cumsum(sizes) - sizes
        order = np.argsort(names, kind="stable")
        at = np.searchsorted(names[order], runs.segment)
        hit = (at < len(names)) & (np.append(names[order], np.uint64(0))[at] == runs.segment)
        live, which = np.flatnonzero(hit), order[at[hit]]
        size = runs.count[live]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return finish(part, units, np.repeat(runs.row[live], size), np.repeat(runs.first[live], size) + step, values[np.repeat(shift[which], size) + step])

    return own.cogroup(answers.groupBy("chunk")).applyInPandas(run, schema)


def covered(units: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``units`` lie in a window that begins at one of ``starts``."""
    steps = np.bincount(starts, minlength=units + 1) - np.bincount(np.minimum(starts + window, units), minlength=units + 1)
    return np.cumsum(steps[:units]) > 0
