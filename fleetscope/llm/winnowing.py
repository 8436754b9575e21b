"""Benchmark decontamination by winnowing.

Of each ``window`` consecutive words the ``gram``-gram with the smallest hash is kept as a
fingerprint, so any shared span of ``window`` words has a fingerprint in common, at the same
place on both sides. Benchmark items give fingerprints and windows; they make two bit
filters of bounded size. A document's fingerprints that pass the first filter are extended
to the windows around them; windows that pass the second are joined with the benchmark's on
their whole text. Filters and hashes only keep rows out of the join: what is a hit is
decided by the words themselves.

Items shorter than a window are one window of all their words. Winnowing promises nothing
for spans that short, so each of their few lengths is looked up at every place.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.spans import LOWER, blocks, mix, signed, span_hashes, text_bytes, word_spans
from fleetscope.runtime import cut_lineage

OUTSIDE = np.ones(256, bool)
OUTSIDE[0x30:0x3A] = OUTSIDE[0x61:0x7B] = OUTSIDE[0x80:] = False
"""Bytes between words, of texts with A-Z lower-cased."""
FILTER_BITS = (15, 27)
"""A filter has 16 bits per benchmark window, but no fewer and no more than 2 to these powers."""


def gram_hashes(letters: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive word hashes, in order."""
    n = len(letters) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    found = np.full(n, size, np.uint64)
    for k in range(size):
        found = mix(found ^ letters[k : k + n])
    return found


def inner(counts: np.ndarray, size: int) -> np.ndarray:
    """First words of the runs of ``size`` words that stay within a text; ``counts`` are the words per text."""
    runs = np.maximum(counts - size + 1, 0)
    base = np.cumsum(counts) - counts
    return np.arange(int(runs.sum())) + np.repeat(base - (np.cumsum(runs) - runs), runs)


def anchors(letters: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes of a text, place of the smallest in each window that begins at ``starts``); the leftmost of equals."""
    grams = gram_hashes(letters, gram)
    place = starts.copy()
    for k in range(1, window - gram + 1):
        other = starts + k
        better = grams[other] < grams[place]
        place[better] = other[better]
    return grams, place


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64)


def passes(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = slots(hashes, 8 * len(filter_))
    return filter_[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


class Words:
    """Lower-cased words of several texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lower = LOWER[data]
        self.starts, self.ends, row = word_spans(lower, offsets, OUTSIDE)
        self.counts = np.bincount(row, minlength=len(offsets) - 1)
        self.first = np.cumsum(self.counts) - self.counts
        self.row = row
        self.letters = span_hashes(lower, self.starts, self.ends)
        self.text = lower.tobytes()

    def joined(self, first: int, size: int) -> str:
        own = zip(self.starts[first : first + size].tolist(), self.ends[first : first + size].tolist())
        return b" ".join(self.text[a:b] for a, b in own).decode()


def item_windows(items: DataFrame, window: int, gram: int) -> DataFrame:
    """(item string, window string, words int, print long, hash long): the windows of each item, with their fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            words = Words(data, offsets)
            starts = inner(words.counts, window)
            grams, place = anchors(words.letters, starts, window, gram)
            whole = gram_hashes(words.letters, window)
            size = np.full(len(starts), window)
            prints, hashes = grams[place], whole[starts]
            short = np.flatnonzero((words.counts < window) & (words.counts > 0))
            for m in np.unique(words.counts[short]).tolist():
                own = words.first[short[words.counts[short] == m]]
                found = gram_hashes(words.letters, m)[own]
                starts, size = np.r_[starts, own], np.r_[size, np.full(len(own), m)]
                prints, hashes = np.r_[prints, found], np.r_[hashes, found]
            texts = [words.joined(a, n) for a, n in zip(starts.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(words.row[starts])), pa.array(texts, pa.string()), pa.array(size.astype(np.int32)), signed(prints), signed(hashes),
            ], ["item", "window", "words", "print", "hash"])

    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string"))
    return own.mapInArrow(run, "item string, window string, words int, print long, hash long")


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The filter of a column ``hash``, ``bits / 8`` bytes whatever the number of hashes."""
    slot = F.shiftrightunsigned("hash", 20).bitwiseAND(F.lit(bits - 1)) + 1
    parts = hashes.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def candidates(docs: DataFrame, window: int, gram: int, short: list[int], prints: np.ndarray, hashes: np.ndarray) -> DataFrame:
    """(key, doc_id, n_words, hits) per row, frozen: the windows that pass both filters, each as (start, words, window)."""
    kind_of = pa.struct([("start", pa.int32()), ("words", pa.int32()), ("window", pa.string())])

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        words = Words(data, offsets)
        starts = inner(words.counts, window)
        grams, place = anchors(words.letters, starts, window, gram)
        kept = np.unique(place)  # the fingerprints
        live = np.zeros(len(grams), bool)
        live[kept[passes(prints, grams[kept])]] = True
        starts = starts[live[place]]
        own = np.full(len(starts), window, np.uint64)
        for k in range(window):
            own = mix(own ^ words.letters[starts + k])
        starts = starts[passes(hashes, own)]
        size = np.full(len(starts), window)
        for m in short:
            at = inner(words.counts, m)
            at = at[passes(hashes, gram_hashes(words.letters, m)[at])] if len(at) else at
            starts, size = np.r_[starts, at], np.r_[size, np.full(len(at), m)]
        row = words.row[starts]
        order = np.lexsort((starts, row))
        starts, size, row = starts[order], size[order], row[order]
        texts = [words.joined(a, n) for a, n in zip(starts.tolist(), size.tolist())]
        inside = pa.StructArray.from_arrays(
            [pa.array((starts - words.first[row]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(texts, pa.string())], fields=list(kind_of)
        )
        cuts = np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), inside)], ["doc_id", "n_words", "hits"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for a, b in blocks(offsets):
                yield find(batch.slice(a, b - a))

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_words long, hits array<struct<start:int,words:int,window:string>>"
    )
    return cut_lineage(made.withColumn("key", F.monotonically_increasing_id()))


def covered(spans: Column) -> Column:
    """Words that lie in at least one of the (start, stop) spans."""
    zero = F.struct(F.lit(0).alias("until"), F.lit(0).alias("n"))

    def add(done: Column, span: Column) -> Column:
        new = F.greatest(F.lit(0), span["stop"] - F.greatest(span["start"], done["until"]))
        return F.struct(F.greatest(done["until"], span["stop"]).alias("until"), (done["n"] + new).alias("n"))

    return F.aggregate(F.sort_array(spans), zero, add)["n"].cast("long")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of ``window`` consecutive words of an item, or of
    all the words of an item that has fewer. n_items counts the ids of items with such an
    occurrence; items_sha256 is of those ids, sorted as text and joined by commas. Null and
    wordless texts have no words, items among them no windows; a null item_id is written
    as an empty text, rows with one item_id are one item. Repeated documents each have
    their row. Texts of any length are read whole; other columns are not read.
    """
    windows = cut_lineage(item_windows(items, window, gram).distinct())
    n, short = windows.count(), sorted(r[0] for r in windows.where(F.col("words") < window).select("words").distinct().collect())
    bits = 1 << min(max(ceil(log2(16 * max(n, 1))), FILTER_BITS[0]), FILTER_BITS[1])
    prints, hashes = bit_filter(windows.select(F.col("print").alias("hash")), bits), bit_filter(windows.select("hash"), bits)
    rows = candidates(docs, window, gram, short, prints, hashes)

    # Windows with the same items are one group: a document's items follow from its groups.
    listed = windows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = cut_lineage(listed.withColumn("group", F.sha2(F.to_json("items"), 256)))
    found = rows.where(F.size("hits") > 0).select("key", F.explode("hits").alias("hit")).select("key", "hit.start", (F.col("hit.start") + F.col("hit.words")).alias("stop"), "hit.window")
    by_row = found.join(listed.select("window", "group"), "window").groupBy("key").agg(
        covered(F.collect_list(F.struct("start", "stop"))).alias("n_hit"), F.array_sort(F.collect_set("group")).alias("groups")
    )
    by_row = cut_lineage(by_row.withColumn("sign", F.sha2(F.concat_ws(",", "groups"), 256)))
    # Copies hit the same groups: their items are listed once.
    signs = by_row.groupBy("sign").agg(F.first("groups").alias("groups")).select("sign", F.explode("groups").alias("group"))
    named = signs.join(listed.select("group", "items").dropDuplicates(["group"]), "group").select("sign", F.explode("items").alias("item"))
    named = named.groupBy("sign").agg(F.array_sort(F.collect_set("item")).alias("items")).select(
        "sign", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    )
    hit = by_row.join(named, "sign").select("key", "n_hit", "n_items", "items_sha256")
    none = {"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)}
    clean = rows.where(F.size("hits") == 0).select("doc_id", "n_words", *[v.alias(k) for k, v in none.items()])
    asked = rows.where(F.size("hits") > 0).select("key", "doc_id", "n_words").join(hit, "key", "left")
    judged = asked.select("doc_id", "n_words", *[F.coalesce(k, v).alias(k) for k, v in none.items()])
    return clean.unionByName(judged).withColumn("contaminated", F.col("n_hit") > 0)
