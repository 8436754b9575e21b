"""Hierarchical Pitman-Yor language model over words: previous word, its ending, root.

The root restaurant seats words; its base is uniform over the known words and one unknown.
Every previous word has a restaurant of its own, however many there are; the first word of a
text follows the end of a text. Its parent is the restaurant of the previous word's ending
(the last three bytes, hashed into 4095 slots, and one for text starts), whose parent is the
root. Each table is a customer of the parent. Tables are sampled by Gibbs sweeps; the
predictive probabilities of the averaged seatings score the texts.

Texts become chunks (sets of documents, as numbers of words). Pairs of a word and its
predecessor are dealt to buckets by the word, those of words that make up a thousandth of
all tokens by the predecessor's ending too. A bucket seats what its words need at all levels.
From elsewhere it needs the number of tables per ending and of the most common words, which
are vectors of fixed size, and the tables of each previous word: a pair that occurs once has
one table, so the bucket that owns a word takes from its count what others saved by sharing
tables, and sends back the rest. To score, chunks ask the buckets for their distinct pairs.
No vocabulary is broadcast; common words have short codes on the way (``Book``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm.spans import LOWER, blocks, id_bytes, ids_of, mix, span_hashes, text_bytes, word_spans
from fleetscope.runtime import cut_lineage

CONTEXTS = 4096
"""Endings: a level between the previous word and the root. A word's slot is in the low bits of its name."""
PARTS = 64
CHUNK_BYTES = 12 << 20
END = np.uint64(0x0123456789ABC000)
SLOT = np.uint64(CONTEXTS - 1)


def packed(values: np.ndarray) -> bytes:
    """Compressed byte by byte of the numbers, so that high bytes stand together; fractions as places in a list of the different ones."""
    if not len(values):
        return b""
    if values.dtype.kind == "f":
        found, which, times = np.unique(values.view("u4"), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        place = np.empty(len(found), np.uint32)
        place[order] = np.arange(len(found))
        kind, listed = _place_kind(len(found)), packed(found[order])
        return len(found).to_bytes(4, "little") + len(listed).to_bytes(4, "little") + listed + packed(place[which].astype(kind))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    if kind == "f4":
        found, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
        return unpacked(data[8 : 8 + size], "u4", found).view("f4")[unpacked(data[8 + size :], _place_kind(found), n)]
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, size * n, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def _place_kind(n: int) -> str:
    return "u1" if n <= 1 << 8 else "u2" if n <= 1 << 16 else "u4"


@dataclass(frozen=True)
class Book:
    """Short codes of the words that make up a millionth of all tokens (so a million at most), by frequency.

    Names of other words travel in full: the book saves bytes and changes no result. ``hot``
    are the words that make up a thousandth (a thousand at most), in order.
    """

    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    order: np.ndarray = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "order", np.argsort(self.names))

    def codes(self, names: np.ndarray) -> np.ndarray:
        """The place of each name in the book, from 1; 0 for others."""
        if not len(self.names):
            return np.zeros(len(names), np.uint32)
        at = self.order[np.minimum(np.searchsorted(self.names, names, sorter=self.order), len(self.order) - 1)]
        return np.where(self.names[at] == names, at + 1, 0).astype(np.uint32)

    def spelled(self, names: np.ndarray, codes: np.ndarray | None = None) -> bytes:
        codes = self.codes(names) if codes is None else codes
        short = packed(codes)
        return len(short).to_bytes(8, "little") + short + packed(names[codes == 0])

    def read(self, data: bytes, n: int) -> np.ndarray:
        size = int.from_bytes(data[:8], "little")
        codes = unpacked(data[8 : 8 + size], "u4", n)
        names, rare = np.r_[np.uint64(0), self.names][codes], codes == 0
        names[rare] = unpacked(data[8 + size :], "u8", int(rare.sum()))
        return names

    def is_hot(self, names: np.ndarray) -> np.ndarray:
        return np.isin(names, self.hot)


def is_held_out(doc_id) -> bool:
    """Documents that the model does not learn from; a null id counts as an empty text."""
    return crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, tokens per row): lower-cased words of each row, then its end. A name is a hash with the slot of the ending in its low bits."""
    names, counts = [], []
    for a, b in blocks(offsets):
        part, cuts = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends, row = word_spans(part, cuts)
        n = np.bincount(row, minlength=b - a) + 1
        tail = part[ends - 1].astype(np.uint64)
        for k in (2, 3):
            at = ends - k
            tail |= np.where(at >= starts, part[np.maximum(at, 0)], 0).astype(np.uint64) << np.uint64(8 * (k - 1))
        word = np.full(int(n.sum()), END, np.uint64)
        word[np.arange(len(starts)) + row] = span_hashes(part, starts, ends) & ~SLOT | mix(tail) % SLOT + np.uint64(1)
        names.append(word)
        counts.append(n)
    return np.concatenate(names), np.concatenate(counts)


def chunks(docs: DataFrame, buckets: int) -> DataFrame:
    """One row per chunk of documents: its distinct words, commonest first, and its tokens as places among them."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        token, n = _tokens(data, offsets)
        words, which, times = np.unique(token, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words))
        held = np.array([is_held_out(x) for x in batch.column(0).to_pylist()])
        values = [
            *id_bytes(batch.column(0)), len(n), len(words), len(token), packed(held), packed(words[order]),
            packed(place[which]), packed(n.astype(np.uint32)),
        ]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in values], _CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for first, last in blocks(offsets, CHUNK_BYTES):
                yield encode(batch.slice(first, last - first))

    schema = ", ".join(f"{c} {'long' if c.startswith('n_') else 'binary'}" for c in _CHUNK)
    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
    return cut_lineage(made.withColumn("chunk", F.monotonically_increasing_id()))


_CHUNK = ["ids", "nulls", "n_docs", "n_words", "n_tokens", "held", "words", "tokens", "lengths"]


def book_of(chunk: DataFrame) -> Book:
    """The common words. A word counts where a chunk has it four times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = np.bincount(unpacked(r["tokens"], "u4", r["n_tokens"]), minlength=r["n_words"])
                kept = n >= 4
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(r["words"], "u8", r["n_words"])[kept].view(np.int64)), pa.array(n[kept])], ["name", "n"])

    total = chunk.agg(F.sum("n_tokens")).first()[0] or 0
    counted = chunk.select("n_words", "n_tokens", "words", "tokens").mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= total / (1 << 20)).toArrow()
    names, n = found["name"].to_numpy().view(np.uint64), found["n"].to_numpy()
    return Book(names[np.lexsort((names, -n))], np.sort(names[n >= total / 1024]))


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    """By the high bits, so that words in order are in order of their buckets."""
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _homes(words: np.ndarray, buckets: int, book: Book) -> np.ndarray:
    """Of each word its bucket, whether it is hot, and its slot, as one number."""
    return (_bucket(words, buckets) * 2 + book.is_hot(words)) * CONTEXTS + (words & SLOT).astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """The distinct pairs of a chunk in order of buckets and words, and the words that each bucket is asked for."""

    bucket: np.ndarray
    word: np.ndarray
    spread: np.ndarray
    before: np.ndarray
    pair: np.ndarray
    """Of each token."""

    def slices(self) -> Iterator[tuple[int, slice, slice]]:
        """(bucket, its words, its pairs)."""
        found, first = np.unique(self.bucket, return_index=True)
        edges = np.r_[0, np.cumsum(self.spread)]
        for b, i, j in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(self.bucket)]):
            yield b, slice(i, j), slice(int(edges[i]), int(edges[j]))


def _layout(tokens: np.ndarray, lengths: np.ndarray, homes: np.ndarray, buckets: int) -> Layout:
    """A word is asked for at its own bucket and, if hot, where its pairs are dealt."""
    size = len(homes)
    home, hot, slot = homes // (2 * CONTEXTS), homes // CONTEXTS % 2 == 1, homes % CONTEXTS
    token = tokens.astype(np.int64)
    before = np.r_[token[lengths[0] - 1], token[:-1]]
    place = np.where(hot[token], (home[token] + slot[before] % PARTS) % buckets, home[token])
    keys, pair = np.unique((place * size + token) * size + before, return_inverse=True)
    owner = keys // size
    listed = np.union1d(owner, home * size + np.arange(size))
    spread = np.diff(np.r_[np.searchsorted(owner, listed), len(owner)])
    return Layout(listed // size, listed % size, spread, keys % size, pair)


def requests(chunk: DataFrame, buckets: int, book: Book = Book()) -> DataFrame:
    """(bucket, chunk, words, pairs per word, words before, training counts): what each chunk has of each bucket."""
    book = chunk.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, lengths = unpacked(r["words"], "u8", r["n_words"]), unpacked(r["lengths"], "u4", r["n_docs"])
                found = _layout(unpacked(r["tokens"], "u4", r["n_tokens"]), lengths, _homes(words, buckets, book.value), buckets)
                learned = np.repeat(~unpacked(r["held"], "?", r["n_docs"]), lengths)
                counts = np.bincount(found.pair, weights=learned, minlength=len(found.before)).astype(np.uint32)
                codes = book.value.codes(words)
                spelled = lambda at: book.value.spelled(words[at], codes[at])
                rows = [
                    (b, r["chunk"], w.stop - w.start, p.stop - p.start, spelled(found.word[w]), packed(found.spread[w].astype(np.uint32)),
                     spelled(found.before[p]), packed(counts[p]))
                    for b, w, p in found.slices()
                ]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], _REQUEST)

    schema = "bucket int, chunk long, n_words long, n_pairs long, words binary, spread binary, before binary, counts binary"
    return chunk.select("chunk", "n_docs", "n_words", "n_tokens", "held", "words", "tokens", "lengths").mapInArrow(run, schema)


_REQUEST = ["bucket", "chunk", "n_words", "n_pairs", "words", "spread", "before", "counts"]


@dataclass(frozen=True)
class Merged:
    """The pairs of one bucket over all chunks, in order of words and words before."""

    words: np.ndarray
    owner: np.ndarray
    before: np.ndarray
    counts: np.ndarray
    asked_words: list[np.ndarray]
    asked_pairs: list[np.ndarray]


def _merged(rows: pd.DataFrame, book: Book) -> Merged:
    asked = list(rows.itertuples())
    names = [book.read(r.words, r.n_words) for r in asked]
    words, which = np.unique(np.concatenate(names), return_inverse=True)
    shift = np.cumsum([0] + [len(x) for x in names])
    owner = np.concatenate([np.repeat(which[a:b], unpacked(r.spread, "u4", r.n_words)) for r, a, b in zip(asked, shift, shift[1:])])
    before, at = np.unique(np.concatenate([book.read(r.before, r.n_pairs) for r in asked]), return_inverse=True)
    size = max(1, len(before))
    keys, pair = np.unique(owner * size + at, return_inverse=True)
    counts = np.bincount(pair, weights=np.concatenate([unpacked(r.counts, "u4", r.n_pairs) for r in asked]), minlength=len(keys)).astype(np.int64)
    edges = np.cumsum([0] + [r.n_pairs for r in asked])
    return Merged(
        words, keys // size, before[keys % size], counts,
        [which[a:b] for a, b in zip(shift, shift[1:])], [pair[a:b] for a, b in zip(edges, edges[1:])],
    )


_STATE = (
    "bucket int, n_words long, n_pairs long, n_leaves long, known long, tokens long, root_tables double, once long, twice long, root_once long, "
    "root_twice long, leaf_once long, leaf_twice long, words binary, seen binary, owner binary, contexts binary, lone binary, counts binary, tables binary, "
    "root binary, leaf_owner binary, leaf_before binary, leaf_counts binary, leaf_tables binary, hot_seen array<double>, hot_fans array<double>, "
    "by_context array<double>, customers array<double>"
)


def _opened(rows: pd.DataFrame, *, shared: Broadcast | None = None, buckets: int = 0) -> pd.DataFrame:
    """The restaurants of one bucket: training counts over all chunks, one table for each pair at each level.

    Pairs that occur once keep their one table; only their number per word and ending is kept.
    A hot word stays in its own bucket even if all its pairs lie in others.
    """
    book = shared.value if shared else Book()
    all_ = _merged(rows, book)
    used = all_.counts > 0
    own = book.is_hot(all_.words) & (_bucket(all_.words, buckets) == rows.bucket.iloc[0]) if buckets else np.zeros(len(all_.words), bool)
    own[all_.owner[used]] = True
    kept = np.flatnonzero(own)
    owner = np.searchsorted(kept, all_.owner[used])
    before, counts = all_.before[used], all_.counts[used]
    pairs, pair = np.unique(owner * CONTEXTS + (before & SLOT).astype(np.int64), return_inverse=True)
    lone = np.bincount(pair[counts == 1], minlength=len(pairs))
    more = counts > 1
    house = House(
        all_.words[kept], np.bincount(owner, weights=counts, minlength=len(kept)).astype(np.int64), pairs // CONTEXTS, pairs % CONTEXTS, lone,
        np.bincount(pair, minlength=len(pairs)).astype(float), np.ones(len(pairs)), np.ones(len(kept)),
        pair[more], before[more], counts[more], np.ones(int(more.sum())),
    )
    return pd.DataFrame([house.row(int(rows.bucket.iloc[0]), book)])


@dataclass
class House:
    """The restaurants of one bucket: words, (word, ending) pairs with their customers and tables, and pairs seen more than once."""

    words: np.ndarray
    seen: np.ndarray
    owner: np.ndarray
    contexts: np.ndarray
    lone: np.ndarray
    counts: np.ndarray
    tables: np.ndarray
    root: np.ndarray
    leaf_pair: np.ndarray
    leaf_before: np.ndarray
    leaf_counts: np.ndarray
    leaf_tables: np.ndarray

    def fans(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=tables, minlength=len(self.words))

    def customers(self, leaf_tables: np.ndarray) -> np.ndarray:
        return self.lone + np.bincount(self.leaf_pair, weights=leaf_tables, minlength=len(self.lone))

    def row(self, bucket: int, book: Book) -> dict:
        at = np.searchsorted(self.words, book.hot)
        here = np.r_[self.words, np.uint64(0)][at] == book.hot if len(book.hot) else np.zeros(0, bool)
        hot = np.zeros(len(self.words), bool)
        hot[at[here]] = True
        of_hot = lambda values: np.where(here, np.r_[values, 0.0][at], 0.0)
        per_slot = lambda values: np.bincount(self.contexts, weights=values, minlength=CONTEXTS)
        fans, starts = self.fans(self.tables), np.bincount(self.owner, minlength=len(self.words))[~hot]
        steps = lambda values: packed(np.diff(values, prepend=0).astype(np.uint32))
        return {
            "bucket": bucket, "n_words": len(self.words), "n_pairs": len(self.owner), "n_leaves": len(self.leaf_pair), "known": int((~hot).sum()),
            "tokens": int(self.seen.sum()), "root_tables": float(self.root[~hot].sum()), "once": int((np.rint(self.counts) == 1).sum()),
            "twice": int((np.rint(self.counts) == 2).sum()), "root_once": int((starts == 1).sum()), "root_twice": int((starts == 2).sum()),
            "leaf_once": int(self.lone.sum()), "leaf_twice": int((self.leaf_counts == 2).sum()), "words": book.spelled(self.words),
            "seen": packed(self.seen.astype(np.uint32)), "owner": steps(self.owner), "contexts": packed(self.contexts.astype(np.uint16)),
            "lone": packed(self.lone.astype(np.uint32)), "counts": packed(self.counts.astype(np.float32)), "tables": packed(self.tables.astype(np.float32)),
            "root": packed(self.root.astype(np.float32)), "leaf_owner": steps(self.owner[self.leaf_pair]), "leaf_before": book.spelled(self.leaf_before),
            "leaf_counts": packed(self.leaf_counts.astype(np.uint32)), "leaf_tables": packed(self.leaf_tables.astype(np.float32)),
            "hot_seen": of_hot(self.seen), "hot_fans": of_hot(fans), "by_context": per_slot(self.tables), "customers": per_slot(self.counts),
        }


def _house(r, book: Book) -> House:
    whole = lambda c, kind, n: unpacked(r[c], kind, r[n])
    steps = lambda c, n: np.cumsum(whole(c, "u4", n).astype(np.int64))
    owner, contexts = steps("owner", "n_pairs"), whole("contexts", "u2", "n_pairs").astype(np.int64)
    leaf_before = book.read(r["leaf_before"], r["n_leaves"])
    leaf_pair = np.searchsorted(owner * CONTEXTS + contexts, steps("leaf_owner", "n_leaves") * CONTEXTS + (leaf_before & SLOT).astype(np.int64))
    return House(
        book.read(r["words"], r["n_words"]), whole("seen", "u4", "n_words").astype(np.int64), owner, contexts,
        whole("lone", "u4", "n_pairs").astype(np.int64), whole("counts", "f4", "n_pairs").astype(float), whole("tables", "f4", "n_pairs").astype(float),
        whole("root", "f4", "n_words").astype(float), leaf_pair, leaf_before, whole("leaf_counts", "u4", "n_leaves").astype(np.int64),
        whole("leaf_tables", "f4", "n_leaves").astype(float),
    )


def _restaurants(r, book: Book = Book()) -> tuple[np.ndarray, ...]:
    """(owner, contexts, customers, tables, root tables, words): the two upper levels."""
    h = _house(r, book)
    return h.owner, h.contexts, h.counts, h.tables, h.root, h.words


@dataclass(frozen=True)
class Totals:
    """What all buckets share. Discounts come from how many pairs and words are seen once and twice."""

    words: int
    tokens: int
    discount: float
    root_discount: float
    leaf_discount: float
    by_context: np.ndarray
    customers: np.ndarray
    root_tables: float
    hot: np.ndarray
    hot_seen: np.ndarray
    hot_fans: np.ndarray
    hot_root: np.ndarray
    strength: float = 2.0
    root_strength: float = 10.0
    leaf_strength: float = 2.0

    @property
    def base(self) -> float:
        return 1.0 / (self.words + 1)

    @property
    def spare(self) -> float:
        return (self.root_strength + self.root_discount * self.root_tables) * self.base

    def root_probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.root_discount * tables + self.spare) / (self.root_strength + self.by_context.sum())

    def by_ending(self, share: np.ndarray, slot: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Probability after an ending; ``share`` is the customers of the word there less their discount."""
        return (share + (self.strength + self.discount * self.by_context[slot]) * parent) / (self.strength + self.customers[slot])

    def by_word(self, share: np.ndarray, customers: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Probability after a word that has so many customers and tables."""
        return (share + (self.leaf_strength + self.leaf_discount * tables) * parent) / (self.leaf_strength + customers)

    def whole(self, words: np.ndarray, values: np.ndarray, name: str) -> np.ndarray:
        """Values of a bucket's words, with those of hot words, which lie in many buckets, replaced by their totals."""
        at = np.searchsorted(words, self.hot)
        here = np.flatnonzero(np.r_[words, np.uint64(0)][at] == self.hot) if len(self.hot) else np.zeros(0, int)
        out = np.array(values, float)
        out[at[here]] = getattr(self, name)[here]
        return out


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def totals(state: DataFrame, hot: np.ndarray = Book().hot, seed: int = 0) -> Totals:
    """Sums over all buckets: a few numbers, two vectors of one entry per ending and two of one per hot word. The root's tables of those are seated here."""
    names = ("known", "tokens", "root_tables", "once", "twice", "root_once", "root_twice", "leaf_once", "leaf_twice")
    sums = state.agg(*[F.sum(c).alias(c) for c in names]).first()
    size = max(CONTEXTS, len(hot))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((4, size))
        for batch in batches:
            for k in range(4):
                column = batch.column(k).flatten().to_numpy()
                if len(column):
                    added = column.reshape(len(batch), -1).sum(0)
                    found[k, : len(added)] += added
        at = np.flatnonzero(found.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(x[at]) for x in found]], ["at", *_VECTORS])

    vectors = np.zeros((4, size))
    added = state.select(*_VECTORS).mapInArrow(add, "at long, by_context double, customers double, hot_seen double, hot_fans double")
    for r in added.groupBy("at").agg(*[F.sum(c).alias(c) for c in _VECTORS]).collect():
        vectors[:, r["at"]] = [r[c] for c in _VECTORS]
    by_context, customers, seen, fans = vectors[0, :CONTEXTS], vectors[1, :CONTEXTS], vectors[2, : len(hot)], vectors[3, : len(hot)]
    known = lambda c: sums[c] or 0
    all_ = Totals(
        known("known") + int((seen > 0).sum()), known("tokens"), _discount(known("once"), known("twice")), _discount(known("root_once"), known("root_twice")),
        _discount(known("leaf_once"), known("leaf_twice")), by_context, customers, known("root_tables") + float((seen > 0).sum()), hot, seen, fans, np.zeros(len(hot)),
    )
    rng = np.random.default_rng([seed, len(hot)])
    drawn = [seat(np.rint(fans).astype(np.int64), np.full(len(hot), all_.spare), all_.root_discount, rng) for _ in range(4)]
    root = np.mean(drawn, axis=0) if len(hot) else np.zeros(0)
    return replace(all_, hot_root=root, root_tables=known("root_tables") + float(root.sum()))


_VECTORS = ["by_context", "customers", "hot_seen", "hot_fans"]


def seat(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating ``customers`` one by one, a new table having weight ``fresh``.

    Up to 64 customers are seated singly, further ones in groups of a sixteenth of those
    seated, in which the chance of a new table hardly moves.
    """
    order = np.argsort(-customers, kind="stable")
    count, weight = customers[order], fresh[order]
    tables = np.minimum(count, 1).astype(np.float64)
    seated, n = 1, int(np.searchsorted(-count, -1, "left"))
    while n:
        group = max(1, seated // 16) if seated >= 64 else 1
        coming = np.minimum(count[:n] - seated, group)
        chance = weight[:n] / (weight[:n] + seated - discount * tables[:n])
        tables[:n] += rng.binomial(coming, chance) if group > 1 else rng.random(n) < chance
        seated += group
        n = int(np.searchsorted(-count, -seated, "left"))
    out = np.empty_like(tables)
    out[order] = tables
    return out


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def savings(state: DataFrame, shared: Broadcast) -> DataFrame:
    """Per bucket and bucket that owns words before: those words, in order, and how many of their customers share a table."""
    buckets = _buckets(state.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                book = shared.value
                names, at = np.unique(book.read(r["leaf_before"], r["n_leaves"]), return_inverse=True)
                saved = unpacked(r["leaf_counts"], "u4", r["n_leaves"]) - unpacked(r["leaf_tables"], "f4", r["n_leaves"]).astype(float)
                saved = np.bincount(at, weights=saved, minlength=len(names)).astype(np.float32)
                codes, cut = book.codes(names), np.searchsorted(_bucket(names, buckets), np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    own = slice(cut[b], cut[b + 1])
                    values = [b, r["bucket"], own.stop - own.start, book.spelled(names[own], codes[own]), packed(saved[own])]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], ["bucket", "source", "n_words", "words", "saved"])

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return state.select("bucket", "n_leaves", "leaf_before", "leaf_counts", "leaf_tables").mapInArrow(run, "bucket int, source long, n_words long, words binary, saved binary")


def _saved(words: np.ndarray, rows: pd.DataFrame, book: Book) -> tuple[np.ndarray, list[np.ndarray]]:
    """Savings of each of the bucket's words over all sources, and the places of each source's words."""
    total, places = np.zeros(len(words)), []
    for r in rows.itertuples():
        places.append(np.searchsorted(words, book.read(r.words, r.n_words)))
        total[places[-1]] += unpacked(r.saved, "f4", r.n_words)
    return total, places


def previous_words(state: DataFrame, all_: Totals, shared: Broadcast) -> DataFrame:
    """(bucket, owner, tables): for each bucket the tables of the words before that it named to the owner."""

    def run(key, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"bucket": [], "owner": [], "n": [], "answer": []})
        r, book = own.iloc[0], shared.value
        words = book.read(r["words"], r["n_words"])
        seen = all_.whole(words, unpacked(r["seen"], "u4", r["n_words"]), "hot_seen")
        total, places = _saved(words, rows, book)
        out = [(s, int(key[0]), len(p), packed((seen[p] - total[p]).astype(np.float32))) for s, p in zip(rows["source"].tolist(), places)]
        return pd.DataFrame(out, columns=["bucket", "owner", "n", "answer"])

    owners = state.select("bucket", "n_words", "words", "seen")
    return savings(state, shared).groupBy("bucket").cogroup(owners.groupBy("bucket")).applyInPandas(run, "bucket int, owner int, n long, answer binary")


def sweep(state: DataFrame, all_: Totals, burn: int, keep: int, seed: int, shared: Broadcast | None = None) -> DataFrame:
    """``burn`` Gibbs sweeps in each bucket, then the mean of ``keep`` more. Totals stay as they were at the start."""
    shared = shared or state.sparkSession.sparkContext.broadcast(Book())

    def run(key, own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        book = shared.value
        h = _house(own.iloc[0], book)
        rng = np.random.default_rng([seed, int(key[0])])
        names, at = np.unique(h.leaf_before, return_inverse=True)
        told = [unpacked(a.answer, "f4", a.n) for a in answers.sort_values("owner").itertuples()]
        leaf_weight = (all_.leaf_strength + all_.leaf_discount * np.concatenate([np.zeros(0), *told]))[at]
        weight = all_.strength + all_.discount * all_.by_context[h.contexts]
        spare = np.full(len(h.words), all_.spare)
        counts, tables, root = h.counts, h.tables, h.root
        sums = [np.zeros(len(x)) for x in (h.leaf_tables, tables, root)]
        for k in range(burn + keep):
            fans = all_.whole(h.words, h.fans(tables), "hot_fans")
            parent = all_.root_probability(fans, all_.whole(h.words, root, "hot_root"))[h.owner]
            chance = all_.by_ending(counts - all_.discount * tables, h.contexts, parent)
            leaves = seat(h.leaf_counts, leaf_weight * chance[h.leaf_pair], all_.leaf_discount, rng)
            counts = h.customers(leaves)
            tables = seat(counts.astype(np.int64), weight * parent, all_.discount, rng)
            root = seat(h.fans(tables).astype(np.int64), spare, all_.root_discount, rng)
            if k >= burn:
                for total, x in zip(sums, (leaves, tables, root)):
                    total += x
        h.leaf_tables, h.tables, h.root = (x / keep for x in sums)
        h.counts = h.customers(h.leaf_tables)
        return pd.DataFrame([h.row(int(key[0]), book)])

    answers = previous_words(state, all_, shared)
    return cut_lineage(state.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(run, _STATE))


def replies(asked: DataFrame, state: DataFrame, all_: Totals, shared: Broadcast) -> DataFrame:
    """For each request, of its words the training count, root probability and tables after the word, and of
    its pairs the customers less discount after the previous word (leaf) and after its ending."""

    def run(key, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        book, named = shared.value, rows["saved"].notna()
        rows, named = rows[~named], rows[named]
        if not len(rows):
            return pd.DataFrame({c: [] for c in ("chunk", "bucket", *_REPLY)})
        m = _merged(rows, book)
        seen, tables, leaf, ending = np.zeros(len(m.words), np.uint32), np.zeros(len(m.words)), np.zeros(len(m.owner)), np.zeros(len(m.owner))
        root = np.full(len(m.words), all_.root_probability(np.zeros(1), np.zeros(1))[0])
        if len(own):
            h = _house(own.iloc[0], book)
            at = np.searchsorted(m.words, h.words)
            seen[at] = count = all_.whole(h.words, h.seen, "hot_seen")
            root[at] = all_.root_probability(all_.whole(h.words, h.fans(h.tables), "hot_fans"), all_.whole(h.words, h.root, "hot_root"))
            tables[at] = count - _saved(h.words, named, book)[0]
            leaf_tables = np.ones(len(m.counts))
            leaf_tables[m.counts > 1] = h.leaf_tables
            leaf = np.where(m.counts > 0, m.counts - all_.leaf_discount * leaf_tables, 0.0)
            keys, wanted = at[h.owner] * CONTEXTS + h.contexts, m.owner * CONTEXTS + (m.before & SLOT).astype(np.int64)
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            ending = np.where(keys[place] == wanted, (h.counts - all_.discount * h.tables)[place], 0.0) if len(keys) else ending
        root, tables, leaf, ending = (x.astype(np.float32) for x in (root, tables, leaf, ending))
        out = [
            (int(c), int(key[0]), packed(seen[w]), packed(root[w]), packed(tables[w]), packed(leaf[p]), packed(ending[p]))
            for c, w, p in zip(rows["chunk"].tolist(), m.asked_words, m.asked_pairs)
        ]
        return pd.DataFrame(out, columns=["chunk", "bucket", *_REPLY])

    saved = savings(state, shared).drop("source").withColumns({"chunk": F.lit(-1).cast("long"), "n_pairs": F.lit(0).cast("long")})
    told = asked.withColumn("saved", F.lit(None).cast("binary")).unionByName(saved, allowMissingColumns=True)
    schema = "chunk long, bucket int, " + ", ".join(f"{c} binary" for c in _REPLY)
    return told.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInPandas(run, schema)


_REPLY = ["seen", "root", "tables", "leaf", "ending"]


def score(docs: DataFrame, rounds: int = 2, burn: int = 2, keep: int = 4, seed: int = 8) -> DataFrame:
    """Per row: held_out, n_tokens, n_known, train_tokens, base_score and score (both log10 probabilities of the text).

    Learns from rows that ``is_held_out`` does not name. A null text is empty and has the
    end token alone; repeated rows count as often as they stand. With nothing to learn from,
    every token is unknown and both scores are zero.
    """
    buckets = _buckets(docs.sparkSession)
    chunk = chunks(docs, buckets)
    book = book_of(chunk)
    shared = docs.sparkSession.sparkContext.broadcast(book)
    state = cut_lineage(requests(chunk, buckets, book).groupBy("bucket").applyInPandas(lambda rows: _opened(rows, shared=shared, buckets=buckets), _STATE))
    for k in range(rounds):
        state = sweep(state, totals(state, book.hot, seed), burn, keep if k == rounds - 1 else 1, seed + k, shared)
    all_ = totals(state, book.hot, seed)
    floor = np.log10(all_.tokens + all_.words + 1)

    def homed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = zip(batch.column("words").to_pylist(), batch.column("n_words").to_pylist())
            homes = [packed(_homes(unpacked(x, "u8", n), buckets, shared.value).astype(np.uint32)) for x, n in words]
            yield batch.set_column(batch.schema.get_field_index("words"), "words", pa.array(homes, pa.binary()))

    def run(key, own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        r, told = own.iloc[0], {a.bucket: a for a in answers.itertuples()}
        lengths, homes = unpacked(r["lengths"], "u4", r["n_docs"]), unpacked(r["words"], "u4", r["n_words"]).astype(np.int64)
        token = unpacked(r["tokens"], "u4", r["n_tokens"])
        found = _layout(token, lengths, homes, buckets)
        count, root, tables = np.zeros((3, len(homes)))
        leaf, ending = np.zeros((2, len(found.before)))
        owned = found.bucket == homes[found.word] // (2 * CONTEXTS)
        for b, w, p in found.slices():
            at = found.word[w][owned[w]]
            for into, name, kind in ((count, "seen", "u4"), (root, "root", "f4"), (tables, "tables", "f4")):
                into[at] = unpacked(getattr(told[b], name), kind, w.stop - w.start)[owned[w]]
            leaf[p], ending[p] = (unpacked(x, "f4", p.stop - p.start) for x in (told[b].leaf, told[b].ending))
        before, follower = found.before, np.repeat(found.word, found.spread)
        parent = all_.by_ending(ending, homes[before] % CONTEXTS, root[follower])
        logs = np.log10(all_.by_word(leaf, count[before], tables[before], parent))
        doc = np.repeat(np.arange(r["n_docs"]), lengths)
        total = lambda x: np.bincount(doc, weights=x, minlength=r["n_docs"])
        return pd.DataFrame({
            "doc_id": pd.Series(ids_of(r["ids"], r["nulls"]), dtype=object), "held_out": unpacked(r["held"], "?", r["n_docs"]), "n_tokens": lengths.astype(np.int64),
            "n_known": total(count[token] > 0).astype(np.int64), "train_tokens": all_.tokens,
            "base_score": total(np.log10(count + 1)[token] - floor), "score": total(logs[found.pair]),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    told = replies(requests(chunk, buckets, book), state, all_, shared)
    homes = chunk.mapInArrow(homed, chunk.schema)
    return homes.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(run, schema)
