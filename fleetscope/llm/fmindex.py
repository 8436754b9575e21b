"""Substring dedup by compressed FM-indexes: words in windows that occur elsewhere too.

Each shard of candidate segments gets an FM-index: the Burrows-Wheeler transform of its
segments' words in a wavelet matrix (bit planes with rank counts, a word of 64 bits and a
count per 64 words and plane). The segments are streamed against it by backward search
from their ends; matching statistics, cut off at the threshold, say which windows occur
again, the same document included.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fleetscope.llm.spans import named, word_spans
from fleetscope.llm.windows import Chunk, Search, Units, covered, found_windows

ORDER = 64
"""Suffixes are sorted by so many words; patterns must not be longer."""


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (numbers from 0) sorted by their first ``depth`` symbols, by prefix doubling."""
    rank, size = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while size < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-size] = rank[size:] + 1
        keys, rank = np.unique(rank * (rank.max() + 2) + after, return_inverse=True)
        size *= 2
        if len(keys) == len(rank):
            break
    return np.argsort(rank, kind="stable")


class Wavelet:
    """Rank queries on a sequence of numbers below 2 ** planes."""

    def __init__(self, values: np.ndarray, planes: int):
        self.planes, self.zeros, self.bits, self.before = planes, [], [], []
        for plane in range(planes - 1, -1, -1):
            bit = (values >> plane & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum(dtype=np.int64)))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def place(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` ends up when the planes sort by ``symbols``: differences of two places count occurrences between."""
        for k, plane in enumerate(range(self.planes - 1, -1, -1)):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][word] + np.bitwise_count(self.bits[k][word] & mask)
            at = np.where(symbols >> plane & 1, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Backward search over a text of numbers; ``weights`` gives each position's suffix a weight in counts."""

    def __init__(self, text: np.ndarray, weights: np.ndarray, depth: int = ORDER):
        order = suffix_order(text, depth)
        symbols = int(text.max()) + 1
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))]
        self.wavelet = Wavelet(text[order - 1], max(1, (symbols - 1).bit_length()))
        self.origin = self.wavelet.place(np.arange(symbols), np.zeros(symbols, np.int64))
        self.weight = np.r_[0, np.cumsum(weights[order])]
        self.size = len(text)

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of ``symbol + pattern`` from those of the patterns."""
        shift = self.first[symbols] - self.origin[symbols]
        return shift + self.wavelet.place(symbols, low), shift + self.wavelet.place(symbols, high)

    def matched(self, text: np.ndarray, ends: np.ndarray, lengths: np.ndarray, least: int = 2) -> np.ndarray:
        """How far back from each end the pattern still occurs with a weight of ``least``, at most ``lengths``."""
        done = np.zeros(len(ends), np.int64)
        live = np.flatnonzero(lengths > 0)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.size, np.int64)
        step = 0
        while len(live):
            low, high = self.step(text[ends[live] - 1 - step], low, high)
            step += 1
            good = self.weight[high] - self.weight[low] >= least
            done[live[good]] = step
            go = good & (lengths[live] > step)
            live, low, high = live[go], low[go], high[go]
        return done


def repeated(window: int):
    """Decision of a shard: which windows occur at least twice, each segment counting as often as it stands."""

    def decide(text: bytes, lengths: np.ndarray, windows: np.ndarray, times: np.ndarray, least: np.ndarray) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        starts, ends, owner = word_spans(data, np.r_[0, np.cumsum(lengths)])
        symbol = named(data, starts, ends)[0] + 1
        words = windows + window - 1
        begin = np.cumsum(words + 1) - words - 1  # a break after each segment
        flat = np.zeros(int((words + 1).sum()), np.int64)
        flat[np.arange(len(symbol)) + owner] = symbol
        index = FMIndex(flat, np.repeat(times, words + 1))
        back = index.matched(flat, begin + words, words)
        shift = np.cumsum(windows) - windows
        place = np.arange(int(windows.sum())) - np.repeat(shift, windows)
        segment = np.repeat(np.arange(len(words)), windows)
        said = place >= (words - back)[segment]
        rest = np.flatnonzero(~said)
        at = begin[segment[rest]] + place[rest]
        said[rest] = index.matched(flat, at + window, np.full(len(at), window)) == window
        return said

    return decide


def search(window: int = 35, gram: int = 8) -> Search:
    if 2 * window - gram > ORDER:
        raise ValueError("segments would be longer than the order of the index")
    return Search(window, gram, True, repeated(window), "?")


def remove_repeats(docs: DataFrame, window: int = 35, gram: int = 8) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept text and its SHA-256 (kept_sha256).

    Removed is every word in a window of ``window`` words whose words also start elsewhere, in
    this row or another; repeated rows repeat each other. Kept words are joined by one
    space. Texts shorter than a window, blank and null ones keep all their words.
    """

    def finish(chunk: Chunk, units: Units, row: np.ndarray, start: np.ndarray, said: np.ndarray) -> pd.DataFrame:
        gone = covered(len(units.letters), start[said], window)
        text, out = chunk.data.tobytes(), []
        for k in range(len(chunk.ids)):
            a, b = units.offsets[k], units.offsets[k + 1]
            words, own = text[chunk.offsets[k] : chunk.offsets[k + 1]].split(), gone[a:b]
            if own.any():
                words = [w for w, x in zip(words, own.tolist()) if not x]
            kept = b" ".join(words)
            out.append((chunk.ids[k], b - a, int(own.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()))
        made = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])
        return made.astype({"doc_id": object})

    schema = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
    return found_windows(docs, search(window, gram), finish, schema)
