"""Suffix-array dedup by a logarithmic family of indexes: bytes that an earlier document has.

In each shard the candidate segments come in batches by their smallest doc_id. A batch gets
a suffix array of its windows (sorted by the window's bytes), is merge-scanned against the
levels that exist, and becomes a level itself; levels of like size merge, so there are
logarithmically many and each suffix is merged as often. A level remembers for each
distinct window the smallest doc_id it occurred in.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fleetscope.llm.windows import Chunk, Search, Units, covered, found_windows

BATCH = 1 << 17


class Levels:
    """Sorted arrays of distinct windows with their smallest doc_id, each about twice as long as the next."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def look_up(self, keys: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Scan sorted ``keys`` against every level; returns which were found and lowers their ``least``."""
        known = np.zeros(len(keys), bool)
        for own, value in self.levels:
            at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
            hit = own[at] == keys
            least[hit] = np.minimum(least[hit], value[at[hit]])
            known |= hit
        return known

    def add(self, keys: np.ndarray, least: np.ndarray) -> None:
        if not len(keys):
            return
        self.levels.append((keys, least))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            keys, least = np.concatenate([b, a]), np.concatenate([y, x])
            order = np.argsort(keys, kind="stable")  # two ascending runs: one merge
            self.levels.append((keys[order], least[order]))


def earliest(window: int):
    """Decision of a shard: the smallest doc_id in which each window occurs."""

    def decide(text: bytes, lengths: np.ndarray, windows: np.ndarray, times: np.ndarray, least: np.ndarray) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        begin, shift = np.cumsum(lengths) - lengths, np.cumsum(windows) - windows
        said = np.empty(int(windows.sum()), np.int64)
        order = np.argsort(least, kind="stable")
        done = np.cumsum(windows[order])
        family, at = Levels(), 0
        while at < len(order):
            stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + BATCH, "right")))
            own = order[at:stop]
            size = windows[own]
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            # a last byte that is not zero, because fixed-width strings end at trailing zeros
            keys = np.full((len(step), window + 1), 1, np.uint8)
            keys[:, :window] = data[(np.repeat(begin[own], size) + step)[:, None] + np.arange(window)]
            keys = keys.view(f"S{window + 1}").ravel()
            array = np.argsort(keys, kind="stable")
            sorted_ = keys[array]
            head = np.r_[True, sorted_[1:] != sorted_[:-1]]
            distinct, smallest = sorted_[head], np.repeat(least[own], size)[array[head]]
            known = family.look_up(distinct, smallest)
            family.add(distinct[~known], smallest[~known])
            said[(np.repeat(shift[own], size) + step)[array]] = smallest[np.cumsum(head) - 1]
            at = stop
        return said

    return decide


def search(window: int = 50, gram: int = 18) -> Search:
    return Search(window, gram, False, earliest(window), "i8")


def remove_copied(docs: DataFrame, window: int = 50, gram: int = 18) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (binary) and its SHA-256 (kept_sha256).

    Removed is every byte in a string of ``window`` bytes that also starts in a row with a
    smaller doc_id (an integer; null comes before all). Rows with the same doc_id do not
    remove each other's bytes. Texts shorter than a window, empty and null ones stay whole.
    """

    def finish(chunk: Chunk, units: Units, row: np.ndarray, start: np.ndarray, said: np.ndarray) -> pd.DataFrame:
        gone = covered(len(chunk.data), start[said < chunk.keys[row]], window)
        out = []
        for k in range(len(chunk.ids)):
            a, b = chunk.offsets[k], chunk.offsets[k + 1]
            own = gone[a:b]
            kept = chunk.data[a:b][~own].tobytes()
            spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(b > a and own[0])
            out.append((chunk.ids[k], b - a, int(own.sum()), spans, kept, hashlib.sha256(kept).hexdigest()))
        made = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
        return made.astype({"doc_id": object})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return found_windows(docs, search(window, gram), finish, schema)
