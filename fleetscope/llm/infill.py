"""Fill-in-middle: texts cut at unit ends and written as prefix, suffix and middle.

A learned rank index finds the cuts. All unit ends of a batch of texts, in order, are
covered by line segments, each as long as an error bound allows; what the lines miss is
stored as a residual of one byte per boundary. A cut is the line's prediction for its rank
plus the residual, so it is exact and needs no search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.spans import blocks, text_bytes

ERROR = 96
"""Bytes that a segment may miss a boundary by; residuals fit into one byte."""
MARKS = ("<P>", "<S>", "<M>")
NEWLINE = 10


class RankIndex:
    """Ascending offsets by rank: segments (first rank, offset there, slope) and residuals."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        if not 0 < error <= 120:
            raise ValueError("the error must leave room for rounding in one byte")
        first, slope, at = [], [], 0
        while at < len(offsets):
            stop, own = self._reach(offsets, at, error)
            first.append(at)
            slope.append(own)
            at = stop
        self.first, self.slope = np.array(first, np.int64), np.array(slope, float)
        self.base = offsets[self.first] if first else np.zeros(0, np.int64)
        self.residual = np.zeros(0, np.int8)
        missed = offsets - self.predict(np.arange(len(offsets)))
        self.residual = missed.astype(np.int8)

    @staticmethod
    def _reach(offsets: np.ndarray, at: int, error: int) -> tuple[int, float]:
        """Where the longest segment from ``at`` stops, and a slope that holds for all of it."""
        low, high, begin, size = -np.inf, np.inf, at + 1, 32
        while begin < len(offsets):
            own = np.arange(begin, min(begin + size, len(offsets)))
            rise, run = offsets[own] - offsets[at], own - at
            most = np.minimum(high, np.minimum.accumulate((rise + error) / run))
            least = np.maximum(low, np.maximum.accumulate((rise - error) / run))
            broken = np.flatnonzero(least > most)
            good = int(broken[0]) if len(broken) else len(own)
            if good:
                low, high = least[good - 1], most[good - 1]
            if len(broken):
                return begin + good, (low + high) / 2 if good or begin > at + 1 else 0.0
            begin, size = begin + len(own), size * 2
        return len(offsets), (low + high) / 2 if begin > at + 1 else 0.0

    def predict(self, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, rank, "right") - 1
        return self.base[at] + np.rint(self.slope[at] * (rank - self.first[at])).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """The exact offset of each rank."""
        return self.predict(rank) + self.residual[rank]


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of all unit ends, rank of each text's start, units per text).

    A unit is a line with its ``\\n``, or what follows the last one. A text has one boundary
    more than units: its start.
    """
    breaks = np.flatnonzero(data == NEWLINE)
    row = np.searchsorted(offsets, breaks, "right") - 1
    lines = np.bincount(row, minlength=len(offsets) - 1)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    open_ = np.zeros(len(offsets) - 1, np.int64)
    open_[filled] = data[offsets[filled + 1] - 1] != NEWLINE
    units = lines + open_
    start = np.cumsum(units + 1) - units - 1
    ends = np.empty(int((units + 1).sum()), np.int64)
    ends[start] = offsets[:-1]
    ends[start[row] + 1 + np.arange(len(breaks)) - (np.cumsum(lines) - lines)[row]] = breaks + 1
    ends[(start + units)[open_ > 0]] = offsets[1:][open_ > 0]
    return ends, start, units


def draws(doc_id: str, seed: int) -> list[Column]:
    """Four 32-bit numbers from the SHA-256 of ``seed:doc_id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    Texts are cut into ``n`` lines; the draws of the id choose two cuts among the ``n + 1``
    line ends and the form: ``rate`` per cent of the texts are rearranged, ``spm`` per cent of
    those suffix first. A text that is null, empty or holds one of ``marks`` stays ``plain``, its
    counts null. Rows with one doc_id are cut by the same draws; repeated rows come out as
    often as they went in; texts of any length are cut whole. Other columns are not read.
    """
    signs = [m.encode() for m in marks]

    def arrange(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        h1, h2, h3, h4 = (batch.column(k).to_numpy() for k in range(2, 6))
        ends, start, units = boundaries(data, offsets)
        index = RankIndex(ends)
        one, two = h1 % (units + 1), h2 % (units + 1)
        first, second = index.offset(start + np.minimum(one, two)), index.offset(start + np.maximum(one, two))
        out, forms, prefixes, middles = [], [], [], []
        for k, (a, b, c, d) in enumerate(zip(offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist())):
            text = data[a:d].tobytes()
            if not text or h3[k] % 100 >= rate or any(m in text for m in signs):
                out.append(text)
                forms.append("plain")
                prefixes.append(None)
                middles.append(None)
                continue
            prefix, middle, suffix = text[: b - a], text[b - a : c - a], text[c - a :]
            if h4[k] % 100 < spm:
                forms.append("spm")
                out.append(b"".join((signs[1], suffix, signs[0], prefix, signs[2], middle)))
            else:
                forms.append("psm")
                out.append(b"".join((signs[0], prefix, signs[1], suffix, signs[2], middle)))
            prefixes.append(len(prefix.decode()))
            middles.append(len(middle.decode()))
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(units, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()),
            pa.array(middles, pa.int64()), pa.array(out, pa.binary()).cast(pa.string()),
        ], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for a, b in blocks(offsets):
                yield arrange(batch.slice(a, b - a))

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = [h.alias(f"h{k}") for k, h in enumerate(draws("doc_id", seed), 1)]
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select("doc_id", F.col("text").cast("string"), *numbers).mapInArrow(run, schema)


def restored(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` was given, from its output and form alone."""
    p, s, m = marks
    head = F.substring_index(output, m, 1)
    middle = F.substring_index(output, m, -1)
    by_prefix = F.concat(F.substring_index(F.substring_index(output, s, 1), p, -1), middle, F.substring_index(head, s, -1))
    by_suffix = F.concat(F.substring_index(head, p, -1), middle, F.substring_index(F.substring_index(output, p, 1), s, -1))
    return F.when(F.col(form) == "psm", by_prefix).when(F.col(form) == "spm", by_suffix).otherwise(F.col(output))
