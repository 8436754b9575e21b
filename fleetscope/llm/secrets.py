"""Secret scan: fixed patterns, and character Markov models for what the patterns miss.

Two first-order models over the characters of keys and tokens are compared by their
log-likelihood ratio: one of random strings, one of ordinary identifiers and words. They
are trained from labelled samples. A corpus labels its own: what the patterns match is
random, every other run of the same characters is ordinary. Training counts character
pairs over all samples, so it needs no sampling and its result has a fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.spans import text_bytes

# The patterns of the base scan and the least lengths of what they match.
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET)
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
"""Runs that can hold a match of ACCESS, HEX or the models; 20 is the least length of all three."""

_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(SIZE)

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base scan, kinds as numbers of KINDS; code points, end exclusive."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    for run in RUN.finditer(text):
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            least = LEAST[KINDS[kind]]
            found += [
                (m.start(), kind, m.end()) for m in pattern.finditer(text, run.start(), run.end()) if m.end() - m.start() >= least
            ]
    return sorted(found)


def random_samples(text: str) -> list[str]:
    """What the base scan labels as random: access keys, hexadecimal runs, long assigned values."""
    values = [text[a:b] for a, kind, b in base_spans(text) if kind]
    if ":" in text or "=" in text:
        values += [m[1] for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["access"] and not HEX.fullmatch(m[1])]
    return values


def _pairs(data: np.ndarray, breaks: np.ndarray | None = None) -> np.ndarray:
    code = _CODE[data]
    joined = (code[:-1] >= 0) & (code[1:] >= 0)
    if breaks is not None:
        joined[breaks[(breaks > 0) & (breaks < len(data))] - 1] = False
    return np.bincount((code[:-1] * SIZE + code[1:])[joined], minlength=SIZE * SIZE)


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio of each character pair, random against ordinary."""

    ratio: np.ndarray

    def score(self, text: str) -> float:
        code = _CODE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
        return float(self.ratio[code[:-1], code[1:]].sum())


def fit(random: np.ndarray, ordinary: np.ndarray) -> Model:
    """Models from pair counts.

    Half of the random model is uniform, so alphabets that no sample has still count. The
    ordinary model backs off to single characters, so pairs after a rare one tell too.
    """
    learned = (random + 0.1) / (random.sum(1, keepdims=True) + 0.1 * SIZE)
    single = (ordinary.sum(0) + 0.5) / (ordinary.sum() + 0.5 * SIZE)
    usual = (ordinary + 4 * single) / (ordinary.sum(1, keepdims=True) + 4)
    return Model(np.log(0.5 * learned + 0.5 / SIZE) - np.log(usual))


def train(samples: DataFrame, text: str = "text", label: str = "random") -> Model:
    """Models from labelled strings: boolean ``label`` is true for random ones. Nulls and other characters are skipped."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            for k, kind in enumerate((False, True)):
                rows = pa.array([bool(x) is kind and x is not None for x in batch.column(1).to_pylist()])
                data, offsets = text_bytes(batch.column(0).filter(rows))
                totals[k] += _pairs(data, offsets)
        yield _counts(totals)

    return _collected(samples.select(F.col(text).cast("string"), F.col(label)).mapInArrow(count, _COUNTS))


def train_on_documents(docs: DataFrame) -> Model:
    """Models from the samples that the base scan labels in all of ``docs.text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for first in range(0, len(offsets) - 1, 256):
                cut = offsets[first : first + 257]
                totals[0] += _pairs(data[cut[0] : cut[-1]], cut - cut[0])
            labelled = [x for t in batch.column(0) if t.is_valid for x in random_samples(t.as_py())]
            sample = np.frombuffer("\n".join(labelled).encode(), np.uint8)
            counted = _pairs(sample) if len(sample) else totals[1] * 0
            totals[1] += counted
            totals[0] -= np.minimum(counted, totals[0])
        yield _counts(totals)

    return _collected(docs.select(F.col("text").cast("string")).mapInArrow(count, _COUNTS))


_COUNTS = "random boolean, pair int, n long"


def _counts(totals: np.ndarray) -> pa.RecordBatch:
    kind, pair = np.nonzero(totals)
    return pa.RecordBatch.from_arrays(
        [pa.array(kind == 1), pa.array(pair.astype(np.int32)), pa.array(totals[kind, pair])], ["random", "pair", "n"]
    )


def _collected(counts: DataFrame) -> Model:
    """At most two counts for each pair of characters reach the driver."""
    totals = np.zeros((2, SIZE * SIZE))
    for row in counts.groupBy("random", "pair").agg(F.sum("n").alias("n")).collect():
        totals[int(row["random"]), row["pair"]] = row["n"]
    return fit(totals[1].reshape(SIZE, SIZE), totals[0].reshape(SIZE, SIZE))


def model_spans(text: str, base: list[Span], model: Model, least_ratio: float) -> list[Span]:
    """Runs with letters and digits that the models call random, where no base span lies."""
    found = []
    for run in RUN.finditer(text):
        a, b = run.span()
        value = run[0]
        if any(x < b and y > a for x, _, y in base):
            continue
        if re.search(r"[0-9]", value) and re.search(r"[A-Za-z]", value) and model.score(value) >= least_ratio:
            found.append((a, 3, b))
    return found


def scan(docs: DataFrame, model: Model, least_ratio: float = 20.0) -> DataFrame:
    """(doc_id, base, spans) per row: arrays of ``kind:start:end`` by start, then kind.

    ``base`` has the fixed patterns, ``spans`` also the runs whose log-likelihood ratio
    (nats) is at least ``least_ratio``. Null and empty texts have empty arrays; repeated rows
    stay; columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say = lambda spans: [f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans]
        for batch in batches:
            base, every = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                own = base_spans(text)
                base.append(say(own))
                every.append(say(sorted(own + model_spans(text, own, model, least_ratio))))
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(every, kind)], ["doc_id", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, base array<string>, spans array<string>")


def redact(docs: DataFrame, model: Model, least_ratio: float = 20.0, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and, where there is one, ``n_chars`` counted anew.

    All rows and columns stay; texts without a span, null and empty ones are unchanged.
    """
    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def clean(text: str | None) -> str | None:
        own = base_spans(text) if text else []
        spans = sorted(own + model_spans(text, own, model, least_ratio)) if text else []
        if not spans:
            return text
        out, done = [], 0
        for a, _, b in spans:
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t.as_py()) for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    done = docs.mapInArrow(run, schema)
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(schema["n_chars"].dataType))
    return done
