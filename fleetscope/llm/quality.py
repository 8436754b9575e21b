"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of vote
patterns estimates each rule's accuracy on good and on bad documents;
the posterior of "good" replaces a filter that all rules must pass. Where some documents
have a label, their class is given in each round and the rest follows the posterior, so
what "good" means comes from the labels and not from the rules' start values. The corpus
meets as counts per vote pattern (at most 3 to the number of rules), in partial aggregates.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.runtime import cut_lineage

_SPACES = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def _repeats(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Windows are compared by 64-bit hash within one text: sorted with their places, equal
    neighbours mark repeats, and the union of their 3-word spans is counted by gaps.
    """
    n = F.size(words)
    windows = F.arrays_zip(F.slice(words, F.lit(1), n - 2), F.slice(words, F.lit(2), n - 2), F.slice(words, F.lit(3), n - 2))
    hashes = F.transform(windows, lambda w: F.xxhash64(w))
    placed = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), n - 3).alias("i")))
    return F.when(n < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(placed)


def _covered(placed: Column) -> Column:
    k = F.size(placed)
    beside = F.arrays_zip(
        placed.alias("own"),
        F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(placed, F.lit(1), k - 1)).alias("before"),
        F.slice(placed, F.lit(2), k - 1).alias("after"),
    )
    same = F.filter(beside, lambda z: (z["own"]["h"] == z["before"]["h"]) | (z["own"]["h"] == z["after"]["h"]))
    return F.when(k < 2, F.array().cast("array<int>")).otherwise(F.sort_array(F.transform(same, lambda z: z["own"]["i"])))


def _length(starts: Column) -> Column:
    k = F.size(starts)
    gaps = F.zip_with(F.slice(starts, F.lit(2), k - 1), F.slice(starts, F.lit(1), k - 1), lambda b, a: F.least(b - a, F.lit(3)))
    return F.when(k == 0, F.lit(0)).otherwise(F.lit(3) + F.aggregate(gaps, F.lit(0), lambda s, x: s + x)).cast("long")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_marks")


def with_measures(docs: DataFrame, name: str = "m") -> DataFrame:
    """``docs`` with a struct ``name`` of the measures of each whole text; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    size = F.char_length(text)
    own = docs.columns
    first = F.struct(
        F.size(words).cast("long").alias("n_words"),
        _without(text, _SPACES).cast("long").alias("word_chars"),
        (size - _without(text, "#*$%&|<>")).cast("long").alias("n_symbols"),
        (size - _without(text, _UPPER)).cast("long").alias("n_upper"),
        (size - _without(text, "!?")).cast("long").alias("n_marks"),
    )
    steps = docs.select(*own, first.alias("__first"), lines.alias("__lines"), words.alias("__words"))
    steps = steps.select(
        *own, "__first", F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__dup"), _repeats(F.col("__words")).alias("__placed"),
    )
    steps = steps.select(*own, "__first", "__n_lines", "__dup", _covered(F.col("__placed")).alias("__starts"))
    return steps.select(*own, F.struct(
        "__first.n_words", "__first.word_chars", "__first.n_symbols", F.col("__dup").alias("n_dup_lines"),
        F.col("__n_lines").alias("n_lines"), _length(F.col("__starts")).alias("n_repeat_words"), "__first.n_upper", "__first.n_marks",
    ).alias(name))


def base_failed(m: str = "m") -> Column:
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(m: str = "m") -> list[Column]:
    """One vote per rule: 1 good, -1 bad, 0 abstains. Shares are compared as products, so empty texts divide nothing."""
    x = {k: F.col(f"{m}.{k}") for k in MEASURES}
    return [
        _vote(x["n_words"] < 50, x["n_words"] >= 100),
        _vote(100 * x["n_repeat_words"] > 40 * x["n_words"], 100 * x["n_repeat_words"] <= 15 * x["n_words"]),
        _vote(100 * x["n_dup_lines"] > 30 * x["n_lines"], 100 * x["n_dup_lines"] <= 10 * x["n_lines"]),
        _vote(100 * x["n_symbols"] > 20 * x["n_words"], 100 * x["n_symbols"] <= 5 * x["n_words"]),
        _vote(100 * x["n_upper"] > 40 * x["word_chars"], 100 * x["n_upper"] <= 20 * x["word_chars"]),
        _vote(100 * x["n_marks"] > 30 * x["n_words"], 100 * x["n_marks"] <= 10 * x["n_words"]),
        _vote(
            (10 * x["word_chars"] < 25 * x["n_words"]) | (10 * x["word_chars"] > 120 * x["n_words"]),
            (10 * x["word_chars"] >= 35 * x["n_words"]) & (10 * x["word_chars"] <= 100 * x["n_words"]),
        ),
        _vote(x["n_words"] < 10, x["n_words"] >= 25),
    ]


Rates = list[dict[int, tuple[float, float]]]
"""Per rule and vote (1, -1): how often good and bad documents get it, of those that get a vote."""

_START = {1: (0.997, 0.70), -1: (0.003, 0.30)}
_PRIOR = 0.8
_PSEUDO = 20.0
"""Documents of each class that the start values count as, at every size."""
_UNLABELLED = 0.1


def log_odds(names: list[str], prior: float, rates: Rates) -> Column:
    """Log odds of "good" from the votes in columns ``names``; who abstains says nothing."""
    total = F.lit(log(prior / (1 - prior)))
    for name, rate in zip(names, rates):
        good, bad = (log(rate[v][0] / rate[v][1]) for v in (1, -1))
        total = total + F.when(F.col(name) == 1, good).when(F.col(name) == -1, bad).otherwise(0.0)
    return total


def fit(counts: DataFrame, names: list[str], rounds: int = 25) -> tuple[float, Rates]:
    """(share of good documents, rates) from (vote pattern, n) and, where there is one, ``label`` (1 good, 0 bad, null).

    A rule's accuracy is a pair: how seldom it blames good documents and how often it finds
    bad ones. Rows with a label have its class, the others their posterior. Where there are
    labels, the others weigh ``_UNLABELLED`` of the labelled ones together: defects come in
    kinds, rules do not err independently, and the many documents without a label would
    else turn the classes into the commonest kinds. The start values count as ``_PSEUDO``
    documents of each class. An empty corpus returns the start.
    """
    prior, rates = _PRIOR, [dict(_START) for _ in names]
    counts = counts if "label" in counts.columns else counts.withColumn("label", F.lit(None).cast("int"))
    known = F.col("label").isNotNull()
    labelled, others = counts.agg(F.sum(F.when(known, F.col("n"))), F.sum(F.when(~known, F.col("n")))).first()
    labelled, others = labelled or 0, others or 0
    share = min(1.0, _UNLABELLED * labelled / others) if labelled and others else 1.0
    total = labelled + share * others
    n = F.when(known, F.col("n")).otherwise(share * F.col("n"))
    for _ in range(rounds if total else 0):
        p = F.coalesce(F.col("label").cast("double"), 1 / (1 + F.exp(-log_odds(names, prior, rates))))
        weighted = counts.withColumn("g", n * p).withColumn("b", n * (1 - p))
        sums = weighted.agg(F.sum("g"), *[
            F.sum(F.when(F.col(v) == vote, F.col(w)).otherwise(0.0)) for v in names for vote in (1, -1) for w in ("g", "b")
        ]).first()
        found = []
        for k in range(len(names)):
            own = sums[1 + 4 * k : 5 + 4 * k]
            found.append({
                vote: tuple((own[2 * j + c] + _PSEUDO * _START[vote][c]) / (own[c] + own[2 + c] + _PSEUDO) for c in (0, 1))
                for j, vote in enumerate((1, -1))
            })
        moved = max(abs(x - y) for a, b in zip(found, rates) for v in a for x, y in zip(a[v], b[v]))
        prior, rates = (sums[0] + _PRIOR * _PSEUDO) / (total + _PSEUDO), found
        if moved < 1e-4:
            break
    return prior, rates


def learn(measured: DataFrame, labels: DataFrame | None = None, m: str = "m") -> tuple[list[Column], float, Rates]:
    """The rules, the share of good documents and the rates; ``labels`` (doc_id, quality 1 or 0) cover some of the rows."""
    rules = votes(m)
    names = [f"v{k}" for k in range(len(rules))]
    count = F.count("*").alias("n")
    voted = measured.select("doc_id", *[v.alias(n) for v, n in zip(rules, names)])
    counts = voted.groupBy(*names).agg(count).withColumn("label", F.lit(None).cast("int"))
    if labels is not None:
        told = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
        given = voted.join(told, "doc_id").groupBy(*names, "label").agg(count)
        less = given.select(*names, (-F.col("n")).alias("n"), F.lit(None).cast("int").alias("label"))
        counts = counts.unionByName(less).unionByName(given).groupBy(*names, "label").agg(F.sum("n").alias("n"))
    return rules, *fit(cut_lineage(counts), names)


def judge(measured: DataFrame, labels: DataFrame | None = None, m: str = "m") -> DataFrame:
    """Rows of ``measured`` with ``p_good``, the posterior, and ``kept``: it is at least one half."""
    rules, prior, rates = learn(measured, labels, m)
    own = measured.columns
    names = [f"__v{k}" for k in range(len(rules))]
    scored = measured.select("*", *[v.alias(n) for v, n in zip(rules, names)])
    p = 1 / (1 + F.exp(-log_odds(names, prior, rates)))
    return scored.select(*own, p.alias("p_good"), (p >= 0.5).alias("kept"))


def verdicts(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_hash, m, p_good, kept) per row of ``docs``; the texts are read once.

    Null texts count as empty, repeated rows as often as they stand. ``labels`` (doc_id,
    quality) may cover any of the rows, none included; of several labels the worst counts.
    """
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return judge(cut_lineage(with_measures(named).select("doc_id", "text_hash", "m")), labels)


def keep_good(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    Rejected rows are taken out by doc_id and hash of the text, so rows that share a doc_id
    are judged each by its own text. Measuring again would cost more than the join.
    """
    gone = verdicts(docs, labels).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    return docs.join(gone, same, "left_anti")
