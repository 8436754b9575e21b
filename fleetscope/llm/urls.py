"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained from labelled URLs. Their features need the URL alone: lengths,
depths, digit and sign ratios, entropy, parameter counts, and how often the labelled URLs
with the same host suffix (last label, last two labels) are blocked. Suffix counts are a
table joined to the URLs, so each suffix has its own, however many there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.runtime import cut_lineage

SAMPLE = 10_000
"""Distinct labelled URLs of each label that the trees are fitted on, the smallest by hash; suffix counts use all."""

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` (A-Z lower-cased) and ``path``; both empty for null or without ``://``."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(text, _PARTS, 1), _UPPER, _LOWER), "path": F.regexp_extract(text, _PARTS, 2),
    })


def matching_rule(rules: list[Rule]) -> Column:
    """Struct (name, action) of the longest rule that fits ``host`` and ``path``, else null."""
    found = F.lit(None).cast("struct<name:string,action:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.action).alias("action"))).otherwise(found)
    return found


def _suffixes() -> tuple[Column, Column]:
    """The last label of ``host``, and the last two (marked by a slash, as a host may have one label only)."""
    return F.substring_index("host", ".", -1), F.concat(F.substring_index("host", ".", -2), F.lit("/"))


def _entropy(text: Column) -> Column:
    n = F.char_length(text)
    share = lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n
    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.when(n == 0, 0.0).otherwise(F.aggregate(letters, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c))))


def lexical_features(url: str = "url") -> dict[str, Column]:
    """Features of the URL alone; null counts as empty."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host, path, before = F.col("host"), F.col("path"), F.substring_index(text, "#", 1)
    n = F.greatest(F.char_length(text), F.lit(1))
    found = lambda pattern, of=text: F.regexp_count(of, F.lit(pattern))
    query = F.when(before.contains("?"), F.expr("substring(q, instr(q, '?') + 1)")).otherwise("")
    return {
        "length": F.char_length(text), "host_length": F.char_length(host), "path_length": F.char_length(path),
        "host_depth": found(r"\.", host), "path_depth": found("/", path), "digit_ratio": found("[0-9]") / n,
        "sign_ratio": found("[-_%=&@~+]") / n, "upper_ratio": found("[A-Z]") / n, "entropy": _entropy(text), "host_entropy": _entropy(host),
        "parameters": F.when(F.char_length(query) > 0, found("&", query) + 1).otherwise(0), "query_length": F.char_length(query),
        "fragment": F.char_length(text) - F.char_length(before),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.char_length)),
    }


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """(suffix, seen, blocked) over all distinct labelled URLs."""
    return labelled.select(F.explode(F.array(*_suffixes())).alias("suffix"), "label").groupBy("suffix").agg(
        F.count("*").cast("double").alias("seen"), F.sum("label").alias("blocked")
    )


def _with_features(parts: DataFrame, url: str, counts: DataFrame, own: Column | None = None) -> DataFrame:
    """``parts`` with ``features``. With ``own`` (a training URL's label) its own count is taken out of the suffix counts."""
    names = parts.columns
    short, long = _suffixes()
    rows = parts.withColumns({"__short": short, "__long": long, "q": F.substring_index(F.coalesce(F.col(url).cast("string"), F.lit("")), "#", 1)})
    statistics = []
    for name in ("__short", "__long"):
        told = counts.select(F.col("suffix").alias(name), F.col("seen").alias(f"{name}_seen"), F.col("blocked").alias(f"{name}_blocked"))
        rows = rows.join(told, name, "left")
        seen, blocked = (F.coalesce(f"{name}_{c}", F.lit(0.0)) for c in ("seen", "blocked"))
        if own is not None:
            seen, blocked = seen - 1, blocked - own
        statistics += [(blocked + 0.5) / (seen + 1), F.log1p(seen)]
    values = [c.cast("double") for c in [*lexical_features(url).values(), *statistics]]
    return rows.select(*names, array_to_vector(F.array(*values)).alias("features"))


@dataclass
class Filter:
    """A trained filter. ``model`` is None where the labels were all alike; then ``constant`` is the verdict."""

    model: GBTClassificationModel | None
    counts: DataFrame | None
    constant: float


def train(labelled: DataFrame, url: str = "url", trees: int = 12, depth: int = 4) -> Filter:
    """Fit on ``labelled``: ``url``, host, path (see ``with_parts``) and ``label``, 1.0 for block. No labels mean allow.

    A URL that stands often is one; of a URL with both labels, block counts. Null URLs teach nothing.
    """
    distinct = cut_lineage(labelled.where(F.col(url).isNotNull()).groupBy(url, "host", "path").agg(F.max("label").alias("label")))
    some = [distinct.where(F.col("label") == x).orderBy(F.xxhash64(url), url).limit(SAMPLE) for x in (0.0, 1.0)]
    sample = cut_lineage(some[0].unionByName(some[1]))
    seen = {r[0] for r in sample.select("label").distinct().collect()}
    if len(seen) < 2:
        return Filter(None, None, seen.pop() if seen else 0.0)
    counts = cut_lineage(suffix_counts(distinct))
    learner = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=5, maxBins=32, cacheNodeIds=False)
    rows = _with_features(sample, url, counts, F.col("label")).select("features", "label")
    return Filter(learner.fit(cut_lineage(rows.repartition(4, F.hash("features", "label")).sortWithinPartitions(F.hash("features"), "label"))), counts, 0.0)


def verdicts(parts: DataFrame, trained: Filter, url: str = "url") -> DataFrame:
    """``parts`` with ``block`` (boolean), what the trees say of each URL; a null URL counts as empty.

    Rows stay as often as they stand, URLs of any length are read whole, own columns keep their names.
    """
    if trained.model is None:
        return parts.withColumn("block", F.lit(trained.constant > 0.5))
    scored = trained.model.transform(_with_features(parts.select(F.struct("*").alias("__row"), url, "host", "path"), url, trained.counts))
    return scored.select("__row.*", (F.col("prediction") > 0.5).alias("block"))
