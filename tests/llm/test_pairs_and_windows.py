import hashlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
import xxhash

from fleetscope.llm import fmindex, simhash, suffixes, windows
from fleetscope.llm.links import components

SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    return (text or "").encode().split()


def brute_print(text):
    words = words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_classes(items):
    """{position: smallest id reachable} of [(id, fingerprint)]."""
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(items)):
        groups[find(i)].append(items[i][0])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(items))]


def test_simhash_classes_match_brute_force(docs, corpus):
    found = simhash.classes(simhash.fingerprints(docs)).collect()
    items = [(k, brute_print(t)) for k, t, _ in corpus]
    expected = Counter((i, f, c) for (i, f), c in zip(items, brute_classes(items)))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == expected


def test_simhash_links_of_dense_groups(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 62, 60)
    values = [int(c) for c in centres]
    for c in centres[:6]:
        for _ in range(80):
            x = int(c)
            for _ in range(rng.integers(1, 4)):
                x ^= 1 << int(rng.integers(0, 62))
            values.append(x)
    rows = list(enumerate(values))
    for parts in (2, 3):
        got = {r["doc_id"]: r["component_id"] for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, fp long"), 3, parts).collect()}
        assert got == dict(zip(range(len(rows)), brute_classes(rows)))


def test_simhash_plan_spends_the_radius():
    sample = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    for parts, radius in ((2, 3), (3, 5), (4, 7), (5, 3)):
        plan = simhash.make_plan(sample, 10_000, radius, parts)
        assert sum(t + 1 for t in plan.thresholds) == radius + 1
        assert sum(plan.masks) == (1 << 64) - 1 and len(plan.masks) == parts
    probes = []
    for rows in (0, 1, 10**5, 10**8, 10**11):
        plan = simhash.make_plan(sample if rows > 1 else sample[:rows], rows, 5)
        assert sum(t + 1 for t in plan.thresholds) == 6
        probes.append(sum(len(x) for _, x in plan.variations()))
    assert probes[0] <= 6 and probes == sorted(probes), "longer keys, and so more probes, for more rows"


def test_probes_are_one_expression(spark):
    """However many bits are varied: no plan writes an expression per probe."""
    keys = simhash._probes(0xFFFF, [x for x in range(20_000)])
    frame = spark.createDataFrame([(5,), (-1,)], "fp long").select(keys.alias("k"))
    assert len(frame._jdf.queryExecution().analyzed().toString()) < 500_000
    got = [r["k"] for r in frame.collect()]
    assert [len(x) for x in got] == [20_000] * 2 and got[0][:4] == [5, 4, 7, 6] and got[1][0] == 0xFFFF


def test_simhash_on_nothing_and_one_of_each(spark, docs, corpus, nothing):
    assert simhash.classes(simhash.fingerprints(nothing)).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and not {40, 41, 42, 43, 44, 45, 46, 58} & set(ids) and {0, 1, 2, 3, 8, 20} <= set(ids)
    assert simhash.one_of_each(nothing).count() == 0


def test_one_of_each_decides_by_row(spark):
    """Null ids, one id with two texts, an id that is a copy in one class and alone in another, and repeated rows."""
    rng = np.random.default_rng(7)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 80)) for _ in range(12)]
    rows = [(None, text[k]) for k in range(6)] + [(None, text[0])] * 3
    rows += [(1, text[6]), (1, text[7]), (3, text[8]), (5, text[8]), (5, text[9]), (None, text[9]), (7, text[10]), (7, text[10]), (None, text[11]), (8, text[11])]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    expected = [(None, text[k]) for k in range(6)] + [(1, text[6]), (1, text[7]), (3, text[8]), (5, text[9]), (7, text[10]), (8, text[11])]
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter(expected)


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(0, 300)]
    star = [(1000, 1000 + k) for k in range(1, 500)]
    rows = chain + star + [(7, 7), (3, 2), (3, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "x long, y long"), "x", "y").collect()}
    assert got == {k: 0 for k in range(1, 301)} | {1000 + k: 1000 for k in range(1, 500)}


def brute_windows(corpus, window):
    texts = [words_of(t) for _, t, _ in corpus]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = Counter()
    for (k, _, _), w in zip(corpus, texts):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, y in zip(w, gone) if not y)
        out[k, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window,gram", [(35, 8), (12, 4)])
def test_repeated_words_match_brute_force(docs, corpus, window, gram):
    found = fmindex.remove_repeats(docs, window, gram).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == brute_windows(corpus, window)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in found)


def brute_copied(corpus, window):
    first = {}
    order = sorted(((-(1 << 63) if k is None else k, k, (t or "").encode()) for k, t, _ in corpus), key=lambda x: x[0])
    for rank, _, b in order:
        for i in range(len(b) - window + 1):
            first.setdefault(b[i : i + window], rank)
    out = Counter()
    for rank, k, b in order:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < rank:
                gone[i : i + window] = True
        spans = sum(bool(gone[i]) and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[k, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_copied_bytes_match_brute_force(docs, corpus):
    found = suffixes.remove_copied(docs).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found)
    assert got == brute_copied(corpus, 50)


def test_windows_with_zero_bytes_and_nothing(spark, nothing):
    rows = [(1, "a" * 49 + "\0" + "b" * 30), (2, "a" * 49 + "\0\0" + "c" * 30), (3, "x" + "a" * 49 + "\0" + "b" * 30), (4, "a" * 60)]
    made = suffixes.remove_copied(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in made)
    assert got == brute_copied([(*r, None) for r in rows], 50)
    assert suffixes.remove_copied(nothing).count() == 0 and fmindex.remove_repeats(nothing).count() == 0


def frequent_gram():
    """120 texts that hold one gram in different surroundings, some of them twice."""
    rng = np.random.default_rng(11)
    some = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 900, n))
    rows = [(k, some(20) + " licensed under these terms " + some(20)) for k in range(120)]
    return rows + [(200 + k, some(9) + " " + rows[k][1] + " " + some(3)) for k in range(0, 120, 9)] + [(None, rows[5][1])]


@pytest.mark.parametrize("most", [3, 20, 1 << 13])
def test_split_anchors_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(windows, "CHUNK_BYTES", 4000)
    rows = frequent_gram()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    corpus = [(*r, None) for r in rows]
    for module in (fmindex, suffixes):
        made = replace(module.search(12, 3) if module is fmindex else module.search(50, 18), most=most)
        monkeypatch.setattr(module, "search", lambda *_, made=made: made)
    found = fmindex.remove_repeats(docs, 12, 3).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == brute_windows(corpus, 12)
    found = suffixes.remove_copied(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == brute_copied(corpus, 50)


def test_no_bucket_gathers_a_frequent_anchor(spark):
    """Frequent words among ever different ones: the shard says of each window how many segments it was given."""
    rows = [(k, f"{k}x the of {k}y and to {k}z in or") for k in range(3000)]

    def given(text, lengths, counts, times, least):
        return np.full(int(counts.sum()), len(lengths), np.int64)

    def finish(chunk, units, row, start, said):
        return pd.DataFrame({"most": [int(said.max(initial=0))], "n": [len(said)]})

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = windows.found_windows(docs, windows.Search(9, 1, True, given, "i8", most=200), finish, "most long, n long").collect()
    assert 0 < max(r["most"] for r in made) < 600 and sum(r["n"] for r in made) > 1000


def test_fm_index_counts_weighted_occurrences():
    rng = np.random.default_rng(5)
    text = rng.integers(1, 7, 500)
    text[200:260] = text[20:80]
    text[-1] = 0
    weights = np.ones(500, np.int64)
    index = fmindex.FMIndex(text, weights)
    for start in range(0, 440, 7):
        for size in (1, 3, 9, 40):
            pattern = text[start : start + size]
            low, high = np.zeros(1, np.int64), np.full(1, 500)
            for c in pattern[::-1]:
                low, high = index.step(np.array([c]), low, high)
            assert high[0] - low[0] == sum((text[i : i + size] == pattern).all() for i in range(500 - size + 1))


def test_levels_grow_geometrically():
    family = suffixes.Levels()
    for k in range(64):
        keys = np.sort(np.array([f"{i * 64 + k:08d}" for i in range(100)], "S9"))
        known = family.look_up(keys, np.full(100, k))
        assert not known.any()
        family.add(keys, np.full(100, k))
    assert len(family.levels) <= 7 and sum(len(x) for x, _ in family.levels) == 6400
    least = np.full(1, 99)
    assert family.look_up(np.array(["00000005"], "S9"), least).all() and least[0] == 5


def test_anchors_spread_over_buckets():
    data = np.random.default_rng(2).integers(97, 123, 300_000).astype(np.uint8)
    units = windows.units_of(data, np.array([0, 150_000, 300_000]), False)
    runs = windows.runs_of(units, 50, 18)
    assert runs.count.sum() == 2 * (150_000 - 49)
    sizes = np.bincount(windows.bucket_of(runs.anchor, 8), minlength=8)
    assert sizes.max() < 1.2 * sizes.min()
