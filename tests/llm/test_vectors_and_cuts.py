import random
from collections import Counter

import numpy as np
import pytest

from fleetscope.llm import fmindex, infill, pivots, spans, winnowing
from fleetscope.llm.tokens import encoder


def twins(n: int) -> tuple[str, str]:
    """Two different words of ``2 ** n`` letters that any polynomial hash modulo 2^64 takes for one."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_long_words_with_one_polynomial_hash_stay_apart(spark):
    for n in (6, 10, 12):
        a, b = twins(n)
        data = np.frombuffer((a + b + a).encode(), np.uint8)
        starts = np.array([0, len(a), 2 * len(a)])
        hashes = spans.span_hashes(data, starts, starts + len(a))
        assert hashes[0] == hashes[2] != hashes[1]
        which, first = spans.named(data, starts, starts + len(a))
        assert which[0] == which[2] != which[1] and len(first) == 2
    a, b = twins(10)
    fill = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join([*fill, a, *fill[::-1]])), (2, " ".join([*fill[:20], "x", b, *fill[::-1]])), (3, " ".join(["y"] * 20 + [a] + ["z"] * 20)), (4, " ".join(["y"] * 20 + [b] + ["z"] * 20))]
    found = {r["doc_id"]: r["n_removed"] for r in fmindex.remove_repeats(spark.createDataFrame(rows[2:], "doc_id long, text string")).collect()}
    assert found == {3: 0, 4: 0}
    data, offsets = spans.text_bytes(__import__("pyarrow").array([t for _, t in rows]))
    own = encoder("byte_bpe_50k.json")
    ids, at = own.encode(data, offsets)
    for k, (_, t) in enumerate(rows):
        assert ids[at[k] : at[k + 1]].tolist() == own.whole.encode(t, add_special_tokens=False).ids


def test_names_by_bytes_when_hashes_collide(monkeypatch):
    monkeypatch.setattr(spans, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    text = b"aab abb aab xy zz xy " + b"q" * 200 + b" " + b"r" * 200
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = spans.word_spans(data, np.array([0, len(data)]))
    which, first = spans.named(data, starts, ends)
    words = [text[a:b] for a, b in zip(starts, ends)]
    assert [words[first[w]] for w in which] == words and len(first) == len(set(words))


@pytest.mark.parametrize("error", [1, 8, 96])
def test_rank_index_is_exact(error):
    rng = np.random.default_rng(error)
    for steps in (np.full(5000, 7), rng.integers(0, 300, 5000), rng.integers(0, 3, 5000), np.r_[np.zeros(100, int), [10**9], rng.integers(1, 90, 800)], np.zeros(0, int), [5]):
        offsets = np.cumsum(np.asarray(steps, np.int64))
        index = infill.RankIndex(offsets, error)
        assert (index.offset(np.arange(len(offsets))) == offsets).all()
        assert len(index.residual) == len(offsets) and index.residual.dtype == np.int8 and np.abs(index.residual).max(initial=0) <= error + 1
    assert len(infill.RankIndex(np.arange(0, 70_000, 7)).first) == 1
    with pytest.raises(ValueError):
        infill.RankIndex(np.arange(3), 0)


def test_fill_in_middle_keeps_texts(spark):
    rng = random.Random(1)
    texts = [None, "", "\n", "a", "a\nb", "x\n\n\ny\n", "has <S> inside\nx", "é ü\r\nz\n", "l\n" * 30_000, "w" * 200_000]
    texts += ["\n".join("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    rows = [(None if k == 12 else k % 50, t, "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)
    made = infill.fill_in_middle(docs)
    found = made.select("*", infill.restored("output", "form").alias("back")).collect()
    assert Counter((r["doc_id"], r["back"]) for r in found) == Counter((k, t or "") for k, t, _ in rows)
    for r in found:
        assert r["n"] == len([x for x in r["back"].split("\n")[:-1]]) + (not r["back"].endswith("\n") and r["back"] != "")
        plain = r["back"] == "" or "<S>" in r["back"]
        assert (r["form"] == "plain") == plain == (r["prefix_chars"] is None)
        if not plain:
            assert r["output"].endswith("<M>" + r["back"][r["prefix_chars"] : r["prefix_chars"] + r["middle_chars"]])
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs.where("doc_id < 0")).count() == 0
    assert {r["form"] for r in infill.fill_in_middle(docs, rate=0).collect()} == {"plain"}


def test_pivot_bounds_leave_work_out_and_change_nothing():
    rng = np.random.default_rng(6)
    centres = rng.integers(-900, 900, (8, 64))
    x = np.concatenate([c + rng.integers(-40, 40, (200, 64)) for c in centres] + [centres, centres])
    centroids = np.concatenate([centres[:6], centres[:2]])  # two of them twice: ties
    for n in (0, 1, 8):
        points = pivots.far_apart(x[:64], n)
        label, best, computed = pivots.nearest(x, pivots.distances(x, points), centroids, pivots.distances(centroids, points))
        full = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
        assert (label == full.argmin(1)).all() and (best == full.min(1)).all()
        assert n < 8 or computed < 0.5 * full.size
    assert len(pivots.far_apart(np.zeros((5, 64), np.int64), 4)) == 1 and len(pivots.far_apart(np.zeros((0, 64), np.int64), 4)) == 0


def test_clusters_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, cluster int, distance long"
    empty = pivots.cluster(spark.createDataFrame([], schema), 8, 10)
    assert pivots.with_inertia(empty).count() == 0
    rows = [(k, [float(k)] * 64, 1, 1) for k in range(3)] + [(9, None, 1, 1), (10, [0.0] * 65, 1, 1)]
    made = pivots.with_inertia(pivots.cluster(spark.createDataFrame(rows, schema), 8, 10)).collect()
    assert len(made) == 3 and {r["inertia"] for r in made} == {0} and len({r["cluster"] for r in made}) == 3
    same = pivots.with_inertia(pivots.cluster(spark.createDataFrame([(1, [1.5] * 64, 1, 1)] * 20, schema), 8, 2)).collect()
    assert len(same) == 20 and {r["cluster"] for r in same} == {0}
    with pytest.raises(Exception, match="would not fit"):
        pivots.cluster(spark.createDataFrame([(1, [1e9] * 64, 1, 1)], schema), 8, 1)


def test_filter_holds_what_it_was_given(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 3000, dtype=np.int64) * rng.choice([-1, 1], 3000)
    made = winnowing.bit_filter(spark.createDataFrame([(int(v),) for v in values], "hash long"), 1 << 16)
    assert winnowing.passes(made, values.view(np.uint64)).all()
    others = rng.integers(0, 1 << 63, 20_000, dtype=np.int64).view(np.uint64)
    assert winnowing.passes(made, others).mean() < 0.1


def test_winnowing_guarantee():
    """Any shared span of a whole window shares a fingerprint at the same place."""
    rng = np.random.default_rng(9)
    shared = rng.integers(0, 1 << 62, 10).astype(np.uint64)
    for k in range(50):
        left, right = (rng.integers(0, 1 << 62, rng.integers(0, 30)).astype(np.uint64) for _ in range(2))
        text = np.r_[left, shared, right]
        starts = winnowing.inner(np.array([len(text)]), 10)
        grams, place = winnowing.anchors(text, starts, 10, 5)
        own_grams, own = winnowing.anchors(shared, np.array([0]), 10, 5)
        at = place[len(left)]
        assert at - len(left) == own[0] and grams[at] == own_grams[own[0]]


def brute_contamination(rows, items, window=10):
    import hashlib
    import re

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = {}
    for k, t in items:
        w = lower(t)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            runs.setdefault(tuple(w[i : i + size]), set()).add("" if k is None else str(k))
    out = Counter()
    for k, t in rows:
        w = lower(t)
        hit, names = [False] * len(w), set()
        for run, ids in runs.items():
            for i in range(len(w) - len(run) + 1):
                if tuple(w[i : i + len(run)]) == run:
                    hit[i : i + len(run)] = [True] * len(run)
                    names |= ids
        out[k, len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), any(hit)] += 1
    return out


def test_contamination_matches_brute_force(spark):
    rng = random.Random(12)
    pool = [f"w{k}" for k in range(25)] + ["Ünder", "x1", "42"]
    say = lambda n: rng.choice([" ", "-", ". "]).join(rng.choice(pool) for _ in range(n))
    items = [(k, say(rng.choice([1, 2, 3, 6, 9, 10, 11, 30]) if k % 2 else 30)) for k in range(14)] + [(None, say(14)), (3, say(16)), (90, None), (91, " .,"), (92, "W1-w2")]
    rows = [(k % 60, say(rng.randint(0, 60))) for k in range(70)]
    rows += [(100 + k, f"{say(9)} {t} {say(5)}") for k, (_, t) in enumerate(items) if t] + [(200, None), (201, ""), (None, items[0][1].upper()), (300, " ".join(f"w{k % 25}" for k in range(40_000)))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, hits string").repartition(4)
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, window int")
    found = winnowing.contamination(docs, bench).collect()
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in found)
    assert got == brute_contamination(rows, items)
    assert winnowing.contamination(docs.where("doc_id < 0"), bench).count() == 0
    clean = winnowing.contamination(docs, bench.where("item_id < 0"))
    assert clean.count() == len(rows) and clean.where("contaminated").count() == 0
