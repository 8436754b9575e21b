import bisect
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fleetscope.llm import chunking, hpylm, mixing, packing, quality, secrets, urls
from fleetscope.llm.tokens import encoder


def test_secret_spans_of_fixed_patterns(spark, nothing):
    key = "AKIA" + "Q7" * 8
    rows = [
        (1, f'password = "hunter22" and {key} deadbeefdeadbeefdeadbeef'), (2, "token=a secret: abcdef"), (3, None), (4, ""), (5, "PassWD:xxxxxx api_key='12345'"),
        (6, "päß token == tokentoken"), (7, "api-key: 1234567 toKen\x20\x20:\x20'zzzzzzz"), (7, "ſecret=abcdefgh"), (8, "AKIA" + "A" * 15),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    found = {(r["doc_id"], tuple(r["base"])) for r in secrets.scan(docs, secrets.train_on_documents(docs)).collect()}
    assert found == {
        (1, ("assign:0:20", "access:26:46", "hex:47:71")), (2, ("assign:8:22",)), (3, ()), (4, ()), (5, ("assign:0:13",)),
        (6, ()), (7, ("assign:17:34",)), (7, ()), (8, ()),
    }
    model = secrets.train_on_documents(nothing)
    assert secrets.scan(nothing, model).count() == 0 and secrets.redact(nothing, model).count() == 0


def test_secret_models_tell_random_from_ordinary(spark, docs, corpus):
    rng = random.Random(4)
    random_text = ["".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(rng.randint(20, 44))) for _ in range(400)]
    plain = ["_".join(rng.choices(("read", "window", "table", "count", "source", "merge", "value", "index"), k=5)) for _ in range(400)]
    train = [(x, True) for x in random_text[:200]] + [(x, False) for x in plain[:200]] + [(None, True), ("x", None)]
    model = secrets.train(spark.createDataFrame(train, "text string, random boolean"))
    assert sum(model.score(x) >= 20 for x in random_text[200:]) >= 190
    assert sum(model.score(x) >= 20 for x in plain[200:]) == 0
    own = secrets.train_on_documents(docs)
    assert sum(own.score(x) >= 20 for x in random_text) >= 380
    hidden = f"the {random_text[0]} of"
    made = secrets.redact(spark.createDataFrame([(1, hidden, 9), (2, None, 3)], "doc_id long, text string, n_chars long"), own).collect()
    assert {tuple(r) for r in made} == {(1, "the [SECRET] of", 15), (2, None, 0)}
    clean = secrets.scan(docs, own).where("size(spans) > 0").count()
    assert clean == 0


def brute_quality(text):
    text = text or ""
    words = text.encode().split()
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if runs[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (
        len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
    )


def test_quality_measures_and_verdicts(spark, docs, corpus, nothing):
    extra = [(100, "a\nb\na\n \n\na", None), (101, "## | <x> %\n" * 80, None), (102, "x y z x y z q x y", None)]
    frame = docs.select("doc_id", "text", "source").union(spark.createDataFrame(extra, "doc_id long, text string, source string"))
    labels = spark.createDataFrame([(k, int(k < 50)) for k in [*range(30), 50, 51, 52, 54, 57, 101]] + [(None, 1), (8, 1)], "doc_id long, quality int")
    found = quality.verdicts(frame, labels).collect()
    got = Counter((r["doc_id"], *[r["m"][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]) for r in found)
    assert got == Counter((k, *brute_quality(t)) for k, t, _ in [*corpus, *extra])
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert {k for k in (8, 17, 26, 47, 50, 51, 52, 54, 57, 101) if kept[k]} == {8, 17, 26, 47}
    good = quality.keep_good(frame, labels)
    assert good.columns == frame.columns and {r["doc_id"] for r in good.collect()} == {k for k, v in kept.items() if v}
    assert quality.keep_good(nothing).count() == 0 and quality.keep_good(docs).columns == docs.columns
    assert not any(x in quality.with_measures(docs)._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))


def test_quality_em_finds_accuracies(spark):
    rng, rows = random.Random(2), []
    for _ in range(4000):
        good = rng.random() < 0.8
        rows.append(tuple(0 if rng.random() < 0.1 else (1 if rng.random() > (0.004 if good else p) else -1) for p in (0.5, 0.6, 0.4)))
    counts = spark.createDataFrame([(*k, n) for k, n in Counter(rows).items()], "a int, b int, c int, n long")
    prior, rates = quality.fit(counts, ["a", "b", "c"])
    assert 0.6 < prior < 0.9 and all(r[-1][0] < 0.02 < 0.25 < r[-1][1] for r in rates)


def test_quality_labels_decide_what_a_bad_vote_means(spark):
    """Two rules each blame a tenth of the documents, alone: the labels say that only the second finds bad ones."""
    rng, rows = random.Random(3), []
    for k in range(3000):
        kind = rng.choice(["plain"] * 8 + ["first", "second"])
        votes = (-1 if kind == "first" else 1, -1 if kind == "second" else 1, 1)
        rows.append((*votes, None if k % 5 else int(kind != "second")))
    counts = spark.createDataFrame([(*k, n) for k, n in Counter(rows).items()], "a int, b int, c int, label int, n long")
    prior, rates = quality.fit(counts, ["a", "b", "c"])
    odds = {tuple(r)[:3]: r["o"] for r in counts.select("a", "b", "c", quality.log_odds(["a", "b", "c"], prior, rates).alias("o")).collect()}
    assert odds[-1, 1, 1] > 0 > odds[1, -1, 1] and odds[1, 1, 1] > 2


def brute_tokens(text):
    return [*encoder("byte_bpe_50k.json").whole.encode(text or "", add_special_tokens=False).ids, 2]


def test_packing_is_whole_and_tight(docs, corpus, nothing):
    size = 256
    rows = packing.pack(packing.pieces(docs, "byte_bpe_50k.json", 2, size, keep_ids=True), size).collect()
    expected, total = Counter(), 0
    for k, text, _ in corpus:
        ids = brute_tokens(text)
        total += len(ids)
        cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
        for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[k, number, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert len(sequences) <= math.ceil(total / size) + 2
    assert packing.pack(packing.pieces(nothing, "byte_bpe_50k.json", 2, size), size).count() == 0


@pytest.mark.parametrize("n,seed", [(1, 0), (7, 1), (300, 2), (20_000, 3)])
def test_plan_places_every_piece_once(n, seed):
    rng = np.random.default_rng(seed)
    counts = dict(Counter(rng.integers(1, 129, n).tolist()))
    plan = packing.Plan(counts, 128, groups=200)
    placed, room = Counter(), defaultdict(list)
    for length, rank, times, sequence, offset in sorted(plan.runs):
        assert placed[length] == rank
        placed[length] += times
        for k in range(times):
            room[sequence + k].append((offset, length))
    assert placed == counts and len(room) == plan.sequences
    for places in room.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    rooms: list[int] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = bisect.bisect_left(rooms, length)
            bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else 128) - length)
    assert plan.sequences <= 1.03 * len(rooms) + 2


def test_mix_targets():
    assert mixing.target_sizes([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    capped = mixing.target_sizes([600, 10, 0, 50], [1, 2, 3, 1])
    assert capped == pytest.approx([480, 30, 0, 150])
    assert mixing.target_sizes([], []) == [] and mixing.target_sizes([0], [1]) == [0.0]


def test_mix_comes_near_targets(docs, corpus, nothing):
    mix = mixing.plan(docs, weight=lambda k, _: k % 3 + 1, shards=4, blocks_per_shard=8)
    rows = mix.rows.collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((k, s, len((t or "").encode().split())) for k, t, s in corpus)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - t) <= largest[s] / 2 + 1 for s, t in target.items())
    again = mixing.plan(docs, weight=lambda k, _: k % 3 + 1, shards=4, blocks_per_shard=8)
    assert Counter((r["doc_id"], r["taken"]) for r in again.rows.collect()) == Counter((r["doc_id"], r["taken"]) for r in rows)
    written = mixing.write_order(docs, mix)
    assert written.columns == docs.columns
    got = Counter(r["doc_id"] for r in written.collect())
    want = Counter()
    for r in rows:
        assert r["taken"] == r["size"] * len(r["shards"]) and set(r["shards"]) <= set(range(4))
        want[r["doc_id"]] += len(r["shards"])
    assert got == +want
    assert mixing.write_order(nothing, mixing.plan(nothing, weight=lambda k, _: 1)).count() == 0
    assert mixing.plan(nothing, weight=lambda k, _: 1).rows.count() == 0


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, 300)}" for _ in range(n))


def hot_rows():
    """Null and repeated ids, rows that stand often, equal texts: a third of all rows share the null id, a tenth are one row."""
    rng = random.Random(21)
    rows = [(None if k % 3 == 0 else k % 500, prose(k % 700, 5 + k % 40), f"s{rng.randint(0, 4)}") for k in range(2400)]
    return rows + [(7, "one and the same", "s1")] * 200 + [(None, None, None)] * 60 + [(None, "x y", None)] * 90


def test_mix_agrees_however_rows_are_dealt(spark, monkeypatch):
    """Brute force over all ids: what is written is what the rows say, words come near targets, partitions change nothing."""
    monkeypatch.setattr(mixing, "EQUAL_ROWS", 64)
    rows = hot_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    results = []
    for n in (2, 7):
        frame = docs.repartition(n)
        mix = mixing.plan(frame, weight=lambda k, _: k % 3 + 1, shards=4, blocks_per_shard=8)
        found = mix.rows.collect()
        results.append(Counter((r["doc_id"], r["source"], r["__hash"], r["size"], r["taken"], tuple(r["shards"])) for r in found))
        written = Counter(tuple(r) for r in mixing.write_order(frame, mix).collect())
        assert sum(len((t or "").split()) * n for (_, t, _), n in written.items()) == sum(r["taken"] for r in found)
        assert all(c <= 3 * Counter(rows)[x] for x, c in written.items())
        taken, target, most = Counter(), {}, Counter()
        for r in found:
            taken[r["source"]] += r["taken"]
            target[r["source"]], most[r["source"]] = r["target"], max(most[r["source"]], r["size"])
        assert all(abs(taken[s] - t) <= most[s] / 2 + 1 for s, t in target.items())
    assert results[0] == results[1] and sum(results[0].values()) == len(rows)
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)


def test_splitting_tree_keeps_quotas():
    quotas = np.array([5, 0, 700, 33, 1])
    shares = mixing.split_quotas(quotas, 7, seed=1)
    assert (shares.sum(0) == quotas).all() and set(shares.sum(1)) <= {105, 106}
    assert (mixing.split_quotas(quotas, 7, seed=1) == shares).all()


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:stop]


RULES = [urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"), urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow")]


def brute_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_url_parts_rules_and_verdicts(spark):
    rng = random.Random(6)
    given = [None, "", "x", "http://", "HTTP://WWW.Example.NET/en/a?b#c", "http://example.net?en/", "a://b://c/d", "http://fr.org/fr/", "http://xnet/", "http://É.net/\n/x", "http://h#f://z/y"]
    given += [f"http://{rng.choice(['a', 'm.b', 'spam-x'])}.example.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{k}?p={k}" for k in range(300)]
    given += ["http://long.example.net/" + "a/" * 30_000]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(given)] + [(4, given[4], "x")], "page_id long, url string, features string").select("page_id", "url")
    parts = urls.with_parts(pages).withColumn("match", urls.matching_rule(RULES))
    for r in parts.collect():
        host, path = brute_parts(r["url"])
        rule = brute_rule(host, path)
        assert (r["host"], r["path"]) == (host, path)
        assert (r["match"]["name"] if r["match"] else None) == (rule.name if rule else None)
    labelled = parts.selectExpr("*", "cast(host like '%spam%' as double) as label")
    judged = urls.verdicts(parts, urls.train(labelled, trees=4, depth=3)).collect()
    assert len(judged) == len(given) + 1 and sum(r["block"] != ("spam" in r["host"]) for r in judged) <= 3
    empty = parts.where("page_id < 0").selectExpr("*", "1.0D as label")
    assert not any(r["block"] for r in urls.verdicts(parts, urls.train(empty)).collect())


def test_language_model_counts_and_perplexity(docs, corpus, nothing):
    found = hpylm.score(docs).collect()
    tokens = [(k, hpylm.is_held_out(k), [*(t or "").encode().lower().split(), None]) for k, t, _ in corpus]
    counts = Counter(w for _, held, x in tokens if not held for w in x)
    total, size = sum(counts.values()), len(counts)
    expected = Counter()
    for k, held, x in tokens:
        base = sum(math.log10((counts[w] + 1) / (total + size + 1)) for w in x)
        expected[k, held, len(x), sum(counts[w] > 0 for w in x), total, round(base, 4)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found) == expected
    assert all(r["score"] < 0 for r in found)
    assert sum(r["score"] for r in found if r["held_out"]) > sum(r["base_score"] for r in found if r["held_out"])
    assert hpylm.score(nothing).count() == 0


def test_language_model_is_normalised(spark, corpus):
    """Over all known words and one unknown the probabilities of a context add up to one."""
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    docs = spark.createDataFrame([(k, t) for k, t, _ in corpus[:20]], "doc_id long, text string")
    state = hpylm.requests(hpylm.chunks(docs, 4), 4).groupBy("bucket").applyInPandas(hpylm._opened, hpylm._STATE)
    state = hpylm.sweep(state, hpylm.totals(state), 2, 3, 1)
    all_ = hpylm.totals(state)
    sums, root = np.zeros(hpylm.CONTEXTS), 0.0
    for r in state.collect():
        owner, contexts, counts, tables, seated, words = hpylm._restaurants(r)
        root += all_.root_probability(np.bincount(owner, weights=tables, minlength=len(words)), seated).sum()
        sums += np.bincount(contexts, weights=(counts - all_.discount * tables) / (all_.strength + all_.customers[contexts]), minlength=hpylm.CONTEXTS)
    root += all_.root_probability(np.zeros(1), np.zeros(1))[0]
    back = (all_.strength + all_.discount * all_.by_context) / (all_.strength + all_.customers)
    used = all_.customers > 0
    assert root == pytest.approx(1, abs=1e-4) and (sums + back * root)[used] == pytest.approx(1, abs=1e-4)


def test_language_model_tells_previous_words_of_one_ending_apart(spark):
    """Words that end alike share a restaurant above their own; hot words are dealt to several buckets."""
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    learned, held = ([k for k in range(2000) if hpylm.is_held_out(k) == x] for x in (False, True))
    rng = random.Random(3)
    pairs = [("running", "fast"), ("singing", "songs"), ("cooking", "dinner"), ("reading", "books")]
    texts = [" ".join(f"{u} {w} w{rng.randrange(300)}" for u, w in rng.choices(pairs, k=5)) for _ in learned[:300]]
    texts += ["Running", "running fast", "running songs", "singing fast", "singing songs"]
    ids = learned[:300] + held[:5]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in hpylm.score(docs).collect()}
    _, fast, other, crossed, songs = (found[k] for k in held[:5])
    assert fast > other + 1 and songs > crossed + 1
    chunk = hpylm.chunks(docs, 4)
    book = hpylm.book_of(chunk)
    dealt = Counter(w for w, _ in {(w, r["bucket"]) for r in hpylm.requests(chunk, 4, book).collect() for w in book.read(r["words"], r["n_words"]).tolist()})
    assert len(book.hot) and max(dealt[w] for w in book.hot.tolist()) > 1 and all(dealt[w] == 1 for w in dealt if w not in book.hot)


def test_seating_follows_the_process():
    rng = np.random.default_rng(0)
    one_by_one = []
    for _ in range(400):
        tables = 1
        for n in range(1, 1000):
            tables += rng.random() < 3.0 / (3.0 + n - 0.5 * tables)
        one_by_one.append(tables)
    quick = hpylm.seat(np.full(400, 1000), np.full(400, 3.0), 0.5, rng)
    assert quick.mean() == pytest.approx(np.mean(one_by_one), rel=0.06)
    assert (hpylm.seat(np.array([0, 1, 5]), np.full(3, 2.0), 0.5, rng) <= [0, 1, 5]).all()


def test_fingerprints_of_edits(docs, corpus, nothing):
    order = sorted(((k, t or "") for k, t, _ in corpus), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    expected = Counter()
    for n, (k, text) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        half = len(text) // 2
        edited = (text[: len(text) - half] + after[:half]).encode()
        own, second, third = chunking.chunk_sets([text.encode(), edited, after.encode()])
        expected[k, len(text), hashlib.sha256(edited).hexdigest(), chunking.written(own), chunking.written(second), round(chunking.held(own, second), 9), round(chunking.held(own, third), 9)] += 1
    found = chunking.compare_with_next(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found) == expected
    assert chunking.compare_with_next(nothing).count() == 0


def test_chunks_resist_shifts():
    rng = random.Random(9)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(20_000))
    own, moved, other = chunking.chunk_sets([text, b"a few more words " + text, bytes(rng.choice(b"abcdefgh ") for _ in range(20_000))])
    assert chunking.held(own, moved) > 0.95 and chunking.held(own, other) < 0.05
    sizes = [n for n in own.values()]
    assert max(sizes) <= chunking.MOST and chunking.chunk_sets([b"", b"x"]) == [{}, chunking.chunk_sets([b"x"])[0]]
