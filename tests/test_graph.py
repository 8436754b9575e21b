import datetime as dt
import random
from collections import defaultdict

import pytest

from fleetscope.operators import graph

T = dt.datetime(2024, 1, 1)
SCHEMA = "server_id bigint, collection_time timestamp, session_id bigint, request_id bigint, blocking_session_id bigint"


def brute(edges, nodes):
    """Chains counted by walking every path that does not repeat a session."""
    down = defaultdict(set)
    for session, blocker in edges:
        if blocker in nodes and blocker != session:
            down[blocker].add(session)

    def paths(node, seen):
        return sum(1 + paths(child, seen | {child}) for child in down[node] if child not in seen)

    return {n: paths(n, {n}) for n in nodes}


def run(frame, rows, edges, nodes):
    data = [(1, T, s, i, b) for i, (s, b) in enumerate(edges)] + [(1, T, n, 99, None) for n in nodes]
    got = graph.blocking_chains(frame(SCHEMA, data))
    return {s: (c, d, r) for s, c, d, r in rows(got, "session_id", "blocked_session_count", "depth", "root_session_id")}


@pytest.mark.parametrize("seed", [1, 2])
def test_single_blocker_graphs_with_cycles_match_path_walk(frame, rows, seed):
    rnd = random.Random(seed)
    nodes = list(range(1, 41))
    edges = [(n, rnd.choice(nodes)) for n in nodes if rnd.random() < 0.85]
    got = run(frame, rows, edges, nodes)
    assert {s: c for s, (c, _, _) in got.items()} == brute(edges, set(nodes))
    blocker = {s: b for s, b in edges if s != b}
    for s, (_, depth, root) in got.items():
        here, hops, seen = s, 0, {s}
        while here in blocker:
            here, hops = blocker[here], hops + 1
            if here in seen:
                assert (depth, root) == (None, None)
                break
            seen.add(here)
        else:
            assert (depth, root) == (hops, here)


def condensed(edges, nodes):
    """Sessions that wait for each other as one, then chains along the rest."""
    up = {n: {b for s, b in edges if s == n and b in nodes and b != n} for n in nodes}
    above = {n: set(up[n]) for n in nodes}
    for _ in nodes:
        above = {n: above[n].union(*(above[b] for b in above[n])) for n in nodes}
    strong = {n: min({n} | {b for b in above[n] if n in above[b]}) for n in nodes}

    def worth(one):
        below = [strong[s] for s in nodes for b in up[s] if strong[b] == one and strong[s] != one]
        return sum(v == one for v in strong.values()) + sum(worth(b) for b in below)

    return strong, {n: worth(strong[n]) - 1 for n in nodes}


@pytest.mark.parametrize("seed,n,share", [(3, 16, 0.4), (4, 24, 0.45)])
def test_several_blockers_and_entangled_cycles(frame, rows, seed, n, share):
    rnd = random.Random(seed)
    nodes = list(range(1, n + 1))
    edges = [(n, b) for n in nodes for b in rnd.sample(nodes, 2) if rnd.random() < share]
    got = run(frame, rows, edges, nodes)
    strong, counts = condensed(set(edges), set(nodes))
    assert {s: c for s, (c, _, _) in got.items()} == counts
    data = [(1, T, s, 0, b) for s, b in edges] + [(1, T, n, 99, None) for n in nodes]
    labels = rows(graph.strong_components(graph.block_edges(frame(SCHEMA, data)), graph.K), "session_id", "strong")
    groups = defaultdict(set)
    for s, name in labels:
        groups[name].add(s)
    expected = defaultdict(set)
    for s in {s for s, _ in labels}:
        expected[strong[s]].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_acyclic_graph_with_several_blockers_matches_path_walk(frame, rows):
    rnd = random.Random(8)
    nodes = list(range(1, 31))
    edges = [(n, b) for n in nodes for b in rnd.sample(nodes, 2) if b < n and rnd.random() < 0.8]
    assert {s: c for s, (c, _, _) in run(frame, rows, edges, nodes).items()} == brute(set(edges), set(nodes))


def test_long_chain_below_two_blockers_is_bypassed(frame, rows, monkeypatch):
    """A chain of 150 under a session with two blockers: rounds do not follow its length."""
    steps, add = [], graph._add_worth
    monkeypatch.setattr(graph, "_add_worth", lambda *a: steps.append(1) or add(*a))
    edges = [(n, n - 1) for n in range(4, 151)] + [(3, 1), (3, 2)]
    got = run(frame, rows, edges, [1, 2, 3])
    assert got[1] == (148, 0, 1) and got[2] == (148, 0, 2) and got[3][0] == 147 and got[149][0] == 1 and got[150][:2] == (0, 148)
    assert len(steps) < 15


def test_closure_of_a_long_chain_keeps_tables_linear(frame, rows, monkeypatch):
    """3,000 sessions in a row with side branches: no table between the rounds outgrows the graph."""
    sizes, cut = [], graph.cut_lineage

    def counted(df):
        made = cut(df)
        sizes.append(made.count())
        return made

    monkeypatch.setattr(graph, "cut_lineage", counted)
    edges = [(n, n - 1) for n in range(2, 3001)] + [(n, n + 5000) for n in range(100, 3001, 700)] + [(n + 5000, n + 6000) for n in range(100, 3001, 700)]
    tops = [n + 6000 for n in range(100, 3001, 700)]
    data = [(1, T, s, i, b) for i, (s, b) in enumerate(edges)] + [(1, T, n, 99, None) for n in [1, *tops]]
    everything = frame(SCHEMA, data)
    found = graph.blocker_closure(everything.filter("session_id = 2900 and blocking_session_id = 2899"), everything)
    expected = set(range(1, 2901)) | {n + k for n in range(100, 2901, 700) for k in (5000, 6000)}
    assert {s for s, in rows(found, "session_id")} == expected
    assert max(sizes) <= len(edges) + len(tops) + 1 and len(sizes) < 45


def test_long_chain_needs_few_rounds_and_missing_blocker_is_no_node(frame, rows):
    edges = [(n, n - 1) for n in range(2, 201)] + [(500, 9999), (600, 0), (700, 700)]
    got = run(frame, rows, edges, [1, 500, 600, 700])
    assert got[1] == (199, 0, 1) and got[200] == (0, 199, 1)
    assert got[500] == (0, 0, 500) and got[600] == (0, 0, 600) and got[700] == (0, 0, 700)


def test_servers_and_collections_stay_apart(frame, rows):
    data = [(1, T, 1, 0, None), (1, T, 2, 0, 1), (2, T, 1, 0, None), (2, T, 2, 0, None)]
    chains = graph.blocking_chains(frame(SCHEMA, data))
    assert rows(graph.block_leaders(chains), "server_id", "session_id") == [(1, 1)]


def test_closure_adds_blockers_and_is_idempotent(frame, rows):
    edges = [(5, 4), (4, 3), (3, 2), (7, 8), (8, 7), (9, 7), (9, 5)]
    everything = frame(SCHEMA, [(1, T, s, i, b) for i, (s, b) in enumerate(edges)] + [(1, T, 2, 0, None)])
    once = graph.blocker_closure(everything.filter("session_id = 9"), everything)
    assert {s for s, in rows(once, "session_id")} == {2, 3, 4, 5, 7, 8, 9}
    again = graph.blocker_closure(once.drop("is_added"), everything)
    assert rows(again, "session_id", "request_id") == rows(once, "session_id", "request_id")
    assert rows(graph.missing_blockers(everything.filter("session_id in (9, 5)")), "session_id") == [(4,), (7,)]


def test_no_sessions(frame):
    assert graph.blocking_chains(frame(SCHEMA, [])).count() == 0


def test_small_groups_need_no_rounds_and_equal_the_general_walk(frame, rows, monkeypatch):
    rnd = random.Random(1)
    data = []
    for server in range(30):
        nodes = list(range(100, 100 + rnd.choice([2, 5, 12])))
        data += [(server, T, n, 0, None) for n in nodes]
        data += [(server, T, n, i, rnd.choice([*nodes, 0, 999])) for i in range(rnd.choice([1, 2])) for n in nodes if rnd.random() < 0.8]
    columns = ["server_id", "session_id", "blocked_session_count", "depth", "root_session_id"]
    cuts, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    got = rows(graph.blocking_chains(frame(SCHEMA, data)), *columns)
    assert len(cuts) == 1
    monkeypatch.setattr(graph, "SMALL_GROUP", 0)
    assert got == rows(graph.blocking_chains(frame(SCHEMA, data)), *columns)


def test_largest_small_group_fits_into_one_number(frame, rows):
    """31 edges that share no session make 62 sessions; in a chain they make 31 levels."""
    edges = [(n + 100, n) for n in range(1, 32)]
    got = run(frame, rows, edges, {n for e in edges for n in e})
    assert got == {**{n: (1, 0, n) for n in range(1, 32)}, **{n + 100: (0, 1, n) for n in range(1, 32)}}
    chain = [(n + 1, n) for n in range(1, 32)]
    got = run(frame, rows, chain, set(range(1, 33)))
    assert got == {n: (32 - n, n - 1, 1) for n in range(1, 33)}


def test_closure_walks_only_what_the_filter_dropped(frame, rows, monkeypatch):
    rnd = random.Random(5)
    data = [(1, T, n, i, rnd.choice([None, rnd.randrange(60)])) for n in range(60) for i in range(2)]
    everything = frame(SCHEMA, data)
    for kept in (lambda n: n % 3 == 0, lambda n: n % 7 == 1):
        got = graph.blocker_closure(everything.filter(f"session_id in ({', '.join(str(n) for n in range(60) if kept(n))})"), everything)
        found = {n for n in range(60) if kept(n)}
        while more := {b for _, _, n, _, b in data if n in found and b is not None} - found:
            found |= more
        assert rows(got, "session_id", "request_id", "is_added") == sorted(((n, i, not kept(n)) for n in found for i in range(2)), key=repr)

    def fail(*_):
        raise AssertionError("nothing was dropped, so there is nothing to walk")

    monkeypatch.setattr(graph, "lifting_levels", fail)
    whole = graph.blocker_closure(everything, everything)
    assert rows(whole, "session_id", "request_id", "is_added") == sorted(((n, i, False) for _, _, n, i, _ in data), key=repr)


def test_sessions_that_block_nobody_are_not_walked(frame, rows, monkeypatch):
    # 1 <- 2 <- 3 with 100 sessions at each, and a ring of 400 and 401 with 50 at 400.
    edges = [(2, 1), (3, 2), (400, 401), (401, 400), *[(10 + n, 1 + n % 3) for n in range(300)], *[(500 + n, 400) for n in range(50)]]
    edges.append((900, 901))
    walked, double = [], graph._double

    def counted(links, *rest):
        walked.append(links.count())
        return double(links, *rest)

    monkeypatch.setattr(graph, "_double", counted)
    got = run(frame, rows, edges, sorted({n for e in edges for n in e}))
    assert walked and max(walked) <= 4
    assert [got[n] for n in (1, 2, 3, 901)] == [(302, 0, 1), (201, 1, 1), (100, 2, 1), (1, 0, 901)]
    assert [got[n] for n in (10, 11, 12, 900)] == [(0, 1, 1), (0, 2, 1), (0, 3, 1), (0, 1, 901)]
    assert [got[n] for n in (400, 401, 500)] == [(51, None, None), (51, None, None), (0, None, None)]


def test_jump_tables_hold_where_ways_from_the_starts_lead(frame, rows, monkeypatch):
    # 100 ways of two steps meet in a chain of 200; only one of them is asked for.
    nodes = range(1000, 1200)
    edges = [(n, n + 1) for n in nodes] + [(i, 100 + i) for i in range(100)] + [(100 + i, 1000) for i in range(100)]
    sizes, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: (lambda done: sizes.append((done.columns, done.count())) or done)(cut(df)))
    table = frame("server_id bigint, a bigint, b bigint", [(1, a, b) for a, b in edges])
    found = graph.reachable(table, table.filter("a in (7, 1100)").select("server_id", "a"), ["server_id"], "a", "b")
    assert rows(found, "a") == [(n,) for n in sorted([7, 107, *range(1000, 1201)], key=lambda n: repr((n,)))]
    # All tables after the graph itself: neither the 99 other ways nor their first steps are left in the second.
    jumps = [n for columns, n in sizes if columns == ["server_id", "a", "b"]]
    assert len(jumps) > 4 and jumps[0] == 301 and jumps[1] <= 300 and max(jumps[2:]) <= 201
