import random

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import ranking, waits
from fleetscope.runtime import freeze_dealt


def test_sliced_numbers_equal_window_numbers_for_a_hot_group(frame, rows):
    rnd = random.Random(7)
    data = [("hot" if i % 3 else None if i % 5 else f"k{i}", rnd.choice([None, *range(50)]), i) for i in range(600)]
    df = frame("k string, v int, id int", data)
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    plain = ranking.number_rows(df, ["k"], order, "n", bounded=True)
    sliced = ranking.number_rows(df, ["k"], order, "n")
    assert rows(plain, "k", "v", "id", "n") == rows(sliced, "k", "v", "id", "n")


def test_best_row_and_spread(frame, rows):
    df = frame("k int, a int, b string", [(1, 5, "x"), (1, 7, "y"), (1, None, "z"), (None, 1, "n")])
    best = ranking.best_row(df, ["k"], [F.col("a")], ["a", "b"], {"n": F.count(F.lit(1))})
    assert rows(best, "k", "a", "b", "n") == sorted([(1, 7, "y", 3), (None, 1, "n", 1)], key=repr)
    spread = ranking.spread_group_value(df, ["k"], top=F.max("a"))
    assert rows(spread, "b", "top") == [("n", 1), ("x", 7), ("y", 7), ("z", 7)]


def test_dense_number(frame, rows):
    df = frame("k int, v int", [(1, 10), (1, 10), (1, 30), (2, 5)])
    assert rows(ranking.dense_number(df, ["k"], "v", "n"), "k", "v", "n") == [(1, 10, 1), (1, 10, 1), (1, 30, 2), (2, 5, 1)]


def test_numbered_rows_meet_only_the_small_shifts(frame):
    df = frame("k string, v int, wide string", [("a", i % 7, "x") for i in range(50)])
    plan = ranking.number_rows(df, ["k"], [F.col("v")], "n")._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Join") == 1
    assert "BroadcastHashJoin" in plan.executedPlan().toString()


def test_only_large_groups_are_dealt_in_slices(frame, rows, monkeypatch):
    rnd = random.Random(9)
    data = [("hot" if i % 3 else None if i % 5 else f"k{i}", rnd.choice([None, *range(50)]), i) for i in range(300)]
    df = frame("k string, v int, id int", data)
    order, columns = [F.col("v").desc_nulls_last(), F.col("id")], ["k", "v", "id", "n"]
    dealt, slices = [], ranking._number_by_slices
    monkeypatch.setattr(ranking, "_number_by_slices", lambda part, *a: dealt.append({k for k, in part.select("k").distinct().collect()}) or slices(part, *a))
    plain = rows(ranking.number_rows(df, ["k"], order, "n", bounded=True), *columns)
    assert rows(ranking.number_small_groups(df, ["k"], order, "n"), *columns) == plain and not dealt
    assert rows(ranking.number_small_groups(df, ["k"], order, "n", most=100), *columns) == plain and dealt == [{"hot"}]


def test_waits_of_usual_requests_are_not_dealt_in_slices(frame, rows, monkeypatch):
    monkeypatch.setattr(ranking, "_number_by_slices", lambda *a: pytest.fail("dealt in slices"))
    profile = frame("server_id int, collection_time timestamp, session_id int, request_id int, wait_type string, num_waits bigint, block_text string", [
        (1, None, 7, 0, "A", 2, None), (1, None, 7, 0, "B", 5, None), (1, None, 7, 0, "C", 1, "keylock"), (1, None, 8, 0, None, None, None),
    ])
    assert rows(waits.rank_waits(profile), "session_id", "wait_type", "wait_rank") == [(7, "A", 3), (7, "B", 2), (7, "C", 1), (8, None, 1)]


def test_join_in_place_is_a_null_safe_left_join(frame, rows):
    left = frame("k int, n string, x string", [(1, "a", "r1"), (1, "a", "r1"), (1, None, "r2"), (None, None, "r3"), (2, "b", "r4")])
    right = frame("k bigint, n string, v int, w string", [(1, "a", 1, "p"), (1, "a", 2, None), (1, None, 3, "q"), (None, None, None, None), (None, None, 4, "s"), (9, "z", 5, "t")])
    found = ranking.join_in_place(left, right, ["k", "n"])
    plain = ranking.null_safe_join(left, right, ["k", "n"], "left")
    assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in plain.schema]
    assert rows(found, *found.columns) == rows(plain, *plain.columns) and found.count() == 8


def test_join_in_place_leaves_dealt_rows_where_they_are(frame):
    left = freeze_dealt(frame("k int, n string, x string", [(i % 5, "a", "x") for i in range(50)]), "k")
    right = freeze_dealt(frame("k int, n string, v int", [(i, "a", i) for i in range(5)]), "k")
    assert "Exchange" not in ranking.join_in_place(left, right, ["n", "k"])._jdf.queryExecution().executedPlan().toString()


def test_packed_rows_are_numbered_as_others(frame, rows, monkeypatch):
    """Packs of a few rows each; names that two objects share and null keys mix in one order, and equal rows stay apart."""
    monkeypatch.setattr(ranking, "PACK_ROWS", 7)
    rnd = random.Random(3)
    data = [(rnd.choice([1, 2, None]), rnd.choice(["a", "b", None]), rnd.randrange(4), i % 90) for i in range(300)]
    df = frame("k int, name string, object_id int, v int", data)
    order = [F.col("name").asc_nulls_first(), F.col("v")]
    plain = ranking.number_rows(df, ["k"], order, "n", bounded=True)
    packed = ranking.number_rows(df, ["k"], order, "n", False, ["k", "name", "object_id"], 1)
    assert packed.columns == plain.columns
    assert rows(packed, "k", "name", "v", "n") == rows(plain, "k", "name", "v", "n")
    assert rows(packed, "k", "name", "object_id", "v") == rows(df, "k", "name", "object_id", "v")


def test_packs_hold_a_bounded_number_of_rows(frame, monkeypatch):
    monkeypatch.setattr(ranking, "PACK_ROWS", 7)
    sizes = [len(r["_rows"]) for r in ranking._pack(frame("k int, v int", [(1, i) for i in range(100)]), ["k"]).collect()]
    assert sum(sizes) == 100 and max(sizes) <= 7
