"""Wait-for graph: blocked counts, blocker closure and block leaders.

Edges point from a blocked session to its blocker. Walks use pointer doubling: after round
``k`` every live pointer spans ``2**k`` edges, so the rounds are logarithmic in the longest
chain. Every table has at most a row per session or edge; no pairs of a session and what is
above or below it are listed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.keys import K
from fleetscope.operators.ranking import spread_group_value
from fleetscope.runtime import cut_lineage

# Groups of up to so many edges, hence at most 62 sessions, are worked out in one row; a set of them is a 64-bit number.
SMALL_GROUP = 31


def block_edges(sessions: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Distinct (session, blocker) edges between collected sessions; no self edges."""
    nodes = sessions.select(*keys, F.col("session_id").alias("blocker")).distinct()
    return (
        sessions.select(*keys, "session_id", F.col("blocking_session_id").alias("blocker"))
        .filter("blocker is not null and blocker <> 0 and blocker <> session_id")
        .distinct()
        .join(nodes, [*keys, "blocker"], "left_semi")
    )


def lifting_levels(
    main: DataFrame, keys: Sequence[str], node: str, target: str, nodes: int, starts: DataFrame | None = None
) -> list[DataFrame]:
    """Jump tables of a graph in which each node has one target: table ``k`` leads ``2**k`` edges ahead.

    A table has a row per node that has so long a way before it, never more than the graph;
    there is none beyond the longest way, or, with cycles, beyond ``nodes``. With ``starts``
    the ways from these alone are asked for: a table then keeps the starts and where its own
    jumps lead, as no way comes to another node by such jumps. Ways that meet make these
    ever fewer; once that ends, the rows stay as they are.
    """
    at, first = [*keys, node], main.select(*keys, node, target)
    levels, rows, shrinks = [], main.count(), starts is not None
    while rows:
        if shrinks:
            landing = first.select(*keys, F.col(target).alias(node)).union(starts.select(*at)).distinct()
            first = cut_lineage(first.join(landing, at, "left_semi"))
            left = first.count()
            shrinks, rows = left < 0.8 * rows, left
        levels.append(first)
        if 2 ** len(levels) > nodes:
            break
        onward = first.select(*keys, F.col(node).alias(target), F.col(target).alias("_beyond"))
        first = cut_lineage(first.join(onward, [*keys, target]).select(*at, F.col("_beyond").alias(target)))
        rows = first.count()
    return levels


def _mark(starts: DataFrame, levels: list[DataFrame], keys: Sequence[str], node: str, target: str) -> DataFrame:
    """All nodes on the ways from ``starts``: from the longest jump down, each marked node marks where it leads."""
    marked = starts
    for k, level in enumerate(reversed(levels), 1):
        ends = F.explode(F.array_compact(F.array(node, target))).alias(node)
        marked = marked.join(level, [*keys, node], "left").select(*keys, ends).distinct()
        if k % 4 == 0:
            marked = cut_lineage(marked)
    return marked


def reachable(edges: DataFrame, starts: DataFrame, keys: Sequence[str], node: str, target: str) -> DataFrame:
    """Nodes reachable from ``starts`` (included) along ``edges``, cycles allowed.

    Each node's lowest target makes the main edges; their jump tables mark whole ways in a
    logarithmic number of joins. Side edges, where a node has several targets, start the
    next pass, from nodes not marked before; passes are as many as side edges on a way.
    """
    at = [*keys, node]
    found = cut_lineage(starts.select(*at).distinct())
    if found.isEmpty():
        return found
    main = cut_lineage(edges.groupBy(*at).agg(F.min(target).alias(target), F.max(target).alias("_last")))
    by_group = main.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("_last") > F.col(target)).alias("several"))
    most, several = by_group.agg(F.max("n"), F.max("several")).first()
    if not most:
        return found
    if not several:
        return cut_lineage(_mark(found, lifting_levels(main, keys, node, target, most, found), keys, node, target))
    levels = lifting_levels(main, keys, node, target, most)
    side = edges.join(main.filter(F.col("_last") > F.col(target)).withColumnRenamed(target, "_main"), at)
    side = cut_lineage(side.filter(F.col(target) > F.col("_main")).select(*at, target).distinct())
    fresh, known = found, None
    while not fresh.isEmpty():
        marked = _mark(fresh, levels, keys, node, target)
        fresh = cut_lineage(marked if known is None else marked.join(known, at, "left_anti"))
        known = fresh if known is None else cut_lineage(known.unionByName(fresh))
        onward = fresh.join(side, at).select(*keys, F.col(target).alias(node)).distinct()
        fresh = cut_lineage(onward.join(known, at, "left_anti"))
    return known


def blocker_closure(filtered: DataFrame, everything: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Filtered sessions plus all sessions that block them, directly or through others.

    ``is_added`` marks sessions the filter had dropped. A way to one of them ends with a step
    from a chosen session and then leads through dropped ones, so only these are walked.
    """
    at = [*keys, "session_id"]
    chosen = filtered.select(*at).distinct()
    edges = block_edges(everything, keys).join(chosen.withColumnRenamed("session_id", "blocker"), [*keys, "blocker"], "left_anti")
    edges = cut_lineage(edges)
    starts = edges.join(chosen, at, "left_semi").select(*keys, F.col("blocker").alias("session_id"))
    extra = reachable(edges.join(chosen, at, "left_anti"), starts, keys, "session_id", "blocker")
    added = everything.join(extra, at, "left_semi")
    return filtered.withColumn("is_added", F.lit(False)).unionByName(added.withColumn("is_added", F.lit(True)))


def missing_blockers(filtered: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Blocker ids that are not among the collected sessions."""
    wanted = (
        filtered.filter("blocking_session_id is not null and blocking_session_id <> 0")
        .select(*keys, F.col("blocking_session_id").alias("session_id")).distinct()
    )
    return wanted.join(filtered.select(*keys, "session_id"), [*keys, "session_id"], "left_anti")


def blocking_chains(sessions: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Per session: sessions blocked below it on all levels, hops to its top blocker, and that blocker.

    A session counts once per chain that reaches it, which is once unless it waits for
    two blockers. Sessions that all wait for each other, in one cycle or several entangled
    ones, stand for one: each counts the others once and all that hang below them. Who has
    no top blocker above, as in and below a lone cycle, has no depth and no root (NULL).
    """
    at = [*keys, "session_id"]
    sized = cut_lineage(spread_group_value(block_edges(sessions, keys), keys, _n=F.count(F.lit(1))))
    linked = _small_group_counts(sized.filter(F.col("_n") <= SMALL_GROUP).drop("_n"), keys)
    large = sized.filter(F.col("_n") > SMALL_GROUP).drop("_n")
    if not large.isEmpty():
        linked = linked.unionByName(_large_group_counts(cut_lineage(large), keys))
    found = F.col("_linked").isNotNull()
    # Sessions without any edge stand alone.
    return (
        sessions.select(*at).distinct().join(linked.withColumn("_linked", F.lit(True)), at, "left").select(
            *at,
            F.coalesce("blocked_session_count", F.lit(0)).cast("bigint").alias("blocked_session_count"),
            F.when(found, F.col("depth")).otherwise(0).cast("bigint").alias("depth"),
            F.when(found, F.col("root")).otherwise(F.col("session_id")).alias("root_session_id"),
        )
    )


def _large_group_counts(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, depth and root of every session on an edge, by joins; groups may be of any size."""
    at = [*keys, "session_id"]
    shared = edges.groupBy(*at).count().filter("count > 1").select(*at)
    if shared.isEmpty():
        return _forest_counts(edges, keys)
    # Only the components in which a session waits for several blockers leave the doubling walk.
    labels = component_labels(edges, keys)
    tangled = labels.join(shared, at, "left_semi").select(*keys, "component").distinct()
    inside = cut_lineage(labels.join(tangled, [*keys, "component"], "left_semi").select(*at))
    plain = _forest_counts(cut_lineage(edges.join(inside, at, "left_anti")), keys)
    return plain.unionByName(_condensed_counts(cut_lineage(edges.join(inside, at, "left_semi")), keys))


def component_labels(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per session on an edge: the lowest session it is connected with, directions ignored (``component``).

    Star contraction: all neighbours of a session are pointed to the lowest of them, then each
    session's lower neighbours; rounds grow with the logarithm of the longest path, and
    each is a partial aggregate and a join.
    """
    def digest(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*keys, "a", "b"))).first())

    links = edges.select(*keys, F.greatest("session_id", "blocker").alias("a"), F.least("session_id", "blocker").alias("b"))
    links, before = cut_lineage(links.distinct()), None
    while before != (now := digest(links)):
        before = now
        both = links.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy(*keys, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        far = both.join(lowest, [*keys, "a"]).filter("b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = far.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        near = far.join(lowest, [*keys, "a"]).filter("b <> m").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut_lineage(near.unionByName(lowest.withColumnRenamed("m", "b")).distinct())
    lows = links.select(*keys, F.col("b").alias("session_id"), F.col("b").alias("component")).distinct()
    return links.select(*keys, F.col("a").alias("session_id"), F.col("b").alias("component")).unionByName(lows)


def descendant_counts(sessions: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Sessions on all levels below each block leader."""
    return block_leaders(blocking_chains(sessions, keys)).select(*keys, "session_id", "blocked_session_count")


def block_leaders(chains: DataFrame) -> DataFrame:
    """Sessions that block others and are not blocked themselves."""
    return chains.filter("depth = 0 and blocked_session_count > 0")


# ---- small groups --------------------------------------------------------------------


def _small_group_counts(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, depth and root of every session on an edge, for groups of at most ``SMALL_GROUP`` edges.

    A group is one row. Its sessions are numbered by id and a set of them is a number with
    a bit for each, so what a session waits for on all levels takes a pass over the group
    per session; then counts are added up from the lowest sessions, members of a cycle
    as one, and depths are given level by level from the top blockers.
    """
    groups = edges.groupBy(*keys).agg(F.collect_list(F.struct("session_id", "blocker")).alias("_edges"))
    steps = {
        "_ids": "array_sort(array_distinct(flatten(transform(_edges, e -> array(e.session_id, e.blocker)))))",
        "_places": "sequence(0, size(_ids) - 1)",
        "_arcs": "transform(_edges, e -> struct(CAST(array_position(_ids, e.session_id) - 1 AS INT) AS below, CAST(array_position(_ids, e.blocker) - 1 AS INT) AS above))",
        # Direct blockers, then all that are reached: by way of each session in turn.
        "_up": "transform(_places, i -> aggregate(_arcs, 0L, (m, e) -> IF(e.below = i, m | shiftleft(1L, e.above), m)))",
        "_all": "aggregate(_places, _up, (r, k) -> transform(r, m -> IF(getbit(m, k) = 1, m | r[k], m)))",
        # Sessions that wait for each other, as a set that holds the session itself, and the first of them.
        "_peers": "transform(_places, i -> aggregate(_places, shiftleft(1L, i), (m, j) -> IF(getbit(_all[i], j) = 1 AND getbit(_all[j], i) = 1, m | shiftleft(1L, j), m)))",
        "_first": "transform(_peers, p -> bit_count((p & -p) - 1))",
        # Who waits for another one reaches more than it.
        "_order": "transform(array_sort(transform(filter(_places, i -> _first[i] = i), i -> struct(-bit_count(_all[i] | shiftleft(1L, i)) AS reach, i AS place))), s -> s.place)",
        "_worth": """aggregate(_order, transform(_places, i -> 0L), (w, i) -> transform(w, (x, k) -> IF(k = i,
            aggregate(_arcs, CAST(bit_count(_peers[i]) AS BIGINT), (s, e) -> IF(_first[e.above] = i AND _first[e.below] <> i, s + w[_first[e.below]], s)), x)))""",
        "_tops": """aggregate(_places, transform(_up, (m, i) -> IF(m = 0, struct(0 AS depth, i AS root), NULL)),
            (t, k) -> transform(t, (x, i) -> IF(x IS NOT NULL, x, array_min(transform(
                filter(_arcs, e -> e.below = i AND t[e.above].depth = k), e -> struct(k + 1 AS depth, t[e.above].root AS root))))))""",
    }
    for name, step in steps.items():
        groups = groups.withColumn(name, F.expr(step))
    told = F.expr("""explode(transform(_places, i -> struct(
        _ids[i] AS session_id, _worth[_first[i]] - 1 AS blocked_session_count, CAST(_tops[i].depth AS BIGINT) AS depth, _ids[_tops[i].root] AS root)))""")
    return groups.select(*keys, told.alias("_told")).select(*keys, "_told.*")


# ---- one blocker per session ---------------------------------------------------------


def _forest_counts(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, depth and root of every session on an edge, each with one blocker at most.

    Sessions that block nobody, mostly nearly all, are only counted at their blockers; the
    walk is that of the others, and the first get their places from it.
    """
    at = [*keys, "session_id"]
    blockers = edges.select(*keys, F.col("blocker").alias("session_id")).distinct()
    leaves = edges.join(blockers, at, "left_anti")
    waiting = leaves.groupBy(*keys, F.col("blocker").alias("session_id")).agg(F.count(F.lit(1)).alias("size"))
    worth = blockers.join(waiting, at, "left").withColumn("size", F.coalesce("size", F.lit(0)) + 1)
    worth = cut_lineage(worth)
    inner = cut_lineage(_inner_counts(cut_lineage(edges.join(worth, at, "left_semi")), worth, keys))
    above = inner.select(*keys, F.col("session_id").alias("blocker"), "depth", "root")
    outer = leaves.join(above, [*keys, "blocker"]).select(
        *at, F.lit(0).cast("bigint").alias("blocked_session_count"), (F.col("depth") + 1).alias("depth"), "root"
    )
    return inner.unionByName(outer)


def _inner_counts(edges: DataFrame, worth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, depth and root of every session of ``worth``, which counts itself and who waits at its end.

    ``edges`` lead from these sessions to these sessions.
    """
    at = [*keys, "session_id"]
    linked = edges.select(*at).union(edges.select(*keys, "blocker"))
    lone = worth.join(linked, at, "left_anti").select(
        *at, (F.col("size") - 1).alias("blocked_session_count"), F.lit(0).cast("bigint").alias("depth"), F.col("session_id").alias("root")
    )
    if edges.isEmpty():
        return lone
    state, cyclic = _double(edges, worth, keys)
    top = F.col("top")
    places = state.select(
        *at, (F.col("size") - 1).alias("blocked_session_count"),
        F.when(top.isNull(), 0).when(~F.col("live"), F.col("span")).cast("bigint").alias("depth"),
        F.when(top.isNull(), F.col("session_id")).when(~F.col("live"), top).alias("root"),
    )
    if cyclic is None:
        return places.unionByName(lone)
    # Cycle members become roots: count the trees below them, then pool each cycle.
    members = cut_lineage(cyclic)
    trees, _ = _double(edges.join(members, at, "left_anti"), worth, keys)
    sizes = trees.select(*at, "size")
    labels = _ring_labels(edges.join(members, at, "left_semi"), keys)
    alone = worth.join(members, at, "left_semi").join(sizes, at, "left_anti")
    pooled = labels.join(sizes.unionByName(alone), at).groupBy(*keys, "label").agg(F.sum("size").alias("total"))
    ring_sizes = labels.join(pooled, [*keys, "label"]).select(*at, F.col("total").alias("size"))
    sizes = sizes.join(members, at, "left_anti").unionByName(ring_sizes)
    counts = sizes.select(*at, (F.col("size") - 1).alias("blocked_session_count"))
    return places.drop("blocked_session_count").join(counts, at).unionByName(lone)


def _double(edges: DataFrame, worth: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Subtree size and final jump per node, and the cycle members if the walk never ends.

    A node counts as its ``size`` in ``worth``.

    ``top`` is the node ``span`` hops up; ``live`` says it is exactly ``2**k`` hops away
    and may have a blocker of its own.
    """
    at = [*keys, "session_id"]
    blocked = edges.select(*at, F.col("blocker").alias("top"))
    roots = edges.select(*keys, F.col("blocker").alias("session_id")).distinct().join(blocked, at, "left_anti")
    one = F.lit(1).cast("bigint")
    state = blocked.withColumn("live", F.lit(True)).unionByName(
        roots.withColumns({"top": F.lit(None).cast(blocked.schema["top"].dataType), "live": F.lit(False)})
    ).withColumn("span", one).join(worth, at)
    stuck = landed = None
    while True:
        # Whatever sits exactly 2**k below a node brings the nodes less than 2**k below itself.
        below = state.filter("live").groupBy(*keys, F.col("top").alias("session_id")).agg(F.sum("size").alias("_more"))
        onward = state.filter("top is not null").select(
            *keys, F.col("session_id").alias("top"), F.col("top").alias("_top"),
            F.col("span").alias("_span"), F.col("live").alias("_live"),
        )
        moves = F.col("live") & F.col("_top").isNotNull()
        state = cut_lineage(
            state.join(below, at, "left").join(onward, [*keys, "top"], "left").select(
                *at,
                F.when(moves, F.col("_top")).otherwise(F.col("top")).alias("top"),
                F.when(moves, F.col("span") + F.col("_span")).otherwise(F.col("span")).alias("span"),
                (moves & F.col("_live")).alias("live"),
                (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"),
            )
        )
        live = state.filter("live").count()
        if live == 0:
            return state, None
        if live == stuck:
            # Only sessions in or below a cycle are left; wait until every jump lands on one.
            images = state.filter("live").select(*keys, F.col("top").alias("session_id")).distinct()
            width = images.count()
            if width == landed:
                return state, images
            landed = width
        stuck = live


def _ring_labels(ring: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lowest member of each cycle, for every member."""
    at = [*keys, "session_id"]
    state = ring.select(*at, F.col("blocker").alias("hop"), F.col("session_id").alias("label"))
    while True:
        onward = state.select(
            *keys, F.col("session_id").alias("hop"), F.col("hop").alias("_hop"), F.col("label").alias("_label")
        )
        moved = cut_lineage(
            state.join(onward, [*keys, "hop"]).select(
                *at, F.col("_hop").alias("hop"), F.least("label", "_label").alias("label"),
                (F.col("_label") < F.col("label")).alias("changed"),
            )
        )
        state = moved.drop("changed")
        if moved.filter("changed").isEmpty():
            return state.select(*at, "label")


# ---- several blockers per session ----------------------------------------------------


def strong_components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per session on an edge: ``strong``, one of the sessions that wait for it and that it waits for, or itself.

    In each pass sessions get random ranks. The least rank spreads forward and backward along
    the edges until nothing changes; where a session got the same from both sides, it lies on
    cycles with the session of that rank and is settled. Edges between sessions that got
    different ranks lie on no cycle and go, so the pieces left shrink like those of a quicksort:
    passes are logarithmic in the sessions. Within a pass ranks also travel along jumps of
    doubled length on each session's lowest blocker, so long chains take few rounds.
    """
    at = [*keys, "session_id"]
    ends = edges.select(*at).union(edges.select(*keys, "blocker")).distinct()
    left, open_, done, seed = edges.select(*at, "blocker"), cut_lineage(ends), None, 0
    while not open_.isEmpty():
        seed += 1
        state = cut_lineage(_spread_ranks(open_, left, keys, seed))
        settled = state.filter("ahead = behind").select(*at, F.col("ahead.id").alias("strong"))
        done = cut_lineage(settled if done is None else done.unionByName(settled))
        rest = state.filter("ahead <> behind")
        open_ = cut_lineage(rest.select(*at))
        mine = rest.select(*at, "ahead", "behind")
        other = rest.select(*keys, F.col("session_id").alias("blocker"), F.col("ahead").alias("_ahead"), F.col("behind").alias("_behind"))
        same = (F.col("ahead") == F.col("_ahead")) & (F.col("behind") == F.col("_behind"))
        left = cut_lineage(left.join(mine, at).join(other, [*keys, "blocker"]).filter(same).select(*at, "blocker"))
    return done


def _spread_ranks(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """``nodes`` with the least rank among those that reach them (``behind``) and that they reach (``ahead``)."""
    at = [*keys, "session_id"]
    rank = F.struct(F.xxhash64("session_id", F.lit(seed)).alias("rank"), F.col("session_id").alias("id"))
    main = cut_lineage(edges.groupBy(*at).agg(F.min("blocker").alias("jump")))
    first = nodes.join(main, at, "left").withColumns({"ahead": rank, "behind": rank})
    state, rounds, until = cut_lineage(first), 0, nodes.count().bit_length()
    none = F.lit(None).cast(state.schema["ahead"].dataType)
    while True:
        rounds += 1
        above = lambda name: state.select(*keys, F.col("session_id").alias(name), F.col("ahead").alias("_ahead"), F.col("jump").alias("_jump"))
        hops = state.filter("jump is not null").select(*at, "jump", "behind").join(above("jump"), [*keys, "jump"], "left")
        told = (
            edges.join(state.select(*at, "behind"), at).select(*keys, F.col("blocker").alias("session_id"), none.alias("a"), F.col("behind").alias("b"))
            .unionByName(edges.join(above("blocker"), [*keys, "blocker"]).select(*at, F.col("_ahead").alias("a"), none.alias("b")))
            .unionByName(hops.select(*keys, F.col("jump").alias("session_id"), none.alias("a"), F.col("behind").alias("b")))
            .unionByName(hops.select(*at, F.col("_ahead").alias("a"), none.alias("b")))
        )
        least = told.groupBy(*at).agg(F.min("a").alias("a"), F.min("b").alias("b"))
        # Jumps that left the chain start anew, for ranks that came in by a side edge.
        again = main if rounds % until == 0 else hops.select(*at, F.col("_jump").alias("jump"))
        moved = cut_lineage(
            state.drop("jump").join(least, at, "left").join(again, at, "left").select(
                *at, "jump", F.least("ahead", "a").alias("ahead"), F.least("behind", "b").alias("behind"),
                (F.coalesce(F.col("a") < F.col("ahead"), F.lit(False)) | F.coalesce(F.col("b") < F.col("behind"), F.lit(False))).alias("_changed"),
            )
        )
        state = moved.drop("_changed")
        if moved.filter("_changed").isEmpty():
            return state.drop("jump")


def _condensed_counts(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, depth and root of sessions with several blockers, cycles included.

    ``worth`` of a session is itself and what is known to hang below it; an edge counts the
    worth of its session ``times`` over. Free ends (nobody waits for them) hand their worth
    up and go. What is not gone after a few rounds has long chains or cycles: the members of
    a cycle become one session, once, and from then on chains of sessions for which just one
    waits are bypassed now and then. Bypassed sessions and members are worked out at the
    end, last ones first.
    """
    at = [*keys, "session_id"]
    ends = edges.select(*at).union(edges.select(*keys, "blocker")).distinct()
    left = cut_lineage(edges.select(*at, "blocker", F.lit(1).cast("bigint").alias("times")))
    worth = cut_lineage(ends.withColumn("worth", F.lit(1).cast("bigint")))
    later: list[DataFrame] = []  # (session, blocked one it depends on, add, factor)
    rounds, acyclic = 0, False
    while not left.isEmpty():
        rounds += 1
        waited_for = left.select(*keys, F.col("blocker").alias("session_id")).distinct()
        free = left.join(waited_for, at, "left_anti")
        gained = free.join(worth, at).groupBy(*keys, F.col("blocker").alias("session_id")).agg(F.sum(F.col("worth") * F.col("times")).alias("more"))
        gained = cut_lineage(gained)
        stuck = gained.isEmpty()
        if not stuck:
            worth = _add_worth(worth, gained, keys)
            left = cut_lineage(left.join(waited_for, at, "left_semi"))
        if (stuck or rounds % 4 == 0) and not left.isEmpty():
            if not acyclic:
                left, worth, members = _merge_cycles(left, worth, keys)
                later.append(members)
                acyclic = True
            left, worth, bypassed = _bypass(left, worth, keys)
            later.append(bypassed)
    for one in reversed(later):
        known = worth.select(*keys, F.col("session_id").alias("below"), "worth")
        found = one.join(known, [*keys, "below"]).select(*at, (F.col("add") + F.col("factor") * F.col("worth")).alias("worth"))
        worth = cut_lineage(worth.join(one, at, "left_anti").unionByName(found))
    counts = worth.select(*at, (F.col("worth") - 1).alias("blocked_session_count"))
    return counts.join(_shortest_tops(edges, keys), at, "left")


def _add_worth(worth: DataFrame, gained: DataFrame, keys: Sequence[str]) -> DataFrame:
    at = [*keys, "session_id"]
    return cut_lineage(worth.join(gained, at, "left").select(*at, (F.col("worth") + F.coalesce("more", F.lit(0))).alias("worth")))


def _merge_cycles(left: DataFrame, worth: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of a cycle, or of entangled ones, become the session that names them."""
    at = [*keys, "session_id"]
    labels = strong_components(left, keys)
    merged = labels.filter("strong <> session_id").select(*at, F.col("strong").alias("below"))
    members = cut_lineage(merged.withColumns({"add": F.lit(0).cast("bigint"), "factor": F.lit(1).cast("bigint")}))
    pooled = worth.join(members, at).groupBy(*keys, F.col("below").alias("session_id")).agg(F.sum("worth").alias("more"))
    of_blocker = labels.select(*keys, F.col("session_id").alias("blocker"), F.col("strong").alias("_blocker"))
    between = left.join(labels, at).join(of_blocker, [*keys, "blocker"]).filter("strong <> _blocker")
    between = between.groupBy(*keys, F.col("strong").alias("session_id"), F.col("_blocker").alias("blocker")).agg(F.sum("times").alias("times"))
    return cut_lineage(between.select(*at, "blocker", "times")), _add_worth(worth, pooled, keys), members


def _bypass(left: DataFrame, worth: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions for which just one other waits are left out: who they wait for takes the end of their chain instead.

    There are no cycles any more: a bypassed session on one would count itself.
    """
    at = [*keys, "session_id"]
    chain = left.groupBy(*keys, F.col("blocker").alias("session_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min("session_id").alias("below"), F.min("times").alias("factor")
    )
    chain = chain.filter("n = 1").join(worth, at).select(*at, "below", F.col("worth").alias("add"), "factor")
    chain = cut_lineage(chain)
    for _ in range(chain.count().bit_length()):
        onward = chain.select(*keys, F.col("session_id").alias("below"), F.col("below").alias("_below"), F.col("add").alias("_add"), F.col("factor").alias("_factor"))
        longer = F.col("_below").isNotNull()
        chain = cut_lineage(chain.join(onward, [*keys, "below"], "left").select(
            *at, F.coalesce("_below", "below").alias("below"),
            F.when(longer, F.col("add") + F.col("factor") * F.col("_add")).otherwise(F.col("add")).alias("add"),
            F.when(longer, F.col("factor") * F.col("_factor")).otherwise(F.col("factor")).alias("factor"), longer.alias("_moved"),
        ))
        if chain.filter("_moved").isEmpty():
            chain = chain.drop("_moved")
            break
        chain = chain.drop("_moved")
    gone = chain
    kept = left.join(gone.select(*keys, F.col("session_id").alias("blocker")), [*keys, "blocker"], "left_anti")
    plain = kept.join(gone.select(*at), at, "left_anti")
    over = cut_lineage(kept.join(gone, at).select(*keys, "blocker", "below", (F.col("times") * F.col("add")).alias("more"), (F.col("times") * F.col("factor")).alias("times")))
    gained = over.groupBy(*keys, F.col("blocker").alias("session_id")).agg(F.sum("more").alias("more"))
    new = over.select(*keys, F.col("below").alias("session_id"), "blocker", "times")
    joined = plain.select(*at, "blocker", "times").unionByName(new).groupBy(*at, "blocker").agg(F.sum("times").alias("times"))
    return cut_lineage(joined), _add_worth(worth, gained, keys), gone


def _shortest_tops(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fewest hops to a top blocker, and the lowest such blocker."""
    at = [*keys, "session_id"]
    blocked = edges.select(*at).distinct()
    roots = edges.select(*keys, F.col("blocker").alias("session_id")).distinct().join(blocked, at, "left_anti")
    layer = roots.select(*at, F.col("session_id").alias("root"))
    done = layer.select(*at, F.lit(0).cast("bigint").alias("depth"), "root")
    depth = 0
    while True:
        depth += 1
        above = layer.select(*keys, F.col("session_id").alias("blocker"), "root")
        layer = cut_lineage(
            edges.join(above, [*keys, "blocker"]).groupBy(*at).agg(F.min("root").alias("root"))
            .join(done, at, "left_anti")
        )
        if layer.isEmpty():
            return done
        done = cut_lineage(done.unionByName(layer.select(*at, F.lit(depth).cast("bigint").alias("depth"), "root")))
