"""Operators on small graphs with known answers."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwell.functions import predicates as P
from arcwell.operators import centrality, communities, deltas, documents, flow, history, moving, planning, pregel, routes, structure, twin
from arcwell.plans.model import EdgeType, GraphModel, NodeType, Property, SchemaMismatch
from arcwell.plans.query import Edges, Graph, NO_REVISIT, Path
from arcwell.plans.registry import ProjectionCache, Registry, standard
from arcwell.scratch import cut, shared_dir
from arcwell.streaming.feed import LiveGraph, OutOfOrder, TwinSynchronizer, follow


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def edges(spark, *pairs, **props):
    rows = [(i, a, b, *[v[i - 1] for v in props.values()]) for i, (a, b) in enumerate(pairs, 1)]
    return spark.createDataFrame(rows, "id long, from_id long, to_id long" + "".join(f", {k} double" for k in props))


def table(df, *cols):
    return {r[cols[0]]: tuple(r[c] for c in cols[1:]) if len(cols) > 2 else r[cols[1]] for r in df.collect()}


def test_pagerank_ranks_the_hub_first_and_sums_to_one(spark):
    r = centrality.ranked(centrality.pagerank(nodes(spark, 1, 2, 3), edges(spark, (1, 2), (3, 2)))).orderBy("rank").collect()
    assert r[0]["id"] == 2 and abs(sum(x["score"] for x in r) - 1) < 1e-9 and [x["rank"] for x in r] == [0, 1, 2]


def test_degree_and_incremental_degree(spark):
    n, e = nodes(spark, 1, 2, 3), edges(spark, (1, 2), (2, 3), (2, 1))
    assert table(centrality.degree(n, e), "id", "in_degree", "out_degree", "score")[2] == (1, 2, 0.75)
    delta = spark.createDataFrame([("add", "edge", 9, 3, 1)], "op string, kind string, id long, from_id long, to_id long")
    n2, e2, affected = deltas.apply_delta(n, e, delta)
    want = table(centrality.degree(n2, e2), "id", "in_degree", "out_degree", "score")
    assert table(centrality.incremental_degree(centrality.degree(n, e), n2, e2, affected), "id", "in_degree", "out_degree", "score") == want


def test_components(spark):
    n, e = nodes(spark, 1, 2, 3, 4, 5), edges(spark, (1, 2), (2, 1), (2, 3), (3, 4), (4, 3))
    weak = structure.weak_components(n, e)
    assert [(r["component"], r["size"]) for r in structure.component_sizes(weak).orderBy("position").collect()] == [(1, 4), (5, 1)]
    assert table(structure.strong_components(n, e), "id", "component") == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_weak_components_of_a_long_path(spark):
    n = 60
    found = structure.weak_components(nodes(spark, *range(n)), edges(spark, *[(i, i + 1) for i in range(n - 1)]))
    assert set(table(found, "id", "component").values()) == {0}


def test_strong_components_of_a_long_path_and_a_random_graph(spark):
    n = 200
    found = structure.strong_components(nodes(spark, *range(n)), edges(spark, *[(i, i + 1) for i in range(n - 1)]), limit=20)
    assert table(found, "id", "component") == {i: i for i in range(n)}
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 40, (60, 2))]
    reach = np.eye(40, dtype=bool)
    for a, b in pairs:
        reach[a, b] = True
    for k in range(40):
        reach |= reach[:, k : k + 1] & reach[k]
    want = {i: min(j for j in range(40) if reach[i, j] and reach[j, i]) for i in range(40)}
    assert table(structure.strong_components(nodes(spark, *range(40)), edges(spark, *pairs)), "id", "component") == want


def test_cycles_with_a_self_loop_and_parallel_edges(spark):
    found, more = structure.cycles(nodes(spark, 1, 2, 3), edges(spark, (1, 2), (2, 1), (3, 3), (1, 2)))
    assert sorted(len(r["path"]) for r in found.collect()) == [1, 2, 2] and not more
    _, more = structure.cycles(nodes(spark, 1, 2, 3), edges(spark, (1, 2), (2, 1), (3, 3)), max_cycles=1)
    assert more


def test_routes(spark):
    e = edges(spark, (0, 1), (1, 2), (0, 3), (3, 2), cost=[1.0, 1.0, 0.5, 10.0])
    assert routes.shortest_path(e, 0, 2, "cost") == ([0, 1, 2], 2.0)
    assert routes.shortest_path(e, 2, 0, "cost") == (None, math.inf)
    assert routes.shortest_path(e, 1, 1, "cost") == ([1], 0.0)
    assert table(routes.shortest_costs(e, nodes(spark, 0), "cost"), "id", "cost") == {0: 0.0, 1: 1.0, 2: 2.0, 3: 0.5}
    k = routes.k_shortest(e, 0, 2, 5, "cost").orderBy("rank").collect()
    assert [(r["path"], r["cost"]) for r in k] == [([0, 1, 2], 2.0), ([0, 3, 2], 10.5)]
    i = routes.impact_reroute(e, 0, 2, [1], [], weight="cost").collect()
    assert [(r["cost_delta"], r["hop_delta"]) for r in i] == [(8.5, 0)]
    with pytest.raises(ValueError):
        routes.shortest_costs(edges(spark, (0, 1), cost=[-1.0]), nodes(spark, 0), "cost")


@pytest.mark.parametrize("local", [0, routes.LOCAL])
def test_routes_of_any_length_are_brute_force(spark, local):
    """The k cheapest and the unbeaten routes among all loopless ones, on a graph whose routes have up to nine edges."""
    rng = np.random.default_rng(4)
    pairs = [(i, i + 1) for i in range(9)] + [(int(a), int(b)) for a, b in rng.integers(0, 10, (14, 2)) if a != b] + [(2, 3)]
    cost, risk = ([float(x) for x in rng.integers(1, 9, len(pairs))] for _ in range(2))
    e = edges(spark, *pairs, cost=cost, risk=risk)
    every, stack = [], [((0,), 0.0, 0.0)]
    while stack:
        path, c, r = stack.pop()
        if path[-1] == 9:
            every.append((c, len(path) - 1, ",".join(map(str, path)), r))
            continue
        stack += [((*path, b), c + x, r + y) for (a, b), x, y in zip(pairs, cost, risk) if a == path[-1] and b not in path]
    best = {}
    for c, n, text, _ in every:
        best[text] = min(best.get(text, (c, n, text)), (c, n, text))
    want = sorted(best.values())
    for k in (1, 4, len(want) + 1):
        got = routes.k_shortest(e, 0, 9, k, "cost", local=local).orderBy("rank").collect()
        assert [(r["cost"], len(r["path"]) - 1, ",".join(map(str, r["path"]))) for r in got] == want[:k] and all(r["exhausted"] == (k > len(want)) for r in got)
    assert routes.shortest_path(e, 0, 9, "cost", local=local)[1] == want[0][0] and max(n for _, n, _ in want) > 5
    points = {(c, r) for c, _, _, r in every}
    best = {p for p in points if not any(q != p and q[0] <= p[0] and q[1] <= p[1] for q in points)}
    got = routes.pareto_routes(e, 0, 9, ("cost", "risk"), limit=None, local=local).collect()
    assert {(r["cost"], r["risk"]) for r in got} == best and not got[0]["truncated"]
    assert all(r["path"] == min(t for c, _, t, x in every if (c, x) == (r["cost"], r["risk"])) for r in got)
    assert routes.pareto_routes(e, 0, 9, ("cost", "risk"), max_labels=3, local=local).filter("not truncated").isEmpty()


def test_pareto_keeps_what_nothing_beats(spark):
    e = edges(spark, (0, 1), (1, 2), (0, 3), (3, 2), (0, 2), cost=[1.0, 1.0, 2.0, 2.0, 9.0], risk=[5.0, 5.0, 6.0, 6.0, 1.0])
    assert {r["path"] for r in routes.pareto_routes(e, 0, 2, ("cost", "risk")).collect()} == {"0,1,2", "0,2"}


def test_betweenness(spark):
    assert table(centrality.betweenness(nodes(spark, 1, 2, 3), edges(spark, (1, 2), (2, 3))), "id", "score", "normalised")[2] == (1.0, 0.5)
    diamond = edges(spark, (1, 2), (1, 3), (2, 4), (3, 4))
    assert table(centrality.betweenness(nodes(spark, 1, 2, 3, 4), diamond), "id", "score")[2] == 0.5


def test_flow(spark):
    f = flow.maximum_flow(edges(spark, (0, 1), (1, 9), (0, 2), (2, 9), cap=[3.0, 2.0, 2.0, 4.0]), 0, 9, "cap")
    assert f.value == 4.0 and f.cut_capacity == 4.0


def test_critical_path(spark):
    n = spark.createDataFrame([(1, 3.0), (2, 5.0), (3, 2.0), (4, 4.0)], "id long, d double")
    e = edges(spark, (1, 2), (1, 3), (2, 4), (3, 4), lag=[0.0, 0.0, 0.0, 1.0])
    t = table(planning.critical_path(n, e, "d", "lag"), "id", "earliest_finish", "slack", "critical")
    assert t[4] == (12.0, 0.0, True) and t[3] == (5.0, 2.0, False)
    with pytest.raises(ValueError):
        planning.critical_path(n, edges(spark, (1, 2), (2, 1)), "d")


def test_communities_are_connected_and_better_than_singletons(spark):
    pairs = [(a, b) for g in ((1, 2, 3, 4), (5, 6, 7, 8)) for a in g for b in g if a < b] + [(4, 5)]
    n, e = nodes(spark, *range(1, 9)), edges(spark, *pairs)
    c = communities.communities(n, e)
    assert table(c, "id", "community") == {i: 0 if i < 5 else 1 for i in range(1, 9)}
    assert communities.modularity(c, e).first()[0] > communities.modularity(n.select("id", F.col("id").alias("community")), e).first()[0]
    m = {r["community"]: r for r in communities.community_metrics(c, e).collect()}
    assert m[0]["boundary"] == 1.0 and m[0]["bridge_nodes"] == 1


def test_communities_of_more_edges_than_the_driver_takes(spark, monkeypatch):
    rng = random.Random(5)
    planted = {v: v % 6 for v in range(-60, 60)}
    pairs = sorted({(a, b) for a in planted for b in planted if a != b and rng.random() < (0.4 if planted[a] == planted[b] else 0.02)})
    n, e = nodes(spark, *planted, 1000), edges(spark, *pairs, (7, 7), weight=[1.0] * len(pairs) + [2.0])
    alone = communities.communities(n, e, "weight")
    for limit in ("MAX_EDGES", "DRIVER_EDGES"):
        monkeypatch.setattr(communities, limit, 10, raising=False)
    got = communities.communities(n, e, "weight")
    c = table(got, "id", "community")
    assert c == table(alone, "id", "community") == {**{v: (v + 60) % 6 for v in planted}, 1000: 6}
    assert c == table(communities.communities(n, e, "weight"), "id", "community")
    with pytest.raises(Exception, match="no node"):
        communities.communities(n, edges(spark, (1, 2), (3, 5000)))


def test_parts_without_a_link_are_communities_of_their_own(spark):
    links = moving.cut(moving._links(spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0), (3, 4, 1.0)], "a int, b int, w double")).coalesce(1).sortWithinPartitions("v"))
    assert moving._connected(spark, links, np.array([0, 0, 0, 0, 4], np.int32)).tolist() == [0, 0, 2, 2, 4]


def test_link_prediction(spark):
    p = communities.predict_links(nodes(spark, 1, 2, 3, 4), edges(spark, (1, 3), (2, 3), (1, 4), (2, 4))).collect()
    assert [(r["a"], r["b"], r["common"]) for r in p] == [(1, 2, 2), (3, 4, 2)]


def test_directed_link_prediction_scopes_and_limits(spark):
    n, e = nodes(spark, 1, 2, 3, 4), edges(spark, (1, 2), (2, 3), (2, 4), (1, 4))
    got = communities.predict_links(n, e, directed=True).collect()
    assert [(r["a"], r["b"], r["common"], r["jaccard"]) for r in got] == [(1, 3, 1, 0.5)]
    members = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "id long, community long")
    assert communities.predict_links(n, e, members, directed=True, scope="same").isEmpty()
    assert communities.predict_links(n, e, members, directed=True, scope="across").count() == 1
    with pytest.raises(communities.CandidateLimit):
        communities.predict_links(n, e, max_pairs=0)


def _all_links(n, pairs, members, directed, scope, weights=(1.0, 1.5, 1.5, 0.25, 1.0)):
    """Each pair compared with each: (a, b, common, confidence) in order."""
    out = {v: set() for v in n}
    into = {v: set() for v in n}
    for a, b in pairs:
        for x, y in [(a, b)] if directed else [(a, b), (b, a)]:
            out[x].add(y)
            into[y].add(x)
    found = []
    for a in n:
        for b in n:
            common = out[a] & into[b]
            same = float(members.get(a) is not None and members.get(a) == members.get(b))
            if (a != b if directed else a < b) and common and b not in out[a] and (scope == "all" or same == (scope == "same")):
                degree = [len(out[m]) + len(into[m]) if directed else len(out[m]) for m in common]
                found.append((a, b, (len(common), len(common) / (len(out[a]) + len(into[b]) - len(common)), sum(1 / math.log(d) for d in degree if d > 1), len(out[a]) * len(into[b]), same)))
    tops = [max((f[2][i] for f in found), default=0) for i in range(5)]
    score = lambda f: round(sum(w * x / t for w, x, t in zip(weights, f[2], tops, strict=True) if t) / sum(weights), 9)
    return sorted(((a, b, m[0], score((a, b, m))) for a, b, m in found), key=lambda r: (-r[3], r[0], r[1]))


@pytest.mark.parametrize("directed, scope", [(False, "all"), (False, "across"), (True, "all"), (True, "same")])
def test_link_prediction_is_brute_force(spark, directed, scope):
    rng = random.Random(11)
    ids = range(40)
    # Leaves of a few hubs are alike; some nodes link to themselves.
    pairs = [(v, 36 + v % 3) for v in range(8, 36)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(22)] + [(37, 37), (5, 5)]
    members = {v: v % 2 for v in ids if v % 7}
    want = _all_links(ids, pairs, members, directed, scope)
    known = spark.createDataFrame(list(members.items()), "id long, community long")
    for limit in (3, 20, 1000):
        got = communities.predict_links(nodes(spark, *ids), edges(spark, *pairs), known, directed=directed, scope=scope, limit=limit, max_pairs=len(want)).collect()
        assert [(r["a"], r["b"], r["common"], round(r["confidence"], 9)) for r in got] == want[:limit]
    with pytest.raises(communities.CandidateLimit):
        communities.predict_links(nodes(spark, *ids), edges(spark, *pairs), known, directed=directed, scope=scope, max_pairs=len(want) - 1)


def test_link_prediction_at_a_hub_of_many(spark):
    e = spark.range(400_000).selectExpr("id", "id as from_id", "100000 + id % 2 as to_id")
    got = communities.predict_links(nodes(spark), e, limit=4)
    assert [(r["a"], r["b"], r["common"]) for r in got.collect()] == [(0, 2, 1), (0, 4, 1), (0, 6, 1), (0, 8, 1)]


def test_vertex_program_sends_to_ids_and_halts(spark):
    send = lambda s: F.when(s < 3, F.array(F.struct(F.lit(9).cast("long").alias("a"), (s + 1).alias("b")))).otherwise(F.array().cast("array<struct<a: bigint, b: bigint>>"))
    state, steps = pregel.run(nodes(spark, 1, 9), edges(spark, (9, 9)).limit(0), F.lit(0).cast("long"), lambda s, w: s, F.max, lambda s, m: F.greatest(s, m), send_to=send, halt=lambda old, new: (new >= 3) | (new == old))
    assert table(state, "id", "state")[9] == 3 and steps >= 3


def test_vertex_program(spark):
    e = edges(spark, (1, 2), (2, 3))
    state, steps = pregel.run(nodes(spark, 1, 2, 3), e, F.when(F.col("id") == 1, 0.0).otherwise(math.inf), lambda s, w: s + w, F.min, lambda s, m: F.least(s, m))
    assert table(state, "id", "state") == {1: 0.0, 2: 1.0, 3: 2.0} and steps >= 2
    with pytest.raises(ValueError):
        pregel.run(nodes(spark, 1, 2, 3), e, F.col("id"), lambda s, w: s, F.max, lambda s, m: F.greatest(s, m), max_messages=1)


def test_traversal_multiplicity_guards_and_paging(spark):
    people = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, name string")
    knows = edges(spark, (1, 2), (1, 2), (2, 3), (2, 1), strength=[1.0, 2.0, 3.0, 4.0])
    g = Graph({"P": people}, {"Knows": Edges(knows, "P", "P")})
    q = g.set("P").where_id(1).outgoing("Knows")
    assert q.count() == 2 and q.distinct().count() == 1
    two = g.set("P").where_id(1).path(Path("P").repeat_outgoing("Knows", 2))
    assert sorted(r["id"] for r in two.to_list()) == [1, 1, 3, 3]
    assert [r["id"] for r in g.set("P").where_id(1).path(Path("P").repeat_outgoing("Knows", 2).guarded(NO_REVISIT)).to_list()] == [3, 3]
    assert [r["id"] for r in g.set("P").order_by("name").to_list()] == [3, 1, 2]
    assert [r["id"] for r in g.set("P").order_by("name", True).to_list()] == [2, 1, 3]
    assert g.set("P").element_at(1)["id"] == 2 and g.set("P").last()["id"] == 3
    assert g.set("P").to_dict("id", "name") == {1: "a", 2: "b", 3: None}
    for wrong in (lambda: g.set("P").take(0), lambda: g.set("P").order_by("id").distinct(), lambda: g.set("P").select(id="id").outgoing("Knows"), lambda: Path("P").guarded(1)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(LookupError):
        g.set("P").where_id(7).first()
    with pytest.raises(ValueError):
        g.set("P").single()


def test_null_logic(spark):
    d = spark.createDataFrame([(1, None, None), (2, "", True), (3, " ", False), (4, "x%y", None)], "id long, s string, b boolean")
    ids = lambda c: sorted(r["id"] for r in d.filter(c).collect())
    assert ids(P.is_true(d.b)) == [2] and ids(P.is_false(d.b)) == [3]
    assert ids(P.contains(d.s, None)) == [2, 3, 4] and ids(P.contains(d.s, "%")) == [4]
    assert ids(P.is_null_or_empty(d.s)) == [1, 2] and ids(P.is_null_or_blank(d.s)) == [1, 2, 3]
    assert ids(P.one_of(d.s, [])) == [] and ids(P.one_of(d.s, [None, "", ""])) == [1, 2]


def test_model(spark):
    from pyspark.sql import types as T

    m = GraphModel({"P": NodeType("P", (Property("name", T.StringType(), True, 200),))}, {"K": EdgeType("K", "P", "P")})
    with pytest.raises(SchemaMismatch):
        m.check("P", nodes(spark, 1))
    assert "`id` BIGINT NOT NULL" in m.create_script()
    assert m.unique_violations("K", edges(spark, (1, 2)).union(edges(spark, (1, 2)))).first()["n"] == 2
    with pytest.raises(ValueError):
        GraphModel({}, {"K": EdgeType("K", "P", "P")})


H = "entity_type string, entity_id long, operation_kind int, captured_at timestamp, valid_from timestamp, valid_to timestamp, is_edge boolean"
D = [datetime(2024, 1, i) for i in range(1, 9)]


def test_history_ties_and_half_open_validity(spark):
    h = spark.createDataFrame([("U", 1, 2, D[1], D[0], D[2], False), ("U", 1, 1, D[1], D[1], None, False), ("U", 2, 3, D[1], D[1], None, False)], H)
    got = history.as_of(h, D[3]).collect()
    assert len(got) == 1 and got[0]["valid_to"] is None
    assert [r["entity_id"] for r in history.project(h.filter("valid_to is not null"), D[3], D[0]).collect()] == [1]
    assert history.project(h.filter("valid_to is not null"), D[3], D[2]).isEmpty()
    twice = spark.createDataFrame([("U", 1, 1, D[1], D[0], None, False), ("U", 1, 2, D[1], D[0], D[4], False)], H)
    with pytest.raises(ValueError):
        history.project(twice, D[3], D[1])
    with pytest.raises(ValueError):
        history.between(h, D[3], D[1])


def test_snapshot_fingerprint_does_not_depend_on_partitions(spark):
    rows = spark.range(100).select("id", (F.col("id") * 2).alias("x"))
    a = history.snapshot(rows, "id", ["x"])
    assert history.content_fingerprint(a) == history.content_fingerprint(history.snapshot(rows.repartition(7, "x"), "id", ["x"]))
    assert history.diff(a, a).isEmpty()
    b = history.snapshot(rows.filter("id <> 3").withColumn("x", F.when(F.col("id") == 4, 0).otherwise(F.col("x"))), "id", ["x"])
    assert table(history.diff(a, b), "id", "change") == {3: "Removed", 4: "Modified"}


DELTA = "op string, kind string, id long, from_id long, to_id long"


def test_deltas_carry_properties_and_versions(spark):
    n = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "id long, name string, demand double")
    e = edges(spark, (1, 2), (2, 3), (3, 1), cost=[1.0, 2.0, 3.0])
    rows = [("update", "node", 1, None, None, "z", None), ("add", "node", 4, None, None, "d", None), ("remove", "node", 3, None, None, None, None), ("update", "edge", 2, None, 4, None, 9.0), ("add", "edge", 7, 4, 1, None, 5.0)]
    delta = spark.createDataFrame(rows, DELTA + ", name string, cost double")
    p, affected = deltas.Projection("g", 1, n, e).apply(delta, "g", 1)
    assert table(p.nodes, "id", "name", "demand") == {1: ("z", 1.0), 2: ("b", 2.0), 4: ("d", None)}
    assert table(p.edges, "id", "from_id", "to_id", "cost") == {1: (1, 2, 1.0), 2: (2, 4, 9.0), 7: (4, 1, 5.0)}
    assert p.version == 2 and sorted(r["id"] for r in affected.collect()) == [1, 2, 3, 4]
    for wrong in (lambda: p.apply(delta, "other", 2), lambda: p.apply(delta, "g", 1), lambda: p.apply(delta, "g", 2, 2), lambda: deltas.Projection("g", 1, n, e).apply(delta.union(delta.limit(1)), "g", 1)):
        with pytest.raises(deltas.Rejected):
            wrong()
    same = lambda: (n, e)
    assert deltas.apply_or_rebuild(n, e, delta, same)[2] is False and deltas.apply_or_rebuild(n, e, delta.filter("op = 'add'").withColumn("id", F.lit(1).cast("long")), same)[2] is True


def test_mutations_are_applied_or_refused(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, name string, x double")
    m = spark.createDataFrame([(1, "update", 1, "z"), (2, "remove", 2, None), (3, "add", None, "n"), (4, "add", 9, "m"), (5, "add", None, "o")], "seq long, op string, id long, name string")
    plan = deltas.plan_mutations(m.withColumnRenamed("name", "payload"), rows.select("id", F.col("name").alias("payload")))
    assert table(deltas.apply_mutations(rows, plan, m), "id", "name", "x") == {1: ("z", 1.0), 9: ("m", None), 10: ("n", None), 11: ("o", None)}
    again = m.union(m.filter("seq = 1").withColumn("seq", F.lit(8).cast("long")))
    with pytest.raises(deltas.Rejected):
        deltas.apply_mutations(rows, deltas.plan_mutations(again.withColumnRenamed("name", "payload"), rows.select("id", F.col("name").alias("payload"))), again)
    e = edges(spark, (1, 2), (1, 2))
    em = spark.createDataFrame([(1, "connect", None, 1, 3), (2, "disconnect", None, 1, 2), (3, "disconnect", None, 2, 1), (4, "reconnect", 1, 2, 2), (5, "connect", 2, 1, 1)], "seq long, op string, id long, from_id long, to_id long")
    got = table(deltas.plan_edge_mutations(em, nodes(spark, 1, 2), e), "seq", "action", "problem")
    assert got == {1: ("Insert", "end missing"), 2: ("Delete", "ambiguous ends"), 3: ("NoOp", None), 4: ("Update", None), 5: ("Insert", "duplicate key")}


def test_deltas_are_checked(spark):
    n, e = nodes(spark, 1, 2, 3), edges(spark, (1, 2), (2, 3))
    for bad in (("add", "node", 1, None, None), ("remove", "node", 9, None, None), ("add", "edge", 9, 1, 9), ("update", "edge", 9, 1, 2)):
        with pytest.raises(deltas.Rejected):
            deltas.apply_delta(n, e, spark.createDataFrame([bad], DELTA))
    n2, e2, touched = deltas.apply_delta(n, e, spark.createDataFrame([("remove", "node", 2, None, None)], DELTA))
    assert e2.isEmpty() and sorted(r["id"] for r in touched.collect()) == [1, 2, 3]
    with pytest.raises(deltas.Rejected):
        deltas.remove_edge(edges(spark, (1, 2), (1, 2)), 1, 2)
    rows = spark.createDataFrame([(1, 1)], "id long, version int")
    with pytest.raises(deltas.Rejected):
        deltas.save_versioned(rows, spark.createDataFrame([(1, 2)], "id long, version int"))


def test_live_graph_follows_a_feed_and_refuses_disorder(spark, tmp_path):
    rows = [(2, "add", "edge", 7, 3, 1), (1, "add", "node", 3, None, None)]
    spark.createDataFrame(rows, "sequence long, " + DELTA).write.json(str(tmp_path / "in"))
    live = follow(spark, str(tmp_path / "in"), LiveGraph(nodes(spark, 1, 2), edges(spark, (1, 2))), str(tmp_path / "state"))
    assert live.sequence == 2 and live.edges.count() == 2 and [s for s, _ in live.updates] == [1, 2]
    for late in (2, 0, -1, None):
        with pytest.raises(OutOfOrder):
            live.apply(spark.createDataFrame([(late, "add", "node", 8, None, None)], "sequence long, " + DELTA))


def test_live_graph_is_the_deltas_one_by_one(spark, tmp_path):
    """Random batches folded at once and applied sequence by sequence; failing ones change nothing; a new graph goes on."""
    rng = np.random.default_rng(2)
    n = spark.createDataFrame([(i, f"n{i}") for i in range(6)], "id long, name string")
    e = edges(spark, *[(int(a), int(b)) for a, b in rng.integers(0, 6, (9, 2))], cost=[float(i) for i in range(9)])
    live = LiveGraph(n, e, state=str(tmp_path / "state"))
    one, s = (n, e), 0
    schema = "sequence long, " + DELTA + ", name string, cost double"
    for epoch in range(3):
        batch = []
        while len(batch) < 5:
            op, kind, i = rng.choice(["add", "update", "remove"]), rng.choice(["node", "edge"]), int(rng.integers(0, 12))
            ends = (int(rng.integers(0, 7)), int(rng.integers(0, 7))) if kind == "edge" and op != "remove" else (None, None)
            row = (s + 1, str(op), str(kind), i, *ends, f"x{s}" if kind == "node" else None, float(s) if kind == "edge" else None)
            try:
                one = deltas.apply_delta(*one, spark.createDataFrame([row], schema).drop("sequence"))[:2]
            except deltas.Rejected:
                continue
            one = tuple(map(cut, one))
            batch.append(row)
            s += 1
        wrong = spark.createDataFrame([*batch, (s + 1, "add", "edge", 99, 0, 77, None, None)], schema)
        with pytest.raises(deltas.Rejected):
            live.apply(wrong, epoch)
        live.apply(spark.createDataFrame(batch, schema), epoch)
        live.apply(spark.createDataFrame(batch, schema), epoch)
        live = LiveGraph(n, e, state=str(tmp_path / "state"))
        assert live.sequence == s and table(live.nodes, "id", "name") == table(one[0], "id", "name")
        assert table(live.edges, "id", "from_id", "to_id", "cost") == table(one[1], "id", "from_id", "to_id", "cost")


def test_twin(spark):
    n = spark.createDataFrame([(1, 0.0), (2, 3.0), (3, 2.0)], "id long, demand double")
    e = edges(spark, (1, 2), (2, 3), capacity=[3.0, 2.0])
    assert table(twin.cascade(n, e, nodes(spark, 1)), "id", "round") == {1: 0, 2: 1, 3: 2}
    s = twin.outcome_statistics(spark.createDataFrame([(float(i),) for i in range(5)], "outcome double")).first()
    assert (s["mean"], s["p25"], s["p75"]) == (2.0, 1.0, 3.0)
    runs = twin.monte_carlo(spark, 100, lambda u: u[:, 0], 1).orderBy("run").toPandas()["outcome"]
    again = twin.monte_carlo(spark, 50, lambda u: u[:, 0], 1).orderBy("run").toPandas()["outcome"]
    assert np.array_equal(runs[:50], again) and 0 <= runs.min() and runs.max() < 1
    chain = twin.event_chain("s", "b", [{"op": "add"}, {"op": "remove"}])
    assert twin.verify_chain("s", "b", chain) and not twin.verify_chain("s", "b", chain[1:])
    assert twin.read_report(twin.evidence_report([], [{"severity": 1, "rule": "r"}], [], []))["warnings"]
    with pytest.raises(ValueError):
        twin.read_report(twin.evidence_report([], [], [], []).replace('"drift": []', '"drift": [1]'))
    state, ran, late = twin.simulate([], [(2, 0, "b", None), (1, 0, "a", None), (9, 0, "c", None)], lambda s, ev: s + [ev[2]], 5)
    assert (state, ran, late) == (["a", "b"], 2, 1)


def test_drift_levels_and_order(spark):
    world = lambda *ids: spark.createDataFrame([("node", i, "f", "-") for i in ids], "kind string, id long, fingerprint string, ends string")
    assert twin.drift(world(1, 2), world(1, 2)).first()["level"] == "None"
    assert twin.drift(world(1, 2), world(1)).first()["level"] == "Critical"
    sync = TwinSynchronizer()
    sync.observe(1, D[0], world(1), world(1))
    with pytest.raises(OutOfOrder):
        sync.observe(1, D[1], world(1), world(1))


def test_documents(spark):
    n = spark.createDataFrame([("A",), ("b",), ("c",)], "id string")
    l = spark.createDataFrame([("a", "B"), ("B", "c")], "source string, target string")  # noqa: E741
    assert table(documents.focus(n, l, "a", 1), "id", "depth") == {"A": 0, "b": 1}
    assert documents.focus(n, l, "c", 5, incoming=True).count() == 3


def test_registry_and_cache(spark):
    r = Registry()
    r.register("x", lambda a, b=1: a + b)
    assert r.run("x", 1, b=2)[0] == 3
    for wrong in (lambda: r.register("x", len), lambda: r.run("x", 1, c=2)):
        with pytest.raises(ValueError):
            wrong()
    assert "community.leiden" in standard().algorithms
    clock, loads = [0.0], []
    cache = ProjectionCache(1, 10, lambda: clock[0])
    load = lambda: loads.append(1) or (nodes(spark, 1), edges(spark, (1, 1)))
    cache.get("k", 1, load), cache.get("k", 1, load)
    clock[0] = 11
    cache.get("k", 1, load), cache.get("k", 2, load)
    assert len(loads) == 3


def test_statistics_with_an_orphan_a_loop_and_parallel_edges(spark):
    s = structure.statistics(nodes(spark, 1, 2, 3), edges(spark, (1, 2), (1, 2), (1, 1), (1, 9))).first()
    assert (s["nodes"], s["edges"], s["isolated"], s["orphans"]) == (3, 3, 1, 1)


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
