"""Queries over the whole graph of the smallest tables, against brute force."""

from collections import Counter, defaultdict

import pytest

from factloom.plans import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain(spark):
    """nodes, arcs as (id, src, dst) and each node's strong component, by what each node reaches."""
    nodes, edges = Q._graph(spark, DATA)
    names = [r.node for r in nodes.collect()]
    arcs = [(r.id, r.src, r.dst) for r in edges.collect()]
    ahead = defaultdict(set)
    for _, a, b in arcs:
        ahead[a].add(b)

    def reach(n):
        seen, stack = {n}, [n]
        while stack:
            new = ahead[stack.pop()] - seen
            seen |= new
            stack += new
        return seen

    every = {n: reach(n) for n in names}
    return names, arcs, {n: min(m for m in every[n] if n in every[m]) for n in names}


def test_boundary_gate_judges_components(spark, plain):
    names, _, component = plain
    owner = {r.node: r.owner for r in Q.queries()["graph_partition"](spark, DATA).collect()}
    members = defaultdict(list)
    for n in names:
        members[component[n]].append(n)
    want = Counter(Q.queries()["gate_boundary"](spark, DATA).collect())
    for c, held in members.items():  # no edge of these tables is a loop
        if len(held) > 8:
            want[(f"s{c}", 0, "large-scc", "warn")] += 1
        if len(held) > 1 and len({owner[n] for n in held}) > 1:
            want[(f"s{c}", 1, "boundary-crossing-scc", "deny")] += 1
    got = Counter(map(tuple, Q.queries()["gate_boundary_whole"](spark, DATA).collect()))
    assert got == Counter({tuple(k): v for k, v in want.items()}) and {r for _, r, *_ in got} >= {0, 1}


def test_components_condensation_and_order(spark, plain):
    names, arcs, component = plain
    run = lambda name: Q.queries()[f"graph_{name}_whole"](spark, DATA).collect()
    size = Counter(component.values())
    assert {r.node: (r.component, r.cyclic) for r in run("strong_components")} == {n: (c, size[c] > 1) for n, c in component.items()}
    links = defaultdict(list)
    for i, a, b in arcs:
        if component[a] != component[b]:
            links[component[a], component[b]].append(i)
    assert {(r.source, r.target): (r.edges, r.first_edge) for r in run("condensation")} == {k: (len(v), min(v)) for k, v in links.items()}
    place = {r.component: r.place for r in run("topological_order")}
    assert sorted(place) == sorted(size) and sorted(place.values()) == list(range(len(size))) and all(place[a] < place[b] for a, b in links)
    least = {n: n for _, *ends in arcs for n in ends}
    moved = True
    while moved:
        moved = False
        for _, a, b in arcs:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                moved = True
    assert {r.node: r.component for r in run("connected_components")} == least and len(least) > 25
