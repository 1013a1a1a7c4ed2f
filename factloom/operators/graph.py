"""Code-graph analytics as DataFrame programs.

``nodes``: node, parent (of the containment tree), category, label.
``edges``: id, src, dst, kind, certainty; parallel edges and self-loops count.
Loops advance a frontier and write each state to shared scratch, so a plan never
grows with the number of rounds. No state is collected: only counts are.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.scratch import Grown, discard, materialise

SYMBOLS = ["function", "type", "value"]


def select_edges(edges: DataFrame, kinds: list[str] | None = None, certainties: list[str] | None = None) -> DataFrame:
    """Edges of the given kinds and certainties; None allows any."""
    if kinds is not None:
        edges = edges.where(F.col("kind").isin(kinds))
    return edges if certainties is None else edges.where(F.col("certainty").isin(certainties))


def code_relations(edges: DataFrame) -> DataFrame:
    """All but dependencies between packages, of any certainty."""
    return select_edges(edges, ["call", "import", "implementation", "reference"])


def admit(nodes: DataFrame, edges: DataFrame, max_nodes: int = 250_000, max_edges: int = 1_000_000) -> None:
    """Refuse a graph above its ceilings."""
    if nodes.count() > max_nodes or edges.count() > max_edges:
        raise ValueError("the graph is above its ceiling")


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, incoming, outgoing, total; a self-loop counts once each way."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    sums = ends.groupBy("node").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))
    return nodes.select("node").join(sums, "node", "left").fillna(0).withColumn("total", F.col("incoming") + F.col("outgoing"))


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Distinct (a, b) steps: out, in or both."""
    out, back = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"out": out, "in": back, "both": out.unionAll(back)}[direction].distinct()


def neighbors(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """seed, node and distance of all nodes within ``depth`` steps of each seed, the seed itself left out."""
    steps = materialise(directed(edges, direction), "steps")
    seen = Grown(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("distance")).distinct(), "seen")
    front = seen.rows
    for d in range(1, depth + 1):
        reached = front.join(steps, front.node == steps.a).select("seed", F.col("b").alias("node"), F.lit(d).alias("distance")).distinct()
        front = seen.add(reached.join(seen.rows, ["seed", "node"], "left_anti"))
        if front.isEmpty():
            break
    return seen.rows.where("distance > 0")


def shortest_path(edges: DataFrame, source: int, target: int) -> DataFrame:
    """step, id, src, dst of a shortest path, that with the least edge id at every step; empty if there is none."""
    back = materialise(edges.select("id", "src", "dst"), "path-edges")
    near = materialise(edges.sparkSession.createDataFrame([(target, 0)], "node long, left int"), "path-near")
    front, d = near, 0
    while near.where(F.col("node") == source).isEmpty():
        d += 1
        reached = back.join(front, back.dst == front.node).select(F.col("src").alias("node")).distinct().withColumn("left", F.lit(d))
        front = materialise(reached.join(near, "node", "left_anti"), "path-front")
        if front.isEmpty():
            return back.limit(0).withColumn("step", F.lit(0)).select("step", "id", "src", "dst")
        near = materialise(near.unionByName(front), "path-near")
    rows, at = [], source
    for step in range(d):  # one edge for each step, by its least id
        ahead = near.where(F.col("left") == d - step - 1)
        edge = back.where(F.col("src") == at).join(ahead, back.dst == ahead.node).agg(F.min_by(F.struct("id", "src", "dst"), "id").alias("e")).first()["e"]
        rows.append((step, edge["id"], edge["src"], edge["dst"]))
        at = edge["dst"]
    return edges.sparkSession.createDataFrame(rows, "step int, id long, src long, dst long")


def subgraph(edges: DataFrame, seed: int, depth: int, direction: str = "out") -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` of the seed (itself included) and the edges with both ends among them."""
    start = edges.sparkSession.createDataFrame([(seed,)], "node long")
    kept = materialise(neighbors(edges, start, depth, direction).select("node").unionAll(start).distinct(), "subgraph")
    inner = edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return kept, inner


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of the undirected graph; nodes without an edge to another are left out.

    Large-star and small-star rounds; hubs are joined on their least neighbour.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    state = None
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = materialise(both.where("v > u").join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc-large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        after = materialise(small.where("u <> v").distinct(), "cc")
        discard(now, first, large, least)
        now = after
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return pairs.unionAll(pairs.select(F.col("component"), F.col("component"))).distinct()
        state = seen


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (its least node) and cyclic of every node.

    Colours spread forward (each node takes the least node that reaches it); from
    every colour's root the nodes of that colour that reach it, found backward, are
    its component. They leave, and the rest goes on. Nodes without an edge either
    way are trimmed first. A lone node is cyclic if it has a loop.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    left = materialise(nodes.select("node"), "scc-nodes")
    steps = materialise(edges.where("src <> dst").select("src", "dst").distinct(), "scc-steps")
    done = None
    while True:
        # Trim: what has no step in, or none out, is a component of its own.
        inner = left.join(steps.select(F.col("src").alias("node")).distinct(), "node", "left_semi").join(steps.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
        inner = materialise(inner, "scc-inner")
        lone = left.join(inner, "node", "left_anti").select("node", F.col("node").alias("component"))
        done = materialise(lone if done is None else done.unionByName(lone), "scc-done")
        before, after = left.count(), inner.count()
        if not after:
            break
        steps = materialise(steps.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi"), "scc-steps")
        left = inner
        if after < before:
            continue
        colour = materialise(left.withColumn("colour", F.col("node")), "scc-colour")
        while True:
            passed = steps.join(colour, steps.src == colour.node).groupBy("dst").agg(F.min("colour").alias("given"))
            joined = colour.join(passed, colour.node == passed.dst, "left").select("node", F.least("colour", F.coalesce("given", "colour")).alias("colour"), (F.col("given") < F.col("colour")).alias("moved"))
            joined = materialise(joined, "scc-colour")
            colour = joined.select("node", "colour")
            if joined.where("moved").isEmpty():
                break
        owned = steps.join(colour, steps.src == colour.node).select("src", "dst", F.col("colour").alias("cs")).join(colour.withColumnsRenamed({"node": "n2", "colour": "cd"}), F.col("dst") == F.col("n2")).where("cs = cd").select("src", "dst", F.col("cs").alias("colour"))
        owned = materialise(owned, "scc-owned")
        found = materialise(colour.where("node = colour"), "scc-found")
        front = found
        while True:
            back = owned.join(front.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            front = materialise(back.join(found, ["node", "colour"], "left_anti"), "scc-front")
            if front.isEmpty():
                break
            found = materialise(found.unionByName(front), "scc-found")
        done = materialise(done.unionByName(found.select("node", F.col("colour").alias("component"))), "scc-done")
        left = materialise(left.join(found, "node", "left_anti"), "scc-nodes")
        steps = materialise(steps.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"), "scc-steps")
        if left.isEmpty():
            break
    sizes = done.groupBy("component").agg((F.count("*") > 1).alias("many"))
    return done.join(sizes, "component").join(loops.withColumn("loop", F.lit(True)), "node", "left").select("node", "component", (F.col("many") | F.coalesce("loop", F.lit(False))).alias("cyclic"))


def condensation(edges: DataFrame, components: DataFrame) -> DataFrame:
    """source, target, edges: one row for each pair of components with an edge from one to the other, and their number."""
    a = components.select(F.col("node").alias("src"), F.col("component").alias("source"))
    b = components.select(F.col("node").alias("dst"), F.col("component").alias("target"))
    return edges.join(a, "src").join(b, "dst").where("source <> target").groupBy("source", "target").agg(F.count("*").alias("edges"), F.min("id").alias("first_edge"))


def topological_order(links: DataFrame, components: DataFrame) -> DataFrame:
    """component and place: always the least component whose predecessors are all placed.

    This order is sequential by nature, so the condensation is ordered on the
    driver. ``admit`` refuses one with more components or links than its ceilings.
    """
    admit(components.select("component").distinct(), links.select("source", "target").distinct())
    names = [r[0] for r in components.select("component").distinct().collect()]
    ahead: dict[int, list[int]] = {c: [] for c in names}
    waits = dict.fromkeys(names, 0)
    for r in links.select("source", "target").distinct().collect():
        ahead[r[0]].append(r[1])
        waits[r[1]] += 1
    ready = [c for c in names if not waits[c]]
    heapq.heapify(ready)
    out = []
    while ready:
        c = heapq.heappop(ready)
        out.append((c, len(out)))
        for d in ahead[c]:
            waits[d] -= 1
            if not waits[d]:
                heapq.heappush(ready, d)
    return components.sparkSession.createDataFrame(out, "component long, place int")


# ---------------------------------------------------------------- centrality


def betweenness(nodes: DataFrame, edges: DataFrame, max_work: int = 50_000_000) -> DataFrame:
    """node, raw and score: shares of shortest routes that pass through, parallel edges being routes of their own.

    Directed; ends get no credit; scores are over (n - 1)(n - 2), and 0 for two
    nodes or fewer. All sources advance together, level by level; dependencies
    are summed back by level. n (n + m) above ``max_work`` is refused.
    """
    n, m = nodes.count(), edges.count()
    if n * (n + m) > max_work:
        raise ValueError("betweenness is above its work bound")
    steps = materialise(edges.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("ways")), "bc-steps")
    seen = materialise(nodes.select(F.col("node").alias("source"), "node", F.lit(0).alias("d"), F.lit(1.0).alias("routes")), "bc-seen")
    front, d = seen, 0
    while True:
        d += 1
        reached = front.join(steps, front.node == steps.src).groupBy("source", F.col("dst").alias("node")).agg(F.sum(F.col("routes") * F.col("ways")).alias("routes")).withColumn("d", F.lit(d))
        front = materialise(reached.join(seen.select("source", "node"), ["source", "node"], "left_anti").select("source", "node", "d", "routes"), "bc-front")
        if front.isEmpty():
            break
        seen = materialise(seen.unionByName(front), "bc-seen")
    credit = None
    for level in range(d - 1, 0, -1):
        here = seen.where(F.col("d") == level)
        if credit is not None:
            here = here.join(credit, ["source", "node"], "left").select("source", "node", "routes", F.coalesce("credit", F.lit(0.0)).alias("credit"))
        else:
            here = here.select("source", "node", "routes", F.lit(0.0).alias("credit"))
        here = materialise(here, "bc-here")
        total = here.where("source <> node") if level == d - 1 else total.unionByName(here.where("source <> node"))
        up = seen.where(F.col("d") == level - 1).select("source", F.col("node").alias("p"), F.col("routes").alias("pr"))
        given = here.join(steps, here.node == steps.dst).join(up.withColumnRenamed("source", "s"), (F.col("source") == F.col("s")) & (F.col("src") == F.col("p")))
        credit = materialise(given.groupBy("source", F.col("p").alias("node")).agg(F.sum(F.col("pr") * F.col("ways") / F.col("routes") * (1 + F.col("credit"))).alias("credit")), "bc-credit")
    raw = total.groupBy("node").agg(F.sum("credit").alias("raw")) if d > 1 else nodes.select("node", F.lit(0.0).alias("raw"))
    over = float((n - 1) * (n - 2)) if n > 2 else 0.0
    score = F.col("raw") / over if over else F.lit(0.0)
    return nodes.select("node").join(raw, "node", "left").select("node", F.coalesce("raw", F.lit(0.0)).alias("raw")).withColumn("score", score)


# ---------------------------------------------------------------- partitions


def partition(nodes: DataFrame) -> DataFrame:
    """node and owner: the nearest container above it (a container owns itself); null if none. Pointer jumping."""
    at = materialise(nodes.select("node", F.when(F.col("category") == "container", F.col("node")).alias("owner"), "parent"), "owners")
    while not at.where("owner is null and parent is not null").isEmpty():
        up = at.select(F.col("node").alias("_n"), F.col("owner").alias("_o"), F.col("parent").alias("_p"))
        at = materialise(at.join(up, (at.parent == up._n) & at.owner.isNull(), "left").select("node", F.coalesce("owner", "_o").alias("owner"), F.when(F.coalesce("owner", "_o").isNull(), F.col("_p")).alias("parent")), "owners")
    return at.select("node", "owner")


def qualified_labels(nodes: DataFrame) -> DataFrame:
    """node and path: the labels from the root down, joined by ``::``."""
    at = materialise(nodes.select("node", "parent", F.col("label").alias("path")), "labels")
    names = nodes.select(F.col("node").alias("_n"), F.col("parent").alias("_p"), F.col("label").alias("_l"))
    while not at.where("parent is not null").isEmpty():
        at = materialise(at.join(names, at.parent == names._n, "left").select("node", F.col("_p").alias("parent"), F.concat_ws("::", "_l", "path").alias("path")), "labels")
    return at.select("node", "path")


def owned_edges(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """The edges with src_owner and dst_owner; edges with an unowned end are left out."""
    a = owners.where("owner is not null").select(F.col("node").alias("src"), F.col("owner").alias("src_owner"))
    b = owners.where("owner is not null").select(F.col("node").alias("dst"), F.col("owner").alias("dst_owner"))
    return edges.join(a, "src").join(b, "dst")


def cohesion(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """owner, internal, boundary and score of every partition: edges that leave its nodes, by whether they stay."""
    inside = F.col("src_owner") == F.col("dst_owner")
    sums = owned_edges(edges, owners).groupBy(F.col("src_owner").alias("owner")).agg(F.count_if(inside).alias("internal"), F.count_if(~inside).alias("boundary"))
    every = owners.where("owner is not null").select("owner").distinct().join(sums, "owner", "left").fillna(0)
    whole = F.col("internal") + F.col("boundary")
    return every.withColumn("score", F.when(whole > 0, F.col("internal") / whole))


def modularity(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """One row: edges, internal and modularity (null without an edge)."""
    held = owned_edges(edges, owners)
    out = held.groupBy(F.col("src_owner").alias("owner")).agg(F.count("*").alias("k_out"), F.count_if(F.col("src_owner") == F.col("dst_owner")).alias("internal"))
    into = held.groupBy(F.col("dst_owner").alias("owner")).agg(F.count("*").alias("k_in"))
    joined = out.join(into, "owner", "full_outer").fillna(0)
    m = F.sum("k_out")
    return joined.agg(m.alias("edges"), F.sum("internal").alias("internal"), F.when(m > 0, F.sum("internal") / m - F.sum(F.col("k_out") * F.col("k_in")) / (m * m)).alias("modularity"))


def misplacement(nodes: DataFrame, edges: DataFrame, owners: DataFrame) -> DataFrame:
    """symbol, foreign_owner, foreign, total: edges of a symbol into each partition not its own, over all that it has out."""
    held = owned_edges(edges, owners).join(nodes.where(F.col("category").isin(SYMBOLS)).select(F.col("node").alias("src")), "src", "left_semi")
    pairs = held.groupBy("src", "src_owner", "dst_owner").agg(F.count("*").alias("foreign"))
    total = pairs.groupBy("src").agg(F.sum("foreign").alias("total"))
    return pairs.where("src_owner <> dst_owner").join(total, "src").select(F.col("src").alias("symbol"), F.col("dst_owner").alias("foreign_owner"), "foreign", "total")


def crossings(components: DataFrame, owners: DataFrame) -> DataFrame:
    """component, members, partitions of the components whose members lie in two partitions or more."""
    held = components.join(owners, "node").groupBy("component").agg(F.count("*").alias("members"), F.count_distinct("owner").alias("partitions"))
    return held.where("partitions > 1")


def component_facts(components: DataFrame, owners: DataFrame) -> DataFrame:
    return components.join(owners, "node", "left").groupBy("component").agg(F.count("*").alias("members"), F.count_distinct("owner").alias("partitions"), F.bool_or("cyclic").alias("cyclic"))


def layout(nodes: DataFrame, edges: DataFrame, owners: DataFrame, centrality: DataFrame | None = None) -> DataFrame:
    """node, parent, owner, incoming and outgoing, and the betweenness score where ``centrality`` has it: what a drawing needs."""
    out = nodes.select("node", "parent").join(owners, "node", "left").join(degree(nodes, edges).drop("total"), "node")
    return out if centrality is None else out.join(centrality.select("node", F.col("score").alias("betweenness")), "node", "left")


def layout_edges(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """id, src, dst, kind, certainty and crosses (whether the ends lie in different partitions; null where one has none)."""
    a, b = (owners.select(F.col("node").alias(end), F.col("owner").alias(f"{end}_owner")) for end in ("src", "dst"))
    return edges.join(a, "src", "left").join(b, "dst", "left").select("id", "src", "dst", "kind", "certainty", (F.col("src_owner") != F.col("dst_owner")).alias("crosses"))


def divergence(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """All that says how far a graph is from its declared partitions: cohesion, modularity, misplacement, crossings."""
    owners = materialise(partition(nodes), "owners")
    components = materialise(strong_components(nodes, edges), "components")
    return {"cohesion": cohesion(edges, owners), "modularity": modularity(edges, owners), "misplacement": misplacement(nodes, edges, owners), "crossings": crossings(components, owners)}


def component_subjects(components: DataFrame, labels: DataFrame) -> DataFrame:
    """component, subject and members: a cyclic component is named after its least member."""
    named = components.where("cyclic").join(labels, "node", "left")
    return named.groupBy("component").agg(F.concat(F.lit("scc::"), F.min_by("path", "node")).alias("subject"), F.count("*").alias("members"))


def validate_component_facts(facts: DataFrame) -> None:
    """Each component once, with members and partitions, no more of these than of those, and cyclic if it has several members; else ValueError."""
    if not facts.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a component is stated twice")
    if not facts.where("members < 1 or partitions < 1 or partitions > members or (members > 1 and not cyclic) or component is null").isEmpty():
        raise ValueError("a component fact contradicts itself")


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """value: rows of a version-1 graph document, one JSON object each: the header, then nodes, then edges, by id."""
    head = nodes.agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("m"))).select(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("id"), F.to_json(F.struct(F.lit(1).alias("version"), F.col("n").alias("nodes"), F.col("m").alias("edges"))).alias("value"))
    a = nodes.select(F.lit(1).alias("part"), F.col("node").alias("id"), F.to_json(F.struct(F.col("node").alias("id"), "parent", "category", "label")).alias("value"))
    b = edges.select(F.lit(2).alias("part"), "id", F.to_json(F.struct("id", F.col("src").alias("source"), F.col("dst").alias("target"), "kind", "certainty")).alias("value"))
    return head.unionByName(a).unionByName(b)


# ---------------------------------------------------------------- closures


def closure(steps: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed and node of everything reachable by (a, b) steps, the seeds included. Semi-naive: only new pairs are joined on."""
    steps = materialise(steps.select("a", "b").distinct(), "closure-steps")
    seen = Grown(seeds.select(F.col("node").alias("seed"), "node").distinct(), "closure")
    front = seen.rows
    while True:
        reached = front.join(steps, front.node == steps.a).select("seed", F.col("b").alias("node")).distinct()
        front = seen.add(reached.join(seen.rows, ["seed", "node"], "left_anti"))
        if front.isEmpty():
            return seen.rows
