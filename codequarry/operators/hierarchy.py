"""Parent-child links to full hierarchies: path, depth, root, descendants, cycles.

Two physical forms share one traversal:

* ``map_hierarchy`` / ``map_cycle_nodes``: one row holds one whole graph as a map of
  parent to children. Rows are independent, so nothing is shuffled.
* ``edge_hierarchy``: an edge table of any size. Connected components are found by
  alternating star contractions, components up to ``local_edges`` edges are
  co-located and traversed in one task each, larger ones are resolved by
  distributed peeling, colouring and frontier joins, so that no task ever holds one.

Traversal: iterative depth-first search with white, grey and black nodes. A link to a
grey node is a back edge; low links give the strongly connected components, and a
node is on a cycle if its component has two nodes or a self link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Output rows of one Arrow batch.
BATCH_ROWS = 4096
#: Components of more edges than this are resolved by distributed joins.
LOCAL_EDGES = 100_000


# ---------------------------------------------------------------- one graph in memory


def clean_graph(links) -> dict[str, list[str]]:
    """Parent to distinct children in first-seen order; null names are dropped."""
    out: dict[str, list[str]] = {}
    for parent, children in links or ():
        if parent is None:
            continue
        seen = out.setdefault(parent, [])
        have = set(seen)
        for child in children or ():
            if child is not None and child not in have:
                have.add(child)
                seen.append(child)
    return out


def components(graph: dict[str, list[str]]) -> list[list[str]]:
    """Weakly connected components (union-find), each with its nodes in first-seen order."""
    up: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for parent, children in graph.items():
        up.setdefault(parent, parent)
        for child in children:
            up.setdefault(child, child)
            a, b = find(parent), find(child)
            if a != b:
                up[b] = a
    groups: dict[str, list[str]] = {}
    for node in up:
        groups.setdefault(find(node), []).append(node)
    return list(groups.values())


def colour_search(graph: dict[str, list[str]], nodes: list[str]):
    """Depth-first search over nodes: strongly connected component of each node, nodes
    on cycles, back edges. Iterative, so depth is bounded by memory only."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    grey: set[str] = set()
    stack: list[str] = []
    waiting: set[str] = set()
    scc: dict[str, int] = {}
    cyclic: set[str] = set()
    back: list[tuple[str, str]] = []
    for start in nodes:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        grey.add(start)
        stack.append(start)
        waiting.add(start)
        work = [(start, iter(graph.get(start, ())))]
        while work:
            node, children = work[-1]
            for child in children:
                if child == node:
                    cyclic.add(node)
                if child in grey:
                    back.append((node, child))
                if child not in index:
                    index[child] = low[child] = len(index)
                    grey.add(child)
                    stack.append(child)
                    waiting.add(child)
                    work.append((child, iter(graph.get(child, ()))))
                    break
                if child in waiting:
                    low[node] = min(low[node], index[child])
            else:
                work.pop()
                grey.discard(node)
                if work:
                    above = work[-1][0]
                    low[above] = min(low[above], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        member = stack.pop()
                        waiting.discard(member)
                        members.append(member)
                        if member == node:
                            break
                    for member in members:
                        scc[member] = index[node]
                    if len(members) > 1:
                        cyclic.update(members)
    return scc, cyclic, back


def cycle_nodes(graph: dict[str, list[str]]) -> list[str]:
    """Nodes from which links lead back to themselves."""
    found: list[str] = []
    for nodes in components(graph):
        found += sorted(colour_search(graph, nodes)[1])
    return found


def start_nodes(graph: dict[str, list[str]], nodes: list[str], scc: dict[str, int]) -> list[str]:
    """Roots of a component: nodes without a parent, and of each strongly connected
    component that nothing else links to, its smallest node."""
    entered = {scc[c] for p in nodes for c in graph.get(p, ()) if scc[c] != scc[p]}
    first: dict[int, str] = {}
    for node in nodes:
        if scc[node] not in entered:
            first[scc[node]] = min(first.get(scc[node], node), node)
    return sorted(first.values())


def descendants(graph: dict[str, list[str]], node: str) -> list[str]:
    """All nodes that links lead to from node, itself only if it is on a cycle."""
    seen: set[str] = set()
    todo = list(graph.get(node, ()))
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo.extend(graph.get(x, ()))
    return sorted(seen)


def paths(graph: dict[str, list[str]], root: str) -> Iterator[tuple[str, ...]]:
    """Every path from root that repeats no node, parents before children."""
    path, on = [root], {root}
    yield (root,)
    work = [iter(graph.get(root, ()))]
    while work:
        for child in work[-1]:
            if child not in on:
                path.append(child)
                on.add(child)
                yield tuple(path)
                work.append(iter(graph.get(child, ())))
                break
        else:
            work.pop()
            on.discard(path.pop())


# ---------------------------------------------------------------- one graph per row


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)


def map_cycle_nodes(df: DataFrame, key: str, graph: str) -> DataFrame:
    """Distinct (key, node_id) of the nodes of each row's graph that are on a cycle.

    A null or empty graph gives no row; null children are no links; repeated rows
    count once. Columns besides key and graph are not read.
    """
    schema = pa.schema([("key", pa.int64()), ("node_id", pa.string())])

    def run(batches):
        def rows():
            for batch in batches:
                for k, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for node in cycle_nodes(clean_graph(g)):
                        yield k, node

        return _batches(rows(), schema)

    out = df.select(F.col(key).cast("long").alias("key"), F.col(graph).alias("graph"))
    return out.mapInArrow(run, "key long, node_id string").distinct().withColumnRenamed("key", key)


def map_cycle_links(df: DataFrame, key: str, graph: str) -> DataFrame:
    """Distinct (key, cycle, parent, child) of the links that lie on a cycle of each row's graph.

    Those are the back edges of the search and what they close: links inside a strongly
    connected component, and self links. cycle is the least node of the component, so the
    result doesn't depend on where the search began. Cases as for map_cycle_nodes.
    """
    schema = pa.schema([("key", pa.int64()), ("cycle", pa.string()), ("parent", pa.string()), ("child", pa.string())])

    def run(batches):
        def rows():
            for batch in batches:
                for k, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    links = clean_graph(g)
                    for nodes in components(links):
                        scc, _, back = colour_search(links, nodes)
                        if not back:
                            continue
                        least: dict[int, str] = {}
                        for node in nodes:
                            least[scc[node]] = min(least.get(scc[node], node), node)
                        for parent in nodes:
                            for child in links.get(parent, ()):
                                if scc[parent] == scc[child]:
                                    yield k, least[scc[parent]], parent, child

        return _batches(rows(), schema)

    out = df.select(F.col(key).cast("long").alias("key"), F.col(graph).alias("graph"))
    return out.mapInArrow(run, "key long, cycle string, parent string, child string").distinct().withColumnRenamed("key", key)


def map_hierarchy(df: DataFrame, key: str, graph: str, types: str) -> DataFrame:
    """One row per graph, root and path: the full hierarchy of each row's graph.

    Columns: key, root, node_id, node_type (null where types has none), depth (root 0),
    path (array), on_cycle, descendants (array, sorted). A node that several parents
    call has a row for each path; a path never repeats a node, so a cycle is entered
    once and its back link shows as on_cycle. Null or empty graphs give no row.
    Repeated rows (same key) are read once.
    """
    schema = pa.schema([
        ("key", pa.int64()), ("root", pa.string()), ("node_id", pa.string()), ("node_type", pa.string()), ("depth", pa.int64()),
        ("path", pa.list_(pa.string())), ("on_cycle", pa.bool_()), ("descendants", pa.list_(pa.string())),
    ])

    def run(batches):
        def rows():
            for batch in batches:
                for k, g, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    links, kinds = clean_graph(g), dict(t or ())
                    below: dict[str, list[str]] = {}
                    for nodes in components(links):
                        scc, cyclic, _ = colour_search(links, nodes)
                        for root in start_nodes(links, nodes, scc):
                            for path in paths(links, root):
                                node = path[-1]
                                if node not in below:
                                    below[node] = descendants(links, node)
                                yield k, root, node, kinds.get(node), len(path) - 1, list(path), node in cyclic, below[node]

        return _batches(rows(), schema)

    out = df.select(F.col(key).cast("long").alias("key"), F.col(graph).alias("graph"), F.col(types).alias("types"))
    # maps can't be compared, so repeated rows leave by key
    out = out.dropDuplicates(["key"])
    ddl = "key long, root string, node_id string, node_type string, depth long, path array<string>, on_cycle boolean, descendants array<string>"
    return out.mapInArrow(run, ddl).withColumnRenamed("key", key)


# ---------------------------------------------------------------- edge tables


def connected_components(edges: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """(node, component) of an undirected reading of the edges; component is the least
    node of it. Alternates large-star and small-star contractions until nothing moves,
    about log(n) rounds, each cut with a checkpoint. A hub of a third of all edges is
    pre-aggregated: its minimum is a partial aggregate, and its links meet it by a join
    that AQE may split."""
    e = edges.select(F.col(parent).alias("u"), F.col(child).alias("v")).where("u is not null and v is not null")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    e = cut_lineage(e.where("u <> v").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("v", "u"))
        near = both if large else both.where("v < u")
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = near.join(least, "u")
        moved = moved.where("v > u").select("v", "m") if large else moved.select("v", "m").union(least.select("u", "m"))
        return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()

    before = None
    while True:
        e = cut_lineage(star(star(e, True), False))
        now = mark(e)
        if now == before:
            break
        before = now
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _peel(e: DataFrame) -> DataFrame:
    """Edges left after nodes without a parent or without a child are taken off again and again."""
    n = -1
    while True:
        e = cut_lineage(e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"))
        left = e.count()
        if left == n:
            return e
        n = left


def distributed_cycle_nodes(edges: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """Distinct node_id on cycles of an edge table of any size, without co-location.

    Peels what is on no cycle, then colours: every node takes the greatest node that
    reaches it; nodes that the colour's own node can be reached from, within the
    colour, form one strongly connected component and leave.
    """
    e = edges.select(F.col(parent).alias("u"), F.col(child).alias("v")).where("u is not null and v is not null").distinct()
    return e.where("u = v").select(F.col("u").alias("node_id")).union(_strong(e.where("u <> v")).select("node_id")).distinct()


def _strong(e: DataFrame) -> DataFrame:
    """(node_id, scc) of the strongly connected components of two or more nodes of edges u, v without self links."""
    found = [e.select(F.col("u").alias("node_id"), F.col("u").alias("scc")).limit(0)]
    e = _peel(e)
    while not e.isEmpty():
        colour = e.select("u").union(e.select("v")).distinct().select("u", F.col("u").alias("c"))
        while True:
            come = e.join(colour, "u").groupBy(F.col("v").alias("u")).agg(F.max("c").alias("d"))
            new = cut_lineage(colour.join(come, "u", "left").select("u", F.greatest("c", "d").alias("c"), (F.col("d") > F.col("c")).alias("moved")))
            colour = new.select("u", "c")
            if new.where("moved").isEmpty():
                break
        inner = e.join(colour, "u").join(colour.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v").where("c = cv").select("u", "v", "c")
        inner = cut_lineage(inner)
        reach = colour.where("u = c").select("u", "c")
        front = reach
        while True:
            front = cut_lineage(inner.join(front.select(F.col("u").alias("v"), "c"), ["v", "c"]).select("u", "c").distinct().join(reach, ["u", "c"], "left_anti"))
            if front.isEmpty():
                break
            reach = cut_lineage(reach.union(front))
        # a colour alone is on no cycle: self links were taken off
        many = reach.groupBy("c").count().where("count > 1").select("c")
        found.append(cut_lineage(reach.join(many, "c", "left_semi").select(F.col("u").alias("node_id"), F.col("c").alias("scc"))))
        gone = reach.select("u")
        e = _peel(e.join(gone, "u", "left_anti").join(gone.select(F.col("u").alias("v")), "v", "left_anti").select("u", "v"))
    return reduce(DataFrame.union, found)


def edge_hierarchy(edges: DataFrame, parent: str = "parent", child: str = "child", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(component, root, node_id, depth, path, on_cycle, descendants): hierarchy of an edge table.

    Components of up to local_edges edges are co-located and searched in one task
    each; larger ones grow by a frontier join per level, so a component of a third of
    all rows stays spread. Both give the same rows. Null ends are no links, repeated
    links count once, an empty table gives no row, other columns are not read.
    """
    e = edges.select(F.col(parent).cast("string").alias("u"), F.col(child).cast("string").alias("v")).where("u is not null and v is not null").distinct()
    comp = cut_lineage(connected_components(e, "u", "v"))
    tagged = e.join(comp.select(F.col("node").alias("u"), "component"), "u")
    size = tagged.groupBy("component").agg(F.count("*").alias("n"))
    small = tagged.join(size.where(F.col("n") <= local_edges), "component", "left_semi")
    large = tagged.join(size.where(F.col("n") > local_edges), "component", "left_semi")
    ddl = "component string, root string, node_id string, depth long, path array<string>, on_cycle boolean, descendants array<string>"

    def search(pdf):
        import pandas as pd

        links: dict[str, list[str]] = {}
        for u, v in zip(pdf["u"], pdf["v"]):
            links.setdefault(u, []).append(v)
        links = {u: sorted(vs) for u, vs in sorted(links.items())}
        nodes = sorted(set(links) | {v for vs in links.values() for v in vs})
        scc, cyclic, _ = colour_search(links, nodes)
        below = {n: descendants(links, n) for n in nodes}
        out = [(pdf["component"].iloc[0], root, p[-1], len(p) - 1, list(p), p[-1] in cyclic, below[p[-1]]) for root in start_nodes(links, nodes, scc) for p in paths(links, root)]
        return pd.DataFrame(out, columns=["component", "root", "node_id", "depth", "path", "on_cycle", "descendants"])

    done = small.groupBy("component").applyInPandas(search, ddl)
    if large.isEmpty():
        return done
    large = cut_lineage(large)
    inner = large.where("u <> v").select("u", "v")
    strong = cut_lineage(_strong(inner))
    cyclic = cut_lineage(strong.select("node_id").union(large.where("u = v").select("u")).distinct())
    # as start_nodes: the least node of each strongly connected component that nothing else links to
    nodes = large.select("component", F.col("u").alias("node_id")).union(large.select("component", "v")).distinct()
    label = cut_lineage(nodes.join(strong, "node_id", "left").select("component", "node_id", F.coalesce("scc", "node_id").alias("scc")))
    ends = inner.join(label.select(F.col("node_id").alias("u"), F.col("scc").alias("a")), "u").join(label.select(F.col("node_id").alias("v"), "scc"), "v")
    roots = label.join(ends.where("a <> scc").select("scc"), "scc", "left_anti").groupBy("component", "scc").agg(F.min("node_id").alias("node_id"))
    level: Column = F.lit(0).cast("long")
    front = cut_lineage(roots.select("component", F.col("node_id").alias("root"), "node_id", level.alias("depth"), F.array("node_id").alias("path")))
    levels = []
    while not front.isEmpty():
        levels.append(front)
        step = front.join(large.select(F.col("u").alias("node_id"), "v"), "node_id").where(~F.array_contains("path", F.col("v")))
        front = cut_lineage(step.select("component", "root", F.col("v").alias("node_id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("v")).alias("path")))
    grown = reduce(DataFrame.union, levels)
    # a node has below it what follows a node of its own strongly connected component on some
    # path (a path from a root through it may have met the rest before), and that component
    follows = grown.select(F.explode("path").alias("w"), F.col("node_id").alias("y")).where("w <> y").distinct()
    follows = follows.join(label.select(F.col("node_id").alias("w"), "scc"), "w").select("scc", "y")
    members = label.join(cyclic, "node_id", "left_semi").select("scc", F.col("node_id").alias("y"))
    below = follows.union(members).groupBy("scc").agg(F.array_sort(F.collect_set("y")).alias("descendants"))
    of_node = label.join(below, "scc", "left").select("node_id", F.coalesce("descendants", F.array().cast("array<string>")).alias("descendants"))
    grown = grown.join(cyclic.withColumn("on_cycle", F.lit(True)), "node_id", "left").join(of_node, "node_id")
    return done.union(grown.select("component", "root", "node_id", "depth", "path", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"), "descendants"))
