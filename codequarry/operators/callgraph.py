"""Call graphs as edge and node tables, and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import parent_identifier

#: Text form of a stored graph: bare adjacency, or adjacency beside types.
ADJACENCY, TYPES = "map<string,array<string>>", "map<string,string>"


def from_json(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """keys, graph, id2type of JSON texts in either form; null where a text holds neither."""
    inner = F.get_json_object(text, "$.graph")
    return df.select(*keys, F.from_json(F.coalesce(inner, F.col(text)), ADJACENCY).alias("graph"), F.from_json(F.get_json_object(text, "$.id2type"), TYPES).alias("id2type"))


def edges(graphs: DataFrame) -> DataFrame:
    """graph_no, caller, callee, ord: one row per stored link, repeated links too; repeated rows once."""
    one = graphs.dropDuplicates(["graph_no"]).select("graph_no", F.explode("graph").alias("caller", "callees"))
    return one.select("graph_no", "caller", F.posexplode("callees").alias("ord", "callee")).select("graph_no", "caller", "callee", F.col("ord").cast("long").alias("ord")).where("callee is not null")


def nodes(graphs: DataFrame) -> DataFrame:
    """Distinct graph_no, node_id, elem_type over callers, callees and typed ids; OTHER without a type."""
    one = graphs.dropDuplicates(["graph_no"])
    ids = one.select("graph_no", F.explode(F.array_union(F.map_keys("graph"), F.flatten(F.map_values("graph")))).alias("node_id"))
    types = one.select("graph_no", F.explode("id2type").alias("node_id", "elem_type"))
    return ids.where("node_id is not null").union(types.select("graph_no", "node_id")).distinct().join(types.distinct(), ["graph_no", "node_id"], "left").select("graph_no", "node_id", F.coalesce("elem_type", F.lit("OTHER")).alias("elem_type"))


def callee_counts(graphs: DataFrame) -> DataFrame:
    """Out-degree of every node, repeated links counted, 0 for leaves."""
    return nodes(graphs).join(edges(graphs).groupBy("graph_no", F.col("caller").alias("node_id")).agg(F.count("*").alias("n")), ["graph_no", "node_id"], "left").select("graph_no", "node_id", F.coalesce("n", F.lit(0)).alias("n_callees"))


def typed_callees(graphs: DataFrame) -> DataFrame:
    """graph_no, caller, callee, callee_type: distinct links with the callee's type."""
    t = nodes(graphs).withColumnRenamed("node_id", "callee").withColumnRenamed("elem_type", "callee_type")
    return edges(graphs).select("graph_no", "caller", "callee").distinct().join(t, ["graph_no", "callee"]).select("graph_no", "caller", "callee", "callee_type")


def class_methods(graphs: DataFrame) -> DataFrame:
    """graph_no, class_id, method_id: nodes one segment below a CLASS node. The prefix condition
    is rewritten to an equality with the parent's identifier."""
    n = nodes(graphs)
    classes = n.where("elem_type = 'CLASS'").select("graph_no", F.col("node_id").alias("class_id"))
    return n.select("graph_no", F.col("node_id").alias("method_id"), parent_identifier("node_id").alias("class_id")).join(classes, ["graph_no", "class_id"]).select("graph_no", "class_id", "method_id")


def callees_of_classes(graphs: DataFrame) -> DataFrame:
    """Distinct graph_no, node_id, callee; a class has its own and its methods' callees."""
    e = edges(graphs).select("graph_no", F.col("caller").alias("node_id"), "callee")
    through = class_methods(graphs).join(e.withColumnRenamed("node_id", "method_id"), ["graph_no", "method_id"]).select("graph_no", F.col("class_id").alias("node_id"), "callee")
    return e.union(through).distinct()


def merged(graphs: DataFrame, callers: DataFrame) -> DataFrame:
    """Distinct callees of any of the callers (graph_no, caller)."""
    return edges(graphs).join(callers.select("graph_no", "caller").distinct(), ["graph_no", "caller"], "left_semi").select("graph_no", "callee").distinct()


def drop_unresolvable(graphs: DataFrame, known: DataFrame) -> DataFrame:
    """Links whose caller lies in a known module (module_id): the id without one or two segments."""
    modules = known.select(F.col("module_id").alias("m")).where("m is not null").distinct()
    e = edges(graphs)
    tries = e.select("graph_no", "caller", F.explode(F.array(parent_identifier("caller", 1), parent_identifier("caller", 2))).alias("m"))
    good = tries.join(modules, "m", "left_semi").select("graph_no", "caller").distinct()
    return e.join(good, ["graph_no", "caller"], "left_semi")


def unresolvable_ids(graphs: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct graph_no, node_id of nodes that lie in no known module."""
    modules = known.select(F.col("module_id").alias("m")).where("m is not null").distinct()
    n = nodes(graphs).select("graph_no", "node_id")
    tries = n.select("graph_no", "node_id", F.explode(F.array(parent_identifier("node_id", 1), parent_identifier("node_id", 2))).alias("m"))
    return n.join(tries.join(modules, "m", "left_semi").select("graph_no", "node_id").distinct(), ["graph_no", "node_id"], "left_anti")


def normalised(graphs: DataFrame, exports: DataFrame) -> DataFrame:
    """Links with status: callees that exports (module_id, name, target) re-export are rewritten.
    ok: a caller or typed id; rewritten: found through an import; unresolved: neither."""
    known = nodes(graphs).where("elem_type <> 'OTHER'").select("graph_no", F.col("node_id").alias("callee"), F.lit(True).alias("known"))
    e = edges(graphs).join(known, ["graph_no", "callee"], "left")
    x = exports.select(F.concat_ws(".", "module_id", "name").alias("callee"), "target").dropDuplicates(["callee"])
    e = e.join(x, "callee", "left")
    state = F.when(F.col("known"), "ok").when(F.col("target").isNotNull(), "rewritten").otherwise("unresolved")
    return e.select("graph_no", "caller", F.when(state == "rewritten", F.col("target")).otherwise(F.col("callee")).alias("callee"), "ord", state.alias("status"))


def without_empty(graphs: DataFrame) -> DataFrame:
    """graphs whose keys without callees are dropped."""
    return graphs.withColumn("graph", F.map_filter("graph", lambda k, v: F.size(v) > 0))


def to_maps(edge_table: DataFrame) -> DataFrame:
    """graph_no, graph: the adjacency of an edge table, callees by ord, as one map per graph."""
    per = edge_table.groupBy("graph_no", "caller").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "callee"))), lambda x: x["callee"]).alias("callees"))
    return per.groupBy("graph_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("caller", "callees")))).alias("graph"))


def reachable(graphs: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Distinct graph_no, root, node_id, least hops (up to depth) from each seed (graph_no, root).

    Semi-naive: each hop joins the links with the last hop's new nodes only, so cycles end.
    """
    from ..session import cut_lineage

    e = edges(graphs).select("graph_no", F.col("caller").alias("node_id"), "callee").distinct()
    front = seeds.select("graph_no", "root", F.col("root").alias("node_id"), F.lit(0).cast("long").alias("hops")).distinct()
    seen = front
    for hop in range(1, depth + 1):
        new = front.join(e, ["graph_no", "node_id"]).select("graph_no", "root", F.col("callee").alias("node_id")).distinct()
        front = cut_lineage(new.join(seen, ["graph_no", "root", "node_id"], "left_anti").withColumn("hops", F.lit(hop).cast("long")))
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front))
    return seen
