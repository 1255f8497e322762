"""Dependency slices: which statements a definition needs, across files.

Uses meet definitions by an as-of join (the last definition before the use; for names
inside functions and classes the last of the file). Imports lead to the end of the file
they resolve to. Reachability is a semi-naive loop over the edge table.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import parent_identifier
from ..session import cut_lineage
from . import extract, imports

#: Fronts of a search that are kept apart before they are written as one.
MANY_FRONTS = 8
#: Ranked statements that leave a worker as one batch.
RANKED_ROWS = 10_000


def last_before(uses: DataFrame, defs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """uses with `before`: the greatest order among defs of the same keys that is strictly less.

    One shuffle on the keys: both sides are stacked and the last definition is carried
    forward by a window, instead of joining every use with every definition.
    """
    u = uses.select(*keys, order, F.lit(True).alias("is_use")).distinct()
    d = defs.select(*keys, order, F.lit(False).alias("is_use")).distinct()
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    both = u.unionByName(d)
    carried = both.withColumn("before", F.max(F.when(~F.col("is_use"), F.col(order))).over(w))
    return carried.where("is_use").drop("is_use")


def edges(files: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """repo_id, src_path, src_idx, dst_path, dst_idx, symbol: statement needs statement.

    A symbol that no definition explains goes to the wildcard imports of its file and to its
    last definition in the files they lead to. An import whose file is known needs the last
    definition of the imported name there, or of the bound name where a module is
    imported; imports inside a definition are needed by it. calls (repo_id, caller,
    callee: unit ids, as file_calls gives them) adds what definitions call.
    """
    files = extract.parse_once(files, "outline", "imports")
    s = extract.outline(files).select("file_no", "repo_id", "rel_path", "module_id", "idx", "orig_idx", "kind", "defines", "uses", "late", "is_wildcard")
    defs = s.select("repo_id", "rel_path", "idx", F.explode("defines").alias("symbol"))
    uses = s.select("repo_id", "rel_path", "idx", "late", F.explode("uses").alias("symbol"))
    keys = ["repo_id", "rel_path", "symbol"]
    strict = uses.where("not late").join(last_before(uses.where("not late"), defs, keys, "idx"), [*keys, "idx"])
    ends = defs.groupBy(*keys).agg(F.max("idx").alias("before"))
    late = uses.where("late").join(ends, keys, "left")
    both = strict.select(*keys, "idx", "before").unionByName(late.select(*keys, "idx", "before"))
    source = lambda idx="idx": ["repo_id", F.col("rel_path").alias("src_path"), F.col(idx).alias("src_idx")]
    hit = both.where("before is not null").select(*source(), F.col("rel_path").alias("dst_path"), F.col("before").alias("dst_idx"), "symbol")
    known = imports.resolved(files).where("target is not null").select("file_no", "repo_id", "rel_path", "module", "level", "alias", "name", "is_top", "orig_idx", "target")
    end_there = ends.select("repo_id", F.col("rel_path").alias("target"), F.col("symbol").alias("name"), F.col("before").alias("dst_idx"))
    # what wildcards may explain: the import itself, and the definition where it leads
    wild = s.where("is_wildcard").select("repo_id", "rel_path", "orig_idx", F.col("idx").alias("dst_idx"))
    missed = both.where("before is null").select(*keys, "idx")
    to_wild = missed.join(wild, ["repo_id", "rel_path"]).select(*source(), F.col("rel_path").alias("dst_path"), "dst_idx", "symbol")
    stars = known.where("name = '*'").select("repo_id", "rel_path", "target").distinct()
    through = missed.join(stars, ["repo_id", "rel_path"]).withColumn("name", F.col("symbol")).join(end_there, ["repo_id", "target", "name"])
    through = through.select(*source(), F.col("target").alias("dst_path"), "dst_idx", "symbol")
    # imports of known files: the statement that binds the alias needs the name's last definition there
    named = known.where("coalesce(name, '') <> '*'").withColumn("wanted", F.coalesce("name", "alias"))
    bind = s.where("kind in ('Import', 'ImportFrom')").select("repo_id", "rel_path", "orig_idx", "idx", F.explode("defines").alias("alias"))
    top = bind.join(named.where("is_top").select("repo_id", "rel_path", "orig_idx", "alias", "wanted", "target").distinct(), ["repo_id", "rel_path", "orig_idx", "alias"])
    inner = s.where("late").select("repo_id", "rel_path", "orig_idx", "idx").join(named.where("not is_top").select("repo_id", "rel_path", "orig_idx", "alias", "wanted", "target").distinct(), ["repo_id", "rel_path", "orig_idx"])
    cols = ["repo_id", "rel_path", "idx", F.col("alias").alias("symbol"), F.col("wanted").alias("name"), "target"]
    far = top.select(*cols).unionByName(inner.select(*cols)).join(end_there, ["repo_id", "target", "name"])
    far = far.select(*source(), F.col("target").alias("dst_path"), "dst_idx", "symbol")
    out = hit.unionByName(to_wild).unionByName(through).unionByName(far)
    if calls is not None:
        units = s.where("late").select("repo_id", "rel_path", "idx", "module_id", F.get("defines", F.lit(0)).alias("symbol")).groupBy("repo_id", "rel_path", "module_id", "symbol").agg(F.max("idx").alias("idx"))
        of_unit = units.select("repo_id", F.concat_ws(".", "module_id", "symbol").alias("id"), "rel_path", "idx", "symbol")
        # a method stands in its class's statement
        tries = lambda c: F.explode(F.array(F.col(c), parent_identifier(c, 1))).alias("id")
        at = lambda c: calls.select("repo_id", "caller", "callee", tries(c)).join(of_unit, ["repo_id", "id"])
        a = at("caller").select("repo_id", "caller", "callee", F.col("rel_path").alias("src_path"), F.col("idx").alias("src_idx"))
        b = at("callee").select("repo_id", "caller", "callee", F.col("rel_path").alias("dst_path"), F.col("idx").alias("dst_idx"), "symbol")
        out = out.unionByName(a.join(b, ["repo_id", "caller", "callee"]).select("repo_id", "src_path", "src_idx", "dst_path", "dst_idx", "symbol"))
    return out.where("src_path <> dst_path or src_idx <> dst_idx").distinct()


def slices(edge_table: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """Distinct root_id, repo_id, path, idx reachable from seeds (root_id, repo_id, path, idx), seeds
    included; depth bounds the hops, None follows all. Cycles end, as only new statements go on.
    A hop writes its new statements only; what was seen before is the union of those."""
    e = cut_lineage(edge_table.select("repo_id", F.col("src_path").alias("path"), F.col("src_idx").alias("idx"), "dst_path", "dst_idx").distinct())
    front = cut_lineage(seeds.select("root_id", "repo_id", "path", "idx").distinct())
    fronts = [front]
    hop = 0
    while depth is None or hop < depth:
        hop += 1
        new = front.join(e, ["repo_id", "path", "idx"]).select("root_id", "repo_id", F.col("dst_path").alias("path"), F.col("dst_idx").alias("idx")).distinct()
        front = cut_lineage(new.join(reduce(DataFrame.unionByName, fronts), ["root_id", "repo_id", "path", "idx"], "left_anti"))
        if front.isEmpty():
            break
        fronts.append(front)
        if len(fronts) > MANY_FRONTS:  # keeps the union, and with it the plan, short
            fronts = [cut_lineage(reduce(DataFrame.unionByName, fronts))]
    return reduce(DataFrame.unionByName, fronts)


def unit_seeds(files: DataFrame) -> DataFrame:
    """root_id, repo_id, path, idx: the statement that defines each unit (methods by their class)."""
    s = extract.outline(files).where("kind in ('FunctionDef', 'AsyncFunctionDef', 'ClassDef')")
    return s.select(F.concat_ws(".", "module_id", F.get("defines", F.lit(0))).alias("root_id"), "repo_id", F.col("rel_path").alias("path"), "idx")


def _ranks(needs: dict) -> dict:
    """Node to its place when what a node needs goes first, from the smallest node on."""
    rank: dict = {}
    busy: set = set()
    for start in sorted(needs):
        if start in rank:
            continue
        busy.add(start)
        work = [(start, iter(sorted(needs[start])))]
        while work:
            node, todo = work[-1]
            nxt = next((x for x in todo if x in needs and x not in rank and x not in busy), None)
            if nxt is not None:
                busy.add(nxt)
                work.append((nxt, iter(sorted(needs[nxt]))))
            else:
                rank[node] = len(rank)
                work.pop()
    return rank


def _ranked(rows: list[tuple]) -> list[tuple]:
    """path, idx, rank, file_rank of one slice from its path, idx, dst_path, dst_idx."""
    needs: dict[tuple, set] = {}
    of_files: dict[str, set] = {}
    for p, i, q, j in rows:
        own = needs.setdefault((p, i), set())
        files = of_files.setdefault(p, set())
        if q is not None and j is not None:
            own.add((q, j))
            if q != p:
                files.add(q)
    whole = _ranks(of_files)
    return [(p, i, r, whole[p]) for (p, i), r in _ranks(needs).items()]


def topological(edge_table: DataFrame, slice_rows: DataFrame) -> DataFrame:
    """slice_rows with rank and file_rank: dependencies before what needs them, of statements and of
    files, ties by path and index; links that close a cycle don't count.

    The slices of a partition pass through one Arrow stream in the order of their roots, as
    most hold a statement or two; one at a time is held, bounded by its repository's statements.
    """
    e = edge_table.select("repo_id", F.col("src_path").alias("path"), F.col("src_idx").alias("idx"), "dst_path", "dst_idx")
    joined = slice_rows.select("repo_id", "root_id", "path", "idx").join(e, ["repo_id", "path", "idx"], "left")
    kinds = [("root_id", pa.string()), ("repo_id", pa.string()), ("path", pa.string()), ("idx", pa.int64()), ("rank", pa.int64()), ("file_rank", pa.int64())]

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        out: list[tuple] = []
        for (repo, root), group in groupby(rows(), itemgetter(0, 1)):
            out += ((root, repo, *x) for x in _ranked([r[2:] for r in group]))
            if len(out) >= RANKED_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out), kinds)], schema=pa.schema(kinds))
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out), kinds)], schema=pa.schema(kinds))

    keys = ["repo_id", "root_id"]
    stream = joined.select(*keys, "path", F.col("idx").cast("long").alias("idx"), "dst_path", F.col("dst_idx").cast("long").alias("dst_idx")).repartition(*keys).sortWithinPartitions(*keys)
    return stream.mapInArrow(run, "root_id string, repo_id string, path string, idx long, rank long, file_rank long")


def unparsed(files: DataFrame, slice_rows: DataFrame, style: str = "markdown") -> DataFrame:
    """repo_id, root_id, context: the slice's statements by file and index, each original statement
    once. Files come in the order of file_rank where slice_rows has it (topological), else by
    path; the root's own file comes last. Style markdown fences files, comment heads them
    with a comment."""
    s = extract.statements(files).select("repo_id", F.col("rel_path").alias("path"), "module_id", "idx", "orig_idx", "code")
    place = F.col("file_rank") if "file_rank" in slice_rows.columns else F.lit(0).cast("long")
    keys = ["repo_id", "root_id", "path", "module_id"]
    rows = slice_rows.withColumn("place", place).join(s, ["repo_id", "path", "idx"]).groupBy(*keys, "orig_idx").agg(F.min("idx").alias("idx"), F.min_by("code", "idx").alias("code"), F.min("place").alias("place"))
    per = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "code"))), lambda x: x["code"]), "\n\n").alias("code"), F.min("place").alias("place"))
    own = F.col("root_id").startswith(F.concat("module_id", F.lit(".")))
    body = formatted(F.col("path"), F.col("code"), style)
    files_ = F.array_sort(F.collect_list(F.struct(own.alias("own"), "place", "path", body.alias("text"))))
    return per.groupBy("repo_id", "root_id").agg(F.array_join(F.transform(files_, lambda x: x["text"]), "\n\n").alias("context"))


def formatted(path, code, style: str = "markdown"):
    """A file's code under its path, fenced (markdown) or headed by a comment."""
    if style == "markdown":
        return F.concat(F.lit("```python\n# "), path, F.lit("\n"), code, F.lit("\n```"))
    return F.concat(F.lit("# "), path, F.lit("\n"), code)
