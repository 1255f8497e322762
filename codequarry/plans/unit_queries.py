"""Queries of the extraction, identifier, import, call graph, slice and context operators."""

from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..operators import callgraph, context, extract, imports, slicing
from ..session import cut_lineage, load
from ..sources import tables


def _files(s, d):
    return load(s, d, "files")


def _graphs(s, d):
    return load(s, d, "call_graphs")


def identifiers(s, d):
    f = _files(s, d).select("file_no", "rel_path").distinct()
    ident = ids.identifier_from_path("rel_path")
    return f.select("file_no", ident.alias("module_id"), ids.parent_identifier(ident).alias("parent"), ids.parent_identifier(ident, 2).alias("grandparent"), ids.last_segment(ident).alias("name"), ids.path_from_identifier(ident).alias("path"))


def repo_ids(s, d):
    r = load(s, d, "repos")
    url = F.concat(F.lit("https://host.example/"), F.coalesce("repo_org", F.lit("none")), F.lit("/"), "repo_name", F.lit(".git/"))
    return r.select("repo_id", ids.repo_id_from_url(F.regexp_replace(url, r"\.git/$", ".git")).alias("from_url"), ids.repo_id_from_local("local_repo_path").alias("from_local"), ids.repo_part("repo_id", "org").alias("org"), ids.repo_part("repo_id", "name").alias("name"), ids.callgraph_path("repo_id", "graphs").alias("graph_path"))


def hidden_files(s, d):
    return _files(s, d).select("file_no", "rel_path").distinct().where(ids.is_hidden("rel_path"))


def units_union(s, d):
    f = load(s, d, "code_functions").select("unit_no", F.lit("function").alias("unit_kind"), F.col("function_id.identifier").alias("unit_id"), F.coalesce("function_name", ids.last_segment("function_id.identifier")).alias("name"), F.lit(None).cast("string").alias("class_id"))
    m = load(s, d, "code_methods").select("unit_no", F.lit("method").alias("unit_kind"), F.col("method_id.identifier").alias("unit_id"), F.coalesce("method_name", ids.last_segment("method_id.identifier")).alias("name"), F.coalesce("parent_class_id.identifier", ids.parent_identifier("method_id.identifier")).alias("class_id"))
    return f.unionByName(m).distinct()


def units_topk(s, d):
    """The report "ten longest functions of each repository", ties by unit_no."""
    from pyspark.sql import Window

    f = load(s, d, "code_functions").where("function_code is not null").select("repo_id", "unit_no", F.length("function_code").cast("long").alias("n_chars")).distinct()
    w = Window.partitionBy("repo_id").orderBy(F.col("n_chars").desc(), "unit_no")
    return f.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10")


def unit_lines(s, d):
    f = load(s, d, "code_functions").where("function_code is not null").select("unit_no", "function_code").distinct()
    return f.select("unit_no", F.size(F.split("function_code", "\n")).cast("long").alias("n_lines")).where(f"n_lines < {extract.FUNCTION_LINES}")


def name_filter(s, d):
    return units_union(s, d).where(extract.no_dunder() & extract.good_name()).select("unit_no", "name")


def decorator_filter(s, d):
    m = load(s, d, "code_methods").where("method_code is not null").select("unit_no", "method_code").distinct()
    found = F.filter(F.split("method_code", "\n"), lambda x: x.startswith("@"))
    m = m.select("unit_no", F.transform(found, lambda x: F.trim(F.regexp_replace(x, "^@", ""))).alias("decorators"))
    return m.where(extract.allowed_decorators(extract.METHOD_DECORATORS)).select("unit_no", F.size("decorators").cast("long").alias("n_decorators"))


def callee_filter(s, d):
    counts = callgraph.callee_counts(_graphs(s, d))
    return counts.where("n_callees > 0")


def elided_code(s, d):
    f = load(s, d, "code_functions").where("function_code is not null").select("unit_no", "function_code").distinct()
    return f.select("unit_no", ids.elide("function_code").alias("shown"), ids.shorten("function_code", 100).alias("short"))


def array_summaries(s, d):
    e = load(s, d, "embeddings")
    big = F.size("embedding") > 25
    return e.select("vec_id", F.when(big, F.concat(F.lit("shape=("), F.size("embedding").cast("string"), F.lit(",)"))).otherwise(F.to_json(F.transform("embedding", lambda x: F.round(x, 2)))).alias("summary"))


def batches(s, d):
    """Fixed chunks of 100 repositories in id order: batch, size, first and last id."""
    from pyspark.sql import Window

    r = load(s, d, "repos").select("repo_id").distinct()
    n = r.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("repo_id")) - 1) / 100).cast("long"))
    return n.groupBy("batch").agg(F.count("*").alias("n"), F.min("repo_id").alias("first_id"), F.max("repo_id").alias("last_id"))


def image_recipe(s, d):
    return load(s, d, "repos").agg(F.countDistinct("repo_id").cast("int").alias("n")).select(tables.image_recipe(F.col("n"), 100).alias("recipe"))


def graph_roundtrip(s, d):
    g = callgraph.to_maps(callgraph.edges(_graphs(s, d)))
    return g.select("graph_no", F.explode("graph").alias("caller", "callees")).select("graph_no", "caller", F.array_join("callees", ",").alias("callees"))


def graph_merge(s, d):
    roots = callgraph.nodes(_graphs(s, d)).where("elem_type = 'CLASS'").select("graph_no", F.col("node_id").alias("caller"))
    return callgraph.merged(_graphs(s, d), roots)


def _known(s, d):
    """The modules of functions that are called."""
    t = callgraph.typed_callees(_graphs(s, d)).where("callee_type = 'FUNCTION'")
    return t.select(ids.parent_identifier("callee").alias("module_id"))


def graph_known(s, d):
    known = _known(s, d)
    return callgraph.drop_unresolvable(_graphs(s, d), known).select("graph_no", "caller", "callee", "ord")


def graph_unresolved(s, d):
    known = _known(s, d)
    return callgraph.unresolvable_ids(_graphs(s, d), known)


def _classed(s, d):
    """The graphs with a CLASS for what every METHOD stands in."""
    methods = F.map_keys(F.map_filter("id2type", lambda k, v: v == "METHOD"))
    owners = F.array_except(F.array_distinct(F.transform(methods, lambda m: ids.parent_identifier(m))), F.map_keys("id2type"))
    return _graphs(s, d).withColumn("id2type", F.map_concat("id2type", F.map_from_entries(F.transform(owners, lambda o: F.struct(o, F.lit("CLASS"))))))


def reach3(s, d):
    g = _graphs(s, d)
    called = callgraph.edges(g).select("graph_no", F.col("callee").alias("node_id")).distinct()
    roots = callgraph.edges(g).select("graph_no", F.col("caller").alias("node_id")).distinct().join(called, ["graph_no", "node_id"], "left_anti").select("graph_no", F.col("node_id").alias("root"))
    return callgraph.reachable(g, roots, 3)


def asof_definitions(s, d):
    """For each purchase of a user, the last view before it."""
    e = load(s, d, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return slicing.last_before(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "t")


def context_naive(s, d):
    f = load(s, d, "code_functions").where("function_code is not null").select("unit_no", F.col("file.file_module.module_id.identifier").alias("m"), "function_code").distinct()
    path = ids.path_from_identifier("m")
    return f.where("m is not null").select("unit_no", slicing.formatted(path, F.col("function_code"), "markdown").alias("markdown"), slicing.formatted(path, F.col("function_code"), "comment").alias("comment"))


def context_budget(s, d):
    """Blocks of each file that fit 200 tokens, the last block with the highest claim."""
    f = _files(s, d).where("file_content is not null and rel_path like '%.py'").select(F.lit("").alias("repo_id"), F.col("file_no").cast("string").alias("unit_id"), F.lit(True).alias("is_own"), F.col("rel_path").alias("path"), F.regexp_replace("file_content", "\r\n|\r", "\n").alias("text")).distinct()
    blocks = F.filter(F.split("text", r"\n\n+"), lambda x: F.trim(x) != "")
    pieces = f.withColumn("blocks", blocks).select("repo_id", "unit_id", "is_own", "path", F.size("blocks").alias("n"), F.posexplode("blocks").alias("ord", "piece"))
    kept = context.within_budget(pieces.withColumn("is_target", F.col("ord") == F.col("n") - 1), 200)
    return kept.select("unit_id", F.col("ord").cast("long").alias("ord"), "tokens", "over_budget")


def local_paths(s, d):
    ids_ = load(s, d, "code_functions").select("repo_id", F.col("function_id.identifier").alias("identifier"))
    return imports.local_paths(_files(s, d), ids_)


def id_types(s, d):
    ids_ = _graphs(s, d).select("repo_id", F.explode(F.array_union(F.map_keys("graph"), F.flatten(F.map_values("graph")))).alias("identifier"))
    return imports.id_types(_files(s, d), ids_)


def slices(s, d):
    f = extract.parse_once(_files(s, d), "outline", "imports")
    return slicing.slices(slicing.edges(f), slicing.unit_seeds(f))


def slice_ranks(s, d):
    f = extract.parse_once(_files(s, d), "outline", "imports")
    e = cut_lineage(slicing.edges(f))
    return slicing.topological(e, slicing.slices(e, slicing.unit_seeds(f)))


def _contexts(s, d, kind, budget=6000):
    f = extract.parse_once(_files(s, d), "units", "imports", "statements", "blocks")
    return context.contexts(f, extract.extract_units(f), kind, budget)


def contexts_called(s, d):
    """Full contexts with the files of what a unit calls, at a tight budget."""
    f = extract.parse_once(_files(s, d), "units", "imports", "calls", "blocks")
    return context.contexts(f, extract.extract_units(f), "full", 300, calls=cut_lineage(imports.file_calls(f)))


def repository_graphs(s, d):
    g = imports.repository_graphs(_files(s, d))
    return g.select("repo_id", "id2type", F.explode("graph").alias("caller", "callees")).select("repo_id", "caller", F.array_join("callees", ",").alias("callees"), F.col("id2type")[F.col("caller")].alias("caller_type"))


def _of_methods(s, d, df):
    """Rows of files that code_methods holds methods of: those parse, as SQL alone can't tell."""
    m = load(s, d, "code_methods").select("repo_id", F.col("file.file_module.module_id.identifier").alias("module_id")).distinct()
    return df.join(m, ["repo_id", "module_id"], "left_semi")


def method_imports(s, d):
    return _of_methods(s, d, extract.imports(_files(s, d))).where("is_top").select("file_no", "level", "module", "name", "alias")


def method_imports_resolved(s, d):
    return _of_methods(s, d, imports.resolved(_files(s, d))).where("is_top").select("file_no", "level", "module", "name", "alias", "target").distinct()


def method_imports_absolute(s, d):
    return _of_methods(s, d, imports.absolute(_files(s, d))).where("is_top").select("file_no", "module", "name", "alias").distinct()


def method_units(s, d):
    """The extracted methods that code_methods knows, with their decorators in number."""
    m = load(s, d, "code_methods").where("method_code is not null").select("repo_id", F.col("method_id.identifier").alias("unit_id")).distinct()
    u = extract.all_units(_files(s, d)).where("unit_kind = 'method'").join(m, ["repo_id", "unit_id"], "left_semi")
    return u.select("repo_id", "unit_id", "class_id", "name", F.size("decorators").cast("long").alias("n_decorators")).distinct()


QUERIES = {
    "method_imports": method_imports, "method_imports_resolved": method_imports_resolved, "method_imports_absolute": method_imports_absolute, "method_units": method_units,
    "local_paths": local_paths, "id_types": id_types, "identifiers": identifiers, "repo_ids": repo_ids, "hidden_files": hidden_files, "units_union": units_union, "units_topk": units_topk, "unit_lines": unit_lines, "name_filter": name_filter, "decorator_filter": decorator_filter,
    "callee_filter": callee_filter, "elided_code": elided_code, "array_summaries": array_summaries, "batches": batches, "image_recipe": image_recipe,
    "graph_edges": lambda s, d: callgraph.edges(_graphs(s, d)), "graph_nodes": lambda s, d: callgraph.nodes(_graphs(s, d)), "graph_typed_callees": lambda s, d: callgraph.typed_callees(_graphs(s, d)),
    "graph_class_methods": lambda s, d: callgraph.class_methods(_classed(s, d)), "graph_class_callees": lambda s, d: callgraph.callees_of_classes(_classed(s, d)), "graph_roundtrip": graph_roundtrip, "graph_merge": graph_merge,
    "graph_known": graph_known, "graph_unresolved": graph_unresolved, "reach3": reach3, "asof_definitions": asof_definitions, "context_naive": context_naive, "context_budget": context_budget,
    "extract_status": lambda s, d: extract.parse_status(_files(s, d)), "extract_all": lambda s, d: extract.all_units(_files(s, d)).select("file_no", "unit_id", "def_ord", "unit_kind", "name", "n_args", "n_body", "n_code_lines", "docstring"),
    "extract_units": lambda s, d: extract.extract_units(_files(s, d), load(s, d, "call_graphs").select("repo_id", "graph")).select("file_no", "unit_id", "def_ord", "unit_kind", "name"),
    "module_members": lambda s, d: extract.members(_files(s, d)).select("file_no", "ord", "name"), "module_imports": lambda s, d: extract.imports(_files(s, d)).select("file_no", "level", "module", "name", "alias", "is_top"),
    "imports_resolved": lambda s, d: imports.resolved(_files(s, d)).select("file_no", "level", "module", "name", "alias", "target"), "imports_absolute": lambda s, d: imports.absolute(_files(s, d)).select("file_no", "module", "name", "alias"),
    "packages": lambda s, d: imports.packages(_files(s, d)), "file_calls": lambda s, d: imports.file_calls(_files(s, d)),
    "statements": lambda s, d: extract.statements(_files(s, d)).select("file_no", "idx", "orig_idx", "kind", "code", F.array_join("uses", ",").alias("uses")),
    "slice_edges": lambda s, d: slicing.edges(_files(s, d)), "slices": slices, "slice_ranks": slice_ranks, "contexts_sliced": lambda s, d: _contexts(s, d, "sliced"), "contexts_full": lambda s, d: _contexts(s, d, "full"),
    "contexts_naive": lambda s, d: _contexts(s, d, "naive"), "contexts_called": contexts_called, "repository_graphs": repository_graphs, "imports_rewritten": lambda s, d: imports.rewritten(_files(s, d)), "module_exports": lambda s, d: imports.exports(_files(s, d)),
}

#: The imports at the top level of the modules that methods come from, by the lines they stand in.
_IMPORTS = r"""m AS (SELECT DISTINCT repo_id, file.file_module.module_id.identifier AS module_id FROM code_methods WHERE file.file_module.module_id.identifier IS NOT NULL),
mf AS (SELECT DISTINCT x.file_no, x.repo_id, x.rel_path, regexp_replace(x.file_content, '\r\n|\r', chr(10), 'g') AS t FROM files x JOIN m ON m.repo_id = x.repo_id AND m.module_id = replace(regexp_replace(x.rel_path, '\.py$', ''), '/', '.') WHERE x.rel_path LIKE '%.py' AND NOT regexp_matches(x.rel_path, '(^|/)\.')),
is1 AS (SELECT file_no, unnest(regexp_extract_all(t, '(?m)^(?:import [^\n]+|from [.\w]+ import (?:\([^)]*\)|[^\n(]+))')) AS s FROM mf),
is2 AS (SELECT file_no, starts_with(s, 'from') AS is_from, regexp_extract(s, '^from (\.*)', 1) AS dots, regexp_extract(s, '^from \.*([\w.]*) import', 1) AS m, regexp_replace(regexp_replace(regexp_replace(s, '^(?:import|from [.\w]+ import)\s*\(?', ''), '#[^\n]*', '', 'g'), '\)\s*$', '') AS names FROM is1),
is3 AS (SELECT *, trim(unnest(string_split(names, ',')), ' ' || chr(10) || chr(9)) AS n FROM is2),
imp AS (SELECT file_no, CASE WHEN is_from THEN length(dots) ELSE 0 END::BIGINT AS level, CASE WHEN is_from THEN nullif(m, '') ELSE regexp_extract(n, '^[\w.]+') END AS module, CASE WHEN is_from THEN regexp_extract(n, '^(?:\w+|\*)') END AS name, CASE WHEN regexp_matches(n, ' as ') THEN regexp_extract(n, ' as (\w+)', 1) WHEN is_from THEN regexp_extract(n, '^(?:\w+|\*)') ELSE regexp_extract(n, '^\w+') END AS alias FROM is3 WHERE n <> '')"""
_PACKAGES = """pf AS (SELECT DISTINCT file_no, repo_id, regexp_replace(rel_path, '/?[^/]*$', '') AS dir FROM files WHERE rel_path LIKE '%.py'), p AS (SELECT DISTINCT repo_id, regexp_replace(rel_path, '/?[^/]*$', '') AS dir FROM files WHERE regexp_matches(rel_path, '(^|/)__init__\\.py$')),
 d AS (SELECT *, string_split(dir, '/') AS parts, CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS depth FROM pf), u AS (SELECT *, unnest(range(0, depth + 1)) AS ups FROM d), a AS (SELECT *, array_to_string(list_slice(parts, 1, depth - ups), '/') AS anc FROM u),
 r AS (SELECT a.file_no, a.parts, a.depth, coalesce(min(CASE WHEN p.dir IS NULL THEN a.ups END), a.depth) AS ups FROM a LEFT JOIN p ON p.repo_id = a.repo_id AND p.dir = a.anc GROUP BY a.file_no, a.parts, a.depth),
 k AS (SELECT file_no, array_to_string(list_slice(parts, 1, depth - ups), '/') AS package_root, CASE WHEN ups = 0 THEN parts[-1] ELSE array_to_string(list_slice(parts, depth - ups + 1, depth), '.') END AS package FROM (SELECT file_no, parts, depth, min(ups) AS ups FROM r GROUP BY file_no, parts, depth))"""

_EDGES = """
WITH RECURSIVE g AS (SELECT graph_no, any_value(graph) AS graph, any_value(id2type) AS id2type FROM call_graphs GROUP BY graph_no),
e0 AS (SELECT graph_no, unnest(map_entries(graph)) AS e FROM g),
e1 AS (SELECT graph_no, e.key AS caller, unnest(e.value) AS callee, unnest(range(len(e.value))) AS ord FROM e0),
e AS (SELECT * FROM e1 WHERE callee IS NOT NULL),
t0 AS (SELECT graph_no, unnest(map_entries(id2type)) AS t FROM g), t AS (SELECT graph_no, t.key AS node_id, t.value AS elem_type FROM t0),
ids AS (SELECT graph_no, e.key AS node_id FROM e0 UNION SELECT graph_no, callee FROM e UNION SELECT graph_no, node_id FROM t),
nodes AS (SELECT ids.graph_no, ids.node_id, coalesce(t.elem_type, 'OTHER') AS elem_type FROM ids LEFT JOIN t ON t.graph_no = ids.graph_no AND t.node_id = ids.node_id)"""

_PARENT = "array_to_string(list_slice(string_split({0}, '.'), 1, greatest(len(string_split({0}, '.')) - {1}, 0)), '.')"
_IDENT = "replace(regexp_replace(rel_path, '\\.py$', ''), '/', '.')"
_METHODS = ", cs AS (SELECT graph_no, node_id FROM nodes WHERE elem_type = 'CLASS' UNION SELECT graph_no, " + _PARENT.format("node_id", 1) + " FROM t WHERE elem_type = 'METHOD' AND " + _PARENT.format("node_id", 1) + " NOT IN (SELECT x.node_id FROM t x WHERE x.graph_no = t.graph_no)), ns AS (SELECT graph_no, node_id FROM nodes UNION SELECT graph_no, node_id FROM cs), cm AS (SELECT n.graph_no, c.node_id AS class_id, n.node_id AS method_id FROM ns n JOIN cs c ON c.graph_no = n.graph_no AND c.node_id = " + _PARENT.format("n.node_id", 1) + ")"
_UNITS = f"""SELECT DISTINCT unit_no, 'function' AS unit_kind, function_id.identifier AS unit_id, coalesce(function_name, string_split(function_id.identifier, '.')[-1]) AS name, NULL::VARCHAR AS class_id FROM code_functions
 UNION SELECT DISTINCT unit_no, 'method', method_id.identifier, coalesce(method_name, string_split(method_id.identifier, '.')[-1]), coalesce(parent_class_id.identifier, {_PARENT.format('method_id.identifier', 1)}) FROM code_methods"""
_PREFIX = " OR ".join(f"starts_with(lower(name), '{p}')" for p in extract.NAME_PREFIXES)
_KNOWN = ", k AS (SELECT DISTINCT " + _PARENT.format("callee", 1) + " AS m FROM e JOIN nodes n ON n.graph_no = e.graph_no AND n.node_id = e.callee AND n.elem_type = 'FUNCTION')"
_CODE = "SELECT DISTINCT unit_no, function_code AS c FROM code_functions WHERE function_code IS NOT NULL"

SQL = {
    "packages": "WITH " + _PACKAGES + " SELECT file_no, package_root, package FROM k",
    "method_imports": "WITH " + _IMPORTS + " SELECT file_no, level, module, name, alias FROM imp",
    "method_imports_absolute": "WITH " + _IMPORTS + ", " + _PACKAGES + """ SELECT DISTINCT file_no, CASE WHEN level = 0 THEN module ELSE concat_ws('.', nullif(array_to_string(list_slice(string_split(package, '.'), 1, greatest(len(string_split(package, '.')) - level + 1, 0)), '.'), ''), module) END AS module, name, alias FROM imp JOIN k USING (file_no)""",
    "method_imports_resolved": "WITH " + _IMPORTS + ", " + _PACKAGES + """, i AS (SELECT DISTINCT imp.*, mf.repo_id, regexp_replace(mf.rel_path, '/?[^/]*$', '') AS dir, k.package_root FROM imp JOIN mf USING (file_no) JOIN k USING (file_no)),
 i2 AS (SELECT *, string_split(dir, '/') AS parts, CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS depth, row_number() OVER () AS no FROM i),
 bs AS (SELECT *, CASE WHEN level > 0 THEN [array_to_string(list_slice(parts, 1, greatest(depth - level + 1, 0)), '/')] ELSE list_concat([package_root], list_transform(range(0, depth + 1), lambda j: array_to_string(list_slice(parts, 1, depth - j), '/'))) END AS bases FROM i2),
 b1 AS (SELECT *, unnest(bases) AS base, unnest(range(len(bases))) AS prio FROM bs), b2 AS (SELECT *, CASE WHEN base = '' THEN replace(coalesce(module, ''), '.', '/') WHEN coalesce(module, '') = '' THEN base ELSE base || '/' || replace(module, '.', '/') END AS stem FROM b1),
 b3 AS (SELECT *, CASE WHEN name IS NOT NULL AND name <> '*' THEN CASE WHEN stem = '' THEN name ELSE stem || '/' || name END END AS inside FROM b2),
 t AS (SELECT no, repo_id, prio, unnest([inside || '.py', inside || '/__init__.py', stem || '.py', CASE WHEN stem = '' THEN '__init__.py' ELSE stem || '/__init__.py' END]) AS target, unnest([0, 1, 2, 3]) AS form FROM b3),
 known AS (SELECT DISTINCT repo_id, rel_path AS target FROM files), best AS (SELECT no, t.target FROM t JOIN known ON known.repo_id = t.repo_id AND known.target = t.target QUALIFY row_number() OVER (PARTITION BY no ORDER BY prio, form) = 1)
 SELECT DISTINCT file_no, level, module, name, alias, best.target FROM i2 LEFT JOIN best ON best.no = i2.no""",
    "method_units": """SELECT DISTINCT repo_id, method_id.identifier AS unit_id, regexp_replace(method_id.identifier, '\\.[^.]*$', '') AS class_id, string_split(method_id.identifier, '.')[-1] AS name,
 len(list_filter(string_split(method_code, chr(10)), lambda l: starts_with(l, '@')))::BIGINT AS n_decorators FROM code_methods WHERE method_code IS NOT NULL AND NOT regexp_matches(method_code, '(?m)^async def ')""",
    "local_paths": """WITH f AS (SELECT DISTINCT repo_id, rel_path AS path, replace(regexp_replace(regexp_replace(rel_path, '/__init__\\.py$', ''), '\\.py$', ''), '/', '.') AS prefix FROM files),
 b AS (SELECT repo_id, prefix, path FROM f QUALIFY row_number() OVER (PARTITION BY repo_id, prefix ORDER BY length(path), path) = 1), i AS (SELECT DISTINCT repo_id, function_id.identifier AS identifier FROM code_functions WHERE function_id.identifier IS NOT NULL),
 m AS (SELECT i.repo_id, i.identifier, b.path FROM i JOIN b ON b.repo_id = i.repo_id AND (i.identifier = b.prefix OR starts_with(i.identifier, b.prefix || '.')) QUALIFY row_number() OVER (PARTITION BY i.repo_id, i.identifier ORDER BY length(b.prefix) DESC) = 1)
 SELECT i.repo_id, i.identifier, m.path FROM i LEFT JOIN m ON m.repo_id = i.repo_id AND m.identifier = i.identifier""",
    "identifiers": f"WITH f AS (SELECT DISTINCT file_no, {_IDENT} AS module_id FROM files) SELECT file_no, module_id, {_PARENT.format('module_id', 1)} AS parent, {_PARENT.format('module_id', 2)} AS grandparent, string_split(module_id, '.')[-1] AS name, replace(module_id, '.', '/') || '.py' AS path FROM f",
    "repo_ids": """SELECT repo_id, CASE WHEN repo_name IS NOT NULL THEN coalesce(repo_org, 'none') || '___' || repo_name ELSE '' END AS from_url, 'LOCAL___' || string_split(regexp_replace(local_repo_path, '/+$', ''), '/')[-1] AS from_local,
 CASE WHEN len(string_split(repo_id, '___')) = 2 THEN string_split(repo_id, '___')[1] ELSE repo_id END AS org, CASE WHEN len(string_split(repo_id, '___')) = 2 THEN string_split(repo_id, '___')[2] ELSE repo_id END AS name, 'graphs/' || repo_id || '_cgraph.json' AS graph_path FROM repos""",
    "hidden_files": "SELECT DISTINCT file_no, rel_path FROM files WHERE regexp_matches(rel_path, '(^|/)\\.')",
    "units_union": _UNITS,
    "units_topk": "WITH f AS (SELECT DISTINCT repo_id, unit_no, length(function_code)::BIGINT AS n_chars FROM code_functions WHERE function_code IS NOT NULL) SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n_chars DESC, unit_no) AS rank FROM f QUALIFY rank <= 10",
    "unit_lines": f"WITH f AS ({_CODE}) SELECT unit_no, len(string_split(c, chr(10)))::BIGINT AS n_lines FROM f WHERE len(string_split(c, chr(10))) < 25",
    "name_filter": f"WITH u AS ({_UNITS}) SELECT unit_no, name FROM u WHERE NOT starts_with(name, '__') AND NOT ({_PREFIX})",
    "decorator_filter": """WITH m AS (SELECT DISTINCT unit_no, method_code FROM code_methods WHERE method_code IS NOT NULL), x AS (SELECT unit_no, list_transform(list_filter(string_split(method_code, chr(10)), lambda l: starts_with(l, '@')), lambda l: trim(substr(l, 2))) AS ds FROM m)
 SELECT unit_no, len(ds)::BIGINT AS n_decorators FROM x WHERE len(list_filter(ds, lambda y: y NOT IN ('staticmethod', 'classmethod'))) = 0""",
    "callee_filter": _EDGES + " SELECT graph_no, caller AS node_id, count(*) AS n_callees FROM e GROUP BY 1, 2",
    "elided_code": f"WITH f AS ({_CODE})" + """, w AS (SELECT unit_no, c, trim(regexp_replace(c, '\\s+', ' ', 'g')) AS t FROM f) SELECT unit_no, CASE WHEN length(c) > 180 THEN left(c, 90) || '  ......  ' || right(c, 90) ELSE c END AS shown,
 CASE WHEN length(t) <= 100 THEN t ELSE regexp_replace(substr(t, 1, 98), '\\s?\\S*$', '') || '...' END AS short FROM w""",
    "array_summaries": "SELECT vec_id, 'shape=(' || len(embedding) || ',)' AS summary FROM embeddings",
    "batches": "WITH r AS (SELECT DISTINCT repo_id FROM repos), n AS (SELECT repo_id, (row_number() OVER (ORDER BY repo_id) - 1) // 100 AS batch FROM r) SELECT batch, count(*) AS n, min(repo_id) AS first_id, max(repo_id) AS last_id FROM n GROUP BY 1",
    "image_recipe": """WITH n AS (SELECT count(DISTINCT repo_id)::INT AS n FROM repos), s AS (SELECT n, unnest(range(0, n, 100)) AS s FROM n)
 SELECT 'FROM python:3.11' || chr(10) || 'WORKDIR /install' || chr(10) || 'COPY . /install' || chr(10) || string_agg('RUN python install.py --start ' || s || ' --end ' || least(s + 100, n), chr(10) ORDER BY s) AS recipe FROM s""",
    "graph_edges": _EDGES + " SELECT graph_no, caller, callee, ord FROM e",
    "graph_nodes": _EDGES + " SELECT graph_no, node_id, elem_type FROM nodes",
    "graph_typed_callees": _EDGES + " SELECT DISTINCT e.graph_no, caller, callee, elem_type AS callee_type FROM e JOIN nodes n ON n.graph_no = e.graph_no AND n.node_id = e.callee",
    "graph_class_methods": _EDGES + _METHODS + " SELECT graph_no, class_id, method_id FROM cm",
    "graph_class_callees": _EDGES + _METHODS + " SELECT graph_no, caller AS node_id, callee FROM e UNION SELECT cm.graph_no, cm.class_id, e.callee FROM cm JOIN e ON e.graph_no = cm.graph_no AND e.caller = cm.method_id",
    "graph_roundtrip": _EDGES + " SELECT graph_no, caller, string_agg(callee, ',' ORDER BY ord) AS callees FROM e GROUP BY 1, 2",
    "graph_merge": _EDGES + " SELECT DISTINCT e.graph_no, callee FROM e JOIN nodes n ON n.graph_no = e.graph_no AND n.node_id = e.caller AND n.elem_type = 'CLASS'",
    "graph_known": _EDGES + _KNOWN + f" SELECT graph_no, caller, callee, ord FROM e WHERE {_PARENT.format('caller', 1)} IN (SELECT m FROM k) OR {_PARENT.format('caller', 2)} IN (SELECT m FROM k)",
    "graph_unresolved": _EDGES + _KNOWN + f" SELECT graph_no, node_id FROM nodes WHERE {_PARENT.format('node_id', 1)} NOT IN (SELECT m FROM k) AND {_PARENT.format('node_id', 2)} NOT IN (SELECT m FROM k)",
    "reach3": _EDGES + """, d AS (SELECT DISTINCT graph_no, caller, callee FROM e), roots AS (SELECT DISTINCT graph_no, caller AS root FROM d WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.graph_no = d.graph_no AND x.callee = d.caller)),
 p AS (SELECT graph_no, root, root AS node_id, 0 AS hops FROM roots UNION SELECT p.graph_no, p.root, d.callee, p.hops + 1 FROM p JOIN d ON d.graph_no = p.graph_no AND d.caller = p.node_id WHERE p.hops < 3)
 SELECT graph_no, root, node_id, min(hops)::BIGINT AS hops FROM p GROUP BY 1, 2, 3""",
    "asof_definitions": """WITH u AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'), v AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view')
 SELECT u.user_id, u.t, v.t AS "before" FROM u ASOF LEFT JOIN v ON v.user_id = u.user_id AND u.t > v.t""",
    "context_naive": """WITH f AS (SELECT DISTINCT unit_no, replace(file.file_module.module_id.identifier, '.', '/') || '.py' AS p, function_code AS c FROM code_functions WHERE function_code IS NOT NULL AND file.file_module.module_id.identifier IS NOT NULL)
 SELECT unit_no, '```python' || chr(10) || '# ' || p || chr(10) || c || chr(10) || '```' AS markdown, '# ' || p || chr(10) || c AS comment FROM f""",
    "context_budget": """WITH f AS (SELECT DISTINCT file_no::VARCHAR AS unit_id, regexp_replace(file_content, '\\r\\n|\\r', chr(10), 'g') AS t FROM files WHERE file_content IS NOT NULL AND rel_path LIKE '%.py'),
 b AS (SELECT unit_id, list_filter(regexp_split_to_array(t, '\\n\\n+'), lambda x: trim(x) <> '') AS l FROM f), p AS (SELECT unit_id, unnest(l) AS piece, unnest(range(len(l))) AS ord FROM b),
 k AS (SELECT unit_id, ord, ord = max(ord) OVER (PARTITION BY unit_id) AS is_target, len(regexp_extract_all(piece, '\\w+|[^\\w\\s]')) AS tokens FROM p), s AS (SELECT *, sum(tokens) OVER w AS running FROM k WINDOW w AS (PARTITION BY unit_id ORDER BY is_target DESC, ord ROWS UNBOUNDED PRECEDING))
 SELECT unit_id, ord, tokens, running > 200 AS over_budget FROM s WHERE running <= 200 OR is_target""",
}

