"""Resolution of imports to files of the same repository, without a file system.

Every import gives candidate paths in order of priority; candidates meet the files by an
equi-join and the best one stays. Nothing is imported or executed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rewrite
from ..functions.identifiers import parent_identifier
from ..session import cut_lineage
from . import extract

#: Re-exports that are followed one after the other.
EXPORT_STEPS = 3


def directory(path: Column | str) -> Column:
    """Directory of a path, empty at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def package_dirs(files: DataFrame) -> DataFrame:
    """Distinct (repo_id, dir) of directories that hold an __init__.py."""
    return files.where(F.col("rel_path").rlike(r"(^|/)__init__\.py$")).select("repo_id", directory(F.col("rel_path")).alias("dir")).distinct()


def packages(files: DataFrame) -> DataFrame:
    """file_no, package_root, package: the first ancestor directory that is no package, and the
    dotted package of the file's directory (its base name where it is no package)."""
    f = files.where(F.col("rel_path").endswith(".py")).select("file_no", "repo_id", directory(F.col("rel_path")).alias("dir")).distinct()
    depth = F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(F.split("dir", "/")))
    # ancestors, nearest first: ups 0 is the directory itself
    up = f.select("*", depth.alias("depth")).select("*", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("ups"))
    up = up.withColumn("anc", F.array_join(F.slice(F.split("dir", "/"), 1, F.col("depth") - F.col("ups")), "/"))
    marked = up.join(package_dirs(files).withColumnRenamed("dir", "anc").withColumn("is_package", F.lit(True)), ["repo_id", "anc"], "left")
    root = marked.groupBy("file_no", "dir", "depth").agg(F.min(F.when(F.col("is_package").isNull(), F.col("ups"))).alias("ups"))
    # the top directory may be a package too; then the root is the top
    ups = F.coalesce("ups", "depth")
    parts = F.split("dir", "/")
    name = F.when(ups == 0, F.element_at(parts, -1)).otherwise(F.array_join(F.slice(parts, F.col("depth") - ups + 1, ups), "."))
    return root.select("file_no", F.array_join(F.slice(parts, 1, F.col("depth") - ups), "/").alias("package_root"), name.alias("package"))


def _join_path(base: Column, rest: Column) -> Column:
    return F.when(base == "", rest).when(rest == "", base).otherwise(F.concat_ws("/", base, rest))


def resolved(files: DataFrame) -> DataFrame:
    """KEYS, level, module, name, alias, is_top, orig_idx, target: the file an import leads to, null for
    libraries. Absolute imports try the package root, the file's directory, its ancestors
    and the top; relative ones their own directory. A module file goes before a package's
    __init__.py, and "from p import m" before p itself where m is a module."""
    files = extract.parse_once(files, "imports")
    rows = extract.imports(files).join(packages(files), "file_no")
    # the target depends on these alone; a generated row number could differ when a lost partition is computed again
    rows = rows.withColumn("row", F.concat_ws("\x1f", "file_no", "level", F.coalesce("module", F.lit("\x00")), F.coalesce("name", F.lit("\x00")))).withColumn("dir", directory(F.col("rel_path")))
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(parts))
    module = F.replace(F.coalesce("module", F.lit("")), F.lit("."), F.lit("/"))
    ancestors = F.transform(F.sequence(F.lit(0), depth), lambda k: F.array_join(F.slice(parts, 1, depth - k), "/"))
    up = F.array_join(F.slice(parts, 1, F.greatest(depth - F.col("level").cast("int") + 1, F.lit(0))), "/")
    bases = F.when(F.col("level") > 0, F.array(up)).otherwise(F.concat(F.array("package_root"), ancestors))
    known = files.select("repo_id", F.col("rel_path").alias("target")).distinct()
    # most imports are of libraries: candidates are made only where some file has the last name of one
    last = known.select("repo_id", F.explode(F.array(F.regexp_extract("target", r"([^/]*)\.py$", 1), F.regexp_extract("target", r"([^/]*)/__init__\.py$", 1))).alias("last")).distinct()
    lean = rows.select("row", "repo_id", "package_root", "dir", "level", "module", "name")
    bare = F.coalesce("module", F.lit("")) == ""  # the base itself
    likely = lean.where(~bare).select("*", F.explode(F.array_compact(F.array("name", F.element_at(F.split("module", r"\."), -1)))).alias("last"))
    lean = lean.where(bare).unionByName(likely.join(last, ["repo_id", "last"], "left_semi").drop("last"))
    base = lean.select("*", F.posexplode(bases).alias("prio", "base"))
    stem = _join_path(F.col("base"), module)
    inner = F.when(F.col("name").isNotNull() & (F.col("name") != "*"), _join_path(stem, F.col("name")))
    forms = F.array(F.concat(inner, F.lit(".py")), F.concat(inner, F.lit("/__init__.py")), F.concat(stem, F.lit(".py")), _join_path(stem, F.lit("__init__.py")))
    tries = base.select("row", "repo_id", "prio", F.posexplode(forms).alias("form", "target")).where("target is not null")
    best = tries.join(known, ["repo_id", "target"]).groupBy("row").agg(F.min_by("target", F.struct("prio", "form")).alias("target"))
    out = rows.join(best, "row", "left")
    return out.select("file_no", "repo_id", "rel_path", "module_id", "level", "module", "name", "alias", "is_top", "orig_idx", "target")


def absolute(files: DataFrame) -> DataFrame:
    """KEYS, module (absolute), name, alias, is_top of every import: level dots lead up from the package."""
    rows = extract.imports(files).join(packages(files), "file_no")
    parts = F.split("package", r"\.")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - F.col("level").cast("int") + 1, F.lit(0))), ".")
    module = F.when(F.col("level") == 0, F.col("module")).otherwise(F.concat_ws(".", F.when(base != "", base), "module"))
    return rows.select("file_no", "repo_id", "rel_path", "module_id", module.alias("module"), "name", "alias", "is_top")


def stars_expanded(files: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """file_no, module, name, alias with each * replaced by the target module's members.

    library (module, name) is a catalogue of members of modules outside the repositories;
    modules are never imported. A * that nothing explains stays.
    """
    files = extract.parse_once(files, "imports", "members")
    rows = resolved(files)
    stars = rows.where("name = '*'")
    inside = extract.members(files).select("repo_id", F.col("rel_path").alias("target"), F.col("name").alias("member")).distinct()
    found = stars.join(inside, ["repo_id", "target"], "left")
    if library is not None:
        found = found.join(library.select("module", F.col("name").alias("outside")), "module", "left").withColumn("member", F.coalesce("member", "outside"))
    name = F.coalesce("member", F.lit("*"))
    out = found.select("file_no", "module", name.alias("name"), name.alias("alias"))
    return rows.where("name is null or name <> '*'").select("file_no", "module", "name", "alias").union(out).distinct()


def rewritten(files: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """file_no, text of every Python file: relative imports absolute, each * that a file of the
    repository (or library, as for stars_expanded) explains replaced by names. Other texts,
    those that don't parse too, stay as they are."""
    parsed = extract.parse_once(files, "imports", "members")
    stars = resolved(parsed).where("name = '*' and is_top").select("file_no", "repo_id", "level", "module", "target").distinct()
    names = extract.members(parsed).where("not startswith(name, '_')").select("repo_id", F.col("rel_path").alias("target"), "name")
    found = stars.join(names, ["repo_id", "target"]).select("file_no", "level", "module", "name")
    if library is not None:
        found = found.union(stars.where("target is null and level = 0").join(library.select("module", "name"), "module").select("file_no", "level", "module", "name"))
    per = found.groupBy("file_no", "level", "module").agg(F.array_sort(F.collect_set("name")).alias("names"))
    per = per.groupBy("file_no").agg(F.collect_list(F.struct("level", "module", "names")).alias("stars"))
    about = packages(parsed).select("file_no", "package").join(per, "file_no", "left")
    texts = files.where(F.col("rel_path").endswith(".py")).select(F.col("file_no").cast("long").alias("file_no"), F.col("file_content").alias("text")).where("text is not null").dropDuplicates(["file_no"])

    @F.pandas_udf("string")
    def change(text: pd.Series, package: pd.Series, stars: pd.Series) -> pd.Series:
        return pd.Series([rewrite.imports_rewritten(t, p or "", {(int(x["level"]), x["module"]): list(x["names"]) for x in (() if s is None else s)}) for t, p, s in zip(text, package, stars)], dtype=object)

    return texts.join(about, "file_no", "left").select("file_no", change("text", "package", "stars").alias("text"))


def imported_files(files: DataFrame) -> DataFrame:
    """Distinct (file_no, target) of files of the same repository that a file imports."""
    return resolved(files).where("target is not null").select("file_no", "target").distinct()


def file_calls(files: DataFrame) -> DataFrame:
    """Distinct (repo_id, caller, callee, resolved): a call graph by name resolution.

    A called name is a unit of the module, a member through an import, a builtin, the import's
    own path where no unit has that id (re-exports), or stays as written. Names through
    instances aren't followed.
    """
    import builtins

    files = extract.parse_once(files, "calls", "imports", "units")
    calls = extract.calls(files).select("file_no", "repo_id", "module_id", "caller", "callee").distinct()
    units = extract.all_units(files)
    ids = units.select("repo_id", "unit_id").union(units.where("class_id is not null").select("repo_id", F.col("class_id").alias("unit_id"))).distinct()
    head, rest = F.element_at(F.split("callee", r"\."), 1), F.regexp_replace("callee", r"^[^.]*\.?", "")
    calls = calls.select("*", head.alias("alias"), rest.alias("rest"))
    imp = resolved(files).where("target is not null").select("file_no", "alias", "name", F.replace(F.regexp_replace(F.regexp_replace("target", r"/__init__\.py$", ""), r"\.py$", ""), F.lit("/"), F.lit(".")).alias("to_module")).dropDuplicates(["file_no", "alias"])
    c = calls.join(imp, ["file_no", "alias"], "left")
    through = F.concat_ws(".", "to_module", F.when(~F.col("to_module").endswith(F.concat(F.lit("."), "name")), F.col("name")), F.when(F.col("rest") != "", F.col("rest")))
    local = F.concat_ws(".", "module_id", "callee")
    names = F.array(*(F.lit(b) for b in sorted(b for b in dir(builtins) if not b.startswith("_"))))
    cand = c.select("repo_id", "caller", "callee", F.when(F.col("to_module").isNotNull(), through).alias("through"), F.array(F.when(F.col("to_module").isNotNull(), through), local, F.col("callee")).alias("cands"), F.array_contains(names, F.col("callee")).alias("is_builtin"))
    tries = cand.select("*", F.posexplode("cands").alias("prio", "unit_id")).where("unit_id is not null").join(ids.withColumn("hit", F.lit(True)), ["repo_id", "unit_id"], "left")
    best = tries.groupBy("repo_id", "caller", "callee", "is_builtin").agg(F.min_by("unit_id", F.when(F.col("hit"), F.col("prio"))).alias("unit_id"), F.min("through").alias("through"))
    name = F.coalesce("unit_id", F.when(F.col("is_builtin"), F.concat(F.lit("<builtin>."), "callee")), "through", "callee")
    return best.select("repo_id", "caller", name.alias("callee"), (F.col("unit_id").isNotNull() | F.col("is_builtin")).alias("resolved")).distinct()


def exports(files: DataFrame) -> DataFrame:
    """Distinct repo_id, module_id, name, target: names that a module has by import, with the id they
    stand for in the module that they come from."""
    rows = resolved(files).where("target is not null and name is not null and name <> '*' and is_top")
    to = F.replace(F.regexp_replace(F.regexp_replace("target", r"/__init__\.py$", ""), r"\.py$", ""), F.lit("/"), F.lit("."))
    return rows.select("repo_id", F.regexp_replace("module_id", r"\.__init__$", "").alias("module_id"), F.col("alias").alias("name"), F.when(to.endswith(F.concat(F.lit("."), "name")), to).otherwise(F.concat_ws(".", to, "name")).alias("target")).distinct()


def repository_graphs(files: DataFrame) -> DataFrame:
    """repo_id, graph, id2type of each repository: links are found by name, callees that a module
    only imports become the ids they stand for, callers outside the repository's modules and
    keys without callees are dropped, and every id gets its type.

    Chains of up to EXPORT_STEPS re-exports are followed; ids that nothing explains stay as
    they are. A graph is one row, so it holds the links of one repository at most.
    """
    files = extract.parse_once(files, "calls", "imports", "units")
    links = file_calls(files).select("repo_id", "caller", "callee")
    known = cut_lineage(exports(files).groupBy("repo_id", F.concat_ws(".", "module_id", "name").alias("callee")).agg(F.min("target").alias("to")).where("callee <> to"))
    seen = links
    for _ in range(EXPORT_STEPS):
        seen = seen.join(known, ["repo_id", "callee"], "left").select("repo_id", "caller", F.coalesce("to", "callee").alias("callee")).distinct()
    modules = files.select("repo_id", F.regexp_replace("module_id", r"\.__init__$", "").alias("m")).distinct()
    tries = seen.select("repo_id", "caller", F.explode(F.array(F.col("caller"), parent_identifier("caller", 1), parent_identifier("caller", 2))).alias("m"))
    own = tries.join(modules, ["repo_id", "m"], "left_semi").select("repo_id", "caller").distinct()
    links = cut_lineage(seen.join(own, ["repo_id", "caller"], "left_semi"))
    ids = links.select("repo_id", F.col("caller").alias("identifier")).union(links.select("repo_id", "callee")).distinct()
    kinds = id_types(files, ids).groupBy("repo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("identifier", "elem_type")))).alias("id2type"))
    per = links.groupBy("repo_id", "caller").agg(F.array_sort(F.collect_set("callee")).alias("callees"))
    graphs = per.groupBy("repo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("caller", "callees")))).alias("graph"))
    return graphs.join(kinds, "repo_id").select("repo_id", "graph", "id2type")


def local_paths(files: DataFrame, identifiers: DataFrame, column: str = "identifier") -> DataFrame:
    """repo_id, identifier, path: the longest prefix of a dotted identifier that is a module file or
    a package of the repository; null where none is. Dots in directory names are tried too."""
    known = files.select("repo_id", F.col("rel_path").alias("path")).distinct()
    # a directory's own identifier form decides, so names with dots need no search
    forms = known.select("repo_id", "path", F.replace(F.regexp_replace(F.regexp_replace("path", r"/__init__\.py$", ""), r"\.py$", ""), F.lit("/"), F.lit(".")).alias("prefix"))
    forms = forms.groupBy("repo_id", "prefix").agg(F.min_by("path", F.struct(F.length("path"), "path")).alias("path"))
    ids = identifiers.select("repo_id", F.col(column).alias("identifier")).where("identifier is not null").distinct()
    parts = F.split("identifier", r"\.")
    tries = ids.select("repo_id", "identifier", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("prefix"))
    best = tries.join(forms, ["repo_id", "prefix"]).groupBy("repo_id", "identifier").agg(F.max_by("path", F.length("prefix")).alias("path"))
    return ids.join(best, ["repo_id", "identifier"], "left")


def id_types(files: DataFrame, identifiers: DataFrame, column: str = "identifier") -> DataFrame:
    """repo_id, identifier, elem_type: BUILTIN by its prefix, FUNCTION, METHOD or CLASS by a
    definition, API where the repository has no file or directory of the first segment, else OTHER."""
    ids = identifiers.select("repo_id", F.col(column).alias("identifier")).where("identifier is not null").distinct()
    files = extract.parse_once(files, "units")
    units = extract.all_units(files)
    kinds = units.select("repo_id", F.col("unit_id").alias("identifier"), F.upper("unit_kind").alias("kind")).union(units.where("class_id is not null").select("repo_id", F.col("class_id").alias("identifier"), F.lit("CLASS")))
    kinds = kinds.groupBy("repo_id", "identifier").agg(F.min("kind").alias("kind"))
    tops = files.select("repo_id", F.regexp_replace(F.element_at(F.split("rel_path", "/"), 1), r"\.py$", "").alias("top")).distinct().withColumn("is_own", F.lit(True))
    out = ids.withColumn("top", F.element_at(F.split("identifier", r"\."), 1)).join(kinds, ["repo_id", "identifier"], "left").join(tops, ["repo_id", "top"], "left")
    kind = F.when(F.col("identifier").startswith("<builtin>"), "BUILTIN").when(F.col("kind").isNotNull(), F.col("kind")).when(F.col("is_own").isNull(), "API").otherwise("OTHER")
    return out.select("repo_id", "identifier", kind.alias("elem_type"))
