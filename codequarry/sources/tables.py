"""Sources: repository trees, JSON unit files, graphs, repository lists; and the sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..session import plan_bytes

REPO = "struct<repo_org:string,repo_name:string,repo_id:string,local_repo_path:string>"
FILE = f"struct<file_module:struct<module_id:struct<identifier:string>,module_type:string,repo:{REPO}>>"
TESTS = "struct<tests:map<string,string>,operation:string,gen_model:string,gen_date:string,exec_stats:string,chat_messages:array<struct<role:string,content:string>>>"
UNIT = f"function_id struct<identifier:string>, method_id struct<identifier:string>, file {FILE}, function_name string, method_name string, parent_class_id struct<identifier:string>, function_code string, method_code string, context struct<context_type:string,context:string>, test_history struct<history:array<{TESTS}>>"


#: Bytes that may go into one row as a JSON array.
ARRAY_LIMIT = 64 << 20


def repo_tree(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """repo_id, rel_path, file_content of the files below root/<repo_id>/; hidden paths are left out.
    Contents are read by the executors, UTF-8, undecodable bytes replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^/*{_quoted(base.lstrip('/'))}/+", "")
    parts = F.split(rel, "/")
    out = raw.select(F.element_at(parts, 1).alias("repo_id"), F.array_join(F.slice(parts, 2, F.size(parts)), "/").alias("rel_path"), F.decode(F.col("content"), "UTF-8").alias("file_content"))
    return out.where((F.col("rel_path") != "") & ~ids.is_hidden("rel_path"))


def _quoted(text: str) -> str:
    import re

    return re.sub(r"([.^$*+?{}\[\]()|\\])", r"\\\1", text)


def with_file_no(files: DataFrame) -> DataFrame:
    """files with a key made from repository and path, alike in every run."""
    return files.withColumn("file_no", F.xxhash64("repo_id", "rel_path"))


def repos_from_urls(urls: DataFrame, repos_dir: str = "repos") -> DataFrame:
    """repo_id, repo_org, repo_name, repo_url, local_repo_path of repository URLs (url)."""
    rid = ids.repo_id_from_url("url")
    return urls.where("url is not null").select(rid.alias("repo_id"), ids.repo_part(rid, "org").alias("repo_org"), ids.repo_part(rid, "name").alias("repo_name"), F.col("url").alias("repo_url"), ids.repo_path(rid, repos_dir).alias("local_repo_path")).dropDuplicates(["repo_id"])


def repos_from_paths(paths: DataFrame) -> DataFrame:
    """repo_id, repo_org, repo_name, local_repo_path of local directories (path)."""
    rid = ids.repo_id_from_local("path")
    return paths.where("path is not null").select(rid.alias("repo_id"), ids.repo_part(rid, "org").alias("repo_org"), ids.repo_part(rid, "name").alias("repo_name"), F.col("path").alias("local_repo_path")).dropDuplicates(["repo_id"])


def read_units(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """Units of a JSON array file: unit_kind, unit_id and the stored fields. A row that is neither
    function nor method fails the read. compat puts repo_id in place of the repository's names."""
    raw = spark.read.schema(UNIT).option("multiLine", True).json(path)
    kind = F.when(F.col("function_id").isNotNull(), "function").when(F.col("method_id").isNotNull(), "method").otherwise(F.raise_error(F.lit("neither function nor method")).cast("string"))
    out = raw.select(kind.alias("unit_kind"), F.coalesce("function_id.identifier", "method_id.identifier").alias("unit_id"), "*")
    if compat:
        rid = F.col("file.file_module.repo.repo_id")
        out = out.withColumn("file", F.col("file").withField("file_module.repo.repo_org", rid).withField("file_module.repo.repo_name", rid))
    return out


def write_units(units: DataFrame, path: str, overwrite: bool = False) -> None:
    """Units as JSON lines in a folder; an existing folder stays unless overwrite."""
    units.write.mode("overwrite" if overwrite else "ignore").json(path)


def as_json_array(df: DataFrame, limit: int = ARRAY_LIMIT) -> DataFrame:
    """One row `text`: all rows as one JSON array. For exports of up to limit bytes by the
    optimiser's estimate; larger tables are refused (write_units writes them in parts)."""
    if plan_bytes(df) > limit:
        raise ValueError(f"about {plan_bytes(df)} bytes don't go into one row; use write_units")
    return df.select(F.to_json(F.struct("*")).alias("j")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("j")), ",\n"), F.lit("]")).alias("text"))


def in_batches(df: DataFrame, path: str, run: Callable[[DataFrame], DataFrame], batches: int, key: str = "unit_id") -> DataFrame:
    """run(df) in parts, each written under path as soon as it is done, and all parts read again.

    Rows go to parts by the hash of key, so a broken run can be started again with the same
    arguments: parts that are complete (Spark marks them) are not run again.
    """
    spark = df.sparkSession
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for number in range(batches):
        part = f"{path}/batch={number}"
        if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{part}/_SUCCESS")):
            run(df.where(F.pmod(F.xxhash64(key), F.lit(batches)) == number)).write.mode("overwrite").parquet(part)
    return spark.read.parquet(path).drop("batch")


def image_recipe(n: Column | int, batch: int = 10, install: str = "python install.py") -> Column:
    """Text of an image recipe: a base and one RUN for each batch of 0..n-1."""
    count = F.lit(n) if isinstance(n, int) else n
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1, F.lit(batch))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda s: F.concat(F.lit(f"RUN {install} --start "), s.cast("string"), F.lit(" --end "), F.least(s + batch, count).cast("string")))
    return F.concat_ws("\n", F.lit("FROM python:3.11\nWORKDIR /install\nCOPY . /install"), F.array_join(runs, "\n"))
