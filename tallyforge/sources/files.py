"""Scans and sinks of record files. Schemas are always given, never inferred."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Strict scan: blank lines are skipped, any malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Scan that drops a torn last line (malformed, without a line end) of a file and fails on any other malformed line.

    Lines are rows, so a file of any size is split like any other text. A
    file's last line is the one of the largest offset, and it lacks its line
    end when the lines with theirs are one byte longer than the file.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("_file"), meta["file_size"].alias("_size"), F.struct(meta["file_block_start"], F.monotonically_increasing_id()).alias("_at"), F.col("value").alias("_line"))
    files = lines.groupBy("_file").agg(F.max("_at").alias("_last"), (F.sum(F.octet_length("_line") + 1) > F.max("_size")).alias("_open"))
    each = lines.where(F.trim(F.regexp_replace("_line", r"\r$", "")) != "").withColumn("_bad", F.try_parse_json("_line").isNull())
    judged = each.join(files, "_file").withColumn("_r", F.from_json("_line", schema))
    bad = F.col("_bad")
    torn = bad & F.col("_open") & (F.col("_at") == F.col("_last"))
    message = F.concat(F.lit("malformed line in "), "_file", F.lit(": "), F.substring("_line", 1, 80))
    # one condition on both sides of the join, so that nothing is raised before it is known which lines are torn
    checked = judged.where(F.when(torn, False).when(bad, F.raise_error(message).cast("boolean")).otherwise(True))
    return checked.select(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields])


def collect_objects(df: DataFrame, json: str, key: str, *keep: str, depth: int = 6) -> DataFrame:
    """(keep, path, value) of every object that has a key, at any depth up to ``depth`` in a JSON text; values are variants.

    A row of nested variants is exploded once per level; objects that were
    found are not searched further.
    """
    tvf = df.sparkSession.tvf
    level = df.select(*keep, F.lit("").alias("path"), F.try_parse_json(json).alias("value"))
    has = F.try_variant_get("value", f"$.{key}", "variant").isNotNull() & F.schema_of_variant("value").startswith("OBJECT")
    found = level.where(has)
    for _ in range(depth):
        nested = level.where(~F.coalesce(has, F.lit(False)) & F.col("value").isNotNull() & F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)"))
        inner = nested.select(*keep, "path", F.col("value").alias("_outer")).lateralJoin(tvf.variant_explode(F.col("_outer").outer()))
        level = inner.select(*keep, F.concat_ws("/", F.nullif("path", F.lit("")), F.coalesce("key", F.col("pos").cast("string"))).alias("path"), "value")
        found = found.unionByName(level.where(has))
    return found


def seeds_by_role(spark: SparkSession, path: str, roles: dict[str, str], id_depth: int = 1) -> DataFrame:
    """(id, a column per role): the text files of every item gathered by what their names say they are.

    ``roles`` maps a column to a pattern of file names; the item is the path's
    last ``id_depth`` folders. Of several files of a role the one of the
    shortest, then smallest name is taken.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_name"), F.col("value").alias("_text"))
    parts = F.split("_path", "/")
    item = F.array_join(F.slice(parts, F.size(parts) - id_depth, F.lit(id_depth)), "/")
    role = F.lit(None).cast("string")
    for name, pattern in reversed(roles.items()):
        role = F.when(F.col("_name").rlike(pattern), name).otherwise(role)
    text = lambda r: F.min_by(F.when(F.col("_role") == r, F.col("_text")), F.when(F.col("_role") == r, F.struct(F.length("_name"), F.col("_name")))).alias(r)
    return files.withColumn("_role", role).where("_role is not null").groupBy(item.alias("id")).agg(*[text(r) for r in roles])


def read_ragged_csv(spark: SparkSession, path: str, fixed: list[str], rest: str, header: bool = False) -> DataFrame:
    """Lines of ``fixed`` leading fields and any number of further ones, gathered in an array column."""
    lines = spark.read.text(path)
    if header:  # reproduces readers that lose the first record to a header
        lines = lines.withColumn("_f", F.col("_metadata.file_path")).withColumn("_i", F.monotonically_increasing_id())
        first = lines.groupBy("_f").agg(F.min("_i").alias("_i"))
        lines = lines.join(first, ["_f", "_i"], "left_anti").select("value")
    parts = F.split("value", ",")
    return lines.where(F.trim("value") != "").select(*[F.trim(F.try_element_at(parts, F.lit(i + 1))).alias(c) for i, c in enumerate(fixed)], F.when(F.size(parts) > len(fixed), F.transform(F.slice(parts, len(fixed) + 1, F.size(parts)), F.trim)).otherwise(F.array().cast("array<string>")).alias(rest))


def read_report(spark: SparkSession, path: str, pattern: str, columns: list[str]) -> DataFrame:
    """Lines of a fixed-format report as the groups of a pattern; other lines are skipped."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(*[F.regexp_extract("value", pattern, i + 1).alias(c) for i, c in enumerate(columns)])


def read_logs(spark: SparkSession, path: str, name_pattern: str, keys: list[str]) -> DataFrame:
    """Whole log files, with keys taken from their names; files of other names are skipped."""
    logs = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("log"))
    return logs.where(F.col("file").rlike(name_pattern)).select(*[F.regexp_extract("file", name_pattern, i + 1).alias(k) for i, k in enumerate(keys)], "log")


def discover(spark: SparkSession, path: str, glob: str, has: str | None = None) -> DataFrame:
    """(folder, n_files) of the folders below ``path`` with files of a name, only those that also hold ``has``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path")
    folder, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    out = found.groupBy(folder.alias("folder")).agg(F.count("*").alias("n_files"), F.bool_or(name == has if has else F.lit(True)).alias("_has"))
    return out.where("_has").drop("_has")


def flatten_samples(df: DataFrame, json: str, *keep: str) -> DataFrame:
    """(keep, item, sample, value) of containers that map an item to a list of samples, to a map of them, or a flat 'item_sampleN' to one.

    Values are variants, so that no schema has to be guessed.
    """
    outer = df.select(*keep, F.parse_json(json).alias("_v")).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer())).select(*keep, F.col("key").alias("_item"), F.col("value").alias("_value"))
    kind = F.schema_of_variant("_value")
    flat = F.col("_item").rlike(r"_sample\d+$")
    nested = outer.where(~flat).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_value").outer())).select(*keep, F.col("_item").alias("item"), F.coalesce("key", F.col("pos").cast("string")).alias("sample"), "value")
    single = outer.where(flat & kind.startswith("OBJECT")).select(*keep, F.regexp_extract("_item", r"^(.*)_sample\d+$", 1).alias("item"), F.regexp_extract("_item", r"_sample(\d+)$", 1).alias("sample"), F.col("_value").alias("value"))
    return nested.unionByName(single)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write JSON lines; the count comes from an observation of the same job. The committer makes the output appear at once."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return int(seen.get["n"])


def write_routed(df: DataFrame, reason: Column, accepted: str, rejected: str) -> tuple[int, int]:
    """Accepted and rejected rows to two places, from one checked computation."""
    from tallyforge.runtime import checkpointed

    judged = checkpointed(df.withColumn("reject_reason", reason))
    good = write_jsonl(judged.where("reject_reason is null").drop("reject_reason"), accepted)
    return good, write_jsonl(judged.where("reject_reason is not null"), rejected)


def write_table_row(df: DataFrame, columns: list[str], path: str) -> None:
    """Tab-separated rows of fixed columns; nulls are empty cells."""
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value")).write.mode("overwrite").text(path)


def write_pivot_csv(df: DataFrame, rows: str, columns: str, value: str, names: list[str], path: str) -> None:
    """A line per value of ``rows`` and a column per name; of several values of a cell the first in order, none is an empty cell.

    The names are given, so that no extra job looks for them.
    """
    table = df.groupBy(rows).agg(*[F.min(F.when(F.col(columns) == n, F.col(value))).alias(n) for n in names])
    table.orderBy(rows).write.mode("overwrite").option("header", True).csv(path)


class Registry:
    """Named adapters; a repeated or an unknown name is an error."""

    def __init__(self, what: str) -> None:
        self.what, self._known = what, {}

    def register(self, name: str) -> Callable[[Callable], Callable]:
        def put(f: Callable) -> Callable:
            if name in self._known:
                raise ValueError(f"{self.what} {name!r} is registered already")
            self._known[name] = f
            return f

        return put

    def get(self, name: str) -> Callable:
        if name not in self._known:
            raise KeyError(f"unknown {self.what} {name!r}; known: {', '.join(sorted(self._known))}")
        return self._known[name]


datasets = Registry("dataset adapter")
methods = Registry("expansion method")


def mapped_seeds(df: DataFrame, mapping: dict[str, str], checks: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """Rows under the mapped names that pass all checks, and how many each first failing check rejects."""
    reason = F.lit(None).cast("string")
    for cond, name in reversed(checks):
        reason = F.when(~F.coalesce(cond, F.lit(False)), name).otherwise(reason)
    judged = df.withColumn("_reason", reason)
    return judged.where("_reason is null").select(*[F.col(v).alias(k) for k, v in mapping.items()]), judged.where("_reason is not null").groupBy(F.col("_reason").alias("reason")).count()
