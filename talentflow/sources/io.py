"""Readers and sinks.

Raw feeds are CSV read with an explicit all-string schema (no ``inferSchema``
pass), multi-line quoted fields allowed; master and result tables are Parquet,
so later reads get column pruning and predicate pushdown.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentflow.functions.extract import pipe_to_set
from talentflow.session import ship_package


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Parquet table ``<root>/<name>.parquet``."""
    ship_package(spark)  # Python tasks on the table may need it
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def string_schema(cols: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in cols])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | list[str]) -> DataFrame:
    """A1/A2: one CSV (file or folder) with header, quoted multi-line fields.

    Empty fields read as NULL (B16).
    """
    if isinstance(schema, list):
        schema = string_schema(schema)
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
                 .option("escape", '"').option("mode", "PERMISSIVE").csv(path))


def read_csv_tables(spark: SparkSession, root: str, tables: dict[str, T.StructType | list[str]]
                    ) -> dict[str, DataFrame]:
    """A1: every known table under a root (``{relative_path: schema}``)."""
    return {rel: read_csv(spark, os.path.join(root, rel), s) for rel, s in tables.items()}


def discover_csv(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """A1: all CSV files below a root, through the file system of the path: ``{relative path
    without .csv: table}``, all columns read as strings by the file's header."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.getFileStatus(top).getPath().toString().rstrip("/") + "/"
    files, out = fs.listFiles(top, True), {}
    while files.hasNext():
        path = files.next().getPath().toString()
        if path.endswith(".csv"):
            out[path.removeprefix(base)[:-4]] = (spark.read.option("header", True).option("multiLine", True)
                                                 .option("escape", '"').csv(path))
    return dict(sorted(out.items()))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A1/A10: ``(table, n_rows)`` as one union of per-table counts."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def read_columns(spark: SparkSession, root: str, name: str, cols: list[str]) -> DataFrame:
    """A3: column-pruned read (Parquet reads only these columns)."""
    return read_table(spark, root, name).select(*cols)


def serialize_lists(df: DataFrame, delim: str = "|") -> DataFrame:
    """A4: array columns -> delimiter-joined strings; NULL arrays -> ''."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            out.append(F.coalesce(F.concat_ws(delim, F.col(f.name)), F.lit("")).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def deserialize_lists(df: DataFrame, cols: list[str], delim: str = "|") -> DataFrame:
    """Inverse of A4 (D6) for CSV hand-offs."""
    return df.withColumns({c: pipe_to_set(c, delim) for c in cols})


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """A5 and master-table sink."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        serialize_lists(df).write.mode(mode).option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """Small metrics DataFrame -> one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def load_warehouse(spark: SparkSession, root: str, tables: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Typed warehouse tables from CSV; '' -> NULL for the timestamp columns."""
    out = {}
    for name, schema in tables.items():
        raw = read_csv(spark, os.path.join(root, f"{name}.csv"), [f.name for f in schema.fields])
        cols = []
        for f in schema.fields:
            c = F.nullif(F.col(f.name), F.lit(""))
            if isinstance(f.dataType, T.ArrayType):
                cols.append(pipe_to_set(c).alias(f.name))
            elif isinstance(f.dataType, T.BooleanType):
                cols.append((F.lower(c) == "true").alias(f.name))
            else:
                cols.append(c.try_cast(f.dataType).alias(f.name))
        out[name] = raw.select(*cols)
    return out


def build_warehouse(matches: DataFrame, job_skills: DataFrame, job_industries: DataFrame,
                    jobs: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rename rank -> match_rank; restrict job child tables to matched jobs."""
    if "rank" in matches.columns:
        matches = matches.withColumnRenamed("rank", "match_rank")
    matched = matches.select("job_id").distinct()
    return {
        "matches": matches,
        "job_skills": job_skills.join(matched, "job_id", "left_semi"),
        "job_industries": job_industries.join(matched, "job_id", "left_semi"),
        "jobs": jobs if jobs is not None else slim_jobs(matches, job_skills),
    }


SLIM_NULL_COLUMNS = {
    "company_id": "bigint", "company_industry": "string", "company_size": "string",
    "employee_count_latest": "bigint", "description_clean": "string",
    "experience_required": "string", "industries": "array<string>", "work_type": "string",
    "location": "string", "location_clean": "string", "min_salary": "double",
    "max_salary": "double", "normalized_salary_clean": "double", "has_salary": "boolean",
    "pay_period": "string", "currency": "string", "benefits": "array<string>",
    "remote_allowed_bool": "boolean", "listed_time_dt": "timestamp", "expiry_dt": "timestamp",
    "description_word_count": "int", "jd_completeness_score": "double",
    "job_quality_score": "double",
}


def slim_jobs(matches: DataFrame, job_skills: DataFrame, rank_col: str = "match_rank") -> DataFrame:
    """Jobs table from matches when the catalogue is absent.

    First title/company per job = the one of the best-ranked match row (ties by
    candidate id); lower title; sorted distinct skills; 23 NULL columns.
    """
    order = F.struct(F.col(rank_col), F.col("candidate_id"))
    base = matches.groupBy("job_id").agg(F.min_by("job_title", order).alias("title"),
                                         F.min_by("company_name", order).alias("company_name"))
    req = (job_skills.filter(F.col("skill_clean").isNotNull() & (F.col("skill_clean") != ""))
                     .groupBy("job_id").agg(F.array_sort(F.collect_set("skill_clean"))
                                            .alias("required_skills")))
    out = (base.withColumn("title_clean", F.lower(F.coalesce("title", F.lit(""))))
               .join(req, "job_id", "left")
               .withColumn("required_skills", F.coalesce("required_skills",
                                                         F.array().cast("array<string>")))
               .withColumn("required_skill_count", F.size("required_skills")))
    return out.withColumns({c: F.lit(None).cast(tp) for c, tp in SLIM_NULL_COLUMNS.items()})


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Plain-text files -> (path, text); undecodable bytes are dropped."""
    raw = spark.read.format("binaryFile").load(path)
    # bytes -> UTF-8; invalid sequences removed (like errors='ignore')
    txt = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\ufffd", "")
    return raw.select("path", txt.alias("text"))


def _committed_batches(spark: SparkSession, path: str) -> list[str]:
    """Folders below ``path`` whose write has ended."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found = [f.getPath() for f in fs.listStatus(top) if f.isDirectory()]
    return sorted(p.toString() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def embedding_cache(rows: DataFrame, id_col: str, vec_col: str, path: str | None = None,
                    content_col: str | None = None,
                    embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(id, vector)``, one row per distinct id, vectors computed once and kept at ``path``.

    A vector is kept under its id and the hash of its content (``content_col``, by default the
    vector itself). Only rows whose id and content are not there yet go through ``embed`` (which
    gets ``id, content`` and returns at least ``id`` and the vector; without it the content is the
    vector) and are appended as a folder of their own; folders without a commit mark are not read,
    so that a lost or concurrent run harms nothing. A changed content gets a new vector, an
    unchanged table writes nothing. Of several contents of one id the smallest counts; rows
    without an id are left out.
    """
    spark, content = rows.sparkSession, content_col or vec_col
    one = (rows.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(content).alias(content)))
    keyed = one.withColumn("__key", F.xxhash64(content))

    def vectors(some: DataFrame) -> DataFrame:
        if embed is None:
            return some.select(id_col, F.col(content).alias(vec_col), "__key")
        return embed(some.drop("__key")).select(id_col, vec_col).join(some.select(id_col, "__key"), id_col)
    if not path:
        return vectors(keyed).drop("__key")
    held = _committed_batches(spark, path)
    new = keyed
    if held:
        new = keyed.join(spark.read.parquet(*held).select(id_col, "__key"), [id_col, "__key"], "left_anti")
    if not new.isEmpty():
        batch = f"{path.rstrip('/')}/batch-{uuid.uuid4().hex}"
        vectors(new).write.parquet(batch)
        held.append(batch)
    if not held:
        return vectors(keyed).drop("__key")
    kept = spark.read.parquet(*held).groupBy(id_col, "__key").agg(F.min(vec_col).alias(vec_col))
    return kept.join(keyed.select(id_col, "__key"), [id_col, "__key"], "left_semi").drop("__key")
