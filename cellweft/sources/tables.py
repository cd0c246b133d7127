"""Readers and writers of the pipeline's files, on Spark's own formats.

Writes go through the commit protocol of the file system, so readers never see half a table; they refuse to replace what exists
unless told to.
"""

from __future__ import annotations

import hashlib
import tarfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_tsv(spark: SparkSession, path: str, schema: StructType | str, required: Sequence[str] = ()) -> DataFrame:
    """A tab-separated table with a header, gzip or not; a malformed line fails (S7). Required columns must be in the schema."""
    df = spark.read.option("sep", "\t").option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(schema).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return df


def column_consistency(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(n_columns, n_lines): how many fields lines have; a sound table has one row."""
    return spark.read.text(path).groupBy(F.size(F.split("value", sep, -1)).alias("n_columns")).agg(F.count("*").alias("n_lines"))


def write(df: DataFrame, path: str, kind: str = "parquet", overwrite: bool = False, by: Sequence[str] = ()) -> None:
    """Write parquet, orc, json, csv or tsv, one folder per value of ``by``."""
    w = df.write.mode("overwrite" if overwrite else "error")
    if by:
        w = w.partitionBy(*by)
    if kind == "tsv":
        w.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    elif kind == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(kind).save(path)


def profile(df: DataFrame) -> DataFrame:
    """(column, type, nullable, n, filled) of a table (S4): one pass."""
    n = df.agg(F.count("*").alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable"), F.col("_n").alias("n"), F.col(f"_c{i}").alias("filled")) for i, f in enumerate(df.schema)])
    return n.select(F.explode(rows).alias("r")).select("r.*")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, rows, day): rows per file of a parquet folder, the day from its name."""
    d = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return d.groupBy("file", "bytes").agg(F.count("*").alias("rows")).withColumn("day", F.nullif(F.regexp_extract("file", r"_D(\d+)_", 1), F.lit("")).cast("int"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, status): ok, missing, size or content by a manifest of name, length, sha256."""
    f = found.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("length").alias("_l"), F.col("sha256").alias("_s"))
    j = manifest.join(f, "name", "left")
    return j.select("name", F.when(F.col("_l").isNull(), "missing").when(F.col("_l") != F.col("length"), "size").when(F.col("_s") != F.col("sha256"), "content").otherwise("ok").alias("status"))


def unpack(archive: str, target: str) -> list[str]:
    """Extract a tar archive; members that would leave ``target`` are refused."""
    root = Path(target).resolve()
    with tarfile.open(archive) as t:
        for m in t.getmembers():
            if not (root / m.name).resolve().is_relative_to(root) or m.islnk() or m.issym():
                raise ValueError(f"unsafe member {m.name}")
        t.extractall(root, filter="data")
        return sorted(m.name for m in t.getmembers() if m.isfile())


def sha256_file(path: str, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while b := f.read(chunk):
            h.update(b)
    return h.hexdigest()


def with_node_index(features: DataFrame, nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Chosen feature columns with their node index; an anchor without a node is an error (S11). The projection reaches the scan."""
    from cellweft.operators.gates import join_checked, require

    j = join_checked(features.select("slice_id", "anchor_index", *columns), nodes.select("slice_id", "anchor_index", "node_index"), ["slice_id", "anchor_index"])
    return require(j, "node index", without_node=F.col("node_index").isNull())


def selected_rows(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is wanted (S12): a semi-join; small key sets become a runtime filter of the scan."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def union_bank(banks: dict[str, DataFrame]) -> DataFrame:
    """One row per (locus, allele) from several reference banks.

    Missing sample_count counts as infinite, missing normalized_count as 1; the row with the smallest (invalid, normalized_count,
    sample_count, bank) stays. Banks: locus, allele, sample_count, normalized_count, invalid.
    """
    from functools import reduce

    every = reduce(DataFrame.unionByName, [d.select("locus", "allele", F.coalesce(F.col("sample_count").cast("double"), F.lit(float("inf"))).alias("sample_count"), F.coalesce(F.col("normalized_count").cast("double"), F.lit(1.0)).alias("normalized_count"), F.coalesce("invalid", F.lit(False)).alias("invalid"), F.lit(k).alias("bank")) for k, d in sorted(banks.items())])
    best = every.groupBy("locus", "allele").agg(F.min(F.struct("invalid", "normalized_count", "sample_count", "bank")).alias("r"))
    return best.select("locus", "allele", "r.*")
