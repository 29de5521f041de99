"""Manifests: what the sorter writes and the modality pipelines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions import classify

COLUMNS = ("source_path", "relative_path", "category", "status", "target_path", "reason", "size_bytes")
MODALITIES = ("image", "audio", "text")


def sort_files(files: DataFrame, root: str, strict_sniff: bool = False) -> DataFrame:
    """The manifest of scanned files. content_category is the label by content, category the one after the strict suffix rule."""
    content = classify.category(F.col("path"), F.col("length"), F.col("content"), strict_sniff)
    base = root.rstrip("/") + "/"
    relative = F.replace(F.regexp_replace("path", r"^\w+:/*(?=/)", ""), F.lit("\\"), F.lit("/"))
    bare = base.split(":", 1)[-1] if "://" not in base else "/" + base.split("://", 1)[1].split("/", 1)[-1]
    out = files.withColumn("content_category", content).withColumn("category", classify.strict_category(F.col("path"), F.col("content_category")))
    return out.select(
        F.col("path").alias("source_path"),
        F.when(relative.startswith(bare), F.substring(relative, len(bare) + 1, 1 << 20)).otherwise(relative).alias("relative_path"),
        "category", F.when(F.col("category") == "error", "error").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("target_path"),
        F.when(F.col("category") == "error", "unreadable").alias("reason"), F.col("length").alias("size_bytes"), "content_category",
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select(*COLUMNS).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_predictions(manifest: DataFrame, path: str) -> None:
    manifest.select(F.col("relative_path").alias("filename"), F.col("category").alias("predicted_label")).write.mode("overwrite").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str, allow_empty: bool = False) -> DataFrame:
    """path and category (lower case), from headers in any case with spaces around.

    Needs category and one of path, source_path, relative_path; the first that is filled counts. A row without either is
    an error, and so is a manifest without rows unless allowed.
    """
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    rows = raw.toDF(*[c.strip().lower() for c in raw.columns])
    names = [c for c in ("path", "source_path", "relative_path") if c in rows.columns]
    if "category" not in rows.columns or not names:
        raise ValueError("a manifest needs a category and one of path, source_path, relative_path")
    out = rows.select(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in names]).alias("path"), F.lower(F.nullif(F.trim("category"), F.lit(""))).alias("category"))
    told = out.agg(F.count("*").alias("n"), F.count_if(F.col("path").isNull() | F.col("category").isNull()).alias("bad")).first()
    if told["bad"]:
        raise ValueError(f"{told['bad']} rows of the manifest have no path or category")
    if not told["n"] and not allow_empty:
        raise ValueError("the manifest is empty")
    return out


def of_modality(manifest: DataFrame, modality: str) -> DataFrame:
    return manifest.where(F.col("category") == modality)


def unknown_categories(manifest: DataFrame, expected: tuple[str, ...] = MODALITIES) -> DataFrame:
    return manifest.where(~F.col("category").isin(*expected)).groupBy("category").agg(F.count("*").alias("n"))


def modality_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("category").agg(F.count("*").alias("n"))
