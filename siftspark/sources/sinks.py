"""Sinks: datasets, splits, keep lists, pairs, copies of kept files."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from contextlib import suppress

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def save_dataset(rows: DataFrame, path: str, kind: str = "parquet", split_col: str | None = None) -> None:
    """json (lines), csv (header) or parquet; split_col: a folder for each split."""
    if kind not in ("json", "csv", "parquet"):
        raise ValueError(f"unknown kind of dataset: {kind}")
    writer = rows.write.mode("overwrite")
    if split_col:
        writer = writer.partitionBy(split_col)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Lines `Pair: (i, j), Similarity: s`."""
    pairs.select(F.format_string("Pair: (%s, %s), Similarity: %s", F.col("a").cast("string"), F.col("b").cast("string"), F.col("similarity").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_keep_list(rows: DataFrame, path: str, id_col: str) -> None:
    rows.select(id_col).distinct().orderBy(id_col).write.mode("overwrite").json(path)


def target_names(files: DataFrame, path_col: str = "path", size_col: str | None = None) -> DataFrame:
    """files with target: the base name, and from the second file of that name on with _1, _2 ... before its suffix."""
    name = F.regexp_extract(path_col, r"([^/\\]*)$", 1)
    n = F.row_number().over(Window.partitionBy("_name").orderBy(path_col)) - 1
    stem, suffix = F.regexp_extract("_name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("_name", r"^(.*?)(\.[^.]*)?$", 2)
    return files.withColumn("_name", name).withColumn("_n", n).withColumn("target", F.when(F.col("_n") == 0, F.col("_name")).otherwise(F.concat(stem, F.lit("_"), F.col("_n"), suffix))).drop("_name", "_n")


def copy_files(kept: DataFrame, folder: str, move: bool = False, same_name: str = "rename", attempts: int = 3, category_col: str | None = None) -> DataFrame:
    """Copies (or moves) path to folder/target; path, target, status: copied, linked, skipped, missing or failed. Run by
    the result's action; counts are a groupBy("status").

    same_name: rename (a number before the suffix) or skip (the first file of a name, by path, is copied). category_col: a
    folder for each category. Local files are linked where the file system allows it, unless they move. A file is tried
    again up to `attempts` times. Executors work through the store that each URI names; a task that runs again finds or
    overwrites its own copies.
    """
    to = folder.rstrip("/")
    if same_name not in ("rename", "skip"):
        raise ValueError(f"unknown rule for equal names: {same_name}")

    def one(fs: object, path: str, target: str) -> str:
        (source, a), (sink, b) = (fs.FileSystem.from_uri(x if "://" in x else x.replace("file:", "", 1)) for x in (path, f"{to}/{target}"))
        there = sink.get_file_info(b).type != fs.FileType.NotFound
        if source.get_file_info(a).type == fs.FileType.NotFound:
            # moved by an earlier run of this task
            return "copied" if move and there else "missing"
        sink.create_dir(b.rsplit("/", 1)[0], recursive=True)
        if isinstance(source, fs.LocalFileSystem) and isinstance(sink, fs.LocalFileSystem) and not move:
            with suppress(OSError):
                if there:
                    os.remove(b)
                os.link(a, b)
                return "linked"
        fs.copy_files(a, b, source_filesystem=source, destination_filesystem=sink)
        if move:
            source.delete_file(a)
        return "copied"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        def tried(path: str, target: str, again: bool) -> str:
            if again:
                return "skipped"
            for left in range(max(1, attempts) - 1, -1, -1):
                try:
                    return one(fs, path, target)
                except OSError:
                    if left:
                        time.sleep(0.1)
            return "failed"

        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "target": frame["target"], "status": [tried(*x) for x in zip(frame["path"], frame["target"], frame["again"], strict=True)]})

    named = target_names(kept)
    base = F.regexp_extract("path", r"([^/\\]*)$", 1)
    target = F.col("target") if same_name == "rename" else base
    again = F.lit(False) if same_name == "rename" else F.col("target") != base
    target = target if category_col is None else F.concat(F.col(category_col), F.lit("/"), target)
    return named.select("path", target.alias("target"), again.alias("again")).mapInPandas(run, "path string, target string, status string")


def write_text(spark: SparkSession, path: str, text: str, only_new: bool = False) -> bool:
    """A small file through the store that the path names. only_new: false, and nothing written, if it is there."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = store.create(place, not only_new)
    except Exception as e:  # noqa: BLE001  the store's own kind of "already there"
        if only_new and store.exists(place):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def write_duplicates(groups: DataFrame, path: str) -> bool:
    """Groups of resolve.groups() as JSON lines, one a group; nothing is written if there is none."""
    if groups.isEmpty():
        return False
    groups.write.mode("overwrite").json(path)
    return True


def write_removal(rows: DataFrame, remove: DataFrame, folder: str, id_col: str, name: str = "dataset") -> dict:
    """What a list of ids to remove does to rows: folder/remove_files (text), folder/keep_files (JSON lines of the kept
    rows), folder/metadata.json and folder/report.txt (counts and rate). Returns the metadata."""
    spark, ids = rows.sparkSession, remove.select(id_col).distinct()
    ids.orderBy(id_col).select(F.col(id_col).cast("string").alias("value")).write.mode("overwrite").text(f"{folder}/remove_files")
    kept = rows.join(ids, id_col, "left_anti")
    kept.write.mode("overwrite").json(f"{folder}/keep_files")
    total, n_kept = rows.count(), spark.read.text(f"{folder}/keep_files").count()
    told = {"dataset_name": name, "total_files": total, "kept_files_count": n_kept, "removed_files_count": total - n_kept, "dedup_rate": (total - n_kept) / total if total else None}
    write_text(spark, f"{folder}/metadata.json", json.dumps(told, ensure_ascii=False, indent=2))
    rate = "-" if told["dedup_rate"] is None else format(told["dedup_rate"], ".2%")
    write_text(spark, f"{folder}/report.txt", f"{name}\ntotal {total}\nkept {n_kept}\nremoved {total - n_kept}\nrate {rate}\n")
    return told


def write_sweep(results: DataFrame, path: str, threshold_col: str = "threshold") -> None:
    """Results of several thresholds, each in a folder of its own."""
    results.write.mode("overwrite").partitionBy(threshold_col).json(path)


def write_kept_lists(swept: DataFrame, path: str, id_col: str = "vec_id", cluster_col: str = "cluster") -> None:
    """Of matrix_rule(): the kept ids for each eps (eps=.../part-*.csv, sorted, header), with their cluster."""
    kept = swept.where(~F.col("removed")).select("eps", cluster_col, id_col).distinct()
    kept.repartition("eps").sortWithinPartitions("eps", id_col).write.mode("overwrite").partitionBy("eps").option("header", True).csv(path)


def gather(records: DataFrame, keep: DataFrame, idx_col: str = "idx") -> DataFrame:
    """The records at the kept places: keep has id, records a place of their own in idx_col."""
    return records.join(keep.select(F.col("id").alias(idx_col)).distinct(), idx_col, "left_semi")


def subset(files: DataFrame, n: int, folder: str, seed: int = 42) -> DataFrame:
    """n files chosen by a seeded hash, linked (or copied) to an emptied folder, under the name of the folder they came from;
    statuses as copy_files()."""
    delete(files.sparkSession, folder)
    some = files.select("path").orderBy(F.xxhash64(F.lit(seed), "path"), "path").limit(n)
    return copy_files(some.withColumn("parent", F.regexp_extract("path", r"([^/\\]*)[/\\][^/\\]*$", 1)), folder, category_col="parent")
