"""Joins that the deduplication pipelines need: lookups by several spellings of a path, keep and remove lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions.text import first_number, lookup_tokens, path_variants
from siftspark.operators.fold import numbered


def by_variants(paths: DataFrame, store: DataFrame, path_col: str = "path", store_col: str = "path", value_col: str = "idx") -> DataFrame:
    """paths with value_col of the store row whose spelling matches first; null if none does.

    Spellings of one store path count from its least value.
    """
    asked = paths.select(F.col(path_col).alias("_p")).distinct().select("_p", F.posexplode(path_variants(F.col("_p"))).alias("_at", "_key"))
    told = store.select(F.explode(path_variants(F.col(store_col))).alias("_key"), F.col(value_col).alias("_v")).groupBy("_key").agg(F.min("_v").alias("_v"))
    found = asked.join(told, "_key").groupBy("_p").agg(F.min_by("_v", "_at").alias(value_col))
    return paths.join(found, paths[path_col] == found["_p"], "left").drop("_p")


def missing(looked_up: DataFrame, value_col: str = "idx") -> DataFrame:
    return looked_up.where(F.col(value_col).isNull())


def fuzzy(paths: DataFrame, store: DataFrame, path_col: str = "path", key_col: str = "key") -> DataFrame:
    """paths with match (a store key): the exact path, else its base name, else a shared token (same base name first,
    then the first key by order); null if nothing is shared."""
    base = lambda c: F.regexp_extract(c, r"([^/\\]*)$", 1)
    p, k = F.col(path_col), F.col(key_col)
    keys = lambda c: F.concat(F.array(F.struct(F.lit(0).alias("r"), c.alias("t")), F.struct(F.lit(1).alias("r"), base(c).alias("t"))), F.transform(lookup_tokens(c), lambda t: F.struct(F.lit(2).alias("r"), t.alias("t"))))
    asked = paths.select(p.alias("_p")).distinct().select("_p", F.explode(keys(F.col("_p"))).alias("x")).select("_p", "x.r", "x.t")
    told = store.select(k.alias("_k"), F.explode(keys(k)).alias("x")).select("_k", "x.r", "x.t")
    # of the keys that share a token the first of each base name is enough
    met = asked.join(told, ["r", "t"]).groupBy("_p").agg(F.min(F.struct("r", (base(F.col("_p")) != base(F.col("_k"))).alias("other"), "_k")).alias("m"))
    found = met.select("_p", F.col("m._k").alias("match"))
    return paths.join(found, paths[path_col] == found["_p"], "left").drop("_p")


def keep_only(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return rows.join(ids.select(on), on, "left_semi")


def remove(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return rows.join(ids.select(on), on, "left_anti")


def removed_files(removed: DataFrame, files: DataFrame, id_col: str = "id", path_col: str = "path") -> DataFrame:
    """id and path of the files that ids stand for: by the file's place in order (from 0), else by the number in its name."""
    at = numbered(files.select(F.col(path_col).alias("path")), "path", "place")
    by_place = removed.select(F.col(id_col).cast("long").alias("id")).distinct().join(at, F.col("id") == F.col("place"), "left").select("id", "path")
    by_name = files.select(first_number(F.regexp_extract(path_col, r"([^/\\]*)$", 1)).cast("long").alias("n"), F.col(path_col).alias("other")).where("n is not null").groupBy("n").agg(F.min("other").alias("other"))
    return by_place.join(by_name, F.col("id") == F.col("n"), "left").select("id", F.coalesce("path", "other").alias("path"))


def existing(paths: DataFrame, listing: DataFrame, path_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """(existing, missing) by a listing of files."""
    return keep_only(paths, listing, path_col), remove(paths, listing, path_col)


def by_position(left: DataFrame, right: DataFrame, idx: str = "idx") -> DataFrame:
    """Rows that were side by side in two stores, by their explicit index."""
    return left.join(right, idx)


def accessible(manifest: DataFrame, listing: DataFrame, path_col: str = "path", strict: float = 0.10, most: int | None = None) -> DataFrame:
    """One row: total, missing, share, ok. ok: the missing share is at most `strict` and the number at most `most`."""
    m = manifest.join(listing.select(path_col).withColumn("_there", F.lit(True)), path_col, "left")
    out = m.agg(F.count("*").alias("total"), F.count_if(F.col("_there").isNull()).alias("missing"))
    share = F.when(F.col("total") > 0, F.col("missing") / F.col("total")).otherwise(F.lit(0.0))
    return out.withColumn("share", share).withColumn("ok", (F.col("share") <= strict) & (F.lit(True) if most is None else F.col("missing") <= most))
