"""Scans: directories, text files, datasets, manifests, lists. All through Spark's readers, so any store works."""

from __future__ import annotations

import io
import json
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftspark.functions.text import json_objects, parse_index


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place))


def scan_files(spark: SparkSession, root: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of all files below root; content is only read if it is used."""
    if not exists(spark, root):
        raise FileNotFoundError(root)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(root)


def empty_files(spark: SparkSession, root: str) -> DataFrame:
    """The files without bytes below root, which Spark's binary reader leaves out; columns as in scan_files().

    The driver walks the listing, so this is for file trees, not for stores with very many objects.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    listing, rows = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(place, True), []
    while listing.hasNext():
        file = listing.next()
        if file.getLen() == 0:
            rows.append((file.getPath().toString(), file.getModificationTime() / 1000))
    return spark.createDataFrame(rows, "path string, t double").select("path", F.timestamp_seconds("t").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit("").cast("binary").alias("content"))


def scan_wav(spark: SparkSession, root: str) -> DataFrame:
    return scan_files(spark, root, "*.wav", recursive=False)


def headers(files: DataFrame, size: int = 4096) -> DataFrame:
    return files.withColumn("header", F.coalesce(F.substring("content", 1, size), F.lit("").cast("binary")))


def decode_texts(files: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """files with text: bytes that are no text in the encoding are left out."""
    @F.pandas_udf("string")
    def text(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: None if c is None else bytes(c).decode(encoding, "ignore"))

    return files.withColumn("text", text("content")).drop("content")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path of each non-blank line, trimmed; an empty table if there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string")
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def read_indices(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """id of each line that is an integer; other lines are left out (strict: an error)."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.trim("value").cast("bigint").alias("id")) if strict else lines.select(parse_index(F.col("value")).alias("id")).where("id is not null")


def read_pairs(spark: SparkSession, path: str, threshold: float = 0.83) -> DataFrame:
    """a, b, similarity of lines `Pair: (i, j), Similarity: s` with at least the threshold."""
    part = lambda i: F.regexp_extract("value", r"Pair:\s*\((\d+),\s*(\d+)\),\s*Similarity:\s*([0-9.eE+-]+)", i)
    rows = spark.read.text(path).where(part(1) != "").select(part(1).cast("bigint").alias("a"), part(2).cast("bigint").alias("b"), part(3).cast("double").alias("similarity"))
    return rows.where(F.col("similarity") >= threshold)


def _is_json(text: str | None) -> bool:
    try:
        json.loads(text or "")
        return True
    except (ValueError, RecursionError):
        return False


def _one_document(spark: SparkSession, path: str) -> bool:
    """Whether JSON files hold one array or object over several lines, rather than one object a line. Told by the first
    line; only if that is no JSON by itself, by whether whole files are."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    if not first or _is_json(first[0]["value"]):
        return bool(first) and first[0]["value"].lstrip().startswith("[")

    @F.pandas_udf("boolean")
    def whole(texts: pd.Series) -> pd.Series:
        return texts.map(_is_json)

    return bool(spark.read.text(path, wholetext=True).agg(F.min(whole("value")).alias("w")).first()["w"])


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


#: Column that Spark puts broken lines in.
CORRUPT = "_corrupt_line"


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON Lines, a JSON array, {"data": [...]} or one JSON object; CSV with a header; or Parquet, by suffix.

    Broken lines of JSON Lines are no rows; bad_rows() has them, and good lines around them stay.
    """
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if kind not in ("json", "jsonl"):
        raise ValueError(f"unknown kind of dataset: {path}")
    if _one_document(spark, path):
        rows = spark.read.option("multiLine", True).json(path)
    else:
        rows = _json_lines(spark, path)
        if CORRUPT in rows.columns:
            rows = spark.createDataFrame([], "value string") if rows.columns == [CORRUPT] else rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    if rows.columns == ["data"] and rows.schema["data"].dataType.typeName() == "array":
        rows = rows.select(F.explode("data").alias("d")).select("d.*")
    return rows


def bad_rows(spark: SparkSession, path: str) -> DataFrame:
    """line: the lines of a JSON Lines dataset that are no JSON. Count them before relying on read_dataset()'s rows."""
    none = spark.createDataFrame([], "line string")
    if path.rsplit(".", 1)[-1].lower() not in ("json", "jsonl") or _one_document(spark, path):
        return none
    rows = _json_lines(spark, path)
    if CORRUPT not in rows.columns:
        return none
    # the schema is told, so Spark parses once more and no inference runs
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = F.from_json("value", f"`{CORRUPT}` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select("value", parsed[CORRUPT].alias("bad")).where("bad is not null").select(F.col("value").alias("line"))


def read_concatenated(spark: SparkSession, path: str, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """text, label of JSON objects that stand one after the other in files, with line ends between them or not.

    Objects without either are left out, and so is what is no object. Files are read whole.
    """
    objects = spark.read.text(path, wholetext=True).select(F.explode(json_objects(F.col("value"))).alias("o"))
    return objects.select(F.get_json_object("o", f"$.{text_col}").alias("text"), F.get_json_object("o", f"$.{label_col}").alias("label")).where("text is not null and label is not null")


def list_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind, length of the JSON, CSV and Parquet files right in a folder, by path. Contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,jsonl,csv,parquet}").load(folder)
    return found.select("path", F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("kind"), "length").orderBy("path")


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """place, field, type, length of the fields of the first n rows: a look at the format."""
    some = rows.limit(n).withColumn("_place", F.monotonically_increasing_id())
    each = F.array(*[F.struct(F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type"), F.length(F.col(f"`{f.name}`").cast("string")).alias("length")) for f in rows.schema if f.dataType.typeName() not in ("array", "map", "struct", "variant")])
    return some.select((F.row_number().over(Window.orderBy("_place")) - 1).alias("place"), F.explode(each).alias("x")).select("place", "x.*")


def labelled(rows: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """text and label where both are there."""
    return rows.select(F.col(text_col).alias("text"), F.col(label_col).alias("label")).where("text is not null and label is not null")


def valid_texts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    return rows.where(F.col(text_col).isNotNull() & (F.trim(F.col(text_col)) != ""))


def image_sources(spark: SparkSession, files_root: str | None = None, lists: Iterable[str] = (), records: Iterable[str] = ()) -> DataFrame:
    """source: image files below a folder, lines of text lists, strings (or url, image_url, img) of JSON lists; distinct, sorted."""
    parts = []
    if files_root:
        parts.append(scan_files(spark, files_root).where(F.lower("path").rlike(r"\.(jpe?g|png|gif|bmp|webp)$")).select(F.col("path").alias("source")))
    parts += [read_lines(spark, p).select(F.col("path").alias("source")) for p in lists]
    for p in records:
        item = F.explode(F.from_json("value", "array<string>")).alias("item")
        rows = spark.read.text(p, wholetext=True).select(item)
        url = F.coalesce(*[F.get_json_object("item", f"$.{k}") for k in ("url", "image_url", "img")], F.when(~F.col("item").startswith("{"), F.col("item")))
        parts.append(rows.select(url.alias("source")).where("source is not null"))
    out = parts[0] if parts else spark.createDataFrame([], "source string")
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.distinct().orderBy("source")


def json_records(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the JSON files of a folder, lists of objects or of strings (url): text columns for the union of all keys."""
    items = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("item")).where("item is not null")
    is_object = F.col("item").startswith("{")
    rows = items.select(F.when(is_object, F.from_json("item", "map<string,string>")).otherwise(F.create_map(F.lit("url"), F.col("item"))).alias("m"))
    # as many values as the result has columns
    keys = sorted(r["k"] for r in rows.select(F.explode(F.map_keys("m")).alias("k")).distinct().collect())
    return rows.select(*[F.col("m")[k].alias(k) for k in keys]) if keys else spark.createDataFrame([], "url string")


def raw_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """idx, embedding of a .npy or raw float32 file; a size that is no multiple of a row is an error. Files are read whole: for import only."""
    def rows(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                if bytes(data[:6]) == b"\x93NUMPY":
                    m = np.load(io.BytesIO(data), allow_pickle=False).astype(np.float32).reshape(-1, dim)
                elif len(data) % (4 * dim):
                    raise ValueError(f"{len(data)} bytes are no whole number of rows of {dim} floats")
                else:
                    m = np.frombuffer(data, np.float32).reshape(-1, dim)
                for i in range(0, len(m), 4096):
                    yield pd.DataFrame({"idx": np.arange(i, min(i + 4096, len(m))), "embedding": list(m[i : i + 4096])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "idx long, embedding array<float>")


def cluster_rows(spark: SparkSession, path: str) -> DataFrame:
    """idx, path, dist of tab-separated cluster files."""
    return spark.read.option("sep", "\t").schema("idx long, path string, dist double").csv(path)


def cluster_members(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """cluster, idx, path of the files cluster_N.npy (rows of path, idx, distance, cluster) and cluster_N.txt (idx, path,
    distance by tabs) of a folder. A cluster that has both comes from .npy. wanted: only these idx (column idx)."""
    def rows(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            for cluster, npy, data in zip(frame["cluster"], frame["npy"], frame["content"], strict=True):
                found = []
                if npy:
                    found = [(int(float(r[1])), str(r[0])) for r in np.load(io.BytesIO(data), allow_pickle=False)]
                else:
                    for line in bytes(data).decode("utf-8", "ignore").splitlines():
                        parts = line.split("\t")
                        if parts[0].strip().lstrip("-").isdigit():
                            found.append((int(parts[0]), parts[1] if len(parts) > 1 else None))
                yield pd.DataFrame([(cluster, *x) for x in found], columns=["cluster", "idx", "path"])

    scanned = spark.read.format("binaryFile").option("pathGlobFilter", "cluster_*.{npy,txt}").load(folder)
    named = scanned.select(F.regexp_extract("path", r"cluster_(\d+)\.\w+$", 1).cast("long").alias("cluster"), F.col("path").endswith(".npy").alias("npy"), "content").where("cluster is not null")
    first = named.groupBy(F.col("cluster").alias("_c")).agg(F.max("npy").alias("_any"))
    members = named.join(first, (F.col("cluster") == F.col("_c")) & (F.col("npy") == F.col("_any"))).select("cluster", "npy", "content").mapInPandas(rows, "cluster long, idx long, path string")
    return members if wanted is None else members.join(wanted.select("idx").distinct(), "idx", "left_semi")


def fingerprint_store(spark: SparkSession, path: str, key_col: str = "key", value_col: str = "fingerprint") -> DataFrame:
    """key, fingerprint of a Parquet store of precomputed fingerprints; lookup.fuzzy() joins it to paths."""
    return spark.read.parquet(path).select(F.col(key_col).alias("key"), F.col(value_col).alias("fingerprint"))
