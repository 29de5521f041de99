"""The whole run: sort, deduplicate each modality, report. Configuration, resume and a command line."""

from __future__ import annotations

import argparse
import hashlib
import json
import logging
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, fields
from datetime import datetime, timezone
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions import media
from siftspark.operators import dedup, lookup, resolve, semdedup, stats
from siftspark.session import checkpointed
from siftspark.sources import files, manifest, sinks

log = logging.getLogger("siftspark")


@dataclass
class Config:
    """Settings of a run. Unknown keys are an error."""

    input_root: str = ""
    output_root: str = ""
    #: Without sorting, the manifest of the newest run under output_root is used.
    sorter: bool = True
    strict_sniff: bool = False
    list_empty: bool = True
    text: dict = field(default_factory=lambda: {"method": "ours_lsh", "threshold": 0.8, "n": 3})
    image: dict = field(default_factory=lambda: {"method": "sem_dedup", "eps": 0.15})
    audio: dict = field(default_factory=lambda: {"method": "phash", "threshold": 0.75})
    copy: bool = False


def merged(base: dict, over: dict) -> dict:
    """over on base, dictionaries key by key."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load_config(path: str | None = None, **over: object) -> Config:
    """From YAML or JSON on the defaults; relative roots are left to the caller."""
    told: dict = {}
    if path:
        with open(path, encoding="utf-8") as file:
            if path.endswith((".yaml", ".yml")):
                import yaml

                told = yaml.safe_load(file) or {}
            else:
                told = json.load(file)
    settings = merged(merged(asdict(Config()), told), over)
    known = {f.name for f in fields(Config)}
    if extra := set(settings) - known:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    return Config(**settings)


def config_hash(config: Config) -> str:
    return hashlib.sha256(json.dumps(asdict(config), sort_keys=True).encode()).hexdigest()


class Locked(RuntimeError):
    """Another run of the same configuration is under way."""


class Pipeline:
    """run() gives the manifest, each modality's rows with kept, and a report. Results of a configuration are kept under
    its hash; a second run of it reads what is there and goes on behind the last stage that ended.

    While a run is under way its folder holds _LOCK, and a second one is refused; a stage that fails leaves NAME._FAILURE
    with the reason. Modalities are independent jobs and run side by side.
    """

    def __init__(self, spark: SparkSession, config: Config, features: dict | None = None):
        """features: for image and audio a function from files (path, length, content) to rows with path and a value column
        (null: no feature); the package's own by default. Under "open_clip" a column function for that image backend."""
        self.spark, self.config, self.features = spark, config, features or {}
        self.root = f"{config.output_root.rstrip('/')}/run-{config_hash(config)[:16]}"
        self.seconds: dict[str, float] = {}

    def _stage(self, name: str, make: object) -> DataFrame:
        path, failed = f"{self.root}/{name}", f"{self.root}/{name}._FAILURE"
        if not files.exists(self.spark, f"{path}/_SUCCESS"):
            log.info("stage %s begins", name)
            began = time.time()
            try:
                make().write.mode("overwrite").parquet(path)
            except Exception as e:
                sinks.write_text(self.spark, failed, f"{type(e).__name__}: {e}")
                log.error("stage %s failed: %s", name, e)
                raise
            sinks.delete(self.spark, failed)
            self.seconds[name] = time.time() - began
            log.info("stage %s took %.1f s", name, self.seconds[name])
        return self.spark.read.parquet(path)

    def run(self) -> dict[str, DataFrame]:
        if not sinks.write_text(self.spark, f"{self.root}/_LOCK", datetime.now(timezone.utc).isoformat(), only_new=True):
            raise Locked(f"{self.root}/_LOCK is there")
        try:
            return self._run()
        finally:
            sinks.delete(self.spark, f"{self.root}/_LOCK")

    def _run(self) -> dict[str, DataFrame]:
        scanned = files.scan_files(self.spark, self.config.input_root)
        if self.config.list_empty:
            scanned = scanned.unionByName(files.empty_files(self.spark, self.config.input_root))
        if self.config.sorter:
            out = {"manifest": self._stage("manifest", lambda: manifest.sort_files(scanned, self.config.input_root, self.config.strict_sniff))}
        else:
            out = {"manifest": self.spark.read.parquet(latest_manifest(self.spark, self.config.output_root))}

        def dedup_of(modality: str) -> DataFrame:
            paths = out["manifest"].where(F.col("category") == modality).select(F.col("source_path").alias("path"), "size_bytes")
            rows = lambda: self._dedup(modality, scanned.join(paths.select("path"), "path", "left_semi"))
            return self._stage(modality, lambda: rows().select("path", "kept", "original", "similarity", "missing").join(paths, "path"))

        with ThreadPoolExecutor(len(manifest.MODALITIES)) as pool:
            out |= dict(zip(manifest.MODALITIES, pool.map(inheritable_thread_target(self.spark)(dedup_of), manifest.MODALITIES), strict=True))
        whole = reduce(DataFrame.unionByName, [out[m].select(F.lit(m).alias("modality"), "kept", "size_bytes") for m in manifest.MODALITIES])
        out["summary"] = self._stage("summary", lambda: stats.modality_summary(whole))
        for modality in manifest.MODALITIES:
            groups = resolve.groups(out[modality].where("original is not null"), "path", self._threshold(modality))
            out[f"{modality}_duplicates"] = groups
            if not files.exists(self.spark, f"{self.root}/{modality}-duplicates.json/_SUCCESS"):
                sinks.write_duplicates(groups, f"{self.root}/{modality}-duplicates.json")
            if self.config.copy:
                out[f"{modality}_copies"] = self._stage(f"{modality}-copies", lambda m=modality: sinks.copy_files(out[m].where("kept").select("path"), f"{self.root}/keepers/{m}"))
        told = {"config": asdict(self.config), "seconds": self.seconds, "modalities": [r.asDict() for r in out["summary"].collect()]}
        sinks.write_text(self.spark, f"{self.root}/summary.json", json.dumps(told, ensure_ascii=False, indent=2))
        sinks.write_text(self.spark, f"{self.root}/report.md", markdown(out["summary"]))
        return out

    def _threshold(self, modality: str) -> float | None:
        how = getattr(self.config, modality)
        return how.get("threshold", 1 - how["eps"] if "eps" in how else None)

    def _dedup(self, modality: str, rows: DataFrame) -> DataFrame:
        """rows with kept, original, similarity and missing (true: no feature, so neither kept nor compared, for images;
        kept, for audio)."""
        how = dict(getattr(self.config, modality))
        method = how.pop("method")
        if method == "file_hash":
            return dedup.file_hash(rows, algorithm=how.get("algorithm", "sha1")).drop("content").withColumn("missing", F.lit(False))
        if modality == "text":
            return dedup.text_pipeline(files.decode_texts(rows), method, order_col="path", **how).withColumn("missing", F.lit(False))
        if modality == "audio":
            if method == "md5":
                return dedup.by_key(rows, F.md5("content"), "path").drop("content").withColumn("missing", F.lit(False))
            own = {"phash": media.audio_phash, "mfcc": media.audio_mfcc}.get(method, media.audio_fingerprint)
            valued = self._valued("audio", rows, own)
            return dedup.audio_pipeline(valued, method, order_col="path", value_col="value", **how).withColumn("missing", F.col("value").isNull())
        if method not in ("pairwise", "sem_dedup", "semdedup", "legacy"):
            raise ValueError(f"unknown image method {method}")
        plugins = {"open_clip": self.features["open_clip"]} if "open_clip" in self.features else {}
        backend = media.choose_backend(how.pop("backend", "auto"), how.pop("fallback", "average_rgb"), plugins) if "image" not in self.features else None
        valued = self._valued("image", rows, backend)
        ok = valued.where("value is not null")
        if method == "pairwise":
            done = dedup.cosine(ok, 1 - how["eps"], order_col="path", vector_col="value")
        else:
            done = self._semantic(ok, method, how)
        lost = valued.where("value is null").select("path", F.lit(False).alias("kept"), F.lit(None).cast("string").alias("original"), F.lit(None).cast("double").alias("similarity"), F.lit(True).alias("missing"))
        return done.select("path", "kept", "original", "similarity", F.lit(False).alias("missing")).unionByName(lost)

    def _valued(self, modality: str, rows: DataFrame, own: object) -> DataFrame:
        featurize = self.features.get(modality)
        made = featurize(rows).select("path", "value") if featurize else media.with_feature(rows.select("path", "content"), own).select("path", "value")
        return checkpointed(made)

    def _semantic(self, rows: DataFrame, method: str, how: dict) -> DataFrame:
        """sem_dedup: clusters found here. With keep_indices_file and cluster_dir (legacy) those of an earlier run: its kept
        ids stay, and others belong to the most similar kept row of their cluster. No cluster that matches: all pairs."""
        if not how.get("keep_indices_file") or not how.get("cluster_dir"):
            if method == "legacy":
                raise ValueError("legacy needs keep_indices_file and cluster_dir")
            return semdedup.dynamic(rows, how["eps"], id_col="path", vector_col="value")
        members = files.cluster_members(self.spark, how["cluster_dir"])
        known = lookup.by_variants(rows, members, "path", "path", "idx").where("idx is not null").join(members.select("idx", "cluster").dropDuplicates(["idx"]), "idx")
        known = checkpointed(known)
        if known.isEmpty():
            return dedup.cosine(rows, 1 - how["eps"], order_col="path", vector_col="value")
        done = semdedup.apply_keep_list(known, files.read_indices(self.spark, how["keep_indices_file"]), "cluster", "idx", "value")
        named = known.select(F.col("idx").alias("original"), F.col("path").alias("original_path"))
        return done.join(named, "original", "left").select("path", "kept", F.col("original_path").alias("original"), "similarity")


def latest_manifest(spark: SparkSession, output_root: str) -> str:
    """The manifest of the newest run below output_root, for runs that do not sort."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{output_root.rstrip('/')}/run-*/manifest/_SUCCESS")
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place) or []
    if not len(found):
        raise FileNotFoundError(f"no run below {output_root} has a manifest")
    newest = max(found, key=lambda f: f.getModificationTime())
    return newest.getPath().getParent().toString()


def markdown(summary: DataFrame) -> str:
    """The summary as a Markdown table: a row for each modality, and one for all."""
    rows = sorted(summary.collect(), key=lambda r: (r["modality"] is None, r["modality"] or ""))
    show = lambda x, f: "-" if x is None else format(x, f)
    lines = [f"# Deduplication report\n\n{datetime.now(timezone.utc):%Y-%m-%d %H:%M} UTC\n", "| modality | candidates | unique | duplicates | dedup rate | MB | MB kept |", "| --- | --- | --- | --- | --- | --- | --- |"]
    for r in rows:
        lines.append(f"| {r['modality'] or 'all'} | {r['candidates']:,} | {r['unique']:,} | {r['duplicates']:,} | {show(r['dedup_rate'], '.2%')} | {show((r['bytes'] or 0) / 2**20, ',.2f')} | {show((r['kept_bytes'] or 0) / 2**20, ',.2f')} |")
    return "\n".join(lines) + "\n"


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Sort a folder of files, drop near-duplicates of each modality, report.")
    parser.add_argument("--config")
    parser.add_argument("--input")
    parser.add_argument("--output")
    told = parser.parse_args(args)
    over = {k: v for k, v in (("input_root", told.input), ("output_root", told.output)) if v}
    from siftspark.session import get_session

    done = Pipeline(get_session(), load_config(told.config, **over)).run()
    print(markdown(done["summary"]))


if __name__ == "__main__":
    main()
