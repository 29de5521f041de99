"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is content-addressed (SHA-256). The ledger holds a row for each pair of blob and rule version
that was scanned, with or without findings. A run scans the pairs it lacks, appends them, and joins the findings back
to all paths (rows) that carry the blob.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm.shared import fresh, scratch, stored


@dataclass(frozen=True)
class Rule:
    """Matches of a Java pattern, leftmost and non-overlapping, whose group has at least `least` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    #: A pattern without which there is no finding; a cheap test for the many clean texts.
    needs: str = ""

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.least, self.group)).encode()).hexdigest()[:16]

    def spans(self, text: Column) -> Column:
        """array<struct<start, end>> in code points, end exclusive; of all matches, dropped ones are consumed too.

        The text between matches comes from split(), the matches from regexp_extract_all(); running sums of their
        lengths are the places.
        """
        matches, parts = F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0)), F.split(text, self.pattern, -1)
        told = matches if self.group == 0 else F.regexp_extract_all(text, F.lit(self.pattern), F.lit(self.group))
        rows = F.arrays_zip(F.slice(F.transform(parts, F.length), 1, F.size(matches)).alias("gap"), F.transform(matches, F.length).alias("size"), F.transform(told, F.length).alias("told"))
        # Java leaves out an empty first part only before an empty match, and no rule matches nothing
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))
        walked = F.aggregate(
            rows,
            start,
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + x["size"]).alias("at"),
                F.when(
                    x["told"] >= self.least,
                    F.concat(a["found"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end")))),
                )
                .otherwise(a["found"])
                .alias("found"),
            ),
        )
        none = F.array().cast("array<struct<start:int,end:int>>")
        return F.when(text.rlike(self.needs or self.pattern), walked["found"]).otherwise(none)


# The base rules, in the order in which kinds are listed.
RULES = (
    Rule(
        "assign",
        r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        2,
        r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, r"AKIA[A-Z0-9]{14}"),
    Rule("hex", r"[0-9a-f]+", 16, 0, r"[0-9a-f]{16}"),
)

LEDGER = "blob string, kind string, version string, spans array<struct<start:int,end:int>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(LEDGER).parquet(path) if there else None


def update_ledger(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Scans the pairs of blob and rule version that the ledger (a path) lacks, appends them and returns the ledger.

    Null texts are the empty blob. Rows with the same text are one blob. An empty table leaves an empty ledger.
    A run that fails leaves whole pairs or none; pairs that were written twice say the same and count once.
    """
    spark, before = docs.sparkSession, _ledger(docs.sparkSession, ledger)
    texts = docs.select(blob_of(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if before is not None:
        seen = before.groupBy("blob").agg(F.collect_set("version").alias("seen"))
        # thin rows first: only blobs that lack a rule take their texts along
        lacking = texts.select("blob").distinct().join(seen, "blob", "left").where(
            F.size(F.array_except(F.array(*[F.lit(r.version) for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))) > 0
        )
        texts = texts.join(lacking, "blob")
    else:
        texts = texts.withColumn("seen", F.array().cast("array<string>"))
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"), F.first("seen").alias("seen"))
    scanned = blobs.select(
        "blob",
        F.explode(
            F.array(*[
                F.struct(
                    F.lit(r.kind).alias("kind"),
                    F.lit(r.version).alias("version"),
                    F.when(~F.array_contains(F.coalesce("seen", F.array().cast("array<string>")), r.version), r.spans(F.col("text"))).alias("spans"),
                )
                for r in rules
            ])
        ).alias("r"),
    ).where("r.spans is not null").select("blob", "r.kind", "r.version", "r.spans")
    scanned.write.mode("append").option("compression", "zstd").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger)


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with secrets: array<struct<start, rank, end, kind>> by start, then kind as listed; empty where there are none.

    A column of docs called secrets gives way. Offsets count code points. ledger: a path, new by default.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "secrets"])
    done = update_ledger(docs, ledger or scratch(docs.sparkSession, "ledger"), rules, text_col)
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.version, i)])
    blob, hits = fresh(docs, "blob", "found")
    found = (
        done.where(F.col("version").isin([r.version for r in rules]) & (F.size("spans") > 0))
        .dropDuplicates(["blob", "version"])
        .withColumn("rank", rank[F.col("version")])
        .select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), s["end"].alias("end"), F.col("kind").alias("kind"))).alias("s"))
        .groupBy(F.col("blob").alias(blob))
        .agg(F.array_sort(F.flatten(F.collect_list("s"))).alias(hits))
    )
    # findings as a table of their own: Spark knows their size, and can split the rows of a blob with very many paths
    found = stored(found, "findings")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return docs.withColumn(blob, blob_of(F.col(text_col))).join(found, blob, "left").withColumn("secrets", F.coalesce(hits, none)).drop(blob, hits)


def spans_text(secrets: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, comma-joined."""
    some = secrets if kinds is None else F.filter(secrets, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, mark: str = "[REDACTED]", text_col: str = "text", secrets_col: str = "secrets") -> DataFrame:
    """Every span of secrets becomes mark; overlapping spans become one. Texts without secrets and null ones stay."""
    text, spans = F.col(text_col), F.col(secrets_col)
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    walked = F.aggregate(
        spans,
        first,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], text.substr(a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))),
    )
    return docs.withColumn(text_col, F.when(F.size(spans) > 0, walked).otherwise(text))
