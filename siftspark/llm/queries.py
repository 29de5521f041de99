"""The queries of this subpackage: op1 to op10. Each reads whole tables and takes its rows from its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm import ann, bpe, classifier, mixing, rules, secrets, sharding, simhash, suffixes, warc
from siftspark.llm.shared import stored, table

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 40


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, word_bpe_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"), with_text=False)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(table(spark, sf_dir, "pages"))
    seen = warc.captures(warc.read(spark, path, with_payload=False))
    return seen.select(
        F.col("metadata.page_id").alias("page_id"), F.col("reply.payload_bytes").alias("payload_bytes"), F.col("reply.digest").alias("payload_digest"),
        F.col("reply.kind").alias("record_type"), F.col("metadata.refers_to_page").alias("refers_to"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = stored(simhash.with_fingerprints(docs).drop("text"), "fingerprints")
    return simhash.classes(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = classifier.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    held_out = F.coalesce(classifier.fold("doc_id") == 0, F.lit(False))
    return classifier.score(docs, forest).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = stored(mixing.measured(docs).drop("text").withColumn("row_no", F.monotonically_increasing_id()), "sizes")
    planned = stored(mixing.plan(rows, n_shards=SHARDS), "planned")
    mixture = stored(mixing.draw(planned.select("row_no", "size", "mix_key", "shards")), "mixture")
    taken = mixture.groupBy("row_no").agg(F.sum("size").alias("taken"), F.array_sort(F.collect_list("shard")).alias("shards"))
    own = planned.select("row_no", "doc_id", "size", "source_size", "target")
    return own.join(taken, "row_no", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sharding.write_shards(table(spark, sf_dir, "documents"), SHARDS)
    text = F.coalesce("text", F.lit(""))
    return spark.read.parquet(path).select(
        "doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_kept=False)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = secrets.spans_text(F.col("secrets"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left"
    )


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_bpe, op2_warc, op3_simhash, op4_ann, op5_classifier, op6_mixing, op7_sharding, op8_suffixes, op9_secrets, op10_rules)}


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(
    f"substr('{_LETTERS}', ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {shift}) & 31)::INT + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0)
)

OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages), d AS (SELECT *, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS f FROM p)
SELECT page_id, strlen(b)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = f OR f IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f OR page_id IS NULL THEN f END AS refers_to FROM d"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, '{r.kind}' AS kind, {k} AS rank, {r.least} AS least, string_split_regex(t, {_quoted(r.pattern)}) AS parts, regexp_extract_all(t, {_quoted(r.pattern)}, 0) AS ms, regexp_extract_all(t, {_quoted(r.pattern)}, {r.group}) AS gs FROM docs"
    for k, r in enumerate(secrets.RULES)
)

OP9_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({_FOUND}),
  each AS (SELECT doc_id, kind, rank, least, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(parts[1:len(ms)]) AS gap FROM found),
  placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM each),
  spans AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
    string_agg(kind || ':' || (stop - length(m))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY stop - length(m), rank) AS s FROM placed WHERE length(g) >= least GROUP BY doc_id)
SELECT docs.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans
FROM docs LEFT JOIN spans USING (doc_id)"""

OP10_SQL = rf"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
  words AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '[^ 	-
]+') AS w FROM docs)),
  threes AS (SELECT *, lead(w, 1) OVER v AS w1, lead(w, 2) OVER v AS w2 FROM words WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
  again AS (SELECT *, w2 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1 AS r FROM threes),
  covered AS (SELECT *, r OR coalesce(lag(r, 1) OVER v, false) OR coalesce(lag(r, 2) OVER v, false) AS c FROM again WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
  by_word AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, count(*) FILTER (c) AS n_repeat_words FROM covered GROUP BY doc_id),
  lines AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS l FROM docs),
  full_lines AS (SELECT *, translate(lower(trim(regexp_replace(l, '[ 	-
]+', ' ', 'g'))), '123456789', '000000000') AS folded, len(regexp_extract_all(l, '[^ 	-
]+')) AS n FROM lines WHERE regexp_matches(l, '[^ 	-
]')),
  by_line AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM full_lines GROUP BY doc_id),
  hosts AS (SELECT source AS host, count(DISTINCT t) AS texts FROM docs GROUP BY 1),
  common AS (SELECT source, folded FROM full_lines JOIN hosts ON source IS NOT DISTINCT FROM host GROUP BY 1, 2 HAVING count(DISTINCT t) > {rules.LINE_LEAST} AND count(DISTINCT t) > {rules.LINE_SHARE} * any_value(texts)),
  lost AS (SELECT doc_id, sum(n)::BIGINT AS lost FROM full_lines f JOIN common c ON f.folded = c.folded AND f.source IS NOT DISTINCT FROM c.source GROUP BY doc_id),
  told AS (SELECT docs.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
    FROM docs LEFT JOIN by_word USING (doc_id) LEFT JOIN by_line USING (doc_id) LEFT JOIN lost USING (doc_id)),
  base AS (SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.REPEATED_PERCENT} * n_words AS base_failed FROM told)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - lost >= {rules.LEAST_WORDS} AND n_words - lost >= {1 - rules.DEPLETED_SHARE} * n_words AS kept, n_words - lost AS words_left FROM base"""


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can say; the others are held against brute force in the tests."""
    return {"op2_warc": OP2_SQL, "op9_secrets": OP9_SQL, "op10_rules": OP10_SQL}
