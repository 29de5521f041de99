"""The pipeline's stages, each on its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from siftspark.llm import bpe, secrets
from siftspark.llm.queries import oracle_sql, queries, word_bpe_path
from tests.llm.test_pieces import shingle_sets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        out.append(docs.toPandas())
        docs = spark.createDataFrame(out[-1].astype(object).where(out[-1].notna(), None), docs.schema)
    return out


def test_stages(spark, stages):
    first = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    good, single, hidden, mixed, tokens = stages
    assert len(pipeline.STAGES) == 5 and all(list(x.columns) == list(pipeline.COLUMNS) for x in stages[:4])
    assert 0 < len(good) < len(first)
    sets = shingle_sets(dict(zip(good["doc_id"], good["text"])))
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and group[i] != group[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                group = {k: group[i] if g == group[j] else g for k, g in group.items()}
    assert sorted(single["doc_id"]) == sorted({min(i for i in sets if group[i] == g) for g in set(group.values())})
    assert sorted(hidden["doc_id"]) == sorted(single["doc_id"])
    was = dict(zip(single["doc_id"], single["text"]))
    for i, t, n in zip(hidden["doc_id"], hidden["text"], hidden["n_chars"]):
        assert not re.search(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}", t) and (t == was[i] or ("[REDACTED]" in t and n == len(t)))
    assert set(mixed["doc_id"]) <= set(hidden["doc_id"]) and mixed["doc_id"].value_counts().max() <= 2
    words = lambda df: df["text"].map(lambda t: len(t.encode().split())).sum()
    assert words(mixed) / words(hidden) == pytest.approx(1.5, rel=0.05)
    own = bpe.codec(word_bpe_path())
    text = dict(zip(mixed["doc_id"], mixed["text"]))
    assert len(tokens) == len(mixed) and all(own.text(text[i])[0] == ids for i, ids in zip(tokens["doc_id"], tokens["ids"]))


def test_run_gives_the_same_tokens(spark, stages):
    rows = pipeline.run(spark, SF).select("doc_id", "n_tokens").toPandas()
    assert sorted(map(tuple, rows.to_numpy())) == sorted(map(tuple, stages[-1][["doc_id", "n_tokens"]].to_numpy()))


def test_registry():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries()] == list(range(1, 11)) and set(oracle_sql()) <= set(queries())
    assert secrets.RULES[0].version != secrets.RULES[1].version and F.lit(1) is not None


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(0, None, None, None, None), (None, "a b c", "en", "s", 5), (1, "", "en", None, 0), (2, "same text here", "en", "s", 14), (2, "same text here", "en", "s", 14), (3, "same text here", "en", "t", 14), (4, "token: abcdefghijklmnop " * 30, "en", "s", 720), (5, "word " * 30_000, None, "", 150_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("fp", F.lit(1)).withColumn("secrets", F.lit("x"))
    spark.createDataFrame([(2, 1), (4, 0), (None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name == "SimHash near-dedup":
            assert sorted(str(r["doc_id"]) for r in got) == ["0", "2", "4", "5", "None"]  # empty texts are one group
        elif name == "secret scans":
            assert len(got) == len(rows) and not any("abcdefghijklmnop" in (r["text"] or "") for r in got)
        elif name == "mixing sources":
            assert {r["doc_id"] for r in got} <= {None, 2, 3, 4, 5} and max(sum(r["doc_id"] == i for r in got) for i in (3, 4, 5)) <= 2
        elif name == "BPE encoding":
            assert len(got) == len(rows) and sum(r["n_tokens"] == 0 for r in got) == 2
