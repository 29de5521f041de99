import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftspark.operators import lookup, semdedup
from siftspark.plans import pipeline
from siftspark.sources import files, manifest, sinks
from siftspark.streaming import dedup as streams
from tests.test_media import png, tone, wav


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    for name, data in {
        "a.txt": b"some words in a file", "sub/b.txt": b"some words in a file", "c.md": b"other things to read", "d.png": b"\x89PNG\r\n\x1a\n1",
        "sub/d.png": b"\x89PNG\r\n\x1a\n1", "e.wav": b"RIFF1234WAVE", "f.json": b'{"image": "x"}', "g.bin": bytes(9) * 30, "h.txt": b"",
    }.items():
        (root / name).write_bytes(data)
    return str(root)


def test_run_and_resume(spark, tree, tmp_path):
    config = pipeline.load_config(None, input_root=tree, output_root=str(tmp_path / "out"), text={"method": "md5"}, image={"method": "file_hash"}, audio={"method": "md5"}, copy=True)
    out = pipeline.Pipeline(spark, config).run()
    found = {r["relative_path"]: r["category"] for r in out["manifest"].collect()}
    assert found == {"a.txt": "text", "sub/b.txt": "text", "c.md": "text", "d.png": "image", "sub/d.png": "image", "e.wav": "audio", "f.json": "unknown", "g.bin": "unknown", "h.txt": "unknown"}
    told = {r["modality"]: (r["candidates"], r["duplicates"]) for r in out["summary"].collect()}
    assert told == {"text": (3, 1), "image": (2, 1), "audio": (1, 0), None: (6, 2)}
    root = pipeline.Pipeline(spark, config).root
    assert sorted(os.listdir(f"{root}/keepers/text")) == ["a.txt", "c.md"]
    os.remove(f"{tree}/a.txt")  # a second run reads what is there
    assert pipeline.Pipeline(spark, config).run()["manifest"].count() == 9
    assert "| all | 6 | 4 | 2 |" in pipeline.markdown(out["summary"])


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"text": {"threshold": 0.7}}))
    assert pipeline.load_config(str(path)).text == {"method": "ours_lsh", "threshold": 0.7, "n": 3}
    with pytest.raises(ValueError):
        pipeline.load_config(None, other=1)
    assert pipeline.config_hash(pipeline.Config()) == pipeline.config_hash(pipeline.Config()) != pipeline.config_hash(pipeline.Config(copy=True))


def test_manifests(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(" Category ,Path,source_path\nText, a ,x\nimage,,b\n")
    rows = manifest.read_manifest(spark, str(path))
    assert sorted(map(tuple, rows.collect())) == [("a", "text"), ("b", "image")]
    for bad in ("category\ntext\n", "category,path\n", "category,path\ntext,\n"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            manifest.read_manifest(spark, str(path)).collect()


def test_datasets(spark, tmp_path):
    for name, data in {
        "a.jsonl": '{"text": "x", "label": 1}\n{"text": "y", "label": 2}\n', "b.json": '[{"text": "x", "label": 1},\n {"text": "y", "label": 2}]',
        "c.json": '{"data": [{"text": "x", "label": 1}, {"text": "y", "label": 2}]}', "d.csv": "text,label\nx,1\ny,2\n",
    }.items():
        (tmp_path / name).write_text(data)
        rows = files.labelled(files.read_dataset(spark, str(tmp_path / name)))
        assert sorted((r["text"], int(r["label"])) for r in rows.collect()) == [("x", 1), ("y", 2)], name


def test_lists_and_pairs(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a\n\n b \n")
    assert sorted(r[0] for r in files.read_lines(spark, str(tmp_path / "l.txt")).collect()) == ["a", "b"]
    assert files.read_lines(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "i.txt").write_text("1\nx\n3.0\n")
    assert sorted(r[0] for r in files.read_indices(spark, str(tmp_path / "i.txt")).collect()) == [1, 3]
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5)], "a long, b long, similarity double")
    sinks.write_pairs(pairs, str(tmp_path / "p"))
    assert [tuple(r) for r in files.read_pairs(spark, str(tmp_path / "p")).collect()] == [(1, 2, 0.9)]
    named = sinks.target_names(spark.createDataFrame([("x/a.png",), ("y/a.png",), ("y/b",)], "path string"))
    assert sorted(r["target"] for r in named.collect()) == ["a.png", "a_1.png", "b"]


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "s", "the same text here"), (2, "2024-01-01 00:01:00", "s", "The same, text here"), (3, "2024-01-01 00:02:00", "s", "something else")]
    batch = spark.createDataFrame(rows, "doc_id long, ts string, source string, text string").withColumn("ts", F.to_timestamp("ts"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = streams.exact(stream).writeStream.format("memory").queryName("exact").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("exact").count() == 2
    q = streams.windowed_jaccard(stream).writeStream.format("memory").queryName("win").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["id"], r["kept"]) for r in spark.table("win").collect()) == [(1, True), (2, False), (3, True)]


def test_broken_lines_lose_no_rows(spark, tmp_path):
    good = ['{"text": "x", "label": 1}', '{"text": "y", "label": 2}', '{"text": "z", "label": 3}']
    for name, lines, bad in (("a.jsonl", [good[0], "{broken", *good[1:]], 1), ("b.json", ["{broken", *good, "also broken"], 2), ("c.jsonl", good, 0)):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        rows = files.read_dataset(spark, str(tmp_path / name))
        assert sorted((r["text"], r["label"]) for r in rows.collect()) == [("x", 1), ("y", 2), ("z", 3)], name
        assert files.bad_rows(spark, str(tmp_path / name)).count() == bad, name
    (tmp_path / "d.json").write_text(json.dumps({"data": [{"text": "x"}, {"text": "y"}]}, indent=2))
    assert sorted(r["text"] for r in files.read_dataset(spark, str(tmp_path / "d.json")).collect()) == ["x", "y"]
    (tmp_path / "e.json").write_text(json.dumps({"text": "x", "n": [1]}, indent=2))
    assert [r["text"] for r in files.read_dataset(spark, str(tmp_path / "e.json")).collect()] == ["x"]
    (tmp_path / "f.json").write_text("nothing\nat all\n")
    assert files.read_dataset(spark, str(tmp_path / "f.json")).count() == 0 and files.bad_rows(spark, str(tmp_path / "f.json")).count() == 2


def test_more_readers(spark, tmp_path):
    (tmp_path / "j.txt").write_text('{"text": "a {", "label": 1}{"text": "b", "label": "q"} junk { {"text": "c"}\n{"text": "d", "label": 0}')
    assert sorted(map(tuple, files.read_concatenated(spark, str(tmp_path / "j.txt")).collect())) == [("a {", "1"), ("b", "q"), ("d", "0")]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "one.json").write_text('["http://x/a.png", {"url": "u", "caption": "c"}]')
    (tmp_path / "r" / "two.json").write_text('[{"img": "i"}]')
    rows = files.json_records(spark, str(tmp_path / "r")).collect()
    assert sorted(rows[0].asDict()) == ["caption", "img", "url"] and sorted(str(r["url"]) for r in rows) == ["None", "http://x/a.png", "u"]
    assert [r["kind"] for r in files.list_datasets(spark, str(tmp_path / "r")).collect()] == ["json", "json"]
    m = np.arange(12, dtype=np.float32).reshape(3, 4)
    np.save(tmp_path / "e.npy", m)
    m.tofile(tmp_path / "e.bin")
    for name in ("e.npy", "e.bin"):
        assert sorted((r["idx"], tuple(r["embedding"])) for r in files.raw_vectors(spark, str(tmp_path / name), 4).collect()) == [(i, tuple(v)) for i, v in enumerate(m)]
    (tmp_path / "c").mkdir()
    np.save(tmp_path / "c" / "cluster_0.npy", np.array([["p/a", "0", "0.1", "0"], ["p/b", "1", "0.2", "0"]]))
    (tmp_path / "c" / "cluster_0.txt").write_text("9\tnot\t1\n")
    (tmp_path / "c" / "cluster_1.txt").write_text("2\tp/c\t0.5\nbad line\n3\tp/d\t0.1\n")
    wanted = spark.createDataFrame([(0,), (2,), (9,)], "idx long")
    assert sorted(map(tuple, files.cluster_members(spark, str(tmp_path / "c"), wanted).select("cluster", "idx", "path").collect())) == [(0, 0, "p/a"), (1, 2, "p/c")]
    shown = files.preview(spark.createDataFrame([("ab", 1)] * 9, "t string, n int")).collect()
    assert len(shown) == 10 and {(r["field"], r["type"], r["length"]) for r in shown} == {("t", "string", 2), ("n", "int", 1)}


def test_copies_sweeps_and_removal_lists(spark, tmp_path):
    for name in ("x/a.txt", "y/a.txt", "y/b.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    paths = spark.createDataFrame([(f"file:{tmp_path}/{n}", k) for n, k in (("x/a.txt", "t"), ("y/a.txt", "t"), ("y/b.txt", "u"), ("y/none", "u"))], "path string, kind string")
    told = lambda out: sorted(r["status"] for r in out.collect())
    assert told(sinks.copy_files(paths, str(tmp_path / "o1"))) == ["linked", "linked", "linked", "missing"] and sorted(os.listdir(tmp_path / "o1")) == ["a.txt", "a_1.txt", "b.txt"]
    assert told(sinks.copy_files(paths, str(tmp_path / "o2"), same_name="skip")) == ["linked", "linked", "missing", "skipped"]
    assert sorted(os.listdir(tmp_path / "o2")) == ["a.txt", "b.txt"]
    assert told(sinks.copy_files(paths, str(tmp_path / "o3"), category_col="kind")) == ["linked", "linked", "linked", "missing"]
    assert sorted(os.listdir(tmp_path / "o3")) == ["t", "u"]
    assert told(sinks.copy_files(paths.where("kind = 'u'"), str(tmp_path / "o4"), move=True)) == ["copied", "missing"] and not (tmp_path / "y/b.txt").exists()
    assert sinks.subset(paths.where("kind = 't'"), 2, str(tmp_path / "o5")).where("status = 'linked'").count() == 2 and sorted(os.listdir(tmp_path / "o5")) == ["x", "y"]
    rows = spark.createDataFrame([(i, f"f{i}") for i in range(10)], "id long, name string")
    told = sinks.write_removal(rows, rows.where("id < 3"), str(tmp_path / "rm"), "id", "set")
    assert told["kept_files_count"] == 7 and told["dedup_rate"] == 0.3 and json.loads((tmp_path / "rm" / "metadata.json").read_text()) == told
    assert "30.00%" in (tmp_path / "rm" / "report.txt").read_text() and spark.read.json(str(tmp_path / "rm" / "keep_files")).count() == 7
    sinks.write_sweep(rows.withColumn("threshold", F.lit(0.5)), str(tmp_path / "sw"))
    assert (tmp_path / "sw" / "threshold=0.5").is_dir()
    swept = semdedup.matrix_rule(spark.createDataFrame([(1, 0, 0.1), (2, 0, 0.5)], "vec_id long, cluster int, m double"), [0.6, 0.8])
    sinks.write_kept_lists(swept, str(tmp_path / "kl"))
    kept = spark.read.option("header", True).csv(str(tmp_path / "kl"))
    assert sorted((r["eps"], r["vec_id"]) for r in kept.collect()) == [(0.6, "1"), (0.8, "1")]
    assert sinks.gather(rows, spark.createDataFrame([(4,)], "id long"), "id").count() == 1
    assert not sinks.write_duplicates(spark.createDataFrame([], "original string"), str(tmp_path / "none")) and not (tmp_path / "none").exists()


def test_removed_ids_name_files(spark):
    paths = spark.createDataFrame([("d/audio_7.wav",), ("d/audio_2.wav",), ("d/audio_40.wav",)], "path string")
    ids = spark.createDataFrame([(0,), (2,), (40,), (99,)], "id long")
    assert sorted((r["id"], r["path"]) for r in lookup.removed_files(ids, paths).collect() if r["path"]) == [(0, "d/audio_2.wav"), (2, "d/audio_7.wav"), (40, "d/audio_40.wav")]


def test_media_runs(spark, tmp_path):
    root, rng = tmp_path / "in", np.random.default_rng(4)
    root.mkdir()
    picture = rng.integers(0, 256, (64, 64, 3), dtype=np.uint8)
    near, other = picture.copy(), np.full((64, 64, 3), (250, 10, 10), np.uint8)
    near[0, 0] = 0
    for name, data in (("a.png", png(picture)), ("b.png", png(near)), ("c.png", png(other)), ("d.png", b"\x89PNG broken"), ("a.wav", wav(tone(700))), ("b.wav", wav(tone(700))), ("c.wav", b"RIFF1234WAVE"), ("t.txt", b"one two three")):
        (root / name).write_bytes(data)
    base = {"input_root": str(root), "output_root": str(tmp_path / "out"), "text": {"method": "md5"}}
    kept = lambda df: sorted(os.path.basename(r["path"]) for r in df.where("kept").collect())
    out = pipeline.Pipeline(spark, pipeline.load_config(None, **base)).run()
    assert kept(out["image"]) == ["a.png", "c.png"] and [os.path.basename(r["path"]) for r in out["image"].where("missing").collect()] == ["d.png"]
    assert kept(out["audio"]) == ["a.wav", "c.wav"]  # equal hashes; what cannot be heard is kept
    made = pipeline.Pipeline(spark, pipeline.load_config(None, **base)).root
    told = json.loads(open(f"{made}/summary.json").read())
    assert {m["modality"] for m in told["modalities"]} == {"image", "audio", "text", None} and "| image | 4 |" in open(f"{made}/report.md").read()
    assert os.path.isdir(f"{made}/image-duplicates.json") and not os.path.isdir(f"{made}/text-duplicates.json")
    for method in ("jaccard", "lsh", "mfcc", "md5"):
        how = {"audio": {"method": method} | ({} if method == "md5" else {"threshold": 0.75}), "image": {"method": "pairwise", "eps": 0.05}}
        out = pipeline.Pipeline(spark, pipeline.load_config(None, **base, **how)).run()
        assert kept(out["audio"]) == ["a.wav", "c.wav"] and kept(out["image"]) == ["a.png", "c.png"], method
    # an earlier run's clusters and keep list
    (tmp_path / "cl").mkdir()
    (tmp_path / "cl" / "cluster_0.txt").write_text("".join(f"{i}\tfile:{root}/{n}\t0.1\n" for i, n in enumerate(("a.png", "b.png", "c.png"))))
    (tmp_path / "keep.txt").write_text("1\n")
    legacy = {"method": "legacy", "eps": 0.1, "cluster_dir": str(tmp_path / "cl"), "keep_indices_file": str(tmp_path / "keep.txt")}
    out = pipeline.Pipeline(spark, pipeline.load_config(None, **base, image=legacy)).run()
    assert kept(out["image"]) == ["b.png"] and {os.path.basename(r["original"]) for r in out["image"].where("original is not null").collect()} == {"b.png"}
    with pytest.raises(ValueError):
        pipeline.Pipeline(spark, pipeline.load_config(None, **base, image={"method": "legacy", "eps": 0.2, "cluster_dir": None})).run()
    later = pipeline.load_config(None, **base, sorter=False, copy=True)
    assert pipeline.Pipeline(spark, later).run()["manifest"].count() == 8


def test_locks_and_failures(spark, tree, tmp_path):
    config = pipeline.load_config(None, input_root=tree, output_root=str(tmp_path / "out"), text={"method": "none"}, image={"method": "file_hash"}, audio={"method": "md5"})
    run = pipeline.Pipeline(spark, config)
    with pytest.raises(ValueError):
        run.run()
    assert "unknown text method" in open(f"{run.root}/text._FAILURE").read() and not os.path.exists(f"{run.root}/_LOCK")
    open(f"{run.root}/_LOCK", "w").close()
    with pytest.raises(pipeline.Locked):
        run.run()
    with pytest.raises(FileNotFoundError):
        pipeline.latest_manifest(spark, str(tmp_path / "nowhere"))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
