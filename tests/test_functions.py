import json

import pytest
from pyspark.sql import functions as F

from siftspark.functions import classify, sketch, text, vectors


def column(spark, values, kind, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_normalisations_differ(spark):
    given = ["A - b", "", None, "  Ünï\t中文!! x ", "!!!"]
    assert column(spark, given, "string", text.normalize) == ["a b", "", None, "ünï 中文 x", ""]
    assert column(spark, given, "string", text.normalize_strip) == ["a  b", "", None, "ünï 中文 x", ""]
    twice = column(spark, ["A - b"], "string", lambda c: text.normalize_strip(text.normalize_strip(c)))
    assert twice == ["a b"]


def test_ngrams_of_short_texts(spark):
    assert column(spark, ["ab", "", None, "abc"], "string", lambda c: text.ngrams(c, 3)) == [["ab"], [], [], ["abc"]]
    assert column(spark, ["ab", "abcd"], "string", lambda c: text.ngrams(c, 3, False)) == [[], ["abc", "bcd"]]
    assert "a b c" in column(spark, ["a b c"], "string", lambda c: text.ngrams(c, 3))[0]
    assert column(spark, ["a b", "abab"], "string", lambda c: text.char_grams(c, 3)) == [["ab"], ["aba", "bab"]]
    assert column(spark, ["x y z"], "string", lambda c: text.char_grams(c, 2, words=2, most=1)) == [["x", "y", "xy"]]


def test_jaccard_of_empty_sets(spark):
    rows = spark.createDataFrame([([], []), (["a"], ["a", "b"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.5]
    assert [r[0] for r in rows.select(text.jaccard(F.col("a"), F.col("b"), 0.0)).collect()] == [0.0, 0.5]


def test_parsers(spark):
    assert column(spark, ["7", " 7.0 ", "b'7'", "x", "7.5"], "string", text.parse_index) == [7, 7, 7, None, None]
    assert column(spark, ["audio_012.wav", "none"], "string", text.first_number) == ["012", None]
    assert column(spark, ["A\\B"], "string", text.path_variants) == [["A\\B", "A/B", "a\\b", "a/b"]]
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(text.safe_div(F.col("a"), F.col("b"))).collect()] == [0.5, None, None]


def test_band_parameters():
    assert [sketch.divisor_bands(t) for t in (0.1, 0.4, 0.5, 0.7, 0.8, 0.9)] == [(100, 2), (50, 4), (40, 5), (25, 8), (20, 10), (10, 20)]
    assert sketch.area_bands(0.8, 128) == (9, 13)


def test_minhash_agrees_in_sql_and_python(spark):
    rows = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "t array<string>")
    got = [r[0] for r in rows.select(sketch.minhash(F.col("t"), 8)).collect()]
    want = [min((a * sketch._hash(t) + b) % sketch.PRIME for t in ("a", "b")) for a, b in sketch.coefficients(8)]
    assert got == [want, [sketch.PRIME] * 8, [sketch.PRIME] * 8]


def test_simhash_of_near_texts(spark):
    one = "the quick brown fox jumps over the lazy dog and runs far away from the old brown house " * 3
    a, b, c = column(spark, [one, one + "x", "something else entirely, of quite other letters"], "string", sketch.simhash)
    bits = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    assert bits(a, b) < 10 < bits(a, c)


def test_vectors(spark):
    assert column(spark, [[1.0, -1.0, 0.0, 2.0]], "array<double>", vectors.set_bits) == [[0, 3]]
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    assert rows.select(vectors.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.96)
    assert rows.select(vectors.norm(vectors.normalized(F.col("a")))).first()[0] == pytest.approx(1)
    sizes = spark.createDataFrame([("g", 1), ("g", 3), ("h", 5)], "g string, s int")
    assert sorted(r[0] for r in sizes.select(vectors.min_max(F.col("s"), F.col("g"))).collect()) == [0.0, 0.0, 1.0]


@pytest.mark.parametrize(
    "value, label",
    [
        ({"image": "x", "text": "y"}, "image"), ({"wav": 1}, "audio"), ({"url": "A.PNG"}, "image"), ({"url": "a.html"}, "text"), ({}, "text"),
        ([{"text": "a"}, {"image": "b"}], "text"), ([{"image": "b"}, {"text": "a"}], "image"), (["a", " "], "text"), ([], "text"), (5, "text"),
        ([{"url": "x.gif"}, {"url": "y.gif"}, "words"], "image"),
    ],
)
def test_json_labels(value, label):
    assert classify.json_label_of(json.loads(json.dumps(value))) == label


def test_categories(spark):
    png, wav, words = b"\x89PNG\r\n\x1a\n" + b"\0" * 9, b"RIFF\1\2\3\4WAVEfmt ", b"just some words here"
    binary = bytes(range(0, 9)) * 20
    rows = [
        ("a.png", b""), ("a.wav", words), ("a.txt", png), ("a.txt", words), ("a.txt", b""), ("a.gif", b'{"text": 1}'), ("a.gif", binary), ("a.mp3", binary),
        ("a.mp3", words), ("a.json", b'{"image": "x"}'), ("a.json", b"{broken"), ("a.json", binary), ("a.bin", binary), ("a", wav), ("dir.x/a", words), ("a.flac", b"fLaC" + binary),
        ("a.svg", b" <SVG>"), (".txt", words),
    ]
    data = spark.createDataFrame([(i, p, c, len(c)) for i, (p, c) in enumerate(rows)] + [(99, "a.md", None, None)], "i int, p string, c binary, n long")
    found = data.withColumn("k", classify.category(F.col("p"), F.col("n"), F.col("c"))).withColumn("s", classify.strict_category(F.col("p"), F.col("k"))).orderBy("i").collect()
    assert [r["k"] for r in found] == [
        "image", "audio", "image", "text", "unknown", "text", "image", "audio", "text", "image", "text", "unknown", "unknown", "audio", "text", "audio", "image", "text", "error",
    ]
    assert [r["s"] for r in found][:3] == ["image", "audio", "unknown"] and found[9]["s"] == "unknown"
    strict = data.select("i", classify.category(F.col("p"), F.col("n"), F.col("c"), True).alias("k")).orderBy("i").collect()
    assert strict[0]["k"] == "unknown" and strict[1]["k"] == "text"


def test_printable_share(spark):
    given = [b"abc", b"", None, b"\x00" * 2 + b"a" * 8, b"\x00" + b"a" * 9, b"\xad" * 9 + b"a"]
    assert column(spark, given, "binary", classify.mostly_printable) == [True, False, False, False, True, False]


def test_json_of_columns(spark):
    given = ['{"audio": 1}', '{"url": "http://x/a.webp"}', "no json", "[1]", None]
    assert column(spark, given, "string", classify.json_object_label) == ["audio", "image", None, None, None]


def test_sql_functions(spark):
    from siftspark.functions import sketch, sql

    names = sql.register(spark, "sift_")
    assert {"sift_text_normalize", "sift_jaccard", "sift_cosine", "sift_hamming", "sift_classify_json", "sift_ngrams", "sift_minhash", "sift_simhash"} == set(names)
    one = lambda q: spark.sql(f"SELECT {q} AS v").first()["v"]
    assert one("sift_text_normalize('  A -  b!\\n')") == "a b" and one("sift_jaccard(array('a', 'b'), array('b', 'c'))") == 1 / 3 and one("sift_jaccard(array(), array())") == 1.0
    assert abs(one("sift_cosine(array(1D, 0D), array(1D, 1D))") - 0.5**0.5) < 1e-12 and one("sift_hamming(5L, 6L)") == 2
    assert one("sift_classify_json('{\"audio\": 1, \"text\": 2}')") == "audio" and one("sift_classify_json('{\"url\": \"x.PNG\"}')") == "image" and one("sift_classify_json('[1]')") is None
    assert one("sift_ngrams('abcd', 3)") == ["abc", "bcd"] and len(one("sift_minhash(array('a'), 7)")) == 7 and one("sift_simhash('some text')") == sketch.simhash_of("some text")
