import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.stemmer import stem
from tessera.functions.stopwords import ENGLISH, merge_stop_words, read_stop_words

CLEAN = [
    ("Two   blanks, a tab\tand  an end!", "two blanks a tab and an end"),
    ("the old millâThe Lower Ferry:", "the old mill the lower ferry"),
    ("signs such as @, #, $, %, and ^ vanish.", "signs such as and vanish"),
    ("Drop <b> marks, #tags, @names, and http://example.", "drop marks names and"),
    ("Perché è così", "perch cos"),
    ("a <b\nc> d_e", "a d e"),
    ("!!! ...", ""),
    ("", ""),
    (None, None),
    ("comunità", "comunit"),
]


def test_clean(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEAN)], "i int, t string")
    got = {r["i"]: r["c"] for r in rows.select("i", text.clean(F.col("t")).alias("c")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CLEAN)}


def test_tokens_stop_words_and_stems(spark):
    rows = spark.createDataFrame([(0, "The ferries are at the harbour"), (1, "It was a very rainy evening"), (2, "Kindness is rewarded"), (3, None), (4, "  ")], "i int, t string")
    got = {r["i"]: r["x"] for r in rows.select("i", text.tokens(F.col("t"), sorted(ENGLISH), True).alias("x")).collect()}
    assert got == {0: ["ferri", "harbour"], 1: ["raini", "even"], 2: ["kind", "reward"], 3: [], 4: []}


def test_tokens_are_the_words_of_the_cleaned_text(spark):
    """With any white space, at the ends too, and without a second pass that collapses it."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*(t for t, _ in CLEAN), "\t a\x0bb\x0c c\r\nd  e \n", "\u00a0x\u2003y", " . "])], "i int, t string")
    both = rows.select(text.tokens(F.col("t")).alias("x"), text.clean(F.col("t")).alias("c"))
    assert all(r["x"] == (r["c"] or "").split() for r in both.collect())
    assert both.select("x")._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2


@pytest.mark.parametrize(("word", "want"), [w.split(":") for w in "swimming:swim floats:float rained:rain fence:fenc simple:simpl decoration:decor opposite:opposit ropes:rope county:counti daily:daili harbours:harbour sky:sky skies:sky dying:die generously:generous hopping:hop hoping:hope relational:relat national:nation agreed:agre feed:feed communism:communism proceed:proceed".split()])
def test_stem(word, want):
    assert stem(word) == want


def test_stop_word_lists(tmp_path):
    (tmp_path / "a").write_text("the\nneedn't\n\nOf\n")
    (tmp_path / "b").write_text("a\nthe\n")
    assert read_stop_words(tmp_path / "a", tmp_path / "b") == ["a", "of", "the"]
    assert merge_stop_words(["x", "X "], []) == ["x"]


def test_parse_posting(spark):
    rows = spark.createDataFrame([("3:7",), ("x",), ("",)], "t string")
    assert [tuple(r[0]) for r in rows.select(text.parse_posting(F.col("t"))).collect()] == [(3, 7), (None, None), (None, None)]
