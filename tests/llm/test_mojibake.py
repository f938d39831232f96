import random
import tracemalloc

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import mojibake


@pytest.fixture(scope="module")
def texts(sf):
    rows = duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE length(text) > 40 ORDER BY doc_id").fetchall()
    return [r[0] for r in rows]


@pytest.fixture(scope="module")
def model(texts):
    return mojibake.fit(texts[::2])


def test_tables_round_trip():
    for pair in mojibake.PAIRS:
        if pair[0] != "utf-8" or pair[1] in mojibake._WIDE:
            continue
        for text in ("naïve “café” – Привет", "漢字と仮名", "ไทย"):
            assert mojibake.restore(mojibake.garble(text, pair), pair) == text, pair


def test_held_out_accuracy(texts, model):
    """Held-out texts, half of them damaged: few false alarms, nearly all damage found and most of it undone."""
    rng = random.Random(9)
    held = [t[:400] for t in texts[1::2]]
    labeller = mojibake.Labeller(model)
    assert sum(map(bool, labeller.damage(held))) <= 0.01 * len(held)
    cases = [("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1251", 1), ("utf-8", "cp1252", 2), ("utf-8", "cp850", 1), ("cp1251", "koi8-r", 1), ("cp1251", "cp1252", 1), ("gbk", "cp1252", 1)]
    damaged = []
    for text in held:
        pair = rng.choice(cases)
        if pair[0] != "utf-8" and text.encode(pair[0], "ignore").decode(pair[0]) != text:
            pair = cases[rng.randrange(5)]
        bad = mojibake.garble(text, pair)
        odd = sum(c > "\x7f" for c in text)
        if bad != text and odd >= 3:
            damaged.append((text, bad))
    spans = labeller.damage([b for _, b in damaged])
    assert sum(map(bool, spans)) >= 0.97 * len(damaged)
    assert sum(mojibake.repaired(b, s)[0] == t for (t, b), s in zip(damaged, spans)) >= 0.85 * len(damaged)


def test_stretches_and_lost_characters(texts, model):
    bad = mojibake.garble("– „Müller“ –", ("utf-8", "cp1252", 1))
    text = "The plain start. " + bad + " and the plain end."
    labeller = mojibake.Labeller(model)
    (spans,) = labeller.damage([text])
    assert mojibake.repaired(text, spans) == ("The plain start. – „Müller“ – and the plain end.", True)
    (lost,) = labeller.damage(["a caf� here"])
    assert [s[:3] for s in lost] == [(5, 6, -1)] and mojibake.repaired("a caf� here", lost) == ("a caf� here", False)


def test_cleaned_blanks(model):
    labeller = mojibake.Labeller(model)
    for text, want in (("Une chÃ¨vre Ã  cÃ´tÃ© du pont.", "Une chèvre à côté du pont."), ("SÃO JOÃO-LE, in print", None)):
        (spans,) = labeller.damage([text])
        assert (mojibake.repaired(text, spans)[0] if spans else None) == want


def test_rows(spark, model):
    rows = [("a", None), ("b", ""), ("c", "plain"), ("d", "naïve café, as it was"), ("e", "the cafÃ© was naÃ¯ve â€“ yes"), ("e", "the cafÃ© was naÃ¯ve â€“ yes"), (None, "cafÃ© â€“"), ("f", "x" * 50_000 + " cafÃ© â€“ " + "é" * 3)]
    df = spark.createDataFrame(rows, "doc_no string, text string").withColumn("key", F.lit(1)).withColumn("damage", F.lit(2))
    got = mojibake.damaged(df, "doc_no", "text", model).collect()
    assert sorted(str(r["key"]) for r in got) == ["None", "e", "e", "f"]
    assert {r["restored"] for r in got if r["key"] == "e"} == {"the café was naïve – yes"}
    assert mojibake.damaged(df.limit(0), "doc_no", "text", model).count() == 0


def test_no_training_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = mojibake.train((empty, "text", "doc_id"), [(empty, "text", "doc_id")])
    assert mojibake.Labeller(model).damage(["plain", "", "a caf� b"])[2]


def test_windows_give_the_same_path(texts, model, monkeypatch):
    """Long texts in windows of any size are labelled as in one piece, across window borders, too."""
    rng = random.Random(4)
    long = []
    for _ in range(6):
        parts = [mojibake.garble(t, rng.choice([("utf-8", "cp1252", 1), ("utf-8", "cp1251", 1), ("cp1251", "koi8-r", 1)])) if rng.random() < 0.4 else t for t in rng.sample(texts, 12)]
        long.append(" ".join(parts)[:9000])
    labeller = mojibake.Labeller(model)
    whole, likely = labeller.label(long), [labeller.likelihood(t) for t in long]
    rivals = [labeller._rivals(t, 0) for t in long]
    for window in (7, 1000, 8999):
        monkeypatch.setattr(mojibake, "WINDOW", window)
        assert labeller.label(long) == whole and sum(map(len, whole)) > 10
        assert [labeller._rivals(t, 0) for t in long] == rivals
        assert all(abs(a[0] - b[0]) < 1e-3 * max(1, abs(b[0])) and a[1] == b[1] for a, b in zip((labeller.likelihood(t) for t in long), likely))


def test_memory_of_a_very_long_text(texts, model):
    """The working memory does not grow with states times length: far under a byte a state and character."""
    text = mojibake.garble("".join(t for t in texts if not t.isascii())[:150_000], ("utf-8", "cp1252", 1)) * 2
    labeller = mojibake.Labeller(model)
    tracemalloc.start()
    found = labeller.damage([text])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and len(text) > 300_000 and peak < 45_000_000


def test_tables_come_from_every_text(spark):
    """Not from a sample: words of either half of a corpus are known at the mass of a single text, and so at any partitioning."""
    rows = spark.createDataFrame([(i, "le thé froid" if i % 2 else "зелёный жук") for i in range(40)], "doc_id long, text string")
    other = spark.createDataFrame([(i, "un café chaud") for i in range(40)], "doc_no long, text string")
    one, five = (mojibake.train((rows.repartition(n), "text", "doc_id"), [(other, "text", "doc_no")], 1) for n in (1, 5))
    assert {"thé", "зелёный", "жук", "café"} <= one.words == five.words
    assert (one.keys == five.keys).all() and abs(one.gains - five.gains).max() < 1e-4
