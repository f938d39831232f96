import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import sampling, sentences


@pytest.fixture(scope="module")
def splitter():
    rows = duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE length(text) > 0 ORDER BY doc_id LIMIT 5000").fetchall()
    return sentences.Splitter(sentences.train([r[0] for r in rows]))


CASES = [
    ["Dr. Vorn of Kesmere measured 60.4 litres.", "It was old... or so St. Wim believed.", "Yes."],
    ["The sign read “Stop! Wet paint!” in red letters.", "Nobody came."],
    ["“Did the turnip fall?” asked the clerk.", "“It did,” he said."],
    ["(See Fig. 2 and pp. 17-60 for the nomadic urchin.)", "Outside, it rained."],
    ["[Idle cushion, vol. 26, no. 10.]", "The end…", "A new start."],
    ["Pryne & Co Ltd. bought No. 77, Mt. Ophvik Rd., for £540.03.", "In May it closed at 6 p.m.", "The gate opens at 7 a.m. and closes at 9 p.m. on Tuesdays."],
    ["In the K.Z.H. district, no fungus softens.", "E. O. Nosrova wrote that."],
    ["— Кто там? — спросила хозяйка.", "В 1786 г. там жило 3,5 тыс. чел., т. е. почти весь край.", "Какая тишина!..", "См. рис. 7."],
    ["« Qui a fermé la barrière ? » demanda Mme Courz.", "Quelle journée !"],
    ["—¿Quién llamó? —preguntó el niño.", "¿Dónde está Bóvrós?"],
    ["Am 5. Mai 1740 kam der Zug aus Taueck z. B. erst gegen Mittag.", "„Wer hat den Schlüssel?“, fragte der Müller."],
    ["eThyroid is a tool.", "eBlade is another."],
]


@pytest.mark.parametrize("wanted", CASES, ids=[c[0][:20] for c in CASES])
def test_cases(splitter, wanted):
    text = " ".join(wanted)
    assert [text[a:b] for a, b in splitter.split(text)] == wanted


def test_scripts_without_blanks(splitter):
    wanted = ["芬海湾的火车到了。", "“谁关了门？”女主人问。", "他想了很久……最后还是回了维尔镇。", "The end came."]
    text = "".join(wanted)
    assert [text[a:b] for a, b in splitter.split(text)] == wanted
    text = "「もう遅い。」とハル城の老人は言った。なんと静かな夜だろう！"
    assert [text[a:b] for a, b in splitter.split(text)] == ["「もう遅い。」とハル城の老人は言った。", "なんと静かな夜だろう！"]
    text = "คนเฝ้าป่าเปิดเสื้อ ดร.ทาร์นิกวัดได้5.5กิโลเมตร"
    assert [text[a:b] for a, b in splitter.split(text)] == text.split(" ")


def test_structure(splitter):
    text = "A heading\n\nA line that goes\non here. Next one.\r\n \r\n• Press it. Twice.\n• Fold it\n\n1. One\n2. Two\n3. Three\n  \n"
    assert [text[a:b] for a, b in splitter.split(text)] == ["A heading", "A line that goes\non here.", "Next one.", "• Press it. Twice.", "• Fold it", "1. One", "2. Two", "3. Three"]


def test_rows(spark, splitter):
    rows = [(1, None), (2, ""), (3, " \n\n\t"), (4, "One. Two."), (5, "🍋 box. Yes it."), (6, "Word " * 30_000 + "end. " + "Again. " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start_pos", F.lit("x")).withColumn("lang", F.lit(None).cast("string"))
    got = [tuple(r) for r in sentences.sentences(df, splitter.model).orderBy("doc_id", "start_pos").collect()]
    assert [r for r in got if r[0] < 6] == [(4, 0, 4), (4, 5, 9), (5, 0, 6), (5, 7, 14)]
    assert sum(r[0] == 6 for r in got) == 2001
    assert sentences.sentences(df.limit(0), splitter.model).count() == 0


def test_marks_close_however_far_away(splitter):
    """A sentence wholly in brackets or quotes is one, and brackets within a sentence do not divide it, at any length."""
    for n in (20, 5_000, 200_000):
        inner = ("One word more. " * (n // 15)).strip()
        for left, right in ("()", "“”", "«»"):
            text = f"He read {left}{inner}{right} to us. Then he left."
            assert [text[a:b] for a, b in splitter.split(text)] == [text[:-14], "Then he left."]


def test_marks_that_never_close_take_linear_time(splitter):
    began = time.perf_counter()
    for text in ("( “ « " * 60_000 + "End. Next.", "(a “b” " * 50_000 + "End. Next.", "- item\n" * 50_000, "1. a\n\n" * 30_000, "(" * 100_000 + ")" * 100_000):
        assert splitter.split(text)
    assert time.perf_counter() - began < 20


def test_no_training_texts():
    plain = sentences.Splitter(sentences.train([]))
    text = "Dr. Vorn came. He left! Why? See No. 7."
    assert [text[a:b] for a, b in plain.split(text)] == ["Dr. Vorn came.", "He left!", "Why?", "See No. 7."]


def test_fitting_is_bounded(spark):
    df = spark.createDataFrame([(i, f"Text {i}. More.") for i in range(20)], "doc_id long, text string")
    assert sentences.fit(df, sample=5).weights
    long = df.unionByName(spark.createDataFrame([(99, "y" * 400)], "doc_id long, text string"))
    found = sampling.texts(long, "text", "doc_id", 100, characters=200)
    assert 0 < len(found) <= 15 and sum(map(len, found)) <= 200
    assert sampling.texts(df.limit(0), "text", "doc_id", 5) == []
