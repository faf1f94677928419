import pytest

from plumbline.operators import text


TEXTS = ["", "   ", "one two", "a b c", "\U0001f600 smile", None, "good good bad,", "Great WORST bad"]


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(t,) for t in TEXTS], "t string")


def test_words_and_characters(df):
    found = text.text_stats(df, ["t"]).first()
    known = [t for t in TEXTS if t is not None]
    words = [len(t.split()) for t in known]
    assert (found["max_words"], found["min_words"]) == (max(words), 0)
    assert found["avg_words"] == pytest.approx(sum(words) / len(words))
    assert found["avg_chars"] == pytest.approx(sum(map(len, known)) / len(known))


def test_every_white_space_character_separates(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    df = spark.createDataFrame([("x".join(spaces),), ("a​b",)], "t string")
    expected = ["x".join(spaces).split(), "a​b".split()]
    found = text.text_stats(df, ["t"]).first()
    assert (found["max_words"], found["min_words"]) == (len(expected[0]), len(expected[1]))


def test_vocabulary(df):
    found = text.vocabulary_stats(df, ["t"]).first()
    tokens = " ".join(t for t in TEXTS if t is not None).lower().split()
    assert (found["unique_words"], found["total_words"]) == (len(set(tokens)), len(tokens))
    assert found["empty_ratio"] == pytest.approx(2 / 7)


def test_no_words_at_all(spark):
    df = spark.createDataFrame([("",), (" ",)], "t string")
    found = text.vocabulary_stats(df, ["t"]).first()
    assert (found["unique_words"], found["vocabulary_density"], found["empty_ratio"]) == (0, None, 1.0)


def test_common_words_in_order(df):
    found = text.common_words(df, ["t"], 3).orderBy("rank").collect()
    assert [(r["word"], r["n"]) for r in found] == [("good", 2), ("a", 1), ("b", 1)]


def test_sentiment_counts_presence(df):
    found = text.lexicon_sentiment(df, ["t"]).first()
    # "good good bad," holds one positive word, as "bad," is another token; "Great WORST bad" is 1 to 2.
    assert found["positive_words"] == pytest.approx(2 / 7)
    assert found["negative_words"] == pytest.approx(2 / 7)
    assert found["positive"] == pytest.approx(1 / 7) and found["negative"] == pytest.approx(1 / 7)
    assert found["neutral"] == pytest.approx(5 / 7)


def test_only_long_texts_are_text(spark):
    df = spark.createDataFrame([("x" * 50, "y" * 51)], "short string, long string")
    assert text.text_columns(df, 3) == ["long"]


def test_length_histograms(spark):
    df = spark.createDataFrame([("a b",), ("a b c",), (None,)], "t string")
    rows = text.text_histograms(df, "t", 4).collect()
    assert len(rows) == 8 and sum(r["n"] for r in rows) == 4
    single = text.text_histograms(spark.createDataFrame([("ab",)], "t string"), "t", 4).collect()
    assert sum(r["n"] for r in single) == 2


def test_every_text_column_is_analysed(spark):
    long = "some words that make a long enough text to count as one, and then a few more of them"
    df = spark.createDataFrame([(long,) * 5], ", ".join(f"t{i} string" for i in range(5)))
    assert text.text_stats(df).count() == text.lexicon_sentiment(df).count() == text.vocabulary_stats(df).count() == 5


def test_no_text_column(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert text.text_histograms(df).collect() == []
