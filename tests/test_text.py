"""Functions of texts on odd values."""

import pytest

from docfoundry.functions import text


def chosen(spark, rows, *word):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string")
    return [r["c"] for r in df.select("i", text.extract_choice(df["t"], ["Yes", "no"], *word).alias("c")).orderBy("i").collect()]


@pytest.mark.parametrize("word, beside_letters", [((), None), ((text.ASCII_WORD,), "no")])
def test_words_end_where_their_characters_do(spark, word, beside_letters):
    assert chosen(spark, ["aros.\nNoñascii", "éno x", "a no b", "yes, no, yes.", "nobody", "no_1", "x", None, "  NO "], *word) == [beside_letters, beside_letters, "no", "Yes", None, None, None, None, "no"]
