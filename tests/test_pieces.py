"""Parts of a text that begin or end with the digit of their own place: trimming takes blanks, nothing else."""

from pyspark.sql import functions as F

from scholiast.functions import text as T
from scholiast.operators import align


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("v")).first()["v"]


def test_selected_quote_keeps_digits_of_its_place(spark):
    assert one(spark, T.selected_quote, "0997 is the first of all. 194.209.21.243 is the next") == "0997 is the first of all. 194.209.21.243 is the next"
    assert one(spark, T.selected_quote, "0 one two three four five six seven eight. More. And more.") == "0 one two three four five six seven eight."
    assert one(spark, T.sentences, " 0. 1 2 ") == ["0.", "1 2"]


def test_sentence_candidates_keep_digits_of_their_place(spark):
    said = ["0 is what the first one begins with.", "194.209 begins the next of all parts 1", "The last of these has 2 2"]
    assert one(spark, T.sentence_candidates, f"{said[0]} {said[1]}. {said[2]}") == [said[0], f"{said[1]}.", said[2]]


def test_quotes_keep_digits_of_their_place(spark):
    q = align.quotes_of(spark.createDataFrame([(1, "0 a b. 1 c d 1")], "item_id long, text string"))
    assert sorted((r["sentence"], r["q"]) for r in q.collect()) == [(0, ["0", "a", "b"]), (1, ["1", "c", "d", "1"])]
