"""The bitmap that texts' grams pass before they are shuffled drops only grams that file no id."""

from pyspark.sql import functions as F

from casewright.operators import known_ids as K


def test_only_grams_that_file_nothing_are_dropped(spark):
    ids = spark.range(300).select(F.concat(F.lit("name-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), F.col("id").cast("string").alias("uid"), F.col("id").alias("place"))
    index = K.gram_index(ids)
    texts = spark.range(900).select(F.col("id").alias("row_key"), F.concat(F.lit("a report of name-"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" and its sequel")).alias("text"))
    filed = texts.select("row_key", F.explode(K.grams(F.col("text"), 6)).alias("gram"))
    left = K._filed_somewhere(filed, K.gram_bits(index))
    need = filed.join(index.select("gram").distinct(), "gram", "left_semi").select("row_key", "gram")
    assert need.exceptAll(left).count() == 0 and left.count() < filed.count() / 5
    assert K.met_ids(texts, index, [6]).count() == 300
