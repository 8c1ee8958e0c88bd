"""Words of texts are split in one pass and lowered one by one, with the words of the plain rules."""

import random

from pyspark.sql import functions as F

from kerbgrid.llm import decontaminate as d

SEPARATORS = r"(?:[^\p{L}\p{M}\p{N}" + d.START + r".,]|(?<![0-9])[.,]|[.,](?![0-9]))+"
PARTS = ["A", "b", "Σ", "σ", "Α", ".", ",", "!", "\n", " ", "1", "9", "\x04", "İ", "ß", "\U00010400", "́", "km", "five", "Five", "dollars", "'", "٠", " ", "\x01"]


def test_words_equal_the_plain_rules_and_windows_carry_no_lowered_copy(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choices(PARTS, k=draw.randrange(30))) for _ in range(2000)] + [None, "", "ΟΔΟΣ. ΟΔΟΣ", "1,200.5 and 3. .5 5."]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    marked = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"(^|[.!?\n])(\s*)(?=\p{Lu})", f"$1$2{d.START}")
    plain = rows.select("id", *[F.array_remove(F.split(x, SEPARATORS), "").alias(name) for name, x in (("words", marked), ("low", F.lower(marked)))])
    got = d.worded(rows, "id")
    assert sorted(map(tuple, got.select("id", "words", "low").collect())) == sorted(map(tuple, plain.collect()))
    assert d.windows(got, "id").columns == ["id", "words", "tokens", "at", "form", "hash"]
