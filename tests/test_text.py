import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions.tokens import char_ngrams, ngram_length, words


def of(spark, expression, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


CASES = [
    ("see https://x.org/a next", "see next"),
    ("mail a@b.co next", "mail next"),
    ("www.x.org gone", "gone"),
    ("क़ क़", "क क"),
    ("ऩ", "ऩ"),
    ("चाँद हँ", "चांद हँ"),
    ("a​b‌‍﻿c", "abc"),
    ("a\x85b", "ab"),
    ("  a \t\n b\x1cc ", "a bc"),
    ("é", "é"),
    ("", ""),
    (None, None),
]


def test_cleaning_cases(spark):
    assert of(spark, T.clean_text, *(c for c, _ in CASES)) == [e for _, e in CASES]


def test_nukta_stays_without_nfc(spark):
    assert of(spark, lambda c: T.clean_text(c, normalize_unicode=False), "क़") == ["क़"]


def test_clean_text_follows_python(spark):
    """The steps by Python's re on odd strings."""
    import random

    r = random.Random(0)
    alphabet = list("ab.@/:w \t\n  \x1c\x85​़ँकक़") + ["http://", "https://", "www.", "x@y.z"]
    strings = ["".join(r.choice(alphabet) for _ in range(r.randrange(25))) for _ in range(800)]

    def clean(s):
        s = unicodedata.normalize("NFC", s)
        s = re.sub(r"https?://\S+|www\.\S+", "", s)
        s = re.sub(r"\S+@\S+\.\S+", "", s)
        s = "".join(c for c in s if not (ord(c) < 32 and c not in "\t\n\r" or 127 <= ord(c) < 160))
        s = "".join(c for c in s if c not in "​‌‍﻿़")
        s = re.sub("ँ(?=[क-ह])", "ं", s)
        return " ".join(s.split())

    assert of(spark, T.clean_text, *strings) == [clean(s) for s in strings]


def test_transliteration(spark):
    assert of(spark, T.transliterate, "Hai nahi  xyz hai. KA") == ["है नहीं xyz hai. क"]
    assert of(spark, lambda c: T.clean_text(c, transliteration=True, lowercase=True), "Hai FOO") == ["है foo"]


def test_numbers_have_at_least_four_digits(spark):
    rows = spark.createDataFrame([(7,), (12345,)], "n int").select(T.numbered(F.lit("d"), "c", F.col("n")).alias("x")).collect()
    assert [r.x for r in rows] == ["d_c0007", "d_c12345"]


def test_ngrams_in_order(spark):
    assert of(spark, lambda c: F.array_join(char_ngrams(c, 2, 3), " "), "ab cd", "", "a") == ["^a ab b$ ^ab ab$ ^c cd d$ ^cd cd$", "", "^a a$ ^a$"]


@pytest.mark.parametrize("low,high", [(2, 4), (3, 5), (5, 6)])
def test_ngram_length(spark, low, high):
    values = ["river delta farm", "a bc", "", "x", None, "abcdefghij k"]
    assert of(spark, lambda c: ngram_length(F.coalesce(c, F.lit("")), low, high), *values) == of(spark, lambda c: F.size(char_ngrams(F.coalesce(c, F.lit("")), low, high)).cast("long"), *values)


def test_words(spark):
    assert of(spark, words, " a b\x1cc ", "") == [["a", "b", "c"], []]
