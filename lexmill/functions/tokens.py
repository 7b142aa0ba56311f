"""Words and character n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze


def words(c: Column) -> Column:
    """Whitespace words; none for an empty text."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def char_ngrams(c: Column, low: int = 2, high: int = 4) -> Column:
    """N-grams of each word between ``^`` and ``$``: by word, then n, then position; repeats stay."""

    def of_word(w: Column) -> Column:
        marked = F.concat(F.lit("^"), w, F.lit("$"))
        sizes = [_grams(marked, F.length(w) + 3 - n, n) for n in range(low, high + 1)]
        return F.concat(*sizes)

    return F.flatten(F.transform(words(c), of_word))


def _grams(marked: Column, count: Column, n: int) -> Column:
    at = F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
    return F.when(count >= 1, F.transform(at, lambda i: F.substring(marked, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def ngram_length(c: Column, low: int = 2, high: int = 4) -> Column:
    """How many n-grams ``char_ngrams`` gives, without making them."""
    size = lambda w: sum((F.greatest(F.length(w) + 3 - n, F.lit(0)) for n in range(low, high + 1)), F.lit(0))
    return F.aggregate(words(c), F.lit(0), lambda a, w: a + size(w)).cast("long")
