"""Text cleaning as column expressions, in the order ``clean_text`` fixes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: One non-space character, where space also counts U+001C-001F and all Unicode spaces.
_NS = r"(?U:[^\s\x1c-\x1f])"
_SPACES = r"(?U)[\s\x1c-\x1f]+"
URL = rf"https?://{_NS}+|www\.{_NS}+"
# a match runs to the end of its word, so the next one can only begin at the start of a word
EMAIL = rf"(?<!{_NS}){_NS}+@{_NS}+\.{_NS}+"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
NUKTA = "\u093c"

#: Whole Latin words and their Devanagari spelling.
LATIN_TO_DEVANAGARI = {
    "a": "अ", "aa": "आ", "i": "इ", "ee": "ई", "u": "उ", "oo": "ऊ", "e": "ए", "ai": "ऐ", "o": "ओ", "au": "औ",
    "ka": "क", "kha": "ख", "ga": "ग", "gha": "घ", "cha": "च", "chha": "छ", "ja": "ज", "jha": "झ",
    "ta": "ट", "da": "ड", "dha": "ढ", "na": "न", "pa": "प", "pha": "फ", "ba": "ब", "bha": "भ", "ma": "म",
    "ya": "य", "ra": "र", "la": "ल", "va": "व", "wa": "व", "sha": "श", "sa": "स", "ha": "ह",
    "kya": "क्या", "gya": "ज्ञ", "ri": "रि", "re": "रे", "ro": "रो", "ru": "रु",
    "se": "से", "ke": "के", "me": "में", "ko": "को", "ki": "कि", "hi": "हि", "ho": "हो", "he": "हे",
    "nahi": "नहीं", "hai": "है", "hain": "हैं", "tha": "था", "aur": "और", "par": "पर", "bhi": "भी", "koi": "कोई",
}


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def nfc(c: Column) -> Column:
    """Spark has no NFC: only texts beyond ASCII go to the Arrow worker."""
    return F.coalesce(_nfc(F.when(~F.rlike(c, F.lit(r"^\p{ASCII}*$")), c)), c)


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, "")


def strip_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL, "")


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def strip_zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


def strip_nukta(c: Column) -> Column:
    return F.translate(c, NUKTA, "")


def chandrabindu(c: Column) -> Column:
    """Before a consonant it becomes an anusvara."""
    return F.regexp_replace(c, "\u0901([\u0915-\u0939])", "\u0902$1")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def transliterate(c: Column) -> Column:
    """Whole Latin words of the map are respelled; words are joined by one space."""
    spelled = F.create_map(*(F.lit(x) for pair in LATIN_TO_DEVANAGARI.items() for x in pair))
    word = lambda w: F.coalesce(F.when(F.rlike(w, F.lit("^[A-Za-z]+$")), F.try_element_at(spelled, F.lower(w))), w)
    return F.array_join(F.transform(F.split(squeeze(c), " "), word), " ")


def clean_text(
    c: Column,
    normalize_unicode: bool = True,
    remove_urls: bool = True,
    remove_emails: bool = True,
    lowercase: bool = False,
    transliteration: bool = False,
) -> Column:
    steps = [
        (normalize_unicode, nfc), (remove_urls, strip_urls), (remove_emails, strip_emails), (True, strip_control),
        (True, strip_zero_width), (True, strip_nukta), (True, chandrabindu), (transliteration, transliterate),
        (lowercase, F.lower), (True, squeeze),
    ]
    for wanted, step in steps:
        if wanted:
            c = step(c)
    return c


def preview(c: Column, chars: int = 200) -> Column:
    return F.substring(c, 1, chars)


def numbered(stem: Column, sign: str, number: Column) -> Column:
    """``stem_c0007``: at least four digits, never cut."""
    return F.format_string(f"%s_{sign}%04d", stem, number)
