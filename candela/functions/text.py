"""Text, number and date normalisation, as Column expressions."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Legal-form words dropped from the end of an organisation's name.
LEGAL_FORMS = ["ag", "sa", "sas", "sarl", "gmbh", "bv", "nv", "ltd", "limited", "plc", "llc", "inc", "corp", "corporation", "spa", "srl", "oy", "ab", "as", "a/s", "se"]


@F.pandas_udf(T.StringType())
def _fold(values: pd.Series) -> pd.Series:
    """NFKC and case folding, for the rows that have more than ASCII."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


def _words(folded: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def normalize_ascii(value: Column) -> Column:
    """F1 for text known to be ASCII: lower case, words apart by one space."""
    return _words(F.lower(F.coalesce(value, F.lit(""))))


def normalize_text(value: Column) -> Column:
    """NFKC, case folded, anything but word characters as one space. Only non-ASCII rows go through Python."""
    text = F.coalesce(value, F.lit(""))
    odd = text.rlike(r"[^\x00-\x7F]")
    return _words(F.when(odd, _fold(F.when(odd, text))).otherwise(F.lower(text)))


def drop_legal_forms(normalized: Column) -> Column:
    """F2 on F1's result: trailing legal-form words go, however many."""
    forms = "|".join(x for x in LEGAL_FORMS if "/" not in x)
    return F.trim(F.regexp_replace(normalized, rf"(?:(?:^|\s)(?:{forms}))+$", ""))


def normalize_identifier(value: Column) -> Column:
    """letters and digits only, upper case."""
    return F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Za-z0-9]", ""))


def trigrams(value: Column) -> Column:
    """F4's set: 3-grams of each word, with two spaces before and one after it."""
    words = F.filter(F.split(F.lower(value), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """shared over all 3-grams of two sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)])


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity; 0 where either is empty. Equal texts don't go through Python."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when((a == b) & (a != ""), F.lit(1.0)).otherwise(_ratio(a, b))


def normalize_query(value: Column) -> Column:
    """lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))


def celex_of(uri: Column) -> Column:
    """the act's number in a resource address; decoded, then cut at ? and #, then slashes trimmed."""
    tail = F.try_url_decode(F.regexp_replace(F.regexp_extract(uri, r"/resource/celex/(.*)$", 1), r"\+", "%2B"))
    cut = F.regexp_replace(F.regexp_extract(tail, r"^([^?#]*)", 1), r"^/+|/+$", "")
    return F.when(uri.contains("/resource/celex/"), F.nullif(cut, F.lit("")))


def loose_decimal(value: Column) -> Column:
    """spaces out, comma as point; null where that is no number."""
    return F.replace(F.replace(value, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(24,6)")


def loose_date(value: Column) -> Column:
    """an ISO date, or one in the first ten characters; else null."""
    return F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd"))


def currency_code(value: Column) -> Column:
    """the first three characters, upper case."""
    return F.substring(F.upper(value), 1, 3)


def instant(value: Column) -> Column:
    """a date as its midnight UTC, else an ISO instant; blank is null."""
    stamp = F.when(F.length(value) == 10, F.concat(value, F.lit("T00:00:00Z"))).otherwise(value)
    return F.nullif(stamp, F.lit("")).try_cast("timestamp")


def strict_number(value: Column) -> Column:
    """F16: a plain signed decimal, U+2212 as minus; anything else is null."""
    text = F.replace(F.trim(value), F.lit("−"), F.lit("-"))
    return F.when(text.rlike(r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)$"), text.try_cast("decimal(38,12)"))


def plain_number(value: Column) -> Column:
    """twelve half-even decimals, trailing zeros stripped."""
    text = F.bround(value, 12).cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def object_key(value: Column) -> Column:
    """safe characters only, at most 180."""
    return F.substring(F.regexp_replace(value, r"[^\p{L}\p{N}._-]", "_"), 1, 180)


def route_group(path: Column) -> Column:
    """the first segments of an internal, versioned or public API path, other paths whole."""
    return F.when(path.rlike("^/api/(?:internal|v1|public)/"), F.substring_index(path, "/", 4)).otherwise(path)


def html_title(html: Column) -> Column:
    """The first title's text, the five named entities resolved, white space collapsed; null if empty."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        title = F.replace(title, F.lit(name), F.lit(char))
    return F.nullif(F.trim(F.regexp_replace(title, r"\s+", " ")), F.lit(""))
