"""Typed values out of label texts, as native column expressions.

All of them expect text that `squash` has normalised; `nfc` does the one step that Spark has no function for, and only
for rows that can need it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from labelaudit.functions import fixed_values as V

#: Words of printable ASCII with single spaces between them: squash leaves such a text as it is. Possessive, so that long texts need no stack.
PLAIN = r"\A[!-~]++(?: [!-~]++)*+\z"
#: Below U+0300 every text is in composed form already; the rupee signs are too.
MAY_NEED_NFC = r"[^\u0000-˿₨₹]"


def pattern(text: str) -> str:
    return V.FLAGS + text


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once; within lambdas Spark works out every mention of a value anew."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def first(text: Column, regex: str, group: int = 0) -> Column:
    """As found, for use within lambdas, where nullif would search twice."""
    return once(F.regexp_extract(text, pattern(regex), group), lambda x: F.when(x != "", x))


def found(text: Column, regex: str, group: int = 0) -> Column:
    """The group of the first match; null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern(regex), group), F.lit(""))


def has(text: Column, regex: str) -> Column:
    return F.coalesce(text.rlike(pattern(regex)), F.lit(False))


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


def nfc(df: DataFrame, *columns: str) -> DataFrame:
    """Canonical composition of text columns. Only rows with characters that can change go through Python."""
    odd = F.lit(False)
    for c in columns:
        odd = odd | F.coalesce(F.col(c).rlike(MAY_NEED_NFC), F.lit(False))
    names = df.columns
    plain = df.where(~odd)
    changed = df.where(odd).withColumns({c: _compose(F.col(c)) for c in columns}).select(*names)
    return plain.unionByName(changed)


@F.pandas_udf(ArrayType(StringType()))
def _compose_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else [None if t is None else unicodedata.normalize("NFC", t) for t in x])


def nfc_tokens(df: DataFrame, tokens: str) -> DataFrame:
    """As nfc, for the texts of an array of tokens."""
    odd = F.coalesce(F.exists(tokens, lambda t: F.coalesce(t["text"].rlike(MAY_NEED_NFC), F.lit(False))), F.lit(False))
    composed = df.where(odd).withColumn("__texts", _compose_all(F.transform(tokens, lambda t: t["text"])))
    changed = composed.withColumn(tokens, F.transform(tokens, lambda t, i: t.withField("text", F.get("__texts", i)))).select(*df.columns)
    return df.where(~odd).unionByName(changed)


def squashed(text: Column) -> Column:
    """As squash, but nothing is an empty text."""
    out = F.replace(F.replace(F.replace(text, F.lit("²"), F.lit("2")), F.lit("³"), F.lit("3")), F.lit("₨"), F.lit("Rs"))
    whole = F.trim(F.regexp_replace(out, r"(?U)[\s\x1c-\x1f ]+", " "))
    return F.when(text.rlike(PLAIN), text).otherwise(whole)


def squash(text: Column) -> Column:
    """Superscripts to digits, the old rupee sign to letters, white space to single spaces; null or nothing is null."""
    return F.nullif(squashed(text), F.lit(""))


def number_text(text: Column) -> Column:
    """Digits with at most one dot: commas go, and of several dots the last stays; no leading zeros."""
    plain = F.regexp_replace(F.replace(text, F.lit(","), F.lit("")), r"\.(?=.*\.)", "")
    return F.regexp_replace(plain, r"^0+(?=[0-9])", "")


def to_decimal(text: Column) -> Column:
    """decimal(14,4); null if it doesn't fit."""
    return number_text(text).try_cast("decimal(14,4)")


def unit_of(raw: Column) -> Column:
    raw = F.lower(raw)
    return F.coalesce(lookup(V.UNIT_CANON, raw), raw)


def quantity(text: Column) -> Column:
    """struct(digits, value, unit, raw_unit) of the first quantity."""
    digits, raw = F.regexp_extract(text, pattern(V.QUANTITY), 1), F.lower(F.regexp_extract(text, pattern(V.QUANTITY), 2))
    fields = lambda m: F.struct(number_text(m["digits"]).alias("digits"), to_decimal(m["digits"]).alias("value"), unit_of(m["raw"]).alias("unit"), m["raw"].alias("raw_unit"))
    return once(F.struct(digits.alias("digits"), raw.alias("raw")), lambda m: F.when(m["digits"] != "", fields(m)))


def money_digits(text: Column) -> Column:
    """Digits of the first amount with a currency mark."""
    return number_text(first(text, V.MONEY, 1))


def money(text: Column) -> Column:
    return money_digits(text).try_cast("decimal(14,4)")


def money_lenient_digits(text: Column) -> Column:
    """A marked amount wins; else the first amount with two decimals after a price word, else the first amount there."""
    tail = F.regexp_extract(text, pattern(V.PRICE_WORD) + r"(.*)$", 1)
    tail = F.regexp_extract(tail, pattern(r"^(.*?)(?:" + V.PRICE_TAIL_STOP + r"|$)"), 1)
    amounts = F.regexp_extract_all(tail, F.lit(pattern("(" + V.BARE_AMOUNT + ")")), F.lit(1))
    exact = lambda found: F.filter(found, lambda x: x.rlike(r"^[0-9]+\.[0-9]{2}$"))
    bare = once(amounts, lambda x: F.coalesce(F.get(exact(x), F.lit(0)), F.get(x, F.lit(0))))
    return F.coalesce(money_digits(text), F.when(has(text, V.PRICE_WORD), number_text(bare)))


def money_lenient(text: Column) -> Column:
    return money_lenient_digits(text).try_cast("decimal(14,4)")


def unit_price(text: Column) -> Column:
    """struct(digits, value, unit) of the first price per unit."""
    digits, raw = F.regexp_extract(text, pattern(V.UNIT_PRICE), 1), F.regexp_extract(text, pattern(V.UNIT_PRICE), 2)
    fields = lambda m: F.struct(number_text(m["digits"]).alias("digits"), to_decimal(m["digits"]).alias("value"), unit_of(m["raw"]).alias("unit"))
    return once(F.struct(digits.alias("digits"), raw.alias("raw")), lambda m: F.when(m["digits"] != "", fields(m)))


def month(text: Column) -> Column:
    """First of the declared month; the first form that matches decides, even if it is no date."""
    forms = ((V.DAY_MONTH_YEAR, 3), (V.MONTH_YEAR, 2), (V.NAMED_MONTH_YEAR, 2))
    groups = lambda regex, n: F.array(*[F.regexp_extract(text, pattern(regex), k) for k in range(1, n + 1)])
    whole = lambda x: F.nullif(x, F.lit("")).cast("int")

    def day_first(m: Column) -> Column:
        a, b = whole(m[0]), whole(m[1])
        return F.when((a > 12) & (b <= 12), b).when((b > 12) & (a <= 12), a).otherwise(b)

    def named(m: Column) -> Column:
        return lookup({m: k for k, m in enumerate(V.MONTHS, 1)}, F.lower(F.substring(m[0], 1, 3)))

    def date(number: Column, year: Column) -> Column:
        return once(F.struct(number.alias("number"), year.alias("year")), lambda x: F.when(x["number"].between(1, 12) & x["year"].between(*V.YEARS), F.make_date(x["year"], x["number"], F.lit(1))))

    last = once(groups(*forms[2]), lambda m: date(named(m), whole(m[1])))
    later = once(groups(*forms[1]), lambda m: F.when(m[1] != "", date(whole(m[0]), whole(m[1]))).otherwise(last))
    return once(groups(*forms[0]), lambda m: F.when(m[2] != "", date(day_first(m), whole(m[2]))).otherwise(later))


def prohibited_hits(text: Column) -> Column:
    """array<struct<token, start, end, suggestion>>: spans in the normalised text, from 0."""
    marked = F.split(F.regexp_replace(text, pattern(V.PROHIBITED_UNIT), "\u0001$1\u0002"), "\u0001")
    places = F.sequence(F.lit(2), F.size(marked))

    def hit(k: Column) -> Column:
        before = F.length(F.array_join(F.slice(marked, 1, k - 1), "")) - (k - 2)  # less one end mark for each earlier hit
        token = F.substring_index(F.element_at(marked, k), "\u0002", 1)
        fix = lookup(V.UNIT_SUGGESTION, F.lower(F.regexp_replace(token, r"[.\s]", "")))
        return F.struct(token.alias("token"), before.alias("start"), (before + F.length(token)).alias("end"), F.coalesce(fix, F.lit("")).alias("suggestion"))

    none = F.array().cast("array<struct<token:string,start:int,end:int,suggestion:string>>")
    return F.when(F.size(marked) > 1, F.transform(places, hit)).otherwise(none)


def first_prohibited(text: Column) -> Column:
    """The first prohibited unit as printed; null if there is none."""
    return found(text, V.PROHIBITED_UNIT, 1)


def suggestion_for(token: Column) -> Column:
    return F.coalesce(lookup(V.UNIT_SUGGESTION, F.lower(F.regexp_replace(token, r"[.\s]", ""))), F.lit(""))


def is_permitted(unit: Column) -> Column:
    return F.lower(F.trim(F.coalesce(unit, F.lit("")))).isin(*V.PERMITTED_UNITS)


def pin(text: Column) -> Column:
    """Six digits of a postal code; longer runs of digits (telephones) are masked first."""
    masked = F.regexp_replace(text, pattern(V.LONG_NUMBER), " ")
    marked = F.concat(found(masked, V.PIN_MARKED, 1), found(masked, V.PIN_MARKED, 2))
    spaced = F.regexp_replace(found(masked, V.PIN_SPACED), r"[\s\-]", "")
    return F.coalesce(marked, found(masked, V.PIN_BARE), spaced)


def phone(text: Column) -> Column:
    return found(text, V.PHONE)


def email(text: Column) -> Column:
    return found(text, V.EMAIL)


def any_of(words) -> str:
    """An alternation of whole words, the longest first."""
    return r"\b(" + "|".join(sorted((w.replace(".", r"\.") for w in words), key=lambda w: (-len(w), w))) + r")\b"


def origin_tail(text: Column) -> Column:
    return F.btrim(F.coalesce(found(text, V.ORIGIN_PHRASE, 1), text), F.lit(" .,:;-&"))


def origin_country(text: Column) -> Column:
    return found(origin_tail(text), any_of(V.COUNTRIES), 1)


def origin_ambiguous(text: Column) -> Column:
    return found(origin_tail(text), any_of(V.AMBIGUOUS_ORIGINS), 1)


def looks_imported(*texts: Column) -> Column:
    out = F.lit(False)
    for t in texts:
        out = out | has(t, V.IMPORT_HINT)
    return out


def compare_key(text: Column) -> Column:
    """Lower case, rupee signs as words, no punctuation: what golden values are compared by."""
    t = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("₹"), F.lit(" rs "))
    t = F.regexp_replace(t, r"(?U)\brs\.?\b", "rs")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def respondent_name(address: Column) -> Column:
    name = F.trim(F.split_part(F.regexp_replace(address, pattern(V.ADDRESS_LABEL), ""), F.lit(","), F.lit(1)))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("Not declared on package (Rule 6(1)(a) finding)"))


def pin_zone(*texts: Column) -> Column:
    digit = F.substring(F.coalesce(*[pin(t) for t in texts]), 1, 1)
    return F.coalesce(lookup(V.PIN_ZONES, digit), F.concat(F.lit("PIN zone "), digit))


def lettered(text: Column, least: int) -> Column:
    """Whether a text has so many letters at least."""
    return F.coalesce(text.rlike(rf"(?:\P{{L}}*+\p{{L}}){{{least}}}"), F.lit(False))


def letters(text: Column) -> Column:
    """How many letters a text has."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{L}", ""))
