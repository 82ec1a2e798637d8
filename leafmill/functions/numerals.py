"""Numerals as page numbers are printed: arabic, full-width, kanji and roman, as column expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

ROMAN = "^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
FULL_WIDTH = "０１２３４５６７８９"
#: Digits and units of kanji numerals, fixed values.
KANJI_DIGITS, KANJI_VALUES = "〇零一二三四五六七八九", "00123456789"
KANJI_UNITS = {"十": 10, "百": 100, "千": 1000}
ROMAN_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
LONGEST_NUMERAL, LONGEST_ROMAN = 6, 8
DIGIT_RUN = "[0-9０-９]{1,6}"
BLANK = "[\\s\\u3000\\u00a0]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once a row."""
    return F.transform(F.array(value), body)[0]


def squeezed(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, BLANK, "")


def arabic(text: Column) -> Column:
    """The number of a text of at most six digits, full-width ones included, white space aside; else null."""
    plain = F.translate(squeezed(text), FULL_WIDTH, "0123456789")
    return F.when(plain.rlike(f"^[0-9]{{1,{LONGEST_NUMERAL}}}$"), plain).cast("long")


def kanji(text: Column) -> Column:
    """The number of a kanji numeral of at most six characters: digits in places, or digits and units."""
    s = squeezed(text)
    placed = F.translate(s, KANJI_DIGITS, KANJI_VALUES).cast("long")
    unit = F.create_map(*[x for k, v in KANJI_UNITS.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    state = lambda total, section, last: F.struct(total.alias("total"), section.alias("section"), last.alias("last"))
    zero = F.lit(0).cast("long")

    def step(a: Column, c: Column) -> Column:
        digit = F.translate(c, KANJI_DIGITS, KANJI_VALUES).cast("long")
        section = a["section"] - a["last"] + F.greatest(a["last"], F.lit(1)) * F.element_at(unit, c)
        return F.when(F.map_contains_key(unit, c), state(a["total"] + section, zero, zero)).otherwise(state(a["total"], a["section"] + F.when(~F.map_contains_key(unit, c), digit), F.when(~F.map_contains_key(unit, c), digit)))

    units = F.aggregate(F.split(s, ""), state(zero, zero, zero), step, lambda a: a["total"] + a["section"])
    short = (F.char_length(s) >= 1) & (F.char_length(s) <= LONGEST_NUMERAL)
    return F.when(short & s.rlike(f"^[{KANJI_DIGITS}]+$"), placed).when(short & s.rlike(f"^[{KANJI_DIGITS}{''.join(KANJI_UNITS)}]+$"), units)


def numeral(text: Column) -> Column:
    """Arabic, full-width or kanji."""
    return F.coalesce(arabic(text), kanji(text))


def roman(text: Column) -> Column:
    """The value of a well-formed roman numeral in either case; else null."""
    up = F.upper(F.trim(text))
    value = F.lit(0)
    for s, v in (("M", 1000), ("D", 500), ("C", 100), ("L", 50), ("X", 10), ("V", 5), ("I", 1)):
        value = value + v * (F.char_length(up) - F.char_length(F.replace(up, F.lit(s), F.lit(""))))
    for s, less in (("CM", 200), ("CD", 200), ("XC", 20), ("XL", 20), ("IX", 2), ("IV", 2)):
        value = value - F.when(F.contains(up, F.lit(s)), less).otherwise(0)
    return F.when((up != "") & up.rlike(ROMAN), value).cast("long")


def roman_as_read(text: Column) -> Column:
    """Roman letters as a reader sums them: from the right, a letter under the largest so far is taken off.

    Either case, at most eight letters, white space aside; forms like ``iiii`` have a value. Null if
    there is another character or the sum is not positive.
    """
    s = F.lower(squeezed(text))
    value = F.create_map(*[x for k, v in ROMAN_VALUES.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("most"))

    def step(a: Column, c: Column) -> Column:
        v = F.element_at(value, c)
        return F.struct((a["total"] + F.when(v < a["most"], -v).otherwise(v)).alias("total"), F.greatest(a["most"], v).alias("most"))

    total = F.aggregate(F.reverse(F.split(s, "")), zero, step, lambda a: a["total"])
    return F.when(s.rlike(f"^[{''.join(ROMAN_VALUES)}]{{1,{LONGEST_ROMAN}}}$"), F.when(total > 0, total))


def fused_digits(text: Column) -> Column:
    """array<struct<v, start, stop>>: digit runs at the start and the end of a text, with their part of its length.

    A number read together with a running head; the parts let a box be cut in proportion.
    """
    n = F.char_length(text)
    lead_all, lead = F.regexp_extract(text, f"^{BLANK}*({DIGIT_RUN})", 0), F.regexp_extract(text, f"^{BLANK}*({DIGIT_RUN})", 1)
    trail = F.regexp_extract(text, f"({DIGIT_RUN}){BLANK}*$", 1)
    one = lambda v, a, b: F.when(v > 0, F.struct(v.alias("v"), a.cast("double").alias("start"), b.cast("double").alias("stop")))
    found = F.array(one(arabic(lead), F.lit(0.0), F.char_length(lead_all) / n), one(arabic(trail), 1 - F.char_length(trail) / n, F.lit(1.0)))
    return F.when(n > 0, F.array_compact(found)).otherwise(F.array_compact(F.array(one(F.lit(None).cast("long"), F.lit(0.0), F.lit(0.0)))))


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's similarity of two texts, null if either is."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def may_be_like(a: Column, b: Column, least: float) -> Column:
    """False where the lengths alone keep ``likeness`` under ``least``."""
    m, n = F.char_length(a), F.char_length(b)
    return F.coalesce((n > 0) & (2 * F.least(m, n) >= least * (m + n)), F.lit(False))


def collapsed(symbols: Column, charset: str) -> Column:
    """Greedy decoding of a line reader: repeats and the blank (0) go, symbol k is character k of ``charset`` from 1."""
    before = F.concat(F.array(F.lit(0)), F.slice(symbols, F.lit(1), F.greatest(F.size(symbols) - 1, F.lit(0))))
    pairs = F.filter(F.arrays_zip(symbols.alias("s"), before.alias("p")), lambda x: (x["s"] != 0) & (x["s"] != x["p"]))
    letters = F.array(*map(F.lit, charset))
    return F.array_join(F.transform(pairs, lambda x: F.element_at(letters, x["s"])), "")


def emitted_confidence(symbols: Column, probabilities: Column) -> Column:
    """Geometric mean of the probabilities of the symbols that ``collapsed`` keeps; 0 if none or one is 0."""
    before = F.concat(F.array(F.lit(0)), F.slice(symbols, F.lit(1), F.greatest(F.size(symbols) - 1, F.lit(0))))
    rows = F.filter(F.arrays_zip(symbols.alias("s"), before.alias("p"), probabilities.alias("q")), lambda x: (x["s"] != 0) & (x["s"] != x["p"]))
    total = F.aggregate(rows, F.lit(0.0), lambda a, x: a + F.log(F.greatest(x["q"], F.lit(1e-300))))
    none = (F.size(rows) == 0) | F.exists(rows, lambda x: x["q"] <= 0)
    return F.when(none, 0.0).otherwise(F.exp(total / F.greatest(F.size(rows), F.lit(1))))


def softmax(logits: Column) -> Column:
    """Of an array, with its maximum taken off first; the maximum and the sum are worked out once an array."""
    powers = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(powers, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total)))
