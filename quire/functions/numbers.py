"""Numbers of a source text and of its Chinese target, and those the target lacks.

The scanners are plain Python over one text; ``number_mismatch`` runs them over Arrow batches, as the
rules look at what stands around a number. Null texts count as empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words and the factors that may follow a number.
ONES = {w: n for n, w in enumerate("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), 1)}
TENS = {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
FACTORS = {"thousand": 1000, "grand": 1000, "million": 10**6, "billion": 10**9, "decade": 10, "decades": 10}
# Chinese digits and units.
DIGITS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10**4, "亿": 10**8}
HALF_WIDTH = str.maketrans("０１２３４５６７８９", "0123456789")

FIGURE = re.compile(r"\d[\d,]*(?:\.\d+)?")
SPOKEN = re.compile(r"[A-Za-z]+(?:-[A-Za-z]+)?")
FACTOR_AFTER = re.compile(r"\s*([A-Za-z]+)")
RANGE = re.compile(r"\s*(?:to|[-~–—])\s*\$?\s*", re.I)
SCALE_AFTER = re.compile(r"[ \t　]*([千万亿])")
HAN_NUMBER = re.compile(f"[{''.join(DIGITS)}{''.join(UNITS)}]+")
HAN_DECADE = re.compile("[零一二三四五六七八九]{2,}几")
HAN_TENTHS = re.compile("([一二三四五六七八九])成")
#: Years stand for themselves; values below LEAST are never asked for; TOLERANCE is relative.
YEARS = range(1000, 2200)
LEAST = 4
TOLERANCE = 0.005


class Figure(NamedTuple):
    start: int
    end: int
    value: float
    year: bool


def _figures(text: str) -> Iterator[Figure]:
    """Numbers in digits that are not glued to a letter, on either side or over a hyphen."""
    for m in FIGURE.finditer(text):
        a, b = m.span()
        around = text[b : b + 1], text[a - 1 : a] if a else "", text[a - 2 : a - 1] if a > 1 and text[a - 1] == "-" else ""
        if any(c.isalpha() for c in around):
            continue
        value = float(m.group().replace(",", ""))
        yield Figure(a, b, value, value.is_integer() and YEARS[0] <= value <= YEARS[-1] and "." not in m.group())


def figures(text: str) -> set[float]:
    """Values of the figures, each times the factor that follows; the first of a range shares the second's."""
    found = list(_figures(text))
    factor = []
    for f in found:
        word = FACTOR_AFTER.match(text[f.end : f.end + 20])
        factor.append(1 if f.year or not word else FACTORS.get(word[1].lower(), 1))
    for k, (f, g) in enumerate(pairwise(found)):
        if factor[k] == 1 != factor[k + 1] and not f.year and RANGE.fullmatch(text, f.end, g.start):
            factor[k] = factor[k + 1]
    return {f.value * n for f, n in zip(found, factor)}


def _below_hundred(word: str) -> int | None:
    tens, _, ones = word.partition("-")
    if ones:
        return TENS[tens] + ONES[ones] if tens in TENS and ones in ONES else None
    return ONES.get(word) or TENS.get(word)


def spoken(text: str) -> set[float]:
    """Values of English number words: hundreds with what follows them, then any factors."""
    words = [w.lower() for w in SPOKEN.findall(text)]
    words += [""] * 3
    out, k = set(), 0
    while words[k]:
        value = _below_hundred(words[k])
        k += 1
        if value is None:
            continue
        if words[k] == "hundred" and words[k - 1] in ONES:
            value *= 100
            k += 1
            rest = k + (words[k] == "and")
            more = _below_hundred(words[rest])
            k = rest if more is None else rest + 1
            value += more or 0
        while words[k] in FACTORS:
            value *= FACTORS[words[k]]
            k += 1
        out.add(float(value))
    return out


def source_numbers(text: str, lang: str = "en") -> set[float]:
    return figures(text) | spoken(text) if lang == "en" else {f.value for f in _figures(text)}


def han_value(s: str) -> float:
    """A numeral with units: large units (万, 亿) multiply what stands since the last one."""
    total = section = digit = 0
    for c in s:
        unit = UNITS.get(c)
        if unit is None:
            digit = DIGITS[c]
        elif unit < 10**4:
            section, digit = section + (digit or 1) * unit, 0
        else:
            total, section, digit = total + (section + digit) * unit, 0, 0
    return float(total + section + digit)


def target_numbers(text: str) -> set[float]:
    """Values that a Chinese text may be said to hold, in digits and in characters."""
    text = text.translate(HALF_WIDTH)
    out = set()
    for m in FIGURE.finditer(text):
        scale = SCALE_AFTER.match(text[m.end() : m.end() + 3])
        out.add(float(m.group().replace(",", "")) * (UNITS[scale[1]] if scale else 1))
    for s in HAN_NUMBER.findall(text):
        if len(s) == 1 or not UNITS.keys().isdisjoint(s):
            out.add(han_value(s))
        elif digits := int("".join(str(DIGITS[c]) for c in s)):
            out.add(float(digits))
    if "一半" in text:
        out.add(50.0)
    return out | {10.0 * DIGITS[c] for c in HAN_TENTHS.findall(text)}


def open_years(text: str) -> list[str]:
    """The known digits, three or more, of years that end in 几."""
    known = ("".join(str(DIGITS[c]) for c in m[:-1]) for m in HAN_DECADE.findall(text))
    return [k for k in known if len(k) >= 3]


def missing_numbers(source: str, target: str, lang: str = "en") -> list[float]:
    """Values of the source that the target does not hold, ascending.

    A year is also held by its decade (80), its century's number (19, 20) or an open year.
    """
    there, starts = target_numbers(target), tuple(open_years(target))

    def held(v: float) -> bool:
        if any(abs(v - t) <= max(v, 1) * TOLERANCE for t in there):
            return True
        if not YEARS[0] <= v <= YEARS[-1]:
            return False
        year = int(v)
        return not there.isdisjoint({year % 100, year // 100, year // 100 + 1}) or bool(starts) and str(year).startswith(starts)

    return [v for v in sorted(source_numbers(source, lang)) if v >= LEAST and not held(v)]


def _said(v: float) -> str:
    return str(int(v)) if v.is_integer() else str(v)


def mismatch_detail(source: str, target: str, lang: str = "en") -> str | None:
    """What to tell about the missing numbers; None where none is missing."""
    lost = missing_numbers(source, target, lang)
    if not lost:
        return None
    there = sorted(target_numbers(target))
    # The wording of the message.
    return f"原文数值 {'、'.join(map(_said, lost))} 未在译文中出现，请核对数字后重译" + (f"——译文出现了 {'、'.join(map(_said, there))}" if there else "")


def number_mismatch(source: Column, target: Column, lang: str = "en") -> Column:
    """The detail of a pair's missing numbers, null where none is missing. Only pairs with a number go through Python."""
    @F.arrow_udf("string")
    def detail(sources: pa.Array, targets: pa.Array) -> pa.Array:
        return pa.array([mismatch_detail(s or "", t or "", lang) for s, t in zip(sources.to_pylist(), targets.to_pylist())], pa.string())

    words = "|".join([*ONES, *TENS])
    may = F.coalesce(source.rlike(rf"(?U)\d|(?i)\b(?:{words})\b" if lang == "en" else r"(?U)\d"), F.lit(False))
    return F.when(may, detail(F.when(may, source), F.when(may, target)))
