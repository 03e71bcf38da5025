"""One form for texts that look the same.

The form is compatibility normalisation to composed characters, restricted to what looks the same,
with look-alike letters mapped to Latin, white space mapped to single blanks and invisible
(default-ignorable) characters removed. Case folding is a switch, since letters of unlike case look
different. The work is a table lookup per character on the distinct values of an Arrow batch.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata as ud

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Compatibility mappings that change the look and are therefore not applied.
KEPT_TAGS = ("<circle>", "<super>", "<sub>", "<fraction>")

# Letters of other scripts and the Latin letters they look like, after the confusables of Unicode 16.0, with the
# case of the letter; letters that only resemble a Latin one (such as σ and o, г and r) are left out.
GREEK = "ͿΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυϜϲϳϹϺ"
GREEK_LATIN = "JABEZHIKMNOPTYXaivopuFcjCM"
CYRILLIC = "ЅІЈАВЕКМНОРСТУХаеорсухѕіјѴѵҮһӀӏԁԌԚԛԜԝ"
CYRILLIC_LATIN = "SIJABEKMHOPCTYXaeopcyxsijVvYhIldGQqWw"
PHONETIC = "ɑɡ"
PHONETIC_LATIN = "ag"
CHEROKEE = "ᎠᎡᎢᎩᎪᎫᎬᎳᎷᎻᏀᏃᏔᏕᏙᏚᏞᏟᏢᏦᏳᏴ"
CHEROKEE_LATIN = "DRTYAJEWMHGZWSVSLCPKGB"
LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_LATIN = "BPDTGKJCZFMNLSRVHWXYAEIOU"

# CJK radicals that have no decomposition of their own, and the ideographs they look like.
RADICALS = "⺁⺂⺃⺄⺅⺆⺉⺊⺋⺎⺏⺐⺒⺓⺔⺕⺖⺗⺘⺙⺛⺜⺝⺞⺠⺡⺢⺣⺤⺥⺦⺧⺨⺩⺫⺬⺭⺮⺯⺰⺱⺲⺳⺶⺹⺺⺻⺼⺾⺿⻀⻁⻂⻃⻄⻅⻆⻈⻉⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲"
RADICALS_IDEOGRAPHS = "厂乛乚乙亻冂刂卜㔾兀尣尢巳幺彑彐忄㣺扌攵旡日月歺民氵氺灬爫爫丬牛犭王罒示礻竹糹纟罓罒㓁羊耂肀聿月艹艹艹虎衤覀西见角讠贝车辶辶辶阝钅長镸长门阝雨青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀"

# Default-ignorable code points, as inclusive ranges.
IGNORABLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))

SPACE = re.compile(r"\s+")


def _flat(ch: str) -> str:
    """The character's compatibility mapping, step by step, but for mappings that change the look."""
    d = ud.decomposition(ch)
    if not d:
        return ch
    tag, rest = (d.split(" ", 1)[0], d.split(" ")[1:]) if d[0] == "<" else ("", d.split(" "))
    if tag in KEPT_TAGS or (tag and rest[0] == "0020" and len(rest) > 1):
        return ch
    return "".join(_flat(chr(int(x, 16))) for x in rest)


@functools.lru_cache(1)
def table() -> dict[int, str | None]:
    """Code point to its replacement; made once per Python worker."""
    out: dict[int, str | None] = {}
    spans = [range(0xA0, 0x3400), range(0xA69C, 0xAC00), range(0xF900, 0x10000), range(0x1D400, 0x1F252), range(0x1FBF0, 0x1FBFA), range(0x2F800, 0x2FA20)]
    for span in spans:
        for o in span:
            ch = chr(o)
            if (f := _flat(ch)) != ch and ud.normalize("NFD", ch) != f:
                out[o] = f
    for a, b in ((GREEK, GREEK_LATIN), (CYRILLIC, CYRILLIC_LATIN), (PHONETIC, PHONETIC_LATIN), (CHEROKEE, CHEROKEE_LATIN), (LISU, LISU_LATIN), (RADICALS, RADICALS_IDEOGRAPHS)):
        out |= dict(zip(map(ord, a), b, strict=True))
    for o in [*range(0x20), *range(0x7F, 0xA0)]:
        out[o] = " " if chr(o).isspace() else None
    for o in range(0xA0, 0x3001):
        if chr(o).isspace():
            out[o] = " "
    for a, b in IGNORABLE:
        out |= dict.fromkeys(range(a, min(b, sys.maxunicode) + 1))
    return {o: v and ud.normalize("NFD", v).translate(out) for o, v in out.items()}


def one_form(text: str, fold_case: bool = False) -> str:
    """``text`` in one form; applying it twice changes nothing more."""
    if not text.isascii():
        text = ud.normalize("NFC", ud.normalize("NFD", text).translate(table()))
    elif not text.isprintable():
        text = text.translate(table())
    if fold_case:
        text = ud.normalize("NFC", text.casefold().translate(table()))
    return SPACE.sub(" ", text).strip(" ")


def letters_and_digits(text: str) -> str:
    """One form reduced to letters and digits in lower case."""
    return "".join(filter(str.isalnum, one_form(text).lower()))


def by_distinct(values: pd.Series, f) -> pd.Series:
    """``f`` once per distinct value of the batch; null stays null."""
    codes, uniques = pd.factorize(values)
    done = [f(x) for x in uniques]
    return pd.Series([done[c] if c >= 0 else None for c in codes], index=values.index, dtype=object)


def form_column(col: Column | str, fold_case: bool = False) -> Column:
    """The column in one form. Null gives null; empty and blank texts give an empty text."""

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        return by_distinct(values, lambda x: one_form(x, fold_case))

    return form(col)


def reduced_column(col: Column | str) -> Column:
    """:func:`letters_and_digits` of the column; null gives null."""

    @F.pandas_udf("string")
    def reduced(values: pd.Series) -> pd.Series:
        return by_distinct(values, letters_and_digits)

    return reduced(col)


def normalise(df: DataFrame, column: str, to: str, fold_case: bool = False) -> DataFrame:
    """``df`` with the column ``to``: ``column`` in one form. Rows and other columns stay."""
    return df.withColumn(to, form_column(F.col(column), fold_case))
