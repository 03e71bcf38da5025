"""Several values packed in one field: delimiter inference per source, splitting and exploding."""

from __future__ import annotations

import ast
import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidates for a delimiter.
DELIMITERS = ";；,，、|/"
QUOTES = {'"': '"', "'": "'", "“": "”"}
BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "《": "》", "〔": "〕", "「": "」"}


def _latin(ch: str) -> bool:
    return ch.isalpha() and ("A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ɏ")


def _closing(text: str, at: int) -> int:
    """Where the quote or bracket at ``at`` closes, or -1. A doubled ``"`` does not close."""
    ch = text[at]
    if ch in QUOTES:
        end = text.find(QUOTES[ch], at + 1)
        while ch == '"' and end >= 0 and text[end + 1 : end + 2] == '"':
            end = text.find('"', end + 2)
        return end
    depth, close = 0, BRACKETS[ch]
    if text.find(close, at) < 0:
        return -1
    for i in range(at, len(text)):
        depth += (text[i] == ch) - (text[i] == close)
        if not depth:
            return i
    return -1


def cuts(text: str, delimiters: str) -> tuple[list[str], list[str]]:
    """``text`` cut at the delimiters that stand outside quotes and brackets: the pieces, and the delimiters between them.

    Nothing is cut directly between two digits or two Latin letters. A straight quote opens only at
    the start of a value; what never closes is an ordinary character.
    """
    out, between, start, i, n, open_from = [], [], 0, 0, len(text), {}
    while i < n:
        ch = text[i]
        if ch in delimiters:
            a, b = text[i - 1 : i], text[i + 1 : i + 2]
            if not (a and b and ((a.isdecimal() and b.isdecimal()) or (_latin(a) and _latin(b)))):
                out.append(text[start:i])
                between.append(ch)
                start = i + 1
        elif (ch in BRACKETS or ch == "“" or (ch in QUOTES and not text[start:i].strip())) and open_from.get(ch, n) > i:
            end = _closing(text, i)
            if end < 0:
                open_from[ch] = i
            else:
                i = end
        i += 1
    return [*out, text[start:]], between


def pieces(text: str, delimiters: str) -> list[str]:
    return cuts(text, delimiters)[0]


def bare(piece: str) -> str:
    """A value without the blanks and the quotes around it."""
    piece = piece.strip()
    if len(piece) > 1 and piece[0] in QUOTES and _closing(piece, 0) == len(piece) - 1:
        inner = piece[1:-1]
        piece = (inner.replace('""', '"') if piece[0] == '"' else inner).strip()
    return piece


def listed(cell: str) -> list | None:
    """The values of a cell that is a JSON or Python list, else None."""
    if not (cell.startswith("[") and cell.endswith("]")):
        return None
    for read in (json.loads, ast.literal_eval):
        try:
            got = read(cell)
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            continue
        if isinstance(got, list):
            return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in got if x is not None]
    return None


def values_of(cell: str, delimiters: str) -> list[str]:
    """The values of one cell in order; empty values are left out."""
    cell = cell.strip()
    got = listed(cell)
    found = [x.strip() for x in got] if got is not None else [bare(x) for x in pieces(cell, delimiters)]
    return [x for x in found if x]


#: A value is bound to a neighbour if that stands beside it this often; share of values that are not bound from which a
#: delimiter separates values.
BOUND, FREE = 0.9, 0.05


def _neighbours(df: DataFrame) -> DataFrame:
    """``source, delimiter, tied, free``: values that stand beside a delimiter more than once, bound and not bound.

    If a mark belongs to values, as in `AC / DC`, then each part has the same neighbour across it
    nearly always; if it separates values, the neighbours vary. A value is looked at on each side on
    its own, over all its occurrences in the source, at whatever delimiter or at the end of a cell.
    Counts are summed per batch before they are shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for s, c in zip(b["source"], b["cell"], strict=True):
                c = c.strip()
                got = listed(c)
                values, between = ([x.strip() for x in got], []) if got is not None else cuts(c, DELIMITERS)
                if got is None:
                    values = [x.strip() for x in values]
                last = len(values) - 1
                for k, v in enumerate(values):
                    if v:
                        left, right = (between[k - 1], values[k - 1]) if between and k else ("", ""), (between[k], values[k + 1]) if between and k < last else ("", "")
                        seen[s, v, "l", *left] += 1
                        seen[s, v, "r", *right] += 1
            rows = [(s, _digest(s, v, side), d, _digest(d, other), n) for (s, v, side, d, other), n in seen.items()]
            yield pd.DataFrame(rows, columns=["source", "place", "delimiter", "other", "n"])

    sides = df.mapInPandas(run, "source string, place bigint, delimiter string, other bigint, n bigint")
    counts = sides.groupBy("source", "place", "delimiter", "other").agg(F.sum("n").alias("n"))
    each = counts.groupBy("source", "place").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.collect_set("delimiter").alias("ds")).filter("n > 1")
    free = F.col("most") < BOUND * F.col("n")
    return each.select("source", F.explode("ds").alias("delimiter"), free.alias("free")).filter("delimiter <> ''").groupBy("source", "delimiter").agg(F.count_if(~F.col("free")).alias("tied"), F.count_if("free").alias("free"))


def _digest(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\u0000".join(parts).encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


def delimiter_scores(df: DataFrame, source: str, cell: str) -> DataFrame:
    """``source, delimiter, n_cells, score, free_share, accepted`` for every delimiter that cuts a cell of the source.

    The score is the share of cells whose piece count is within twice and half the median, times
    the mean over the cells of the share of their pieces that are regular (a letter, at most 60
    characters, no open quote). ``free_share`` tells values from parts of values: see
    :func:`_neighbours`. A delimiter is accepted if a cell that it cuts holds a value, unless nearly all
    values beside it are bound to their neighbours; values that stand only once say nothing, and
    neither odd cells nor odd pieces refuse a delimiter. Cells that are lists only tell of values.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums: dict[tuple[str, str, int], np.ndarray] = {}
            for s, c in zip(b["source"], b["cell"], strict=True):
                c = c.strip()
                if listed(c) is not None:
                    continue
                for d in DELIMITERS:
                    if d in c and len(got := pieces(c, d)) > 1:
                        filled = [p for p in got if p.strip()]
                        fine = sum(any(ch.isalpha() for ch in p) and len(p) <= 60 and p.count('"') % 2 == 0 for p in filled)
                        key = s, d, len(got)
                        sums[key] = sums.get(key, 0) + np.array([1, bool(filled), fine / max(len(filled), 1)])
            yield pd.DataFrame([(*key, int(x[0]), int(x[1]), x[2]) for key, x in sums.items()], columns=["source", "delimiter", "c", "n", "p", "r"])

    cells = df.select(F.col(source).alias("source"), F.col(cell).alias("cell")).dropna()
    parts = cells.mapInPandas(run, "source string, delimiter string, c bigint, n bigint, p bigint, r double")
    counts = parts.groupBy("source", "delimiter", "c").agg(*[F.sum(x).alias(x) for x in ("n", "p", "r")])
    s = counts.groupBy("source", "delimiter").agg(*[F.sum(x).alias(x) for x in ("n", "p", "r")], F.percentile("c", F.lit(0.5), F.col("n")).alias("mid"), F.collect_list(F.struct("c", "n")).alias("each"))
    near = F.aggregate("each", F.lit(0).cast("bigint"), lambda t, x: t + F.when((x["c"] <= 2 * F.col("mid")) & (2 * x["c"] >= F.col("mid")), x["n"]).otherwise(0))
    score = F.coalesce(F.col("r") / F.nullif("p", F.lit(0)), F.lit(0.0)) * near / F.col("n")
    s = s.join(_neighbours(cells), ["source", "delimiter"], "left")
    share = F.coalesce(F.try_divide("free", F.col("free") + F.col("tied")), F.lit(1.0))
    return s.select("source", "delimiter", F.col("n").alias("n_cells"), score.alias("score"), share.alias("free_share"), ((F.col("p") > 0) & (share >= FREE)).alias("accepted"))


def values_column(cell: Column | str, delimiters: Column | str) -> Column:
    """The values of a cell as an array; each distinct pair of a batch is parsed once."""

    @F.pandas_udf("array<string>")
    def values(cells: pd.Series, delims: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for c, d in zip(cells, delims, strict=True):
            if c is None:
                out.append([])
                continue
            if (c, d) not in known:
                known[c, d] = values_of(c, d or "")
            out.append(known[c, d])
        return pd.Series(out, dtype=object)

    return values(cell, delimiters)


def split_packed(df: DataFrame, key: str, source: str, cell: str) -> DataFrame:
    """``row_key, pos, item``: every value of every cell, its position counted from 0.

    Delimiters are those accepted for the row's source by :func:`delimiter_scores`. Null, blank
    and empty-list cells give no row; rows that stand twice give their values once; a null source
    is a source of its own.
    """
    rows = df.select(F.col(key).alias("row_key"), F.coalesce(F.col(source), F.lit("\u0000")).alias("source"), F.col(cell).alias("cell")).filter(F.col("cell").isNotNull()).distinct()
    accepted = delimiter_scores(rows, "source", "cell").filter("accepted").groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("delimiter")), "").alias("delims"))
    cut = rows.join(accepted, "source", "left").select("row_key", F.posexplode(values_column("cell", F.coalesce("delims", F.lit("")))).alias("pos", "item"))
    return cut.select("row_key", F.col("pos").cast("int").alias("pos"), "item").distinct()
