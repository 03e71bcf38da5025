"""Problem 2: reports that differ only in white space, case, punctuation or field order."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.form import by_distinct, one_form
from siftwork.operators.groups import connected_components, pairs_within
from siftwork.session import checkpointed, table

DASHES = "-‐‑‒–—―−"
#: What stands after a label, a label in brackets, and what stands between fields.
_SIGN = re.compile(r"\s*(?:[:=]|[—–-]{2,})[\s:=]*")
_BRACKET = re.compile(r"[【\[]\s*([^\W\d_](?:[^\W\d_]|\s)*)[】\]][\s:=]*")
_BETWEEN = re.compile(r"[;|/,.、。，；!?！？※*#>\n]")


def canonical(form: str) -> str:
    """Letters and digits in lower case, with the marks that belong to a number.

    Kept are a mark between two digits and a single minus that opens a number, that is one that
    stands before a digit and neither after a Latin letter, a digit nor another dash.
    """
    out, n = [], len(form)
    for i, ch in enumerate(form):
        if ch.isalnum():
            out.append(ch)
            continue
        after = form[i + 1] if i + 1 < n else ""
        if not after.isdecimal():
            continue
        before = form[i - 1] if i else ""
        if before.isdecimal():
            if not ch.isspace():
                out.append("-" if ch in DASHES else ch)
        elif ch in DASHES and not (before in DASHES and before) and not (before.isalpha() and before.isascii()):
            out.append("-")
    return "".join(out).lower()


def _number_mark(form: str, at: int) -> bool:
    """A mark directly between two digits, as in 12:30."""
    return form[at - 1 : at].isdecimal() and form[at + 1 : at + 2].isdecimal()


def labelled_fields(form: str, whole: bool = False) -> list[tuple[str, str]]:
    """The label and value pairs of a form that consists of labelled fields, else nothing.

    A label is the word before its sign, of any length, or what stands in brackets. With ``whole``
    it is all that stands between the last mark between fields and the sign, so it may have several
    words; of several signs after such a mark only the first has a label. A form consists of
    labelled fields if it opens with one and has at least two.
    """
    found = [(m.start(), m.end(), m[1]) for m in _BRACKET.finditer(form)]
    between = [m.start() for m in _BETWEEN.finditer(form) if not _number_mark(form, m.start())] if whole else []
    last = 0
    for m in _SIGN.finditer(form):
        stop, start = m.start(), m.start()
        if _number_mark(form, stop):
            continue
        if whole:
            k = bisect_left(between, stop)
            start = between[k - 1] + 1 if k else 0
            fresh, last = start >= last, m.end()
            if not fresh:
                continue
        else:
            while start and form[start - 1].isalnum():
                start -= 1
        if any(ch.isalpha() for ch in form[start:stop]) and not (whole and _BRACKET.search(form, start, stop)):
            found.append((start, m.end(), form[start:stop]))
    found.sort()
    if len(found) < 2 or canonical(form[: found[0][0]]):
        return []
    stops = [x[0] for x in found[1:]] + [len(form)]
    return [(canonical(label), canonical(form[end:stop])) for (_, end, label), stop in zip(found, stops, strict=True)]


FIELDS = "array<struct<name:string,value:string>>"


def parsed_column(col: Column | str) -> Column:
    """``struct(plain, fields, whole)`` of a text: its canonical string and its labelled fields read both ways.

    ``whole`` is left empty where it says the same as ``fields``.
    """

    @F.pandas_udf(f"plain string, fields {FIELDS}, whole {FIELDS}")
    def parsed(values: pd.Series) -> pd.DataFrame:
        def one(text: str) -> tuple:
            form = one_form(text)
            fields = labelled_fields(form)
            lines = text.splitlines() if _SIGN.search(form) else []
            whole = labelled_fields(form if len(lines) == 1 else "\n".join(map(one_form, lines)), True) if lines else []
            return canonical(form), fields, whole if whole != fields else []

        done = by_distinct(values, one)
        return pd.DataFrame({"plain": [x and x[0] for x in done], "fields": [x[1] if x else [] for x in done], "whole": [x[2] if x else [] for x in done]})

    return parsed(col)


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, plain_key, fields, field_key`` of every row with a non-empty canonical text.

    ``field_key`` is a commutative multiset hash: each normalised name and value pair is hashed
    and the halves of the hashes are added up, so the order of the fields has no part in it. It
    is null where the text is not made of labelled fields. A text whose labels can be read in two
    ways has a row for each.
    """
    p = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), parsed_column(text).alias("p")).filter(F.col("p.plain") != "")
    ways = F.filter(F.array("p.fields", "p.whole"), lambda f: F.size(f) > 0)
    p = p.select("key", F.unhex(F.md5("p.plain")).alias("plain_key"), F.explode_outer(ways).alias("fields"))
    hashes = F.transform("fields", lambda f: F.xxhash64(f["name"], F.lit("\u0000"), f["value"]))
    low = F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + h.bitwiseAND(F.lit(0x7FFFFFFF)))
    high = F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, 33))
    return p.withColumn("field_key", F.when(F.col("fields").isNotNull(), F.struct(low.alias("a"), high.alias("b"), F.size("fields").alias("n"))))


def _as_counts(fields: Column) -> Column:
    """Each distinct field with how often it stands, as a set without order."""
    return F.transform(F.array_distinct(fields), lambda f: F.struct(f["name"], f["value"], F.size(F.filter(fields, lambda g: g == f)).alias("times")))


def verified(prints: DataFrame) -> DataFrame:
    """``prints`` with the column ``field_class``: null without fields, else alike for equal multisets.

    Rows of one fingerprint are compared field by field with the group's first member, as sets of
    counted fields and without sorting; a row that differs (a hash collision) is classed
    by its counted fields themselves, the only ones that are put in order.
    """
    with_fields = prints.filter("field_key IS NOT NULL")
    first = with_fields.groupBy("field_key").agg(F.min_by(_as_counts(F.col("fields")), F.col("key")).alias("_first"))
    own = _as_counts(F.col("fields"))
    same = (F.size(F.array_except(own, "_first")) == 0) & (F.size(F.array_except("_first", own)) == 0)
    checked = with_fields.join(first, "field_key").select("key", "plain_key", F.concat_ws("_", "field_key.a", "field_key.b", "field_key.n", F.when(same, F.lit("")).otherwise(F.md5(F.to_json(F.array_sort(own))))).alias("field_class"))
    return checked.unionByName(prints.filter("field_key IS NULL").select("key", "plain_key", F.lit(None).cast("string").alias("field_class")))


def same_reports(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of keys that hold one report; null and blank texts, or texts without letters and digits, are no case."""
    v = checkpointed(verified(checkpointed(fingerprints(df, key, text))))
    by_text = pairs_within(v.select("plain_key", "key").distinct(), ["plain_key"], "key").select("key_a", "key_b")
    by_field = pairs_within(v.select("field_class", "plain_key", "key"), ["field_class"], "key", "plain_key").select("key_a", "key_b")
    return by_text.unionByName(by_field).distinct()


def collapse(df: DataFrame, key: str, text: str, sources: str) -> DataFrame:
    """One row per report: its smallest key, the rows and the distinct source ids it stands for.

    Rows without letters and digits stand for themselves, rows without a key for nothing. The classes are the components over
    both kinds of equality, each row tied to the first row of its groups.
    """
    v = checkpointed(verified(checkpointed(fingerprints(df, key, text))))
    ties = [v.dropna(subset=[c]).join(v.dropna(subset=[c]).groupBy(c).agg(F.min("key").alias("first")), c).select("key", "first") for c in ("plain_key", "field_class")]
    classes = connected_components(ties[0].unionByName(ties[1]), "key", "first")
    tagged = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(sources).alias("src")).join(classes, F.col("key") == F.col("node"), "left").select(F.coalesce("component", "key").alias("report_id"), "key", "src")
    rows = tagged.groupBy("report_id").agg(F.count(F.lit(1)).alias("n_rows"))
    ids = tagged.select("report_id", F.explode_outer("src").alias("s")).distinct().groupBy("report_id").agg(F.count("s").alias("n_source_ids"))
    return rows.join(ids, "report_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_reports(table(spark, sf_dir, "canonical_raw_records"), "analysis_record_id", "raw_text")


def p2_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "canonical_raw_records"), "analysis_record_id", "raw_text", "source_raw_record_ids")


QUERIES = {"p2_found": p2_found, "p2_reports": p2_reports}
