"""Text, list and JSON cells as column expressions that stay in the JVM."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the separators U+001C to U+001F; the same class works in DuckDB.
SPACES = r"[\t-\r\x{1C}-\x{20}\x{85}\p{Z}]+"
#: Brackets and quotes stripped from the ends of an object; text that stands for nothing.
EDGES = "\\[\\](){}\"'“”‘’`（）【】"
NOTHING = ("nan", "none", "null", "[]", "{}")
STRINGS = "array<string>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends; null gives an empty text."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), SPACES, " "))


def strip(c: Column | str) -> Column:
    """The text without white space at its ends; null gives an empty text."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), f"^{SPACES}|{SPACES}$", "")


def compact_text(c: Column | str) -> Column:
    """Lower case without any white space; null gives an empty text."""
    return F.lower(F.regexp_replace(F.coalesce(col(c), F.lit("")), SPACES, ""))


def object_text(c: Column | str) -> Column:
    """Compact text without brackets and quotes at both ends."""
    return F.regexp_replace(compact_text(c), f"^[{EDGES}]+|[{EDGES}]+$", "")


def listed(c: Column | str) -> Column:
    """The strings of a JSON or Python list; null if the cell is neither."""
    t = normalize_text(c)
    return F.when(t.rlike(r"^\[.*\]$"), F.from_json(t, STRINGS, {"allowSingleQuotes": "true"}))


def json_list(c: Column | str) -> Column:
    """A JSON array cell as its non-empty strings; another text is one item; blank gives none."""
    t = F.coalesce(col(c), F.lit(""))
    got = F.when(t.rlike(r"(?s)^\s*\["), F.from_json(t, STRINGS, {"allowSingleQuotes": "false"}))
    kept = F.filter(got, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    none = F.array().cast(STRINGS)
    return F.when(F.trim(t) == "", none).when(got.isNotNull(), kept).when(t.rlike(r"(?s)^\s*\{"), none).otherwise(F.array(t))


def parse_objects(c: Column | str) -> Column:
    """A list-like cell as sorted distinct object texts: a list, or values between delimiters."""
    t = normalize_text(c)
    parts = F.coalesce(listed(c), F.split(t, r"[;；,，、|/]+"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, object_text), lambda x: x != "")))


def clean_objects(c: Column | str) -> Column:
    """An array's strings without blanks around them, blank ones left out; null gives none."""
    return F.filter(F.transform(F.coalesce(col(c), F.array().cast(STRINGS)), normalize_text), lambda x: x != "")


def object_key(c: Column | str) -> Column:
    """Sorted, not de-duplicated objects as one comparable text."""
    return F.array_join(F.array_sort(col(c)), "\u001f")


def first_text(*columns: Column | str) -> Column:
    """The first column that is neither blank nor ``nan``."""
    kept = [F.when((normalize_text(c) != "") & (F.lower(normalize_text(c)) != "nan"), normalize_text(c)) for c in columns]
    return F.coalesce(*kept, F.lit(""))


def safe_int(c: Column | str) -> Column:
    """Cast over double; what is no number gives 0."""
    return F.coalesce(F.expr("try_cast(try_cast({} as double) as int)".format(c)) if isinstance(c, str) else c.try_cast("double").try_cast("int"), F.lit(0))


def true_text(c: Column | str) -> Column:
    """``true``, ``1`` and ``yes`` in any case, blanks around them ignored."""
    return F.lower(normalize_text(c)).isin("true", "1", "yes")


def is_present(c: Column | str) -> Column:
    """Neither null nor blank nor a text that stands for nothing."""
    t = F.lower(normalize_text(c))
    return (t != "") & ~t.isin(*NOTHING)


def remove_suffix(c: Column | str, suffix: str) -> Column:
    c = col(c)
    return F.when(c.endswith(suffix), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c)


def channel_text(fields: dict[str, Column | str], arrays: tuple[str, ...] = ("object",)) -> Column:
    """``field: value`` pieces joined with `` | ``; array values joined with ``; ``; blank pieces left out."""
    pieces = []
    for name, c in fields.items():
        value = F.array_join(F.filter(col(c), lambda x: x != ""), "; ") if name in arrays else strip(c)
        pieces.append(F.when(value != "", F.concat(F.lit(f"{name}: "), value)))
    return F.array_join(F.array_compact(F.array(*pieces)), " | ")


def cache_key(*parts: Column | str) -> Column:
    """SHA-256 over the parts, each on a line of its own."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256)


def embedding_key(provider: str, model: str, dimension: int, text: Column | str) -> Column:
    return cache_key(*[F.lit(x) for x in (provider, model, "embedding", str(dimension))], text)


def canonical_json(**fields: Column | str) -> Column:
    """A compact JSON object with sorted keys and nulls kept."""
    return F.to_json(F.struct(*[col(fields[k]).alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def fenced_json(c: Column | str) -> Column:
    """The JSON text of an answer: code fences off, else the outermost bracketed span."""
    bare = F.trim(F.regexp_replace(col(c), r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    span = F.regexp_extract(bare, r"(?s)([\[{].*[\]}])", 1)
    return F.when(F.try_parse_json(bare).isNotNull(), bare).when(F.try_parse_json(span).isNotNull(), span)


def fill_template(template: Column | str, replacements: dict[str, Column | str]) -> Column:
    """Placeholders replaced one after the other."""
    out = col(template)
    for name, value in replacements.items():
        out = F.replace(out, F.lit(name), col(value))
    return out


def pair_key(a: Column | str, b: Column | str) -> Column:
    """An unordered pair as one text; null for a pair of equals."""
    return F.when(col(a) != col(b), F.concat_ws("|", F.least(a, b), F.greatest(a, b)))


def safe_name(c: Column | str) -> Column:
    """Letters, digits, dots, dashes and ideographs; anything else is one underscore."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(normalize_text(c), r"[^0-9A-Za-z._\x{4e00}-\x{9fff}-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("unnamed"))


def char_ngrams(c: Column | str, n: int = 2) -> Column:
    """Runs of ``n`` characters; a short text is one run; a blank one gives ``<empty>``."""
    t = normalize_text(c)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
    return F.when(t == "", F.array(F.lit("<empty>"))).when(F.length(t) <= n, F.array(t)).otherwise(runs)


def hash_bucket(gram: Column, dimension: int) -> Column:
    """The first four digest bytes, lowest first, modulo the dimension."""
    h = F.md5(gram)
    turned = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return (F.conv(turned, 16, 10).cast("long") % dimension).cast("int")


def hash_sign(gram: Column) -> Column:
    """-1 or 1 from the parity of the fifth digest byte."""
    return F.when(F.conv(F.substring(F.md5(gram), 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


def fallback_label(v: Column | str) -> Column:
    """The place of the component of largest size, modulo 3."""
    sizes = F.transform(col(v), F.abs)
    return ((F.array_position(sizes, F.array_max(sizes)) - 1) % 3).cast("int")


def clause_with(c: Column | str, markers: list[str]) -> Column:
    """From the first clause that holds a marker to the end; without one, the last clause."""
    parts = F.filter(F.split(normalize_text(c), "[，,；;。]"), lambda x: F.trim(x) != "")
    marked = F.transform(parts, lambda x: x.rlike("|".join(markers)))
    at = F.array_position(marked, F.lit(True))
    tail = F.when(at > 0, F.slice(parts, at.cast("int"), F.size(parts))).otherwise(F.slice(parts, -1, 1))
    return F.when(F.size(parts) > 0, F.array_join(tail, "，")).otherwise(F.lit(""))


def clean(c: Column | str) -> Column:
    """The cell as text as it is; null and NaN give an empty text."""
    t = col(c).cast("string")
    return F.when(t.isNull() | (t == "NaN") | (t == "nan"), "").otherwise(t)


def optional_int(c: Column | str) -> Column:
    """The whole part of a number; null, NaN and what is no number give null."""
    return optional_float(c).try_cast("bigint")


def optional_float(c: Column | str) -> Column:
    """A number; null, NaN and what is no number give null."""
    d = F.trim(col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(d), d)


def optional_bool(c: Column | str) -> Column:
    """Null stays null; else as :func:`true_text`."""
    return F.when(col(c).isNotNull(), true_text(col(c).cast("string")))


def json_dict(c: Column | str) -> Column:
    """A JSON object as a map of texts; anything else gives an empty map."""
    got = F.when(col(c).rlike(r"(?s)^\s*\{"), F.from_json(c, "map<string,string>"))
    return F.coalesce(got, F.create_map().cast("map<string,string>"))


def table_value(c: Column | str, kind: str) -> Column:
    """A cell of a nested type as JSON text, others as they are."""
    return F.to_json(c) if kind.startswith(("array", "map", "struct")) else col(c)


def _fenced_kind(c: Column | str, kind: str) -> Column:
    t = fenced_json(c)
    return F.when(F.schema_of_variant(F.try_parse_json(t)).startswith(kind), t)


def fenced_array(c: Column | str) -> Column:
    """As :func:`fenced_json`, for an array only."""
    return _fenced_kind(c, "ARRAY")


def fenced_object(c: Column | str) -> Column:
    """As :func:`fenced_json`, for an object only."""
    return _fenced_kind(c, "OBJECT")


def json_paths(c: Column | str, what: str) -> Column:
    """All ``keys``, all ``strings`` or all ``scalars`` of a JSON text, at every depth, in order.

    What is no JSON gives null. Each cell is walked with a stack, so depth has no limit but that of
    the JSON reader, beyond which the cell counts as no JSON.
    """
    def walk(text: str | None) -> list[str] | None:
        try:
            stack = [json.loads(text)] if text is not None else None
        except (ValueError, RecursionError):
            stack = None
        if stack is None:
            return None
        out = []
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                if what == "keys":
                    out.append(x[0])
                stack.append(x[1])
            elif isinstance(x, dict):
                stack += [*reversed(x.items())]
            elif isinstance(x, list):
                stack += reversed(x)
            elif x is not None and (what == "scalars" or (what == "strings" and isinstance(x, str))):
                out.append(x if isinstance(x, str) else json.dumps(x))
        return out

    @F.pandas_udf("array<string>")
    def walked(cells: pd.Series) -> pd.Series:
        return pd.Series([walk(x) for x in cells], dtype=object)

    return walked(c)


def concise(c: Column | str, markers: list[str], most: int) -> Column:
    """The text before the first marker; if longer than ``most``, its first sentence, cut to ``most`` characters."""
    t = F.coalesce(strip(c), F.lit(""))
    for m in markers:
        t = F.when(F.instr(t, m) > 0, strip(F.substring_index(t, m, 1))).otherwise(t)
    pieces = F.filter(F.transform(F.split(t, r"(?<=[。！？；])|[\r\n]+"), strip), lambda x: x != "")
    return F.when(F.length(t) <= most, t).otherwise(strip(F.substring(F.coalesce(F.try_element_at(pieces, F.lit(1)), t), 1, most)))


def range_label(value: Column | str, low: Column | str, high: Column | str) -> Column:
    """``below``, ``within`` or ``above`` a closed range; null where a part is null."""
    v = col(value)
    return F.when(v < col(low), "below").when(v > col(high), "above").when(v.isNotNull() & col(low).isNotNull() & col(high).isNotNull(), "within")


def batch_id(ids: Column | str) -> Column:
    """The ids of a batch in their order, joined with bars."""
    return F.array_join(ids, "|")


def cluster_id(*columns: Column | str) -> Column:
    """The first column that is not null, as a whole number; 0 without one."""
    return safe_int(F.coalesce(*[col(c).cast("string") for c in columns], F.lit("0")))
