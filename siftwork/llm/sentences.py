"""Problem 9: sentence boundaries across languages and scripts.

Whether the dot of an abbreviation or a number ends a sentence is decided from unambiguous
occurrences elsewhere, those of the same document first and those of the corpus in its language
where the document is silent:

* a word before a dot is an abbreviation if its dot is followed by a small letter or a comma;
* an abbreviation that ends no paragraph, though words of the language do, ends no sentence;
* a word after such a dot opens a sentence if it stands at the start of a paragraph or after an
  exclamation or question mark, and is a proper name if it stands capitalised within sentences.

Every text is parsed once, into pieces between all places that may end a sentence; the pieces are
kept, and joined where the evidence says that a dot ends nothing. Marks that leave no doubt,
quotations, brackets, list lines, blank lines and Thai blanks follow rules of the script.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.session import checkpointed, spread, table

# Marks that end a sentence without doubt, dots that may, quotes and brackets in pairs.
STRONG = "!?。！？｡؟۔।॥։።፧‼⁇⁈⁉⸮។᠃"
DOTS = ".．"
STRONGS, _ASKED, _CLOSED = frozenset(STRONG), frozenset("!?！？"), frozenset(STRONG + DOTS + ":：;；…")
PAIRS = {"(": ")", "（": "）", "[": "]", "［": "］", "{": "}", "【": "】", "〔": "〕", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "“": "”", "„": "“", "‹": "›", "｢": "｣"}
#: Share of a word's dots before a small letter or comma, or before a number, from which it is an abbreviation, and
#: share of the places without doubt at which a capitalised word opens a sentence from which it opens others.
SHORT, COUNTED, OPENS = 0.2, 0.7, 0.5
#: An abbreviation ends none if it stands at the end of a paragraph this much less often than words of its language do,
#: and the likelihood ratio of that is significant at 99 %.
RARE, SIGNIFICANT = 0.1, 6.63
#: Up to so many corpus words are sent to the workers; beyond it each document gets its own by a join.
SENT = 200_000

BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x85  ])"
_BLANK = re.compile(rf"{BREAK}[^\S\n\r]*(?:{BREAK}\s*)+")
_BREAK = re.compile(BREAK)
_MARKER = re.compile(r"[^\S\n\r]*(?:(\d{1,3})\.(?!\d)|(\d{1,3})[)）]|[(（](\d{1,3})[)）]|[①-⑳]|[-*](?=\s)|•)")
_MARKS = re.compile(f"[{re.escape(STRONG + DOTS)}…⋯]+")
_OPEN = re.compile("[" + re.escape("".join({*PAIRS, *PAIRS.values(), '"'})) + "]")
_THAI = re.compile(r"(?<=[ก-ฺเ-๎])[^\S\n\r\x0b\x0c\x85  ]+(?=[ก-ฺเ-๎])")
# Characters without width, which part no word.
_UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_SEEN = dict.fromkeys(map(ord, _UNSEEN))
_CJK = re.compile(r"[⺀-鿿가-힯豈-﫿ｦ-ﾟ]")
_NEXT = re.compile(r"\s*([\"“„«‹「『(（\[]*)\s*([^\W\d_][^\W\d_̀-ͯ]*|\d+)?")


def covered(text: str) -> list[tuple[int, int]]:
    """Disjoint spans within paired quotes or brackets; an opener that never closes covers nothing.

    One pass with a stack: a closing mark ends the last open mark of its kind and drops what was
    opened inside it and not closed.
    """
    spans: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    waiting: Counter = Counter()
    for m in _OPEN.finditer(text):
        ch = m[0]
        close = '"' if ch == '"' else ch
        if waiting[close]:
            while True:
                want, at = stack.pop()
                waiting[want] -= 1
                if want == close:
                    break
            spans.append((at, m.start()))
        elif ch == '"' or ch in PAIRS:
            want = '"' if ch == '"' else PAIRS[ch]
            stack.append((want, m.start()))
            waiting[want] += 1
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if not out or a > out[-1][1]:
            out.append((a, b))
        elif b > out[-1][1]:
            out[-1] = (out[-1][0], b)
    return out


_CAPITALS = "".join(chr(c) for c in range(0x41, 0x530) if chr(c).isupper())
_SMALL = "".join(chr(c) for c in range(0x61, 0x530) if chr(c).islower())
_NAME = re.compile(f"(?<=[{_SMALL},] )[{_CAPITALS}][^\\W\\d_̀-ͯ]*+(?!\\.)")


def blocks(text: str) -> list[tuple[int, int, int]]:
    """``start, body, stop`` of the stretches between blank lines, cut again before list lines.

    ``body`` lies behind a list marker. A number with a dot may as well be an ordinal or a number of
    the running sentence; it is a marker if it is 1, follows the number of the marker before, or
    stands where the line before has ended with a mark.
    """
    out, last = [], 0
    edges = [0]
    for m in _BLANK.finditer(text):
        edges += [m.start(), m.end()]
    edges.append(len(text))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        start, body = a, a
        for line in [a, *(m.end() for m in _BREAK.finditer(text, a, b))]:
            m = _MARKER.match(text, line, b)
            if not m:
                continue
            number = int(m[1] or m[2] or m[3] or 0)
            if m[1] and number not in (1, last + 1) and line > start and text[start:line].rstrip()[-1:] not in _CLOSED:
                continue
            last = number or last
            if line > start:
                out.append((start, body, line))
            start, body = line, m.end()
        out.append((start, body, b))
    return out


def _word_before(text: str, start: int, stop: int) -> str:
    """The word that ends at ``stop``, in lower case: letters joined by dots (z.B), or letters and digits after a letter.

    ``#`` stands for a number, an empty text for anything else.
    """
    i = stop
    while i > start and (text[i - 1].isalnum() or unicodedata.combining(text[i - 1]) or "ऀ" <= text[i - 1] <= "෿" or (text[i - 1] in _UNSEEN and i < stop)):
        i -= 1
    word = text[i:stop].translate(_SEEN)
    while word[:1].isdigit() and not word.isdigit():
        word = word[1:]
    if not word or not word[0].isalpha():
        return "#" if text[stop - 1 : stop].isdigit() else ""
    if len(word) == 1:
        i = stop - 1
        while i - 2 >= start and text[i - 1] == "." and text[i - 2].isalpha() and not (i - 3 >= start and text[i - 3].isalpha()):
            i -= 2
    return text[i:stop].lower() if len(word) == 1 else word.lower()


def _caseless(ch: str) -> bool:
    return ch.isalpha() and not ch.isascii() and ch.lower() == ch.upper()


CERTAIN, NEVER, OPEN = 1, 0, -1


class Parsed:
    """A text cut at all places that may end a sentence.

    ``pieces`` are ``start, stop, dot``: spans without white space around them, and what ends them:
    -1 an end without doubt, else the number of the dot in ``dots``, which holds the word before,
    the kind of what follows and the word after. ``seen`` counts words before dots by kind, ``opens``
    and ``names`` are the words that open a sentence or stand within one without doubt.
    """

    def __init__(self, text: str):
        self.pieces: list[tuple[int, int, int]] = []
        self.dots: list[tuple[str, str, str]] = []
        self.seen: Counter = Counter()
        self.opens: set[str] = set()
        self.names = set(_NAME.findall(text))
        for a, body, b in blocks(text):
            inside = covered(text[a:b])
            starts = [s for s, _ in inside]
            cuts: list[tuple[int, int]] = []
            self._open(text, body, b)
            for m in _MARKS.finditer(text, body, b):
                at = m.start()
                if starts and (k := bisect_right(starts, at - a) - 1) >= 0 and at - a <= inside[k][1]:
                    if not _ASKED.isdisjoint(m[0]):
                        self._open(text, m.end(), b)
                    continue
                if not STRONGS.isdisjoint(m[0]):
                    left, right = text[at - 1 : at], text[m.end() : m.end() + 1]
                    if not (m[0].isascii() and left.isascii() and left.isalnum() and right.isascii() and (right.islower() or right.isdigit())):
                        cuts.append((m.end(), -1))
                    if not _ASKED.isdisjoint(m[0]):
                        self._open(text, m.end(), b)
                elif len(m[0]) == 1 and m[0] in DOTS:
                    verdict = self._dot(text, a, at, b)
                    if verdict != NEVER:
                        cuts.append((m.end(), -1 if verdict == CERTAIN else len(self.dots) - 1))
            for m in _THAI.finditer(text, a, b):
                if not (starts and (k := bisect_right(starts, m.start() - a) - 1) >= 0 and m.start() - a <= inside[k][1]):
                    cuts.append((m.end(), -1))
            self._cut(text, a, b, sorted(set(cuts)))

    def _open(self, text: str, at: int, stop: int) -> None:
        if (m := _NEXT.match(text, at, stop)) and m[2] and m[2][0].isupper():
            self.opens.add(m[2])

    def _dot(self, text: str, a: int, at: int, b: int) -> int:
        """Takes a single dot down and says whether it ends a sentence as far as that needs no evidence."""
        prev, nxt = text[at - 1 : at] if at > a else "", text[at + 1] if at + 1 < b else ""
        if nxt.isalnum():
            capital = nxt.isupper() and text[at + 2 : at + 3].islower() and prev.islower() and at - 2 >= a and text[at - 2].isalpha()
            return CERTAIN if _caseless(prev) or (_caseless(nxt) and not prev.isspace()) or capital else NEVER
        m = _NEXT.match(text, at + 1, b)
        after, quote, end = m[2] or "", m[1], m.end()
        if after:
            code = after.isupper() and re.match(r"-?\d", text[end : end + 2])
            kind = "num" if after[0].isdigit() or code else "mid" if after[0].islower() and not quote else "cap" if after[0].isupper() or after[0].islower() else "other"
        elif not quote and end == b:
            kind = "stop"
        else:
            mark = quote[:1] or text[end]
            kind = "mid" if mark in ",;:)]}，；：、）»”’-–—%" else "other"
        before = "" if _CJK.match(prev) else _word_before(text, a, at)
        if before and before != "#":
            self.seen[before, kind] += 1
        if kind == "stop" or (prev and _CJK.match(prev)):
            return CERTAIN
        if kind == "mid" or (len(before) == 1 and kind == "cap" and len(after) == 1 and text[end : end + 1] == "."):
            return NEVER
        if not before or (before == "#" and kind == "other"):
            return CERTAIN
        if before == "#" and kind == "num":
            return NEVER
        self.dots.append((before, kind, after))
        return OPEN

    def _cut(self, text: str, a: int, b: int, cuts: list[tuple[int, int]]) -> None:
        first, start = len(self.pieces), a
        for c, dot in [*cuts, (b, -1)]:
            piece = text[start:c]
            if piece and not piece.isspace():
                lead = len(piece) - len(piece.lstrip())
                self.pieces.append((start + lead, start + len(piece.rstrip()), dot))
            elif dot < 0 and len(self.pieces) > first:
                self.pieces[-1] = (*self.pieces[-1][:2], -1)
            start = c


def ended(dots: list[tuple[str, str, str]], own: dict[str, set[str]], opens: set[str], names: set[str], never=frozenset(), may=frozenset(), openers=frozenset()) -> list[bool]:
    """Which of a document's open dots end a sentence.

    ``own`` has the words that the document shows to be abbreviations (``mid``) and to end
    paragraphs (``stop``), ``opens`` and ``names`` its words that open sentences or stand within
    them. Where it shows nothing, or both, the corpus words ``never``, ``may`` and ``openers`` decide.
    """
    out = []
    for before, kind, after in dots:
        shown = (after in opens) - (after in names)
        opener = kind == "cap" and (shown > 0 or (not shown and after in openers))
        if before == "#":
            out.append(opener)
        elif before in never and before not in own["stop"]:
            out.append(False)
        elif before in own["mid"] or before in may or before in never:
            out.append(opener)
        else:
            out.append(True)
    return out


def joined(pieces, ends: list[bool]) -> list[tuple[int, int]]:
    """The sentences: pieces joined where the dot between them ends nothing."""
    out, start = [], None
    for a, z, dot in pieces:
        start = a if start is None else start
        if dot < 0 or ends[dot]:
            out.append((start, z))
            start = None
    return out


def sentences(text: str, never=frozenset(), may=frozenset(), openers=frozenset()) -> list[tuple[int, int]]:
    """The sentences of a text as half-open spans of code points, without white space around them.

    ``never`` and ``may`` are the corpus's abbreviations, ``openers`` its words that open sentences.
    """
    p = Parsed(text)
    own = {k: {w for w, kind in p.seen if kind == k} for k in ("mid", "stop")}
    return joined(p.pieces, ended(p.dots, own, p.opens, p.names, never, may, openers))


KINDS = ("mid", "num", "stop", "cap", "other")
PARSED = "lang string, starts array<int>, stops array<int>, closed array<int>, before array<string>, kind array<string>, after array<string>, words array<string>, kinds array<string>, times array<int>, opens array<string>, names array<string>"
#: Stands for all languages together, which documents without a language go by.
ALL = "*"


def parsed_documents(docs: DataFrame, kind: str) -> DataFrame:
    """Every document of ``_key, text, lang`` parsed once, as flat arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 500):
                part, rows = b.iloc[s : s + 500], []
                for key, text, lang in zip(part["_key"], part["text"], part["lang"], strict=True):
                    p = Parsed(text)
                    pieces, dots, seen = (list(map(list, zip(*x, strict=True))) or [[], [], []] for x in (p.pieces, p.dots, [(w, k, n) for (w, k), n in p.seen.items()]))
                    rows.append((key, lang, *pieces, *dots, *seen, sorted(p.opens), sorted(p.names)))
                yield pd.DataFrame(rows, columns=["_key", *(c.split()[0] for c in PARSED.split(", "))])

    return docs.mapInPandas(run, f"_key {kind}, {PARSED}")


def corpus_words(parsed: DataFrame) -> DataFrame:
    """``lang, word, k`` of the whole corpus: abbreviations (k is ``never`` or ``may``) and openers (``opens``).

    All are shares of the word's own occurrences in its language, so they mean the same at every
    size. A word that may end sentences ends paragraphs now and then; one that does so hardly ever,
    compared with all words of the language, is an abbreviation that ends none.
    """
    lang = F.coalesce("lang", F.lit(ALL))
    dots = parsed.select(lang.alias("lang"), F.explode(F.arrays_zip("words", "kinds", "times")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.kinds").alias("kind"), F.col("x.times").cast("bigint").alias("n"))
    at = lambda c: parsed.select(lang.alias("lang"), F.explode(c).alias("word"), F.lit(c).alias("kind"), F.lit(1).cast("bigint").alias("n"))
    every = (*KINDS, "opens", "names")
    sums = lambda df: df.groupBy("lang", "word").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in every])
    counts = checkpointed(sums(dots.unionByName(at("opens")).unionByName(at("names"))))
    whole = counts.filter(F.col("lang") != ALL).unionByName(counts.groupBy("word").agg(*[F.sum(k).alias(k) for k in every]).withColumn("lang", F.lit(ALL)))
    n = sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))
    base = whole.groupBy("lang").agg(F.try_divide(F.sum("stop"), F.sum(n)).alias("p"))
    s, p = F.col("stop"), F.col("p")
    part = lambda x, expected: F.when(x > 0, x * F.ln(x / expected)).otherwise(0.0)
    ratio = 2 * (part(s, n * p) + part(n - s, n * (1 - p)))
    no_end = (p > 0) & (p < 1) & (s <= RARE * p * n) & (ratio >= SIGNIFICANT)
    short = (F.col("mid") >= SHORT * n) | ((F.col("num") >= COUNTED * n) & (s <= RARE * p * n))
    kind = F.when(n > 0, F.when(no_end, "never").when(short, "may"))
    opens = F.when((F.col("opens") > 0) & (F.col("opens") >= OPENS * (F.col("opens") + F.col("names"))), "opens")
    return whole.join(F.broadcast(base), "lang").select("lang", "word", F.explode(F.array_compact(F.array(kind, opens))).alias("k"))


def split_documents(docs: DataFrame, key: str, text: str, lang: str | None = None, sent: int = SENT) -> DataFrame:
    """``key, start_at, stop_at`` of every sentence of every document.

    Null, empty and blank texts have none, nor have rows without a key; rows that stand twice give
    their sentences twice. Without a language a document goes by the words of all. Corpus words are
    broadcast while there are at most ``sent`` of them; beyond that each document is joined with
    the corpus words it holds, the words salted since some stand in most documents.
    """
    type_ = dict(docs.dtypes)[key]
    d = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("lang"))
    parsed = checkpointed(parsed_documents(spread(d.filter("text IS NOT NULL AND _key IS NOT NULL")), type_))
    both = checkpointed(corpus_words(parsed))
    sets = ("never", "may", "opens")

    def rows(b: pd.DataFrame, words) -> pd.DataFrame:
        out = []
        for key_, starts, stops, closed, before, kind, after, seen, kinds, opens, names, w in zip(*(b[c] for c in ("_key", "starts", "stops", "closed", "before", "kind", "after", "words", "kinds", "opens", "names")), words, strict=True):
            ends = []
            if len(before):
                own = {k: {x for x, y in zip(seen, kinds, strict=True) if y == k} for k in ("mid", "stop")}
                ends = ended(list(zip(before, kind, after, strict=True)), own, set(opens), set(names), *w)
            out += [(key_, a, z) for a, z in joined(zip(starts, stops, closed, strict=True), ends)]
        return pd.DataFrame(out, columns=["_key", "start_at", "stop_at"])

    schema = f"_key {type_}, start_at int, stop_at int"
    few = both.limit(sent + 1).toPandas()
    if len(few) <= sent:
        known = {x: tuple(frozenset(g["word"][g["k"] == k]) for k in sets) for x, g in few.groupby("lang")}
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            none = (frozenset(),) * 3
            for b in batches:
                yield rows(b, [shared.value.get(x or ALL, none) for x in b["lang"]])

        return parsed.mapInPandas(run, schema).withColumnRenamed("_key", key)

    salt = 16
    held = parsed.select("_key", F.coalesce("lang", F.lit(ALL)).alias("lang"), F.explode(F.array_distinct(F.concat("before", "after"))).alias("word")).withColumn("salt", F.pmod(F.xxhash64("_key"), F.lit(salt)).cast("int"))
    spread_words = both.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    found = held.join(spread_words, ["lang", "word", "salt"]).groupBy("_key").agg(*[F.collect_set(F.when(F.col("k") == k, F.col("word"))).alias(f"_{k}") for k in sets])

    def run_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield rows(b, [tuple(frozenset(x if x is not None else ()) for x in p) for p in zip(*(b[f"_{k}"] for k in sets), strict=True)])

    return parsed.join(found, "_key", "left").mapInPandas(run_joined, schema).withColumnRenamed("_key", key)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


QUERIES = {"p9_found": p9_found}
