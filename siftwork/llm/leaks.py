"""Problem 8: evaluation passages in training texts, by an FM-index per shard of documents.

Texts are brought to one form and reduced to letters and digits in lower case. A task gathers its
documents into shards of about ``SHARD`` characters, builds the shard's suffix array by prefix
doubling, its Burrows-Wheeler transform and a wavelet matrix over that, and searches all windows of
``RUN`` characters of the test items backwards and all at once. Windows that survive are located
through sampled suffix positions, and neighbouring occurrences are merged into spans.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.form import letters_and_digits, reduced_column
from siftwork.session import checkpointed, spread, table

RUN, SHARD, SAMPLE = 40, 1_500_000, 16
#: Characters of distinct reduced items that are searched at once, and such lots that one scan of the documents takes.
ITEMS_AT_ONCE, LOTS = 2_000_000, 16


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; only suffixes that are still tied are sorted again.

    The first round takes as many symbols at once as fit in a number.
    """
    n = len(symbols)
    width = max(1, int(symbols.max(initial=0) + 1).bit_length())
    k = max(1, 62 // width)
    packed = np.zeros(n, np.int64)
    for i in range(k):
        packed <<= width
        packed[: max(n - i, 0)] += symbols[i:] + 1
    order = np.argsort(packed, kind="stable")
    s = packed[order]
    head = np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    size = np.bincount(head, minlength=n)
    open_ = order[size[head] > 1]
    while len(open_):
        beyond = open_ + k
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + second
        o = np.argsort(key, kind="stable")
        pos, key = open_[o], key[o]
        old = rank[pos]
        first = np.r_[True, old[1:] != old[:-1]]
        slot = old + np.arange(len(pos)) - np.maximum.accumulate(np.where(first, np.arange(len(pos)), 0))
        order[slot] = pos
        fresh = np.r_[True, key[1:] != key[:-1]]
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(pos)), 0))
        rank[pos] = slot[at]
        alone = np.bincount(at, minlength=len(pos))[at] == 1
        open_ = pos[~alone]
        k *= 2
    return order


class FMIndex:
    """Backward search over a text of several pieces, each closed by a separator of its own."""

    def __init__(self, pieces: list[np.ndarray]):
        self.alphabet = np.unique(np.concatenate(pieces)) if pieces else np.empty(0, np.uint32)
        lengths = np.array([len(p) for p in pieces])
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        n = int((lengths + 1).sum())
        symbols = np.zeros(n, np.int64)
        body = np.ones(n, bool)
        body[self.starts + lengths] = False
        symbols[body] = len(pieces) + np.searchsorted(self.alphabet, np.concatenate(pieces))
        symbols[~body] = np.arange(len(pieces))
        order = suffix_array(symbols)
        letters = np.where(body, symbols - len(pieces) + 1, 0).astype(np.int32)  # separators are symbol 0
        bwt = letters[order - 1]
        self.before = np.cumsum(np.bincount(letters, minlength=len(self.alphabet) + 1)) - np.bincount(letters, minlength=len(self.alphabet) + 1)
        self.levels = max(1, int(len(self.alphabet)).bit_length())
        self.ones, self.zeros, row = [], [], bwt.copy()
        for level in reversed(range(self.levels)):
            bit = (row >> level) & 1 == 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(int(n - ones[-1]))
            row = np.concatenate([row[~bit], row[bit]])
        self.bwt = bwt
        self.n = n
        opens = np.zeros(n, bool)
        opens[self.starts] = True  # so that no walk passes a separator
        at = (order % SAMPLE == 0) | opens[order]
        self.sampled, self.position = at, order[at]
        self.sample_rank = np.r_[0, np.cumsum(at)].astype(np.int32)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first i symbols of the transform."""
        start = np.zeros_like(i)
        for k, level in enumerate(reversed(range(self.levels))):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones[k][i], self.ones[k][start]
            i = np.where(one, self.zeros[k] + a, i - a)
            start = np.where(one, self.zeros[k] + b, start - b)
        return i - start

    def search(self, text: np.ndarray, starts: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the windows of ``run`` code points of ``text`` that occur, and their intervals."""
        alive = np.arange(len(starts))
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        for step in range(run - 1, -1, -1):
            if not len(alive) or not len(self.alphabet):
                return alive[:0], lo[:0], hi[:0]
            ch = text[starts[alive] + step]
            c = np.minimum(np.searchsorted(self.alphabet, ch), len(self.alphabet) - 1)
            known = self.alphabet[c] == ch
            alive, c, lo, hi = alive[known], c[known] + 1, lo[known], hi[known]
            both = self.rank(np.r_[c, c], np.r_[lo, hi])
            lo, hi = self.before[c] + both[: len(c)], self.before[c] + both[len(c) :]
            some = hi > lo
            alive, lo, hi = alive[some], lo[some], hi[some]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array, walking back to the next sampled one."""
        out, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            hit = self.sampled[rows[todo]]
            done = todo[hit]
            out[done] = self.position[self.sample_rank[rows[done]]] + steps[done]
            todo = todo[~hit]
            c = self.bwt[rows[todo]].astype(np.int64)
            rows[todo] = self.before[c] + self.rank(c, rows[todo])
            steps[todo] += 1
        return out


class Items:
    """Distinct reduced items as one array of code points, where their windows start, and whose they are."""

    def __init__(self, rows: list[tuple[str, list[int]]], run: int):
        texts = [code_points(t) for t, _ in rows]
        length = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(length) - length
        n = np.maximum(length - run + 1, 0)
        self.text = np.concatenate(texts) if texts else np.empty(0, np.uint32)
        self.window_text = np.repeat(np.arange(len(rows), dtype=np.int32), n)
        self.starts = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ids = [np.array(i, np.int64) for _, i in rows]
        self.ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
        self.first = np.cumsum([0, *map(len, ids)])


def source_offsets(text: str) -> np.ndarray:
    """For each reduced character the source span it came from: rows of (start, stop)."""
    out, start = [], 0
    for i in range(1, len(text) + 1):
        if i < len(text) and unicodedata.combining(text[i]):
            continue
        out += [(start, i)] * len(letters_and_digits(text[start:i]))
        start = i
    return np.array(out, np.int64).reshape(-1, 2)


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = RUN, shard: int = SHARD) -> DataFrame:
    """``key, item, start_at, stop_at``: merged spans of the reduced document that an item shares.

    Every span is a stretch of at least ``run`` letters and digits, each window of which stands in
    the item. Rows without a key, null and blank texts and items shorter than ``run`` share nothing; equal items are all
    reported. The items are a set of bounded size: their distinct texts are sent to the workers in
    lots of about ``ITEMS_AT_ONCE`` characters, and each shard's index is built once for ``LOTS`` of them.
    """
    sc = docs.sparkSession.sparkContext
    short = items.filter(F.col(item_key).isNotNull()).select(F.col(item_key).cast("long").alias("i"), reduced_column(item_text).alias("t")).filter(F.length("t") >= run).distinct()
    texts = checkpointed(short.groupBy("t").agg(F.collect_list("i").alias("ids")))
    size = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    lots = max(1, -(-size // ITEMS_AT_ONCE))
    lot = F.pmod(F.xxhash64("t"), F.lit(lots))
    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, item bigint, start_at int, stop_at int"
    out = None
    for p in range(0, lots, LOTS):
        shared = [sc.broadcast(Items([(r["t"], r["ids"]) for r in texts.filter(lot == k).collect()], run)) for k in range(p, min(p + LOTS, lots))]

        def search(held: list[tuple[object, int, np.ndarray]], shared=shared) -> Iterator[pd.DataFrame]:
            index = FMIndex([x[2] for x in held])
            for part in shared:
                own = part.value
                alive, lo, hi = index.search(own.text, own.starts, run)
                if not len(alive):
                    continue
                n = hi - lo
                rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at, which = index.locate(rows), own.window_text[np.repeat(alive, n)]
                m = own.first[which + 1] - own.first[which]
                item = own.ids[np.repeat(own.first[which], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                at = np.repeat(at, m)
                piece = np.searchsorted(index.starts, at, side="right") - 1
                t = pd.DataFrame({"piece": piece, "item": item, "at": at - index.starts[piece]}).drop_duplicates().sort_values(["piece", "item", "at"])
                new = (t["piece"].diff() != 0) | (t["item"].diff() != 0) | (t["at"].diff() > run)
                g = t.groupby(new.cumsum().to_numpy())
                s = g.agg(piece=("piece", "first"), item=("item", "first"), a=("at", "min"), z=("at", "max"))
                offset = np.array([held[x][1] for x in s["piece"]], np.int64)
                yield pd.DataFrame({key: [held[x][0] for x in s["piece"]], "item": s["item"].to_numpy(), "start_at": s["a"].to_numpy() + offset, "stop_at": s["z"].to_numpy() + offset + run})

        def scan(batches: Iterator[pd.DataFrame], search=search) -> Iterator[pd.DataFrame]:
            held, size = [], 0
            for b in batches:
                for k, t in zip(b[key], b[text], strict=True):
                    cp = code_points(letters_and_digits(t))
                    for s in range(0, max(1, len(cp) - run + 1), shard - run + 1):
                        if len(piece := cp[s : s + shard]) < run:
                            continue
                        held.append((k, s, piece))
                        size += len(piece)
                        if size >= shard:
                            yield from search(held)
                            held, size = [], 0
            if held:
                yield from search(held)

        found = spread(docs.select(key, text).filter(F.col(text).isNotNull() & F.col(key).isNotNull())).mapInPandas(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out


def removal_spans(docs: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """``key, start_at, stop_at, n_items``: what to cut from each source text, overlaps merged.

    Only documents with a leak are read again; the offsets are code points of the source text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t, spans in zip(b[key], b[text], b["spans"], strict=True):
                where = source_offsets(t)
                merged: list[list] = []
                for s in sorted(spans, key=lambda x: (x["start_at"], x["stop_at"])):
                    a, z = int(where[s["start_at"], 0]), int(where[min(s["stop_at"], len(where)) - 1, 1])
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(z, merged[-1][1])
                        merged[-1][2].add(s["item"])
                    else:
                        merged.append([a, z, {s["item"]}])
                out += [(k, a, z, len(i)) for a, z, i in merged]
            yield pd.DataFrame(out, columns=[key, "start_at", "stop_at", "n_items"])

    spans = found.groupBy(key).agg(F.collect_set(F.struct("item", "start_at", "stop_at")).alias("spans"))
    return docs.select(key, text).join(spans, key).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, start_at int, stop_at int, n_items int")


def document_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_leaks(spark, sf_dir).select("doc_id", F.col("item").alias("item_id")).distinct()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_spans(table(spark, sf_dir, "documents"), "doc_id", "text", document_leaks(spark, sf_dir))


QUERIES = {"p8_found": p8_found, "p8_spans": p8_spans}
