"""Problem 7: encoding of texts with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern. A word is a list of part boundaries and the
list of the ranks of its adjacent pairs; the smallest rank is looked for again and again, the
boundary inside that pair is deleted and the two ranks beside it are taken anew. Words recur, so
each is merged once per worker as long as it is remembered. Very long words use a heap over the
same ranks, with the same result.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.session import spread, table

#: The pattern of the rank files, a fixed value of these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes from which a word counts as long; bytes and words that a worker remembers.
LONG, KEPT_WORD, KEPT = 512, 600, 1 << 17


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """The file of a vocabulary; the folder is a parameter, by default the installed one's."""
    folder = folder or os.environ.get("SIFTWORK_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, name)


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word. Ties between equal ranks go to the left."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG:
        return merge_long(word, ranks)
    none = len(ranks) + 1
    get = ranks.get
    bound = list(range(len(word) + 1))
    near = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while near:
        low = min(near)
        if low == none:
            break
        i = near.index(low)
        del bound[i + 1], near[i]
        if i:
            near[i - 1] = get(word[bound[i - 1] : bound[i + 1]], none)
        if i < len(near):
            near[i] = get(word[bound[i] : bound[i + 2]], none)
    return [ranks[word[a:b]] for a, b in zip(bound, bound[1:])]  # noqa: B905


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue
        j = after[i]
        alive[j], after[i] = False, end
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]


@functools.lru_cache(2)
def encoder(data: bytes):
    """A function from text to ids, with a bounded memory of words."""
    import regex

    ranks, known, find = ranks_of(data), {}, regex.compile(PATTERN).findall

    def encode(text: str | None) -> array:
        out = array("i")
        for word in find(text) if text else ():
            ids = known.get(word)
            if ids is None:
                raw = word.encode()
                ids = array("i", merge(raw, ranks))
                if len(raw) <= KEPT_WORD:
                    if len(known) >= KEPT:
                        known.clear()
                    known[word] = ids
            out.extend(ids)
        return out

    return encode


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """``key, ids`` of every row. Null and empty texts give an empty list; no special tokens. Rows
    without a key are left out.

    What looks like a special token is ordinary text. The vocabulary is one file of fixed size,
    read once and sent to the workers.
    """
    import numpy as np

    with open(vocabulary or vocabulary_path(), "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(data.value)
        for b in batches:
            for s in range(0, len(b), 1000):
                part = b.iloc[s : s + 1000]
                yield pd.DataFrame({key: part[key], "ids": [np.frombuffer(x, np.int32) if len(x := encode(t)) else np.empty(0, np.int32) for t in part[text]]})

    return spread(df.select(key, text).filter(F.col(key).isNotNull())).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, ids array<int>")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, characters and tokens per source and language."""
    docs = table(spark, sf_dir, "documents")
    ids = encode_texts(docs, "doc_id", "text").select("doc_id", F.size("ids").alias("n_tokens"))
    return docs.select("doc_id", "lang", "source", F.length("text").alias("n")).join(ids, "doc_id").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"))


QUERIES = {"p7_ids": p7_ids, "p7_lengths": p7_lengths}
