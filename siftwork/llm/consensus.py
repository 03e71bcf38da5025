"""Problem 5: consensus of several annotators' labels by message passing.

Every class that an item received is a question of one class against the rest. On the edges of the
bipartite graph of items and annotators two messages alternate until they settle:

* item to annotator: the log-odds that the annotator's class is right against the rest, as the
  messages of the item's other annotators have it;
* annotator to item: the log-odds of the annotator being right on its other items, plus the log of
  the number of ways to be wrong, which is how rarely two wrong votes on an item agree.

An annotator's message to an item differs from its message to the others only by that item's own
part, so two sums per annotator (how often it is right, and on how many items) and two per field
are the whole state of a round; no edge is stored. A round is one pass over the packed votes and
one small aggregate. The consensus is the class with the largest sum of the settled messages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.session import checkpointed, table

BLANKS = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]+"

#: Annotators up to which their sums are sent to the workers; beyond it they are joined to the votes.
SENT = 100_000
#: Votes an item needs for it to tell something about its annotators' reliability.
LEAST = 3
#: Share of right votes that every annotator starts with.
START = 0.7


def label_column(col: Column | str) -> Column:
    """A label without the blanks around it; blank gives null."""
    c = F.regexp_replace(col, f"^{BLANKS}|{BLANKS}$", "")
    return F.when(c != "", c)


def latest_votes(df: DataFrame, fields: list[str], item: str, annotator: str, order: list[str]) -> DataFrame:
    """``field_name, item_key, annotator, label``: each annotator's last answer per item and field, if it has a label.

    The last by ``order`` counts even if its label is null or blank. Rows without item or annotator
    are no votes; a tie in ``order`` goes to the larger label.
    """
    rows = df.filter(F.col(item).isNotNull() & F.col(annotator).isNotNull())
    last = rows.groupBy(F.col(item).alias("item_key"), F.col(annotator).alias("annotator")).agg(*[F.max_by(F.struct(F.col(f).alias("l")), F.struct(*order, f)).alias(f"s_{f}") for f in fields])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), label_column(f"s_{f}.l").alias("label")) for f in fields])).alias("x")
    return last.select("item_key", "annotator", each).select("x.field_name", "item_key", "annotator", "x.label").filter("label IS NOT NULL")


def items_of(votes: DataFrame) -> DataFrame:
    """One row per item with its annotators and labels, in the same order."""
    v = votes.groupBy("field_name", "item_key").agg(F.collect_list(F.struct("annotator", "label")).alias("v"))
    return v.select("field_name", "item_key", F.col("v.annotator").alias("annotators"), F.col("v.label").alias("labels"))


def _flat(b: pd.DataFrame) -> tuple[dict[str, np.ndarray], pd.DataFrame, np.ndarray]:
    """The batch's votes as flat arrays, the annotators they name, and the label of each question.

    ``item``, ``question`` and ``who`` are numbered from 0 within the batch; questions of an item
    are neighbours.
    """
    n = b["annotators"].map(len).to_numpy()
    item = np.repeat(np.arange(len(b)), n)
    code, names = pd.factorize(np.concatenate(b["labels"].to_list()))
    asked, question = np.unique(item * len(names) + code, return_inverse=True)
    field = b["field_name"].to_numpy()[item]
    who, people = pd.factorize(pd.MultiIndex.from_arrays([field, np.concatenate(b["annotators"].to_list())]))
    return {"item": item, "question": question, "who": who}, pd.DataFrame(list(people), columns=["field_name", "annotator"]), names[asked % len(names)]


BLOCK = "block bigint, field_name array<string>, annotator array<string>, item binary, question binary, who binary"


def packed_votes(items: DataFrame) -> DataFrame:
    """The votes of each batch of items as one row of flat arrays, so that a round reads no strings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for k, b in enumerate(batches):
            if len(b):
                flat, people, _ = _flat(b)
                yield pd.DataFrame([{"block": first + k, "field_name": people["field_name"].to_list(), "annotator": people["annotator"].to_list(), **{c: x.astype(np.int32).tobytes() for c, x in flat.items()}}])

    return items.drop("item_key").mapInPandas(run, BLOCK)


class Block:
    """Votes of a batch, and the messages on their edges."""

    def __init__(self, item: np.ndarray, question: np.ndarray, who: np.ndarray):
        self.item, self.question, self.who = item, question, who
        self.owner = np.zeros(question.max(initial=-1) + 1, np.int64)
        self.owner[question] = item
        self.items = int(item.max(initial=-1)) + 1
        self.classes = np.bincount(self.owner, minlength=self.items)
        self.counts = (np.bincount(item, minlength=self.items) >= LEAST)[item].astype(float)

    def from_items(self, y: np.ndarray, ways: np.ndarray) -> np.ndarray:
        """Log-odds of each vote's class against the rest, as the item's other votes have it.

        Classes that nobody named stand for what is left of the ways to be wrong.
        """
        support = np.bincount(self.question, y, minlength=len(self.owner))
        top = np.zeros(self.items)
        np.maximum.at(top, self.owner, support)
        weight = np.exp(support - top[self.owner])
        named = np.bincount(self.owner, weight, minlength=self.items)
        unnamed = np.maximum(np.exp(ways) + 1 - self.classes[self.item], 1) * np.exp(-top[self.item])
        rest = np.maximum(named[self.item] - weight[self.question], 0) + unnamed
        return support[self.question] - y - top[self.item] - np.log(rest)

    def messages(self, right: np.ndarray, n: np.ndarray, ways: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Annotator to item, and the chance of each vote being right, from the sums of its annotator.

        The item's own part of the sums is found by passing the messages once with it in.
        """
        r, n, w = right[self.who], n[self.who], ways[self.who]
        sure = np.zeros(len(r))
        for turn in range(3):
            own = self.counts if turn else np.zeros(len(r))
            a = np.maximum(r - own * sure, 0)
            y = np.log((a + 1) / (np.maximum(n - own - a, 0) + 1)) + w
            sure = 1 / (1 + np.exp(-np.clip(self.from_items(y, w) + y, -500, 500)))
        return y, sure

    def sums(self, sure: np.ndarray, people: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per annotator how often right and of how many; per item the pairs of wrong votes that agree, and all."""
        right = np.bincount(self.who, self.counts * sure, minlength=people)
        n = np.bincount(self.who, self.counts, minlength=people)
        wrong = self.counts * (1 - sure)
        pairs = lambda at, k: np.bincount(at, wrong, minlength=k) ** 2 - np.bincount(at, wrong**2, minlength=k)
        agree = np.bincount(self.owner, pairs(self.question, len(self.owner)), minlength=self.items)
        return right, n, agree, pairs(self.item, self.items)


def _sent(state: DataFrame, sent: int) -> dict | None:
    """The sums of all annotators if there are at most ``sent`` of them."""
    rows = state.limit(sent + 1).collect()
    return {(r["field_name"], r["annotator"]): (r["total"], r["n"], r["ways"]) for r in rows} if len(rows) <= sent else None


def _joined(rows: DataFrame, id_: str, people: list, state: DataFrame) -> DataFrame:
    """``rows`` with the sums of the annotators that each names, in the same order."""
    named = rows.select(id_, F.posexplode(F.arrays_zip(*people)).alias("k", "p")).select(id_, "k", "p.*")
    known = named.join(state, ["field_name", "annotator"], "left").groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("k", "total", "n", "ways"))).alias("s"))
    return rows.join(known, id_)


def _params(known: dict | None, b, people: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if known is not None:
        got = np.array([known[p] for p in zip(people["field_name"], people["annotator"], strict=True)], float).reshape(-1, 3)
    else:
        got = np.array([[s["total"], s["n"], s["ways"]] for s in b], float).reshape(-1, 3)
    return got[:, 0], got[:, 1], got[:, 2]


def reliabilities(votes: DataFrame, tolerance: float = 1e-4, most: int = 200, sent: int = SENT, items: DataFrame | None = None) -> DataFrame:
    """``field_name, annotator, total, n, ways, reliability``: the sums after the messages have settled.

    ``total`` of ``n`` votes on items of at least ``LEAST`` votes are right, and reliability is
    their share (the share all start with where ``n`` is 0). Rounds go on until no reliability moves by ``tolerance``;
    after ``most`` rounds without that an error is raised, so no unsettled label comes out.
    """
    sc = votes.sparkSession.sparkContext
    blocks = checkpointed(packed_votes(items if items is not None else items_of(votes)))
    start = votes.select("field_name", "annotator").distinct().select("*", F.lit(1000 * START).alias("total"), F.lit(1000.0).alias("n"), F.lit(0.0).alias("ways"))
    state = checkpointed(start.withColumn("reliability", F.lit(START)))
    table_ = _sent(state, sent)
    for _ in range(most):
        known = sc.broadcast(table_)
        rows = blocks if table_ is not None else _joined(blocks, "block", ["field_name", "annotator"], state.drop("reliability"))

        def run(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, b in batch.iterrows():
                    people = pd.DataFrame({"field_name": b["field_name"], "annotator": b["annotator"]})
                    block = Block(*(np.frombuffer(b[c], np.int32).astype(np.int64) for c in ("item", "question", "who")))
                    total, n, ways = _params(known.value, b.get("s"), people)
                    _, sure = block.messages(total, n, ways)
                    total, n, agree, every = block.sums(sure, len(people))
                    field = np.empty(block.items, object)
                    field[block.item] = people["field_name"].to_numpy()[block.who]
                    pairs = pd.DataFrame({"field_name": field, "annotator": None, "total": agree, "n": every})
                    yield pd.concat([people.assign(total=total, n=n), pairs]).groupby(["field_name", "annotator"], as_index=False, dropna=False).sum()

        sums = rows.mapInPandas(run, "field_name string, annotator string, total double, n double").groupBy("field_name", "annotator").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        if table_ is not None:
            table_, moved = _updated(table_, sums.collect())  # a row per annotator and field, at most as many as were sent
        else:
            state, moved = _updated_frame(state, checkpointed(sums))
        if moved < tolerance:
            break
    else:
        raise RuntimeError(f"messages did not settle in {most} rounds")
    if table_ is None:
        return state
    kinds = "field_name string, annotator string, total double, n double, ways double, reliability double"
    return votes.sparkSession.createDataFrame([(*who, *x, x[0] / x[1] if x[1] else START) for who, x in table_.items()], kinds)


def _updated(known: dict, sums: list) -> tuple[dict, float]:
    """The annotators' sums after a round, and the most that a reliability or a field's ways moved by."""
    pairs = {r["field_name"]: (r["total"], r["n"]) for r in sums if r["annotator"] is None}
    ways = {f: max(float(np.log((n + 1) / (agree + 1))), 0.0) for f, (agree, n) in pairs.items()}
    new = {(r["field_name"], r["annotator"]): (r["total"], r["n"], ways[r["field_name"]]) for r in sums if r["annotator"] is not None}
    share = lambda x: x[0] / x[1] if x[1] else START
    return new, max((max(abs(share(x) - share(known[who])), abs(x[2] - known[who][2])) for who, x in new.items()), default=0.0)


def _updated_frame(state: DataFrame, sums: DataFrame) -> tuple[DataFrame, float]:
    """The same for annotators that are too many to be sent."""
    ways = sums.filter("annotator IS NULL").select("field_name", F.greatest(F.ln((F.col("n") + 1) / (F.col("total") + 1)), F.lit(0.0)).alias("ways"))
    was = state.select("field_name", "annotator", F.col("reliability").alias("_was"), F.col("ways").alias("_ways"))
    new = sums.filter("annotator IS NOT NULL").join(ways, "field_name").join(was, ["field_name", "annotator"]).withColumn("reliability", F.coalesce(F.try_divide("total", "n"), F.lit(START)))
    moved = F.greatest(F.abs(F.col("reliability") - F.col("_was")), F.abs(F.col("ways") - F.col("_ways")))
    out = checkpointed(new.select("field_name", "annotator", "total", "n", "ways", "reliability", moved.alias("moved")))
    return out.drop("moved"), out.agg(F.max("moved")).first()[0] or 0.0


def consensus(votes: DataFrame, sent: int = SENT) -> DataFrame:
    """``field_name, item_key, label, n_votes, support, runner_up, agreement`` per item.

    The label is the class with the largest sum of the settled messages of the annotators that
    chose it; ties go to the smaller string. ``agreement`` is the share of pairs of annotators that
    chose the same label, 1 for a single vote. An item's votes (one per annotator) are held
    together. A table without votes gives an empty result.
    """
    items = checkpointed(items_of(votes))
    votes = items.select("field_name", F.explode("annotators").alias("annotator"))
    state = reliabilities(votes, sent=sent, items=items)
    known = votes.sparkSession.sparkContext.broadcast(_sent(state, sent))
    rows = items
    if known.value is None:
        id_ = F.struct("field_name", "item_key").alias("id")
        named = items.select(id_, F.transform("annotators", lambda a: F.col("field_name")).alias("field_name"), F.col("annotators").alias("annotator"))
        rows = items.select("*", id_).join(_joined(named, "id", ["field_name", "annotator"], state.drop("reliability")).select("id", "s"), "id").drop("id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            flat, people, label = _flat(b)
            block = Block(**flat)
            if known.value is None:
                each = np.array([[x["total"], x["n"], x["ways"]] for s in b["s"] for x in s], float)
                params = np.zeros((len(people), 3))
                params[flat["who"]] = each
                total, n, ways = params.T
            else:
                total, n, ways = _params(known.value, None, people)
            y, _ = block.messages(total, n, ways)
            size = np.bincount(flat["question"])
            t = pd.DataFrame({"i": block.owner, "label": label, "support": np.bincount(flat["question"], y), "n": size})
            t = t.sort_values(["i", "support", "label"], ascending=[True, False, True])
            top, second = t.drop_duplicates("i"), t[t.groupby("i").cumcount() == 1]
            run_up = np.full(len(b), np.nan)
            run_up[second["i"].to_numpy()] = second["support"].to_numpy()
            count = np.bincount(flat["item"], minlength=len(b))
            pairs = np.bincount(t["i"], t["n"] * (t["n"] - 1), minlength=len(b))
            yield pd.DataFrame({"field_name": b["field_name"].to_numpy(), "item_key": b["item_key"].to_numpy(), "label": top["label"].to_numpy(), "n_votes": count.astype(np.int32), "support": top["support"].to_numpy(), "runner_up": run_up, "agreement": np.where(count > 1, pairs / np.maximum(count * (count - 1), 1), 1.0)})

    return rows.mapInPandas(run, "field_name string, item_key string, label string, n_votes int, support double, runner_up double, agreement double")


def all_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models' votes on the three labelled fields."""
    c, s = table(spark, sf_dir, "extraction_candidates"), table(spark, sf_dir, "scene_split_candidates")
    scenes = latest_votes(s, ["risk_scene"], "structured_record_id", "source_model", ["confidence"])
    return scenes.unionByName(latest_votes(c, ["finding", "scene"], "raw_record_id", "source_model", ["cand_pos", "candidate_id"]))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(all_votes(spark, sf_dir)).filter("n_votes >= 3").select("field_name", "item_key", "label")


def p5_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(all_votes(spark, sf_dir)).select("field_name", "item_key", "label", "n_votes", *[F.round(c, 4).alias(c) for c in ("support", "runner_up", "agreement")])


def p5_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = checkpointed(all_votes(spark, sf_dir))
    return reliabilities(votes).select("field_name", F.col("annotator").alias("source_model"), F.col("n").cast("bigint").alias("n_votes"), F.round("reliability", 4).alias("reliability"))


QUERIES = {"p5_found": p5_found, "p5_items": p5_items, "p5_models": p5_models}
