"""Ranked lexical search for many queries at once, by sums that queries share.

1. One pass over the texts keeps, for each document, its length and the counts of those terms that some item asks for.
2. Lengths and document frequencies give every term's weight.
3. The items' term sets are mined for what they share: terms asked for by the same items form one set; then neighbours in
   a common order that stand together in several items become a shared set of their own, round by round. Sets and items
   are nodes of a graph in which a node is the sum of its parts.
4. A block of documents is scored by walking the graph once: each shared set's partial scores of the block are added up
   once and used by every item that leads to it. A task keeps the best of each item; these are merged by two windows.

The items of a part (at most ``max_item_bytes`` of text) are sent to the executors; more items take more parts, each with a
pass of its own.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, as_text, materialise, parts_of_batch, release_memory, split_words, text_bytes
from .decontamination import _NORMAL, words_of

#: Partial scores that a task holds at once, in numbers of 8 bytes, and hits kept before the best are picked out.
CELLS, HITS = 4_000_000, 400_000


# ---------------------------------------------------------------- the query-sharing graph


class Plan:
    """A graph of sums. Columns 0 .. n_terms - 1 are terms; node k adds up the columns in parts[k] and is column n_terms + k;
    items[i] lists the columns that item i is the sum of. Parts come before the nodes that use them."""

    def __init__(self, n_terms: int, parts: list[tuple[int, ...]], items: list[tuple[int, ...]]):
        self.n_terms, self.parts, self.items = n_terms, parts, items

    def additions(self) -> int:
        return sum(len(p) - 1 for p in self.parts) + sum(max(0, len(i) - 1) for i in self.items)

    def evaluate(self, columns: np.ndarray) -> np.ndarray:
        """Scores (items x documents) of a block from its terms' scores (terms x documents)."""
        held = np.empty((self.n_terms + len(self.parts), columns.shape[1]), np.int64)
        held[: self.n_terms] = columns
        for k, parts in enumerate(self.parts, self.n_terms):
            np.add(held[parts[0]], held[parts[1]], out=held[k])
            for p in parts[2:]:
                held[k] += held[p]
        out = np.zeros((len(self.items), columns.shape[1]), np.int64)
        for row, parts in zip(out, self.items):
            for p in parts:
                row += held[p]
        return out


def mine(items: list[list[int]], n_terms: int) -> Plan:
    """The graph of items given as lists of distinct terms.

    Terms of the same items form one set. Then, in rounds, each item's columns are ordered alike (those of most items
    first) and neighbours that meet in two or more items become a set, the most frequent pairs first, until no pair is
    shared. Every round shortens the lists of the items that share, so rounds are few and their work follows the lists' length.
    """
    asked: dict[int, list[int]] = defaultdict(list)
    for i, terms in enumerate(items):
        for t in terms:
            asked[t].append(i)
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for t in sorted(asked):
        alike[tuple(asked[t])].append(t)
    parts: list[tuple[int, ...]] = []
    users: dict[int, int] = {}
    lists: list[list[int]] = [[] for _ in items]

    def node(members: tuple[int, ...], n: int) -> int:
        parts.append(members)
        users[n_terms + len(parts) - 1] = n
        return n_terms + len(parts) - 1

    for who, terms in alike.items():
        shared = len(who) > 1 and len(terms) > 1
        columns = [node(tuple(terms), len(who))] if shared else terms
        for c in columns:
            users[c] = len(who)
            for i in who:
                lists[i].append(c)
    while True:
        for own in lists:
            own.sort(key=lambda c: (-users[c], c))
        pairs = Counter(p for own in lists for p in zip(own, own[1:]))
        made = {p: n for p, n in sorted(pairs.items(), key=lambda x: (-x[1], x[0])) if n > 1}
        if not made:
            return Plan(n_terms, parts, [tuple(own) for own in lists])
        uses: Counter = Counter()
        cuts = []
        for own in lists:  # in each list, the most frequent of overlapping pairs
            taken: set[int] = set()
            for k in sorted((k for k in range(len(own) - 1) if (own[k], own[k + 1]) in made), key=lambda k: (-made[own[k], own[k + 1]], k)):
                if k not in taken and k + 1 not in taken:
                    taken |= {k, k + 1}
                    uses[own[k], own[k + 1]] += 1
            cuts.append(taken)
        named = {p: node(p, n) for p, n in sorted(uses.items(), key=lambda x: (-x[1], x[0])) if n > 1}
        if not named:  # pairs overlap so that none is left twice: the most frequent one alone
            best = next(iter(made))
            named, cuts = {best: node(best, made[best])}, None
        for i, own in enumerate(lists):
            out, k = [], 0
            while k < len(own):
                pair = (own[k], own[k + 1]) if k + 1 < len(own) else None
                if pair in named and (cuts is None or k in cuts[i] and k + 1 in cuts[i]):
                    out.append(named[pair])
                    k += 2
                else:
                    out.append(own[k])
                    k += 1
            lists[i] = out


# ---------------------------------------------------------------- passes over documents


def _postings(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and those terms that items ask for: their numbers and counts, as 4-byte integers."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        place = sent.value
        for b in batches:
            for rows in parts_of_batch(b, 1):
                texts = pa.array([(x or b"").translate(_NORMAL) for x in rows.column(1).to_pylist()], pa.binary())
                codes, words, bounds = split_words(as_text(texts))
                known = np.array([place.get(w, -1) for w in words], np.int64)
                found = known[codes] if len(words) else np.zeros(0, np.int64)
                n = np.diff(bounds)
                owner = np.repeat(np.arange(len(n)), n)[found >= 0]
                keys, tf = np.unique(owner * (len(place) + 1) + found[found >= 0], return_counts=True)
                cut = np.searchsorted(keys // (len(place) + 1), np.arange(len(n) + 1))
                ids, tf = (keys % (len(place) + 1)).astype("<i4"), tf.astype("<i4")
                blobs = [[x[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])] for x in (ids, tf)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], ["doc_id", "n", "terms", "counts"])
        release_memory()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes()).mapInArrow(run, "doc_id bigint, n bigint, terms binary, counts binary")


def _frequencies(postings: DataFrame, n_terms: int) -> np.ndarray:
    """The number of documents that hold each term."""

    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4"), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["term", "df"])

    found = postings.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row for each term of the items
    df = np.zeros(n_terms, np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return df


def _best(hits: list[np.ndarray], k: int) -> np.ndarray:
    """The k best of each item among rows (item, -score, id is null, doc_id)."""
    rows = np.concatenate(hits, axis=1)
    rows = rows[:, np.lexsort(rows[::-1])]
    first = np.searchsorted(rows[0], rows[0])
    return rows[:, np.arange(rows.shape[1]) - first < k]


def _scored(postings: DataFrame, plan: Plan, weights: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """item (its number), doc_id and score of the k best documents of each item in each task."""
    sent = postings.sparkSession.sparkContext.broadcast((plan, weights))

    def run(batches):
        plan, w = sent.value
        width = max(16, CELLS // (plan.n_terms + len(plan.parts) + len(plan.items)))
        least = np.ones(len(plan.items), np.int64)  # what a score must reach to be among the best
        best, held = [], 0
        for b in batches:
            for at in range(0, b.num_rows, width):
                rows = b.slice(at, width)
                own = rows.column("terms").to_pylist()
                ids, tf = (np.frombuffer(b"".join(x), "<i4").astype(np.int64) for x in (own, rows.column("counts").to_pylist()))
                n = rows.column("n").to_numpy()
                doc = np.repeat(np.arange(len(n)), [len(x) // 4 for x in own])
                m = 50 + (50 * n * n_docs) // max(n_words, 1)
                columns = np.zeros((plan.n_terms, len(n)), np.int64)
                columns[ids, doc] = w[ids] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                scores = plan.evaluate(columns)
                item, where = np.nonzero(scores >= least[:, None])
                if not len(item):
                    continue
                name = rows.column("doc_id")
                null = name.is_null().to_numpy(zero_copy_only=False)[where]
                best.append(np.stack([item, -scores[item, where], null, name.fill_null(0).to_numpy()[where]]))
                held += len(item)
                if held > HITS:
                    best = [_best(best, k)]
                    held = best[0].shape[1]
                    full = np.bincount(best[0][0], minlength=len(least)) >= k
                    last = np.searchsorted(best[0][0], np.arange(len(least)), side="right") - 1
                    least[full] = -best[0][1][last[full]]
        if best:
            item, score, null, name = _best(best, k)
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(name, mask=null.astype(bool)), pa.array(-score)], ["item", "doc_id", "score"])
        release_memory()

    return postings.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 50, max_item_bytes: int = 2_000_000) -> DataFrame:
    """For each item, its k best documents of score above 0: item_id, rank (from 1), doc_id, score.

    Items with a null id or text ask for nothing; several rows of an item count as one, of all their terms. Documents
    without terms, and null texts, are never found. Equal scores rank by ascending doc_id, null last; rows alike in both
    have a rank each. Columns other than doc_id, text and item_id, text are not read. Empty tables give no rows.
    """
    spark, keep = docs.sparkSession, Scratch()
    kind = items.schema["item_id"].dataType.simpleString()
    usable = items.where("item_id is not null and text is not null").select("item_id", text_bytes())
    size = usable.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts, out = max(1, -(-size // max_item_bytes)), None
    for part in range(parts):
        asked: dict[object, set[bytes]] = defaultdict(set)
        for name, raw in usable.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect():  # about max_item_bytes
            asked[name].update(words_of(bytes(raw)))
        names = sorted(n for n, own in asked.items() if own)
        terms = {t: i for i, t in enumerate(sorted({t for n in names for t in asked[n]}))}
        if not terms:
            continue
        postings = keep(_postings(docs, terms))
        n_docs, n_words = postings.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = _frequencies(postings, len(terms))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        plan = mine([sorted(terms[t] for t in asked[n]) for n in names], len(terms))
        found = _scored(postings, plan, weights, n_docs, n_words, k)
        # the best of each task, then of some tasks, then of all
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        some = Window.partitionBy("item", "_salt").orderBy(*order)
        found = found.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(64))).withColumn("_rank", F.row_number().over(some)).where(F.col("_rank") <= k)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        named = spark.createDataFrame(list(enumerate(names)), f"item bigint, item_id {kind}")
        own = materialise(found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))
        keep.clear()
        out = own if out is None else out.unionByName(own)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint") if out is None else out
