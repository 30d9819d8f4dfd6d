"""Exact n-gram Jaccard join by T-occurrence search (DivideSkip), and the components of its links.

Two sets of sizes m and n reach a Jaccard similarity of p percent only with an overlap of T = ceil(p (m + n) / (100 + p)),
and only if they share one of their first n - ceil(p n / 100) + 1 shingles in any order common to all documents. So the
inverted lists of those shingles, the short ones when frequent shingles come last in the order, give every candidate;
the long lists are never gathered but probed by binary search for the candidates alone.

1. One pass over the texts: size and set digest of each row (equal sets form one node), and frequent shingles.
2. Short lists: the first shingles of each node are dealt by shingle; shingles with the same nodes become one list with a
   weight. In each list every node is paired with the one that shares most, which is searched for in blocks of them.
   Lists whose nodes have turned out connected need nothing more, so a group of k near copies costs about k pairs and
   not k squared.
3. What shares a list and isn't connected yet: in short lists, pairs that share enough lists to reach the overlap are
   verified; in lists of many nodes, those outside the list's largest component are searched for in blocks of the others.
4. Connected components of the exact links.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, as_text, discard, hash_words, keep_matching, materialise, mix64, parts_of_batch, release_memory, split_words, text_bytes

#: Frequent shingles kept for the order of shingles; more of them would shorten lists, none of them changes a result.
FREQUENT = 500_000
#: Longer lists are searched by blocks of nodes instead of pair by pair, and a block's size.
LONG, BLOCK = 32, 256
#: Shingles of so many texts are counted together in a task.
CHUNK = 2_000_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def overlap_needed(m: int, n: int, percent: int) -> int:
    """The smallest overlap with 100 * overlap >= percent * union."""
    return -(-percent * (m + n) // (100 + percent))


def prefix_length(n, percent: int):
    """First shingles of which a partner must share one."""
    return n - (percent * n + 99) // 100 + 1


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts. A collision within a pair of texts has odds of about 1e-13."""

    def __init__(self, size: int = 5):
        self.size = size

    def __call__(self, raw: bytes) -> np.ndarray:
        return self.sets(pa.array([raw], pa.binary()))[0]

    def _rolled(self, h: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the windows of n words."""
        out = np.full(max(0, len(h) - n + 1), n, np.uint64)
        for k in range(n):
            out += h[k : k + len(out)] * (_ODD[k % 5] + np.uint64(2 * (k // 5)))
        return mix64(out)

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """The set of each text; A-Z folded, words between ASCII white space, a shorter text as one shingle."""
        places, words, bounds = split_words(pc.ascii_lower(as_text(texts)))
        h = hash_words(words)[places]
        every, bounds = self._rolled(h, self.size), bounds.tolist()
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            out.append(np.unique(every[a : b - self.size + 1]) if b - a >= self.size else self._rolled(h[a:b], b - a) if b > a else np.empty(0, np.uint64))
        return out


def node_of(tokens: np.ndarray) -> int:
    """The node id of a set: a signed 64-bit digest."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


# ---------------------------------------------------------------- T-occurrence search


class BlockIndex:
    """Inverted lists of a block of sets: shingle -> ascending positions of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        self.keys, self.first = np.unique(tokens[order], return_index=True)
        self.last = np.append(self.first[1:], len(tokens))

    def lists(self, query: np.ndarray) -> list[np.ndarray]:
        if not len(self.keys):
            return []
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        return [self.owner[self.first[k] : self.last[k]] for k in at[self.keys[at] == query].tolist()]


def divide_skip(query: np.ndarray, index: BlockIndex, percent: int) -> list[tuple[int, int]]:
    """(position, overlap) of the sets of the block that reach the overlap which their size asks for.

    The L longest lists are set aside; the short ones are heap-merged, and what occurs there at least T - L times is
    looked up in the long lists by binary search, for as long as it can still reach T.
    """
    lists = sorted(index.lists(query), key=len)
    need = [overlap_needed(len(query), len(s), percent) for s in index.sets]
    least = min(need, default=0)
    if len(lists) < least or not lists:
        return []
    n_long = max(0, least - 1)  # with L = T - 1, one occurrence in the short lists makes a candidate
    short, long = lists[: len(lists) - n_long], [x.tolist() for x in lists[len(lists) - n_long :]]
    found = []
    merged = heapq.merge(*(x.tolist() for x in short))
    for who, run in groupby(merged):
        count = sum(1 for _ in run)
        if count + len(long) < need[who]:
            continue
        for k, own in enumerate(long):
            if count + len(long) - k < need[who]:
                break
            at = bisect_left(own, who)
            count += at < len(own) and own[at] == who
        if count >= need[who]:
            found.append((who, count))
    return found


# ---------------------------------------------------------------- stages


def _describe(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document (kind 0: doc_id, node, n) and for each shingle frequent in a task (kind 1: node, n times)."""

    def run(batches):
        shingle = Shingler(size)
        pending, seen, held = [], set(), 0

        def frequent():
            keys, n = np.unique(np.concatenate(pending), return_counts=True)
            return keys[n >= 2], n[n >= 2]

        def rows(kind, doc_ids, nodes, ns):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ns), kind, np.int32)), doc_ids, pa.array(nodes, pa.int64()), pa.array(ns, pa.int64())], ["kind", "doc_id", "node", "n"])

        for b in batches:
            nodes, ns = [], []
            for t in (t for part in parts_of_batch(b, 1) for t in shingle.sets(part.column(1))):
                node = node_of(t)
                nodes.append(node)
                ns.append(len(t))
                if len(t) and node not in seen:  # copies count once in a chunk
                    seen.add(node)
                    pending.append(t)
                    held += len(t)
                    if held >= CHUNK:
                        keys, n = frequent()
                        yield rows(1, pa.nulls(len(n), pa.int64()), keys.view(np.int64), n)
                        pending, seen, held = [], set(), 0
            yield rows(0, b.column(0), nodes, ns)
        if pending:
            keys, n = frequent()
            yield rows(1, pa.nulls(len(n), pa.int64()), keys.view(np.int64), n)
        pending.clear()
        release_memory()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes()).mapInArrow(run, "kind int, doc_id bigint, node bigint, n bigint")


def _first_shingles(reps: DataFrame, frequent, size: int, percent: int, buckets: int) -> DataFrame:
    """The first shingles of each node in the common order, dealt by shingle: blobs of (shingle, node, size, rank)."""

    def run(batches):
        shingle, seen = Shingler(size), set()
        keys, times = frequent.value
        for b in batches:
            for rows in parts_of_batch(b, 1):
                parts = []
                for t in shingle.sets(rows.column(1)):
                    if not len(t) or (node := node_of(t)) in seen:  # copies without an id come here too
                        continue
                    seen.add(node)
                    n = len(t)
                    p = prefix_length(n, percent)
                    first = t
                    if len(keys):
                        k = np.minimum(np.searchsorted(keys, t), len(keys) - 1)
                        common = keys[k] == t
                        first = t[~common]
                        if len(first) < p:
                            first = np.concatenate([first, t[common][np.argsort(times[k[common]], kind="stable")]])
                    e = np.empty(p, _ENTRY)
                    e["token"], e["node"], e["n"], e["rank"] = first[:p], node, n, np.arange(p)
                    parts.append(e)
                if not parts:
                    continue
                e = np.concatenate(parts)
                bucket = (mix64(e["token"]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                e, bucket = e[order], bucket[order]
                cut = np.flatnonzero(np.diff(bucket)) + 1
                blobs = [_packed(x) for x in np.split(e, cut)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[np.concatenate([[0], cut])], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "entries"])
        seen.clear()
        release_memory()

    return reps.select("doc_id", "text").mapInArrow(run, "bucket bigint, entries binary")


_ENTRY = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<i4"), ("rank", "<i4")])


def _packed(e: np.ndarray) -> bytes:
    """Entries as bytes, column by column and the small numbers byte by byte: their zeros lie together and compress."""
    small = np.stack([e["n"], e["rank"]]).view(np.uint8).reshape(2, len(e), 4).transpose(0, 2, 1)
    return e["token"].tobytes() + e["node"].tobytes() + small.tobytes()


def _unpacked(blobs: list[bytes]) -> np.ndarray:
    e, at = np.empty(sum(len(x) for x in blobs) // _ENTRY.itemsize, _ENTRY), 0
    while blobs:
        x = blobs.pop()
        k = len(x) // _ENTRY.itemsize
        own = e[at : at + k]
        own["token"], own["node"] = np.frombuffer(x, "<u8", k), np.frombuffer(x, "<i8", k, 8 * k)
        own["n"], own["rank"] = np.ascontiguousarray(np.frombuffer(x, np.uint8, offset=16 * k).reshape(2, 4, k).transpose(0, 2, 1)).view("<i4").reshape(2, k)
        at += k
    return e


def _short_lists(blobs: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Lists of two or more nodes: list (a digest of its nodes), node, n, rank (the node's highest of the list's
    shingles) and weight (the number of shingles with these nodes)."""

    def run(batches):
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for k, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(k, []).append(e)
        while held:
            e = np.unique(_unpacked(held.popitem()[1]))  # a node may come from several tasks
            _, which, n = np.unique(e["token"], return_inverse=True, return_counts=True)
            e = e[n[which] > 1]
            e = e[np.lexsort((e["node"], e["n"], e["token"]))]
            # an entry whose neighbours by size are too small and too large for it has no partner in the list
            near = (e["token"][1:] == e["token"][:-1]) & (100 * e["n"][:-1].astype(np.int64) >= percent * e["n"][1:].astype(np.int64))
            e = e[np.concatenate([near, [False]]) | np.concatenate([[False], near])] if len(e) else e
            if not len(e):
                continue
            first = np.flatnonzero(np.concatenate([[True], e["token"][1:] != e["token"][:-1]]))
            size = np.diff(np.append(first, len(e)))
            digest = mix64(np.bitwise_xor.reduceat(mix64(e["node"].view("<u8") if e["node"].flags.c_contiguous else e["node"].astype("<i8").view("<u8")), first) + size.astype(np.uint64))
            digest = np.repeat(digest.view(np.int64), size)
            order = np.lexsort((e["rank"], e["node"], digest))
            e, digest = e[order], digest[order]
            first = np.flatnonzero(np.concatenate([[True], (digest[1:] != digest[:-1]) | (e["node"][1:] != e["node"][:-1])]))
            last = np.append(first[1:], len(e)) - 1
            cols = [digest[first], e["node"][first], e["n"][first], e["rank"][last], (last - first + 1).astype(np.int64)]
            for at in range(0, len(first), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[at : at + 100_000])) for c in cols], ["list", "node", "n", "rank", "weight"])
        release_memory()

    lists = blobs.repartition(buckets, "bucket").mapInArrow(run, "list bigint, node bigint, n int, rank int, weight bigint")
    return lists.groupBy("list", "node").agg(F.max("n").alias("n"), F.max("rank").alias("rank"), F.sum("weight").alias("weight"))


def _possible(n, last, m, other, shared, percent: int):
    """Whether sets of sizes n and m can reach the overlap that share exactly ``shared`` of their first shingles, the
    last of them at the ranks last and other: any further one lies beyond the first shingles of one of the sets."""
    need = F.ceil(percent * (n + m) / F.lit(100.0 + percent) - 1e-9)
    beyond = lambda size: F.ceil(percent * size / F.lit(100.0) - 1e-9) - 1
    more = F.greatest(F.least(beyond(n), m - 1 - other), F.least(n - 1 - last, beyond(m)))
    return shared + more >= need


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK, few: bool = False) -> DataFrame:
    """Links among pairs (a, b): for each a, its partners in blocks, each block searched with a as the query. ``few``: at
    most BROADCAST_ROWS pairs and queries."""
    size = pairs.groupBy("a").agg(F.count("*").alias("partners"))
    parts = F.ceil(F.col("partners") / block).cast("int")
    dealt = pairs.join(size, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.greatest(parts, F.lit(1))).cast("int"))
    queries = size.select("a", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)).alias("part"))
    wanted = queries.select("a", "part", F.lit(0).alias("kind"), F.col("a").alias("b")).unionByName(dealt.select("a", "part", F.lit(1).alias("kind"), "b"))

    def run(batches):
        now, query, ids, own = None, None, [], []

        def links():
            """The query's links in the block; members that it doesn't reach are searched for in turn."""
            if not own or query is None:
                return []
            index = BlockIndex(own)
            hit = {k for k, _ in divide_skip(query, index, percent)}
            found = [(now[0], ids[k]) for k in hit]
            if len(own) > 1:
                for k in range(len(own)):
                    if k not in hit:
                        found += [(ids[k], ids[j]) for j, _ in divide_skip(own[k], index, percent) if j != k]
            return found

        out: list[tuple[int, int]] = []
        for b in batches:
            for a, part, kind, node, tokens in zip(*(c.to_pylist() for c in b.columns)):
                if (a, part) != now:
                    out += links()
                    now, query, ids, own = (a, part), None, [], []
                t = np.frombuffer(tokens, "<u8")
                if kind == 0:
                    query = t
                elif not ids or ids[-1] != node:  # a set may come from several tasks
                    ids.append(node)
                    own.append(t)
                    if len(own) >= 2 * block:  # a block is full: search it and go on with the same query
                        out += links()
                        ids, own = [], []
            yield _pairs_batch(out)
            out = []
        yield _pairs_batch(links())
        ids, own = [], []
        release_memory()

    # sets are read once and, as long as what is wanted of them can be broadcast, shuffled once
    wanted = wanted.withColumnRenamed("b", "node")
    rows = sets.join(F.broadcast(wanted) if few else wanted, "node").select("a", "part", "kind", F.col("node").alias("b"), "tokens")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "kind", "b").mapInArrow(run, "a bigint, b bigint")


def _pairs_batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the links (a, b): the component's smallest node.

    Alternates large-star and small-star rounds, each written to the shared folder, until nothing changes. The result reads
    the last of them, which ``discard`` deletes.
    """
    edges = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    before = mark(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
        large = both.where("b > a").join(least, "a").select(F.col("low").alias("a"), "b").where("a <> b")
        # every edge now runs from a smaller a to a larger b; the small star ties b's smaller neighbours to the smallest
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b")
        small = small.select("low", "a").union(small.select("low", "b")).toDF("low", "b").where("low <> b")
        old, edges = edges, materialise(small.select(F.col("low").alias("a"), "b").distinct())
        discard(old)
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"connected_components: not settled after {max_rounds} rounds")
    found = edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    found._written = edges._written
    return found


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75, keep: Scratch | None = None) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id, the smallest doc_id that it reaches by links, itself included.

    A set holds the distinct shingles of ``size`` lower-cased (A-Z) words; a shorter text is one shingle; null or
    wordless texts have an empty set and link with nothing. Rows with equal sets are linked. A null doc_id takes part
    as a text, but is no component's id unless its component has no other (then null). Repeated rows stay. Columns
    other than doc_id and text are not read. Tables on the way are deleted; those that the result reads are put into
    ``keep``, for a caller that deletes them too.
    """
    keep, steps = Scratch() if keep is None else keep, Scratch()
    described = keep(_describe(docs, size))
    rows = described.where("kind = 0").select("doc_id", "node", "n")
    nodes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    comps = connected_components(_all_links(docs, described, nodes, size, percent, steps))
    keep.held.append(comps)
    steps.clear()
    least = Window.partitionBy("group")
    labels = nodes.join(comps, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("group"))
    named = labels.groupBy("group").agg(F.min("doc_id").alias("component_id")).join(labels.select("node", "group"), "group")
    return rows.join(named.select("node", "component_id"), "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _all_links(docs: DataFrame, described: DataFrame, nodes: DataFrame, size: int, percent: int, steps: Scratch) -> DataFrame:
    """Links that connect all nodes whose sets reach the similarity; links within a component may be left out. ``steps``
    holds what they are read from."""
    spark = docs.sparkSession
    top = described.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(FREQUENT)
    top = top.toArrow()  # at most FREQUENT rows
    keys = top["node"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], top["n"].to_numpy()[order]))
    total = described.where("kind = 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(16, int(total[1] * (100 - percent) / 100) // 400_000)

    # one text for each node: rows that are not their node's first are left out by a join on their ids
    first = nodes.select("doc_id").where("doc_id is not null")
    extra = steps(described.where("kind = 0 and n > 0").select("doc_id", "node").join(nodes.select("node", F.col("doc_id").alias("first")), "node").where("doc_id <> first").select("doc_id").distinct().join(first, "doc_id", "left_anti"))
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes())
    reps = keep_matching(source, extra, "doc_id", extra.count(), "left_anti")
    plain = materialise(_short_lists(_first_shingles(reps, frequent, size, percent, buckets), buckets, percent))
    spread, salted = _dealt(plain, written=steps)
    lists = steps(salted)
    discard(plain)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The whole sets of the given nodes, some of them maybe more than once; texts and sets are filtered by broadcast
        ids where those are few."""
        ids = steps(nodes.join(wanted.distinct(), "node").select("node", "doc_id"))
        n = ids.count()
        texts = keep_matching(source, ids.select("doc_id").distinct(), "doc_id", n)
        if not ids.where("doc_id is null").isEmpty():  # nodes of rows without an id are found by their digest alone
            texts = texts.unionByName(source.where("doc_id is null"))
        return keep_matching(_sets(texts, size), ids.select("node"), "node", n)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = steps(pairs)
        few = 2 * pairs.count() <= BROADCAST_ROWS  # a query has a pair at least
        return steps(_verify(pairs, sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b"))), percent, few=few))

    # the node that shares most with others is each list's lead: enough to connect groups of copies
    shares = lists.groupBy("node").agg(F.sum(F.col("weight") * F.col("nodes")).alias("shares"))
    ranked = lists.join(shares, "node")
    leads = ranked.groupBy("list").agg(F.max(F.struct("shares", "node", "n")).alias("lead")).select("list", F.col("lead.node").alias("a"), F.col("lead.n").alias("m"))
    star = lists.join(spread(leads), ["list", "salt"]).where("node <> a").groupBy("a", F.col("node").alias("b")).agg(F.sum("weight").alias("shared"), F.max("n").alias("n"), F.max("m").alias("m"))
    sizes = (100 * F.col("m") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("m"))
    links = verified(star.where(sizes & (F.col("shared") >= 0.03 * F.col("n"))).select("a", "b"))
    rounds = connected_components(links)
    comps = steps(rounds)
    discard(rounds)

    # every other pair that shares a list and isn't connected yet: counted in the short lists, then bounded by the long ones
    tagged = lists.join(comps, "node", "left").select("list", "salt", "nodes", "node", "n", "rank", "weight", F.coalesce("component", "node").alias("group"))
    mixed = tagged.groupBy("list").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("list")
    open_lists = steps(tagged.join(spread(mixed), ["list", "salt"], "left_semi"))
    short_lists = open_lists.where(F.col("nodes") <= LONG)
    x, y = short_lists.alias("x"), short_lists.alias("y")
    sizes = (100 * F.col("x.n") >= percent * F.col("y.n")) & (100 * F.col("y.n") >= percent * F.col("x.n"))
    rest = x.join(y, (F.col("x.list") == F.col("y.list")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.group") != F.col("y.group")) & sizes)
    rest = rest.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(
        F.sum("x.weight").alias("shared"), F.max("x.rank").alias("i"), F.max("y.rank").alias("j"), F.max("x.n").alias("n"), F.max("y.n").alias("m")
    )
    # a pair that also shares a long list may be bounded too low here; the blocks below find it
    rest = rest.where(_possible(F.col("n"), F.col("i"), F.col("m"), F.col("j"), F.col("shared"), percent)).select("a", "b")
    links = links.unionByName(verified(rest))

    members = open_lists.where(F.col("nodes") > LONG)
    if members.isEmpty():
        return links
    asks, blocks = _block_search(members, spread, percent)
    asks, blocks = steps(asks), steps(blocks)
    return links.unionByName(_search_blocks(asks, blocks, sets_of(members.select("node")), percent))


def _dealt(lists: DataFrame, least: int = 500, written=materialise):
    """Lists with their number of nodes and a salt that parts the rows of a long list, and a function that gives a table of one or a few
    rows a list a row for each of its salts, to be joined on both. Long are at most 50,000 lists, so which they are is broadcast."""
    counts = written(lists.groupBy("list").agg(F.count("*").alias("nodes")))
    size = max(least, counts.agg(F.coalesce(F.sum("nodes"), F.lit(0))).first()[0] // 50_000)
    long = F.broadcast(counts.where(F.col("nodes") > size).select("list", F.ceil(F.col("nodes") / size).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    spread = lambda facts: facts.join(long, "list", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    salted = lists.join(long, "list", "left").withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int")).drop("_salts")
    return spread, salted.join(spread(counts), ["list", "salt"])


def _block_search(members: DataFrame, spread, percent: int) -> tuple[DataFrame, DataFrame]:
    """Which nodes are searched for in which blocks: asks (node, home, band, chunk) and blocks (node, home, band, chunk).

    A node's home is the longest of its long lists, so the nodes of a list lie in few blocks; bands of sizes, each a
    quarter apart or more, keep out what can't be similar, and chunks bound a block.
    """
    group = members.groupBy("list", "group").agg(F.count("*").alias("k")).groupBy("list").agg(F.max(F.struct("k", "group")).alias("g")).select("list", F.col("g.group").alias("largest"))
    band = F.floor(F.ln("n") / F.ln(F.lit(100.0 / percent)))
    home = members.groupBy("node").agg(F.max(F.struct("nodes", "list")).alias("h"), F.max("n").alias("n"))
    blocks = home.select("node", F.col("h.list").alias("home"), band.alias("band"), F.pmod(F.xxhash64("node"), F.greatest(F.ceil(F.col("h.nodes") / BLOCK), F.lit(1))).alias("chunk"))
    held = members.select("list", "node").join(blocks, "node").select("list", "home", "band", "chunk").distinct()
    queries = members.join(spread(group), ["list", "salt"]).where("group <> largest").select("list", "salt", "node", band.alias("own"))
    asks = queries.join(spread(held), ["list", "salt"]).where(F.abs(F.col("own") - F.col("band")) <= 1).select("node", "home", "band", "chunk").distinct()
    return asks, blocks


def _search_blocks(asks: DataFrame, blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the asking nodes with the nodes of the blocks; each block's index is built once."""
    key = ["home", "band", "chunk"]
    rows = blocks.join(asks.select(*key).distinct(), key, "left_semi").withColumn("kind", F.lit(0)).unionByName(asks.withColumn("kind", F.lit(1)))
    rows = rows.join(sets, "node").select(*key, "kind", "node", "tokens")

    def run(batches):
        now, last, ids, own, index = None, None, [], [], None
        for b in batches:
            out = []
            for home, band, chunk, kind, node, tokens in zip(*(c.to_pylist() for c in b.columns)):
                if (home, band, chunk) != now:
                    now, last, ids, own, index = (home, band, chunk), None, [], [], None
                if (kind, node) == last:  # a set may come from several tasks
                    continue
                last = kind, node
                t = np.frombuffer(tokens, "<u8")
                if kind == 0:
                    ids.append(node)
                    own.append(t)
                    continue
                if index is None:
                    index = BlockIndex(own)
                out += [(node, ids[k]) for k, _ in divide_skip(t, index, percent) if ids[k] != node]
            yield _pairs_batch(out)
        ids, own, index = [], [], None
        release_memory()

    return rows.repartition(*key).sortWithinPartitions(*key, "kind", "node").mapInArrow(run, "a bigint, b bigint")


def _sets(source: DataFrame, size: int) -> DataFrame:
    """The whole sorted set of each text, copies once in a task."""

    def run(batches):
        shingle, seen = Shingler(size), set()
        for b in batches:
            for rows in parts_of_batch(b, b.schema.get_field_index("text")):
                sets = {node_of(t): t for t in shingle.sets(rows.column("text"))}
                new = [k for k in sets if k not in seen]
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([sets[k].tobytes() for k in new], pa.binary())], ["node", "tokens"])
        seen.clear()
        release_memory()

    return source.mapInArrow(run, "node bigint, tokens binary")
