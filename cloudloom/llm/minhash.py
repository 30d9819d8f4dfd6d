"""Near duplicates by fast similarity sketching, banding and exact verification.

1. One pass over the texts: each row's set of word shingles, its 128-bit digest (equal sets form one node) and its sketch.
   In round i every shingle is thrown into one of t bins with a value of i plus a hash; a bin keeps its least value, so what
   an early round has put there stays. Long sets fill all bins in a round or two; round t + b throws all shingles into bin b,
   so after 2 t rounds at most no bin is empty. Two sets agree in a bin with a probability of their similarity J, and the
   number of bins in which they agree is as concentrated around t J as that of t independent minima.
2. Bins are cut into bands; nodes that agree in a band form a list. Counts, smallest nodes and fingerprints of lists are
   aggregated before the shuffle, so no task gathers a long list, and lists of the same nodes become one.
3. Every node of a list is compared with the list's smallest one, on whole sets. Lists that connected components of these
   links don't cover are compared further: pair by pair in short ones, in blocks by inverted lists in long ones.
4. Connected components of the exact links.

With 80 bands of 8 bins a pair with J = 0.80 shares no band with odds of (1 - 0.8^8)^80 = 4e-7; a pair with J = 0.3 shares
one with odds of 0.005.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep_matching, materialise, mix64, parts_of_batch, release_memory, text_bytes
from .jaccard import BLOCK, LONG, BlockIndex, Shingler, _dealt, _pairs_batch, connected_components, divide_skip

BANDS, ROWS = 80, 8
#: Rows of up to 50 bytes each that are broadcast instead of shuffling the sets.
HELD = 200_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def digest_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def sketches(sets: list[np.ndarray], t: int, at_once: int = 100_000) -> np.ndarray:
    """The t bins of each non-empty set: the round in which a bin was filled in the upper bits, the least hash below.

    Rounds are thrown together while few shingles are left, and sets whose bins are all filled leave after that.
    """
    out = np.full((len(sets), t), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    base = np.repeat(np.arange(len(sets)) * t, [len(s) for s in sets])
    i = 0
    while len(tokens) and i < 2 * t:
        rounds = np.arange(i, min(2 * t, i + max(1, at_once // len(tokens))), dtype=np.uint64)[:, None]
        h = mix64(tokens + (rounds * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        bins = np.where(rounds < t, (h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32), rounds - np.minimum(rounds, np.uint64(t))).astype(np.int64)
        np.minimum.at(flat, (bins + base).reshape(-1), (rounds << np.uint64(32) | h & np.uint64(0xFFFFFFFF)).reshape(-1))
        left = np.unique(base) // t
        left = left[(out[left] == _EMPTY).any(axis=1)]
        held = np.isin(base // t, left)
        tokens, base, i = tokens[held], base[held], int(rounds[-1, 0]) + 1
    return out


def bands_of(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of each sketch: equal keys mean equal bins of the same band."""
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return key


def _describe(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, digest, n and bands of each row; no bands for an empty set."""

    def run(batches):
        shingle = Shingler(size)
        for b in batches:
            for part in parts_of_batch(b, 1, 2_000_000):
                sets = shingle.sets(part.column(1))
                n = np.array([len(s) for s in sets], np.int64)
                keys = bands_of(sketches([s for s in sets if len(s)], bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([digest_of(s) for s in sets], pa.binary()), pa.array(n), lists], ["doc_id", "digest", "n", "bands"])
        release_memory()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes()).mapInArrow(run, "doc_id bigint, digest binary, n bigint, bands array<bigint>")


def _sets(source: DataFrame, size: int) -> DataFrame:
    """digest and whole sorted set of each text."""

    def run(batches):
        shingle = Shingler(size)
        for b in batches:
            for rows in parts_of_batch(b, b.schema.get_field_index("text")):
                sets = shingle.sets(rows.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array([digest_of(t) for t in sets], pa.binary()), pa.array([t.tobytes() for t in sets], pa.binary())], ["digest", "tokens"])
        release_memory()

    return source.mapInArrow(run, "digest binary, tokens binary")


def _lists(nodes_bands: DataFrame, keep: Scratch) -> DataFrame:
    """list, node and n of the bands that two or more nodes share; one list for all bands of the same nodes."""
    rows = nodes_bands.select("node", "n", F.explode("bands").alias("key"))
    # most bands are one node's: the count and the least node, unlike a second hash, hardly take room in the shuffle
    keys = rows.groupBy("key").agg(F.count("*").alias("nodes"), F.min("node").alias("least"), F.expr("bit_xor(xxhash64(node))").alias("who")).where("nodes > 1")
    lists = keep(keys.groupBy("nodes", "least", "who").agg(F.min("key").alias("key")).select("key"))
    return keep_matching(rows, lists, "key", lists.count()).select(F.col("key").alias("list"), "node", "n")


class _Forest:
    """Which nodes are connected so far; join says whether a link is news."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        at = x
        while (y := self.up.get(at, at)) != at:
            at = y
        while (y := self.up.get(x, x)) != at:
            self.up[x], x = at, y
        return at

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _search(members: DataFrame, queries: DataFrame, keys: list[str], sets: DataFrame, percent: int, among: bool, most: int = 512, tokens_held: int = 4_000_000) -> DataFrame:
    """Links (a, b) of queries (keys, node) with members (keys, node) of the same group, on whole sets by inverted lists.

    Of the links found in a group only those that connect what wasn't connected there are given, so a group of k nodes
    gives fewer than k. With ``among``, a group has one query; its members come in parts of ``most``, and those that it doesn't
    reach are searched for among themselves. Otherwise a group's members are held while its queries, any number, pass by.
    """
    rows = queries.select(*keys, "node", F.lit(0 if among else 2).alias("kind")).unionByName(members.select(*keys, "node", F.lit(1).alias("kind")))
    few = rows.limit(HELD + 1).count() <= HELD  # then the sets are shuffled once, to the groups
    rows = (F.broadcast(rows) if few else rows).join(sets, "node").select(*keys, "kind", "node", "tokens")

    def run(batches):
        now, query, ids, own, index, forest, out = None, None, [], [], None, _Forest(), []

        def reach(node, tokens):
            found = [k for k, _ in divide_skip(tokens, index, percent)]
            out.extend((node, ids[k]) for k in found if ids[k] != node and forest.join(node, ids[k]))
            return found

        def part():
            nonlocal index
            if own:
                index = BlockIndex(own)
                reached = set(reach(*query)) if query else ()
                for k in range(len(own)) if len(own) > 1 else ():
                    if k not in reached:
                        reach(ids[k], own[k])

        for b in batches:
            for *key, kind, node, tokens in zip(*(c.to_pylist() for c in b.columns)):
                tokens = np.frombuffer(tokens, "<u8")
                full = among and (len(own) >= most or held > tokens_held) if key == now else True
                if full:
                    if among:
                        part()
                    ids, own, index, held = [], [], None, 0
                if key != now:
                    now, query, forest = key, None, _Forest()
                if kind == 0:
                    query = (node, tokens)
                elif kind == 1:
                    ids.append(node)
                    own.append(tokens)
                    held += len(tokens)
                else:
                    index = index or BlockIndex(own)
                    reach(node, tokens)
            yield _pairs_batch(out)
            out.clear()
        if among:
            part()
        yield _pairs_batch(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, "a bigint, b bigint")


def _blocks(members: DataFrame, spread, percent: int) -> tuple[DataFrame, DataFrame]:
    """Which nodes of long lists are searched for in which blocks: asks and blocks, both (node, home, band, chunk).

    A node's home is the longest of its lists; bands of sizes keep out what can't be similar, and chunks bound a block. The
    nodes outside a list's largest group ask the blocks of the homes and bands that its nodes have; homes and bands are made
    distinct before chunks are counted out, so a block is asked for once however many lists lead to it.
    """
    group = members.groupBy("list", "group").agg(F.count("*").alias("k")).groupBy("list").agg(F.max(F.struct("k", "group")).alias("g")).select("list", F.col("g.group").alias("largest"))
    band = F.floor(F.ln("n") / F.ln(F.lit(100.0 / percent)))
    # a node's lists, at most one a band, stay beside its home: no join multiplies them
    home = members.groupBy("node").agg(F.max(F.struct("nodes", "list")).alias("h"), F.max("n").alias("n"), F.collect_list("list").alias("lists"))
    blocks = home.select("node", F.col("h.list").alias("home"), band.alias("band"), F.greatest(F.ceil(F.col("h.nodes") / BLOCK), F.lit(1)).alias("chunks"), "lists")
    held = blocks.select(F.explode("lists").alias("list"), "home", "band", "chunks").distinct()
    queries = members.join(spread(group), ["list", "salt"]).where("group <> largest").select("list", "salt", "node", band.alias("own"))
    asks = queries.join(spread(held), ["list", "salt"]).where(F.abs(F.col("own") - F.col("band")) <= 1).select("node", "home", "band", "chunks").distinct()
    asks = asks.select("node", "home", "band", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"))
    return asks, blocks.select("node", "home", "band", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"))


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id (the smallest doc_id that it reaches by links) and kept.

    A set holds the distinct shingles of ``size`` lower-cased (A-Z) words; a shorter text is one shingle; null or
    wordless texts have an empty set and link with nothing. Rows with equal sets are linked. A null doc_id takes part
    as a text, but is no component's id unless its component has no other (then null, and such rows are kept). Repeated
    rows stay and are kept or not alike. Columns other than doc_id and text are not read. An empty table gives no rows.
    """
    keep = Scratch()
    described = keep(_describe(docs, size, bands, rows).withColumn("row", F.monotonically_increasing_id()))
    nodes = keep(described.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.max("n").alias("n")))
    member = keep(described.select("row", "doc_id", "digest", "n").join(nodes.select("digest", "node"), "digest", "left").select("row", "doc_id", "n", "node"))
    copies = keep(member.where("row <> node").select("row"))
    firsts = keep_matching(described.where("n > 0").select("row", "n", "bands"), copies, "row", copies.count(), "left_anti")
    plain = keep(_lists(firsts.withColumnRenamed("row", "node"), keep))
    groups = _grouped(docs, nodes, plain, size, percent, keep)
    named = groups.groupBy("group").agg(F.min("doc_id").alias("component_id")).join(groups.select("node", "group"), "group")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = member.join(named.select("node", "component_id"), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    out = materialise(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
    keep.clear()
    return out


def _grouped(docs: DataFrame, nodes: DataFrame, plain: DataFrame, size: int, percent: int, keep: Scratch) -> DataFrame:
    """node, doc_id and group of each node: connected by links between nodes of the lists that reach the similarity."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes())
    alike = lambda x, y: (100 * F.col(x) >= percent * F.col(y)) & (100 * F.col(y) >= percent * F.col(x))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The whole sets of the given nodes, from the texts of the rows with their ids."""
        own = keep(nodes.join(wanted.distinct(), "node", "left_semi").select("node", "digest", "doc_id"))
        n = own.count()
        texts = keep_matching(source, own.select("doc_id").distinct(), "doc_id", n)
        if not own.where("doc_id is null").isEmpty():  # nodes of rows without an id are found by their digest alone
            texts = texts.unionByName(source.where("doc_id is null"))
        found = _sets(texts, size)
        sets = keep(found.join(F.broadcast(own) if n <= HELD else own, "digest").select("node", "tokens"))
        return sets.dropDuplicates(["node"]) if sets.count() > n else sets

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b, parts to which a's partners are dealt)."""
        dealt = keep(pairs.select("a", F.col("b").alias("node"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")))
        queries = dealt.select("a", "part", F.col("a").alias("node")).distinct()
        sets = sets_of(dealt.select("node").union(dealt.select("a")))
        return keep(_search(dealt, queries, ["a", "part"], sets, percent, among=True).distinct())

    def regrouped(groups: DataFrame, links: DataFrame) -> DataFrame:
        """groups after links (a, b): the links' groups are connected, not their nodes."""
        name = groups.select("node", "group")
        ends = links.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        comps = connected_components(ends).toDF("group", "to")
        return keep(groups.join(comps, "group", "left").select("node", "doc_id", F.coalesce("to", "group").alias("group")))

    spread, salted = _dealt(plain)
    lists = keep(salted)
    leads = lists.groupBy("list").agg(F.min("node").alias("a"), F.max("nodes").alias("size"))
    sizes = leads.groupBy("a").agg(F.ceil(F.sum("size") / (4 * BLOCK)).cast("int").alias("parts"))  # at most a row for each band and lead
    leads = leads.join(sizes, "a").join(nodes.select(F.col("node").alias("a"), F.col("n").alias("m")), "a").drop("size")
    star = lists.join(spread(leads), ["list", "salt"]).where((F.col("node") != F.col("a")) & alike("m", "n"))
    star = star.select("a", F.col("node").alias("b"), "parts").distinct()
    groups = regrouped(nodes.select("node", "doc_id", F.col("node").alias("group")), verified(star))

    # a node meets its group once, however many lists it is in
    held = lists.groupBy("node").agg(F.first("n").alias("n"), F.collect_list(F.struct("list", "nodes", "salt")).alias("at"))
    tagged = held.join(groups.select("node", "group"), "node").select("node", "n", "group", F.explode("at").alias("at")).select("at.*", "node", "n", "group")
    mixed = tagged.groupBy("list").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("list")
    left = keep(tagged.join(spread(mixed), ["list", "salt"], "left_semi"))
    x, y = (left.where(F.col("nodes") <= LONG).alias(k) for k in "xy")
    pairs = x.join(y, (F.col("x.list") == F.col("y.list")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.group") != F.col("y.group")) & alike("x.n", "y.n"))
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.lit(1).alias("parts")).distinct()
    links = verified(pairs.join(star.select("a", "b"), ["a", "b"], "left_anti"))  # a list's lead is its smallest node
    long = left.where(F.col("nodes") > LONG)
    if not long.isEmpty():
        asks, blocks = (keep(f) for f in _blocks(long, spread, percent))
        key = ["home", "band", "chunk"]
        asked = blocks.join(asks.select(*key).distinct(), key, "left_semi")
        links = links.unionByName(keep(_search(asked, asks, key, sets_of(long.select("node")), percent, among=False)))
    return groups if links.isEmpty() else regrouped(groups, links)
