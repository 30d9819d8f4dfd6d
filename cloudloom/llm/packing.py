"""Best-fit packing of tokenised documents into fixed-length sequences by bin completion.

Only the lengths matter for packing, and there are at most ``max_len`` different ones. So the executors count lengths,
the driver completes bins on that histogram (its size is bounded by ``max_len``, whatever the corpus), and the
executors place every piece by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import deque
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, parts_of_batch, release_memory, split_words, text_bytes

SEPARATOR = 1  # the id that ends each document


@lru_cache(maxsize=2)
def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ChunkEncoder:
    """Encodes texts by their white-space chunks, each distinct chunk once: pre-tokens never span white space.

    Signs after a letter are set apart first, as the tokenizer does, so that a word and the same word before a comma are
    one chunk. ``cache`` maps a chunk to its little-endian ids; it starts anew at ``limit`` entries.
    """

    def __init__(self, path: str, limit: int = 400_000):
        self.tok, self.cache, self.limit = _load(path), {}, limit
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        # texts to encode whole: added tokens, separators that only Python knows, and the one letter whose lower case is two signs
        self.whole = "|".join([*added, "[\x1c-\x1f\u0130]"])

    def _learn(self, new: list[bytes]) -> None:
        for at in range(0, len(new), 2000):
            words = [w.decode() for w in new[at : at + 2000]]
            enc = self.tok.encode(" ".join(words), add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in words])
            first = np.fromiter((a for a, _ in enc.offsets), np.int64, len(enc))
            cut = (np.searchsorted(first, starts) * 4).tolist()
            ids = np.array(enc.ids, "<u4").tobytes()
            self.cache.update((w, ids[cut[k] : cut[k + 1]]) for k, w in enumerate(new[at : at + 2000]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a binary column, and where each text's begin in them (and the last one's end)."""
        texts = pc.ascii_lower(texts.cast(pa.string()))
        whole = np.flatnonzero(pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False))
        apart = [np.array(self.tok.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4") for k in whole.tolist()]
        if len(whole):
            texts = pc.replace_with_mask(texts, pa.array(np.isin(np.arange(len(texts)), whole)), pa.scalar(""))
        places, chunks, bounds = split_words(pc.replace_substring_regex(texts, _SIGN_AFTER_LETTER, r"\1 \2"))
        found = list(map(self.cache.get, chunks))
        if None in found:
            missing = [k for k, x in enumerate(found) if x is None]
            if len(self.cache) + len(missing) > self.limit:
                self.cache.clear()
            self._learn([chunks[k] for k in missing])
            for k in missing:
                found[k] = self.cache[chunks[k]]
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        each = size[places]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat((np.cumsum(size) - size)[places] - ends[:-1], each) + np.arange(ends[-1])]
        bounds = ends[bounds]
        if len(whole):
            ids = np.insert(ids, np.repeat(bounds[whole], [len(x) for x in apart]), np.concatenate(apart))
            more = np.zeros(len(texts), np.int64)
            more[whole] = [len(x) for x in apart]
            bounds = bounds + np.concatenate([[0], np.cumsum(more)])
        return ids, bounds


#: Letters and signs are pre-tokens of their own, but for an apostrophe, which may begin a contraction.
_SIGN_AFTER_LETTER = r"(\p{L})([!-&(-/:-@\[-`{-~])"


def cut_documents(docs: DataFrame, tokenizer_path: str, max_len: int, keep_ids: bool = False) -> DataFrame:
    """Tokenise whole texts, end each with id 1, cut those longer than max_len: a row for each piece."""

    def run(batches):
        enc = ChunkEncoder(tokenizer_path)
        for batch in batches:
            for part in parts_of_batch(batch, 1):
                ids, bounds = enc.encode(part.column(1))
                ids = np.insert(ids, bounds[1:], SEPARATOR).astype("<u4", copy=False)
                bounds = bounds + np.arange(len(bounds))
                size = np.diff(bounds)
                pieces = -(-size // max_len)
                which = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * max_len
                length = np.minimum(size[which] - start, max_len)
                begin = bounds[which] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist())]
                cols = [part.column(0).take(pa.array(which)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        del enc
        release_memory()

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes()).mapInArrow(run, schema)


# ---------------------------------------------------------------- bin completion on a histogram of lengths


class _Budget:
    """How many probes for fillings the search may still make after its first descent."""

    def __init__(self, probes: int):
        self.left = probes


def fillings(counts: np.ndarray, room: int, budget: _Budget):
    """Undominated fillings of ``room`` by counted lengths, lazily: those that fill it by one, two or three pieces, the longest
    first, then best fit, then every other maximal one in descending order.

    A filling is dominated where one piece, or two, could be exchanged for a longer piece of those left that still goes in:
    what is exchanged stays for later bins. One piece that fills the room dominates all others. Where the room is far
    longer than any piece, the longest pieces go in first.
    """
    head: list[int] = []
    left = counts
    while True:
        top = _longest(left, room)
        if not top or room < 3 * top:
            break
        if left is counts:
            left = counts.copy()
        n = min(int(left[top]), room // top - 2)
        head += [top] * n
        left[top] -= n
        room -= top * n
    if room == 0 or not top:
        yield head
        return
    if left[room]:
        yield [*head, room]
        return
    have = left > 0
    pairs = np.flatnonzero(have[(room + 1) // 2 : room] & have[room // 2 : 0 : -1]) + (room + 1) // 2  # a >= room - a
    pairs = [a for a in pairs[::-1].tolist() if 2 * a != room or left[a] > 1]
    for a in pairs:
        yield [*head, a, room - a]
    known = 2 if pairs else 1  # fillings of so many pieces that leave no room are all given
    if not pairs:
        for a in np.flatnonzero(have[: room - 1])[::-1].tolist():
            if 3 * a < room or budget.left <= 0:
                break
            budget.left -= 1
            r = room - a
            low, high = (r + 1) // 2, min(a, r - 1)
            for b in (np.flatnonzero(have[low : high + 1] & have[r - high : r - low + 1][::-1]) + low)[::-1].tolist():
                three = (a, b, r - b)
                if all(left[x] >= three.count(x) for x in three):
                    known = 3
                    yield [*head, *three]
    spare = left.copy()
    for filling in _descending(spare, room, room, [], budget):
        waste = room - sum(filling)
        if not (waste == 0 and len(filling) <= known) and not _dominated(spare, filling, waste):
            yield [*head, *filling]


def _longest(counts: np.ndarray, most: int) -> int:
    """The longest counted length of at most ``most``, or 0."""
    at = np.flatnonzero(counts[1 : most + 1][::-1])[:1]
    return most - int(at[0]) if len(at) else 0


def _descending(spare: np.ndarray, room: int, most: int, chosen: list[int], budget: _Budget):
    """Maximal fillings of pieces of at most ``most``, the longest first; the first of them is best fit. ``spare`` is what the
    chosen pieces leave."""
    x = _longest(spare, min(room, most))
    if not x:
        if chosen and not _longest(spare, room):  # else a longer piece, passed over, still goes in
            yield list(chosen)
        return
    most_of_it = min(int(spare[x]), room // x)
    for n in range(most_of_it, -1, -1):
        if n < most_of_it:
            if budget.left <= 0:
                return
            budget.left -= 1
        spare[x] -= n
        chosen += [x] * n
        yield from _descending(spare, room - n * x, x - 1, chosen, budget)
        del chosen[len(chosen) - n :]
        spare[x] += n


def _dominated(spare: np.ndarray, filling: list[int], waste: int) -> bool:
    """Whether a longer piece of those left could take the place of one piece, or of two, of the filling."""
    own = sorted(set(filling))
    if waste and any(spare[x + 1 : x + waste + 1].any() for x in own):
        return True
    return any(spare[a + b : a + b + waste + 1].any() for k, a in enumerate(own) for b in own[k:] if a != b or filling.count(a) > 1)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counted lengths: bins alike are kept once, with their number."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by the room they have left
    rooms: list[int] = []
    for x in sorted((k for k, n in histogram.items() if n), reverse=True):
        n = histogram[x]
        while n:
            k = bisect.bisect_left(rooms, x)
            if k == len(rooms):
                fit = min(capacity // x, n)
                bins, rest = (n // fit, n % fit)
                put = [((x,) * fit, bins), ((x,) * rest, 1)] if rest else [((x,) * fit, bins)]
                n = 0
            else:
                room = rooms[k]
                pattern, bins = open_bins[room].pop()
                took = min(n, bins)
                n -= took
                put = [((*pattern, x), took)] + ([(pattern, bins - took)] if bins > took else [])
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(k)
            for pattern, bins in put:
                room = capacity - sum(pattern)
                if room not in open_bins:
                    bisect.insort(rooms, room)
                    open_bins[room] = []
                open_bins[room].append((pattern, bins))
    return [(_counted(pattern), bins) for held in open_bins.values() for pattern, bins in held]


def _counted(filling) -> dict[int, int]:
    return {x: filling.count(x) for x in dict.fromkeys(filling)}


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: for each split length a, pieces over capacity - a are alone, others over half can't
    share, and what pieces from a to half don't fit beside them needs bins of its own."""
    x = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    if not len(x):
        return 0
    n = np.array([histogram[k] for k in x.tolist()], np.int64)
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    a = np.concatenate([[0], x[2 * x <= capacity]])
    half, alone, least = np.searchsorted(x, capacity // 2, "right"), np.searchsorted(x, capacity - a, "right"), np.searchsorted(x, a, "left")
    beside = count[alone] - count[half]
    spare = beside * capacity - (total[alone] - total[half])
    rest = np.maximum(0, -(-(total[half] - total[least] - spare) // capacity))
    return int((count[-1] - count[alone] + beside + rest).max())


def complete_bins(histogram: dict[int, int], capacity: int, probes: int = 100_000) -> list[tuple[dict[int, int], int]]:
    """Pack counted lengths into as few bins as found: [(pieces of each length in a bin, number of such bins)].

    Best fit decreasing is the first incumbent. A descent completes bins around the longest piece left by the first
    undominated filling each; later descents take another filling at one or more places, early places first (limited
    discrepancies), and end where their waste shows that they can't beat the incumbent. The search ends at the lower
    bound, when all is tried, or after ``probes`` of fillings beyond the first descent: it is the one limit, and what it leaves is
    a packing that may have more bins than the least.
    """
    histogram = {x: n for x, n in histogram.items() if n}
    if not histogram:
        return []
    total = sum(x * n for x, n in histogram.items())
    bound = lower_bound(histogram, capacity)
    best = best_fit(histogram, capacity)
    best_bins = sum(n for _, n in best)
    budget = _Budget(probes)

    def descend(turns: tuple[tuple[int, int], ...]):
        """Bins by the first fillings, but for the nth one at the places of ``turns``; how many places were passed; None for bins
        that end early or lack such a filling."""
        counts = np.zeros(capacity + 1, np.int64)
        counts[list(histogram)] = list(histogram.values())
        other, found, bins, waste, top = dict(turns), [], 0, 0, capacity
        while top := _longest(counts, top):
            counts[top] -= 1
            choice = next(islice(fillings(counts, capacity - top, budget), other.get(len(found), 0), None), None)
            counts[top] += 1
            if choice is None:
                return None, len(found)
            pattern = _counted([top, *choice])
            times = min(int(counts[x]) // n for x, n in pattern.items())
            for x, n in pattern.items():
                counts[x] -= n * times
            bins += times
            waste += times * (capacity - sum(x * n for x, n in pattern.items()))
            found.append((pattern, times))
            budget.left -= 1
            if waste > (best_bins - 1) * capacity - total:
                return None, len(found)
        return found, len(found)

    waiting = deque([()])
    while waiting and best_bins > bound and (budget.left > 0 or waiting[0] == ()):
        turns = waiting.popleft()
        found, places = descend(turns)
        if found is not None and sum(n for _, n in found) < best_bins:
            best, best_bins = found, sum(n for _, n in found)
        after = turns[-1][0] + 1 if turns else 0
        if turns and places > turns[-1][0]:
            waiting.append((*turns[:-1], (turns[-1][0], turns[-1][1] + 1)))
        waiting.extend((*turns, (k, 1)) for k in range(after, min(places, after + 1000)))
    return best


def placement(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, first offset), sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in bins:
        offset = 0
        for x, n in pattern.items():
            rows.append((x, used.get(x, 0), sequence, n, offset))
            used[x] = used.get(x, 0) + n * times
            offset += x * n
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = 4096, keep_ids: bool = False, probes: int = 100_000) -> DataFrame:
    """Pack all documents into few sequences of at most max_len tokens; only longer documents are cut.

    Null text counts as empty: one piece, the separator alone. A null doc_id and repeated rows are packed like any
    other row. Columns besides doc_id and text are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = materialise(cut_documents(docs, tokenizer_path, max_len, keep_ids).withColumn("_row", F.monotonically_increasing_id()))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most max_len rows
    plan = spark.sparkContext.broadcast(placement(complete_bins(histogram, max_len, probes)))  # bounded by max_len too

    # rank among the pieces of a length, without gathering a length in one task: rank in a salted bucket + the buckets before
    salts = max(16, sum(histogram.values()) // 20_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("_row")
    ranked = salted.withColumn("rank", F.row_number().over(inside)).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("rank") - 1)

    names = [c for c in pieces.columns if c != "_row"]

    def place(batches):
        rows = plan.value
        key = (rows[:, 0] << 44) + rows[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = rows[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
            nth = rank - at[:, 1]
            sequence, offset = at[:, 2] + nth // at[:, 3], at[:, 4] + nth % at[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes if n != "_row")
    return ranked.select(*names, "rank").mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")
