"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items, one scan of each text."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import keyed, keyed_schema, materialise, release_memory, text_bytes

#: ASCII letters fold to lower case, other ASCII than digits and letters becomes a space, bytes beyond ASCII stay.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words; normalisation keeps every byte in its place, so offsets need no table."""
    return raw.translate(_NORMAL).split()


def windows_of(raw: bytes, size: int) -> list[bytes]:
    w = words_of(raw)
    return [b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []


_automata: dict[str, object] = {}


def _automaton(key: str, items: list[tuple[str, bytes]], size: int):
    """Built once in each Python worker and kept for its later tasks."""
    if key not in _automata:
        import ahocorasick

        found: dict[bytes, set[str]] = {}
        for item, raw in items:
            for w in windows_of(raw, size):
                found.setdefault(w, set()).add(item)
        a = ahocorasick.Automaton()
        for w, ids in found.items():
            a.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(sorted(ids))))
        if found:
            a.make_automaton()
        _automata.clear()
        _automata[key] = (a, len(found))
    return _automata[key]


def _characters(raw: bytes, at: np.ndarray) -> np.ndarray:
    """Character offsets of byte offsets in UTF-8."""
    return np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])[at]


def scan_text(raw: bytes, automaton, n_windows: int) -> tuple[int, int, list[str], list[tuple[str, int, int]]]:
    """Words, words hit, item ids found, and (item, start, end) in characters of the original text."""
    words = words_of(raw)
    if not words or not n_windows:
        return len(words), 0, [], []
    text = " " + b" ".join(words).decode("latin-1") + " "
    hits = list(automaton.iter(text))
    if not hits:
        return len(words), 0, [], []
    spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(spaces, [e for e, _ in hits])  # words before the closing space
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, last - [n for _, (n, _) in hits], 1)
    np.add.at(marks, last, -1)
    covered = np.cumsum(marks)[:-1] > 0
    normal = np.frombuffer(raw.translate(_NORMAL), np.uint8)
    blank = np.isin(normal, (32, 9, 10, 11, 12, 13))
    edge = np.diff(np.concatenate([[1], blank.astype(np.int8), [1]]))
    starts, ends = _characters(raw, np.flatnonzero(edge == -1)), _characters(raw, np.flatnonzero(edge == 1))
    spans: dict[str, list[list[int]]] = {}
    for e, (n, ids) in zip(last, (v for _, v in hits)):
        for i in ids:
            own = spans.setdefault(i, [])
            if own and own[-1][1] >= e - n:
                own[-1][1] = max(own[-1][1], int(e))
            else:
                own.append([int(e - n), int(e)])
    return len(words), int(covered.sum()), sorted(spans), [(i, int(starts[a]), int(ends[b - 1])) for i in sorted(spans) for a, b in spans[i]]


_RESULT = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<item_id:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_benchmark_bytes: int = 8_000_000, key: str = "doc_id") -> DataFrame:
    """Find the benchmark items in every whole text: words, words hit, item ids and spans in the original text.

    The automaton is sent to the executors, so the benchmark's size is measured first; one of over max_benchmark_bytes
    is dealt into parts by item, each scanned by an automaton of its own in a stage of its own; between them the rows, with
    what was found, are written to the shared folder.
    Null texts have no words. Items whose text or id is null take no part; several rows of an item count as one item.
    Rows with a null or repeated doc_id are scanned like others. Other columns are not read. Words hit by several parts
    count once. Another ``key`` than doc_id comes back as it is, such as a struct of all columns.
    """
    sc = docs.sparkSession.sparkContext
    usable = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), text_bytes())
    size = usable.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // max_benchmark_bytes))
    found, schema = keyed(docs, key), keyed_schema(docs, key, _RESULT)
    for part in range(parts):
        own = usable.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else usable
        items = sorted((r[0], bytes(r[1])) for r in own.collect())  # at most about max_benchmark_bytes
        if part:
            found = materialise(found)  # one automaton at a time in a worker
        found = _scan_part(found, schema, sc.broadcast(items), hashlib.sha256(repr((window, items)).encode()).hexdigest(), window, first=part == 0, last=part == parts - 1)
    return found


def _scan_part(source: DataFrame, schema: StructType, sent, digest: str, window: int, first: bool, last: bool) -> DataFrame:
    """Scan by one automaton; between parts the text and what was found travel on in the same row."""
    span = pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    carried = schema.names

    def run(batches):
        automaton, n = _automaton(digest, sent.value, window)
        for b in batches:
            raws = b.column("text").to_pylist()
            rows = [scan_text(r, automaton, n) for r in raws]
            items, spans = [r[2] for r in rows], [[dict(zip(("item_id", "start", "end"), s)) for s in r[3]] for r in rows]
            hit = [r[1] for r in rows]
            if not first:
                items = [sorted({*a, *c}) for a, c in zip(items, b.column("items").to_pylist())]
                spans = [a + c for a, c in zip(spans, b.column("spans").to_pylist())]
                hit = [count_hit(r, s) for r, s in zip(raws, spans)]
            cols = [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(span))]
            names = carried
            if not last:
                cols, names = [*cols, b.column("text")], [*names, "text"]
            yield pa.RecordBatch.from_arrays(cols, names)
        release_memory()

    return source.mapInArrow(run, schema if last else StructType([*schema.fields, StructField("text", BinaryType())]))


def count_hit(raw: bytes, spans: list[dict]) -> int:
    """Words inside any of the spans."""
    text, hit = raw.decode(), set()
    for s in spans:
        before = len(words_of(text[: s["start"]].encode()))
        hit.update(range(before, before + len(words_of(text[s["start"] : s["end"]].encode()))))
    return len(hit)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "spans",
    )
