"""Language identification by nearest centroids of TF-IDF n-gram vectors, with rejection by distance."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, keyed, keyed_schema, release_memory, text_bytes

DIMENSIONS = 4096
#: ASCII letters fold to lower case, other ASCII becomes a space; bytes beyond ASCII stay as they are.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw)) or (not raw.isascii() and any(c.isalpha() for c in raw.decode()))


def ngram_counts(raw: bytes, out: np.ndarray) -> None:
    """Add the counts of hashed n-grams (1 to 3 bytes, words set off by one space) of the whole text to out."""
    a = np.frombuffer(b" " + b" ".join(raw.translate(_NORMAL).split()) + b" ", np.uint8).astype(np.uint32)
    for h in (a, a[:-1] * 257 + a[1:], (a[:-2] * 257 + a[1:-1]) * 257 + a[2:]):
        out += np.bincount(((h * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64), minlength=DIMENSIONS)


def vectors(raws: list[bytes], idf: np.ndarray | None = None) -> np.ndarray:
    """Row vectors: damped counts times idf, of unit length (zero for an empty text)."""
    x = np.zeros((len(raws), DIMENSIONS), np.float32)
    for k, r in enumerate(raws):
        ngram_counts(r, x[k])
    np.log1p(x, out=x)
    if idf is not None:
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors; starts at spread-out rows."""
    rng = np.random.default_rng(seed)
    c = x[[rng.integers(len(x))]]
    while len(c) < min(k, len(x)):
        far = 1 - (x @ c.T).max(axis=1)
        c = np.vstack([c, x[np.argmax(far * rng.random(len(x)))]])
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.vstack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(labelled: DataFrame, centroids: int = 4, sample: int = 6000, reject_quantile: float = 0.001, slack: float = 0.6) -> dict:
    """Learn idf, centroids and rejection limits from (key, text, lang) rows with a language.

    A bounded sample is used: about ``sample`` rows, shared evenly among the languages and drawn by a hash of key,
    which should be a row's own: rows of a repeated key come together. A language's limit is ``slack`` times the ``reject_quantile`` of its own rows' cosine with their nearest
    centroid, so that what lies far beyond the language's own texts is rejected and plain texts are kept.
    """
    rows = labelled.where("lang is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {"langs": [], "idf": np.ones(DIMENSIONS, np.float32), "centroids": np.zeros((0, DIMENSIONS), np.float32), "owner": np.zeros(0, np.int64), "limits": np.zeros(0)}
    share = max(1, sample // len(counts))
    rate = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, share / n)))
    taken = drawn(rows, "key", rate[F.col("lang")])

    def features(batches):
        for b in batches:
            raws = b.column(1).to_pylist()
            for at in range(0, len(raws), 256):
                x = vectors(raws[at : at + 256])
                held = [np.flatnonzero(r) for r in x]
                cols = [pa.array([k.astype("<u2").tobytes() for k in held], pa.binary()), pa.array([r[k].astype("<f2").tobytes() for r, k in zip(x, held)], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), *cols], ["lang", "ids", "x"])

    got = taken.select("lang", text_bytes()).mapInArrow(features, "lang string, ids binary, x binary").toArrow()  # about ``sample`` rows
    names = got["lang"].to_pylist()
    places = np.zeros(DIMENSIONS)
    for raw in got["ids"]:
        places[np.frombuffer(raw.as_py(), "<u2")] += 1
    idf = (np.log((1 + len(names)) / (1 + places)) + 1).astype(np.float32)
    langs = sorted(set(names))
    cents, owner, limits = [], [], []
    for k, name in enumerate(langs):  # one language's rows at a time are dense
        part = got.filter(pa.array([n == name for n in names]))
        rows_of = sorted(zip(part["ids"].to_pylist(), part["x"].to_pylist()))  # alike for any partitioning
        own = np.zeros((len(rows_of), DIMENSIONS), np.float32)
        for r, (ids, x) in zip(own, rows_of):
            r[np.frombuffer(ids, "<u2")] = np.frombuffer(x, "<f2")
        own *= idf
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
        c = spherical_kmeans(own, centroids)
        cents.append(c)
        owner += [k] * len(c)
        limits.append(slack * float(np.quantile((own @ c.T).max(axis=1), reject_quantile)))
    return {"langs": langs, "idf": idf, "centroids": np.vstack(cents).astype(np.float32), "owner": np.array(owner), "limits": np.array(limits)}


def predict(docs: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score (cosine with the nearest centroid, 0 to 1) and rejected, for every whole text.

    ``und`` with score 0 and rejected: a null text or one without a letter. A text farther from every centroid than its
    language's limit is rejected but keeps its nearest language. Ties go to the language first by name. Without any
    labelled row all predictions are ``und``. Repeated rows and null ids are predicted like others. Another ``key`` than doc_id
    comes back as it is: a struct of all columns carries whole rows through.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: languages x centroids x dimensions

    def run(batches):
        m = sent.value
        for b in batches:
            raws = b.column(1).to_pylist()
            for at in range(0, len(raws), 256):
                part = raws[at : at + 256]
                known = np.array([has_letter(r) for r in part], bool) & bool(m["langs"])
                if m["langs"]:
                    cosine = vectors(part, m["idf"]) @ m["centroids"].T
                    near = cosine.argmax(axis=1)
                    score = np.clip(cosine[np.arange(len(part)), near].astype(float), 0, 1) * known
                    lang = m["owner"][near]
                    names = [m["langs"][k] if ok else "und" for k, ok in zip(lang, known)]
                    rejected = ~known | (score < m["limits"][lang])
                else:
                    score, names, rejected = np.zeros(len(part)), ["und"] * len(part), np.ones(len(part), bool)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(names), pa.array(score), pa.array(rejected)], [key, "lang_pred", "score", "rejected"])
        release_memory()

    return keyed(docs, key).mapInArrow(run, keyed_schema(docs, key, "lang_pred string, score double, rejected boolean"))
