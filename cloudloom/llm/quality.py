"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of a text.

A text's features x are its hashed words (damped counts of unit length, upper case kept apart), one-hot bins of
structure statistics (lines, symbols, capitals, repetition, word lengths) and of metadata (its size). Its score is
sigmoid(w0 + w.x + sum over pairs <v_i, v_j> x_i x_j); the pairs cost linear time, as half of the square of the sum less
the sum of the squares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, drawn, keyed, keyed_schema, release_memory, stable_hash, text_bytes

WORD_BUCKETS = 1 << 14
STATS, BINS = 12, 10
FEATURES = WORD_BUCKETS + STATS * BINS

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'-"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _bin(value: float) -> int:
    """A share from 0 to 1 to one of BINS bins, finer near 0."""
    return min(BINS - 1, int(np.sqrt(max(0.0, value)) * BINS))


class Featuriser:
    def __init__(self):
        self.memo = Memo(lambda w: stable_hash(w) * 0x9E3779B97F4A7C15 % (1 << 64) >> 50)

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Feature ids and values of the whole text."""
        words = raw.split()
        n = len(words)
        if n:
            h = np.fromiter(map(self.memo.__getitem__, words), np.int64, n)
            ids, counts = np.unique(h, return_counts=True)
            x = np.log1p(counts)
            x = x / np.sqrt((x * x).sum())
            distinct, most, same_next = len(ids) / n, counts.max() / n, float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0
            mean_len = sum(map(len, words)) / n
        else:
            ids, x, distinct, most, same_next, mean_len = np.empty(0, np.int64), np.empty(0), 1.0, 0.0, 0.0, 0.0
        a = np.frombuffer(raw, np.uint8)
        size = max(1, len(a))
        lines = raw.split(b"\n")
        stats = (
            _SYMBOL[a].sum() / size, _UPPER[a].sum() / size, _DIGIT[a].sum() / size, (a >= 128).sum() / size, 1 - distinct, most, same_next,
            min(1.0, mean_len / 20), 1 - len(set(lines)) / len(lines), min(1.0, len(lines) / 400), min(1.0, np.log1p(n) / 12), min(1.0, raw.count(b".") / max(1, n)),
        )
        own = [WORD_BUCKETS + k * BINS + _bin(v) for k, v in enumerate(stats)]
        return np.concatenate([ids, own]), np.concatenate([x, np.full(STATS, 0.5)])


def stacked(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, all values, and where each row starts."""
    starts = np.cumsum([0] + [len(i) for i, _ in rows[:-1]])
    return np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), starts


def logits(model: dict, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """w0 + linear part + pairwise part in time linear in the features."""
    vx = model["v"][ids] * x[:, None]
    total = np.add.reduceat(vx, starts, axis=0)
    squares = np.add.reduceat(vx * vx, starts, axis=0)
    return model["w0"] + np.add.reduceat(model["w"][ids] * x, starts) + 0.5 * (total * total - squares).sum(axis=1)


def train(rows, labels: np.ndarray, rank: int = 6, epochs: int = 6, batch: int = 128, rate: float = 0.08, l2: float = 1e-5, seed: int = 11) -> dict:
    """Fit by mini-batches with AdaGrad steps."""
    rng = np.random.default_rng(seed)
    m = {"w0": 0.0, "w": np.zeros(FEATURES), "v": rng.normal(0, 0.02, (FEATURES, rank))}
    gw, gv, g0 = np.full(FEATURES, 1e-6), np.full((FEATURES, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            ids, x, starts = stacked([rows[k] for k in pick])
            owner = np.repeat(np.arange(len(pick)), np.diff(np.append(starts, len(ids))))
            vx = m["v"][ids] * x[:, None]
            total = np.add.reduceat(vx, starts, axis=0)
            z = m["w0"] + np.add.reduceat(m["w"][ids] * x, starts) + 0.5 * (total * total - np.add.reduceat(vx * vx, starts, axis=0)).sum(axis=1)
            d = (1 / (1 + np.exp(-z)) - labels[pick]) / len(pick)
            dx = d[owner] * x
            uniq, back = np.unique(ids, return_inverse=True)
            w_grad = np.bincount(back, dx, len(uniq)) + l2 * m["w"][uniq]
            pair = dx[:, None] * (total[owner] - vx)
            v_grad = np.stack([np.bincount(back, pair[:, f], len(uniq)) for f in range(rank)], axis=1) + l2 * m["v"][uniq]
            gw[uniq] += w_grad**2
            gv[uniq] += v_grad**2
            g0 += d.sum() ** 2
            m["w"][uniq] -= rate * w_grad / np.sqrt(gw[uniq])
            m["v"][uniq] -= rate * 0.5 * v_grad / np.sqrt(gv[uniq])
            m["w0"] -= rate * d.sum() / np.sqrt(g0)
    return m


def fit(labelled: DataFrame, threshold: float = 0.7, sample: int = 8000) -> dict:
    """Learn from rows (key, text, quality 0 or 1); a bounded sample of about ``sample`` rows is drawn by a hash of key.

    A fifth of the sample is kept out of the fit; on it, the logits are shifted so that ``threshold`` is where the
    better rows part from the worse with the least balanced error.
    """
    rows = labelled.where("quality in (0, 1)")
    n = rows.count()
    taken = drawn(rows, "key", sample / max(1, n))

    def features(batches):
        make = Featuriser()
        for b in batches:
            got = [make(r) for r in b.column(1).to_pylist()]
            cols = [b.column(0), b.column(2), pa.array([i.astype("<i4").tobytes() for i, _ in got], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "quality", "ids", "x"])

    got = taken.select("key", text_bytes(), F.col("quality").cast("int")).mapInArrow(features, "key string, quality int, ids binary, x binary").toArrow().to_pandas()
    got = got.sort_values(["key", "ids"], kind="stable")
    data = [(np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4")) for i, v in zip(got["ids"], got["x"])]  # views, no copies
    y = got["quality"].to_numpy(float)
    shift = float(np.log(threshold / (1 - threshold)))
    if len(set(y)) < 2:  # one class or none: nothing to part
        return {"w0": shift + (0.1 if not len(y) or y[0] == 1 else -0.1), "w": np.zeros(FEATURES), "v": np.zeros((FEATURES, 1)), "threshold": threshold}
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    model = train([d for d, h in zip(data, held) if not h], y[~held])
    z, t = (logits(model, *stacked([d for d, h in zip(data, held) if h])), y[held]) if held.any() else (logits(model, *stacked(data)), y)
    order = np.argsort(z)
    z, t = z[order], t[order]
    # balanced error of the cut below each row: good rows under it, bad rows over it
    error = np.concatenate([[0], np.cumsum(t)]) / t.sum() + (1 - np.concatenate([[0], np.cumsum(1 - t)]) / (1 - t).sum())
    best = np.flatnonzero(error == error.min())
    k = best[len(best) // 2]
    cut = z[0] - 0.1 if k == 0 else z[-1] + 0.1 if k == len(z) else (z[k - 1] + z[k]) / 2
    model["w0"] += shift - cut
    return model | {"threshold": threshold}


def score(docs: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from the threshold on) of every whole text.

    Null counts as the empty text, whose statistics alone are scored. Repeated rows and null ids are scored like
    others; columns besides doc_id and text are not read. Another ``key`` than doc_id comes back as it is, such as a struct of
    all columns.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: FEATURES x rank

    def run(batches):
        m, make = sent.value, Featuriser()
        for b in batches:
            raws = b.column(1).to_pylist()
            for at in range(0, len(raws), 256):
                z = logits(m, *stacked([make(r) for r in raws[at : at + 256]]))
                s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), pa.array(s), pa.array((s >= m["threshold"]).astype(np.int32))], [key, "score", "predicted"])
        make = None
        release_memory()

    return keyed(docs, key).mapInArrow(run, keyed_schema(docs, key, "score double, predicted int"))
