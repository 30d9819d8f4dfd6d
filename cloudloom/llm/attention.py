"""A causal self-attention model of id sequences in numpy: one head, relative position biases, one hidden layer.

Sequences are cut into overlapping windows of ``context`` earlier inputs and ``stride`` positions that are scored, so
each position is scored once, and windows of many sequences go through batched masked attention together.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def initial(inputs: int, class_counts: np.ndarray, context: int, stride: int, width: int = 16, hidden: int = 32, seed: int = 5) -> dict:
    """Parameters; input id ``inputs`` is padding. The output is a softmax over groups of classes and one over a group's members
    (class c is member c % m of group c // m, m about the root of their number); its biases start as the unigram model."""
    rng = np.random.default_rng(seed)
    n = lambda *s, scale: (rng.standard_normal(s) * scale).astype(F32)
    members = int(np.ceil(len(class_counts) ** 0.5))
    groups = -(-len(class_counts) // members)
    p = np.zeros(groups * members)
    p[: len(class_counts)] = np.maximum(class_counts, 0.5)
    p = (p / p.sum()).reshape(groups, members)
    whole = p.sum(axis=1)
    return {
        "E": n(inputs + 1, width, scale=0.3), "Wq": n(width, width, scale=width**-0.5), "Wk": n(width, width, scale=width**-0.5), "Wv": n(width, width, scale=width**-0.5),
        "R": np.zeros(context + stride, F32), "A": n(width, hidden, scale=width**-0.5), "B": n(width, hidden, scale=width**-0.5), "c": np.zeros(hidden, F32),
        "W1": n(hidden, groups, scale=0.05), "b1": np.log(whole).astype(F32), "W2": n(groups, hidden, members, scale=0.05),
        "b2": np.where(p > 0, np.log(np.maximum(p, 1e-30) / whole[:, None]), -1e9).astype(F32),
    }


def windows(lengths: np.ndarray, flat: np.ndarray, pad: int, context: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the sequences that lie one after the other in ``flat``: ids [n, context + stride] and, for each
    sequence position, its place among the n * stride scored places."""
    chunks = -(-lengths // stride)
    room = context + chunks * stride
    begin = np.concatenate([[0], np.cumsum(room)[:-1]])
    padded = np.full(int(room.sum()) + 1, pad, np.int32)
    seq = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    padded[begin[seq] + context + at] = flat
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    which = np.repeat(np.arange(len(lengths)), chunks)
    start = begin[which] + (np.arange(int(chunks.sum())) - first[which]) * stride
    return padded[start[:, None] + np.arange(context + stride)], first[seq] * stride + at


def _allowed(context: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    distance = np.arange(stride)[:, None] + context - np.arange(context + stride)[None, :]
    return distance >= 0, np.maximum(distance, 0)


def _exponentials(logits: np.ndarray, bounded: bool) -> np.ndarray:
    """The logits' exponentials, in place, and their sums [n, 1]; the row's maximum comes off first unless they are bounded."""
    if not bounded:
        logits -= logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    return logits @ np.ones((logits.shape[-1], 1), logits.dtype)


def _low(m: dict) -> bool:
    """Whether the output's exponentials stay within range: what they weigh lies between -1 and 1."""
    one = float((np.abs(m["W1"]).sum(axis=0) + np.abs(m["b1"])).max())
    return max(one, float((np.abs(m["W2"]).sum(axis=1) + np.maximum(m["b2"], 0)).max())) < 60


def _tables(m: dict):
    """What depends on an input id alone: queries (scaled), keys and values."""
    return (m["E"] @ m["Wq"]) * m["E"].dtype.type(m["Wq"].shape[1] ** -0.5), m["E"] @ m["Wk"], m["E"] @ m["Wv"]


def _bounded(m: dict, tables) -> bool:
    """Whether no attention score can be so large that its exponential needs the row's maximum taken off."""
    norm = lambda t: float(np.linalg.norm(t, axis=1).max())
    return norm(tables[0]) * norm(tables[1]) + float(np.abs(m["R"]).max()) < 60


def _attend(tables, ids: np.ndarray, bias: np.ndarray, context: int, pad: int, bounded: bool):
    """Queries, keys, values, unnormalised attention weights, their sums and the weighted mean of the values. Padding before a sequence
    is not seen; that after it comes later than all its places."""
    q, k, v = np.take(tables[0], ids[:, context:], axis=0), np.take(tables[1], ids, axis=0), np.take(tables[2], ids, axis=0)
    s = q @ k.transpose(0, 2, 1)
    s += bias
    gaps = ids[:, :context] == pad
    first = np.flatnonzero(gaps.any(axis=1))
    s[first, :, :context] += np.where(gaps[first], s.dtype.type(-1e9), s.dtype.type(0))[:, None, :]
    total = _exponentials(s, bounded)
    a = s @ v
    a /= total
    return q, k, v, s, total, a


def _by_group(z: np.ndarray, groups: np.ndarray, w2: np.ndarray, b2: np.ndarray):
    """Order of the rows by group, the slices of the groups that occur, and the rows' logits within their groups, in that order."""
    groups = groups.astype(np.int16)  # sorted by digits
    order = np.argsort(groups, kind="stable")
    cut = np.concatenate([[0], np.cumsum(np.bincount(groups, minlength=len(w2)))]).tolist()
    held = [(k, cut[k], cut[k + 1]) for k in range(len(w2)) if cut[k + 1] > cut[k]]
    z = np.take(z, order, axis=0)
    logits = np.empty((len(z), w2.shape[2]), z.dtype)
    for k, a, b in held:
        np.matmul(z[a:b], w2[k], out=logits[a:b])
        logits[a:b] += b2[k]
    return order, held, z, logits


def log_probabilities(m: dict, ids: np.ndarray, targets: np.ndarray, context: int, batch: int = 32) -> np.ndarray:
    """Natural log probability of the target class at every scored place [n * stride]. Attention goes in batches of windows that stay
    in a core's cache, the output in 16 of them."""
    pad, stride, members = len(m["E"]) - 1, ids.shape[1] - context, m["W2"].shape[2]
    tables, direct, low = _tables(m), m["E"] @ m["A"] + m["c"], _low(m)
    ok, distance = _allowed(context, stride)
    bias, bounded = np.where(ok, m["R"][distance], m["R"].dtype.type(-1e9)), _bounded(m, tables)
    out = np.empty(len(ids) * stride, m["E"].dtype)

    def chosen(logits, at):
        own = logits[np.arange(len(at)), at] if low else logits[np.arange(len(at)), at] - logits.max(axis=1)
        return own - np.log(_exponentials(logits, low)[:, 0])

    for start in range(0, len(ids), 16 * batch):
        many = ids[start : start + 16 * batch]
        a = np.empty((len(many), stride, m["Wv"].shape[1]), m["E"].dtype)
        for at in range(0, len(many), batch):
            a[at : at + batch] = _attend(tables, many[at : at + batch], bias, context, pad, bounded)[5]
        z = np.take(direct, many[:, context:].ravel(), axis=0)
        z += a.reshape(-1, a.shape[-1]) @ m["B"]
        np.tanh(z, out=z)
        y = targets[start * stride : (start + len(many)) * stride]
        group, member = y // members, y % members
        logits = z @ m["W1"]
        logits += m["b1"]
        p = chosen(logits, group)
        order, _, _, logits = _by_group(z, group, m["W2"], m["b2"])
        p[order] += chosen(logits, member[order])
        out[start * stride : (start + len(many)) * stride] = p
    return out


def _scatter(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each id."""
    if n < 1 << 15:
        ids = ids.astype(np.int16)  # sorted by digits
    order = np.argsort(ids, kind="stable")
    at = ids[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[at[first]] = np.add.reduceat(np.take(rows, order, axis=0), first, axis=0)
    return out


def gradients(m: dict, ids: np.ndarray, targets: np.ndarray, weight: np.ndarray, context: int) -> tuple[float, dict]:
    """Mean loss over the weighted places, and its gradient."""
    pad, width, (groups, _, members) = len(m["E"]) - 1, m["Wq"].shape[1], m["W2"].shape
    stride = ids.shape[1] - context
    ok, distance = _allowed(context, stride)
    dtype = m["E"].dtype.type
    tables = _tables(m)
    q, k, v, e, sums, a = _attend(tables, ids, np.where(ok, m["R"][distance], dtype(-1e9)), context, pad, _bounded(m, tables))
    flat = lambda t: t.reshape(-1, t.shape[-1])
    now = ids[:, context:].ravel()
    group, member = np.divmod(targets, members)
    share = (weight / max(1.0, float(weight.sum())))[:, None].astype(m["E"].dtype)  # places without weight add nothing
    here = np.arange(len(targets))
    af, low = flat(a), _low(m)
    z = np.take(m["E"] @ m["A"] + m["c"], now, axis=0)
    z += af @ m["B"]
    np.tanh(z, out=z)
    one = z @ m["W1"]
    one += m["b1"]
    one /= _exponentials(one, low)
    order, parts, zs, two = _by_group(z, group, m["W2"], m["b2"])
    two /= _exponentials(two, low)
    member, sorted_share = member[order], share[order]
    loss = -float((np.log(np.maximum(one[here, group], 1e-30)) * share[:, 0]).sum() + (np.log(np.maximum(two[here, member], 1e-30)) * sorted_share[:, 0]).sum())
    one[here, group] -= 1
    one *= share
    two[here, member] -= 1
    two *= sorted_share
    g = {"W1": z.T @ one, "b1": np.ones(len(one), one.dtype) @ one, "W2": np.zeros_like(m["W2"]), "b2": np.zeros_like(m["b2"])}
    dzs = np.empty_like(zs)
    for k_, i, j in parts:
        g["W2"][k_], g["b2"][k_] = zs[i:j].T @ two[i:j], two[i:j].sum(axis=0)
        np.matmul(two[i:j], m["W2"][k_].T, out=dzs[i:j])
    dh = one @ m["W1"].T
    dh[order] += dzs
    z *= z
    np.subtract(1, z, out=z)
    dh *= z
    g["B"], g["c"] = af.T @ dh, np.ones(len(dh), dh.dtype) @ dh
    da = (dh @ m["B"].T).reshape(a.shape)
    da /= sums
    ds = da @ v.transpose(0, 2, 1)
    ds -= (da * a).sum(axis=2, keepdims=True)  # the mean of a row's gradient under its weights
    ds *= e
    g["R"] = np.bincount(distance.ravel(), ds.sum(axis=0).ravel(), len(m["R"])).astype(m["R"].dtype)
    to_all = np.empty((*ids.shape, 2 * width), m["E"].dtype)
    np.matmul(ds.transpose(0, 2, 1), q, out=to_all[:, :, :width])
    np.matmul(e.transpose(0, 2, 1), da, out=to_all[:, :, width:])
    to_all = _scatter(ids.ravel(), flat(to_all), len(m["E"]))
    to_now = np.empty((*a.shape[:2], width + dh.shape[1]), m["E"].dtype)
    np.matmul(ds, k, out=to_now[:, :, :width])
    flat(to_now)[:, width:] = dh
    to_now = _scatter(now, flat(to_now), len(m["E"]))
    queries, direct = to_now[:, :width] * dtype(width**-0.5), to_now[:, width:]
    keys, values = to_all[:, :width], to_all[:, width:]
    g["Wq"], g["Wk"], g["Wv"], g["A"] = (m["E"].T @ d for d in (queries, keys, values, direct))
    g["E"] = queries @ m["Wq"].T + keys @ m["Wk"].T + values @ m["Wv"].T + direct @ m["A"].T
    g["E"][-1] = 0
    return loss, g


class Trainer:
    """Adam on windows that come in parts, so that a task never holds more than a part of what it learns from."""

    def __init__(self, m: dict, context: int, rate: float, batch: int = 64, seed: int = 3):
        self.m = {k: v.copy() for k, v in m.items()}
        self.one, self.two = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
        self.context, self.rate, self.batch, self.rng, self.step = context, rate, batch, np.random.default_rng(seed), 0

    def learn(self, ids: np.ndarray, targets: np.ndarray, weight: np.ndarray, done: float) -> list[float]:
        """One pass over windows; targets and weight are [n * stride]. The rate falls to a tenth as ``done`` rises to 1."""
        losses, order = [], self.rng.permutation(len(ids))
        targets, weight = targets.reshape(len(ids), -1), weight.reshape(len(ids), -1)
        for at in range(0, len(order), self.batch):
            pick = np.sort(order[at : at + self.batch])
            loss, g = gradients(self.m, ids[pick], targets[pick].ravel(), weight[pick].ravel(), self.context)
            losses.append(loss)
            self.step += 1
            lr = self.rate * (1 - 0.9 * min(1.0, done)) * (1 - 0.999**self.step) ** 0.5 / (1 - 0.9**self.step)
            for k, d in g.items():
                one, two = self.one[k], self.two[k]
                one *= F32(0.9)
                one += F32(0.1) * d
                d *= d
                two *= F32(0.999)
                d *= F32(0.001)
                two += d
                np.sqrt(two, out=d)
                d += F32(1e-8)
                np.divide(one, d, out=d)
                d *= F32(lr)
                self.m[k] -= d
        return losses
