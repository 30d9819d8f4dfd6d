"""Seeded draws that depend on row keys alone: the same under any partitioning, and expressible in any SQL dialect."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prime, and factors for the lower 31 bits and for the rest of each key.
PRIME = 2147483647
_LOW = (1540483477, 1812433253, 1566083941, 1181783497)
_HIGH = (668265263, 374761393, 1103515245, 974711)


def draw_sql(seed: int, *keys: str) -> str:
    """A draw from [0, 1) as SQL of up to four integer keys, all of whose bits count.

    Keys and seed are added up as multiples modulo a prime and raised to the fifth power, which maps residues one to one: the
    ids 0 to 2^31 - 2 of a cloud have a draw each. No step leaves 64 bits.
    """
    parts = [f"({k} & {PRIME}) * {_LOW[i]} % {PRIME} + ((({k} >> 31) % {PRIME}) + {PRIME}) * {_HIGH[i]} % {PRIME}" for i, k in enumerate(f"cast({k} as bigint)" for k in keys)]
    x = f"(({' + '.join(parts)} + {(seed + 1) * 1299709 % PRIME}) % {PRIME})"
    square = f"({x} * {x} % {PRIME})"
    return f"(({square} * {square} % {PRIME}) * {x} % {PRIME} / {PRIME}.0)"


def draw(seed: int, *keys: str) -> Column:
    return F.expr(f"cast({draw_sql(seed, *keys)} as double)")


def drawn(seed: int, *keys: np.ndarray) -> np.ndarray:
    """The draws of draw_sql for arrays of integer keys."""
    x = np.full(len(keys[0]), (seed + 1) * 1299709 % PRIME, np.int64)
    for i, k in enumerate(keys):
        x += (k & PRIME) * _LOW[i] % PRIME + (np.fmod(k >> 31, PRIME) + PRIME) * _HIGH[i] % PRIME
    x %= PRIME
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME / float(PRIME)
