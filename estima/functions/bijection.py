"""Keyed bijections of 0 ... n-1 as column expressions.

A number x < a * b (a and b near the root of n) is a pair (x div b, x mod b). Four Feistel rounds add
to one half, modulo its own size, a mix of the other half and a key: each can be undone, so the
whole is a bijection of 0 ... a*b-1. A value at or beyond n is sent through again (cycle walking)
until it is below; less than a values are beyond, so this is rare and it ends after at most
a*b - n steps. A permutation of all rows is then arithmetic on a rank: no sort and no shuffle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2**31 - 1
#: Walks that are tried: with n rows a value needs k of them with a probability of about n ** (-k / 2).
MOST_WALKS = 40


def keys(name: str) -> list[int]:
    """Offset and factor of each of the four rounds, from the md5 of the key's name."""
    out = []
    for r in range(4):
        h = hashlib.md5(f"{name}|{r}".encode()).hexdigest()
        out += [int(h[:7], 16), int(h[7:14], 16) | 1]
    return out


def sides(n: int) -> tuple[int, int]:
    """a and b: the least square-like rectangle that holds 0 ... n-1."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permuted(rank: Column, n: int, key: Column | Sequence[int]) -> Column:
    """Where ``rank`` (0 ... n-1) goes under ``key`` (an array of the eight numbers of :func:`keys`)."""
    a, b = sides(n)
    k = (lambda i: F.element_at(key, i + 1)) if isinstance(key, Column) else (lambda i: F.lit(int(key[i])).cast("long"))

    def mixed(x: Column, i: int) -> Column:
        return (((x + k(2 * i)) * (x + k(2 * i))) % PRIME * k(2 * i + 1)) % PRIME

    def step(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), x % b
        left = (left + mixed(right, 0)) % a
        right = (right + mixed(left, 1)) % b
        left = (left + mixed(right, 2)) % a
        right = (right + mixed(left, 3)) % b
        return left * b + right

    walks = min(a * b - n, MOST_WALKS)
    first = step(rank.cast("long"))
    if not walks:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), first, lambda x, _: F.when(x >= n, step(x)).otherwise(x))


def permuted_each(rank: Column, n: int, each: Sequence[Sequence[int]]) -> Column:
    """Where ``rank`` goes under each key of ``each``, as an array: :func:`permuted` on whole batches of ranks,
    which sends only the few values beyond n on their walk."""
    a, b = sides(n)
    walks = min(a * b - n, MOST_WALKS)

    def step(x: np.ndarray, k: Sequence[int]) -> np.ndarray:
        mixed = lambda v, i: ((v + k[2 * i]) ** 2 % PRIME * k[2 * i + 1]) % PRIME
        left, right = x // b, x % b
        left = (left + mixed(right, 0)) % a
        right = (right + mixed(left, 1)) % b
        left = (left + mixed(right, 2)) % a
        right = (right + mixed(left, 3)) % b
        return left * b + right

    def to(ranks: pa.Array) -> pa.Array:
        x = np.asarray(ranks.to_numpy(zero_copy_only=False), np.int64)
        out = np.empty((len(x), len(each)), np.int64)
        for j, k in enumerate(each):
            at = step(x, k)
            for _ in range(walks):
                beyond = np.flatnonzero(at >= n)
                if not len(beyond):
                    break
                at[beyond] = step(at[beyond], k)
            out[:, j] = at
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(each), pa.int32()), pa.array(out.ravel()))

    # the annotations tell Spark that whole Arrow arrays come and go
    to.__annotations__ = {"ranks": pa.Array, "return": pa.Array}
    return F.arrow_udf(to, "array<bigint>")(rank.cast("long"))
