"""What ``numpy.random.default_rng([key, path])`` draws first, for many paths at once, and Spark's hashes of rows and trees.

Setting up a generator for every node is nearly all of the time that a deep tree takes, and so is an expression over an array of trees
for every row; the numbers here are the same, bit for bit.
"""

from __future__ import annotations

import numpy as np

STEP_HIGH, STEP_LOW = 0x2360ED051FC65DA4, 0x4385DF649FCCF645  # multiplier of the generator (PCG64)


def _seeds(words: list[np.ndarray]) -> list[np.ndarray]:
    """Four numbers of 64 bits from four words of 32, as ``SeedSequence`` mixes them."""
    const = 0x43B0D7E5

    def hashed(v: np.ndarray) -> np.ndarray:
        nonlocal const
        v = v ^ np.uint32(const)
        const = const * 0x931E8875 & 0xFFFFFFFF
        v = v * np.uint32(const)
        return v ^ (v >> np.uint32(16))

    pool = [hashed(w) for w in words]
    for source in range(4):
        for target in range(4):
            if source != target:
                mixed = pool[target] * np.uint32(0xCA01F9DD) - hashed(pool[source]) * np.uint32(0x4973F715)
                pool[target] = mixed ^ (mixed >> np.uint32(16))
    const, out = 0x8B51F9DD, []
    for i in range(8):
        v = pool[i % 4] ^ np.uint32(const)
        const = const * 0x58F38DED & 0xFFFFFFFF
        v = v * np.uint32(const)
        out.append((v ^ (v >> np.uint32(16))).astype("uint64"))
    return [out[i] | out[i + 1] << np.uint64(32) for i in range(0, 8, 2)]


def _plus(high: np.ndarray, low: np.ndarray, other_high: np.ndarray, other_low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = low + other_low
    return high + other_high + (total < low), total


def _step(high: np.ndarray, low: np.ndarray, step: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The next state: 128 bits times the multiplier, plus the stream's step."""
    half, mask = np.uint64(32), np.uint64(0xFFFFFFFF)
    b0, b1 = np.uint64(STEP_LOW & 0xFFFFFFFF), np.uint64(STEP_LOW >> 32)
    a0, a1 = low & mask, low >> half
    first = a1 * b0 + (a0 * b0 >> half)
    second = a0 * b1 + (first & mask)
    carried = a1 * b1 + (first >> half) + (second >> half)
    return _plus(carried + low * np.uint64(STEP_HIGH) + high * np.uint64(STEP_LOW), low * np.uint64(STEP_LOW), *step)


def _output(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    mixed, turn = high ^ low, high >> np.uint64(58)
    return mixed >> turn | mixed << ((np.uint64(64) - turn) & np.uint64(63))


def first_draws(key: int, paths: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``rng.integers(n)`` and then ``rng.random()`` of the generator of each path; ``n`` is 1 or more, paths are positive."""
    paths, n = paths.astype("uint64"), n.astype("uint64")
    if key >> 32:
        same = [np.full(len(paths), w, "uint32") for w in (key & 0xFFFFFFFF, key >> 32)]
        words = [*same, paths.astype("uint32"), (paths >> np.uint64(32)).astype("uint32")]
    else:  # a short key is one word only
        words = [np.full(len(paths), key, "uint32"), paths.astype("uint32"), (paths >> np.uint64(32)).astype("uint32"), np.zeros(len(paths), "uint32")]
    a, b, c, d = _seeds(words)
    step = c << np.uint64(1) | d >> np.uint64(63), d << np.uint64(1) | np.uint64(1)
    state = _step(*_step(*_plus(*step, a, b), step), step)
    one = _output(*state)
    two = _output(*_step(*state, step))
    scaled = (one & np.uint64(0xFFFFFFFF)) * n
    number = (scaled >> np.uint64(32)).astype("int64")
    unit = (np.where(n > 1, two, one) >> np.uint64(11)).astype("float64") * 2.0 ** -53  # a choice of one takes no draw
    # too small a rest is drawn anew, so that all numbers are equally likely: about one path in 2 ** 32 / n
    for i in np.flatnonzero((scaled & np.uint64(0xFFFFFFFF)) < (np.uint64(1 << 32) - n) % n):
        rng = np.random.default_rng([key, int(paths[i])])
        number[i], unit[i] = rng.integers(int(n[i])), rng.random()
    return number, unit


PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _hashed(number: np.ndarray | int, before: np.ndarray) -> np.ndarray:
    """XXH64 of whole numbers onto the hash ``before``, as Spark does it: an int if all fit, else a long."""
    one, two, three, four, five = PRIMES
    number = np.asarray(number, dtype="int64")
    if (abs(number) < 1 << 31).all():
        h = (before + (five + np.uint64(4))) ^ ((number.astype("uint64") & np.uint64(0xFFFFFFFF)) * one)
        h = _turned(h, 23)
        h *= two
        h += three
    else:
        h = (before + (five + np.uint64(8))) ^ (_turned(number.astype("uint64") * two, 31) * one)
        h = _turned(h, 27)
        h *= one
        h += four
    for shift, factor in ((33, two), (29, three), (32, None)):
        h ^= h >> np.uint64(shift)
        if factor is not None:
            h *= factor
    return h


def tree_hashes(keys: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """The 40 low bits of ``xxhash64(key, tree, seed)`` for each of the ``keys`` (given as ``xxhash64(key)``) and the trees from 0."""
    before = keys.astype("int64").view("uint64")[:, None]
    with np.errstate(over="ignore"):
        return (_hashed(seed, _hashed(np.arange(trees), before)) & np.uint64((1 << 40) - 1)).view("int64")
