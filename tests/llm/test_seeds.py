"""Seed masks reach every passage that decontamination promises."""

from itertools import combinations
from math import ceil

import numpy as np
from test_scans import plain_overlaps

from railtempo.llm import decontaminate


def missed(masks, n, substitutions):
    def fits(mask, at, changed):
        return all(c == "0" or at + i not in changed for i, c in enumerate(mask))

    return [s for s in combinations(range(n), substitutions)
            if not any(fits(m, at, s) for m in masks for at in range(n - len(m) + 1))]


def test_masks_hit_every_pattern():
    assert missed(decontaminate.MASKS, 13, 2) == []
    for n in range(5, 31):
        for k in range(min(n - ceil(0.8 * n), 4) + 1):
            assert missed(decontaminate.SHORT, n, k) == []


def test_overlaps_equal_plain_on_random_substitutions(spark):
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(4_000)]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([*range(5, 13), *[13] * 6, 14, 16, 20, 40])]
    docs = []
    for i, text in items:
        for _ in range(40):
            own = text.split()
            changed = rng.choice(len(own), rng.integers(0, max(2, len(own) // 4) + 1), replace=False)
            for at in changed:
                own[at] = f"x{at}"
            around = [list(rng.choice(vocabulary, 20)) if rng.random() < 0.8 else [] for _ in range(2)]
            docs.append((len(docs), " ".join([*around[0], *own, *around[1]])))
    want = plain_overlaps(docs, items)
    found = decontaminate.overlaps(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), ["doc_id"]).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want) > 300
