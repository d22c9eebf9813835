"""Groups of a shard that join late."""

from __future__ import annotations

import numpy as np

from saleroom.llm import simhash


def test_largest_group_joined_late_meets_visitors():
    def bits(*places):
        return sum(1 << p for p in places)

    pairs = iter([bits(a, b) for a in range(32, 64) for b in range(a + 1, 64)])
    far, late, visitor = bits(*range(64)), bits(*range(8)), bits(*range(8, 16))
    fps = [far, late, 0, bits(0, 1, 2, 3), next(pairs), bits(8, 9, 10, 11), *(next(pairs) for _ in range(124)), visitor]
    labels = simhash.grouped(np.array(fps, np.uint64), np.arange(len(fps)) < len(fps) - 1, 4)
    assert len(set(labels[1:].tolist())) == 1 and labels[0] not in labels[1:]
