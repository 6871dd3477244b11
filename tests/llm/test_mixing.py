"""Pfair scheduling in segments against earliest deadline first one slot at a time."""

import heapq

import numpy as np
import pytest

from weftgraph.llm import mixing


def _one_by_one(weights, blocks):
    """(source, block) slot by slot until a source that has run out would be next."""
    total, slot, ran = sum(weights.values()), 0, []
    coming = [(0, s, 0) for s in weights]
    heapq.heapify(coming)
    ready = []
    while True:
        while coming and coming[0][0] <= slot:
            _, s, b = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(b + 1) * total // weights[s]), s, b))
        _, s, b = heapq.heappop(ready)
        if b >= blocks[s]:
            return ran
        ran.append((s, b))
        heapq.heappush(coming, ((b + 1) * total // weights[s], s, b + 1))
        slot += 1


@pytest.mark.parametrize("fan", [3, 64])
def test_unequal_sources_stay_within_a_block(spark, fan):
    sizes = {"a": 8000, "b": 2411, "c": 1203, "d": 301, "e": 97, "f": 3}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(4)
    got = mixing.mix_sources(docs, {s: float(n) for s, n in sizes.items()}, block_docs=1, segment=64, fan=fan).collect()
    assert sorted(r.slot for r in got) == list(range(len(rows)))
    on_target = sorted((r.slot, r.source, r.block) for r in got if r.on_target)
    assert len(on_target) > 10_000
    assert mixing.whole_weights(sizes) == sizes
    assert [x[1:] for x in on_target] == _one_by_one(sizes, sizes)
    ran = np.cumsum(np.array([x[1] for x in on_target])[:, None] == np.array(list(sizes)), axis=0)
    target = np.arange(1, len(ran) + 1)[:, None] * np.array(list(sizes.values()))
    assert np.abs(ran * len(rows) - target).max() < len(rows)  # in blocks: less than one
    late = sorted((r.slot, r.deadline, r.source) for r in got if not r.on_target)
    assert [x[1:] for x in late] == sorted(x[1:] for x in late)


@pytest.mark.parametrize("seed", range(3))
def test_segments_agree_with_one_schedule(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"s{i}": int(n) for i, n in enumerate(rng.integers(1, 400, int(rng.integers(1, 12))))}
    weights = {s: float(rng.choice([1.0, 2.0, 7.5, 90.0])) for s in sizes}
    docs = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    got = mixing.mix_sources(docs, weights, block_docs=1, segment=8, fan=4).filter("on_target").collect()
    whole = mixing.whole_weights(weights)
    assert [(r.source, r.block) for r in sorted(got, key=lambda r: r.slot)] == _one_by_one(whole, sizes)
