import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing
from tidemark.llm.tokens import TOKENIZER_FILE, tokenizer


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40)), st.integers(1, 6))
def test_plan_places_every_item_once(histogram, tiers):
    plan = packing.plan_containers(histogram, 50, tiers)
    fill, windows, ranks = defaultdict(int), defaultdict(int), defaultdict(set)
    limits = packing.tier_limits(50, tiers)
    for i, (s, r) in enumerate(zip(plan.size, plan.rank)):
        end = plan.rank[i + 1] if i + 1 < len(plan.size) and plan.size[i + 1] == s else histogram[int(s)]
        for k in range(end - r):
            at = int(plan.container[i]) + k
            fill[at] += int(s)
            windows[at, int(plan.window[i])] += int(s)
            assert int(r) + k not in ranks[int(s)]
            ranks[int(s)].add(int(r) + k)
    assert {s: set(range(n)) for s, n in histogram.items()} == dict(ranks)
    assert sorted(fill) == list(range(plan.containers)) and max(fill.values(), default=0) <= 50
    for first, each, tier, last in zip(plan.first, plan.fill, plan.tier, [*plan.first[1:], plan.containers]):
        assert all(fill[c] == each for c in range(first, last))
        for c in range(first, last):
            own = [n for (at, _), n in windows.items() if at == c]
            assert max(own) <= limits[tier] and len(own) <= 50 // limits[tier]


def test_tiers_have_windows_of_their_own():
    rng = random.Random(1)
    histogram = defaultdict(int)
    for _ in range(20_000):
        histogram[min(2000, int(rng.lognormvariate(5.5, 1.2)) + 1)] += 1
    one, four = (packing.plan_containers(histogram, 2000, tiers) for tiers in (1, 4))
    assert set(one.tier) == {0} and set(four.tier) == {0, 1, 2, 3}
    total = sum(s * n for s, n in histogram.items())
    for plan in (one, four):
        assert 1 - total / (plan.containers * 2000) < 0.005
    inner = four.window[np.isin(four.container, four.first[four.tier == 3])]
    assert set(inner) == set(range(8))
    long = four.size[np.searchsorted(four.first, four.container, "right") - 1 < np.sum(four.tier == 0)]
    assert long.max() > 1000 > 250 > long.min()  # long windows also take items of the shorter tiers


@pytest.mark.parametrize("share_of_one", [0.0, 0.4])
def test_items(spark, share_of_one):
    rng = random.Random(3)
    sizes = {i: 7 if rng.random() < share_of_one else rng.choice([0, None, 100, 101, 250, rng.randint(1, 100), rng.randint(1, 30)]) for i in range(2000)}
    df = spark.createDataFrame([(i, n, 1, "x") for i, n in sizes.items()], "doc_id bigint, n_tokens int, container int, tier string")
    rows = packing.pack(df, capacity=100, group_size=8, salts=4).collect()
    fill, parts, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        parts[r.doc_id].append((r.piece_no, r.n_tokens))
        if r.container is None:
            assert r.n_tokens == 0 and r.step_group is None
        else:
            fill[r.container] += r.n_tokens
            groups[r.step_group].add(r.container)
    for i, n in sizes.items():
        assert sum(x for _, x in parts[i]) == (n or 0) and [p for p, _ in sorted(parts[i])] == list(range(max(1, -(-(n or 0) // 100))))
        assert all(x == 100 for p, x in sorted(parts[i])[:-1])
    assert all(r.unused == (100 - fill[r.container] if r.container is not None else 0) and r.unused >= 0 for r in rows)
    assert sorted(fill) == list(range(len(fill))) and len(fill) <= -(-sum(fill.values()) // 100) * 1.01 + 1
    tier_of = {r.container: r.tier for r in rows if r.container is not None}
    assert max(map(len, groups.values())) <= 8 and all(len({tier_of[c] for c in g}) == 1 for g in groups.values())
    for tier in set(tier_of.values()):
        loads = [sum(fill[c] for c in g) for g in groups.values() if tier_of[next(iter(g))] == tier]
        assert max(loads) - min(loads) <= 100 + 8


def test_texts(spark):
    encode, _ = tokenizer(TOKENIZER_FILE)
    texts = ["", None, "one two three", "word " * 5000, "a", "a", "é" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = packing.pack_texts(df, capacity=2000).collect()
    for i, text in enumerate(texts):
        assert sum(r.n_tokens for r in rows if r.doc_id == i) == len(encode(text or ""))
    assert sum(r.items for r in packing.containers(packing.pack_texts(df)).collect()) == len([r for r in rows if r.n_tokens])


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same")], "doc_id bigint, text string")
    assert packing.pack_texts(df).count() == 2
    assert packing.pack_texts(df.limit(0)).count() == 0
