import random

import pytest

from typeharvest.llm import neardup


def planted(rnd, n, changed):
    """Pairs (2k, 2k + 1) of 90 shingles each, of which all but `changed` are shared."""
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(8))
    rows = []
    for k in range(n):
        own = [word() for _ in range(94)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[: 94 - changed] + [word() for _ in range(changed)]))]
    return rows


@pytest.mark.parametrize("percent, changed", [(80, 10), (85, 7)])
def test_recall_of_nodes_that_stay_large_to_the_last_level(spark, frame, monkeypatch, percent, changed):
    monkeypatch.setattr(neardup, "SMALL", 1)
    monkeypatch.setattr(neardup, "HUBS", 0)
    n = 1500
    rows = neardup.near_duplicates(frame(planted(random.Random(5), n, changed)), percent=percent).select("doc_id", "component_id").collect()
    missed = n - sum(r.doc_id % 2 and r.component_id == r.doc_id - 1 for r in rows)
    assert missed <= 1


def test_plan():
    assert all(0 < least <= percent / 100 for percent in (80, 85, 100) for _, least in [neardup.plan(percent)])
    assert neardup.plan(80)[0] > neardup.plan(85)[0]
    with pytest.raises(ValueError):
        neardup.plan(30)
