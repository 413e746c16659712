from collections import Counter

import numpy as np
import pytest

from slidelake.llm import neardup

LEAST = 0.9


def pairs_at_the_edge(n, dim, seed):
    """Pairs of unit vectors with cosines about LEAST, some as near to it as rounding gets, their differences spread over few or many dimensions."""
    rng = np.random.default_rng(seed)
    x = neardup.unit(rng.standard_normal((n, dim)))
    way = rng.standard_normal((n, dim)) * (rng.random((n, dim)) < rng.uniform(0.1, 1, (n, 1))) + 1e-9
    way = neardup.unit(way - (way * x).sum(1, keepdims=True) * x)
    cos = LEAST + rng.choice([0, 1e-12, 1e-9, 1e-6, 1e-4, 1e-2, 0.09], n) * rng.choice([-1, 1], n)
    return x, cos[:, None] * x + np.sqrt(1 - cos[:, None] ** 2) * way


@pytest.mark.parametrize("dim", [3, 8, 13, 64, 100])
def test_each_link_once(dim):
    """Whatever block a link is found in first, it is found in one; what is sure is right, and what is not found does not link."""
    x, y = pairs_at_the_edge(400, dim, dim)
    cos = (neardup.unit(x) * neardup.unit(y)).sum(1)
    a, b = neardup.codes(x), neardup.codes(y)
    parts = neardup.splits(dim)
    found = Counter((i, bool(s)) for j in range(len(parts)) for ii, kk, ss in neardup.block_links(a, b, j, parts, LEAST) for i, k, s in zip(ii.tolist(), kk.tolist(), ss.tolist(), strict=True) if i == k)
    assert set(found.values()) == {1} and len({i for i, _ in found}) == len(found)
    assert all(cos[i] >= LEAST for i, s in found if s)
    assert not any(cos[i] >= LEAST for i in set(range(400)) - {i for i, _ in found})
    assert sum(s for _, s in found) > 30


def test_pairs_within_a_side():
    x, y = pairs_at_the_edge(150, 64, 1)
    both = neardup.codes(np.concatenate([x, y]))
    parts = neardup.splits(64)
    within = Counter(tuple(sorted((i, k))) for j in range(len(parts)) for ii, kk, _ in neardup.block_links(both, None, j, parts, LEAST) for i, k in zip(ii.tolist(), kk.tolist(), strict=True))
    cos = neardup.unit(np.concatenate([x, y])) @ neardup.unit(np.concatenate([x, y])).T
    assert set(within.values()) == {1} and {(i, k) for i, k in np.argwhere(cos >= LEAST).tolist() if i < k} <= set(within)


def test_regions_hold_all_that_is_near():
    """Two vectors within reach share a home, or each visits the other's."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((300, 4)), np.zeros((40, 4)), rng.standard_normal((60, 4)) * 0.01])
    r, reach = neardup.Regions(x[::3], 4), 0.4
    at, region, home = r.visits(x, reach)
    homes = dict(zip(at[home].tolist(), region[home].tolist(), strict=True))
    assert len(homes) == home.sum() == len(x)
    seen = set(zip(at.tolist(), region.tolist(), strict=True))
    near = np.argwhere(((x[:, None] - x[None]) ** 2).sum(2) <= reach**2)
    assert all((i, homes[k]) in seen for i, k in near.tolist())


def test_labels_join():
    i, k = np.array([5, 1, 8, 3, 8]), np.array([1, 0, 3, 8, 9])
    assert neardup.joined_labels(np.arange(10), i, k).tolist() == [0, 0, 2, 3, 4, 0, 6, 7, 3, 3]
