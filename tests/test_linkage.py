"""Average linkage: the quick way merges what looking at all pairs each time would."""

import numpy as np
import pytest

from loomgraph.operators import clustering, pairs


def slow(similarity, cut, clusters):
    n = len(similarity)
    d = 1.0 - similarity
    np.fill_diagonal(d, np.inf)
    size, label, left = np.ones(n), np.arange(n), n
    while left > 1:
        i, j = sorted(divmod(int(d.argmin()), n))
        if (clusters is None and d[i, j] > cut) or (clusters is not None and left <= clusters):
            break
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[j] = d[:, j] = np.inf
        d[i, i] = np.inf
        size[i] += size[j]
        label[label == j] = i
        left -= 1
    return label


@pytest.mark.parametrize("clusters", [None, 1, 5])
@pytest.mark.parametrize("steps", [3, 8, 1000])
def test_merges_are_those_of_all_pairs(steps, clusters):
    """Few steps of similarity make many ties."""
    for seed in range(20):
        m = np.random.default_rng(seed).integers(0, steps + 1, (40, 40)) / steps
        m = np.triu(m, 1) + np.triu(m, 1).T
        assert clustering.average_linkage(m, 0.6, clusters).tolist() == slow(m, 0.6, clusters).tolist()


def test_clusters_of_fingerprints(spark, monkeypatch):
    """As from the table of similarities; empty and missing fingerprints are far from all."""
    monkeypatch.setattr(clustering, "ROWS", 7)
    rows = [(c, f"n{k:02d}", None if k == 4 else [] if k == 8 else [(k * x + c) % 11 for x in range(1 + k % 5)]) for c in (1, 2) for k in range(30)]
    v = spark.createDataFrame([*rows, (3, "alone", [1])], "campaign int, name string, fp array<int>")
    v = v.selectExpr("campaign", "name", "fp", "xxhash64(name) AS ord")
    got = clustering.by_fingerprint(v, clusters=5).collect()
    sims = pairs.all_similarities(v).selectExpr("campaign", "source AS u", "target AS v", "sim")
    assert sorted(got) == sorted(clustering.by_similarity(v, sims, clusters=5).collect()) and len(got) == 61
