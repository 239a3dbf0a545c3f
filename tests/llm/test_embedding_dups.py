"""Links and components against all cosines."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from tallyscope.llm import embedding_dups as dups

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, cosine=0.93):
    """(vec_id, links, component, kept) of every row, and the number of links."""
    links, parent = collections.Counter(), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    groups = collections.defaultdict(list)
    for r, (_, label, v) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            groups[label, len(v)].append(r)
    for ids in groups.values():
        m = np.array([rows[r][2] for r in ids], float)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= cosine, 1))):
            links.update([ids[a], ids[b]])
            parent[find(ids[a])] = find(ids[b])
    least = {}
    for r, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(r)] = min(least.get(find(r), i), i)
    out = [(i, links[r], least.get(find(r)), i is not None and i == least[find(r)]) for r, (i, _, _) in enumerate(rows)]
    return sorted(out, key=str), sum(links.values()) // 2


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    base, out = rng.normal(size=(300, 20)).round(3), []
    for i in range(900):
        v = (base[rng.integers(40) if i % 3 else rng.integers(300)] + rng.normal(size=20) * rng.choice([0, 0.1, 0.2])).round(3)
        v = v.astype("f4").astype("f8").tolist()
        out.append((i if i % 97 else None, int(rng.integers(3)) if i % 41 else None, v[:13] if i % 50 == 0 else v))
    bad = [None, [], [0.0] * 20, [None] + [1.0] * 19, [float("nan")] * 20, [float("inf")] * 20]
    out += [(5000 + i, 1, v) for i, v in enumerate(bad)]
    out += [(5010, out[1][1], out[1][2])] * 3 + [(5011, 2, [2.0**90] * 20), (5012, 2, [2.0**91] * 20), (5013, 2, [2.0**-90] * 20)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    """Awkward vectors, with columns named like inner ones."""
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as k1", "2 as n", "3 as list", "4 as component").repartition(5)


@pytest.mark.parametrize("how", [{}, {"sigmas": 99.0, "list_rows": 40}, {"list_rows": 40}])
def test_all_links(table, rows, how):
    expected, links = brute(rows)
    got = sorted(map(tuple, dups.near_duplicates(table, **how).collect()), key=str)
    assert links > 1000
    assert got == expected


def test_lists_cut_into_blocks_and_parts(table, rows, monkeypatch):
    monkeypatch.setattr(dups, "BLOCK", 37)
    monkeypatch.setattr(dups, "PART", 50)
    got = sorted(map(tuple, dups.near_duplicates(table, sigmas=99.0, list_rows=100).collect()), key=str)
    assert got == brute(rows)[0]


def test_recall_without_structure(spark):
    """Noise around unrelated vectors: the probes of the default find at least 0.99 of the links."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(400, 64))
    v = (np.repeat(base, 3, axis=0) + rng.normal(size=(1200, 64)) * 0.18).astype("f4").astype("f8")
    rows = [(i, 0, x.tolist()) for i, x in enumerate(v)]
    links = brute(rows)[1]
    got = dups.near_duplicates(spark.createDataFrame(rows, SCHEMA), list_rows=30).collect()
    assert links > 300
    assert sum(r["n_links"] for r in got) / 2 >= 0.99 * links


def test_codes_never_lose_a_near_row():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(600, 24))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    index = dups.Index.fit(rows[:300], 4)
    home, _ = index.probes(rows, 0.5, 99.0, np.full(600, 24))
    codes, error = index.encode(rows - index.centres[home])
    mine = np.flatnonzero(home == 0)
    tables = index.tables(rows - index.centres[0])
    far = sum(tables[:, s][:, codes[mine, s]] for s in range(dups.SUBSPACES))
    true = ((rows[:, None] - rows[mine][None]) ** 2).sum(axis=2)
    assert (np.sqrt(np.maximum(far, 0)) <= np.sqrt(true) + error[mine][None] + 1e-3).all()


def test_empty(table):
    assert dups.near_duplicates(table.limit(0)).collect() == []
    assert [tuple(r) for r in dups.near_duplicates(table.where("vec_id = 5001")).collect()] == [(5001, 0, 5001, True)]
