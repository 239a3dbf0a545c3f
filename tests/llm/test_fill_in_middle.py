"""Cuts against plain slicing, and the round trip from output and form."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tallyscope.llm import fill_in_middle as fim

ODD = [
    (1, None), (2, ""), (3, "a<P>b"), (4, "é😀中" * 3000), (None, "x"), (None, None), (7, "word  and\n" * 3000), (8, "<<S"), (9, "<"),
    (10, "\0a"), (7, "word  and\n" * 3000), (11, "<M"), (12, " \t"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows, with columns named like results."""
    rows = [*ODD, *((i, "é b<" * (i % 7)) for i in range(20, 220))]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as form", "3 as output", "4 as h1", "5 as cut")


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_cuts_by_code_points(odd):
    rows = fim.transform(odd).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    expected = [brute(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_query_hashes_what_is_rebuilt(odd, spark, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    for r in fim.op11_fill_in_middle(spark, str(tmp_path)).collect():
        same = [t for i, t in ODD if i == r["doc_id"]] if r["doc_id"] is None or r["doc_id"] < 20 else ["é b<" * (r["doc_id"] % 7)]
        assert r["restored_sha256"] in {hashlib.sha256((t or "").encode()).hexdigest() for t in same}


@pytest.mark.parametrize("unit", [r"\S+", r"(?s).", r"[^\n]*\n?", "never"])
def test_units_of_a_pattern(odd, unit):
    rows = fim.restore(fim.transform(odd, unit, plain_from=100)).collect()
    for r in rows:
        assert r["restored"] == r["text"]
        starts = [m.start() for m in re.finditer(unit, r["text"])]
        assert r["n"] == len(starts)
        if r["form"] != "plain":
            edges = {0, len(r["text"]), *starts}
            assert {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= edges


def test_every_rank_is_reached():
    random.seed(4)
    text = "".join(random.choice("aé中😀 ") for _ in range(4000))
    data = text.encode()
    draws = range(len(text) + 1)
    assert fim.cut_code_points(data, draws) == [len(text), *draws]
    words = re.compile(r"\S+")
    starts = [m.start() for m in words.finditer(text)]
    got = fim.cut_matches(text, words, range(len(starts) + 1))
    assert got == [len(starts), 0, *starts[1:], len(text)]


@pytest.mark.parametrize("nodes", [0, 1, 3, 4, 5, 64, 1000])
def test_lanes_are_descended_to_the_right_node(nodes):
    widths = np.random.default_rng(nodes).integers(0, 5, (nodes, 2))
    found, sums = fim.SkipList(widths), np.vstack([[0, 0], widths.cumsum(axis=0)])
    for rank in range(found.units + 1):
        node, units, points = found.seek(rank)
        assert (units, points) == tuple(sums[node])
        assert units <= rank and (node == nodes or units + widths[node, 0] > rank)


def test_empty_table(odd):
    assert fim.restore(fim.transform(odd.limit(0))).count() == 0
