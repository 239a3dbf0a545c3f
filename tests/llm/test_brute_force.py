"""Operators without SQL against plain loops that share nothing with them but trained arrays."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

from tallyscope.llm import language, packing, shards, toxicity

FOLDER = "/root/testdata/sf0.001"


def plain_chance(packed, embed, filters, bias, out, base):
    """Every window of every width, one after the other; a text is followed by blanks."""
    zero = np.zeros(toxicity.EMBEDDING)
    x = [embed[int(w) & 0xFFFF] + embed[int(w) >> 16 & 0xFFFF] for w in packed] + [zero] * 3
    logit, k = float(base), 0
    for i, width in enumerate(toxicity.WIDTHS):
        best = np.zeros(toxicity.FILTERS)
        for at in range(len(packed) + 1):
            best = np.maximum(best, bias[i] + sum(x[at + j] @ filters[k + j] for j in range(width)))
        k += width
        logit += float(best @ out[i])
    return 1 / (1 + math.exp(-logit))


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_chances_are_those_of_a_plain_convolution(monkeypatch, block):
    network, rng = toxicity.Network(), np.random.default_rng(3)
    network.embed[:-1] = rng.normal(0, 0.4, (toxicity.BUCKETS, toxicity.EMBEDDING))
    network.bias[:] = rng.normal(0, 0.3, network.bias.shape)
    network.out[:] = rng.normal(0, 0.2, network.out.shape)
    texts = [b" ".join(b"word%d" % rng.integers(500) for _ in range(n)) for n in (0, 1, 2, 3, 0, 6, 7, 8, 14, 15, 40, 0)]
    packed = [toxicity.word_numbers(t) for t in texts]
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", block)
    got = toxicity.chances(packed, network.product(), network.bias, network.out, 0.1)
    want = [plain_chance(p, network.embed, network.filters, network.bias, network.out, 0.1) for p in packed]
    assert np.allclose(got, want, atol=1e-5)
    alone = [toxicity.chances([p], network.product(), network.bias, network.out, 0.1)[0] for p in packed]
    assert np.allclose(got, alone, atol=1e-6)


def plain_grams(text):
    """Two- and three-letter grams around each letter; anything else is a blank."""
    chars = [ord(c) if c.isalpha() else 32 for c in f" {text} ".lower()]
    for i, b in enumerate(chars):
        if chr(b).isalpha():
            two = (chars[i - 1] * 0x9E3779B1 + b * 0x85EBCA6B) % 2**32
            for h in (two, (two * 0x27D4EB2F + chars[i + 1] * 0xC2B2AE35 + 1) % 2**32):
                yield ((h ^ h >> 15) * 0x2C1B3C6D) % 2**32 >> 16


def test_language_is_that_of_plain_bayes(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    training = language.training_rows(docs)
    counts, rows = collections.defaultdict(collections.Counter), collections.Counter()
    for r in training.collect():
        rows[r["lang"]] += 1
        counts[r["lang"]].update(plain_grams(r["text"] or ""))
    names, total = sorted(rows), sum(rows.values())
    sizes = {n: sum(counts[n].values()) + language.GRAMS * language.SMOOTHING for n in names}
    odd = [(-1, None, "x"), (-2, "", "x"), (-3, "12 34", "x"), (-4, "der", "x"), (-5, "qu", "x"), (-6, "\u0394\u03b5\u03bd", "x")]
    short = [(-100 - i, r["text"][:3], "x") for i, r in enumerate(docs.where("text is not null").limit(60).collect())]
    frame = docs.unionByName(spark.createDataFrame(odd + short, docs.schema))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(frame, *language.learn(training)).collect()}
    uncertain = 0
    for r in frame.collect():
        grams = list(plain_grams(r["text"] or ""))
        if not grams:
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        logs = [
            math.log(rows[n] / total) + sum(math.log((counts[n][g] + language.SMOOTHING) / sizes[n]) for g in grams)
            for n in names
        ]
        chances = [math.exp(x - max(logs)) for x in logs]
        lang, chance = got[r["doc_id"]]
        uncertain += max(chances) / sum(chances) < 0.99
        assert lang == names[logs.index(max(logs))] and abs(chance - max(chances) / sum(chances)) < 2e-3
    assert uncertain


def test_every_unit_goes_where_the_dot_product_is_highest():
    rng = np.random.default_rng(8)
    for units, count in ((400, 8), (50, 3), (5, 8), (0, 8)):
        vectors = np.floor(rng.lognormal(4, 1.5, (units, 3))) + 1
        where = shards.place(vectors, count)
        totals = vectors.sum(axis=0)
        order = sorted(range(units), key=lambda u: -max(vectors[u] / totals))
        room = [[1 / count] * 3 for _ in range(count)]
        for place, u in enumerate(order):
            share = [float(v / t) for v, t in zip(vectors[u], totals)]
            rest = sum(vectors[v][0] for v in order[place:]) / totals[0]
            gain = [r[0] if rest <= shards.TAIL else sum(a * b for a, b in zip(r, share)) for r in room]
            assert gain[where[u]] >= max(gain) - 1e-12
            room[where[u]] = [a - b for a, b in zip(room[where[u]], share)]


def test_shards_are_those_of_the_placed_units(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    groups, cells = {}, 64
    for r in docs.collect():
        text = r["text"] or ""
        key = hashlib.md5(text.encode()).hexdigest()
        row = groups.setdefault(key, [0, 0, 0])
        for i, n in enumerate((len(text.encode()) + 1, len(re.split(r"[ \t\n\x0b\f\r]+", text.strip(" "))), 1)):
            row[i] += n
    total = [sum(g[i] for g in groups.values()) for i in range(3)]
    assert not any(g[i] * 8 > total[i] for g in groups.values() for i in range(3))  # none is split
    heavy = {k for k, g in groups.items() if any(g[i] > max(1, total[i] / 8 / shards.HEAVY) for i in range(3))}
    light = collections.defaultdict(lambda: [0, 0, 0])
    cell = {k: xxhash.xxh64(k.encode(), seed=42).intdigest() % cells for k in groups}
    for k in groups.keys() - heavy:
        light[cell[k]] = [a + b for a, b in zip(light[cell[k]], groups[k])]
    units = [(k, groups[k]) for k in sorted(heavy)] + [(c, light[c]) for c in sorted(light)]
    where = dict(zip((u for u, _ in units), shards.place(np.array([v for _, v in units], "f8"), 8).tolist()))
    for r in shards.shard_documents(docs, cells=cells).collect():
        assert r["shard"] == where[r["group"] if r["group"] in heavy else cell[r["group"]]]


def test_the_plan_uses_as_few_sequences_as_best_fit_decreasing():
    random.seed(2)
    for most in (40, 13):
        for _ in range(30):
            lengths = [random.randint(1, most) for _ in range(random.randint(1, 200))]
            room = []
            for n in sorted(lengths, reverse=True):
                fits = [i for i, r in enumerate(room) if r >= n]
                if fits:
                    room[min(fits, key=lambda i: room[i])] -= n
                else:
                    room.append(40 - n)
            counts = collections.Counter(lengths)
            table = [tuple(int(v) for v in row) for row in packing.plan(counts, 40)]
            filled = collections.defaultdict(list)
            for at, (n, rank, first, offset) in enumerate(table):
                following = [row[1] for row in table[at + 1 : at + 2] if row[0] == n]
                for k in range((following or [counts[n]])[0] - rank):
                    filled[first + k].append((offset, n))
            assert sorted(n for parts in filled.values() for _, n in parts) == sorted(lengths)
            for parts in filled.values():
                ends = [0, *(o + n for o, n in sorted(parts))]
                assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 40
            assert len(filled) <= len(room) + 1


def test_language_blocks_are_bounded_and_change_nothing(monkeypatch):
    """Blocks of a few grams, over many languages, give what one sum per text gives."""
    rng = np.random.default_rng(4)
    names = [f"l{i:03}" for i in range(300)]
    table = rng.normal(-8, 1, (language.GRAMS + 1, 300)).astype("f4")
    texts = ["", None, "a", "one text of words", "ab " * 700, "123", "ж" * 2000]
    gathered = []
    add = np.add.reduceat
    monkeypatch.setattr(language, "CELLS", 300 * 64)
    monkeypatch.setattr(language, "SLICE", 501)
    fake = type("add", (), {"at": np.add.at, "reduceat": staticmethod(lambda x, *a, **k: gathered.append(x.size) or add(x, *a, **k))})
    monkeypatch.setattr(language, "np", type("numpy", (), {**vars(np), "add": fake}))
    langs, scores = language.score(texts, names, table)
    assert max(gathered) <= 300 * 64
    for text, lang, score in zip(texts, langs, scores):
        ids = [i for part in language.slices(text or "") for i in language.grams(part)]
        sums = table[ids].astype("f8").sum(axis=0) + table[-1]
        best = int(sums.argmax())
        assert lang == (names[best] if ids else "und")
        assert abs(score - (1 / np.exp(sums - sums[best]).sum() if ids else 0)) < 1e-3
