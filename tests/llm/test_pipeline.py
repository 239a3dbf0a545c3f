"""The pipeline's stages keep columns, take effect and leave clean documents alone."""

from __future__ import annotations

import collections
import math
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from tallyscope.llm import decontaminate, language
from tallyscope.llm.queries import QUERIES
from tests.llm.test_operators import WORD_BPE, brute_components, brute_weak, encoded, same, windows, words

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(9001, None, None, "s", 0), (9002, "123 456", "en", None, None), (9003, "", "en", "s", 0)]
    awkward = docs.unionByName(spark.createDataFrame(rows, docs.schema)).selectExpr("*", "1 as _lang_score", "doc_id as node")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    told = stages["language"](spark, awkward, FOLDER)
    assert told.columns == awkward.columns and told.count() == docs.count()
    unique = stages["duplicates"](spark, told, FOLDER)
    assert unique.columns == awkward.columns and 0 < unique.count() < docs.count()
    clean = stages["contamination"](spark, unique, FOLDER)
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert clean.count() == decontaminate.decontaminate(unique, bench).where("not contaminated").count() < unique.count()
    hidden = stages["secrets"](spark, clean, FOLDER)
    assert hidden.columns == awkward.columns and hidden.count() == clean.count()
    assert hidden.where("n_chars <> length(text)").count() == 0
    packed = stages["packing"](spark, hidden.select(docs.columns), FOLDER)
    assert packed.select("doc_id").distinct().count() == hidden.count()


def test_every_operator_has_one_query():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted([*(f"op{i}" for i in range(1, 11)), "pipeline"])


def letter_grams(text):
    text = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    return [g for i, c in enumerate(text) if c != " " for g in (text[i - 1 : i + 1], text[i - 1 : i + 2])]


def brute_told(rows):
    """Rows whose language a naive Bayes model on plain counts is sure of."""
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for doc_id, text, lang in rows:
        if lang is not None and zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 3 != 1:
            n[lang] += 1
            counts[lang].update(letter_grams(text))
    total = {k: c.total() + language.SMOOTHING * language.GRAMS for k, c in counts.items()}
    out = []
    for doc_id, text, _ in rows:
        if seen := letter_grams(text):
            logs = [math.log(n[k]) + sum(math.log((counts[k][g] + language.SMOOTHING) / total[k]) for g in seen) for k in n]
            if 1 / sum(math.exp(x - max(logs)) for x in logs) >= 0.5:
                out.append((doc_id, text))
    return out


def brute_redacted(text):
    out, at = "", 0
    for span in filter(None, brute_weak(text).split(",")):
        start, end = map(int, span.split(":")[1:])
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_run_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    base = max((r["text"] for r in docs.limit(50).collect()), key=len)
    made = [base, base + " and a near copy", "The passage: " + bench[0][1], "the user=deploy-user-2024-prod-eu password=Sup3rSecret99 of the house",
            "AKIAABCDEFGH1234 https://b.example/x?Signature=Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5 is in the text", "123 456", "", None]
    rows = [(9000 + i, t, None, "made", None) for i, t in enumerate(made)]
    frame = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = brute_told([(r["doc_id"], r["text"], r["lang"]) for r in frame.collect()])
    least = {i: smallest for i, _, smallest in brute_components(left)}
    left = [row for row in left if least[row[0]] == row[0]]
    known = windows(bench)
    sizes = {len(k) for k in known}
    held = [words(t) for _, t in left]
    left = [row for row, w in zip(left, held) if not any(tuple(w[i : i + n]) in known for n in sizes for i in range(len(w) - n + 1))]
    left = [(i, brute_redacted(t)) for i, t in left]
    assert {9003, 9004} <= {i for i, _ in left} and not {9001, 9002, 9005, 9006, 9007} & {i for i, _ in left}
    want = []
    for doc_id, ids in encoded(left, WORD_BPE):
        for i in range(0, len(ids), 2048):
            part = ids[i : i + 2048]
            want.append((doc_id, i // 2048, i, len(part), zlib.crc32(part.tobytes())))
    same([tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()], want)


def test_stages_keep_the_callers_columns(spark):
    """Columns named like inner ones keep their values and types through the stages that keep columns."""
    names = ["_key", "_spans", "_lang_pred", "_lang_score", "text_key", "node", "row_key", "spans", "lang_pred", "lang_score", "text_key_here"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = [(F.col("doc_id") * 3 + i).cast("int").alias(n) if i % 2 else F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for i, n in enumerate(names)]
    docs = docs.select("*", F.array("doc_id").alias("a.b"), *extra)
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        kept = out.collect()
        assert len(kept) > 100, name
        for r in kept:
            old = before[r["doc_id"]]
            assert all(r[n] == old[n] for n in (*names, "a.b", "lang", "source")), name
