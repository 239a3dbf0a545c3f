"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every letter gives the bigram it ends and the trigram it is the middle of, with anything but letters
taken as one blank; grams are hashed to ``GRAMS`` slots. Counts come from a bounded sample: of each
language about ``SAMPLE_ROWS`` whole training texts, chosen by a hash of the id. Every language is learned,
``LANGUAGES`` at a time. The log-probability matrix, 262 KB a language, is broadcast. Batches of texts are
scored at once: rows of the matrix are gathered for all grams and summed per text.

A text that is null, empty or without letters is ``und`` with score 0; so is every text when nothing
could be learned. A tie goes to the language first by name. Very long texts are scored slice by slice, and at most ``CELLS``
cells of the matrix are gathered at a time, whatever the number of languages.
Repeated rows and null ids are predicted row by row; a null id counts as the empty text for folds.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.naming import quoted
from tallyscope.llm.common import documents, held_out, plain_names, scratch, ship, unused

GRAMS = 1 << 16
SAMPLE_ROWS = 3000
#: Languages whose counts the driver takes at a time.
LANGUAGES = 64
SMOOTHING = 0.1
#: Matrix cells gathered at a time.
CELLS = 1 << 22
SLICE = 1 << 18
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """Hashed bigrams and trigrams of one slice."""
    codes = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "replace"), "<u4")
    is_letter = letters()[codes]
    codes = np.where(is_letter, codes, np.uint32(32))
    at = np.flatnonzero(is_letter)
    a, b, c = codes[at - 1], codes[at], codes[at + 1]
    two = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)
    three = two * np.uint32(0x27D4EB2F) + c * np.uint32(0xC2B2AE35) + np.uint32(1)
    both = np.concatenate([two, three])
    both ^= both >> np.uint32(15)
    both *= np.uint32(0x2C1B3C6D)
    return (both >> np.uint32(16)).astype("i4")


def slices(text: str) -> Iterable[str]:
    return (text[i : i + SLICE] for i in range(0, len(text), SLICE)) if len(text) > SLICE else (text,)


def learn(training: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and their log-probabilities: (GRAMS + 1, languages), the priors in the last row.

    ``training`` has doc_id, text and lang, the latter never null.
    """
    spark = training.sparkSession
    ship(spark)
    rows = {r["lang"]: r["count"] for r in training.groupBy("lang").count().collect()}
    names = sorted(rows)
    table = np.zeros((GRAMS + 1, len(names)), "f4")
    if not names:
        return [], table
    share = [(n, i, min(1 << 30, int(sample_rows / rows[n] * (1 << 30)))) for i, n in enumerate(names)]
    limits = F.broadcast(spark.createDataFrame(share, "lang string, number long, share long"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    sample = training.where(F.col("text").isNotNull()).join(limits, "lang").where(place < F.col("share"))
    sample = sample.select("number", "text").repartition(16)

    def count(batches):
        totals = {}
        for batch in batches:
            for number, text in zip(*(c.to_pylist() for c in batch.columns)):
                if number not in totals and len(totals) == LANGUAGES:
                    yield from counted(totals)
                    totals.clear()
                into = totals.setdefault(number, np.zeros(GRAMS, "i8"))
                for part in slices(text):
                    into += np.bincount(grams(part), minlength=GRAMS)
        yield from counted(totals)

    summed = sample.mapInArrow(count, "number long, gram long, n long").groupBy("number", "gram").agg(F.sum("n").alias("n"))
    if len(names) > LANGUAGES:
        summed = scratch(summed, "grams")
    for first in range(0, len(names), LANGUAGES):
        block = np.full((GRAMS, min(LANGUAGES, len(names) - first)), SMOOTHING)
        found = summed.where(F.col("number").between(first, first + LANGUAGES - 1)).toArrow()
        block[found["gram"].to_numpy(), found["number"].to_numpy() - first] += found["n"].to_numpy()
        table[:-1, first : first + LANGUAGES] = np.log(block / block.sum(axis=0))
    table[-1] = np.log([rows[n] / sum(rows.values()) for n in names])
    return names, table


def counted(totals: dict[int, np.ndarray]) -> Iterable[pa.RecordBatch]:
    """Numbers of languages, their grams and how often they occur."""
    for number, into in totals.items():
        at = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), number, "i8")), pa.array(at), pa.array(into[at])], names=["number", "gram", "n"]
        )


def score(texts: list[str | None], names: list[str], table: np.ndarray) -> tuple[list[str], list[float]]:
    """Predicted language and its posterior for each text."""
    sums = np.zeros((len(texts), len(names)))
    seen = np.zeros(len(texts), bool)
    block, owners, size = [], [], 0
    most = max(1, CELLS // max(1, len(names)))

    def flush() -> None:
        starts = np.cumsum([0, *map(len, block[:-1])])
        np.add.at(sums, owners, np.add.reduceat(table[np.concatenate(block)], starts, axis=0))
        block.clear(), owners.clear()

    for i, text in enumerate(texts if names else []):
        for part in slices(text or ""):
            ids = grams(part)
            seen[i] |= len(ids) > 0
            # a block has ``most`` grams at most, however long a slice is
            for at in range(0, len(ids), most):
                some = ids[at : at + most]
                if block and size + len(some) > most:
                    flush()
                    size = 0
                block.append(some)
                owners.append(i)
                size += len(some)
    if block:
        flush()
    if not names:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    sums += table[-1]
    sums -= sums.max(axis=1, keepdims=True)
    chances = np.exp(sums)
    chances /= chances.sum(axis=1, keepdims=True)
    best = chances.argmax(axis=1)
    langs = [names[b] if s else UNDETERMINED for b, s in zip(best, seen)]
    return langs, [float(c[b]) if s else 0.0 for c, b, s in zip(chances, best, seen)]


def identify(
    docs: DataFrame, names: list[str], table: np.ndarray, text_column: str = "text", out: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """All columns of ``docs`` with the prediction and its score; columns of these names are replaced."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((names, table))
    kept = [c for c in docs.columns if c.lower() not in out]
    rows, at = docs.select(*(quoted(c) for c in kept)), kept.index(text_column)

    def predict(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            step = max(1, CELLS // max(1, len(sent.value[0])))
            parts = [score(texts[i : i + step], *sent.value) for i in range(0, len(texts), step)]
            langs, scores = ([x for part in parts for x in part[k]] for k in range(2))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*kept, *out],
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"{out[0]} string, {out[1]} double"])
    return plain_names(rows).mapInArrow(predict, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out("doc_id", 3, 1) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")


def accepted(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language could be told."""
    lang, score_ = unused(docs, "lang_pred"), unused(docs, "lang_score")
    told = identify(docs, *model, out=(lang, score_))
    return told.where((F.col(lang) != UNDETERMINED) & (F.col(score_) >= least)).select(*(quoted(c) for c in docs.columns))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(training_rows(docs))
    rows = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text")
    return identify(rows, *model).select("doc_id", "held_out", "lang_pred", "score")
