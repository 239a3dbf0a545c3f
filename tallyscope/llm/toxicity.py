"""Toxicity: a convolutional text classifier over hashed words, trained in numpy.

A word is the sum of two hashed embeddings, of itself and of its beginning. Filters of one, two and
three words run over the text, the largest value of each filter over the whole text goes, through a
logistic unit, into a chance. The first embedding dimension starts as the log-odds of a bucket among
toxic and other texts, and a filter of each width starts by reading it; Adam does the rest. Buckets
seen in fewer than ``LEAST_DOCS`` training texts stay zero, so unknown words don't speak.

Training takes about ``TRAIN_ROWS`` labelled rows, chosen by a hash of the id, with texts of up to
``TRAIN_BYTES`` bytes; their word numbers reach the driver. Thresholds are calibrated by language on a
part of these rows kept from the training; the language is read off the text's function words, never off a
column. A score is the chance bent so that its language's threshold becomes 0.5.

Scoring broadcasts the product of embeddings and filters (a fixed size) and takes whole texts, long
ones in overlapping slices. Null and empty texts have the score of no words. Repeated rows and null
ids are scored row by row; without labels every score is 0. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import documents, fraction_of, held_out, ship, text_bytes
from tallyscope.llm.decontaminate import FOLD

BUCKETS = 1 << 15
EMBEDDING = 12
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIX = 5
LEAST_DOCS = 3
TRAIN_ROWS = 12_000
TRAIN_BYTES = 24_000
EPOCHS = 5
BATCH = 64
RATE = 0.01
DECAY = 1e-4
#: Words scored at a time; also the length of a long text's slices.
BLOCK_WORDS = 1 << 16
PAD = BUCKETS  # a word that says nothing; two of them part texts

# Function words that tell four languages apart.
LANGUAGE_WORDS = {
    "en": "the of and to in is that was for with as on are by this from",
    "de": "der die das und ist nicht von mit ein eine zu den auf für dem",
    "fr": "le la les des et un une est que qui dans pour par sur avec",
    "es": "el los las y una del por con para se no es al lo su",
}
LANGUAGES = [*LANGUAGE_WORDS, "other"]


class Words(dict):
    """Word -> word bucket, prefix bucket and language, packed into one number."""

    ENTRIES = 500_000
    SPEAKS = {w.encode(): i for i, x in enumerate(LANGUAGE_WORDS.values()) for w in x.split()}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.ENTRIES:
            self.clear()
        own = zlib.crc32(word) % BUCKETS
        start = zlib.crc32(b"^" + word[:PREFIX]) % BUCKETS if len(word) > PREFIX else PAD
        value = self[word] = own | start << 16 | self.SPEAKS.get(word, len(LANGUAGE_WORDS)) << 32
        return value


_words = Words()


def word_numbers(text: bytes) -> np.ndarray:
    """All words of a text, packed."""
    found = text.translate(FOLD).split()
    return np.fromiter(map(_words.__getitem__, found), "i8", len(found))


def language_of(packed: np.ndarray) -> int:
    """Index into LANGUAGES, by function words."""
    counts = np.bincount(packed >> 32, minlength=len(LANGUAGES))[: len(LANGUAGE_WORDS)]
    return int(counts.argmax()) if counts.any() else len(LANGUAGE_WORDS)


def joined(texts: list[np.ndarray], ends_here: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and prefix buckets of texts with three blanks after each, and the bounds of their windows:
    the first window and the one past the last of each text in turn.

    The last window of a text is all blank, so an empty text has one, too, and none reaches into the next
    text. A piece that doesn't end its text stops where the next piece begins.
    """
    gap = np.array([PAD | PAD << 16] * 3)
    packed = np.concatenate([*(x for t in texts for x in (t, gap)), gap])
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum([0, *(sizes[:-1] + 3)])
    ends = starts + sizes + (1 if ends_here is None else np.where(ends_here, 1, -2))
    return packed & 0xFFFF, packed >> 16 & 0xFFFF, np.stack([starts, ends], axis=1).ravel()


def offsets() -> list[tuple[int, int]]:
    return [(w, j) for w in WIDTHS for j in range(w)]


class Network:
    def __init__(self, seed: int = 7):
        random = np.random.default_rng(seed)
        self.embed = np.zeros((BUCKETS + 1, EMBEDDING), "f4")
        self.filters = random.normal(0, 0.3, (len(offsets()), EMBEDDING, FILTERS)).astype("f4")
        self.bias = np.zeros((len(WIDTHS), FILTERS), "f4")
        self.out = random.normal(0, 0.1, (len(WIDTHS), FILTERS)).astype("f4")
        self.base = np.float32(0)
        self.start = random

    def product(self) -> np.ndarray:
        """Embeddings times filters: what scoring needs, a row per bucket."""
        return np.concatenate([self.embed @ f for f in self.filters], axis=1)

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> None:
        n, positive = len(texts), max(1, int(labels.sum()))
        seen = np.zeros((2, BUCKETS + 1))
        for t, y in zip(texts, labels):
            seen[int(y), np.unique(np.concatenate([t & 0xFFFF, t >> 16 & 0xFFFF]))] += 1
        odds = np.log((seen[1] + 0.5) / (positive + 1)) - np.log((seen[0] + 0.5) / (n - positive + 1))
        known = seen.sum(axis=0) >= LEAST_DOCS
        known[PAD] = False
        self.embed[known] = self.start.normal(0, 0.05, (int(known.sum()), EMBEDDING))
        self.embed[known, 0] = np.clip(odds[known] / 2, -2, 2)
        for k, (_, j) in enumerate(offsets()):
            self.filters[k, :, 0] = 0
            self.filters[k, 0, 0] = 1 if j == 0 else 0.5
        self.out[:, 0] = 1
        self.base = np.float32(-2)
        names = ("embed", "filters", "bias", "out", "base")
        moment = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in names}
        step = 0
        for _ in range(epochs):
            order = self.start.permutation(n)
            for at in range(0, n, BATCH):
                chosen = order[at : at + BATCH]
                grads = self.gradients([texts[i] for i in chosen], labels[chosen])
                grads["embed"][~known] = 0
                step += 1
                for k, g in grads.items():
                    first, second = moment[k]
                    first += 0.1 * (g - first)
                    second += 0.001 * (g * g - second)
                    fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    now = getattr(self, k)
                    change = RATE * fix * first / (np.sqrt(second) + 1e-7)
                    setattr(self, k, (now - change - RATE * DECAY * now).astype("f4"))

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        own, begin, bounds = joined(texts)
        x = self.embed[own] + self.embed[begin]
        pooled, at = [], []
        for i, width in enumerate(WIDTHS):
            first = offsets().index((width, 0))
            y = sum(x[j : len(x) - 2 + j] @ self.filters[first + j] for j in range(width)) + self.bias[i]
            top = np.maximum.reduceat(y, bounds, axis=0)[::2]
            where = np.array([y[a:b].argmax(axis=0) + a for a, b in bounds.reshape(-1, 2)])
            pooled.append(np.maximum(top, 0))
            at.append(where)
        hidden = np.stack(pooled, axis=1)  # texts, widths, filters
        z = (hidden * self.out).sum(axis=(1, 2)) + self.base
        off = ((1 / (1 + np.exp(-z)) - labels) / len(texts)).astype("f4")
        grads = {
            "embed": np.zeros_like(self.embed), "filters": np.zeros_like(self.filters), "bias": np.zeros_like(self.bias),
            "out": np.einsum("t,twf->wf", off, hidden), "base": off.sum(),
        }
        for i, width in enumerate(WIDTHS):
            back = off[:, None] * self.out[i] * (hidden[:, i] > 0)  # texts, filters
            grads["bias"][i] = back.sum(axis=0)
            for j in range(width):
                k = offsets().index((width, j))
                spots = at[i] + j
                grads["filters"][k] = np.einsum("tf,tfe->ef", back, x[spots])
                flow = (back[:, :, None] * self.filters[k].T[None]).reshape(-1, EMBEDDING)
                for ids in (own[spots].ravel(), begin[spots].ravel()):
                    np.add.at(grads["embed"], ids, flow)
        return grads


def pieces(packed: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """Slices of a long text, each beginning with the last two words of the one before, and whether it is
    the last."""
    yield packed[:BLOCK_WORDS], len(packed) <= BLOCK_WORDS
    for i in range(BLOCK_WORDS, len(packed), BLOCK_WORDS):
        yield packed[i - 2 : i + BLOCK_WORDS], i + BLOCK_WORDS >= len(packed)


def chances(texts: list[np.ndarray], product: np.ndarray, bias: np.ndarray, out: np.ndarray, base: float) -> np.ndarray:
    """The chance of each text, from the product of embeddings and filters."""
    top = np.zeros((len(texts), len(WIDTHS), FILTERS), "f4")
    block, owners, lasts, size = [], [], [], 0

    def flush() -> None:
        own, begin, bounds = joined(block, lasts)
        y = product[own] + product[begin]
        column = 0
        for i, width in enumerate(WIDTHS):
            total = bias[i] + sum(
                y[j : len(y) - 2 + j, column + j * FILTERS : column + (j + 1) * FILTERS] for j in range(width)
            )
            column += width * FILTERS
            here = np.maximum.reduceat(total, bounds, axis=0)[::2]
            np.maximum.at(top[:, i], owners, here)
        block.clear(), owners.clear(), lasts.clear()

    for i, text in enumerate(texts):
        for part, last in pieces(text):
            block.append(part)
            owners.append(i)
            lasts.append(last)
            size += len(part) + 3
            if size >= BLOCK_WORDS:
                flush()
                size = 0
    if block:
        flush()
    return 1 / (1 + np.exp(-((top * out).sum(axis=(1, 2)) + base).astype("f8")))


def threshold(chance: np.ndarray, labels: np.ndarray) -> float:
    """Between the chances that part the labels with the fewest errors, the middle of the best gap."""
    order = np.argsort(chance, kind="stable")
    c, y = chance[order], labels[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[0], np.cumsum(1 - y[::-1])])[::-1]
    bounds = np.concatenate([[0], c, [1]])
    best = np.flatnonzero(errors == errors.min())
    wide = best[np.argmax(bounds[best + 1] - bounds[best])]
    return float(np.clip((bounds[wide] + bounds[wide + 1]) / 2, 0.1, 0.9))


def bent(chance: np.ndarray, limit: np.ndarray) -> np.ndarray:
    low = 0.5 * chance / limit
    return np.where(chance < limit, np.minimum(low, np.nextafter(0.5, 0)), 0.5 + 0.5 * (chance - limit) / (1 - limit))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple | None:
    """The model as plain arrays, from doc_id, text and toxic; None without both labels."""
    ship(labelled.sparkSession)

    def encode(batches):
        for batch in batches:
            data = [word_numbers(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(data, pa.binary())], names=["doc_id", "toxic", "words"]
            )

    chosen = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), text_bytes().cast("binary").alias("text"))
    chosen = chosen.where(F.octet_length("text") <= TRAIN_BYTES)
    found = chosen.mapInArrow(encode, "doc_id long, toxic int, words binary").toArrow().sort_by("doc_id")
    texts = [np.frombuffer(b, "i8") for b in found["words"].to_pylist()]
    labels = found["toxic"].to_numpy().astype("f4")
    if not 0 < labels.sum() < len(labels):
        return None
    fold = np.array([zlib.crc32(b"fold%d" % (i or 0)) % 4 == 0 for i in found["doc_id"].to_pylist()])
    network = Network()
    network.fit([t for t, f in zip(texts, fold) if not f], labels[~fold])
    parts = (network.product(), network.bias, network.out, float(network.base))
    kept = [t for t, f in zip(texts, fold) if f]
    chance, truth = chances(kept, *parts), labels[fold]
    speaks = np.array([language_of(t) for t in kept])
    whole = threshold(chance, truth) if 0 < truth.sum() < len(truth) else 0.5
    limits = []
    for i in range(len(LANGUAGES)):
        own = truth[speaks == i]
        enough = min(own.sum(), (1 - own).sum()) >= 20
        limits.append(threshold(chance[speaks == i], own) if enough else whole)
    return (*parts, np.array(limits))


def score(docs: DataFrame, model: tuple | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = np.zeros(len(texts))
            for at in range(0, len(texts) if model else 0, 512):
                words = [word_numbers(t) for t in texts[at : at + 512]]
                limit = model[4][[language_of(w) for w in words]]
                scores[at : at + 512] = bent(chances(words, *model[:4]), limit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype("i4"))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 5, 0).alias("held_out"), text_bytes().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def labelled_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The training sample: labels first, so that only their documents' texts move."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id", 5, 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = fraction_of(known, F.col("doc_id"), rows, known.count())
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(sample), "doc_id")  # about ``rows`` rows, whatever the corpus


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(labelled_rows(docs, documents(spark, sf_dir, "labels"))))
