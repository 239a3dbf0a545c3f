"""Near-duplicate vectors by product quantisation.

Equal vectors of one label are folded to one with a count. Of the different ones a bounded sample
(``SAMPLE_ROWS``, by hash) fits coarse centres and, on what is left after the nearest centre, a code book for
each of ``SUBSPACES`` parts of a vector. Every vector is listed under its label and nearest centre, with its
codes and the exact length of what the codes leave out. It also goes as a query to the lists of further
centres. In a list, distances are sums of table entries by code (the query stays exact); a listed vector is
left out only where that distance, less its own coding error, is beyond the radius, so codes lose nothing. What
is left is compared by the exact cosine in double precision.

Probes: two vectors closer than the radius r lie on one side of the middle between two centres, or one of
them lies within r / 2 of it. A vector is sent on when it lies within r / 2 * min(1, sigmas / sqrt(dimensions)):
``sigmas`` from sqrt(dimensions) on finds every link, fewer rest on differences that point in no special
direction. Each pair is looked at once.

Lists are as many as keep those of the largest label near ``LIST_ROWS``, bounded by the sample; longer ones
are cut into blocks of index rows and parts of queries, each pair of which is a unit of work, so no task holds
more than a block. Links are counted where they are found, by vector; of the links only a forest leaves a
task, and components are joined on Spark.

Vectors that are null, empty, zero or hold a null or a component that is not finite have no links, nor do
vectors without label. Vectors of different lengths never link. Vectors are known by a 64-bit hash with a second
one behind it. Repeated rows are copies of each other; rows without id count as links, but never name a
component. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import documents, fraction_of, scratch, ship
from tallyscope.llm.components import components

COSINE = 0.93
SIGMAS = 4.0
SAMPLE_ROWS = 16384
LIST_ROWS = 512
#: Sample rows behind a centre, at least.
CENTRE_ROWS = 16
SUBSPACES, CODES = 8, 256
ROUNDS = 8
BLOCK, PART = 2048, 8192
#: Queries whose tables are held at a time; pairs compared at a time.
QUERIES, PAIRS = 256, 1 << 16
SLACK = 1e-4


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)


def k_means(rows: np.ndarray, k: int) -> np.ndarray:
    """Centres after some rounds from evenly spaced rows; a centre without rows stays where it is."""
    if not len(rows):
        return np.zeros((1, rows.shape[1]))
    centres = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)].copy()
    for _ in range(ROUNDS):
        at = nearest(rows, centres)
        sizes = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, rows)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


@dataclass
class Index:
    """Coarse centres (lists, width) and code books (subspaces, codes, width / subspaces)."""

    centres: np.ndarray
    books: np.ndarray

    @classmethod
    def fit(cls, rows: np.ndarray, lists: int) -> Index:
        centres = k_means(rows, lists)
        left = (rows - centres[nearest(rows, centres)]) if len(rows) else rows
        books = [k_means(part, CODES) for part in np.split(left, SUBSPACES, axis=1)]
        return cls(centres, np.stack(books))

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def encode(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the length of what they leave out."""
        parts = np.split(left, SUBSPACES, axis=1)
        codes = np.stack([nearest(p, b) for p, b in zip(parts, self.books)], axis=1)
        told = np.concatenate([b[c] for b, c in zip(self.books, codes.T)], axis=1)
        return codes.astype("u1"), np.sqrt(((left - told) ** 2).sum(axis=1))

    def tables(self, left: np.ndarray) -> np.ndarray:
        """Squared distances from query residuals to each code: (queries, subspaces, codes)."""
        parts = left.reshape(len(left), SUBSPACES, -1)
        cross = np.einsum("qsw,scw->qsc", parts, self.books, optimize=True)
        return ((parts**2).sum(axis=2)[:, :, None] + (self.books**2).sum(axis=2)[None] - 2 * cross).astype("f4")

    def probes(self, rows: np.ndarray, radius: float, sigmas: float, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home list of each row, and which further lists it is sent to: (rows, lists)."""
        far = (self.centres**2).sum(axis=1) - 2 * rows @ self.centres.T
        home = np.argmin(far, axis=1)
        apart = np.sqrt(((self.centres[:, None] - self.centres[None]) ** 2).sum(axis=2)) if len(self.centres) <= 64 else None
        out = np.zeros(far.shape, bool)
        for h in np.unique(home):
            mine = np.flatnonzero(home == h)
            gaps = apart[h] if apart is not None else np.sqrt(((self.centres - self.centres[h]) ** 2).sum(axis=1))
            reach = radius / 2 * np.minimum(1, sigmas / np.sqrt(lengths[mine]))
            out[mine] = far[mine] - far[mine, h][:, None] <= 2 * gaps[None] * reach[:, None]
            out[mine, h] = False
        return home, out


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Unit vectors in double precision, shorter ones filled up with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8")
    out = np.zeros((len(vectors), width))
    out[np.arange(width)[None] < lengths[:, None]] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that no square is out of range
    return out / np.sqrt((out**2).sum(axis=1, keepdims=True))


def listed(index: Index, radius: float, sigmas: float, schema: pa.Schema):
    """Vectors -> a row in their own list and one as a query in each further list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                batch = whole.slice(first, 2048)
                vectors = batch.column("embedding")
                lengths = np.diff(vectors.offsets.to_numpy())
                rows = matrix(vectors, index.width)
                home, sent = index.probes(rows, radius, sigmas, lengths)
                codes, error = index.encode(rows - index.centres[home])
                at, to = np.nonzero(sent)
                n, own = len(rows), np.arange(len(rows))
                take = np.concatenate([own, at])
                none = [None] * len(at)
                further = np.split(to.astype("i4"), np.cumsum(sent.sum(axis=1))[:-1])
                columns = {
                    "label": batch.column("label").take(pa.array(take)), "k1": batch.column("k1").take(pa.array(take)),
                    "k2": batch.column("k2").take(pa.array(take)), "n": batch.column("n").take(pa.array(take)),
                    "embedding": vectors.take(pa.array(take)), "dims": pa.array(lengths[take], pa.int32()),
                    "home": pa.array(home[take], pa.int32()), "list": pa.array(np.concatenate([home, to]), pa.int32()),
                    "query": pa.array(np.arange(len(take)) >= n), "codes": pa.array([c.tobytes() for c in codes] + none, pa.binary()),
                    "error": pa.array(list(error) + none, pa.float64()), "probes": pa.array(further + none, pa.list_(pa.int32())),
                }
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return run


class Block:
    """The index rows of one unit of work, with the links found so far."""

    def __init__(self, index: Index, number: int, batch: pa.RecordBatch, radius: float, cosine: float) -> None:
        self.index, self.centre, self.radius, self.cosine = index, index.centres[number], radius, cosine
        self.rows = matrix(batch.column("embedding"), index.width)
        self.codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), "u1").reshape(-1, SUBSPACES).astype("i8")
        self.limit = (radius + batch.column("error").to_numpy()) ** 2 + SLACK
        self.k1, self.k2, self.n = (batch.column(c).to_numpy() for c in ("k1", "k2", "n"))
        self.sent = np.zeros((len(self.rows), len(index.centres)), bool)
        for i, lists in enumerate(batch.column("probes").to_pylist()):
            self.sent[i, lists] = True
        self.links = np.zeros(len(self.rows), "i8")
        self.group = np.arange(len(self.rows))
        self.edges: list[tuple[int, int]] = []

    def close(self, rows: np.ndarray, keep) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, index row) of these queries with a cosine of the bound and more; ``keep`` says
        which candidates are this unit's to count."""
        for first in range(0, len(rows), QUERIES):
            some = rows[first : first + QUERIES]
            tables = self.index.tables(some - self.centre)
            far = np.zeros((len(some), len(self.rows)), "f4")
            for s in range(SUBSPACES):
                far += tables[:, s].take(self.codes[:, s], axis=1)
            q, x = np.nonzero(far <= self.limit[None])
            mine = keep(q + first, x)
            q, x = q[mine], x[mine]
            for cut in range(0, len(q), PAIRS):
                a, b = q[cut : cut + PAIRS], x[cut : cut + PAIRS]
                near = np.einsum("ij,ij->i", some[a], self.rows[b]) >= self.cosine
                yield a[near] + first, b[near]

    def count(self, k1: np.ndarray, n: np.ndarray, pairs: Iterable[tuple[np.ndarray, np.ndarray]], own: bool = False) -> np.ndarray:
        """Add pairs to the links of both sides; returns those of the queries."""
        links = np.zeros(len(k1), "i8")
        for q, x in pairs:
            np.add.at(links, q, self.n[x])
            np.add.at(self.links, x, n[q])
            if not len(q):
                continue
            starts = np.flatnonzero(np.diff(q, prepend=-1))
            for i, xs in zip(q[starts], np.split(x, starts[1:])):
                self.join(int(k1[i]), xs, int(i) if own else None)
        return links

    def join(self, k1: int, xs: np.ndarray, own: int | None) -> None:
        """An edge for each group of index rows that this query brings together."""
        groups, at = np.unique(self.group[xs], return_index=True)
        if own is not None:
            here = self.group[own]
            at, groups = at[groups != here], np.append(groups[groups != here], here)
        self.edges += [(k1, int(self.k1[xs[i]])) for i in at]
        if len(groups) > 1:
            self.group[np.isin(self.group, groups)] = groups[0]

    def compare_own(self) -> None:
        pairs = self.close(self.rows, lambda q, x: q < x)
        self.links += self.count(self.k1, self.n, pairs, own=True)

    def compare(self, batch: pa.RecordBatch, number: int) -> tuple[np.ndarray, np.ndarray]:
        k1, k2, n, home = (batch.column(c).to_numpy() for c in ("k1", "k2", "n", "home"))

        def keep(q, x):
            # rows that are sent to each other's list meet twice; the lesser one counts the pair
            first = (k1[q] < self.k1[x]) | ((k1[q] == self.k1[x]) & (k2[q] < self.k2[x]))
            return (home[q] == number) | ~self.sent[x, home[q]] | first

        return k1, self.count(k1, n, self.close(matrix(batch.column("embedding"), self.index.width), keep))


def searched(index: Index, radius: float, cosine: float, schema: pa.Schema):
    """Units of work in order, the index rows of each before its queries -> link counts and a forest of links."""

    def results(nodes, links, edges=()) -> pa.RecordBatch:
        some = np.flatnonzero(links)
        a = np.concatenate([nodes[some], np.array([e[0] for e in edges], "i8")])
        b = pa.array([None] * len(some) + [e[1] for e in edges], pa.int64())
        found = pa.array([int(v) for v in links[some]] + [None] * len(edges), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), found, b], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, waiting, block = None, [], None

        def opened(waiting: list) -> Block | None:
            if not waiting:
                return None
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            made = Block(index, rows.column("list")[0].as_py(), rows, radius, cosine)
            if rows.column("part")[0].as_py() == 0:
                made.compare_own()
            return made

        for batch in batches:
            keys = np.array(batch.column("task").to_pylist(), object)
            kinds = batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1), len(keys)]
            for start, stop in zip(edges, edges[1:]):
                if start == stop:
                    continue
                if keys[start] != task:
                    block = block or opened(waiting)
                    if block is not None:
                        yield results(block.k1, block.links, block.edges)
                    task, waiting, block = keys[start], [], None
                piece = batch.slice(start, stop - start)
                if kinds[start] == 0:
                    waiting.append(piece)
                    continue
                block = block or opened(waiting)
                if block is not None:
                    yield results(*block.compare(piece, piece.column("list")[0].as_py()))
        block = block or opened(waiting)
        if block is not None:
            yield results(block.k1, block.links, block.edges)

    return run


def is_usable() -> Column:
    """Whether a row can have links."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def fit(classes: DataFrame, rows: int, lists: int, width: int) -> Index:
    sample = fraction_of(classes, F.col("k1"), SAMPLE_ROWS, rows).select("embedding", "k1").toArrow().sort_by("k1")
    vectors = pa.concat_arrays(sample.column("embedding").chunks) if rows else pa.array([], pa.list_(pa.float32()))
    return Index.fit(matrix(vectors, width) if len(vectors) else np.zeros((0, width)), lists)


def units(rows: DataFrame) -> DataFrame:
    """Rows dealt to units of work: a block of a list's index rows against a part of its queries."""
    where = ["label", "dims", "list"]
    sizes = rows.groupBy(*where).agg(F.count_if(~F.col("query")).alias("listed"), F.count("*").alias("all")).where("listed > 0")
    dealt = rows.join(sizes, where).withColumns({
        "blocks": F.ceil(F.col("listed") / BLOCK).cast("int"), "parts": F.ceil(F.col("all") / PART).cast("int"),
    })
    salt, other = (F.pmod(F.xxhash64("k1", F.lit(seed)), F.col(n)).cast("int") for seed, n in ((5, "blocks"), (7, "parts")))
    dealt = dealt.withColumns({"own_block": salt, "own_part": other})

    def upto(n: Column) -> Column:
        return F.sequence(F.lit(0), n - 1)

    as_index = F.transform(upto(F.col("parts")), lambda p: F.struct(F.col("own_block").alias("block"), p.alias("part"), F.lit(0).alias("kind")))
    blocks = F.filter(upto(F.col("blocks")), lambda b: F.col("query") | (b > F.col("own_block")))
    as_query = F.transform(blocks, lambda b: F.struct(b.alias("block"), F.col("own_part").alias("part"), F.lit(1).alias("kind")))
    places = F.when(F.col("query"), as_query).otherwise(F.concat(as_index, as_query))
    dealt = dealt.withColumn("place", F.explode(places)).select(
        F.concat_ws("/", "dims", "list", "place.block", "place.part", F.col("label").cast("string")).alias("task"),
        "place.kind", "place.part", "list", "home", "k1", "k2", "n", "embedding", "codes", "error", "probes",
    )
    return dealt.repartition("task").sortWithinPartitions("task", "kind")


def near_duplicates(table: DataFrame, cosine: float = COSINE, sigmas: float = SIGMAS, list_rows: int = LIST_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. ``table`` has vec_id, label and embedding."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = table.sparkSession
    ship(spark)
    hashes = [F.xxhash64(F.lit(seed), "label", "embedding").alias(f"k{seed}") for seed in (1, 2)]
    rows = table.where(is_usable()).select("vec_id", "label", "embedding", *hashes)
    classes = scratch(
        rows.groupBy("label", "embedding", "k1", "k2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n")), "vectors"
    )
    by_label = classes.groupBy("label").agg(F.count("*").alias("rows"), F.max(F.size("embedding")).alias("dims"))
    total, largest, dims = by_label.agg(F.sum("rows"), F.max("rows"), F.max("dims")).first()
    width = -(-(dims or 1) // SUBSPACES) * SUBSPACES
    lists = max(1, min(-(-(largest or 0) // list_rows), SAMPLE_ROWS // CENTRE_ROWS))
    index = fit(classes, total or 0, lists, width)
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    kind = dict(classes.dtypes)
    ddl = (
        f"label {kind['label']}, k1 long, k2 long, n long, embedding {kind['embedding']}, dims int, home int, list int, "
        "query boolean, codes binary, error double, probes array<int>"
    )
    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    places = classes.select("label", "k1", "k2", "n", "embedding")
    placed = scratch(places.mapInArrow(listed(index, radius, sigmas, schema), ddl), "lists")
    ddl = "k1 long, links long, other long"
    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    found = scratch(units(placed).mapInArrow(searched(index, radius, cosine, schema), ddl), "links")

    links = found.where("links is not null").groupBy("k1").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("k1").alias("a"), F.col("other").alias("b")))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = classes.select("k1", "k2", "n", "first_id").join(links, "k1", "left").join(roots, F.col("k1") == F.col("node"), "left")
    linked = linked.where("root is not null or n > 1")
    least = linked.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("least"))
    linked = linked.join(least, F.col("root") == F.col("r"), "left").select(
        "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("least", "first_id").alias("component")
    )
    mated = rows.select("vec_id", "k1", "k2").join(linked, ["k1", "k2"], "left").select("vec_id", "links", "component")
    alone = table.where(~is_usable()).select("vec_id", F.lit(None).cast("long").alias("links"), F.lit(None).cast(table.schema["vec_id"].dataType).alias("component"))
    component = F.coalesce("component", "vec_id")
    return mated.unionByName(alone).select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op12_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "embeddings"))
