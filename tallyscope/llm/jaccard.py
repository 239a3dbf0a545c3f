"""N-gram Jaccard join: count vectors of token groups, trees of their boxes, exact verification.

A text's set holds the 64-bit hashes of its distinct five-word shingles. Two sets link when
100 * intersection >= 80 * union; then at most a ninth of both sizes together is in one set only.

1. Shingles are hashed to groups, more of them than two linked sets of a size class can differ in,
   with a margin for empty groups. By the pigeonhole principle linked sets agree wholly in at least
   ``needed`` groups that aren't empty. Each set is listed under the fingerprints of its groups, in its own
   size class and the next (a set with more empty groups than the margin is listed under them as well, so
   nothing is lost). Listings go through one shuffle as packed blocks; fingerprints that a single set has
   are dropped there. A task that meets a fingerprint in more than ``SMALL`` sets of a block already knows
   it is a large one: it leaves ``SMALL`` + 1 of them in the fingerprint's bucket and deals the rest out by
   set. So a bucket gets a bounded number a block, whatever share of the corpus has one fingerprint.
2. Up to ``SMALL`` sets under one fingerprint give their pairs, counted over fingerprints; pairs that share
   fewer groups than linked sets must are dropped, the others compared exactly.
3. Of more sets under one fingerprint, the one that shares most is the pivot, and every other is compared
   with it: this finds nearly all links of a large group of near copies with one comparison each. Where
   the sets under a print still lie in several components, the sets with its pivot are points of counts in
   ``DIMENSIONS`` groups. Trees of boxes over parts of about ``PART`` points are joined: the summed coordinate
   minima of two boxes, then of two points, bound the overlap. Surviving pairs are compared exactly. Pairs
   inside one component are never made, and parts of the largest component never meet each other. Rows
   of one print are joined in ``SALTS`` shares.
4. Components come from the links by large and small stars.

A tree over whole documents would not prune: sets of one size overlap in every low dimension. The
group fingerprints cut the corpus into small exact neighbourhoods, and the trees work inside them.

Texts that are null or without words have no set and link with nothing; fewer than five words give one
shingle. Equal sets are one node from the start, whatever their number. Repeated rows and rows with equal ids
share a component by their texts; a null id never becomes a component's id unless no other is there.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import documents, few_at_a_time, give_back, held, lean, scratch, ship, text_bytes, unused
from tallyscope.llm.components import components

SHINGLE = 5
DIMENSIONS = 256
SMALL = 32
PART = 1000
LEAF = 32
BLOCK_BYTES = 24 << 20
LISTED = 14  # bytes of a listing: 5 of the fingerprint, 8 of the set, 1 of the size class
DEALT = 17  # bytes of a listing that is dealt by its set: 8, 8 and 1
FLUSH = 1 << 18
#: Shares in which the rows of one print are joined.
SALTS = 16
#: Sets whose documents are looked up by a broadcast of this many rows at most; beyond, by a shuffle.
BROADCAST_ROWS = 200_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], "u8")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    ENTRIES = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = WordHashes()


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.lower().split()
    h = np.fromiter(map(_hashes.__getitem__, words), "u8", len(words))
    if len(h) < SHINGLE:
        return mixed((h * _MULTIPLIERS[: len(h)]).sum(keepdims=True, dtype="u8") + np.uint64(len(h))) if len(h) else h
    total = np.zeros(len(h) - SHINGLE + 1, "u8")
    for i in range(SHINGLE):
        total += h[i : len(h) - SHINGLE + 1 + i] * _MULTIPLIERS[i]
    return np.unique(mixed(total))


def node_of(items: np.ndarray) -> int:
    """The number of a set."""
    return int((mixed(items ^ np.uint64(0xA0761D6478BD642F)).sum(dtype="u8") + np.uint64(len(items))).astype("i8"))


def _levels(most: int = 1 << 40) -> np.ndarray:
    """The largest size of each class: two sets that link lie in one class or in neighbours."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, ends[-1] * 5 // 4))
    return np.array(ends)


LEVELS = _levels()


def differing(level: int) -> int:
    """The most elements that two linked sets of this class, or this and the one below, don't share."""
    return int(2 * LEVELS[level] // 9)


def needed(level: int) -> int:
    """The least number of groups that linked sets of a class agree in."""
    return 1 + differing(level) // 10


def groups_of(level: int) -> int:
    return differing(level) + needed(level) + 3 + differing(level) // 10


def listings(items: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Classes, and fingerprints under which a set is listed in each."""
    own, out = int(np.searchsorted(LEVELS, len(items))), []
    weights = mixed(items + np.uint64(0x8EBC6AF09C88C6E3))
    for level in (own, own + 1):
        groups = groups_of(level)
        group = ((items >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)  # rising, as the items are
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        salt = np.uint64(level << 40)
        out.append((level, mixed(np.add.reduceat(weights, starts) ^ mixed(group[starts] + salt))))
        # with so many empty groups, too few of the groups it must share might be others
        if groups - differing(level) - (groups - len(starts)) < needed(level):
            empty = np.setdiff1d(np.arange(groups, dtype="u8"), group[starts])
            out.append((level, mixed(mixed(empty + salt))))
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles and node (null without words) of every row."""
    ship(docs.sparkSession)

    def run(batches):
        held("word hashes", lambda: _hashes)
        for batch in batches:
            sizes, nodes = [], []
            for (text,) in few_at_a_time(batch, 2):
                items = shingles(text)
                sizes.append(len(items))
                nodes.append(node_of(items) if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())],
                names=["doc_id", "text_key", "n_shingles", "node"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_bytes()).alias("text_key"), text_bytes().cast("binary").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, text_key long, n_shingles long, node long")


def shared_listings(docs: DataFrame, total_shingles: int) -> DataFrame:
    """What sets share a fingerprint: pairs (a, b) with the number of small prints they share in a class, and
    (print, a) for the sets under a large one, b then being null."""
    buckets = max(64, total_shingles * 2 // 3 * LISTED // BLOCK_BYTES)

    def block_rows(bucket: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
        """Buckets, and for each its rows of ``parts`` one after the other as bytes."""
        order = np.argsort(bucket, kind="stable")
        bucket, parts = bucket[order], [x[order] for x in parts]
        ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
        blocks, start = [], 0
        for end in ends:
            blocks.append(b"".join(x[start:end].tobytes() for x in parts))
            start = end
        return bucket[ends - 1], blocks

    def packed(prints: list[np.ndarray], nodes: list[int], levels: list[int]) -> pa.RecordBatch:
        p = np.concatenate(prints)
        n, level = (np.repeat(np.array(x, t), [len(y) for y in prints]) for x, t in ((nodes, "<i8"), (levels, "u1")))
        # how often its print came before in this block; a set has a print once
        order = np.argsort(p, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], p[order][1:] != p[order][:-1]]))
        before = np.empty(len(p), "i8")
        before[order] = np.arange(len(p)) - np.repeat(starts, np.diff(np.append(starts, len(p))))
        rest = before > SMALL
        bucket = ((p >> np.uint64(40)) % np.uint64(buckets)).astype("i8")
        low, high = p.astype("<u4"), (p >> np.uint64(32)).astype("u1")
        keys, blocks = block_rows(bucket[~rest], [x[~rest] for x in (low, high, n, level)])
        if rest.any():
            whole = (p & np.uint64((1 << 40) - 1)).astype("<i8") | bucket << 40
            dealt = -1 - (mixed(n.view("u8")) % np.uint64(buckets)).astype("i8")
            more = block_rows(dealt[rest], [x[rest] for x in (whole, n, level)])
            keys, blocks = np.concatenate([keys, more[0]]), blocks + more[1]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    def run(batches):
        held("word hashes", lambda: _hashes)
        for batch in batches:
            prints, nodes, levels, seen, size = [], [], [], set(), 0
            for (text,) in few_at_a_time(batch, 0):
                items = shingles(text)
                if not len(items) or (node := node_of(items)) in seen:
                    continue
                seen.add(node)
                for level, some in listings(items):
                    prints.append(some)
                    nodes.append(node)
                    levels.append(level)
                    size += len(some)
                if size >= FLUSH:
                    yield packed(prints, nodes, levels)
                    prints, nodes, levels, size = [], [], [], 0
            if prints:
                yield packed(prints, nodes, levels)

    def under_large(prints: np.ndarray, levels: np.ndarray, nodes: np.ndarray) -> dict:
        return {
            "print": pa.array(prints), "level": pa.array(levels), "a": pa.array(nodes),
            "b": pa.nulls(len(prints), pa.int64()), "shares": pa.array(np.ones(len(prints), "i8")),
        }

    def dealt_out(blocks: list[bytes]) -> pa.Table:
        """Listings of prints that a block showed to be large."""
        sizes = [len(x) // DEALT for x in blocks]
        prints, nodes = (np.concatenate([np.frombuffer(x, "<i8", k, at * k) for x, k in zip(blocks, sizes)]) for at in (0, 8))
        levels = np.concatenate([np.frombuffer(x, "u1", k, 16 * k) for x, k in zip(blocks, sizes)]).astype("i8")
        order = np.lexsort((nodes, prints))
        prints, nodes, levels = prints[order], nodes[order], levels[order]
        new = np.ones(len(prints), bool)
        new[1:] = (prints[1:] != prints[:-1]) | (nodes[1:] != nodes[:-1])
        return pa.table(under_large(prints[new], levels[new], nodes[new]))

    def shared(table: pa.Table) -> pa.Table:
        give_back()  # what the bucket before this one left
        if table["bucket"][0].as_py() < 0:
            return dealt_out(table["block"].to_pylist())
        low, high, node, level = [], [], [], []
        for block in table["block"].to_pylist():
            k = len(block) // LISTED
            low.append(np.frombuffer(block, "<u4", k))
            high.append(np.frombuffer(block, "u1", k, 4 * k))
            node.append(np.frombuffer(block, "<i8", k, 5 * k))
            level.append(np.frombuffer(block, "u1", k, 13 * k))
        prints = np.concatenate(low).astype("i8") | np.concatenate(high).astype("i8") << 32
        nodes, levels = np.concatenate(node), np.concatenate(level).astype("i8")
        order = np.argsort(prints, kind="stable")
        prints, nodes, levels = prints[order], nodes[order], levels[order]
        starts = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
        several = np.minimum.reduceat(nodes, starts) != np.maximum.reduceat(nodes, starts)
        keep = np.repeat(several, np.diff(np.append(starts, len(prints))))
        bucket = int(table["bucket"][0].as_py())
        prints, nodes, levels = prints[keep], nodes[keep], levels[keep]
        order = np.lexsort((nodes, prints))
        prints, nodes, levels = prints[order], nodes[order], levels[order]
        new = np.ones(len(prints), bool)
        new[1:] = (prints[1:] != prints[:-1]) | (nodes[1:] != nodes[:-1])
        prints, nodes, levels = prints[new], nodes[new], levels[new]
        starts = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])[: len(prints)])
        sizes = np.repeat(np.diff(np.append(starts, len(prints))), np.diff(np.append(starts, len(prints))))
        large, small = sizes > SMALL, sizes <= SMALL
        few = [x[small] for x in (prints, nodes, levels)]
        pairs = []
        for apart in range(1, SMALL):
            same = few[0][apart:] == few[0][:-apart]
            if not same.any():
                break
            pairs.append(np.stack([few[1][:-apart][same], few[1][apart:][same], few[2][apart:][same]]))
        a, b, level = np.concatenate(pairs, axis=1) if pairs else np.zeros((3, 0), "i8")
        order = np.lexsort((level, b, a))
        a, b, level = a[order], b[order], level[order]
        at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (level[1:] != level[:-1])])[: len(a)])
        shares = np.diff(np.append(at, len(a)))
        n = int(large.sum())
        return pa.table(
            {
                "print": pa.array(np.concatenate([prints[large] | bucket << 40, np.zeros(len(at), "i8")])),
                "level": pa.array(np.concatenate([levels[large], level[at]])),
                "a": pa.array(np.concatenate([nodes[large], a[at]])),
                "b": pa.array(np.concatenate([np.zeros(n, "i8"), b[at]]), mask=np.arange(n + len(at)) < n),
                "shares": pa.array(np.concatenate([np.ones(n, "i8"), shares])),
            }
        )

    blocks = docs.select(text_bytes().cast("binary").alias("text")).mapInArrow(lean(run), "bucket long, block binary")
    return blocks.groupBy("bucket").applyInArrow(lean(shared), "print long, level long, a long, b long, shares long")


def enough() -> Column:
    """The number of shared groups that a class asks for."""
    return F.get(F.array(*(F.lit(needed(i)) for i in range(len(LEVELS)))), F.col("level").cast("int"))


def small_pairs(listed: DataFrame, live: DataFrame) -> DataFrame:
    """Pairs that share enough; what they may share of large prints counts for them."""
    pairs = listed.where("b is not null").groupBy("a", "b", "level").agg(F.sum("shares").alias("shares"))
    large = live.groupBy("node", "level").agg(F.count("*").alias("large"))
    for k in "ab":
        side = large.select(F.col("node").alias(k), "level", F.col("large").alias(f"{k}_large"))
        pairs = pairs.join(side, [k, "level"], "left")
    more = F.least(F.coalesce("a_large", F.lit(0)), F.coalesce("b_large", F.lit(0)))
    return pairs.where(F.col("shares") + more >= enough()).select("a", "b").distinct()


def with_print(live: DataFrame, facts: DataFrame) -> DataFrame:
    """``live`` with ``facts``, one row per print: a print's rows are joined in shares by their sets."""
    shares = F.explode(F.array(*(F.lit(i) for i in range(SALTS)))).alias("share")
    return live.withColumn("share", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(
        facts.select("*", shares), ["print", "share"]
    ).drop("share")


def pivots_of(live: DataFrame) -> DataFrame:
    """(print, pivot): of the sets under a large print the one that shares most."""
    weights = with_print(live, live.groupBy("print").agg(F.count("*").alias("size")))
    weights = weights.groupBy("node").agg(F.sum("size").alias("weight"))
    best = live.join(weights, "node").groupBy("print").agg(F.max(F.struct("weight", "node")).alias("best"))
    return best.select("print", F.col("best.node").alias("pivot"))


def counts_in(table: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    """Count vectors as rows; a count that didn't fit is unbounded."""
    flat = np.frombuffer(b"".join(table.column(column).to_pylist()), "<u2").reshape(-1, DIMENSIONS).astype("u4")
    flat[flat == 0xFFFF] = 0xFFFFFF
    return flat


def sets_of(docs: DataFrame, known: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, items and counts of the given nodes, each from one of its documents."""
    chosen = known.join(nodes, "node").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("at"))
    chosen = scratch(chosen.select("node", F.col("at.doc_id").alias("at_id"), F.col("at.text_key").alias("at_key")), "chosen")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    found = rows.join(chosen, (F.xxhash64("text") == F.col("at_key")) & F.col("doc_id").eqNullSafe(F.col("at_id")))

    def of_rows(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["node", "n", "items", "counts"])

    def run(batches):
        held("word hashes", lambda: _hashes)
        seen = set()  # rows that repeat in a task are skipped
        for batch in batches:
            out, size = [], 0
            for node, text in few_at_a_time(batch, 0, 1):
                items = shingles(text) if node not in seen else ()
                if len(items) and node_of(items) == node:
                    seen.add(node)
                    counts = np.bincount((items & np.uint64(DIMENSIONS - 1)).astype("i8"), minlength=DIMENSIONS)
                    out.append((node, len(items), items.tobytes(), np.minimum(counts, 0xFFFF).astype("<u2").tobytes()))
                    size += len(items)
                if size >= FLUSH:
                    yield of_rows(out)
                    out, size = [], 0
            if out:
                yield of_rows(out)

    made = found.select("node", F.col("text").cast("binary")).mapInArrow(lean(run), "node long, n long, items binary, counts binary")
    return scratch(made, "sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in few_at_a_time(batch, "a_items", "b_items"):
                x, y = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(100 * common >= 80 * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def bounded(batches):
        for batch in batches:
            shared = np.zeros(batch.num_rows, "i8")
            for at in range(0, batch.num_rows, PART):
                x, y = (counts_in(batch.slice(at, PART), f"{k}_counts") for k in "ab")
                shared[at : at + PART] = np.minimum(x, y).sum(axis=1)
            both = batch.column("a_n").to_numpy() + batch.column("b_n").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(9 * shared >= 4 * both))

    # sizes and the summed minima of counts come first, on narrow rows
    for k in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(k), F.col("n").alias(f"{k}_n"), F.col("counts").alias(f"{k}_counts")), k)
    pairs = pairs.where("5 * least(a_n, b_n) >= 4 * greatest(a_n, b_n)").select("a", "b", "a_n", "b_n", "a_counts", "b_counts")
    pairs = scratch(pairs.mapInArrow(lean(bounded), "a long, b long").distinct(), "pairs")
    if pairs.count() <= BROADCAST_ROWS:
        pairs = F.broadcast(pairs)  # then the sets of one side stay where they are
    for k in "ab":
        pairs = sets.select(F.col("node").alias(k), F.col("items").alias(f"{k}_items")).join(pairs, k)
    return pairs.select("a", "b", "a_items", "b_items").mapInArrow(lean(run), "a long, b long").distinct()


class Boxes:
    """Points packed into leaves by component, size and first coordinates; a leaf keeps its points' maxima."""

    def __init__(self, root: np.ndarray, n: np.ndarray, points: np.ndarray):
        order = np.lexsort((points[:, 1], points[:, 0], n, root))
        self.order, self.root, self.n, self.points = order, root[order], n[order], points[order]
        starts = np.arange(0, len(n), LEAF)
        self.slices = [slice(s, s + LEAF) for s in starts]
        self.most = np.maximum.reduceat(self.points, starts, axis=0)
        self.least_n, self.most_n = np.minimum.reduceat(self.n, starts), np.maximum.reduceat(self.n, starts)
        self.first, self.last = np.minimum.reduceat(self.root, starts), np.maximum.reduceat(self.root, starts)

    def join(self, other: Boxes):
        """Pairs of point numbers in different components whose overlap may reach the similarity."""
        for i, mine in enumerate(self.slices):
            bound = np.minimum(self.most[i], other.most).sum(axis=1, dtype="i8")
            near = (9 * bound >= 4 * (self.least_n[i] + other.least_n)) & (5 * self.most_n[i] >= 4 * other.least_n)
            near &= (5 * other.most_n >= 4 * self.least_n[i])
            near &= (self.first[i] != self.last[i]) | (other.first != other.last) | (self.first[i] != other.first)
            for j in np.flatnonzero(near):
                theirs = other.slices[j]
                shared = np.minimum(self.points[mine, None], other.points[None, theirs]).sum(axis=2, dtype="i8")
                a, b = self.n[mine, None], other.n[None, theirs]
                fits = (9 * shared >= 4 * (a + b)) & (5 * np.minimum(a, b) >= 4 * np.maximum(a, b))
                x, y = np.nonzero(fits & (self.root[mine, None] != other.root[None, theirs]))
                yield self.order[mine][x], other.order[theirs][y]


def surviving_pairs(rows: DataFrame) -> DataFrame:
    """``rows``: pivot, node, n, counts, root. Pairs with one pivot in different components that the
    bounds let through. Many sets are cut into parts, and every two parts meet in one group, but those
    of the largest component among themselves: its sets go to parts of their own, the last ones."""
    sizes = rows.groupBy("pivot", "root").agg(F.count("*").alias("size")).groupBy("pivot").agg(
        F.max(F.struct("size", "root")).alias("largest"), F.sum("size").alias("size")
    )
    others = F.ceil((F.col("size") - F.col("largest.size")) / PART).cast("int")
    sizes = sizes.select("pivot", F.col("largest.root").alias("largest"), others.alias("others"),
                         F.ceil(F.col("largest.size") / PART).cast("int").alias("own")).where("others > 0")
    cut = rows.join(sizes, "pivot").withColumn("at", F.xxhash64("node")).withColumn("is_own", F.col("root") == F.col("largest"))
    part = F.when(F.col("is_own"), F.col("others") + F.pmod("at", "own")).otherwise(F.pmod("at", "others")).cast("int")
    last = F.when(F.col("is_own"), F.col("others")).otherwise(F.col("others") + F.col("own")) - 1
    cut = cut.withColumn("part", part)
    other = F.explode(F.sequence(F.lit(0), last)).alias("other")
    dealt = cut.select("*", other).select(
        "pivot", "node", "n", "counts", "root", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")
    )

    def meet(table: pa.Table) -> pa.Table:
        node, n, root, part = (table[c].to_numpy() for c in ("node", "n", "root", "part"))
        points, out = counts_in(table, "counts"), []
        p, q = (table[c][0].as_py() for c in ("p", "q"))
        first, second = (np.flatnonzero(part == x) for x in (p, q))
        if len(first) and len(second):
            mine, theirs = (Boxes(root[x], n[x], points[x]) for x in (first, second))
            for x, y in mine.join(theirs):
                x, y = node[first[x]], node[second[y]]
                once = (x < y) | (p != q)  # a part that meets itself has each pair twice
                x, y = x[once], y[once]
                out.append((np.minimum(x, y), np.maximum(x, y)))
        a, b = (np.concatenate(x) for x in zip(*out)) if out else np.zeros((2, 0), "i8")
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("pivot", "p", "q").applyInArrow(lean(meet), "a long, b long").distinct()


def linked(docs: DataFrame, known: DataFrame) -> DataFrame | None:
    """(node, root) of all sets that link with another, but the roots; None if there are none."""
    total = known.agg(F.sum("n_shingles")).first()[0] or 0
    listed = scratch(shared_listings(docs, total), "listings")
    # a set may be listed both in a bucket and with the rest that was dealt out
    live = listed.where("b is null").select("print", "level", F.col("a").alias("node")).distinct()
    live = scratch(live, "large-prints")
    pivots = scratch(pivots_of(live), "pivots")
    stars = with_print(live, pivots).where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    pairs = scratch(small_pairs(listed, live).union(stars.distinct()), "candidates")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = sets_of(docs, known, nodes)
    links = scratch(verified(pairs, sets), "links")
    if links.isEmpty():
        rooted = live.withColumn("root", F.col("node"))
    else:
        rooted = live.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_prints = rooted.groupBy("print").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    families = with_print(rooted, open_prints.select("print").join(pivots, "print")).select("pivot", "node", "root").distinct()
    points = sets.select("node", "n", "counts").dropDuplicates(["node"])
    rest = scratch(families.join(points, "node"), "open")
    if not rest.isEmpty():
        links = scratch(links.union(verified(surviving_pairs(rest), sets)), "links")
    return None if links.isEmpty() else components(links)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and text_key (a hash of the text) of every row."""
    known = scratch(features(docs), "shingles")
    rooted = linked(docs, known)
    first = known.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("component_id"))
    if rooted is not None:
        member = first.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
        member = scratch(member, "members")
        least = member.groupBy("root").agg(F.min("component_id").alias("component_id"))
        first = member.select("node", "root").join(least, "root").select("node", "component_id")
    return known.join(first, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_key"
    )


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that stay: of each component the document with
    the smallest id, and all texts without a set. Of rows with equal id and text one stays; rows without an
    id stay only where their component has no id, all of them."""
    found = scratch(near_duplicates(docs), "near-duplicates")
    gone = found.where("n_shingles > 0 and not (doc_id <=> component_id)").select("doc_id", "text_key").distinct()
    key = unused(docs, "text_key_here")
    keyed = docs.withColumn(key, F.xxhash64(text_bytes()))

    def same(other: DataFrame):
        return (keyed[key] == other["text_key"]) & keyed["doc_id"].cast("long").eqNullSafe(other["doc_id"])

    kept = keyed.join(gone, same(gone), "left_anti")
    repeated = found.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id", "text_key").count().where("count > 1")
    repeated = scratch(repeated.drop("count"), "repeated-rows")
    if repeated.isEmpty():
        return kept.drop(key)
    several = keyed.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", key])
    single = kept.join(repeated, same(repeated), "left_anti")
    return single.unionByName(several.join(gone, same(gone), "left_anti")).drop(key)


def op10_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("text_key")
