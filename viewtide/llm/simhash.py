"""SimHash near-duplicates through pivot distance tables.

A fingerprint has a bit set where over half of the XXH64 hashes of the text's three-word shingles have it. Documents with
equal fingerprints form a class; classes link at ``RADIUS`` or fewer differing bits. A table holds every fingerprint's Hamming
distances to reference fingerprints (pivots). By the triangle inequality the distances of a link to any pivot differ by RADIUS
at most, and the table is used three times for it:

- Candidates: the first pivots' distances are cut into cells of 2 RADIUS + 1, and a fingerprint lies in the cell of its
  distance and in that of its distance plus RADIUS. Fingerprints that link share one cell under every pivot, so they meet in the
  cells of all these pivots together, and are compared in the one cell where no pivot has both of them by the second way.
- Within a cell the rows are sorted by the next pivot's distance, and only a window of each row's followers is looked at.
- The other pivots discard pairs whose distances differ by more, one after another. The survivors' bits are compared.

How many pivots make the cells follows from the number of classes, so a class meets about ``CELL_ROWS`` others; each further pivot
leaves 56 % of them and adds 40 % of rows, so rows grow as the 1.6th power of the number of classes. Cells that a sample shows
to be large are dealt out as pairs of blocks to several tasks. Where rows must not grow faster than classes, cells are made of
differences of distances instead (``part_cells``). A task gives the edges of a spanning forest, never its pairs,
and pairs that are connected already are skipped. Components come from contracting the edges until none is left; nothing of
that is held on the driver.

Defined results: null text is empty; a text without words has fingerprint zero and links like any other; fewer words than
a shingle has make one shingle of the whole sequence; a null doc_id takes part, but is no component's id unless all are
null; repeated rows are repeated in the result; other columns are ignored; an empty table gives no rows; a very long text is
read whole, its hashes added up in parts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import around_extras, cut, rows_of, small_or_plain, text_batches, written

SEED = 42
RADIUS = 2
#: Reference fingerprints in a table.
PIVOTS = 24
#: Pivots whose distances and those to their inversions in a part of the bits make ``part_cells``.
PART_PIVOTS = 12
#: Rows of a cell, about, and of a block of a cell that is dealt out; one row in SAMPLE is looked at for large cells.
CELL_ROWS, BLOCK_ROWS, SAMPLE = 2_500, 8_192, 16
#: The share of random pairs that one pivot's cells leave together, for RADIUS.
LEFT = 0.56
#: Rows closed together, and pairs looked at together.
TOGETHER, PAIRS = 65_536, 1_000_000


def shingle_hashes(text: str, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle in turn, none for a text without words."""
    from xxhash import xxh64_intdigest

    # bytes.lower() and bytes.split() know ASCII only: A-Z, and 0x20 and 0x09-0x0D.
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:z], seed) for a, z in spans), np.uint64, len(words) - width + 1)


def fingerprint_of(text: str, width: int, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit integer."""
    return fingerprint_of_hashes(shingle_hashes(text, width, seed))


def fingerprint_of_hashes(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    # Bits in little-endian order: bit k of the value at place k.
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = SEED) -> DataFrame:
    """doc_id, fp (signed long)."""
    import pyarrow as pa

    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(rows_of(batch, "doc_id", "text"))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([fingerprint_of(r[1] or "", width, seed) for r in rows], pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def pivot_values(n: int) -> np.ndarray:
    """n reference fingerprints, the hashes of their numbers."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(n)], np.uint64)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances, a row for each fingerprint and a column for each pivot."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


class Forest:
    """Labels of rows under the links found so far, and one edge for each link that joined two trees."""

    def __init__(self, n: int):
        self.label, self.edges = np.arange(n), []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = self.label[a], self.label[b]
            open_ = la != lb
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            if not len(a):
                return
            # One link for each higher label: they join at once, whatever order they come in.
            high, low = np.maximum(la, lb), np.minimum(la, lb)
            high, at = np.unique(high, return_index=True)
            self.edges.append(np.column_stack([a[at], b[at]]))
            to = np.arange(len(self.label))
            to[high] = low[at]
            while True:
                after = to[to]
                if np.array_equal(after, to):
                    break
                to = after
            self.label = to[self.label]


def cell_pivots(n: int) -> int:
    """How many pivots make the cells of n fingerprints."""
    return max(2, int(np.ceil(np.log(max(n, 1) / CELL_ROWS) / -np.log(LEFT))))


def cells(fps: np.ndarray, pivots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, ways, row: the cells that each fingerprint lies in. Bit j of ways: under pivot j by its distance plus radius."""
    table, width = pivot_table(fps, pivots).astype(np.int64), 2 * radius + 1
    first, second = table // width, (table + radius) // width
    # A cell's key is made of a hash for each pivot's part of it.
    names = np.array([[hash_of(j, c) for c in range(64 // width + 2)] for j in range(len(pivots))], np.uint64)
    row = np.arange(len(fps))
    key, ways = np.zeros(len(fps), np.uint64), np.zeros(len(fps), np.int64)
    for j in range(len(pivots)):
        key ^= names[j, first[:, j]]
    for j in range(len(pivots)):
        also = np.flatnonzero(first[row, j] != second[row, j])
        r = row[also]
        key = np.concatenate([key, key[also] ^ names[j, first[r, j]] ^ names[j, second[r, j]]])
        ways, row = np.concatenate([ways, ways[also] | 1 << j]), np.concatenate([row, r])
    return key, ways, row


def part_cells(fps: np.ndarray, pivots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with radius + 1 cells for each fingerprint, however many pivots make them; no way is ever shared.

    The bits are dealt out to radius + 1 parts, and each pivot has an inversion in each part. A bit outside a part changes the
    distances to a pivot and to its inversion in the part alike, so their difference stays as it is. Fingerprints that link
    differ in radius parts at most, so there is a part for which all differences are equal, and they share its cell.
    """
    table, place = pivot_table(fps, pivots).astype(np.int64), np.arange(64) % (radius + 1)
    keys = []
    for part in range(radius + 1):
        inverted = np.bitwise_or.reduce(np.uint64(1) << np.flatnonzero(place == part).astype(np.uint64))
        differences = table - pivot_table(fps, pivots ^ inverted) + 64
        names = np.array([[hash_of(part * len(pivots) + j, d) for d in range(129)] for j in range(len(pivots))], np.uint64)
        keys.append(np.bitwise_xor.reduce(names[np.arange(len(pivots)), differences], axis=1))
    return np.concatenate(keys), np.zeros((radius + 1) * len(fps), np.int64), np.tile(np.arange(len(fps)), radius + 1)


@functools.cache
def hash_of(pivot: int, cell: int) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(f"cell {pivot} {cell}".encode(), SEED)


def links_within(cell: np.ndarray, fps: np.ndarray, ways: np.ndarray, own: np.ndarray | None, pivots: np.ndarray, radius: int) -> np.ndarray:
    """Spanning edges (row numbers) of the links between rows of a cell (numbered) that share no way. own: the rows' blocks, -1 where all pairs count; else those of different blocks."""
    n, table = len(fps), pivot_table(fps, pivots)
    # A cell's rows in the order of the first distance; no window reaches the next cell.
    place = cell * 256 + table[:, 0]
    order = np.argsort(place, kind="stable")
    place = place[order]
    until = np.searchsorted(place, place + radius, side="right")
    width = until - np.arange(n) - 1
    before = np.cumsum(width) - width
    forest, begin = Forest(n), 0
    while begin < n:
        # As many rows as give about PAIRS pairs.
        end = max(begin + 1, int(np.searchsorted(before, before[begin] + PAIRS)))
        w = width[begin:end]
        a = np.repeat(np.arange(begin, min(end, n)), w)
        b = a + 1 + np.arange(len(a)) - np.repeat(before[begin:end] - before[begin], w)
        a, b = order[a], order[b]
        keep = (forest.label[a] != forest.label[b]) & (ways[a] & ways[b] == 0)
        if own is not None:
            keep &= (own[a] < 0) | (own[a] != own[b])
        a, b = a[keep], b[keep]
        for p in range(1, len(pivots)):
            if not len(a):
                break
            near = np.abs(table[a, p] - table[b, p]) <= radius
            a, b = a[near], b[near]
        linked = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        forest.join(a[linked], b[linked])
        begin = end
    return np.concatenate([np.zeros((0, 2), np.int64), *forest.edges])


def celled(classes: DataFrame, n_cell: int, radius: int, n_pivots: int, in_parts: bool = False) -> DataFrame:
    """classes (fp) -> key (of a cell), ways, fp: a row for each cell that a class lies in."""
    import pyarrow as pa

    pivots = pivot_values(max(n_cell, n_pivots))[:n_cell]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                fps = batch.column(0).slice(at, 1000).to_numpy(zero_copy_only=False)
                key, ways, row = (part_cells if in_parts else cells)(fps.view(np.uint64), pivots, radius)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ways), pa.array(fps[row])], ["key", "ways", "fp"])

    return classes.select("fp").mapInArrow(run, "key long, ways long, fp long")


def class_edges(classes: DataFrame, radius: int = RADIUS, n_pivots: int = PIVOTS, in_parts: bool = False) -> DataFrame:
    """classes (fp, each once) -> (u, v) edges between fingerprints that link, fewer than rows in each cell. in_parts: radius + 1 rows for each class (part_cells)."""
    import pyarrow as pa

    n_cell = PART_PIVOTS if in_parts else cell_pivots(classes.count())
    # The cells' own pivots tell rows of a cell apart least, so they come last.
    pivots = np.roll(pivot_values(max(n_pivots, n_cell + 1)), -n_cell)
    rows = written(celled(classes, n_cell, radius, n_pivots, in_parts), "pivot-cells")
    sampled = rows.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).groupBy("key").count()
    large = cut(sampled.where(F.col("count") * SAMPLE > BLOCK_ROWS).select("key", F.ceil(F.col("count") * SAMPLE / BLOCK_ROWS).cast("int").alias("blocks")))
    # Block i meets block j in task (min, max); a cell of one block is its own task.
    one = F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(-1).alias("own")
    if large.isEmpty():
        keyed = rows.select("key", *one, "ways", "fp")
    else:
        placed = rows.join(small_or_plain(large), "key", "left").withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("fp"), F.col("blocks"))).otherwise(0).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        own = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own"))
        keyed = placed.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), own.alias("own"), "ways", "fp")
    key = ["key", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        held = 0

        def closed(cols: np.ndarray) -> pa.RecordBatch:
            starts = np.concatenate([[True], (cols[1:, :3] != cols[:-1, :3]).any(axis=1)])
            own = cols[:, 3]
            pairs = links_within(np.cumsum(starts), cols[:, 5].copy().view(np.uint64), cols[:, 4], own if (own >= 0).any() else None, pivots, radius)
            u, v = cols[pairs[:, 0], 5], cols[pairs[:, 1], 5]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

        for batch in batches:
            kept.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            held += batch.num_rows
            if held < TOGETHER:
                continue
            cols = np.concatenate(kept)
            # The last cell may go on in the next batch.
            other = np.flatnonzero((cols[:, :3] != cols[-1, :3]).any(axis=1))
            at = int(other[-1]) + 1 if len(other) else 0
            if at:
                yield closed(cols[:at])
            kept = [cols[at:]]
            held = len(cols) - at
        if held:
            yield closed(np.concatenate(kept))

    return keyed.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges with u > v -> (node, component): the smallest node reachable, for every node that has an edge.

    Each round points every node to the smallest of itself and its neighbours, follows the pointers to their ends by
    doubling, and puts the ends in the nodes' places in the edges, until no edge is left. An end has a neighbour that points
    to it, so a round leaves at most half of the nodes, and doubling takes the logarithm of the longest way.
    """
    edges = cut(edges.where("u <> v"))
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")).select(F.col("u").alias("node"), "to"))
        while True:
            ends = to.where("node <> to").select(F.col("node").alias("to"), F.col("to").alias("after"))
            farther = cut(to.join(ends, "to", "left").select("node", F.coalesce("after", "to").alias("to"), F.col("after").isNotNull().alias("moved")))
            to = farther.drop("moved")
            if farther.where("moved").isEmpty():
                break
        if labels is None:
            labels = to.select("node", F.col("to").alias("component"))
        else:
            step = to.select(F.col("node").alias("component"), "to")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        edges = (
            edges.join(to.select(F.col("node").alias("u"), F.col("to").alias("a")), "u")
            .join(to.select(F.col("node").alias("v"), F.col("to").alias("b")), "v")
            .where("a <> b")
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            .distinct()
        )
        edges, labels = cut(edges), cut(labels)
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS, n_pivots: int = PIVOTS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id (the smallest doc_id reachable over links)."""
    prints = cut(fingerprints(docs, width))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # A class is named by its fingerprint, so one without a doc_id links too.
    found = components(class_edges(classes, radius, n_pivots))
    placed = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stay: of each component the document with the smallest doc_id, once. Rows without doc_id stay."""
    return around_extras(docs, {"doc_id", "text"}, lambda d: firsts(d, near_duplicates(d, width, radius)))


def firsts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that stay under labels (doc_id, component_id), a row for each row of docs."""
    names = docs.columns
    labels = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("times"))
    labels = cut(labels.where("doc_id <> component_id or times > 1").select("doc_id", F.struct((F.col("doc_id") == F.col("component_id")).alias("first"), "times").alias("near_dup_mark")))
    marked = docs.join(small_or_plain(labels).withColumnRenamed("doc_id", "near_dup_id"), F.col("doc_id") == F.col("near_dup_id"), "left").drop("near_dup_id")
    stays = marked.where("near_dup_mark is null or near_dup_mark.first")
    if labels.where("near_dup_mark.times > 1").isEmpty():
        return stays.select(*names)
    once = stays.where("near_dup_mark.times > 1").dropDuplicates(["doc_id"])
    return stays.where("near_dup_mark is null or near_dup_mark.times = 1").unionByName(once).select(*names)
