"""Self join of documents by the Jaccard similarity of their word shingles, with chosen paths.

Texts with the same words are one node. A node's set is embedded as the minima of its shingles under random functions.
A run samples some of these coordinates and puts the nodes that share a minimum there into one bucket; a bucket that is
too large is split again on freshly sampled coordinates. In a small bucket all pairs are compared by one-bit sketches,
in a middling one all its nodes with the centres of its dense parts. A bucket that stays large at the last depth is dealt
into pieces, whose centres are then compared with each other in cells, so no pair is lost to the dealing. Runs repeat
until the target recall.

The candidates join nodes into clusters; shingles of clustered nodes are then read once, and all pairs of a cluster are
verified exactly, in cells of bounded size. So a link is lost only if its cluster was not found, whatever the size of a
group of near copies, and no list of all pairs is ever made: nodes carry the count of their links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import Words, bounded_batches, components, distinct, hash_words, mix, relax, shingles, whole_groups, written

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.999
MINIMA = 128  # coordinates of the embedded set
PAIRS = 256  # nodes of a bucket that are compared pair by pair; larger ones with the centres of their dense parts
BUCKET = 4096  # nodes of a bucket that are compared at once; larger ones are split
DEPTH = 4  # splits of a bucket; one that is still larger then is dealt into pieces
CELL = 2048  # nodes on either side of a block of exact comparisons
CELL_SHINGLES = 2 << 20  # shingles on either side of it
BROADCAST_ROWS = 500_000  # ids of documents up to this many are broadcast, beyond it they are joined by a shuffle
_FAR = round(MINIMA * (1 - 0.45) / 2)  # bits by which sketches of a node and a centre, or of two centres, differ at most: similarity 0.45
_PAIR = 27  # bits for two nodes compared directly: at the similarity 0.8 sketches differ by 12.8, s.d. 3.4
_NEAR = round(MINIMA * (1 - 0.85) / 2)  # bits up to which a node lies in the dense part around a centre

_MULTIPLY = (mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (mix(np.arange(1001, MINIMA + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def runs_for(recall: float, similarity: float = SIMILARITY, depth: int = DEPTH) -> int:
    """Runs after which a pair of the given similarity has met with probability recall, at any depth of its buckets."""
    meet = 1.0
    for level in range(depth + 1):
        meet = 1 - math.exp(-meet * _rate(depth - level) * similarity)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _rate(level: int) -> float:
    """Coordinates that a node of the recursion samples on average: 1 / similarity at the root, 2 below it."""
    return 1 / SIMILARITY if level == 0 else 2.0


def _sampled(path: int, level: int) -> np.ndarray:
    """The coordinates sampled at a path: the same for all nodes there."""
    draw = mix(np.array([path], np.uint64) + np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.flatnonzero(draw < np.uint64(int(_rate(level) / MINIMA * 2**64)))


def sets_of(texts: list[str | None]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words, the shingles' keys one text after another, and where each text's begin and end.

    A text of fewer words than a shingle has one shingle of all its words; one without words has none.
    """
    words = hash_words([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    keys = shingles(words, SHINGLE)
    first = words.starts[:-1]
    n = np.diff(words.starts)
    begin, end = first.copy(), np.maximum(words.starts[1:] - SHINGLE + 1, first)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    extra = [int(xxhash.xxh3_64_intdigest(words.hashes[first[i] : words.starts[i + 1]].tobytes())) for i in short.tolist()]
    begin[short] = len(keys) + np.arange(len(short))
    end[short] = begin[short] + 1
    return words, np.concatenate([keys, np.array(extra, np.uint64)]), begin, end


def node_of(words: Words, i: int) -> bytes | None:
    """128 bits of a text's words; none for a text without words."""
    own = words.hashes[words.starts[i] : words.starts[i + 1]]
    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def _minima(keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The embedded sets: for each text with shingles its minimum under each function."""
    low = mix(keys).astype(np.uint32)
    spans = np.ravel(np.stack([begin, end], axis=1))
    if len(low) == 0 or len(begin) == 0:
        return np.zeros((len(begin), MINIMA), np.uint32)
    padded = np.append(low, np.uint32(0xFFFFFFFF))
    out = np.empty((len(begin), MINIMA), np.uint32)
    scratch = np.empty_like(padded)
    for j in range(MINIMA):
        np.multiply(padded, _MULTIPLY[j], out=scratch)
        np.add(scratch, _ADD[j], out=scratch)
        scratch ^= scratch >> np.uint32(15)
        out[:, j] = np.minimum.reduceat(scratch, spans)[0::2]
    return out


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, node, minima and number of shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words, keys, begin, end = sets_of(part.column(1).to_pylist())
                real = np.flatnonzero(end > begin)
                minima = _minima(keys, begin[real], end[real])
                nodes = [node_of(words, i) for i in range(part.num_rows)]
                sign: list[bytes | None] = [None] * part.num_rows
                for i, m in zip(real.tolist(), minima, strict=True):
                    sign[i] = m.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.binary()), pa.array(sign, pa.binary()), pa.array(end - begin, pa.int64())], [key, "node", "minima", "shingles"])
        relax()

    return bounded_batches(docs.select(key, text)).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, node binary, minima binary, shingles long")


_ROWS = "path long, whole long, node binary, sketch binary"  # whole: the bucket that a piece was dealt from, else 0


def _children(batch: pa.RecordBatch, paths: np.ndarray, sizes: np.ndarray, level: int, bucket: int) -> pa.RecordBatch:
    """The buckets below each row's path: a row for each sampled coordinate."""
    minima = np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint32).reshape(-1, MINIMA)
    bits = np.packbits((minima & np.uint32(1)).astype(bool), axis=1)
    rows, kids, wholes = [], [], []
    names = np.frombuffer(b"".join(batch.column("node").to_pylist()), np.uint64).reshape(-1, 2)[:, 0]
    for path in np.unique(paths).tolist():
        own = np.flatnonzero(paths == np.uint64(path))
        for j in _sampled(path, level).tolist():
            below = np.array([(path + (j + 1) * 0xD1B54A32D192ED03) % 2**64], np.uint64)
            child = mix(mix(below) + minima[own, j].astype(np.uint64))
            whole = np.zeros(len(own), np.uint64)
            if level >= DEPTH:
                pieces = -(-sizes[own] // bucket)
                deal = mix(names[own] + np.uint64(path)) % pieces.astype(np.uint64)
                whole = np.where(pieces > 1, child, whole)
                child = np.where(pieces > 1, mix(child + deal + np.uint64(1)), child)
            rows.append(own)
            kids.append(child)
            wholes.append(whole)
    at = np.concatenate([np.zeros(0, np.int64), *rows])
    path, whole = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (kids, wholes))
    return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(whole.view(np.int64)), batch.column("node").take(pa.array(at)), pa.array([bits[i].tobytes() for i in at.tolist()], pa.binary())], ["path", "whole", "node", "sketch"])


def _linked(pairs: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The least index that each of n is joined with."""
    label = np.arange(n)
    i, j = pairs
    while True:
        least = np.minimum(label[i], label[j])
        was = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if np.array_equal(was, label):
            return label


def _compared(table: pa.Table, deepest: bool, bucket: int) -> pa.RecordBatch:
    """Candidate edges inside buckets (a, b), the nodes of buckets to split (a, path, size), and centres of pieces (a, path, 0, sketch)."""
    wholes = table.column("whole").to_numpy()
    paths = table.column("path").to_numpy()
    nodes = table.column("node").to_pylist()
    bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, MINIMA // 64)
    n = len(paths)
    first = np.flatnonzero(np.concatenate([[True], paths[1:] != paths[:-1]]))
    size = np.diff(np.append(first, n))
    small = np.repeat(size <= min(PAIRS, bucket), size)
    end = np.repeat(first + size, size)
    near: list[tuple[np.ndarray, np.ndarray]] = []
    live, d = np.flatnonzero(small), 1
    while len(live := live[live + d < end[live]]):
        apart = np.bitwise_count(bits[live] ^ bits[live + d]).sum(axis=1, dtype=np.int32)
        hit = live[apart <= _PAIR]
        near.append((hit, hit + d))
        d += 1
    split = np.zeros(0, np.int64) if deepest else np.flatnonzero(np.repeat(size > bucket, size))
    piece = wholes[first] != 0
    dense = ((size > min(PAIRS, bucket)) & ((size <= bucket) | deepest)) | piece
    heads: list[int] = []  # centres of pieces, to be compared with those of the bucket's other pieces
    for a, k, of in zip(first[dense].tolist(), size[dense].tolist(), piece[dense].tolist(), strict=True):
        found = _canopies(bits, a, a + k)
        near += found
        heads += [int(c[0]) for _, c in found] if of else []
    i, j = (np.concatenate([np.zeros(0, np.int64), *(p[x] for p in near)]) for x in (0, 1))
    label = _linked((i, j), n)
    edge = np.flatnonzero(label != np.arange(n))
    # Edges go to the least node, so that different buckets of a group agree on the star's centre.
    centre: dict[int, bytes] = {}
    for x, l in zip([*edge.tolist(), *np.unique(label[edge]).tolist()], [*label[edge].tolist(), *np.unique(label[edge]).tolist()], strict=True):
        centre[l] = min(centre.get(l, nodes[x]), nodes[x])
    ends = np.unique(np.concatenate([edge, label[edge]])).tolist()
    ends = [x for x in ends if nodes[x] != centre[int(label[x])]]
    sizes = np.repeat(size, size)
    edge = np.array(ends, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([nodes[x] for x in [*edge.tolist(), *split.tolist(), *heads]], pa.binary()),
            pa.array([centre[x] for x in label[edge].tolist()] + [None] * (len(split) + len(heads)), pa.binary()),
            pa.array(np.concatenate([paths[edge], paths[split], wholes[heads]]), pa.int64()),
            pa.array(np.concatenate([sizes[edge], sizes[split], np.zeros(len(heads), np.int64)]), pa.int64()),
            pa.array([None] * (len(edge) + len(split)) + [bits[x].tobytes() for x in heads], pa.binary()),
        ],
        ["a", "b", "path", "size", "sketch"],
    )


def _canopies(bits: np.ndarray, a: int, b: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes with centres. A node that no earlier centre is near to is a centre; all nodes are compared with it.

    Two nodes of a link are both candidates of the centre that either is near to: distances of sets obey the triangle
    inequality, so a node at 0.15 from a centre has its links within 0.35 of that centre.
    """
    own = bits[a:b]
    free = np.ones(b - a, bool)
    pairs = []
    while free.any():
        c = int(np.argmax(free))
        apart = np.bitwise_count(own ^ own[c]).sum(axis=1, dtype=np.int32)
        hit = np.flatnonzero(apart <= _FAR)
        pairs.append((a + hit, np.full(len(hit), a + c)))
        free[apart <= _NEAR] = False
        free[c] = False
    return pairs


def _heads_linked(heads: DataFrame, bucket: int) -> DataFrame:
    """Edges a, b between centres (a, path, sketch) of the pieces of each bucket, all pairs compared in cells."""
    sizes = heads.groupBy(F.col("path").alias("_path")).agg(F.ceil(F.count("*") / bucket).alias("blocks"))
    dealt = heads.join(sizes, F.col("path") == F.col("_path")).withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), F.col("a").alias("node"), "sketch"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 0):
            keys, nodes = table.column("cell").to_numpy(), table.column("node").to_pylist()
            bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, MINIMA // 64)
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])).tolist()
            pairs = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for x in range(a, b - 1):
                    near = np.flatnonzero(np.bitwise_count(bits[x + 1 : b] ^ bits[x]).sum(axis=1, dtype=np.int32) <= _FAR)
                    pairs.append((np.full(len(near), x), x + 1 + near))
            i, j = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in pairs)]) for k in (0, 1))
            label = _linked((i, j), len(keys))
            at = np.flatnonzero(label != np.arange(len(keys))).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([nodes[x] for x in at], pa.binary()), pa.array([nodes[int(label[x])] for x in at], pa.binary())], ["a", "b"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a binary, b binary").filter("a <> b")


def candidates(nodes: DataFrame, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """Edges a, b that connect every pair of nodes (node, minima) that is similar, and some others."""
    runs = runs_for(recall)
    roots = mix(np.arange(1, runs + 1, dtype=np.uint64))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root in roots.tolist():
                yield _children(batch, np.full(batch.num_rows, root, np.uint64), np.ones(batch.num_rows, np.int64), 0, bucket)

    def compare(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(batches, 0):
                yield _compared(table, level >= DEPTH, bucket)
            relax()

        return run

    def deeper(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _children(batch, batch.column("path").to_numpy().view(np.uint64), batch.column("size").to_numpy(), level, bucket)

        return run

    rows = nodes.select("node", "minima").mapInArrow(start, _ROWS)
    edges = None
    for level in range(DEPTH + 1):
        found = rows.repartition("path").sortWithinPartitions("path").mapInArrow(compare(level), "a binary, b binary, path long, size long, sketch binary")
        found = written(found, f"buckets{level}")
        own = found.filter("b IS NOT NULL").select("a", "b")
        edges = own if edges is None else edges.unionByName(own)
        if level == DEPTH:
            heads = found.filter("b IS NULL").select("a", "path", "sketch")
            if not heads.isEmpty():
                edges = edges.unionByName(_heads_linked(heads, bucket))
            break
        split = found.filter("b IS NULL").select(F.col("a").alias("_a"), "path", "size")
        if split.isEmpty():
            break
        again = split.join(nodes.select("node", "minima"), F.col("_a") == F.col("node")).select("path", "size", "node", "minima")
        rows = again.mapInArrow(deeper(level + 1), _ROWS)
    return edges


def _links(keys: list[np.ndarray], sides: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets, given as distinct keys, of similarity SIMILARITY or more: of all, or of one side with the other."""
    n = np.fromiter(map(len, keys), np.int64, len(keys))
    flat = np.concatenate(keys)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(keys)), n)
    shared = times[column] > 1  # a shingle of one set only is in no intersection
    renumber = np.cumsum(times > 1) - 1
    row, column = row[shared], renumber[column[shared]]
    left = np.flatnonzero(sides == 0) if both else np.arange(len(keys))
    right = np.flatnonzero(sides == 1) if both else left
    place = np.empty(len(keys), np.int64)
    place[left] = np.arange(len(left))
    place[right] = np.arange(len(right))
    on_left = sides[row] == 0 if both else np.ones(len(row), bool)
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column, on_left = row[order], column[order], on_left[order]
    step = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [at, at + step])
        r, c, o = row[a:b], column[a:b] - at, on_left[a:b]
        width = int(c.max()) + 1
        x = np.zeros((len(left), width), np.float32)
        x[place[r[o]], c[o]] = 1
        if both:
            y = np.zeros((len(right), width), np.float32)
            y[place[r[~o]], c[~o]] = 1
        else:
            y = x
        common += x @ y.T
    # 9/5 of the intersection against 4/5 of both sizes, in whole numbers: exact at the threshold.
    over = 100 * common.astype(np.int64) >= round(100 * SIMILARITY) * (n[left][:, None] + n[right][None, :] - common.astype(np.int64))
    if not both:
        over = np.triu(over, 1)
    i, j = np.nonzero(over & (common > 0))
    return left[i], right[j]


def _verified(table: pa.Table) -> pa.RecordBatch:
    """For each node of each cell the documents that it links to there, and the least node that it is joined with."""
    cells = table.column("cell").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    ends = np.append(first[1:], len(cells))
    nodes, blobs = table.column("node").to_pylist(), table.column("shingles").to_pylist()
    side, both, weight = (table.column(c).to_numpy(zero_copy_only=False) for c in ("side", "both", "size"))
    out: list[tuple[bytes, bytes, int]] = []
    for a, b in zip(first.tolist(), ends.tolist(), strict=True):
        at: dict[tuple[bytes, int], int] = {}
        for x in range(a, b):
            at.setdefault((nodes[x], int(side[x])), x)  # a node's text can stand in many rows
        own = sorted(at.values(), key=lambda x: nodes[x])
        if len(own) < 2:
            continue
        i, j = _links([np.frombuffer(blobs[x], np.uint64) for x in own], side[own], bool(both[a]))
        if not len(i):
            continue
        w = weight[own]
        links = np.zeros(len(own), np.int64)
        np.add.at(links, i, w[j])
        np.add.at(links, j, w[i])
        label = _linked((i, j), len(own))
        out += [(nodes[own[k]], nodes[own[label[k]]], int(links[k])) for k in np.flatnonzero(links).tolist()]
    columns = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["node", "peer", "links"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """key, class_id, n_links and copy_of of each row.

    class_id is the least key of the row's class: documents joined by links, a link being a Jaccard similarity of
    SIMILARITY or more of the sets of SHINGLE-word shingles; words are runs between ASCII white space, their case counts.
    n_links is the number of other rows that the row links to, copies included; copy_of is the least key of the rows with
    the same words. A text without words (null, empty, white space) links to nothing and is a class of its own. A text of
    one to four words is one shingle. Repeated rows are copies of each other. A null key is never the least unless all
    are null. Links are exact where found; a pair of similarity 0.8 is found with probability recall or more.
    """
    drawn = written(sketches(docs, key, text), "sketches")
    real = drawn.filter("node IS NOT NULL")
    nodes = real.groupBy("node").agg(F.min(key).alias("rep"), F.count("*").alias("size"), F.first("minima").alias("minima"), F.first("shingles").alias("shingles"))
    nodes = written(nodes, "nodes")
    clusters = components(candidates(nodes, recall, bucket)).join(nodes.select("node", "rep", "size", "shingles"), "node")
    clusters = written(clusters, "clusters")
    sizes = clusters.groupBy(F.col("root").alias("_root")).agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("shingles") / CELL_SHINGLES)).alias("blocks"))
    placed = clusters.join(sizes, F.col("root") == F.col("_root")).drop("_root", "shingles")
    placed = written(placed.select(F.col("node").alias("want"), "root", "blocks", "rep", "size"), "placed")
    small = placed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    wanted = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(placed) if small else placed, F.col("_key").eqNullSafe(F.col("rep")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words, keys, begin, end = sets_of(part.column("_text").to_pylist())
                want = part.column("want").to_pylist()
                own = [i for i in range(part.num_rows) if node_of(words, i) == want[i]]
                blobs = [distinct(keys[begin[i] : end[i]]).tobytes() for i in own]
                rest = [part.column(c).take(pa.array(own, pa.int64())) for c in ("want", "root", "blocks", "size")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(blobs, pa.binary())], ["node", "root", "blocks", "size", "shingles"])
        relax()

    sets = wanted.select("_text", "want", "root", "blocks", "size").mapInArrow(read, "node binary, root binary, blocks long, size long, shingles binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    cells = (
        sets.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("both", F.col("own") != F.col("other"))
        .withColumn("side", (F.col("own") > F.col("other")).cast("int"))
        .withColumn("cell", F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")))
    )
    dealt = cells.select("cell", "node", "side", "both", "size", "shingles").repartition("cell").sortWithinPartitions("cell")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 0):
            yield _verified(table)
        relax()

    links = written(dealt.mapInArrow(verify, "node binary, peer binary, links long"), "links")
    counts = links.groupBy(F.col("node").alias("_node")).agg(F.sum("links").alias("links"))
    labels = components(links.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    labelled = nodes.select("node", "rep", "size").join(labels.select(F.col("node").alias("_n"), "root"), F.col("node") == F.col("_n"), "left")
    labelled = labelled.select("node", "rep", "size", F.coalesce("root", "node").alias("root"))
    least = labelled.groupBy(F.col("root").alias("_root")).agg(F.min("rep").alias("_least"))
    known = (
        labelled.join(least, F.col("root") == F.col("_root"))
        .join(counts, F.col("node") == F.col("_node"), "left")
        .select(F.col("node").alias("_of"), F.col("rep").alias("_rep"), F.col("_least"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("_links"))
    )
    return drawn.select(key, "node").join(known, F.col("node") == F.col("_of"), "left").select(
        key,
        F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("_least")).alias("class_id"),
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("_rep")).alias("copy_of"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose key is their class's least; of repeated rows with that key one stays, null keys all stay."""
    found = written(near_duplicates(docs, key, text), "classes")
    gone = found.filter(F.col(key) != F.col("class_id")).select(F.col(key).alias("_key")).distinct()
    small = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    left = docs.join(F.broadcast(gone) if small else gone, F.col(key) == F.col("_key"), "left_anti")
    if found.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").isEmpty():
        return left
    return left.filter(F.col(key).isNotNull()).dropDuplicates([key, text]).unionByName(left.filter(F.col(key).isNull()))


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT ws, min(doc_id) AS rep, count(*) AS size FROM w WHERE len(ws) > 0 GROUP BY ws),
s AS (SELECT DISTINCT rep, unnest(CASE WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')] ELSE list_transform(generate_series(1, len(ws) - {SHINGLE - 1}), lambda i: array_to_string(ws[i:i+{SHINGLE - 1}], ' ')) END) AS sh FROM n),
k AS (SELECT rep, count(*) AS k FROM s GROUP BY rep),
p AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rep <> b.rep GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN k i ON p.x = i.rep JOIN k j ON p.y = j.rep WHERE 100 * c >= {round(100 * SIMILARITY)} * (i.k + j.k - c)),
r(node, root) AS (SELECT rep, rep FROM n UNION SELECT l.y, r.root FROM r JOIN l ON r.node = l.x WHERE r.root < l.y),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node),
q AS (SELECT x, sum(size) AS links FROM l JOIN n ON l.y = n.rep GROUP BY x)
SELECT w.doc_id, coalesce(m.root, w.doc_id) AS class_id, CAST(coalesce(q.links, 0) + coalesce(n.size, 1) - 1 AS BIGINT) AS n_links, coalesce(n.rep, w.doc_id) AS copy_of
FROM w LEFT JOIN n ON w.ws = n.ws LEFT JOIN m ON m.node = n.rep LEFT JOIN q ON q.x = n.rep
"""
