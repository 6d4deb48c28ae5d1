"""Tables between jobs, and the compact messages that blocks of documents exchange with key ranges."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.sources.scratch import scratch_path, shared_dir, written

__all__ = ["scratch_path", "shared_dir", "written"]  # and what follows

BATCH_ROWS = 1000  # texts that go to a Python worker at once


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches bounded to BATCH_ROWS rows: whole texts are large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def relax() -> None:
    """Gives freed memory back, as a Python worker outlives its task. Without glibc only Arrow's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        return


# ---- messages -----------------------------------------------------------------------------------------------------


def pack(values: np.ndarray, level: int = 1, width: int = 1) -> bytes:
    """An integer array as bytes: a plane for every width bytes of the items, then zstd, so small or sorted values cost little."""
    a = np.ascontiguousarray(values)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize // width, width).transpose(1, 0, 2)
    return zstandard.ZstdCompressor(level=level).compress(planes.tobytes())


def unpack(blob: bytes, dtype, n: int | None = None, width: int = 1) -> np.ndarray:
    """The array that pack() took."""
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    planes = raw.reshape(size // width, -1, width).transpose(1, 0, 2)
    out = np.ascontiguousarray(planes).reshape(-1).view(dtype)
    if n is not None and len(out) != n:
        raise ValueError("a message has lost items")
    return out


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit keys, as differences."""
    return pack(np.diff(keys.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def distinct(keys: np.ndarray) -> np.ndarray:
    """The ascending distinct values, by sorting: many times faster on 64-bit keys than a hash table."""
    keys = np.sort(keys)
    return keys[np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))] if len(keys) else keys


def placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts the keys, for each key in that order its number among the distinct ones, and those."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(keys) else np.zeros(0, bool)
    return order, np.cumsum(first) - 1, ranked[first]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves about half of the output's."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of a sequence from the key of all but its last item and the key of the last."""
    with np.errstate(over="ignore"):
        return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


# ---- blocks -------------------------------------------------------------------------------------------------------

BLOCK_BYTES = 16 << 20
BUNDLE_BYTES = 16 << 20  # of rows that a task deals into blocks at once


def in_blocks(docs: DataFrame, keep: list[str], text: str = "text", block_bytes: int = BLOCK_BYTES, level: int = 6) -> tuple[DataFrame, int]:
    """docs' columns in keep and text (null: empty), dealt into blocks of about block_bytes of text, and the number of blocks.

    Rows are block and rows: the rows that a task has for the block, compressed together at a zstd level (see opened). A row's block
    follows from its own values, so a lost task rebuilds the same block, and a hot source or many copies with ids of their
    own spread over all blocks.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.pmod(F.xxhash64(*keep, body), F.lit(n)).cast("int").alias("block"), *keep, body.alias("text"))

    def deal(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        blocks = table.column(0).to_numpy()
        order = np.argsort(blocks, kind="stable")
        ordered = table.select([*keep, "text"]).take(pa.array(order))
        first = np.flatnonzero(np.diff(blocks[order], prepend=-1))
        options, blobs = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level)), []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(blocks)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ordered.schema, options=options) as out:
                out.write_table(ordered.slice(a, b - a).combine_chunks())
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(blocks[order][first], pa.int32()), pa.array(blobs, pa.binary())], ["block", "rows"])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= BUNDLE_BYTES:
                yield deal(held)
                held, size = [], 0
        if held:
            yield deal(held)
        relax()

    return bounded_batches(rows).mapInArrow(bundle, "block int, rows binary").repartitionById(n, F.col("block")), n


def opened(table: pa.Table) -> pa.Table:
    """The rows of a block."""
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table.column("rows").to_pylist()]).combine_chunks()


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range of the 64-bit key space that each key lies in, from 0 to parts - 1; ascending in the key."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


# ---- words --------------------------------------------------------------------------------------------------------

#: Fixed value: the white space that separates words, \x20 and \x09-\x0D.
SPACE = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so its powers have inverses modulo 2**64
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and their inverses, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


class Words(NamedTuple):
    """The words of some texts one after another."""

    hashes: np.ndarray  # 64 bits of each word's bytes
    sizes: np.ndarray  # bytes
    starts: np.ndarray  # of each text's words, and the end of the last's

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1, dtype=np.int32), np.diff(self.starts))


def _hash_words(texts: list[bytes]) -> Words:
    whole = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _IS_SPACE[whole]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        turns = np.concatenate([[0], turns])
    first, end = turns[0::2], turns[1::2]
    power, inverse = _powers(len(whole))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(whole * power, dtype=np.uint64)])
    size = end - first
    hashes = mix((sums[end] - sums[first]) * inverse[first] + size.astype(np.uint64) * _M1)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    return Words(hashes, size, np.searchsorted(first, bounds))


def hash_words(texts: list[bytes], at_once: int = 1 << 19) -> Words:
    """Hashes of the words of texts in UTF-8: a word's bytes are digits of a number modulo 2**64, then mixed.

    All words of a text are read with a few passes over its bytes. Different words share a hash with a chance of 2**-64.
    """
    parts, group, held = [], [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= at_once:
            parts.append(_hash_words(group))
            group, held = [], 0
    if group or not parts:
        parts.append(_hash_words(group)) if group else parts.append(Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)))
    if len(parts) == 1:
        return parts[0]
    shift = np.cumsum([0, *(len(p.hashes) for p in parts)])
    return Words(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)), np.concatenate([parts[0].starts[:1], *(p.starts[1:] + s for p, s in zip(parts, shift, strict=False))]))


def shingles(words: Words, k: int) -> np.ndarray:
    """Keys of the k words from each place; those that run over a text's end must not be used."""
    n = max(len(words.hashes) - k + 1, 0)
    keys = words.hashes[:n].copy()
    for i in range(1, k):
        keys = chain(keys, words.hashes[i : n + i])
    return keys


# ---- groups -------------------------------------------------------------------------------------------------------


def whole_groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Batches sorted by an integer column as tables in which every group of equal keys is whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and last != keys[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


HOT_NODES = 100_000  # most nodes of a high degree that are broadcast: a bound by construction


def _with_least(pairs: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """Pairs u, v with m, the least that belongs to u; least: w, m and degree, a row for each u.

    Nodes of a degree above all but HOT_NODES can have are few, so their row is broadcast to wherever their pairs lie; a
    shuffle deals the others, none of which fills a task.
    """
    hot = F.col("degree") > max(1000, 2 * edges // HOT_NODES)
    known = pairs.join(F.broadcast(least.filter(hot).select("w", "m")), F.col("u") == F.col("w"), "left").drop("w")
    rest = known.filter("m IS NULL").select("u", "v").join(least.filter(~hot).select("w", "m"), F.col("u") == F.col("w"))
    return known.filter("m IS NOT NULL").select("u", "v", "m").unionByName(rest.select("u", "v", "m"))


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node that it is joined with) of every node of undirected edges a, b; loops are ignored.

    Large-star and small-star steps take turns until the edges are stars: each step links a node's neighbours to the
    least of them, with an aggregation and a join, so a node of any degree stays spread over many rows.
    """
    now = written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    while True:
        n = now.count()
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("w", F.least("w", "m").alias("m"), "degree")
        large = _with_least(both.filter("v > u"), least, n).select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = written(large.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "large")
        least = down.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = _with_least(down, least, n).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = written(small.unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b"))).distinct(), "stars")
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("r")), F.struct(F.col("b").alias("n"), F.col("b").alias("r")))).alias("x")).select("x.n", "x.r")
        # Stars: a node has one root, and a root is its own.
        if ends.groupBy("n").agg(F.min("r").alias("p"), F.max("r").alias("q")).filter("p <> q").isEmpty():
            return ends.distinct().select(F.col("n").alias("node"), F.col("r").alias("root"))
