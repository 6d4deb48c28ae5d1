"""Language-model scores from a weighted backoff automaton.

Training. Every n-gram with a count in the training texts is an arc from its context's state; the state of a context has a
failure arc to the state of the context without its first word. Probabilities are interpolated down the orders: with c the
training counts and a weight L of the order below for each order and size of the context's count,

    P1(w) = (c(w) + 1) / (N + V + 1)        Pk(w | h) = (1 - L) c(h w) / c(h) + L Pk-1(w | h')

so an arc weighs log10 Pk(w | h) and a failure arc log10 L; the probabilities after any history sum to 1, with one share
for all unknown words. The weights L maximize the likelihood of all training tokens, each predicted from counts without
itself.

Scoring. One left-to-right traversal of a text carries its state: at each word it takes failure arcs until the state has
an arc for the word, adds up the weights and goes to the state of the longest known context.

The model is never in one place, as it grows with the corpus. Texts are dealt into blocks; a block asks for the counts of
its own n-grams by ranges of their keys and adds its training counts to the question; a range sums the counts of all
blocks and answers; a block then has the part of the automaton that its texts can reach, and traverses it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import bounded_batches, chain, distinct, hash_words, in_blocks, mix, opened, pack, pack_sorted, part_of, placed, relax, unpack, unpack_sorted, written

ORDER = 3  # words of the longest n-grams; the disk for questions grows with it
BLOCK_BYTES = 8 << 20  # of text in a block
BLOCKS_A_RANGE = 4  # a range of one order's keys answers as many n-grams as so many blocks ask for, whatever the input's size
_SHORT = np.uint64(0xFFFFFFFFFFFFF000)  # keys of two words and more keep 52 bits: what a question costs is its keys' bits
SIZES, RATIOS = 48, 130  # classes of contexts by the logarithm of their counts, and of a token's two estimates by their ratio's
_START, _END = mix(np.array([1, 2], np.uint64) * np.uint64(0xA0761D6478BD642F))  # keys of a text's start and end


class Grams:
    """Some texts as symbols, each between a start and an end, with the keys of the n-grams that end at each symbol."""

    def __init__(self, texts: list[str | None], order: int):
        words = hash_words([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
        n = np.diff(words.starts)
        self._places(n + 1)
        total = int(self.starts[-1])
        one = np.empty(total, np.uint64)
        inside = np.ones(total, bool)
        inside[self.starts[:-1]] = inside[self.starts[1:] - 1] = False
        one[inside] = words.hashes
        one[self.starts[:-1]], one[self.starts[1:] - 1] = _START, _END
        self.keys = [one]
        for _ in range(1, order):
            self.keys.append(np.concatenate([one[:1], chain(self.keys[-1][:-1], one[1:])]) & _SHORT)

    def _places(self, sizes: np.ndarray) -> None:
        self.sizes = sizes  # tokens of each text: the words and the end
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        #: A symbol's place in its text; an n-gram of k words ends at places from k - 1 on.
        self.place = np.arange(int(self.starts[-1])) - np.repeat(self.starts[:-1], sizes + 1)

    @classmethod
    def of_sizes(cls, sizes: np.ndarray) -> Grams:
        """Places alone, without the texts."""
        self = cls.__new__(cls)
        self._places(sizes)
        return self


def statistics(docs: DataFrame, text: str, train: str, parts: int) -> tuple[int, int]:
    """N and V: tokens and distinct tokens of the training texts, from all of them.

    V counts words by 56 bits of their hashes: of 100 million distinct ones 0.07 are expected to be lost.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: list[np.ndarray], n: int) -> pa.RecordBatch:
            all_ = distinct(np.concatenate([np.zeros(0, np.uint64), *keys]))
            cut = np.searchsorted(part_of(all_, parts), np.arange(parts + 1))
            full = [p for p in range(parts) if cut[p + 1] > cut[p]]
            blobs = [pack_sorted(all_[cut[p] : cut[p + 1]]) for p in full]
            return pa.RecordBatch.from_arrays([pa.array([*full, -1], pa.int32()), pa.array([*blobs, None], pa.binary()), pa.array([0] * len(full) + [n], pa.int64())], ["part", "blob", "n"])

        keys, n, held = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                texts = batch.slice(at, 512).column(0).to_pylist()
                words = hash_words([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
                keys.append(distinct(words.hashes & np.uint64(0xFFFFFFFFFFFFFF00)))
                n += len(words.hashes) + len(texts)
                held += len(keys[-1])
                if held > 1 << 21:
                    keys = [distinct(np.concatenate(keys))]
                    held = len(keys[0])
                    if held > 1 << 20:
                        yield out(keys, n)
                        keys, n, held = [], 0, 0
        yield out(keys, n)
        relax()

    def merge(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            return pa.table({"v": pa.array([0], pa.int64()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64())})
        known = distinct(np.concatenate([unpack_sorted(b) for b in table.column("blob").to_pylist()]))
        return pa.table({"v": pa.array([len(known)], pa.int64()), "n": pa.array([0], pa.int64())})

    found = bounded_batches(docs.filter(F.col(train)).select(text)).mapInArrow(gather, "part int, blob binary, n long")
    total = found.repartition(parts, "part").groupBy("part").applyInArrow(merge, "v long, n long").agg(F.sum("n"), F.sum("v")).first()
    n, v = total[0] or 0, total[1] or 0
    return n, v + (1 if n else 0)  # the end is a token


def size_class(context: np.ndarray) -> np.ndarray:
    """0 for a context without a count, then 1 and on by powers of 2."""
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, SIZES - 1), 0)


def ratios(grams: Grams, counts: list[np.ndarray], train: np.ndarray, n: int, v: int) -> np.ndarray:
    """For each order above 1 and size class how often the ratio of a training token's two estimates is in each class.

    The estimates are those of the order and of the one below (with even weights further down), without the token itself;
    class 0: the order has not seen the n-gram elsewhere; else 1 + 4 log2(ratio) + 40, within bounds.
    """
    out = np.zeros((len(counts) - 1, SIZES, RATIOS), np.int64)
    lower = np.maximum(counts[0], 1) / max(n + v, 1)
    for k in range(1, len(counts)):
        context = np.concatenate([[0], counts[k - 1][:-1]])
        here = train & (grams.place >= k) & (context > 1)
        own = np.where(context > 1, (counts[k] - 1) / np.maximum(context - 1, 1), 0.0)
        at = np.flatnonzero(here)
        r = own[at] / lower[at]
        kind = np.where(r > 0, np.clip(41 + 4 * np.log2(np.maximum(r, 1e-30)), 1, RATIOS - 1), 0).astype(np.int64)
        np.add.at(out[k - 1], (size_class(context[at]), kind), 1)
        lower = np.where(context > 1, (own + lower) / 2, lower)
    return out


def weights(counted: np.ndarray) -> np.ndarray:
    """The weight of the order below for each order above 1 and size class, by expectation maximization on the classes.

    A class without tokens takes the weight of the next smaller one; contexts with no count or one leave all to the order
    below, or half.
    """
    r = np.concatenate([[0.0], 2.0 ** ((np.arange(1, RATIOS) - 41 + 0.5) / 4)])
    out = np.ones(counted.shape[:2])
    for k, by_size in enumerate(counted):
        last = 0.5
        for b in range(1, SIZES):
            total = by_size[b].sum()
            x = last
            for _ in range(200 if total else 0):
                x = float((by_size[b] * (x / (x + (1 - x) * r))).sum() / total)
            out[k, b] = last = min(max(x, 1e-4), 1 - 1e-4)
    return out


class Automaton:
    """The states and arcs that some texts can reach: weights by n-gram, aligned with the texts' symbols."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], n: int, v: int, below: np.ndarray):
        self.grams, self.counts = grams, counts
        p = (counts[0] + 1.0) / (n + v + 1.0)
        self.base = np.log10(p)
        #: arcs[k][t]: weight of the arc of the n-gram of k + 1 words that ends at t; fails[k][t]: of the failure arc of
        #: the state of the k + 1 words before t.
        self.arcs, self.fails = [self.base], []
        for k in range(1, len(counts)):
            context = np.concatenate([[0], counts[k - 1][:-1]])
            share = np.where(grams.place >= k, below[k - 1][size_class(context)], 1.0)
            p = (1 - share) * counts[k] / np.maximum(context, 1) + share * p
            self.arcs.append(np.log10(p))
            self.fails.append(np.log10(share))

    def traverse(self) -> np.ndarray:
        """The log10 probability of each text. All texts go on together, a word at a time."""
        g, top = self.grams, len(self.arcs) - 1
        starts, sizes = g.starts[:-1], g.sizes
        rank = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[rank], sizes[rank]
        # The state of a text: the number of words of its context that the automaton knows; it begins at the text's start.
        state = np.minimum((self.counts[0][starts] > 0).astype(np.int64), top) if len(starts) else np.zeros(0, np.int64)
        score = np.zeros(len(starts))
        known = [c > 0 for c in self.counts]
        live = len(starts)
        for step in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            while sizes[live - 1] < step:
                live -= 1
            at = starts[:live] + step
            now, add = state[:live], np.zeros(live)
            arc = np.full(live, -1)
            for k in range(top, 0, -1):
                here = (now >= k) & (arc < 0)
                has = here & known[k][at]
                arc[has] = k
                add += np.where(has, self.arcs[k][at], np.where(here, self.fails[k - 1][at], 0.0))
            last = arc < 0
            add += np.where(last, self.arcs[0][at], 0.0)
            state[:live] = np.where(last, known[0][at].astype(np.int64), np.minimum(arc + 1, top)) if top else 0
            score[:live] += add
        out = np.empty(len(starts))
        out[rank] = score
        return out


def score(docs: DataFrame, train: str, keep: list[str], text: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """keep, n_tokens, n_known, train_tokens, base_score and score of each row, from a model of the rows where train holds.

    Words are runs between ASCII white space with A-Z in lower case; a text's end is a token. base_score sums
    log10((c + 1) / (N + V + 1)); score is the model's log10 probability of the text. A null text is empty and has its
    end only; a null train is false; repeated rows count as often as they stand; other columns are left out. Without
    training rows every token is unknown. keep must not hold a column named train_. Different words share a key with
    probability 2**-64, longer n-grams with
    2**-52. A block sends a range at most one message.
    """
    known = docs.withColumn("train_", F.coalesce(F.col(train), F.lit(False)))
    blocks, n_blocks = in_blocks(known, [*keep, "train_"], text, block_bytes, level=9)
    ranges = -(-n_blocks // BLOCKS_A_RANGE)  # of each order's keys; an order has its own
    n, v = statistics(known, text, "train_", n_blocks)

    def trained(rows: pa.Table, grams: Grams) -> np.ndarray:
        return np.repeat(rows.column("train_").to_numpy(zero_copy_only=False).astype(bool), grams.sizes + 1)

    def ask(table: pa.Table) -> pa.Table:
        rows = opened(table)
        grams = Grams(rows.column("text").to_pylist(), order)
        train_, part, keys, counts = trained(rows, grams), [], [], []
        for i, k in enumerate(grams.keys):
            inside = grams.place >= i
            own = distinct(k[inside])
            found, times = np.unique(k[train_ & inside], return_counts=True)
            count = np.zeros(len(own), np.uint64)
            count[np.searchsorted(own, found)] = times
            cut = np.searchsorted(part_of(own, ranges), np.arange(ranges + 1))
            for p in np.flatnonzero(np.diff(cut)).tolist():
                part.append(i * ranges + p)
                keys.append(pack_sorted(own[cut[p] : cut[p + 1]]))
                counts.append(pack(count[cut[p] : cut[p + 1]]))
        relax()
        block = pa.array([table.column("block")[0].as_py()] * len(part), pa.int32())
        return pa.table({"part": pa.array(part, pa.int32()), "block": block, "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        asked = [unpack_sorted(b) for b in table.column("keys").to_pylist()]
        own = np.concatenate([unpack(b, np.uint64) for b in table.column("counts").to_pylist()])
        order_, number, known_ = placed(np.concatenate(asked))
        total = np.zeros(len(known_), np.uint64)
        np.add.at(total, number, own[order_])
        out = np.empty(len(own), np.uint64)
        out[order_] = total[number]
        blobs = [pack(c, 6) for c in np.split(out, np.cumsum([len(k) for k in asked])[:-1])]
        relax()
        return pa.table({"block": table.column("block"), "part": table.column("part"), "counts": pa.array(blobs, pa.binary())})

    def align(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's counts beside its symbols, and what its training tokens say of the weights."""
        rows = opened(left)
        grams = Grams(rows.column("text").to_pylist(), order)
        got = dict(zip(right.column("part").to_pylist(), right.column("counts").to_pylist(), strict=True))
        aligned = []
        for i, k in enumerate(grams.keys):
            inside = np.flatnonzero(grams.place >= i)
            order_, number, own = placed(k[inside])
            counts = np.concatenate([np.zeros(0, np.uint64), *(unpack(got[p], np.uint64) for p in sorted(got) if p // ranges == i)])
            if len(counts) != len(own):
                raise RuntimeError("a block's answers don't match its n-grams")
            beside = np.zeros(len(k), np.int64)
            beside[inside[order_]] = counts[number].astype(np.int64)
            aligned.append(beside)
        seen = ratios(grams, aligned, trained(rows, grams), n, v).ravel()
        full = np.flatnonzero(seen)
        relax()
        sink = pa.BufferOutputStream()
        held = rows.select(keep)
        with pa.ipc.new_stream(sink, held.schema) as out:
            out.write_table(held)
        return pa.table({
            "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            "sizes": pa.array([pack(grams.sizes.astype(np.int64))], pa.binary()),
            "counts": pa.array([[pack(c, 9, width=1 if i else 4) for i, c in enumerate(aligned)]], pa.list_(pa.binary())),
            "place": pa.array([full.tolist()], pa.list_(pa.int32())),
            "times": pa.array([seen[full].tolist()], pa.list_(pa.int64())),
        })

    asked = blocks.groupBy("block").applyInArrow(ask, "part int, block int, keys binary, counts binary")
    answers = asked.repartitionById(ranges * order, F.col("part")).groupBy("part").applyInArrow(answer, "block int, part int, counts binary")
    joined = blocks.groupBy("block").cogroup(answers.repartitionById(n_blocks, F.col("block")).groupBy("block"))
    aligned = written(joined.applyInArrow(align, "rows binary, sizes binary, counts array<binary>, place array<int>, times array<long>"), "aligned")
    # At most (order - 1) * SIZES * RATIOS rows reach the driver.
    found = aligned.select(F.explode(F.arrays_zip("place", "times")).alias("x")).groupBy("x.place").agg(F.sum("x.times").alias("n")).collect()
    counted = np.zeros((order - 1) * SIZES * RATIOS, np.int64)
    for r in found:
        counted[r["place"]] = r["n"]
    below = weights(counted.reshape(order - 1, SIZES, RATIOS))

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sizes, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                left = pa.ipc.open_stream(rows).read_all().combine_chunks()
                grams = Grams.of_sizes(unpack(sizes, np.int64))
                machine = Automaton(grams, [unpack(c, np.int64, width=1 if i else 4) for i, c in enumerate(counts)], n, v, below)
                token, edges = grams.place > 0, grams.starts[:-1]
                base = np.add.reduceat(np.where(token, machine.base, 0.0), edges)
                hits = np.add.reduceat((token & (machine.counts[0] > 0)).astype(np.int64), edges)
                got = [pa.array(grams.sizes, pa.int64()), pa.array(hits, pa.int64()), pa.array(np.full(len(edges), n), pa.int64()), pa.array(base, pa.float64()), pa.array(machine.traverse(), pa.float64())]
                table = pa.Table.from_arrays([*left.columns, *got], [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                yield from table.to_batches()
            relax()

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    return aligned.select("rows", "sizes", "counts").mapInArrow(traverse, schema)


def document_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """score of documents, learned from those whose crc32(doc_id as text) mod 7 is not 2 (a null id counts as the empty text)."""
    held = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 7 == 2
    return score(docs.select("doc_id", "text", held.alias("held_out")).withColumn("train", ~F.col("held_out")), "train", ["doc_id", "held_out"], order=order)
