"""Benchmark decontamination by SimHash windows.

A document's windows of each item's size have fingerprints of their weighted word shingles: two blocks of 64 bits, the
signs of sums over the shingles. Which items a window is like, only the fingerprints say: two within RADIUS bits agree in
one block or the other up to half of that, so comparing the blocks with those of all items of the size finds every item
within the radius. Candidates are verified by the exact weighted shingle similarity.

Windows that cannot be like any item get no fingerprint: such a window would hold shingles of the benchmark, whatever the
item, that make SIMILARITY of its own weight. That loses nothing, and leaves few windows, however large the benchmark is.

At the similarity 0.8 fingerprints differ by 19.3 bits on average (s.d. 4.0): RADIUS lies 5 deviations above, so at the
very threshold one candidate in a million is not found. Unrelated windows differ by 64 (s.d. 5.7).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelens.llm.common import SPACE, Words, bounded_batches, distinct, hash_words, mix, relax, shingles

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 40  # bits of 128
AT_ONCE = 1024  # windows, and items, that are compared at once
ITEMS_AT_ONCE, BYTES_AT_ONCE = 65_536, 64 << 20  # of the benchmark in one pass over the documents


def read_words(texts: list[str | None]) -> Words:
    return hash_words([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts])


def weighted(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the k words from each place, and their weights: the characters of the words."""
    keys = shingles(words, k)
    total = np.concatenate([[0], np.cumsum(words.sizes)])
    return keys, (total[k : len(keys) + k] - total[: len(keys)]).astype(np.float64)


def _signs(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row for each shingle, a column for each bit of the fingerprint: its weight, or less its weight.

    A fingerprint's angle goes with the squares of these, so they are the roots of the similarity's weights.
    """
    bits = np.stack([keys, mix(keys ^ np.uint64(0xD6E8FEB86659FD93))], axis=1).astype("<u8").view(np.uint8)
    on = np.unpackbits(bits, axis=1, bitorder="little").view(np.int8)
    return (2 * on - 1) * np.round(16 * np.sqrt(weights)).astype(np.int32)[:, None]


def _prints(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, two blocks of 64 bits each, from sums of signs."""
    return np.packbits(sums, axis=1, bitorder="little").view("<u8")


class Index:
    """Some benchmark items: their bags of shingles, their fingerprints by size, and all their shingles as a set."""

    def __init__(self, items: list[tuple[object, str | None]]):
        items = [(i, t) for i, t in items if t and t.strip(SPACE.decode())]
        words = read_words([t for _, t in items])
        self.ids = [i for i, _ in items]
        self.length = np.diff(words.starts)
        self.k = np.minimum(self.length, SHINGLE)  # a short item is one shingle of all its words
        self.bags: list[dict[int, tuple[int, float]]] = []
        self.total: list[float] = []
        prints = []
        for i in range(len(items)):
            k = int(self.k[i])
            a, b = int(words.starts[i]), int(words.starts[i + 1])
            keys, weights = weighted(Words(words.hashes[a:b], words.sizes[a:b], np.array([0, b - a])), k)
            bag: dict[int, tuple[int, float]] = {}
            for key, w in zip(keys.tolist(), weights.tolist(), strict=True):
                bag[key] = (bag.get(key, (0, w))[0] + 1, w)
            self.bags.append(bag)
            self.total.append(float(weights.sum()))
            prints.append(_prints(_signs(keys, weights).sum(axis=0, dtype=np.int64)[None, :] > 0)[0])
        self.prints = np.array(prints, np.uint64).reshape(-1, 2)
        #: words of a shingle -> words of a window -> the items of that size, and the least weight of an item
        self.sizes: dict[int, dict[int, np.ndarray]] = {}
        for i, n in enumerate(self.length.tolist()):
            self.sizes.setdefault(min(n, SHINGLE), {}).setdefault(n, []).append(i)
        self.sizes = {k: {n: np.array(own) for n, own in sorted(of.items())} for k, of in self.sizes.items()}
        self.known = {k: distinct(np.array([x for own in of.values() for i in own.tolist() for x in self.bags[i]], np.uint64)) for k, of in self.sizes.items()}
        self.least = {k: min(self.total[i] for own in of.values() for i in own.tolist()) for k, of in self.sizes.items()}
        self.maps = {}
        for k, known in self.known.items():
            low = np.uint64((1 << max(16, int(len(known) * 32).bit_length())) - 1)
            there = np.zeros(int(low) + 1, bool)
            there[(known & low).astype(np.int64)] = True
            self.maps[k] = low, there

    def within(self, prints: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of fingerprints and the items that differ from them by RADIUS bits or less: all such pairs.

        Of two fingerprints that close, one block or the other differs by half the radius or less, so only those pairs
        are compared as a whole.
        """
        near = [np.bitwise_count(prints[:, None, b] ^ self.prints[None, items, b]) for b in (0, 1)]
        at, item = np.nonzero((near[0] <= RADIUS // 2) | (near[1] <= RADIUS // 2))
        close = near[0][at, item].astype(np.int16) + near[1][at, item] <= RADIUS
        return at[close], items[item[close]]

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """For each text the items in it: item's place, start word, bits that differ, similarity; an item's best window."""
        words = read_words(texts)
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        near: dict[tuple[int, int], list[np.ndarray]] = {}
        shingled = {}
        for k, of in self.sizes.items():
            shingled[k] = keys, weights = weighted(words, k)
            if not len(keys):
                continue
            # Places whose shingle is in any item: a bit map over low bits clears nearly all, the rest are looked up.
            known, (low, there) = self.known[k], self.maps[k]
            at = np.flatnonzero(there[(keys & low).astype(np.int64)])
            at = at[known[np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)] == keys[at]]
            owner = np.searchsorted(words.starts, at, side="right") - 1
            whole = at + k <= words.starts[owner + 1]
            at, owner = at[whole], owner[whole]
            largest = max(of)
            cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(at) > largest)) + 1
            for run in np.split(np.arange(len(at)), cut) if len(at) else ():
                if weights[at[run]].sum() >= SIMILARITY * self.least[k]:
                    d = int(owner[run[0]])
                    for i, places in self._near(keys, weights, k, at[run], int(words.starts[d]), int(words.starts[d + 1])):
                        near.setdefault((d, i), []).append(places)
        for (d, i), places in sorted(near.items()):
            k = int(self.k[i])
            if best := self._best(*shingled[k], words, k, d, i, np.unique(np.concatenate(places))):
                out[d].append(best)
        return out

    def _near(self, keys: np.ndarray, weights: np.ndarray, k: int, hits: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
        """Items, and places in the text from lo to hi where a window's fingerprint is near the item's, around some hits.

        hits: places (ascending) of shingles that stand in the benchmark. A window similar to any item holds shingles of
        the benchmark that make SIMILARITY of its weight or more; the others get no fingerprint, which loses nothing.
        """
        largest = max(self.sizes[k])
        a, z = max(int(hits[0]) - largest + 1, lo), min(int(hits[-1]) + largest, hi - k + 1)
        weight = weights[a:z]
        own = np.concatenate([[0.0], np.cumsum(weight)])
        held = np.zeros(len(weight))
        held[hits - a] = weights[hits]
        held = np.concatenate([[0.0], np.cumsum(held)])
        sums = None
        for size, items in self.sizes[k].items():
            n = min(size, hi - lo) - k + 1
            if n > len(weight):
                continue
            start = np.flatnonzero(held[n:] - held[:-n] >= SIMILARITY * (own[n:] - own[:-n]) - 1e-6)
            if not len(start):
                continue
            if sums is None:
                sums = np.zeros((len(weight) + 1, 128), np.int64)
                np.cumsum(_signs(keys[a:z], weight), axis=0, dtype=np.int64, out=sums[1:])
            for at in range(0, len(start), AT_ONCE):
                part = start[at : at + AT_ONCE]
                for first in range(0, len(items), AT_ONCE):
                    place, item = self.within(_prints(sums[part + n] > sums[part]), items[first : first + AT_ONCE])
                    for i in np.unique(item).tolist():
                        yield i, a + part[place[item == i]]

    def _best(self, keys: np.ndarray, weights: np.ndarray, words: Words, k: int, d: int, i: int, places: np.ndarray) -> tuple[int, int, int, float] | None:
        """The item's best window of its own size around the places (ascending) that fingerprints found; None below SIMILARITY."""
        size, lo, hi = int(self.length[i]), int(words.starts[d]), int(words.starts[d + 1])
        n, total, bag = min(size, hi - lo) - k + 1, self.total[i], self.bags[i]
        last = hi - (n + k - 1)  # where the text's last window starts
        best = None
        for run in np.split(places, np.flatnonzero(np.diff(places) > size) + 1):
            a, b = int(run[0]), min(int(run[-1]), last)
            # The bag slides over the places: a shingle comes, one goes.
            line, ws = keys[a : b + n].tolist(), weights[a : b + n].tolist()
            seen: defaultdict[int, int] = defaultdict(int)
            shared = own = 0.0
            for at, (key, w) in enumerate(zip(line, ws, strict=True)):
                if at >= n:
                    old = line[at - n]
                    own -= ws[at - n]
                    if old in bag and seen[old] <= bag[old][0]:
                        shared -= bag[old][1]
                    seen[old] -= 1
                seen[key] += 1
                own += w
                if key in bag and seen[key] <= bag[key][0]:
                    shared += bag[key][1]
                if at >= n - 1:
                    similarity = shared / (own + total - shared)
                    if similarity >= SIMILARITY and (best is None or similarity > best[1]):
                        best = (a + at - n + 1, similarity)
        if best is None:
            return None
        print_ = _prints(_signs(keys[best[0] : best[0] + n], weights[best[0] : best[0] + n]).sum(axis=0, dtype=np.int64)[None, :] > 0)[0]
        return i, best[0] - lo, int(np.bitwise_count(print_ ^ self.prints[i]).sum()), best[1]


def indexes(items: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[Index]:
    """The benchmark as indexes of bounded size, one after another."""
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    n = max(1, -(-size["n"] // (ITEMS_AT_ONCE // 2)), -(-(size["b"] or 0) // (BYTES_AT_ONCE // 2)))
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64(key, text), F.lit(n)) == b).select(key, text).distinct().collect()
        for at in range(0, len(rows), ITEMS_AT_ONCE):
            yield Index(sorted(map(tuple, rows[at : at + ITEMS_AT_ONCE]), key=repr))


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """key, item, start_word, n_words, bits and similarity of every document that holds an item: its best window.

    Words are runs between ASCII white space, in lower case; shingles are of SHINGLE words and weigh their characters;
    similarity is the weighted Jaccard similarity of the two bags of shingles, SIMILARITY or more. Null and empty texts
    and items have no words and match nothing; an item of fewer words than a shingle is one shingle. Repeated documents
    give repeated rows, repeated items count once; other columns are left out; an empty benchmark gives an empty result.
    """
    kind, item_kind = dict(docs.dtypes)[key], dict(items.dtypes)[item]
    schema = f"`{key}` {kind}, `{item}` {item_kind}, start_word long, n_words long, bits int, similarity double"
    names = [key, item, "start_word", "n_words", "bits", "similarity"]
    item_type = to_arrow_type(items.schema[item].dataType)
    out = None
    for index in indexes(items, item):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    hits = [(d, *m) for d, found in enumerate(index.matches(part.column(1).to_pylist())) for m in found]
                    if hits:
                        where, which, starts, bits, similar = zip(*hits, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column(0).take(pa.array(where)),
                                pa.array([index.ids[i] for i in which], item_type),
                                pa.array(starts, pa.int64()),
                                pa.array([int(index.length[i]) for i in which], pa.int64()),
                                pa.array(bits, pa.int32()),
                                pa.array(similar, pa.float64()),
                            ],
                            names,
                        )

        found = bounded_batches(docs.select(key, text)).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of docs in which find finds no item, with all their columns.

    Null and empty texts hold no item and stay; repeated rows stay or go together; an empty benchmark keeps all.
    """
    where = docs.columns.index(text)
    for index in indexes(items, item):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    yield part.filter(pa.array([not m for m in held.value.matches(part.column(where).to_pylist())], pa.bool_()))
            relax()

        docs = bounded_batches(docs).mapInArrow(run, docs.schema)
    return docs


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words and similarity (to 9 places) of what find finds."""
    return find(docs, items).select("doc_id", "item_id", "start_word", "n_words", F.round("similarity", 9).alias("similarity"))


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_SHINGLES = "array_to_string(w[o:o+k-1], ' ') AS s, list_sum(list_transform(w[o:o+k-1], lambda x: strlen(x))) AS c"
#: All windows that share a shingle with an item, by plain joins, without fingerprints.
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, len(w) AS n, least(len(w), {SHINGLE}) AS k FROM (SELECT item_id, {_WORDS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)) WHERE len(w) > 0),
g AS (SELECT item_id, n, k, s, c, count(*) AS m FROM (SELECT item_id, n, k, {_SHINGLES} FROM i, LATERAL (SELECT unnest(generate_series(1, n - k + 1)) AS o)) GROUP BY ALL),
t AS (SELECT item_id, any_value(n) AS n, sum(m * c) AS total FROM g GROUP BY 1),
x AS (SELECT doc_id, len(w) AS l, o, k, {_SHINGLES} FROM (SELECT * FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k), LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS o)),
h AS (SELECT DISTINCT x.doc_id, g.item_id, o, l, n, g.k FROM x JOIN g ON x.s = g.s AND x.k = g.k),
p AS (SELECT DISTINCT doc_id, item_id, k, least(l, n) - k + 1 AS size, a FROM h, LATERAL (SELECT unnest(generate_series(greatest(o - (least(l, n) - k), 1), least(o, l - least(l, n) + 1))) AS a)),
y AS (SELECT p.doc_id, p.item_id, p.a, x.s, x.c, count(*) AS m FROM p JOIN x ON x.doc_id = p.doc_id AND x.k = p.k AND x.o >= p.a AND x.o < p.a + p.size GROUP BY ALL),
z AS (SELECT y.doc_id, y.item_id, y.a, sum(y.m * y.c) AS own, sum(least(y.m, coalesce(g.m, 0)) * y.c) AS shared FROM y LEFT JOIN g ON g.item_id = y.item_id AND g.s = y.s GROUP BY 1, 2, 3),
v AS (SELECT z.doc_id, z.item_id, z.a, t.n, shared / (own + total - shared) AS similarity FROM z JOIN t ON t.item_id = z.item_id),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, a) AS q FROM v WHERE similarity >= {SIMILARITY})
SELECT doc_id, item_id, CAST(a - 1 AS BIGINT) AS start_word, CAST(n AS BIGINT) AS n_words, round(similarity, 9) AS similarity FROM r WHERE q = 1
"""
