"""Quality rules by line labelling.

A linear-chain conditional random field labels each line of a text as content or boilerplate; Viterbi decoding gives the
most likely sequence of labels, and a document stays if enough of its words stand in content lines. The field is trained
here, on a bounded sample of labelled documents whose lines take the document's label.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import bounded_batches, relax

TRAIN_ROWS = 2000  # labelled documents at most that the field is trained on, by the smallest hash of their ids
TRAIN_BYTES = 1 << 20  # of a text that the field is trained on at most; longer ones are left out of the training
CONTENT_SHARE = 0.5  # of a document's words, from which it is kept
MIN_WORDS, MAX_REPEATED = 50, 0.5  # base rules: fewer words, or a larger share of them in repeated windows, fail

_SPACE, _SYMBOLS, _UPPER = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
#: Words of English notices, in lower case: one feature of FEATURES; other languages go by the rest.
NOTICES = tuple(x.encode() for x in "copyright,license,licence,all rights reserved,cookie,privacy policy,subscribe,click here,sign up,login,http://,https://".split(","))
FEATURES = 13


def _without(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_IS_SPACE, _IS_SYMBOL, _IS_UPPER, _IS_SHOUT, _IS_DIGIT = map(_class, (_SPACE, _SYMBOLS, _UPPER, b"!?", b"0123456789"))
_IS_OTHER = ~_class(_LETTERS + _SPACE)
_IS_END = _class(b".!?:;\"'")


class Lines:
    """The lines with a word of some texts: features, words, and where each text's begin."""

    def __init__(self, texts: list[bytes]):
        whole = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        ends = np.flatnonzero(whole == 10)
        edges = np.concatenate([[0], ends + 1])

        def per_line(mask: np.ndarray) -> np.ndarray:
            return np.diff(np.searchsorted(np.flatnonzero(mask), edges)).astype(np.float64)

        space = _IS_SPACE[whole]
        first = ~space
        first[1:] &= space[:-1]
        last = np.flatnonzero(~space[:-1] & space[1:])  # a word's last byte; the added line end closes the last word
        words = per_line(first)
        chars = np.diff(edges) - per_line(space)
        seen, notice, number, own = [], [], [], [0]
        for text in texts:
            above: set[bytes] = set()
            low = text.lower()
            some = any(n in low for n in NOTICES)
            for i, line in enumerate(text.split(b"\n")):
                seen.append(line in above)
                above.add(line)
                notice.append(some and any(n in line.lower() for n in NOTICES))
                number.append(i)
            own.append(len(seen))
        if not texts:
            seen, notice, number = [False], [False], [0]
        real = words > 0
        n, c = words[real], chars[real]
        other, upper, symbols = per_line(_IS_OTHER[whole])[real], per_line(_IS_UPPER[whole])[real], per_line(_IS_SYMBOL[whole])[real]
        letters = c - other
        final = whole[last[np.searchsorted(last, edges[1:][real]) - 1]] if len(last) else whole[:0]
        self.features = np.stack(
            [
                np.ones(len(n)),
                np.minimum(symbols / n, 2.0),
                symbols * 5 >= n,
                np.minimum(per_line(_IS_SHOUT[whole])[real] / n, 2.0),
                (2 * upper >= letters) & (letters > 0),
                per_line(_IS_DIGIT[whole])[real] / c,
                other / c,
                n <= 3,
                n >= 12,
                _IS_END[final],
                np.array(seen)[real],
                np.minimum(c / n / 10.0, 2.0),
                np.array(notice)[real],
            ],
            axis=1,
        ).astype(np.float64)
        self.words = n.astype(np.int64)
        self.numbers = np.array(number)[real].tolist()
        self.starts = np.concatenate([[0], np.cumsum(real)])[own].tolist()


class Field:
    """Weights of the chain: features to labels (0 boilerplate, 1 content), and label to next label."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((FEATURES, 2)) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi: the most likely labels of one sequence of lines; content where both are as likely."""
        if not len(features):
            return np.zeros(0, np.int8)
        scores = (features @ self.emit).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            a0, b0, a1, b1 = a + m00, b + m10, a + m01, b + m11
            back.append((int(b0 >= a0), int(b1 >= a1)))
            a, b = max(a0, b0) + x, max(a1, b1) + y
        labels = [int(b >= a)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return np.array(labels[::-1], np.int8)

    def fit(self, lines: Lines, targets: list[int], rounds: int = 150, rate: float = 0.2, decay: float = 1e-3) -> Field:
        """Maximum likelihood with a quadratic penalty, by Adam; all sequences advance together, a line at a time."""
        sizes = np.diff(lines.starts)
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        first, sizes = np.array(lines.starts)[order], sizes[order]
        y = np.array(targets)[order]
        steps = int(sizes[0]) if len(sizes) else 0
        active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(steps)]  # sequences longer than t
        n = int(sizes.sum())
        label = np.repeat(np.array(targets), np.diff(lines.starts))
        x = lines.features
        hit = np.zeros((FEATURES, 2))
        for k in (0, 1):
            hit[:, k] = x[label == k].sum(axis=0)
        moved = np.diag([float((sizes[y == k] - 1).sum()) for k in (0, 1)])
        w = np.zeros(FEATURES * 2 + 4)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for turn in range(1, rounds + 1):
            emit, move = w[: FEATURES * 2].reshape(FEATURES, 2), w[FEATURES * 2 :].reshape(2, 2)
            s = x @ emit
            alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
            for t in range(steps):
                at = first[: active[t]] + t
                alpha[at] = s[at] if t == 0 else s[at] + np.logaddexp(alpha[at - 1, :1] + move[0], alpha[at - 1, 1:] + move[1])
            for t in range(steps - 2, -1, -1):
                at = first[: active[t + 1]] + t
                nxt = s[at + 1] + beta[at + 1]
                beta[at] = np.stack([np.logaddexp(move[i, 0] + nxt[:, 0], move[i, 1] + nxt[:, 1]) for i in (0, 1)], axis=1)
            total = np.zeros(n)
            ends = np.logaddexp(alpha[first + sizes - 1, 0], alpha[first + sizes - 1, 1])
            for z, a, k in zip(ends, first, sizes, strict=True):
                total[a : a + k] = z
            p = np.exp(alpha + beta - total[:, None])
            inner = np.ones(n, bool)
            inner[first] = False
            at = np.flatnonzero(inner)
            pairs = np.zeros((2, 2))
            for i in (0, 1):
                for j in (0, 1):
                    pairs[i, j] = np.exp(alpha[at - 1, i] + move[i, j] + s[at, j] + beta[at, j] - total[at]).sum()
            g = -np.concatenate([(hit - x.T @ p).ravel(), (moved - pairs).ravel()]) / n + decay * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
        return Field(w[: FEATURES * 2].reshape(FEATURES, 2).copy(), w[FEATURES * 2 :].reshape(2, 2).copy())


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Field:
    """The field trained on the documents of the rows smallest hashes of labelled ids, of any type that can be ordered.

    At most rows documents of at most TRAIN_BYTES each reach the driver, as features of their lines: of repeated rows of
    an id that with the least text is taken.

    Labels: doc_id, quality (0 or 1; others and nulls are left out, an id with both values too). Without documents of
    both qualities the field is untrained and takes every line for content.
    """
    one = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_q"), F.max("quality").alias("_q2")).filter("_q = _q2")
    chosen = one.select(F.col("doc_id").alias("_id"), "_q").orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # At most `rows` ids: small enough to broadcast by construction.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).filter((F.octet_length("text") <= TRAIN_BYTES) | F.col("text").isNull())
    # A row for each id: the least of repeated rows' texts.
    found = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_q").cast("int").alias("_q"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, q in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = Lines([(text or "").encode()]).features
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], key.type), pa.array([q], pa.int32()), pa.array([x.ravel()], pa.list_(pa.float64()))], ["k", "q", "x"])

    got = bounded_batches(found).mapInArrow(featured, f"k {dict(docs.dtypes)['doc_id']}, q int, x array<double>").collect()
    got.sort(key=lambda r: r["k"])
    if len({r["q"] for r in got}) < 2:
        return Field()
    lines = Lines([])
    parts = [np.array(r["x"]).reshape(-1, FEATURES) for r in got]
    lines.features = np.concatenate(parts)
    lines.starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).tolist()
    return Field().fit(lines, [r["q"] for r in got])


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = data.split()
    n = len(words)
    chars = _without(data, bytes(x for x in range(256) if not 0x80 <= x < 0xC0)) - _without(data, _SPACE)
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += bool(line.strip(_SPACE))
        else:
            seen.add(line)
    repeated = 0
    if n > 3:
        local: defaultdict[bytes, int] = defaultdict(count().__next__)
        ids = np.fromiter(map(local.__getitem__, words), np.int64, n)
        if len(local) < 1 << 21:
            keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        else:
            pairs = np.unique(ids[:-1] * len(local) + ids[1:], return_inverse=True)[1]
            keys = pairs[:-1] * len(local) + ids[2:]
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : n - 2 + k] |= again
        repeated = int(cover.sum())
    return n, chars, _without(data, _SYMBOLS), dup, repeated


def verdict(data: bytes, lines: Lines, a: int, b: int, field: Field, share: float) -> tuple[tuple[int, int, int, int, int], bool, float, bool]:
    """Base counts, base_failed, the share of words in content lines and kept, of a text whose lines are a to b of lines."""
    counts = base_counts(data)
    n, repeated = counts[0], counts[4]
    failed = n < MIN_WORDS or repeated > MAX_REPEATED * n
    good = field.decode(lines.features[a:b]) > 0
    content = float(lines.words[a:b][good].sum()) / n if n else 0.0
    return counts, failed, content, not failed and content >= share


def judge(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share and kept of each row.

    A null or empty text has no words, fails the base rules and has the share 0. Repeated rows give repeated rows; a null
    key stays null; other columns are left out; an empty table gives an empty result. Texts are taken whole.
    """
    names = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                lines = Lines(texts)
                rows = []
                for i, data in enumerate(texts):
                    counts, *rest = verdict(data, lines, lines.starts[i], lines.starts[i + 1], field, share)
                    rows.append((*counts, *rest))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    return bounded_batches(docs.select(key, text)).mapInArrow(run, schema)


def label_lines(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 0) and content of each line with a word.

    A null or empty text has no lines and no rows; repeated rows give repeated rows; a null key stays null; other columns
    are left out; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                lines = Lines([(t or "").encode()])
                good = field.decode(lines.features) > 0
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(good), k.type), pa.array(lines.numbers, pa.int32()), pa.array(good, pa.bool_())], [key, "line", "content"])

    return bounded_batches(docs.select(key, text)).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, line int, content boolean")


def keep(docs: DataFrame, field: Field, text: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of docs that judge keeps, with all their columns."""
    schema = docs.schema
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for at in range(0, batch.num_rows, 512):
                texts = [(t or "").encode() for t in batch.column(where).slice(at, 512).to_pylist()]
                lines = Lines(texts)
                kept += [verdict(data, lines, lines.starts[i], lines.starts[i + 1], field, share)[3] for i, data in enumerate(texts)]
            yield batch.filter(pa.array(kept, pa.bool_()))
        relax()

    return bounded_batches(docs).mapInArrow(run, schema)
