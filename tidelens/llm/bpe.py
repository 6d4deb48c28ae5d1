"""BPE by a distinct-word table.

Texts are dealt into blocks and split into words. Each block asks for its distinct words by ranges of the words' hashes;
a range puts the questions of all blocks together and encodes each distinct word once; the answers go back to the blocks,
where the ids are joined to the words' positions. Decoding looks every id up in the table of pieces, which is as large as
the vocabulary.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import defaultdict
from functools import cached_property, lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.llm.common import BLOCK_BYTES, bounded_batches, in_blocks, opened, pack, part_of, relax, unpack

#: Characters whose classes and lower case every Unicode version shares; other texts take the library's own steps.
_PLAIN = re.compile(r"[\x09-\x0d\x20-\x7e\xa0-ɏ]*")
#: Words that one call of the library encodes.
_AT_ONCE = 256
RANGE_BYTES = 48 << 20


class Splitter:
    """A tokenizer file's words and their ids.

    A word is a run of a text that the file's split pattern never crosses the ends of: between white space in plain texts,
    a piece of the library's own split in others, or a special token after a space, which no other word holds. So a text's ids are its words' ids in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        self.inner = Tokenizer.from_file(path)  # for words, which are normalized already
        self.inner.no_truncation()
        self.inner.no_padding()
        self.inner.normalizer = normalizers.Sequence([])
        self.inner.encode_special_tokens = True

    def _part(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text) and unicodedata.is_normalized("NFC", text):
            return text.lower().split()
        norm = self.tok.normalizer.normalize_str(text)
        return [norm[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(norm)]

    def words(self, text: str) -> list[str]:
        if not self.special or not self.cut.search(text):
            return self._part(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self._part(text[at : m.start()]), " " + m[0]]
            at = m.end()
        return out + self._part(text[at:])

    def ids(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word. Words are joined by spaces for the library and told apart by where their pieces start."""
        out: list[np.ndarray] = []
        for i in range(0, len(words), _AT_ONCE):
            part = words[i : i + _AT_ONCE]
            found = self.inner.encode(" ".join("" if w[0] == " " else w for w in part), add_special_tokens=False)
            ends = np.cumsum([1 if w[0] == " " else len(w) + 1 for w in part])
            at = np.searchsorted(np.array([a for a, _ in found.offsets], np.int64), ends)
            out += np.split(np.array(found.ids, np.uint32), at[:-1])
        return [np.array([self.special[w[1:]]], np.uint32) if w[0] == " " else x for w, x in zip(words, out, strict=True)]

    @cached_property
    def pieces(self) -> list[str]:
        """The table of pieces by id."""
        n = self.tok.get_vocab_size(with_added_tokens=True)
        return [self.tok.id_to_token(i) or "" for i in range(n)]


@lru_cache(maxsize=4)
def splitter(path: str) -> Splitter:
    return Splitter(path)


def _distinct(split: Splitter, texts: list[str], parts: int) -> tuple[list[np.ndarray], list[list[str]]]:
    """Each text as indices of its words, and the distinct words by range; indices run through the ranges in order."""
    local: defaultdict[str, int] = defaultdict(count().__next__)
    seqs = []
    for t in texts:
        words = split.words(t)
        seqs.append(np.fromiter(map(local.__getitem__, words), np.int32, len(words)))
    vocab = list(local)
    keys = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in vocab), np.uint64, len(vocab))
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(vocab), np.int32)
    rank[order] = np.arange(len(vocab), dtype=np.int32)
    ends = np.searchsorted(part_of(keys[order], parts), np.arange(parts), side="right").tolist()
    ordered = list(map(vocab.__getitem__, order.tolist()))
    return [rank[s] for s in seqs], [ordered[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def encode(docs: DataFrame, path: str, keep: str = "doc_id", text: str = "text", output: str = "digest", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ids of each text under the tokenizer file at path, and the text that they decode to.

    output "ids": keep, n_tokens, ids (array of int), decoded. output "digest": keep, n_tokens, ids_sha256 (of the decimal
    ids joined by one space) and decoded_sha256. Equal to the library's encode without special tokens added, truncation
    or padding; special tokens that stand in a text are their own ids. A null text is empty and has no ids; null keys,
    repeated rows and ties stay as they are; an empty table gives an empty result; other columns are left out. path must
    be readable on the executors. Smaller blocks take less memory and more disk, as fewer words of a block are equal.
    """
    blocks, n_blocks = in_blocks(docs, [keep], text, block_bytes)
    # A range answers for about RANGE_BYTES of text, however large the blocks are; a block sends it at most one message.
    parts = -(-n_blocks * block_bytes // RANGE_BYTES)

    def ask(table: pa.Table) -> pa.Table:
        _, ranges = _distinct(splitter(path), opened(table).column("text").to_pylist(), parts)
        filled = [(p, words) for p, words in enumerate(ranges) if words]
        block = table.column("block")[0].as_py()
        return pa.table({
            "part": pa.array([p for p, _ in filled], pa.int32()),
            "block": pa.array([block] * len(filled), pa.int32()),
            "blob": pa.array([pack(np.frombuffer("\n".join(words).encode("utf-8", "surrogatepass"), np.uint8)) for _, words in filled], pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        asked = [unpack(x, np.uint8).tobytes().decode("utf-8", "surrogatepass").split("\n") for x in table.column("blob").to_pylist()]
        known = list(dict.fromkeys(w for words in asked for w in words))  # each distinct word of the range is encoded once
        at = dict(zip(known, range(len(known)), strict=True))
        found = splitter(path).ids(known)
        sizes = np.fromiter(map(len, found), np.uint32, len(found))
        counts, ids = [], []
        for words in asked:
            mine = [at[w] for w in words]
            counts.append(pack(sizes[mine]))
            ids.append(pack(np.concatenate([found[i] for i in mine])))
        return pa.table({"block": table.column("block"), "part": table.column("part"), "counts": pa.array(counts, pa.binary()), "ids": pa.array(ids, pa.binary())})

    kind = dict(docs.dtypes)[keep]
    tail = "ids array<int>, decoded string" if output == "ids" else "ids_sha256 string, decoded_sha256 string"
    schema = f"`{keep}` {kind}, n_tokens long, {tail}"
    names = [keep, "n_tokens", *(["ids", "decoded"] if output == "ids" else ["ids_sha256", "decoded_sha256"])]

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        split, left = splitter(path), opened(left)
        seqs, ranges = _distinct(split, left.column("text").to_pylist(), parts)
        got = {p: (c, i) for p, c, i in zip(*(right.column(x).to_pylist() for x in ("part", "counts", "ids")), strict=True)}
        if set(got) != {p for p, words in enumerate(ranges) if words}:
            raise RuntimeError("a block's answers don't match its words")
        counts = np.concatenate([np.zeros(0, np.uint32), *(unpack(got[p][0], np.uint32, len(ranges[p])) for p in sorted(got))])
        flat = np.concatenate([np.zeros(0, np.uint32), *(unpack(got[p][1], np.uint32) for p in sorted(got))])
        ends = np.cumsum(counts)
        # The join of ids to pieces, for the block's distinct words.
        pieces = split.pieces
        named = list(map(pieces.__getitem__, flat.tolist()))
        digits = list(map(str, flat.tolist()))
        spans = list(zip((ends - counts).tolist(), ends.tolist(), strict=True))
        as_ids = [" ".join(digits[a:b]) for a, b in spans]
        as_text = [" ".join(named[a:b]) for a, b in spans]
        n, one, two = [], [], []
        for s in seqs:
            n.append(int(counts[s].sum()))
            at = s.tolist()
            decoded = " ".join([as_text[i] for i in at if as_ids[i]])
            if output == "ids":
                one.append(np.concatenate([np.zeros(0, np.uint32), *(flat[slice(*spans[i])] for i in at)]).astype(np.int32))
                two.append(decoded)
            else:
                one.append(hashlib.sha256(" ".join([as_ids[i] for i in at if as_ids[i]]).encode()).hexdigest())
                two.append(hashlib.sha256(decoded.encode()).hexdigest())
        relax()
        first = pa.array(one, pa.list_(pa.int32())) if output == "ids" else pa.array(one, pa.string())
        return pa.Table.from_arrays([left.column(keep), pa.array(n, pa.int64()), first, pa.array(two, pa.string())], names)

    asked = blocks.groupBy("block").applyInArrow(ask, "part int, block int, blob binary")
    answers = asked.repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(answer, "block int, part int, counts binary, ids binary")
    return blocks.groupBy("block").cogroup(answers.repartitionById(n_blocks, F.col("block")).groupBy("block")).applyInArrow(join, schema)


def decode(spark: SparkSession, encoded: DataFrame, path: str, keep: str = "doc_id") -> DataFrame:
    """keep and decoded: the pieces of each row's ids, joined by one space. A null list of ids decodes to an empty text."""

    def run(batches):
        pieces = splitter(path).pieces
        for batch in batches:
            texts = [" ".join([pieces[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [keep, "decoded"])

    return bounded_batches(encoded.select(keep, "ids")).mapInArrow(run, f"`{keep}` {dict(encoded.dtypes)[keep]}, decoded string")
