"""Language-model scores against a plain automaton; line labels against enumeration and held-out labels."""

import inspect
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidelens.llm import lm, queries, rules

SF = "/root/testdata/sf0.001"
START, END = ("<start>",), ("<end>",)


def symbols(text):
    return [START, *((w,) for w in (text or "").encode().lower().split()), END]


def plain_scores(rows, order):
    """Counts, weights, states, arcs and failure arcs in dictionaries, and one walk over each text."""
    counts = Counter()
    for text, train in rows:
        s = symbols(text)
        if train:
            counts.update(tuple(s[i : i + k]) for k in range(1, order + 1) for i in range(len(s) - k + 1))
    n = sum(c for g, c in counts.items() if len(g) == 1 and g != (START,))
    v = sum(1 for g in counts if len(g) == 1 and g != (START,))
    size = lambda c: min(int(math.log2(c)) + 1, lm.SIZES - 1) if c else 0
    table = np.zeros((order - 1, lm.SIZES, lm.RATIOS), np.int64)
    for text, train in rows:
        s = symbols(text)
        for i in range(1, len(s)) if train else ():
            lower = max(counts[(s[i],)], 1) / (n + v)
            for k in range(1, min(order - 1, i) + 1):
                c = counts[tuple(s[i - k : i])]
                if c > 1:
                    own = (counts[tuple(s[i - k : i + 1])] - 1) / (c - 1)
                    table[k - 1, size(c), min(max(int(41 + 4 * math.log2(own / lower)), 1), lm.RATIOS - 1) if own > 0 else 0] += 1
                    lower = (own + lower) / 2
    below = lm.weights(table)

    def fail(h):
        return below[len(h) - 1, size(counts[h])]

    def p(h, w):
        if not h:
            return (counts[(w,)] + 1) / (n + v + 1)
        return (1 - fail(h)) * counts[(*h, w)] / max(counts[h], 1) + fail(h) * p(h[1:], w)

    out = []
    for text, _ in rows:
        s = symbols(text)
        state = (START,) if order > 1 and counts[(START,)] else ()
        total = 0.0
        for w in s[1:]:
            while state and not counts[(*state, w)]:
                total += math.log10(fail(state))
                state = state[1:]
            total += math.log10(p(state, w))
            state = (*state, w)
            while state and (len(state) > order - 1 or not counts[state]):
                state = state[1:]
        base = sum(math.log10((counts[(w,)] + 1) / (n + v + 1)) for w in s[1:])
        out.append((len(s) - 1, sum(counts[(w,)] > 0 for w in s[1:]), n, round(base, 6), round(total, 6)))
    return out, counts, p


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, tr, "x") for i, (t, tr) in enumerate(texts)], "doc_id long, text string, train boolean, score string")


TEXTS = [("the cat sat", True), ("The cat ran\nthe dog sat", True), (None, True), ("", False), ("the dog ran off", False), ("unseen words only", False), ("the cat sat", True), ("the", None)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_a_plain_automaton(spark, order):
    rng = random.Random(1)
    more = [(" ".join(rng.choice("abcdef") for _ in range(rng.randrange(40))), rng.random() < 0.6) for _ in range(60)]
    texts = TEXTS + more
    got = lm.score(rows_of(spark, texts), "train", ["doc_id"], order=order, block_bytes=300).orderBy("doc_id").collect()
    want, *_ = plain_scores([(t, bool(tr)) for t, tr in texts], order)
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got] == want


def test_probabilities_after_any_history_sum_to_one():
    rows = [(t, bool(tr)) for t, tr in TEXTS]
    _, counts, p = plain_scores(rows, 3)
    words = [g[0] for g in counts if len(g) == 1 and g != (START,)]
    for h in [(), (START,), ((b"the",),), ((b"the",), (b"cat",))]:
        assert math.isclose(sum(p(h, w) for w in [*words, ("never seen",)]), 1.0)


def test_scores_without_training_rows_and_without_rows(spark):
    d = rows_of(spark, [("a b", False)])
    r = lm.score(d, "train", ["doc_id"]).first()
    assert (r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)
    assert lm.score(d.limit(0), "train", ["doc_id"]).count() == 0


def test_query_holds_to_its_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op2_backoff_scores(spark, SF).collect()}
    rows = [(d["text"], zlib.crc32(str(d["doc_id"]).encode()) % 7 != 2) for d in docs]
    want, *_ = plain_scores(rows, lm.ORDER)
    assert len(got) == len(docs)
    for d, (_, train), w in zip(docs, rows, want, strict=True):
        r = got[d["doc_id"]]
        assert r["held_out"] == (not train)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) == w
    held = [got[d["doc_id"]] for d, (_, train) in zip(docs, rows, strict=True) if not train]
    assert sum(r["score"] for r in held) >= sum(r["base_score"] for r in held)


def plain_counts(text):
    t = text or ""
    words = t.encode().split()
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
    lines = t.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x.encode().split() and x in lines[:i])
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


ODD = [None, "", " \n\t ", "a a a a a", "é€😀 b\n\né€😀 b\nc\x0bd\x85e\xa0f", "x y z " * 40, "one\n" * 60, "#*$%&|<> " * 5, "w " * 30000]


def test_base_counts_against_brute_force(spark):
    real = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t in ODD[:-1] + real:
        assert rules.base_counts((t or "").encode()) == plain_counts(t)


def plain_features(line, seen):
    """One line's features, a line at a time."""
    words = line.split()
    n, chars = len(words), sum(map(len, words))
    count = lambda s: sum(line.count(bytes([b])) for b in s)
    upper = count(range(65, 91))
    letters = upper + count(range(97, 123)) + count(range(128, 256))
    symbols = count(b"#*$%&|<>")
    return [1.0, min(symbols / n, 2), symbols * 5 >= n, min(count(b"!?") / n, 2), 2 * upper >= letters > 0, count(b"0123456789") / chars, (chars - letters) / chars, n <= 3, n >= 12, words[-1][-1:] in b".!?:;\"'", seen, min(chars / n / 10, 2), any(x in line.lower() for x in rules.NOTICES)]


def test_line_features_against_brute_force(spark):
    texts = [(t or "").encode() for t in ODD] + [r["text"].encode() for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    got = rules.Lines(texts)
    at = 0
    for i, t in enumerate(texts):
        seen = set()
        assert got.starts[i] == at
        for number, line in enumerate(t.split(b"\n")):
            if line.strip(rules._SPACE):
                assert np.allclose(got.features[at], np.array(plain_features(line, line in seen), float)) and got.words[at] == len(line.split()) and got.numbers[at] == number
                at += 1
            seen.add(line)
    assert got.starts[-1] == at == len(got.features)


def chain_score(f, x, labels):
    e = x @ f.emit
    return sum(e[i, y] for i, y in enumerate(labels)) + sum(f.move[a, b] for a, b in itertools.pairwise(labels))


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(0)
    for n in range(9):
        f = rules.Field(rng.normal(size=(rules.FEATURES, 2)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, rules.FEATURES))
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: chain_score(f, x, y))
        assert np.isclose(chain_score(f, x, f.decode(x).tolist()), chain_score(f, x, best))
    assert rules.Field().decode(np.ones((3, rules.FEATURES))).tolist() == [1, 1, 1]


def test_training_climbs_the_exact_likelihood():
    rng = np.random.default_rng(1)
    lines = rules.Lines([])
    sizes = [3, 1, 0, 5, 2, 4]
    lines.features = rng.normal(size=(sum(sizes), rules.FEATURES))
    lines.starts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    targets = [1, 0, 1, 0, 1, 0]

    def loss(f):
        total = 0.0
        for i, y in enumerate(targets):
            x = lines.features[lines.starts[i] : lines.starts[i + 1]]
            z = np.logaddexp.reduce([chain_score(f, x, s) for s in itertools.product((0, 1), repeat=len(x))])
            total += z - chain_score(f, x, [y] * len(x))
        return total / sum(sizes) + 0.05 * ((f.emit**2).sum() + (f.move**2).sum()) / 2

    f = rules.Field().fit(lines, targets, rounds=800, rate=0.05, decay=0.05)
    at = loss(f)
    assert at < loss(rules.Field())
    for _ in range(20):  # no small step from the optimum is better
        assert loss(rules.Field(f.emit + 0.05 * rng.normal(size=f.emit.shape), f.move + 0.05 * rng.normal(size=(2, 2)))) > at - 1e-4


def test_verdicts_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = rules.train(docs, labels.filter("doc_id % 2 = 0"))
    got = {r["doc_id"]: r for r in rules.judge(docs, field).collect()}
    held = [(r["quality"], got[r["doc_id"]]) for r in labels.filter("doc_id % 2 = 1").collect()]
    good = [r["kept"] for q, r in held if q == 1 and not r["base_failed"]]
    bad = [r["kept"] for q, r in held if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad)
    kept = {r["doc_id"] for r in rules.keep(docs, field).select("doc_id").collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}
    lines = rules.label_lines(docs.limit(5), field).collect()
    assert {r["doc_id"] for r in lines} <= {r["doc_id"] for r in docs.limit(5).collect()}


def test_rules_on_odd_rows(spark):
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "w " * 60, "c"), (0, None, "c")], "doc_id long, text string, kept string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    field = rules.train(d, none)
    assert not field.emit.any()
    got = rules.judge(d, field).collect()
    assert len(got) == len(ODD) + 2 and all(r["n_words"] == plain_counts(t)[0] for r, t in zip(got, ODD, strict=False))
    assert [r["kept"] for r in got if r["n_words"] == 0] == [False] * 4
    assert rules.judge(d.limit(0), field).count() == 0 and rules.keep(d.limit(0), field).count() == 0
    assert rules.keep(d, field).columns == d.columns


def test_query_backs_off_through_more_than_one_context():
    """The registered order has states of two words, whose failure arcs lead to states of one."""
    assert lm.ORDER >= 3
    assert inspect.signature(lm.document_scores).parameters["order"].default == lm.ORDER


def test_training_takes_ids_of_any_type_and_repeated_rows(spark):
    good, bad = "a plain line of prose that ends here.\n" * 12, "### $$$ 12 || <<<\n" * 20
    rows = [(f"id{i}", good if i % 2 else bad) for i in range(20)] + [("id1", good)] * 50 + [("id1", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"id{i}", i % 2) for i in range(20)], "doc_id string, quality int")
    field = rules.train(docs, labels)
    got = {r["doc_id"]: r["content_share"] for r in rules.judge(docs.filter("text IS NOT NULL"), field).collect()}
    assert got["id3"] == 1.0 and got["id2"] == 0.0
    kept = {r["doc_id"] for r in rules.judge(docs, field).filter("kept").collect()}
    assert kept == {r["doc_id"] for r in rules.keep(docs, field).collect()}
