"""Near duplicates and benchmark leaks against all pairs; the pipeline's stages one by one."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.llm import common, decontaminate, join, queries

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_classes(rows):
    """class_id, n_links and copy_of of each row from all pairs."""
    nodes = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        words = tuple((t or "").encode().split())
        nodes[words or ("empty", k)].append(k)
    keys = list(nodes)
    sets = [shingle_set(rows[nodes[k][0]][1]) for k in keys]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(keys)
    for a in range(len(keys)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += len(nodes[keys[b]])
                links[b] += len(nodes[keys[a]])
                root[find(a)] = find(b)
    least = lambda ks: min((rows[k][0] for k in ks if rows[k][0] is not None), default=None)
    members = defaultdict(list)
    for a, k in enumerate(keys):
        members[find(a)] += nodes[k]
    out = {}
    for a, k in enumerate(keys):
        for x in nodes[k]:
            out[x] = (rows[x][0], least(members[find(a)]), links[a] + len(nodes[k]) - 1, least(nodes[k]))
    return sorted(out.values(), key=repr)


def corpus(rng, groups=25, hot=330):
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    rows, i = [], 0
    for g in range(groups):
        base = [word() for _ in range(rng.randrange(6, 120))]
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
                w[rng.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    base = [word() for _ in range(150)]
    for _ in range(hot):  # a large group of different near copies
        w = list(base)
        w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
        i += 1
    passage = " ".join(word() for _ in range(60))
    for _ in range(hot):  # different texts that share a passage
        rows.append((i, passage + " " + " ".join(word() for _ in range(rng.randrange(10, 200)))))
        i += 1
    return rows + [(i, "one two"), (i + 1, "one\ttwo"), (i + 2, "one"), (i + 3, None), (i + 4, ""), (i + 5, "  "), (i, "one two"), (None, rows[0][1]), (None, "null only words here now")]


@pytest.mark.parametrize(("cell", "bucket"), [(join.CELL, join.BUCKET), (50, 40)])
def test_links_equal_all_pairs(spark, monkeypatch, cell, bucket):
    monkeypatch.setattr(join, "CELL", cell)
    rows = corpus(random.Random(3))
    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, class_id string")
    got = sorted((tuple(r) for r in join.near_duplicates(d, bucket=bucket).collect()), key=repr)
    assert got == plain_classes(rows)


def test_shuffled_and_empty_input(spark, monkeypatch):
    monkeypatch.setattr(join, "BROADCAST_ROWS", 0)
    rows = corpus(random.Random(4), 8, 5)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in join.near_duplicates(d).collect()), key=repr) == plain_classes(rows)
    assert join.near_duplicates(d.limit(0)).count() == 0
    kept = [r["doc_id"] for r in join.one_of_each(d).collect()]
    want = {c for _, c, *_ in plain_classes(rows) if c is not None}
    assert sorted(k for k in kept if k is not None) == sorted(want)


def test_deep_buckets_keep_dense_groups_together():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 2**64, 2, np.uint64)
    bits = np.tile(centre, (600, 1))
    for row in bits:
        for b in rng.choice(128, 6, replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    pairs = join._canopies(bits, 0, 600)
    i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    assert (join._linked((i, j), 600) == 0).all()


def test_recall_of_a_single_run_grows_to_the_target():
    assert join.runs_for(0.999) >= join.runs_for(0.9) >= 1


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    d = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(d).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert common.components(d.limit(0)).count() == 0


def test_hash_words_reads_like_split():
    texts = [b"", b"a", b" a  bb\n\x0b c", b"\n\n", b"x" * 100, "é€ 😀\xa0z".encode()]
    for at_once in (1, 4 << 20):
        w = common.hash_words(texts, at_once)
        flat = [x for t in texts for x in t.split()]
        assert np.diff(w.starts).tolist() == [len(t.split()) for t in texts] and w.sizes.tolist() == list(map(len, flat))
        known = {}
        assert all(known.setdefault(x, h) == h for x, h in zip(flat, w.hashes.tolist(), strict=True)) and len(set(known.values())) == len(known)
    assert len(common.hash_words([]).hashes) == 0


def test_packed_arrays_come_back():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 1000, np.uint64))
    assert np.array_equal(common.unpack_sorted(common.pack_sorted(keys)), keys)
    assert np.array_equal(common.unpack(common.pack(np.arange(5, dtype=np.uint32)), np.uint32, 5), np.arange(5))
    parts = common.part_of(keys, 7)
    assert (np.diff(parts.astype(int)) >= 0).all() and set(parts.tolist()) == set(range(7))


def plain_leaks(docs, items):
    """Best window of each item in each document, over all windows, by weighted Jaccard."""

    def bag(words, k):
        out = defaultdict(float)
        for i in range(len(words) - k + 1):
            s = tuple(words[i : i + k])
            out[s] += sum(map(len, s))
        return out

    read = lambda t: [w for w in (t or "").lower().encode().split()]
    found = set()
    for d, text in docs:
        w = read(text)
        for i, item in items:
            own = read(item)
            if not own:
                continue
            k = min(5, len(own))
            b = bag(own, k)
            best = None
            for s in range(max(1, len(w) - len(own) + 1)):
                a = bag(w[s : s + len(own)], k)
                if not a:
                    continue
                shared = sum(min(v, b.get(x, 0)) for x, v in a.items())
                sim = shared / (sum(a.values()) + sum(b.values()) - shared)
                if sim >= 0.8 and (best is None or sim > best[1] + 1e-12):
                    best = (s, sim)
            if best:
                found.add((d, i, best[0], round(best[1], 9)))
    return found


def leak_corpus(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 60)))) for i in range(12)] + [(20, "two words"), (21, ""), (22, None), (23, "rep rep rep rep rep rep rep rep rep rep")]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randrange(0, 150))]
        own = rng.choice(items[:12])[1].split()
        kind = d % 6
        if kind == 1:
            own[rng.randrange(len(own))] = "edited"
        elif kind == 2:
            del own[len(own) // 2]
        elif kind == 3:
            own = own[: len(own) // 2]
        elif kind == 4:
            own = [x.upper() for x in own]
        at = rng.randrange(len(w) + 1)
        docs.append((d, " ".join(w[:at] + (own if kind != 5 else []) + w[at:])))
    return docs + [(100, None), (101, ""), (102, "x two words y"), (103, "rep " * 30), (None, items[3][1]), (104, items[4][1] + " " + items[4][1])], items


def test_leaks_equal_all_windows(spark):
    docs, items = leak_corpus(random.Random(2))
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start_word"], round(r["similarity"], 9)) for r in decontaminate.find(d, b).collect()}
    assert got == plain_leaks(docs, items)
    dirty = {r[0] for r in got}
    assert sorted((r["doc_id"] for r in decontaminate.clean(d, b).collect()), key=repr) == sorted((i for i, _ in docs if i not in dirty), key=repr)
    assert decontaminate.find(d.limit(0), b).count() == 0 and decontaminate.find(d, b.limit(0)).count() == 0
    assert decontaminate.clean(d, b.limit(0)).count() == len(docs)


def test_a_large_benchmark_is_taken_in_blocks(spark, monkeypatch):
    docs, items = leak_corpus(random.Random(2))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.find(d, b).collect()), key=repr)
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 6)
    assert len(list(decontaminate.indexes(b))) > 2
    assert sorted(map(tuple, decontaminate.find(d, b).collect()), key=repr) == one
    assert decontaminate.clean(d, b).count() == len(docs) - len({r[0] for r in one})


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(0)
    index = decontaminate.Index([(i, f"w{i} a b c d e f g h") for i in range(100)])
    index.prints = rng.integers(0, 2**64, (100, 2), np.uint64)
    prints = index.prints[rng.integers(0, 100, 2000)].copy()
    for row in prints:
        for b in rng.choice(128, rng.integers(0, 60), replace=False).tolist():
            row[b // 64] ^= np.uint64(1 << (b % 64))
    at, item = index.within(prints, np.arange(100))
    apart = np.bitwise_count(prints[:, None, :] ^ index.prints[None, :, :]).sum(axis=2, dtype=int)
    assert set(zip(at.tolist(), item.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(apart <= decontaminate.RADIUS)), strict=True))


def test_items_of_small_id_types(spark):
    d = spark.createDataFrame([(1, "x " + "a b c d e f g h i j " + "y")], "doc_id int, text string")
    b = spark.createDataFrame([(3, "a b c d e f g h i j")], "item_id long, text string").withColumn("item_id", F.col("item_id").cast("smallint"))
    assert [tuple(r)[:3] for r in decontaminate.find(d, b).collect()] == [(1, 3, 1)]


def test_leaks_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(15).collect()]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start_word"], round(r["similarity"], 9)) for r in decontaminate.find(d, b).collect()}
    assert got == plain_leaks(docs, items)
    assert got <= {(r["doc_id"], r["item_id"], r["start_word"], round(r["similarity"], 9)) for r in queries.op10_benchmark_leaks(spark, SF).collect()}


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    start = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(p.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "BPE encoding and decoding"]
    judged = {r["doc_id"] for r in queries.op3_line_labels(spark, SF).filter("kept").collect()}
    one = common.written(p.quality_rules(spark, start, SF), "t1")
    assert {r["doc_id"] for r in one.collect()} == judged and one.columns == start.columns
    two = common.written(p.near_duplicates(spark, one, SF), "t2")
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert {r["doc_id"] for r in two.collect()} == {c for _, c, *_ in plain_classes(rows)} and two.columns == start.columns
    three = common.written(p.decontamination(spark, two, SF), "t3")
    leaky = {r["doc_id"] for r in queries.op10_benchmark_leaks(spark, SF).collect()}
    assert {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in two.collect()} - leaky
    four = common.written(p.secret_scan(spark, three, SF), "t4")
    assert four.columns == start.columns and four.count() == three.count()
    assert four.filter(F.col("n_chars") != F.length("text")).count() == 0
    assert four.filter("text RLIKE 'token = \"[0-9a-f]{40}'").count() == 0
    last = p.token_ids(spark, four, SF)
    whole = p.run(spark, SF)
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in last.collect()) == sorted((r["doc_id"], tuple(r["ids"])) for r in whole.collect())


@pytest.mark.parametrize(("n", "cut"), [(100, 50), (59, 45), (47, 30), (59, 20)])
def test_reordered_passages_equal_all_windows(n, cut):
    rng = random.Random(n * cut)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    own = [word() for _ in range(n)]
    rest = [word() for _ in range(80)]
    docs = [(0, " ".join(rest[:30] + own[cut:] + own[:cut] + rest[30:])), (1, " ".join(own[cut:] + own[:cut])), (2, " ".join(rest + own[n // 2 :] + own[: n // 2 - 1])), (3, " ".join(rest))]
    index = decontaminate.Index([(7, " ".join(own))])
    got = {(docs[d][0], 7, s, round(sim, 9)) for d, found in enumerate(index.matches([t for _, t in docs])) for _, s, _, sim in found}
    want = plain_leaks(docs, [(7, " ".join(own))])
    assert {(0, 7), (1, 7)} <= {r[:2] for r in want}
    assert got == want


def test_recall_on_a_hot_group_larger_than_a_bucket(spark, monkeypatch):
    """600 distinct near copies against buckets of 64 and cells of 50: every link of every document, against all pairs."""
    monkeypatch.setattr(join, "CELL", 50)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(600):
        words = list(base)
        for at in rng.sample(range(120), rng.randrange(4)):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(60))) for i in range(200)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {i: sum(j != i and 100 * len(s & o) >= 80 * len(s | o) for j, o in sets.items()) for i, s in sets.items()}
    got = {r["doc_id"]: r["n_links"] for r in join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bucket=64).collect()}
    assert sum(want.values()) > 10_000
    assert sum(got.values()) >= 0.999 * sum(want.values()) and all(got[i] <= want[i] for i in want)


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_NODES", 4)
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)] + [(9000, 9000)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 5000} and len(got) == 3041 and all((v == 0) == (k < 5000) for k, v in got.items())
