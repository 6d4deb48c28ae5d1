"""Main text, archives and token ids: hand-made cases, damage, the tokenizers library as the judge."""

import gzip
import hashlib
import math
import html as h
import random
import re

import pytest

from tidelens.llm import bpe, html, queries, warc

SF = "/root/testdata/sf0.001"


def test_main_text_of_all_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.op7_main_text(spark, SF).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        # These pages' articles hold blocks of h1 and p only: cut them out without a parser.
        inside = re.search(r"<article>(.*?)(?:</article>|$)", page, re.DOTALL)[1]
        blocks = [h.unescape(re.sub(r"<br>", " ", b)) for b in re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", inside))]
        want = "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)
        assert got[i] == (want, len(want))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just text, no tags.", "just text, no tags."),
        ("<body><nav>Menu</nav><main><p>One &amp; two.<p>Three&nbsp;four</main><footer>Foot</footer>", "One & two.\n\nThree four"),
        ("<article><header><h1>Head</h1></header><p>Body text here.</p><aside>Side</aside><div class='comments'><p>Nice!</p></div><form><p>Name</p></form></article>", "Head\n\nBody text here."),
        ("<article><p>A<script>var x='</p><p>no';</script>B</p><!-- <p>gone</p> --><style>p{}</style><ul><li>x<li>y</ul></article>", "AB\n\nx\n\ny"),
        ("<article><p>cut off <b>in the mid", "cut off in the mid"),
        ("<article><p>a<br>b  \n c</p><p>1 < 2</p></article>", "a b c\n\n1 < 2"),
        ("<div class='sidebar'><p>" + "links " * 50 + "</p></div><div><p>The story, told at some length. It goes on.</p></div>", "The story, told at some length. It goes on."),
        ("<div id='content'><h2>Title</h2><p>Short.</p><p style='display: none'>hidden</p><p class='notice'>Notice</p></div><div><p>" + "Something else, long. " * 9 + "</p></div>", "Title\n\nShort."),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\n\nb\n\nc"),
    ],
)
def test_main_text_by_hand(page, text):
    assert html.extract(page) == text


def test_main_text_frame(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "<article>x</article>", 2), (1, "u", "<article>x</article>", 2)], "page_id long, url string, html string, text int")
    assert sorted((tuple(r) for r in html.extract_pages(pages).collect()), key=repr) == [(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0)]
    assert html.extract_pages(pages.limit(0)).count() == 0


def record(i, payload, kind="response", eol=b"\r\n"):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + payload
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:%d>" % i, b"WARC-Payload-Digest: sha256:" + hashlib.sha256(payload).hexdigest().encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return eol.join(head) + eol * 2 + block + eol * 2


def ids(data):
    return [x.headers["warc-record-id"] if isinstance(x, warc.Record) else (x.offset, x.length, x.reason) for x in warc.salvage(data)]


def urn(*n):
    return [f"<urn:page:{i}>" for i in n]


def test_whole_archives():
    assert ids(b"") == []
    assert ids(b"".join(record(i, b"x" * i) for i in range(5))) == urn(*range(5))
    assert ids(record(1, b"lf only", eol=b"\n")) == urn(1)
    assert ids(record(1, b"inside WARC/1.1\r\nWARC-Type: x\r\n\r\n") + record(2, b"")) == urn(1, 2)


def test_salvage_of_every_kind_of_damage():
    a, b, c = record(1, b"one"), record(2, b"two" * 50), record(3, b"three")
    assert ids(a + b"garbage" + c) == [*urn(1), (len(a), 7, "no version line"), *urn(3)]
    flipped = bytearray(b)
    flipped[-60] ^= 1
    assert ids(a + bytes(flipped) + c) == [*urn(1), (len(a), len(b), "warc-payload-digest differs"), *urn(3)]
    cut = ids(a + b[:-80] + c)
    assert cut[0] == urn(1)[0] and cut[-1] == urn(3)[0] and cut[1][:2] == (len(a), len(b) - 80)
    assert ids(a + b[:-30])[1][2] == "the block is cut off"
    assert ids(b"\x00" * 100) == [(0, 100, "no version line")]
    assert ids(a + b.replace(b"Content-Length", b"Content-Longth") + c)[1][2] == "no length"


def test_salvage_of_gzip_members():
    members = [gzip.compress(record(i, b"page %d" % i * 40)) for i in range(4)]
    assert ids(b"".join(members)) == urn(0, 1, 2, 3)
    broken = gzip.compress(record(1, b"page 1" * 40).replace(b"page 1", b"pagE 1", 1))
    got = ids(members[0] + broken[:-8] + bytes(8) + members[2] + members[3][:-5])
    assert got[0] == urn(0)[0] and got[1][:2] == (len(members[0]), len(broken)) and got[2] == urn(2)[0]
    assert got[3] == urn(3)[0] and got[4][2] == "the member is cut off"  # all but its end mark is there, and its digest holds
    # Nothing vouches for a revisit record's content but the member's own check.
    assert [type(x) for x in ids(gzip.compress(record(1, b"", "revisit"))[:-8] + bytes(8))] == [tuple]


def test_random_damage_never_invents_records():
    rng = random.Random(5)
    records = [record(i, bytes(rng.randrange(32, 127) for _ in range(rng.randrange(200)))) for i in range(20)]
    for _ in range(60):
        data = bytearray(b"".join(records))
        for _ in range(rng.randrange(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        found = list(warc.salvage(bytes(data)))
        assert sum(x.length for x in found) == len(data)
        assert sum(isinstance(x, warc.Record) for x in found) >= 14


def test_archives_of_odd_pages(spark, tmp_path):
    big, rows = "é" * 60, []
    rows = [(5, "u\nv", big, "x"), (2, None, big, "x"), (9, "w", big, "x"), (3, "s", "short", "x"), (4, "s", "short", "x"), (6, "n", None, "x"), (2, None, big, "x"), (None, "z", big, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    got = sorted((tuple(r) for r in warc.round_trip(spark, pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=repr)
    want = [(2, 120, "response", None), (2, 120, "response", None), (3, 5, "response", None), (4, 5, "response", None), (5, 120, "revisit", 2), (6, 0, "response", None), (9, 120, "revisit", 2), (None, 120, "revisit", 2)]
    assert got == sorted(want, key=repr)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_shuffled_and_broadcast_revisits_agree(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "x" * (100 + i % 3)) for i in range(12)], "page_id long, url string, html string")
    one = sorted(map(tuple, warc.classify(pages, "page_id", "html").collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert one == sorted(map(tuple, warc.classify(pages, "page_id", "html").collect()))


def test_reader_logs_gaps(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(1, b"one") + b"garbage" + record(2, b"two"))
    got = warc.read_archives(spark, f"file://{tmp_path}").orderBy("offset").collect()
    assert [r["reason"] for r in got] == [None, "no version line", None] and bytes(got[2]["payload"]) == b"two"


TEXTS = [None, "", "  ", "It's <|endoftext|>x<|startoftext|> İSTANBUL ΣΑΣ ΟΔΟΣ é ẞ ﬁ 你好 ١٢٣ ½ a\x1cb \x85   　 😀👍🏽 don't WE'LL ''s", "<|ENDOFTEXT|>", "é Ünïcode ǅ", "a" * 3000, "one\xa0two"]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_equal_the_library(spark):
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(10_000 + i, t) for i, t in enumerate(TEXTS)] + real + [(10_003, TEXTS[3]), (None, "null key")]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    t = library()
    want = []
    for i, text in rows:
        e = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(e), tuple(e), t.decode(e, skip_special_tokens=False)))
    full = bpe.encode(d, queries.tokenizer_path(), output="ids")
    assert sorted(((r[0], r[1], tuple(r[2]), r[3]) for r in full.collect()), key=repr) == sorted(want, key=repr)
    digest = [(i, n, hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()) for i, n, e, x in want]
    assert sorted(map(tuple, bpe.encode(d, queries.tokenizer_path()).collect()), key=repr) == sorted(digest, key=repr)
    assert sorted((tuple(r) for r in bpe.decode(spark, full, queries.tokenizer_path()).collect()), key=repr) == sorted(((i, x) for i, _, _, x in want), key=repr)
    assert bpe.encode(d.limit(0), queries.tokenizer_path()).count() == 0


def test_many_blocks_give_the_same_ids(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    one = sorted(map(tuple, bpe.encode(d, queries.tokenizer_path()).collect()))
    assert one == sorted(map(tuple, bpe.encode(d, queries.tokenizer_path(), block_bytes=20_000).collect()))


PROSE = "The river rose in the night, and by morning the lower road was gone; nobody had seen it go. "


def test_ratios_outweigh_names():
    story = "".join(f"<p>{PROSE * 4}</p>" for _ in range(5))
    want = "\n\n".join([(PROSE * 4).strip()] * 5)
    teaser = "<article><p>Read next: ten bridges you should see.</p></article>"
    # A dense plain story stays, and a teaser named as content goes.
    assert html.extract(f"<body><div id='text'>{story}</div>{teaser}</body>") == want
    assert html.extract(f"<body>{teaser}<div id='text'>{story}</div></body>") == want
    # Names decide where ratios do not speak against them: a short plain passage beside an article goes.
    assert html.extract(f"<body><article>{story}</article><div>{PROSE}</div></body>") == want
    # Two dense parts, only one of them named, both stay.
    assert html.extract(f"<body><article><p>{PROSE * 4}</p></article><div>{story}</div></body>") == "\n\n".join([(PROSE * 4).strip(), want])


def test_salvage_inside_one_large_member_and_in_linear_time():
    import gzip
    import time

    records = b"".join(record(i, b"x" * 300) for i in range(50))
    whole = gzip.compress(records)
    got = list(warc.salvage(whole[:-10]))
    assert sum(isinstance(x, warc.Record) for x in got) >= 45 and isinstance(got[-1], warc.Gap) and "cut off" in got[-1].reason
    bad = records.replace(b"WARC/1.1", b"WARX/1.1", 1)
    got = list(warc.salvage(gzip.compress(bad)))
    assert sum(isinstance(x, warc.Record) for x in got) == 49 and got[-1].reason.startswith("inside the member")
    many = b"".join(gzip.compress(record(i, b"y" * 50)) for i in range(8000))
    began = time.perf_counter()
    assert sum(isinstance(x, warc.Record) for x in warc.salvage(many)) == 8000
    assert time.perf_counter() - began < 20


def test_round_trip_of_odd_urls_and_large_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILES", ((0, 4), (200, 2), (1000, 1)))
    urls = [" http://a/ b\r\nc ", None, "", "http://é/\n", "plain"]
    rows = [(i, urls[i % 5], "z" * (i * 97) + str(i % 3)) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(spark, pages).collect()}
    assert len(got) == 30 and all(got[i]["url"] == u and got[i]["payload_bytes"] == len(h) for i, u, h in rows)


STORY = "The story runs on, at length; it has commas, and full stops. " * 6
RIVAL = f"<article class='teaser'><a href='/x'>Read more</a></article><div id='text'><h2>Title</h2>{f'<p>{STORY}</p>' * 5}</div>"
LINKS = f"<article><h1>Title of it</h1><p>{STORY}</p><p>{STORY}</p><section><div><div><div><div><i>a</i><u>b</u><s>c</s><em>d</em><tt>x</tt></div></div></div></div></section></article>"
NAMELESS = f"<div><div><span>Home</span><span>About</span><span>Shop</span></div><div><p>{STORY}</p><p>{STORY}</p></div></div>"


def plain_ratios(page):
    """Ratio, smoothing and fusion of each path, by their definitions."""
    seen = []
    for _, path, mark, text in html.nodes(page):
        if text.strip():
            seen.append(((path, mark), len(text.strip()), sum(c in html.PUNCTUATION for c in text)))
    keys = list(dict.fromkeys(k for k, *_ in seen))
    raw = []
    for k in keys:
        own = [(c, p) for q, c, p in seen if q == k]
        raw.append(math.log(1 + sum(c for c, _ in own) / len(own)) + math.log(1 + sum(p for _, p in own) / len(own)))
    out = {}
    for i, k in enumerate(keys):
        near = [j for j in range(max(0, i - 2), min(len(keys), i + 3)) if keys[j][1] == k[1]]
        weight = [math.exp(-((j - i) ** 2) / 2) for j in near]
        out[k] = math.sqrt(raw[i] * sum(w * raw[j] for w, j in zip(weight, near, strict=True)) / sum(weight))
    return out


def test_ratios_equal_their_definition(spark):
    pages = [RIVAL, LINKS, NAMELESS, "", *(r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect())]
    for page in pages:
        totals, ratios = html.path_ratios(list(html.nodes(page or "")))
        want = plain_ratios(page or "")
        assert list(ratios) == list(want) == list(totals) and all(math.isclose(ratios[k], want[k]) for k in want)


def test_ratios_decide_with_and_without_names(monkeypatch):
    told = " ".join(STORY.split())
    assert html.extract(RIVAL) == "\n\n".join(["Title", *[told] * 5])
    assert html.extract(LINKS) == f"Title of it\n\n{told}\n\n{told}"
    assert html.extract(NAMELESS) == f"{told}\n\n{told}"
    # Without the ratios the names decide, and all three come out otherwise.
    true = html.path_ratios
    monkeypatch.setattr(html, "path_ratios", lambda found: (lambda t, r: ({k: [1.0, 0.0, 1.0] for k in t}, dict.fromkeys(r, 1.0)))(*true(found)))
    assert html.extract(RIVAL) == "Read more"
    assert html.extract(LINKS).endswith("abcdx") and "Home" in html.extract(NAMELESS)
