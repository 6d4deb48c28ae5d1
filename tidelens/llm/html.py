"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text; a text node belongs to the path of open tags from the root to it. For each path the
page's text length and punctuation are summed and divided by the number of its nodes; the ratios, in page order, are
smoothed with a Gaussian, fused with themselves and with what the path's names say (content or page furniture), and paths above a threshold
relative to the page's best are content. Where a page has paths named as content and others, the ratios of whole regions
decide between them, with the names as a finite prior.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidelens.llm.common import bounded_batches

#: Fixed values of the HTML language: elements without an end tag, with raw content, and that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: A p element ends where one of these starts.
ENDS_P = BLOCK - frozenset("body caption head html legend option tbody td tfoot th thead tr".split())
#: An element of the left ends where one of the right starts, up to the nearest element that can hold both.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Names of page furniture and of content, in tags and in classes, ids and roles.
FURNITURE_TAGS = frozenset("head nav header footer aside form script style noscript template button select textarea iframe object svg canvas title menu dialog".split())
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pagination|pager|popup|promo|related|replies|reply|respond|share|sharing|sidebar|sidenav|social|sponsor\w*|subscribe|toolbar|widget|alert|contentinfo|complementary|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|article-?body|content|entry|entry-?content|main|main-?content|post|post-?content|post-?body|story)(?:$|[\s_-])", re.IGNORECASE)
PUNCTUATION = ".,;:!?。，、؟…"

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?=[a-zA-Z/!?])(?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+'|[\"'])*+>", re.DOTALL)
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)

_UNSEEN = re.compile(r"\bstyle\s*=\s*[\"'][^\"']*display\s*:\s*none", re.IGNORECASE)

SIGMA, RADIUS = 1.0, 2  # of the smoothing, in paths
SHARE, PLAIN_SHARE = 0.25, 0.5  # of the best fused ratio, from which a path is content
PRIOR = {"content": 1.0, "plain": 0.05, "furniture": 0.0}  # what the names weigh
#: Regions: the text of a path weighs its characters times its smoothed ratios. Names of content multiply that and add to
#: it as some 500 characters of prose would; a region stays from HALF of what stands against it.
NAMED, ADDED, HALF = 4.0, 4000.0, 0.5
HOLDERS = frozenset("html body div section center td".split())  # the innermost of these is a plain path's region


def _mark(tag: str, raw: str) -> str:
    """What an element's names say: furniture, content or plain."""
    if tag in FURNITURE_TAGS:
        return "furniture"
    if _UNSEEN.search(raw):
        return "furniture"
    names = []
    for m in _ATTR.finditer(raw, len(tag) + 1):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "hidden" or m[1].lower() == "aria-hidden" and value.lower() == "true":
            return "furniture"
        names.append(value)
    if names and tag not in ("body", "html", "article", "main") and FURNITURE.search(" ".join(names)):
        return "furniture"
    return "content" if tag in ("article", "main") or names and CONTENT.search(" ".join(names)) else "plain"


def nodes(page: str) -> Iterator[tuple[int, tuple[str, ...], str, str]]:
    """Text nodes in page order: number of the block, path, what the path's names say, text with references decoded."""
    stack: list[tuple[str, str]] = []  # tag, mark as inherited
    block, at, raw_until = 0, 0, None

    def close(i: int) -> None:
        nonlocal block
        if any(t in BLOCK for t, _ in stack[i:]):
            block += 1
        del stack[i:]

    for m in _TOKEN.finditer(page):
        if raw_until and not (m[0].startswith("</") and m[0][2 : 2 + len(raw_until)].lower() == raw_until):
            continue
        if m.start() > at:
            yield block, tuple(t for t, _ in stack), stack[-1][1] if stack else "plain", _html.unescape(page[at : m.start()])
        at = m.end()
        if not (name := _NAME.match(m[0])):
            continue
        tag = name[1].lower()
        if m[0][1] == "/":
            raw_until = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in ("table", "body", "article", "div") and tag not in BLOCK:
                    break
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if tag in SIBLINGS:
            ends, holders = SIBLINGS[tag]
            last = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in holders:
                    break
                if stack[i][0] in ends:
                    last = i
            if last is not None:
                close(last)
        if tag in BLOCK:
            block += 1
        if tag == "br":
            yield block, tuple(t for t, _ in stack), stack[-1][1] if stack else "plain", "\n"
        if tag in VOID or m[0].endswith("/>") and tag not in BLOCK | RAW:
            continue
        mark = _mark(tag, m[0])
        if stack and (stack[-1][1] == "furniture" or mark == "plain"):
            mark = stack[-1][1]
        # A header inside the content holds its headline.
        if tag == "header" and stack and stack[-1][1] == "content":
            mark = "content"
        stack.append((tag, mark))
        if tag in RAW:
            raw_until = tag
    if at < len(page) and not raw_until:
        tail = page[at:]
        cut = re.search(r"<(?:[a-zA-Z/!?][^<>]*)?$", tail)  # a tag that the page's end cuts off
        yield block, tuple(t for t, _ in stack), stack[-1][1] if stack else "plain", _html.unescape(tail[: cut.start()] if cut else tail)


def _region(key: tuple) -> tuple:
    """What a path's text stands or falls with: its innermost holder; for content the outermost article or main, if any."""
    path, mark = key
    if mark == "content":
        i = next((i for i, t in enumerate(path) if t in ("article", "main")), None)
    else:
        i = None
    if i is None:
        i = max((i for i, t in enumerate(path) if t in HOLDERS), default=-1)
    return path[: i + 1], mark


def path_ratios(found: list[tuple[int, tuple[str, ...], str, str]]) -> tuple[dict, dict]:
    """Of each path and mark with text, in the order of first nodes: characters, punctuation and number of its nodes; and its ratio.

    The ratio adds the logarithms of characters and of punctuation a node, is smoothed over the neighbouring paths of the
    same mark, so furniture's ratios don't run into its neighbours, and fused with its value before by their geometric
    mean, so a menu beside a story doesn't pass for one.
    """
    totals: dict[tuple, list[float]] = {}
    for _, path, mark, text in found:
        if text.strip():
            t = totals.setdefault((path, mark), [0.0, 0.0, 0.0])
            t[0] += len(text.strip())
            t[1] += sum(map(text.count, PUNCTUATION))
            t[2] += 1
    keys = list(totals)
    kernel = {d: math.exp(-d * d / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)}
    raw = {k: math.log1p(c / n) + math.log1p(p / n) for k, (c, p, n) in totals.items()}
    ratios = {}
    for i, k in enumerate(keys):
        near = [(w, raw[keys[i + d]]) for d, w in kernel.items() if 0 <= i + d < len(keys) and keys[i + d][1] == k[1]]
        smooth = sum(w * v for w, v in near) / sum(w for w, _ in near)
        ratios[k] = math.sqrt(raw[k] * smooth)
    return totals, ratios


def chosen(totals: dict, ratios: dict) -> set:
    """The paths that are content.

    Ratios are fused with PRIOR, what the marks weigh. Regions are weighed by their paths' characters times ratios, and
    those of HALF of the strongest rival's weight stay; of a region that stays, paths from SHARE of the best ratio on.
    Where nothing is marked as content the plain paths from PLAIN_SHARE of the best fused ratio on are.
    """
    fused = {k: PRIOR[k[1]] * v for k, v in ratios.items()}
    best = max(fused.values(), default=0.0)
    if not any(k[1] == "content" and v > 0 for k, v in fused.items()):
        return {k for k, v in fused.items() if v > 0 and v >= best * PLAIN_SHARE}
    evidence: dict[tuple, float] = {}
    for k in totals:
        if PRIOR[k[1]]:
            evidence[_region(k)] = evidence.get(_region(k), 0.0) + totals[k][0] * ratios[k]
    evidence = {r: NAMED * e + ADDED if r[1] == "content" else e for r, e in evidence.items()}
    plain = max((e for r, e in evidence.items() if r[1] == "plain"), default=0.0)
    kept = {k for k, v in fused.items() if k[1] == "content" and v >= best * SHARE and evidence[_region(k)] >= HALF * plain}
    return kept | {k for k in totals if k[1] == "plain" and evidence[_region(k)] >= HALF * max(evidence.values())}


def extract(page: str | None) -> str:
    """The page's main text: blocks joined by an empty line, white space inside a block made one space; empty if none."""
    found = list(nodes(page or ""))
    kept = chosen(*path_ratios(found))
    blocks: dict[int, list[str]] = {}
    for number, path, mark, text in found:
        if (path, mark) in kept or not text.strip():
            blocks.setdefault(number, []).append(text)
    texts = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n\n".join(t for t in texts if t)


def extract_pages(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, text (the main text) and n_chars (its code points) of each row.

    Null and empty pages, and pages with markup only, have an empty text. Repeated rows give repeated rows; other columns
    are left out, so their names can't clash. Any bytes that aren't markup are text: broken tags raise no error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [extract(x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return bounded_batches(pages.select(*keep, page)).mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["text string", "n_chars long"]))
