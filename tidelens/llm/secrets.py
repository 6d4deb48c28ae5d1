"""Secrets in texts, with Spark SQL functions only.

Three patterns give the base spans. Besides, every candidate string (a long run of key characters) is scanned with a
sliding window: one character enters and one leaves, which changes two counts and the sum of c * log2(c) by two table
entries and gives the window's Shannon entropy at every place. Windows above the threshold of their character class are a
secret: a candidate as a whole is of one class, and runs of hex digits inside a mixed candidate are scanned under the
class of hex digits. An allow-list suppresses candidates and runs known as harmless.

Every character is read a bounded number of times, so a candidate and a text may be of any length. Positions are code
points, end exclusive. They follow from the pieces between matches: no engine function returns them. Folds run in blocks,
as an array that grows by one costs a copy of itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in order, their patterns and the least lengths of what they must hold.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: The method's kinds: character class, entropy in bits from which a window is a secret's.
CLASSES = (("entropy_hex", "^[0-9a-fA-F]+$", 3.0), ("entropy_base64", "^[A-Za-z0-9+/_=-]+$", 3.8))
WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
HEX_RUN = f"[0-9a-fA-F]{{{WINDOW},}}"  # all windows of hex digits in a candidate lie in one
#: Matches of a run of a class start where the run does; saying so spares the search from each of its characters.
_WHOLE = {CANDIDATE: f"(?<![A-Za-z0-9+/_=-]){CANDIDATE}+", HEX_RUN: f"(?<![0-9a-fA-F]){HEX_RUN}+"}
#: Harmless candidates: words or numbers only, unique ids, counting sequences, and the keys of public documentation.
ALLOWED = (
    r"^[A-Za-z+/_=-]+$",
    r"^[0-9+/_=-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"0123456789abcdef|0123456789ABCDEF|abcdefghijklm|ABCDEFGHIJKLM|1234567890",
    r"EXAMPLE",
)

_SPAN = "struct<start:bigint,kind:int,end:bigint,byte:bigint,hit:string>"  # byte: where the span starts in UTF-8
_SPANS = f"array<{_SPAN}>"
BLOCK = 256  # items that a fold collects before its results are put away

_UNIT = 1 << 40  # entropies are sums of whole numbers of these parts of a bit, so they do not drift
_WEIGHT = [round(c * math.log2(c) * _UNIT) if c else 0 for c in range(WINDOW + 1)]


def _none() -> Column:
    return F.array().cast(_SPANS)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once: inside a fold an expression is evaluated wherever it stands."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan(items: Column, zero: Column, step: Callable, give: Callable, kind: str) -> Column:
    """give(state before, item) for each item of an array, where step(state, item) is the next state; results of type kind."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(give(acc["state"], x))).alias("out"))

    def block(acc: Column, all_: Column, at: Column) -> Column:
        done = F.aggregate(F.slice(all_, at, F.lit(BLOCK)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return _bound(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["outs"], F.array(d["out"])).alias("outs")))

    start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("outs"))
    run = lambda all_: F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(all_), F.lit(BLOCK)), start, lambda acc, at: block(acc, all_, at), lambda acc: acc["outs"]))
    return _bound(items, lambda all_: F.when(F.size(all_) > 0, run(all_)).otherwise(none))


def _found(text: Column, pattern: str, kind: int, inner: int = 0) -> Column:
    """All leftmost non-overlapping matches as spans; hit is the group inner. Matches are of ASCII characters."""
    pattern = _WHOLE.get(pattern, pattern)
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(inner)) if inner else match
    parts = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("piece"), match.alias("match"), hit.alias("hit")),
        lambda x: F.struct(F.length(x["piece"]).alias("chars"), F.octet_length(x["piece"]).alias("bytes"), F.length(x["match"]).alias("size"), x["hit"].alias("hit")),
    )
    matched = F.filter(parts, lambda x: x["size"].isNotNull())  # the piece after the last match has none
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("byte"))

    def step(s: Column, x: Column) -> Column:
        return F.struct((s["at"] + x["chars"] + x["size"]).alias("at"), (s["byte"] + x["bytes"] + x["size"]).alias("byte"))

    def give(s: Column, x: Column) -> Column:
        at = s["at"] + x["chars"]
        return F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + x["size"]).alias("end"), (s["byte"] + x["bytes"]).alias("byte"), x["hit"].alias("hit"))

    return _scan(matched, zero, step, give, _SPAN)


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, each checked after matching, by start and then kind."""

    def one(kind: int, pattern: str, least: int, inner: int, sure: str) -> Column:
        found = F.filter(_found(text, pattern, kind, inner), lambda s: F.length(s["hit"]) >= least)
        # sure: what every text with a passing match holds; it spares the rest the work.
        return F.when(text.rlike(sure), found).otherwise(_none())

    # A run's match is the whole rest of the run, so shorter ones can be left out by the pattern itself.
    hexes = f"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}+"
    return F.array_sort(
        F.concat(
            one(0, ASSIGN, LEAST["assign"], 2, ASSIGN[:-2] + f"{{{LEAST['assign']},}})"),
            one(1, ACCESS, LEAST["access"], 0, ACCESS),
            one(2, hexes, LEAST["hex"], 0, hexes),
        )
    )


def _hot(hit: Column, least: Column) -> Column:
    """First and last place in the string at which a window of WINDOW characters starts whose entropy is least or more.

    The counts are 128 bytes, one for each character code; a step changes two of them.
    """
    gains = F.expr("array(" + ", ".join(f"{b - a}L" for a, b in zip(_WEIGHT, _WEIGHT[1:], strict=False)) + ")")
    digits = F.expr("array(" + ", ".join(f"X'{c:02x}'" for c in range(WINDOW + 2)) + ")")
    byte = lambda bin_, at: F.ascii(F.substring(bin_, at, F.lit(1)).cast("string"))
    put = lambda bin_, code, n: F.overlay(bin_, F.element_at(digits, n + 1), code + 1, F.lit(1))

    def run(all_: Column) -> Column:
        """all_: the string's bytes, and the greatest sum of c * log2(c) of a hot window."""
        init = F.struct(F.lit(bytearray(128)).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

        def step(acc: Column, i: Column) -> Column:
            codes = F.struct(byte(all_["bin"], i + 1).alias("come"), F.when(i >= WINDOW, byte(all_["bin"], i + 1 - WINDOW)).otherwise(F.lit(-1)).alias("go"))

            def turn(c: Column) -> Column:
                times = F.struct(
                    c["come"].alias("come"),
                    c["go"].alias("go"),
                    byte(acc["counts"], c["come"] + 1).alias("came"),
                    F.when(c["go"] >= 0, byte(acc["counts"], c["go"] + 1)).otherwise(F.lit(0)).alias("gone"),
                )

                def change(x: Column) -> Column:
                    grown = put(acc["counts"], x["come"], x["came"] + 1)
                    moved = F.when(x["come"] == x["go"], acc["counts"]).when(x["go"] >= 0, put(grown, x["go"], x["gone"] - 1)).otherwise(grown)
                    lost = F.when(x["go"] >= 0, F.element_at(gains, x["gone"])).otherwise(F.lit(0).cast("bigint"))
                    total = F.when(x["come"] == x["go"], acc["sum"]).otherwise(acc["sum"] + F.element_at(gains, x["came"] + 1) - lost)
                    return F.struct(moved.alias("counts"), total.alias("sum"))

                return _bound(times, change)

            def marked(n: Column) -> Column:
                hot = (i >= WINDOW - 1) & (n["sum"] <= all_["most"])
                at = i - (WINDOW - 1)
                return F.struct(n["counts"].alias("counts"), n["sum"].alias("sum"), F.when(hot & (acc["first"] < 0), at).otherwise(acc["first"]).alias("first"), F.when(hot, at).otherwise(acc["last"]).alias("last"))

            return _bound(_bound(codes, turn), marked)

        return F.aggregate(F.sequence(F.lit(0), F.octet_length(all_["bin"]) - 1), init, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    most = F.floor((F.lit(math.log2(WINDOW)) - least) * WINDOW * _UNIT)
    return _bound(F.struct(F.encode(hit, "US-ASCII").alias("bin"), most.alias("most")), run)


def _harmless(hit: Column) -> Column:
    return hit.rlike("|".join(ALLOWED))


def entropy_spans(text: Column) -> Column:
    """Spans of high entropy: from the first window above its class's threshold to the last one's end.

    They are those of whole candidates, under the candidate's class, and those of the hex runs inside candidates of
    another class (key=..., /v1/...), whose threshold hex digits hardly reach.
    """

    def within(s: Column, r: Column | None, kind: Column, least: Column) -> Column:
        hit, at, byte = (s["hit"], s["start"], s["byte"]) if r is None else (r["hit"], s["start"] + r["start"], s["byte"] + r["byte"])
        return _bound(_hot(hit, least), lambda x: F.struct((at + x["first"]).alias("start"), kind.alias("kind"), F.when(x["first"] >= 0, at + x["last"] + WINDOW).alias("end"), (byte + x["first"]).alias("byte"), hit.alias("hit")))

    def scan(s: Column) -> Column:
        kind, least = F.lit(None).cast("int"), F.lit(None).cast("double")
        for k, (_, chars, bits) in reversed(list(enumerate(CLASSES))):
            kind = F.when(s["hit"].rlike(chars), F.lit(len(KINDS) + k)).otherwise(kind)
            least = F.when(s["hit"].rlike(chars), F.lit(bits)).otherwise(least)
        runs = F.filter(_found(s["hit"], HEX_RUN, 0), lambda r: ~_harmless(r["hit"]))
        inside = F.transform(runs, lambda r: within(s, r, F.lit(len(KINDS)), F.lit(CLASSES[0][2])))
        mixed = s["hit"].rlike(HEX_RUN) & ~s["hit"].rlike(CLASSES[0][1])
        return F.concat(F.array(within(s, None, kind, least)), F.when(mixed, inside).otherwise(_none()))

    # A candidate is taken apart by one pass over the matches: filter first, so only open ones are scanned.
    open_ = F.filter(_found(text, CANDIDATE, 0), lambda s: ~_harmless(s["hit"]))
    hot = F.filter(F.flatten(F.transform(open_, scan)), lambda s: s["end"].isNotNull())
    return F.when(text.rlike("[0-9]") & text.rlike(_WHOLE[CANDIDATE]), hot).otherwise(_none())


def all_spans(base: Column, high: Column) -> Column:
    """Base spans and those of high entropy that lie inside no base span, by start and then kind."""
    is_base = lambda s: s["kind"] < len(KINDS)
    reach = lambda far, s: F.when(is_base(s), F.greatest(far, s["end"])).otherwise(far)
    kept = _scan(F.array_sort(F.concat(base, high)), F.lit(-1).cast("bigint"), reach, lambda far, s: F.when(is_base(s) | (far < s["end"]), s), _SPAN)
    return F.filter(kept, lambda s: s.isNotNull())


def scan(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """docs with two more columns and their names: base spans, and all spans, by start and then kind.

    An entropy span that lies inside a base span is left out, as the base span stays. A null text is empty and has no
    spans; other columns stay as they are, the new ones' names avoid theirs.
    """
    base, spans = "_base", "_spans"
    while {base, spans} & {c.lower() for c in docs.columns}:
        base, spans = base + "_", spans + "_"
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(base, base_spans(body)).withColumn(spans, all_spans(F.col(base), entropy_spans(body))), base, spans


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, *(c[0] for c in CLASSES))])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def _is(kind: int):
    return lambda s: s["kind"] == kind


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256 and spans of each row (see scan)."""
    found, base, spans = scan(docs.select(key, text), text)
    counts = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(key, *counts, F.sha2(F.encode(_text(F.col(base)), "UTF-8"), 256).alias("base_sha256"), _text(F.col(spans)).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of the text replaced by mark; overlapping spans are one. A null text stays null."""
    found, base, spans = scan(docs, text)
    end = lambda s: s["byte"] + s["end"] - s["start"]  # noqa: E731 - a span is of ASCII characters

    def cut(x: Column) -> Column:
        """x: the text's bytes and the spans. A fresh span leaves what stands before it, and the mark."""
        before = lambda at, s: F.substring(x["bin"], (at + 1).cast("int"), (s["byte"] - at).cast("int")).cast("string")
        give = lambda at, s: F.when(s["byte"] >= at, F.concat(before(at, s), F.lit(mark)))
        parts = _scan(x["spans"], F.lit(0).cast("bigint"), lambda at, s: F.greatest(at, end(s)), give, "string")
        last = F.array_max(F.transform(x["spans"], end))
        return F.concat(F.array_join(parts, ""), F.substring(x["bin"], (last + 1).cast("int"), F.octet_length(x["bin"])).cast("string"))

    whole = _bound(F.struct(F.encode(F.col(text), "UTF-8").alias("bin"), F.col(spans).alias("spans")), cut)
    return found.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(F.col(text))).drop(base, spans)


def _sql() -> str:
    def spans(kind: int, pattern: str, least: int, group: int, of: str = "d", own: str = "doc_id") -> str:
        quoted = pattern.replace("'", "''")
        return f"""
  SELECT {own}, {kind} AS kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s,
         m[i] AS whole, g[i] AS hit
  FROM (SELECT {own}, string_split_regex(t, '{quoted}') AS p, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS g FROM {of}),
       LATERAL (SELECT unnest(generate_series(1, len(m))) AS i)
  WHERE length(g[i]) >= {least}"""

    names = "['" + "','".join((*KINDS, *(c[0] for c in CLASSES))) + "']"
    kinds = " ".join(f"WHEN regexp_matches(hit, '{c}') THEN {len(KINDS) + k}" for k, (_, c, _) in enumerate(CLASSES))
    bits = " ".join(f"WHEN {len(KINDS) + k} THEN {b}" for k, (_, _, b) in enumerate(CLASSES))
    allowed = " AND ".join(f"NOT regexp_matches(hit, '{p}')" for p in ALLOWED)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, kind, CAST(s AS BIGINT) AS s, CAST(s + length(whole) AS BIGINT) AS e FROM (
{spans(0, ASSIGN, LEAST["assign"], 2)} UNION ALL {spans(1, ACCESS, LEAST["access"], 0)} UNION ALL {spans(2, HEX, LEAST["hex"], 0)})),
c AS (SELECT doc_id, s, hit, CASE {kinds} END AS kind FROM ({spans(0, CANDIDATE, WINDOW, 0)}) WHERE {allowed}),
m AS (SELECT doc_id, s AS base, hit AS t FROM c WHERE kind = {len(KINDS) + 1}),
r AS (SELECT doc_id, base + s AS s, hit, {len(KINDS)} AS kind FROM ({spans(0, HEX_RUN, WINDOW, 0, "m", "doc_id, base")}) WHERE {allowed}),
w AS (SELECT doc_id, s, kind, hit, unnest(generate_series(0, length(hit) - {WINDOW})) AS o FROM (SELECT * FROM c UNION ALL SELECT * FROM r)),
l AS (SELECT doc_id, s, kind, o, substr(hit, o + unnest(generate_series(1, {WINDOW})), 1) AS ch FROM w),
n AS (SELECT doc_id, s, kind, o, ch, count(*) AS k FROM l GROUP BY ALL),
h AS (SELECT doc_id, s, kind, o, log2({WINDOW}) - sum(k * log2(k)) / {WINDOW} AS bits FROM n GROUP BY ALL),
e AS (SELECT doc_id, kind, s + min(o) AS s, s + max(o) + {WINDOW} AS e FROM (SELECT * FROM h WHERE bits >= CASE kind {bits} END) AS x GROUP BY doc_id, kind, x.s),
a AS (SELECT * FROM b UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = e.doc_id AND b.s <= e.s AND b.e >= e.e)),
f AS (SELECT doc_id, kind, s, e, {names}[kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS x FROM a)
SELECT d.doc_id, CAST(count(*) FILTER (kind = 0) AS BIGINT) AS n_assign, CAST(count(*) FILTER (kind = 1) AS BIGINT) AS n_access, CAST(count(*) FILTER (kind = 2) AS BIGINT) AS n_hex,
       sha256(coalesce(string_agg(x, ',' ORDER BY s, kind, e) FILTER (kind < {len(KINDS)}), '')) AS base_sha256,
       coalesce(string_agg(x, ',' ORDER BY s, kind, e), '') AS spans
FROM d LEFT JOIN f ON d.doc_id = f.doc_id
GROUP BY d.doc_id
"""


SQL = _sql()
