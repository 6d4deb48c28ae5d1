"""K-d tree partitioning of documents into shards of near equal bytes.

The tree splits a node along the dimension of the metadata that is widest in it, at the weighted quantile that gives each
side its share of the leaves' bytes (the weighted median where the leaves divide evenly), until a node is one leaf. All
nodes of a level are split together: one aggregation counts the bytes of each node in bins of its dimension, the bin that
holds the quantile is cut into bins again, and rows that are equal in the dimension are told apart by a hash of the row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.llm.common import written

BINS = 1024
TOLERANCE = 1e-4  # of a leaf's bytes, to which a split's place is found
SLOT_ROWS = 50_000  # rows of a shard that one task numbers


BROADCAST_ROWS = 100_000  # distinct values up to this many are broadcast with their ranks, beyond it joined by a shuffle


def ranked(rows: DataFrame, column: str, rank: str) -> DataFrame:
    """rows with rank, the place from 0 of the column's value among the distinct ones in order; -1 for a null.

    Values are dealt by range and numbered in their ranges, so any number of them, however alike, keeps its order.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("_value")).distinct()
    dealt = written(values.repartitionByRange(n, "_value").withColumn("_part", F.spark_partition_id()), "values")
    sizes = dealt.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))  # a row for each range
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_value"))
    numbered = dealt.withColumn("_i", inside).join(F.broadcast(firsts), F.col("_part") == F.col("_p")).select("_value", (F.col("_first") + F.col("_i") - 1).cast("double").alias("_rank"))
    small = dealt.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(numbered) if small else numbered, F.col(column) == F.col("_value"), "left")
    return joined.withColumn(rank, F.coalesce("_rank", F.lit(-1.0))).drop("_value", "_rank")


def _at(values: list, node: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), node + 1)


class Cut(NamedTuple):
    value: float
    below: float  # weight of the rows below the value
    at: float  # weight of the rows at the value; 0 if they all go to one side
    left: bool  # the side of the rows at the value, if they go to one


def _quantiles(level: DataFrame, nodes: dict[int, tuple[float, float]], value: Column, targets: dict[int, float], tol: float) -> dict[int, Cut]:
    """For each node the value at which its running weight reaches the target. nodes: least and greatest value.

    Each round brings a row for every node and bin to the driver: a bounded table, however large the input is.
    """
    found: dict[int, Cut] = {}
    below = dict.fromkeys(nodes, 0.0)
    spans = dict(nodes)
    while open_ := spans.keys() - found.keys():
        top = max(spans) + 1
        a, b = (_at([float(spans.get(k, (0.0, 0.0))[side]) for k in range(top)], F.col("node")) for side in (0, 1))
        bin_ = F.when(b > a, F.least(F.floor((value - a) / (b - a) * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")
        inside = level.filter(F.col("node").isin(*open_) & (value >= a) & (value <= b))
        rows = inside.groupBy("node", bin_.alias("bin")).agg(F.sum("weight").alias("w"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
        for k in open_:
            run = below[k]
            mine = sorted((r for r in rows if r["node"] == k), key=lambda r: r["bin"])
            for r in mine:
                if run + r["w"] >= targets[k] or r is mine[-1]:
                    if r["lo"] == r["hi"]:
                        found[k] = Cut(r["lo"], run, float(r["w"]), False)
                    elif r["w"] <= tol:  # fine enough: the bin goes to the nearer side as a whole
                        left = targets[k] - run > r["w"] / 2
                        found[k] = Cut(r["hi"] if left else r["lo"], run, 0.0, left)
                    else:
                        spans[k], below[k] = (r["lo"], r["hi"]), run
                    break
                run += r["w"]
    return found


def kd_shards(rows: DataFrame, dims: list[str], weight: str, tie: str, leaves: int) -> DataFrame:
    """rows with shard, from 0 to leaves - 1, of near equal sums of weight.

    dims: numeric columns without nulls; weight: positive; tie: a double that spreads the rows that are equal in all
    dims. Rows that are equal in dims and tie stay together. An empty table gives an empty result.
    """
    span = rows.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))], F.sum(weight).alias("w")).first()
    total = float(span["w"] or 0)
    width = {d: (span[f"hi_{d}"] or 0.0) - (span[f"lo_{d}"] or 0.0) for d in dims}
    tol = TOLERANCE * total / leaves
    level = rows.withColumn("node", F.lit(0)).withColumn("weight", F.col(weight).cast("double"))
    share = {0: (0, leaves)}  # node -> its first leaf and number of leaves
    while any(k > 1 for _, k in share.values()):
        stats = {r["node"]: r for r in level.groupBy("node").agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))], F.sum("weight").alias("w"), F.min(tie).alias("lo_tie"), F.max(tie).alias("hi_tie")).collect()}
        split = [k for k, (_, m) in share.items() if m > 1 and k in stats]
        if not split:
            break
        widest = {k: max(dims, key=lambda d: ((stats[k][f"hi_{d}"] - stats[k][f"lo_{d}"]) / width[d] if width[d] else 0.0)) for k in split}
        targets = {k: stats[k]["w"] * (share[k][1] // 2) / share[k][1] for k in split}
        top = max(share) + 1
        value = _at([dims.index(widest.get(k, dims[0])) for k in range(top)], F.col("node"))
        value = F.coalesce(*[F.when(value == i, F.col(d).cast("double")) for i, d in enumerate(dims)])
        cuts = _quantiles(level, {k: (stats[k][f"lo_{widest[k]}"], stats[k][f"hi_{widest[k]}"]) for k in split}, value, targets, tol)
        # Where many rows share the value, the hash splits them; rows that share the hash too go to the nearer side.
        even = {k: c for k, c in cuts.items() if c.at > 0}
        here, node = _at([float(cuts[k].value) if k in cuts else 0.0 for k in range(top)], F.col("node")), F.col("node")
        ties: dict[int, Cut] = {}
        if even:
            equal = level.filter(node.isin(*even) & (value == here))
            ties = _quantiles(equal, {k: (stats[k]["lo_tie"], stats[k]["hi_tie"]) for k in even}, F.col(tie), {k: targets[k] - even[k].below for k in even}, tol)
            ties = {k: c if c.at == 0 else c._replace(left=targets[k] - even[k].below - c.below > c.at / 2) for k, c in ties.items()}
        mark = _at([float(ties[k].value) if k in ties else 0.0 for k in range(top)], node)
        whole = _at([k in cuts and cuts[k].left for k in range(top)], node)
        tied, mark_left = _at([k in ties for k in range(top)], node), _at([k in ties and ties[k].left for k in range(top)], node)
        left = (value < here) | (value == here) & (whole | tied & ((F.col(tie) < mark) | (F.col(tie) == mark) & mark_left))
        child = F.when(F.col("node").isin(*split), F.col("node") * 2 + F.when(left, 0).otherwise(1)).otherwise(F.col("node") * 2)
        level = written(level.withColumn("node", child), "level")
        share = {c: s for k, (first, m) in share.items() for c, s in (((2 * k, (first, m // 2)), (2 * k + 1, (first + m // 2, m - m // 2))) if m > 1 and k in split else ((2 * k, (first, m)),))}
    firsts = [share.get(k, (0, 1))[0] for k in range(max(share) + 1)]
    return level.withColumn("shard", _at(firsts, F.col("node")).cast("int")).drop("node", "weight")


def with_slots(rows: DataFrame, shard: str, order: str) -> DataFrame:
    """rows with slot, a number without gaps from 0 inside each shard; a shard is numbered in buckets, by many tasks."""
    most = rows.groupBy(shard).count().agg(F.max("count")).first()[0] or 0
    n = max(1, -(-most // SLOT_ROWS))
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(n)).cast("int"))
    before = Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(shard, "_b").agg(F.count("*").alias("_n")).select(F.col(shard).alias("_s"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(shard, "_b").orderBy(order)
    numbered = dealt.withColumn("_i", F.row_number().over(inside))
    return numbered.join(offsets, (F.col(shard) == F.col("_s")) & (F.col("_b") == F.col("_bb"))).withColumn("slot", (F.col("_off") + F.col("_i") - 1).cast("long")).drop("_b", "_i", "_s", "_bb", "_off")


def _placed(docs: DataFrame, keep: list[str], leaves: int) -> DataFrame:
    """keep, size, text_crc32, shard and _tie of each row of docs."""
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    lang, source = (F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source"))
    slim = docs.select(
        *keep,
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        lang.alias("_lang"),
        source.alias("_source"),
    )
    # The row's number tells repeated rows apart. It is drawn once: the table is written before anything reads it.
    slim = slim.withColumn("_size", F.log2("size")).withColumn("_tie", F.xxhash64(*keep, "text_crc32", "size", F.monotonically_increasing_id()).cast("double"))
    slim = written(slim, "metadata")
    slim = ranked(ranked(slim, "_lang", "_lang_rank"), "_source", "_source_rank").drop("_lang", "_source")
    return kd_shards(written(slim, "ranked"), ["_size", "_lang_rank", "_source_rank"], "size", "_tie", leaves)


def document_shards(docs: DataFrame, leaves: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each document.

    size is the text's UTF-8 bytes plus 8 (null text: 8; its checksum is that of an empty text). The dimensions are the
    size's logarithm, and the ranks of language and source; a null is before all values. Repeated rows are split like any
    others and have slots of their own. Missing lang or source columns are taken as null; other columns are left out; an
    empty table gives an empty result.
    """
    out = with_slots(_placed(docs.select(*[c for c in docs.columns if c in ("doc_id", "text", "lang", "source")]), ["doc_id"], leaves), "shard", "_tie")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, leaves: int = 24) -> None:
    """Writes docs as Parquet in a folder shard=k for each of leaves shards of near equal bytes.

    Rows are numbered in a copy in the shared folder, so repeated rows are told apart and each is written once. A column
    shard of docs is left out; nulls are as in document_shards; an empty table writes no folder.
    """
    numbered = written(docs.drop("shard").withColumn("_row", F.monotonically_increasing_id()), "rows")
    shards = _placed(numbered.select("_row", *[c for c in docs.columns if c in ("text", "lang", "source")]), ["_row"], leaves).select(F.col("_row").alias("_of"), "shard")
    numbered.join(shards, F.col("_row") == F.col("_of")).drop("_row", "_of").write.partitionBy("shard").parquet(path)
