"""Sharding by a k-d tree over document metadata, cut at distributed weighted medians."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltyard.llm.base import join_by_count, materialize

_DIGIT = 12  # bits of a key that one pass over the rows tells apart
_KEY = 60  # bits of a key: 20 of the coordinate, 40 of the text's hash
DIMENSIONS = ("size", "lang", "source", "first_id")


_SLAB = 256  # so few rows at a border are weighed one by one
_RUN = 4096  # copies of a row that are numbered at once


@dataclass(frozen=True)
class Cut:
    """Rows of node ``node`` whose key in dimension ``dimension`` (a number) is below ``low`` go left; so do those
    whose key is ``key`` and whose own hash is below ``row``, and the few whose hash is in ``chosen``."""

    node: int
    dimension: int
    low: int
    key: int = -1
    row: int = 0
    chosen: tuple[int, ...] = ()


def small(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows a shard, sent to every task."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    columns = [c.split() for c in schema.split(", ")]
    table = pa.table({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(columns)})
    return F.broadcast(df.sparkSession.createDataFrame(table))  # a local relation, which takes no job


def keyed(rows: DataFrame, dimensions: dict[int, int]) -> DataFrame:
    """The rows of these nodes, each with its key in its node's dimension."""
    of = small(rows, list(dimensions.items()), "node long, dimension int")
    return rows.join(of, "node").withColumn("key", F.element_at(F.array(*[f"k_{d}" for d in DIMENSIONS]), F.col("dimension") + 1))


def moved(rows: DataFrame, cuts: list[Cut]) -> DataFrame:
    """Rows of cut nodes a level further: 1 is the root, 2n and 2n + 1 are below n."""
    table = [(c.node, c.dimension, c.low, c.key, c.row, list(c.chosen)) for c in cuts]
    of = small(rows, table, "node long, c_dimension int, c_low long, c_key long, c_row long, c_chosen array<long>")
    key = F.element_at(F.array(*[f"k_{d}" for d in DIMENSIONS]), F.col("c_dimension") + 1)
    left = (key < F.col("c_low")) | ((key == F.col("c_key")) & (F.col("row_hash") < F.col("c_row"))) | F.array_contains("c_chosen", F.col("row_hash"))
    node = F.when(F.col("c_low").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(left, 0).otherwise(1))
    return rows.join(of, "node", "left").withColumn("node", node).drop("c_dimension", "c_low", "c_key", "c_row", "c_chosen")


def text_order(c: Column) -> Column:
    """A number in the order of the strings' first six bytes; null is lowest."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double") + 1, F.lit(0.0))


def metadata(docs: DataFrame) -> DataFrame:
    """One row a row of ``docs``: doc_id, size, text_crc32, row_hash and a key for each dimension.

    The dimensions are those of a text's whole group, the rows that have the same text: its size and its least
    language, source and id. A key is the coordinate, scaled to 20 bits, and then the text's hash, so that a
    group is one value in every dimension. Rows that share text and id are counted and numbered, and the number is
    part of ``row_hash``, which so tells all rows apart and depends on no order.
    """
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    names = set(docs.columns)
    column = lambda n, kind: (F.col(f"`{n}`") if n in names else F.lit(None)).cast(kind).alias(n)
    rows = docs.select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("text_hash"), column("lang", "string"), column("source", "string")
    )
    counted = rows.groupBy("text_hash", "text_crc32", "size", "doc_id").agg(F.min("lang").alias("lang"), F.min("source").alias("source"), F.count(F.lit(1)).alias("n"))
    rows, seen = materialize(counted, F.count(F.lit(1)).alias("rows"))
    group = rows.groupBy("text_hash", "text_crc32", "size").agg(F.min("lang").alias("lang"), F.min("source").alias("source"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("members"))
    at = {"size": F.log2("size"), "lang": text_order(F.col("lang")), "source": text_order(F.col("source")), "first_id": F.coalesce(F.col("first_id"), F.lit(0)).cast("double")}
    group = group.select("text_hash", "text_crc32", F.col("size").alias("group_size"), "members", *[c.alias(d) for d, c in at.items()])
    ends = group.agg(*[f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)])
    scaled = []
    for d in DIMENSIONS:
        low, high = F.col(f"min_{d}"), F.col(f"max_{d}")
        step = F.floor((F.col(d) - low) / F.greatest(high - low, F.lit(1e-9)) * ((1 << 20) - 1)).cast("long")
        scaled.append((F.shiftleft(step, 40) + F.col("text_hash").bitwiseAND((1 << 40) - 1)).alias(f"k_{d}"))
    keys = group.crossJoin(F.broadcast(ends)).select("text_hash", "text_crc32", F.col("group_size").alias("size"), "members", *scaled)
    joined = join_by_count(rows, keys, ["text_hash", "text_crc32", "size"], "members", seen["rows"], "inner")
    run = joined.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_RUN).cast("long"))))
    each = run.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + _RUN, F.col("n")) - 1)))
    row_hash = F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", "copy", F.lit("row")), 64 - _KEY)
    return each.select("doc_id", "size", "text_crc32", row_hash.alias("row_hash"), *[f"k_{d}" for d in DIMENSIONS])


def weighted_cut(rows: DataFrame, key: str, wanted: dict[int, float], whole: dict[int, float]) -> tuple[dict[int, tuple[int, tuple[int, ...]]], dict[int, tuple[int, float]]]:
    """For each node the key below which the weight comes nearest under what is wanted, and the rows at the
    border that fill it up; or, of nodes where one key alone has many rows there, that key and what is wanted of it.

    Each pass sums weights by the next digit of the key, of the rows that share the digits found so far, and
    brings back the sums at each node's border, until the border lies among few rows.
    """
    prefix, left, heavy = dict.fromkeys(wanted, 0), dict(wanted), {}
    slabs: dict[int, tuple[int, int, int]] = {}
    for shift in range(_KEY - _DIGIT, -1, -_DIGIT):
        todo = [n for n in wanted if n not in slabs]
        if not todo:
            break
        of = small(rows, [(n, prefix[n], float(left[n])) for n in todo], "node long, w_prefix long, w_left double")
        digit = F.shiftrightunsigned(key, shift)
        here = rows.join(of, "node").where(F.shiftrightunsigned(digit, _DIGIT) == F.col("w_prefix"))
        sums = here.groupBy("node", "w_left", digit.bitwiseAND((1 << _DIGIT) - 1).alias("digit")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
        by = Window.partitionBy("node").orderBy("digit")  # at most 4096 sums
        all_ = Window.partitionBy("node")
        sums = sums.withColumn("to", F.sum("w").over(by)).withColumn("at", F.row_number().over(by)).withColumn("bins", F.count(F.lit(1)).over(all_))
        border = F.least(F.sum((F.col("to") <= F.col("w_left")).cast("int")).over(all_) + 1, F.col("bins"))
        got = sums.withColumn("border", border).where((F.col("at") <= F.col("border")) & (F.col("at") > F.col("border") - _SLAB)).collect()
        for n in todo:
            bins = sorted((r["digit"], r["w"], r["n"], r["to"]) for r in got if r["node"] == n)
            at = len(bins) - 1
            left[n] -= bins[at][3] - bins[at][1]
            above = prefix[n] << _DIGIT
            prefix[n] = above + bins[at][0]
            count = bins[at][2]
            if count <= _SLAB:
                first = at  # the bins before it, as long as all are few rows, so that rows can be chosen among
                while first and count + bins[first - 1][2] <= _SLAB:
                    first -= 1
                    count += bins[first][2]
                    left[n] += bins[first][1]
                slabs[n] = (above + bins[first][0], prefix[n], shift)
            elif shift == 0:
                heavy[n] = (prefix[n], left[n])
    found: dict[int, tuple[int, tuple[int, ...]]] = {}
    if slabs:
        of = small(rows, [(n, *x) for n, x in slabs.items()], "node long, w_lo long, w_hi long, w_shift int")
        near = rows.join(of, "node").where(F.expr(f"shiftrightunsigned({key}, w_shift)").between(F.col("w_lo"), F.col("w_hi")))
        by_node = defaultdict(list)
        for r in near.select("node", F.col(key).alias("key"), "row_hash", "size").collect():  # at most 256 a node
            by_node[r["node"]].append((r["key"], r["row_hash"], r["size"]))
        for n, (lo, _, shift) in slabs.items():
            found[n] = (lo << shift, fill(by_node[n], left[n], whole[n]))
    return found, heavy


def fill(rows: list[tuple[int, int, int]], wanted: float, whole: float) -> tuple[int, ...]:
    """Of some rows (key, hash, weight), those that come nearest to the weight wanted: all rows of a key or
    none, the heaviest first; only if more than ``whole`` is still wanted then, some rows of a key."""
    units: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k, h, w in sorted(rows):
        units[k].append((w, h))
    out, skipped = [], []
    for k, unit in sorted(units.items(), key=lambda x: (-sum(w for w, _ in x[1]), x[0])):
        total = sum(w for w, _ in unit)
        if total <= wanted:
            out += [h for _, h in unit]
            wanted -= total
        else:
            skipped.append(unit)
    if wanted > whole:
        for w, h in sorted((x for unit in skipped if len(unit) > 1 for x in unit), reverse=True):
            if w <= wanted:
                out.append(h)
                wanted -= w
    rest = [x for unit in skipped if len(unit) == 1 for x in unit]
    if rest and abs(min(rest)[0] - wanted) < wanted:  # one row too many is nearer than none
        out.append(min(rest)[1])
    return tuple(out)


def placed(rows: DataFrame, shards: int, tolerance: float = 0.005) -> DataFrame:
    """``rows`` with the ``shard`` of each. A node of k shards is cut so that its left part has k // 2 of them, along
    the dimension that is widest in it, until each leaf holds the bytes of one shard. All nodes of a level are cut
    together, by joins with tables of a row a node, so that a plan is as long for thousands of shards as for few.

    Groups of equal texts stay whole where the border comes within ``tolerance`` of a shard's bytes without
    splitting them; else it goes through the group that is there, between rows by their hash.
    """
    parts, leaves, depth = {1: shards}, {}, 0
    rows = rows.withColumn("node", F.lit(1).cast("long"))
    while any(k > 1 for k in parts.values()):
        leaves |= {n: k for n, k in parts.items() if k == 1}
        parts = {n: k for n, k in parts.items() if k > 1}
        width = [(F.max(f"k_{d}") - F.min(f"k_{d}")).alias(d) for d in DIMENSIONS]
        seen = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *width).collect() if r["node"] in parts}
        wanted = {n: seen[n]["bytes"] * (k // 2) / k for n, k in parts.items() if n in seen}
        whole = {n: seen[n]["bytes"] / parts[n] * tolerance for n in wanted}
        widest = {n: max(range(len(DIMENSIONS)), key=lambda d: seen[n][DIMENSIONS[d]]) for n in wanted}
        cuts: list[Cut] = []
        if wanted:
            at = keyed(rows, widest)
            found, heavy = weighted_cut(at, "key", wanted, whole)
            inside, again = {}, {}
            if heavy:
                of = small(rows, [(n, k) for n, (k, _) in heavy.items()], "node long, h_key long")
                inside, again = weighted_cut(at.join(of, "node").where("key = h_key"), "row_hash", {n: w for n, (_, w) in heavy.items()}, whole)
            cuts += [Cut(n, widest[n], low, chosen=chosen) for n, (low, chosen) in found.items()]
            inside |= {n: (h, ()) for n, (h, _) in again.items()}  # a node is always cut, so that no row is left inside
            cuts += [Cut(n, widest[n], k, k, inside[n][0], inside[n][1]) for n, (k, _) in heavy.items()]
        cuts += [Cut(n, 0, 0) for n in parts if n not in wanted]
        rows = moved(rows, cuts)
        depth += 1
        if depth % 4 == 0:
            rows = materialize(rows)
        parts = {c: s for n, k in parts.items() for c, s in ((2 * n, k // 2), (2 * n + 1, k - k // 2))}
    leaves |= parts
    order = sorted(leaves, key=lambda n: n / (1 << n.bit_length()))
    return rows.join(small(rows, [(n, i) for i, n in enumerate(order)], "node long, shard int"), "node")


def shard(docs: DataFrame, shards: int = 8, rows_a_bucket: int = 200_000) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one a row of ``docs``.

    The law is ``bytes``: shards' sums of ``size`` (UTF-8 bytes and 1; a null or empty text has 1) are nearly
    equal. Rows with equal texts stay together where that leaves shards nearly equal; rows of one key (a tie) are
    split by their hash where a border goes through them. ``slot`` counts a shard's rows from 0. Missing or null lang
    and source are lowest, rows with a null id are placed like others, repeated rows each count, further columns are
    ignored, and an empty table gives no row.
    """
    rows, seen = materialize(metadata(docs), F.count(F.lit(1)).alias("n"))
    rows = placed(rows, shards) if seen["n"] else rows.withColumn("shard", F.lit(0))
    buckets = max(1, -(-seen["n"] // rows_a_bucket))
    rows = rows.withColumn("bucket", F.pmod("row_hash", F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bucket").orderBy("row_hash", "doc_id")
    out = rows.join(counts, ["shard", "bucket"]).withColumn("slot", F.col("before") + F.row_number().over(within) - 1)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
