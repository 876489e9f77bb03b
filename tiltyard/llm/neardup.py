"""Near-duplicate documents: MinHash bands, odd sketches, and exact confirmation on whole shingle sets."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltyard.llm.base import Chunk, Forest, Grouped, as_arrow, chunks, components, dropped, join_by_count, lists, map_arrow, materialize, mix, numbered, small_batches, trim

WORDS, PERCENT = 5, 75  # a shingle's words; the least similarity, in hundredths
ROWS, BANDS = 5, 48  # a pair at the least similarity shares no band once in 400,000 times
SKETCH_BITS = 512
#: Pairs that the sketches put below this are dropped unconfirmed: over five standard errors below 0.75.
SKETCH_LEAST = 0.58
#: What is compared in one task at once: so many sets, or sets of so many shingles together, or so many sketches.
BLOCK, ELEMENTS, SKETCHES = 1024, 1 << 20, 1024

_SHINGLE, _SHORT = numbered(WORDS, 3), numbered(1, 4)[0]
_FACTOR = (numbered(ROWS * BANDS, 5) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_TERM = (numbered(ROWS * BANDS, 6) >> np.uint64(32)).astype(np.uint32)
_BAND = numbered(ROWS, 7)
_FOLD = numbered(ROWS * BANDS, 8)


def shingles(part: Chunk, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles in a chunk, repeats included, and where each text's begin. A text of fewer
    words has its whole sequence as one shingle; one without words has none."""
    hashes = part.hashes()
    at = part.windows(words)
    key = np.zeros(len(at), np.uint64)
    for k in range(words):
        key += hashes[at + k] * _SHINGLE[k]
    short = np.flatnonzero((part.n_words > 0) & (part.n_words < words))
    if len(short):
        first = part.bounds[short]
        whole = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            has = part.n_words[short] > k
            whole[has] += hashes[first[has] + k] * _SHINGLE[k]
        key = np.concatenate([key, whole + _SHORT * part.n_words[short].astype(np.uint64)])
        doc = np.concatenate([part.doc[at], short])
        order = np.argsort(doc, kind="stable")
        key, doc = key[order], doc[order]
    else:
        doc = part.doc[at]
    return mix(key), np.searchsorted(doc, np.arange(part.n + 1))


def minima(values: np.ndarray) -> np.ndarray:
    """The least value of a set under each of the hash functions, a slice of the set at a time."""
    low = np.full(len(_FACTOR), 0xFFFFFFFF, np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    for lo in range(0, len(short), 2048):
        np.minimum(low, (short[lo : lo + 2048, None] * _FACTOR + _TERM).min(axis=0), out=low)
    return low


def with_text_hash(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, t1, t2, text): a text's own two hashes, so that a row can be found again."""
    return docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(9), F.col("text")).alias("t2"), "text")


def signatures(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, t1, t2, n_shingles, d1, d2, bands, sketch): the set's size, its digest (equal sets alone have
    equal ones), a key for each band and the odd sketch: the parity, at each of 512 places, of how many
    (function, minimum) samples fold there."""

    def sign(batch: pa.RecordBatch) -> dict:
        sizes, d1, d2, keys, sketches = [], [], [], [], []
        for part in chunks(batch.column(3), lower=True):
            hashes, bounds = shingles(part)
            low = np.zeros((part.n, ROWS * BANDS), np.uint32)
            for i in range(part.n):
                own = np.unique(hashes[bounds[i] : bounds[i + 1]])
                sizes.append(len(own))
                d1.append(int((own * _BAND[0]).sum()) & ((1 << 63) - 1))
                d2.append(int((mix(own) * _BAND[1]).sum()) & ((1 << 63) - 1))
                if len(own):
                    low[i] = minima(own)
            wide = low.astype(np.uint64)
            by_band = (wide.reshape(part.n, BANDS, ROWS) * _BAND).sum(axis=2)
            keys.append(mix(by_band + np.arange(1, BANDS + 1, dtype=np.uint64) * _SHORT).view(np.int64))
            place = (mix(wide * np.uint64(0x9E3779B97F4A7C15) + _FOLD) % np.uint64(SKETCH_BITS)).astype(np.int64)
            count = np.bincount((place + np.arange(part.n)[:, None] * SKETCH_BITS).ravel(), minlength=part.n * SKETCH_BITS)
            sketches.append(np.packbits((count & 1).astype(np.uint8).reshape(part.n, SKETCH_BITS), axis=1))
        bands, odd = np.concatenate(keys), np.concatenate(sketches)
        return {
            "doc_id": batch.column(0), "t1": batch.column(1), "t2": batch.column(2), "n_shingles": sizes, "d1": d1, "d2": d2,
            "bands": lists(bands.ravel(), np.full(len(bands), BANDS), pa.int64()), "sketch": [x.tobytes() for x in odd],
        }

    return map_arrow(with_text_hash(docs), sign, "doc_id long, t1 long, t2 long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary")


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity that two odd sketches' XOR tells, for rows of bytes."""
    odd = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return 1 + SKETCH_BITS / (4 * ROWS * BANDS) * np.log(np.maximum(1 - 2 * odd / SKETCH_BITS, 1e-9))


def sketch_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)


def close_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose sketches don't tell them apart."""
    of = lambda n: sketches.select(F.col("id").alias(n), F.col("sketch").alias(f"sketch_{n}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")

    def keep(batch: pa.RecordBatch) -> dict:
        near = estimates(sketch_rows(batch.column(2)), sketch_rows(batch.column(3))) >= SKETCH_LEAST
        return {k: batch.column(i).filter(pa.array(near)) for i, k in enumerate("ab")}

    return map_arrow(both.select("a", "b", "sketch_a", "sketch_b"), keep, "a long, b long")


def by_task(rows: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``fn`` over the table of each key, many small keys to a task: one sort, and runs read from batches."""
    spread = rows.repartition(*keys).sortWithinPartitions(*keys)
    target = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(target)
        held: dict[str, list] = {f.name: [] for f in to}
        for table in Grouped(batches, keys):
            if table.num_rows > 1 and (out := fn(table)):
                for k, v in out.items():
                    held[k].extend(v)
            if len(held[to.names[0]]) > 10_000:
                yield pa.RecordBatch.from_arrays([as_arrow(held[f.name], f.type) for f in to], schema=to)
                held = {f.name: [] for f in to}
        if held[to.names[0]]:
            yield pa.RecordBatch.from_arrays([as_arrow(held[f.name], f.type) for f in to], schema=to)
        trim()

    return small_batches(spread).mapInArrow(run, schema)


def candidate_links(table: pa.Table) -> dict | None:
    """Of one bucket's rows (id, root, sketch): pairs, of different roots, that the sketches hold to be
    close; no more of them than connect what all such pairs connect."""
    root, ids = table["root"].to_numpy(), table["id"].to_numpy()
    if (root == root[0]).all():
        return None
    bits = sketch_rows(table["sketch"])
    number = {int(r): i for i, r in enumerate(dict.fromkeys(root.tolist()))}
    label = np.array([number[int(r)] for r in root])
    forest, out = Forest(len(number)), {"a": [], "b": []}
    for i in range(len(ids) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if len(rest):
            for j in rest[estimates(bits[i], bits[rest]) >= SKETCH_LEAST].tolist():
                if forest.join(int(label[i]), int(label[j])):
                    out["a"].append(int(ids[i]))
                    out["b"].append(int(ids[j]))
    return out


def exact_links(table: pa.Table) -> dict | None:
    """Of rows (id, root, hashes): pairs, of different roots, whose sets are confirmed similar; no
    more of them than connect what all such pairs connect.

    Sizes of intersections come from one product of the sets' incidence matrix, some elements at a time.
    """
    root, ids = table["root"].to_numpy(), table["id"].to_numpy()
    if (root == root[0]).all():
        return None
    column = table["hashes"].combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    n = len(ids)
    order = np.argsort(values, kind="stable")
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)[order]
    values = values[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    element = np.cumsum(new, dtype=np.int32) - 1
    shared = np.bincount(element)[element] > 1
    row, element = row[shared], element[shared]
    element = np.cumsum(np.diff(element, prepend=element[:1]) != 0, dtype=np.int32)
    common = np.zeros((n, n), np.float32)
    for lo in range(0, int(element[-1]) + 1 if len(element) else 0, 4096):
        part = slice(*np.searchsorted(element, [lo, lo + 4096]))
        inside = np.zeros((n, 4096), np.float32)
        inside[row[part], element[part] - lo] = 1
        common += inside @ inside.T
    near = np.triu(100 * common.astype(np.int64) >= PERCENT * (sizes[:, None] + sizes[None, :] - common.astype(np.int64)), 1)
    number = {int(r): i for i, r in enumerate(dict.fromkeys(root.tolist()))}
    forest, out = Forest(len(number)), {"a": [], "b": []}
    label = [number[int(r)] for r in root]
    for i, j in zip(*np.nonzero(near)):
        if forest.join(label[i], label[j]):
            out["a"].append(int(ids[i]))
            out["b"].append(int(ids[j]))
    trim()
    return out


def rooted(ids: DataFrame, roots: DataFrame) -> DataFrame:
    """``ids`` with a root for each id: itself where the components have none."""
    r = roots.select(F.col("id").alias("r_id"), F.col("root").alias("r_root"))
    return ids.join(r, ids["id"] == r["r_id"], "left").withColumn("root", F.coalesce("r_root", "id")).drop("r_id", "r_root")


class Filter:
    """A Bloom filter of one function over the n numbers in a column of ``keys``: a bit for each of sixteen times as
    many places, of ``most`` (32 MB) at most, as one broadcast row. Where it is too full it lets more pass, never less."""

    def __init__(self, keys: DataFrame, column: str, n: int, most: int = 1 << 28):
        self.bits = 1 << min(most.bit_length() - 1, max(16, (16 * n).bit_length()))
        self.name = "bits_" + uuid.uuid4().hex
        place = F.pmod(F.col(column), F.lit(self.bits))
        bit = F.expr("shiftleft(1L, cast(bit as int))")
        got = keys.select(F.shiftright(place, 6).alias("word"), (place % 64).alias("bit")).groupBy("word").agg(F.bit_or(bit).alias("v")).toPandas()
        words = np.zeros(self.bits // 64, np.int64)
        words[got["word"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64)
        row = pa.table({self.name: pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))})
        self.row = F.broadcast(keys.sparkSession.createDataFrame(row))

    def met(self, df: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
        """The rows of ``df`` whose number may be among the keys, or ("left_anti") those whose number can't be."""
        word = f"get(`{self.name}`, cast(shiftright(pmod(`{column}`, {self.bits}L), 6) as int))"
        return df.join(self.row, F.expr(f"(shiftrightunsigned({word}, cast(pmod(`{column}`, 64L) as int)) & 1L) = 1L"), how)


def set_hashes(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, t1, t2, hashes): the distinct shingles of each of these texts."""

    def sets(batch: pa.RecordBatch):
        for part in chunks(batch.column(3), lower=True):
            hashes, bounds = shingles(part)
            own = [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(part.n)]
            sizes = np.array([len(x) for x in own])
            rows = {n: batch.column(i).slice(part.first, part.n) for i, n in enumerate(("doc_id", "t1", "t2"))}
            yield rows | {"hashes": lists(np.concatenate(own).view(np.int64), sizes, pa.int64())}

    return map_arrow(docs.select("doc_id", "t1", "t2", "text"), sets, "doc_id long, t1 long, t2 long, hashes array<long>")


def outside_against_all(rows: DataFrame, group: str) -> DataFrame:
    """Rows (group, id, root, load) dealt to tasks (group, i, j): whatever lies outside a group's largest part meets
    all of the group, two blocks a task. ``load`` is a row's share of a block. What a large part has in common is
    known and isn't compared again, so the work is that of the rest times the group."""
    sizes = rows.groupBy(group, "root").agg(F.sum("load").alias("c"), F.count(F.lit(1)).alias("k")).groupBy(F.col(group).alias("m_group"))
    main = sizes.agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("n"), F.max("c").alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    at = rows.join(main, F.col(group) == F.col("m_group"))
    left, right = F.greatest(F.ceil(F.col("n") - F.col("most")), F.lit(1)).cast("int"), F.greatest(F.ceil("n"), F.lit(1)).cast("int")
    own = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    as_left = at.where("root <> main").select(group, "id", "root", own("l", left).alias("i"), F.explode(F.sequence(F.lit(0), right - 1)).alias("j"))
    as_right = at.select(group, "id", "root", F.explode(F.sequence(F.lit(0), left - 1)).alias("i"), own("r", right).alias("j"))
    return as_left.union(as_right).distinct()


def similar_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows of ``docs``; the classes of rows with equal sets, which have any; and (id, root) of the classes
    that links connect with others.

    1. Rows with equal sets are one class; only classes go on.
    2. MinHash bands give buckets. Each class is held against its buckets' least class by odd sketches; then
       buckets that still have several groups compare across groups, large ones what lies outside their largest. This
       connects every pair that shares a bucket and that sketches can't tell apart into candidate groups.
    3. Candidate groups are confirmed on whole sets: blocks of a group at a time with a few common members,
       and then, of groups with several blocks, whatever those blocks left apart against all the rest.

    Every pair that shares a band is so decided exactly, or is known to be connected already.
    """
    signed, seen = materialize(signatures(docs), F.count(F.lit(1)).alias("rows"))
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "t1", "t2")
    classes = signed.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes, n = materialize(classes.withColumn("id", F.monotonically_increasing_id()), F.count(F.lit(1)).alias("classes"))
    sketches = classes.select("id", "sketch")

    banded = classes.select("id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = join_by_count(banded, buckets, ["key"], "n", BANDS * n["classes"], "inner")
    members, widest = materialize(members.select("key", "id", "hub", "n"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    stars = members.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    close = materialize(close_pairs(stars, sketches))
    # Known to be connected: a class, its least close hub, and that one's.
    up = close.groupBy("a").agg(F.min("b").alias("m"))
    above = up.select(F.col("a").alias("u_a"), F.col("m").alias("u_m"))
    groups = up.join(above, F.col("m") == F.col("u_a"), "left").select(F.col("a").alias("id"), F.coalesce("u_m", "m").alias("root"))

    apart = rooted(members.select("key", "id", "n"), groups)
    open_ = apart.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("key").alias("o_key"))
    apart = apart.join(open_, apart["key"] == open_["o_key"], "left_semi").withColumn("load", F.lit(1.0 / SKETCHES))
    few = apart.where(F.col("n") <= SKETCHES).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", "root")
    if widest["n"] > SKETCHES:
        many = outside_against_all(apart.where(F.col("n") > SKETCHES).select("key", "id", "root", "load"), "key")
        few = few.union(many.select("key", "i", "j", "id", "root"))
    more = by_task(few.join(sketches, "id"), ["key", "i", "j"], candidate_links, "a long, b long")
    groups = components(close.union(more))

    load = F.greatest(F.lit(1.0 / BLOCK), F.col("n_shingles") / float(ELEMENTS)).alias("load")
    placed = groups.withColumnRenamed("root", "group").join(classes.select("id", "first", load), "id")
    total = placed.groupBy(F.col("group").alias("g")).agg(F.sum("load").alias("blocks"), F.count(F.lit(1)).alias("n"))
    sized, most = materialize(placed.join(total, F.col("group") == F.col("g")).drop("g"), F.coalesce(F.max("blocks"), F.lit(0.0)).alias("blocks"), F.count(F.lit(1)).alias("n"))
    dropped(members, close)
    # Only texts of candidates become sets, before anything is shuffled; which rows they are is then joined exactly.
    wanted = sized.select("id", "group", "blocks", F.col("first.doc_id").alias("w_id"), F.col("first.t1").alias("t1"), F.col("first.t2").alias("t2"))
    made = set_hashes(Filter(wanted, "t1", most["n"]).met(with_text_hash(docs), "t1")).groupBy("t1", "t2", "doc_id").agg(F.first("hashes").alias("hashes"))
    sets = materialize(made.join(wanted, (made["t1"] == wanted["t1"]) & (made["t2"] == wanted["t2"]) & made["doc_id"].eqNullSafe(wanted["w_id"])).select("id", "group", "blocks", "hashes"))
    blocks = F.greatest(F.ceil("blocks"), F.lit(1)).cast("int")
    # Members of a large group that every block sees: those with the least hashes, about a thirtieth of a block.
    often = F.pmod(F.xxhash64("id", F.lit("often")), F.greatest(F.floor(30 * F.col("blocks")), F.lit(1))) == 0
    own = F.pmod(F.xxhash64("id", F.lit("block")), blocks).cast("int")
    dealt = sets.withColumn("i", F.explode(F.when((blocks > 1) & often, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own)))).withColumn("root", F.col("id"))
    links = materialize(by_task(dealt.select("group", "i", "id", "root", "hashes"), ["group", "i"], exact_links, "a long, b long"))
    final = components(links)
    if most["blocks"] > 1:  # groups of several blocks: what those blocks left apart
        large = rooted(sized.where(F.col("blocks") > 1), final).select("group", "id", "root", "load")
        tasks = outside_against_all(large, "group").join(sets.select("id", "hashes"), "id")
        late = by_task(tasks.select("group", "i", "j", "id", "root", "hashes"), ["group", "i", "j"], exact_links, "a long, b long")
        final = components(links.union(late))
    dropped(sized, sets, links)
    signed.rows_written = seen["rows"]
    return signed, classes, final


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept): the groups of documents that links connect, a link being
    100 * intersection >= 75 * union of two documents' sets of shingles.

    Null and empty texts have no shingles and link with nothing. Rows with a null id are documents like others; a
    component's id is its least id that isn't null, and a row of its own group alone has its own id. Rows that share
    an id each have their own text's component. A tie of similarities doesn't matter, as every link counts. Other
    columns are ignored; an empty table gives no row.
    """
    signed, classes, final = similar_classes(docs)
    grouped = rooted(classes.select("id", "d1", "d2", "n_shingles", "rows", F.col("first.doc_id").alias("least")), final)
    name = grouped.groupBy(F.col("root").alias("n_root")).agg(F.min("least").alias("component_id"))
    named = grouped.join(name, F.col("root") == F.col("n_root")).select("d1", "d2", "n_shingles", "rows", "component_id")
    out = join_by_count(signed.select("doc_id", "n_shingles", "d1", "d2"), named, ["d1", "d2", "n_shingles"], "rows", signed.rows_written)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicate rows of ``docs``, with all its columns: the one of the least id, null
    ids last; of repeated rows, which have the same id and text, one. Rows without shingles all stay."""
    signed, classes, final = similar_classes(docs)
    row = ["doc_id", "t1", "t2"]
    grouped = rooted(classes.select("id", "d1", "d2", "n_shingles", "rows", "first"), final)
    name = grouped.groupBy(F.col("root").alias("n_root")).agg(F.min("first").alias("kept"), F.sum("rows").alias("members")).where("members > 1")
    named = grouped.join(name, F.col("root") == F.col("n_root")).select("d1", "d2", "n_shingles", "rows", "kept")
    of = join_by_count(signed.select(*row, "d1", "d2", "n_shingles"), named, ["d1", "d2", "n_shingles"], "rows", signed.rows_written).where("kept is not null")
    first = F.struct(F.col("doc_id").isNull().alias("null"), *row) == F.col("kept")
    mark = {n: n + "_" + uuid.uuid4().hex for n in row}
    met = of.groupBy(*[F.col(n).alias("of_" + mark[n]) for n in row]).agg(F.max(F.coalesce(first, F.lit(False))).alias("stays"), F.count(F.lit(1)).alias("rows")).where("not stays or rows > 1")
    met, seen = materialize(met, F.count(F.when(F.col("stays"), 1)).alias("repeated"), F.count(F.lit(1)).alias("n"))
    marked = docs.withColumns({mark["doc_id"]: F.col("doc_id"), mark["t1"]: F.xxhash64("text"), mark["t2"]: F.xxhash64(F.lit(9), F.col("text"))})
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col("of_" + n)) for n in mark.values()])
    few = Filter(met, "of_" + mark["t1"], seen["n"])  # other rows stay where they are; only these are joined exactly
    out = few.met(marked, mark["t1"], "left_anti").unionByName(few.met(marked, mark["t1"]).join(met, same, "left_anti")).drop(*mark.values())
    if seen["repeated"]:  # of repeated rows that stay, one
        out = out.unionByName(few.met(marked, mark["t1"]).join(met.where("stays"), same, "left_semi").dropDuplicates([*mark.values()]).drop(*mark.values()))
    return out
