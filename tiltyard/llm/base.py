"""What the operators of this subpackage share: tables in the shared folder, text chunks, components."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the warehouse's where the session names none: both are shared by
    all executors. No folder of one machine is ever used."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tiltyard"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, *metrics: Column) -> DataFrame | tuple[DataFrame, dict]:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and a lost
    executor costs nothing that was written. With ``metrics`` (aggregates, aliased) also their values,
    computed while writing. The table goes when ``dropped`` or ``clear_written`` says so, or with the session."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tiltyard/{uuid.uuid4().hex}"
    seen = Observation() if metrics else None
    (df.observe(seen, *metrics) if seen else df).write.parquet(path)
    at, files = _path(spark, path)
    files.deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    _written.add(path)
    back.written_to = path
    return (back, seen.get) if seen else back


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` gave and that no plan reads any more."""
    for table in tables:
        if table.written_to in _written:
            _written.remove(table.written_to)
            at, files = _path(table.sparkSession, table.written_to)
            files.delete(at, True)


def clear_written(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` wrote; frames that read them are dead afterwards."""
    while _written:
        at, files = _path(spark, _written.pop())
        files.delete(at, True)


_libc = ctypes.CDLL(None)


def trim() -> None:
    """Give what the last batch needed back to the system: a Python worker outlives its tasks, and would keep it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def join_by_count(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, how: str = "left", most: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key and says in ``count`` how many of ``rows``
    (``total`` in all) have that key; rows without one get nulls, or go if ``how`` is "inner".

    Keys with over a ``most``-th of all rows, of which there can't be more than ``most``, are broadcast, so that
    their rows aren't shuffled; the others are joined on their keys, of which none is large then.
    """
    least = max(most, -(-total // most))
    hot, cold = F.broadcast(table.where(F.col(count) > least)), table.where(F.col(count) <= least)
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(cold, keys, how))


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, each found by its exact name; further columns and their names don't matter."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every vertex to the least one that these edges connect it with."""
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    low = np.arange(len(names))
    while len(a):
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        while (new != new[new]).any():
            new = new[new]
        apart = new[a] != new[b]
        a, b, low = a[apart], b[apart], new
    moved = np.flatnonzero(low != np.arange(len(names)))
    return names[moved], names[low[moved]]


EDGES = 1 << 19  # so many edges are contracted at once


def _contracted(edges: DataFrame, final: bool) -> DataFrame:
    """Edges (u, v) as stars, some of a partition's at a time; ``own`` tells whether u came as an edge's greater
    end. With ``final`` edges lie sorted by u, and all of one vertex are taken together."""

    def run(batches):
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            u, v = np.concatenate([u, batch.column(0).to_numpy()]), np.concatenate([v, batch.column(1).to_numpy()])
            while len(u) > EDGES and (cut := int(np.searchsorted(u, u[EDGES])) if final else EDGES):
                yield _stars(u[:cut], v[:cut], final)
                u, v = u[cut:], v[cut:]
        if len(u):
            yield _stars(u, v, final)
        trim()

    return edges.select("u", "v").mapInArrow(run, "u long, v long, own boolean")


def _stars(u: np.ndarray, v: np.ndarray, final: bool) -> pa.RecordBatch:
    a, b = local_stars(u, v)
    own = np.isin(a, u) if final else np.ones(len(a), bool)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(own)], ["u", "v", "own"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (id, root), root the smallest id reachable.

    Edges are contracted to stars within partitions, so that a vertex is then the greater end of no more edges
    than there were contractions. A round deals edges by their greater end, contracts them again, and replaces an
    edge's lesser end by that one's own root, with a join. A vertex with any number of links so is nowhere one
    task's list. It ends when each vertex has one edge, to a vertex that has none.
    Rounds are written to the shared folder, each in place of the one before. Vertices without edges have no row.
    """
    rest, old = _contracted(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False), None
    while True:
        stars = _contracted(rest.repartition("u").sortWithinPartitions("u"), True)
        stars, seen = materialize(stars, F.count(F.when(~F.col("own"), 1)).alias("foreign"))
        up = stars.select(F.col("u").alias("p_u"), F.col("v").alias("p_v"))
        jumped = stars.join(up, stars["v"] == up["p_u"], "left").select("u", F.coalesce("p_v", "v").alias("v"), F.col("p_v").isNotNull().alias("moved"))
        rest, then = materialize(jumped, F.count(F.when(F.col("moved"), 1)).alias("moved"))
        dropped(stars, *([] if old is None else [old]))
        old = rest
        if not seen["foreign"] and not then["moved"]:
            break
    return rest.select(F.col("u").alias("id"), F.col("v").alias("root")).union(rest.select("v", "v").distinct())


# Text in Arrow batches -------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def numbered(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit odd numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([seed], np.uint64))) | np.uint64(1)


_WEIGHTS = numbered(4096, 1)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span ``data[start:end]``: multilinear over positions, then mixed."""
    global _WEIGHTS
    size = end - start
    if not len(size):
        return np.zeros(0, np.uint64)
    if size.max() > len(_WEIGHTS):
        _WEIGHTS = numbered(int(size.max()) * 2, 1)
    before = np.cumsum(size) - size
    pos = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(before, size)
    terms = (data[pos + np.repeat(start, size)].astype(np.uint64) + np.uint64(1)) * _WEIGHTS[pos]
    total = np.zeros(len(size), np.uint64)
    some = size > 0
    if some.any():
        total[some] = np.add.reduceat(terms, before[some])
    return mix(total + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Chunk:
    """Some whole texts, side by side in one byte array, and their words ``[^\\x20\\x09-\\x0D]+``."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.first, self.offsets, self.n = first, offsets, len(offsets) - 1
        self.data = _LOWER[data] if lower else data
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # a word ends where its text does
        self.inside = word[1:-1]
        self.start = np.flatnonzero(word[1:] & (~word[:-1] | edge)).astype(np.int64)
        self.end = np.flatnonzero(word[:-1] & (~word[1:] | edge)).astype(np.int64)
        self.bounds = np.searchsorted(self.start, offsets)  # the words of text i: bounds[i]:bounds[i + 1]
        self.n_words = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(self.n), self.n_words)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask marks."""
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return np.diff(total[self.offsets])

    def windows(self, size: int) -> np.ndarray:
        """The first words of all windows of ``size`` words within one text."""
        at = np.arange(max(0, len(self.start) - size + 1))
        return at[self.doc[at] == self.doc[at + size - 1]] if len(at) else at


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each text's offsets; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, lower: bool = False, limit: int = 1 << 19) -> Iterator[Chunk]:
    """Whole texts, about ``limit`` bytes at a time (one text, if it is longer), so that the arrays made
    from them stay small whatever a batch holds."""
    data, off = text_bytes(column)
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield Chunk(lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower)
        lo = hi


#: Arrow batches between the JVM and Python, whose copies live in both: at most so many bytes in our sessions.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session's Arrow batches made no larger than BATCH_BYTES, whatever rows hold: the setting is read
    when a plan runs, so it is the session's from here on."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", df.sparkSession.conf.get(name).lower()).groups()
    if int(size) << {"k": 10, "m": 20, "g": 30}.get(unit[:1], 0) > BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow over whole batches; ``fn`` takes a batch and returns its columns, named, or gives them part by
    part as a generator."""
    target = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(target)
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                for part in [out] if isinstance(out, dict) else out:
                    yield pa.RecordBatch.from_arrays([as_arrow(part[f.name], f.type) for f in to], schema=to)
                out = part = None
                trim()

    return small_batches(df).mapInArrow(run, schema)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values.cast(kind)
    return pa.array(values, kind)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of flat values and the lists' sizes."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


class Grouped:
    """Runs of equal keys in batches sorted by them, across batch borders: yields one table a key."""

    def __init__(self, batches: Iterable[pa.RecordBatch], keys: list[str]):
        self.batches, self.keys = batches, keys

    def __iter__(self) -> Iterator[pa.Table]:
        held: list[pa.Table] = []
        for batch in self.batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            change = np.zeros(batch.num_rows, bool)
            for k in self.keys:
                v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
                change[1:] |= v[1:] != v[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                part = table.slice(lo, hi - lo)
                if lo == 0 and held and all(held[-1][k][-1] != part[k][0] for k in self.keys[:1]):
                    yield pa.concat_tables(held)
                    held = []
                elif lo == 0 and held and any(held[-1][k][-1] != part[k][0] for k in self.keys):
                    yield pa.concat_tables(held)
                    held = []
                elif lo and held:
                    yield pa.concat_tables(held)
                    held = []
                held.append(part)
        if held:
            yield pa.concat_tables(held)


class Forest:
    """Union by smallest root over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
