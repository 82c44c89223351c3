"""Tables in the folder that driver and executors share, connected components, and comparison within buckets."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINKS = "a long, b long, key long"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir or setCheckpointDir() names.

    Where neither is set, a new one on a local master; on a cluster RuntimeError, as executors would not see it.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame, large: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and survives lost executors.

    Spark deletes a shuffle's files once the driver has collected the plan that made them; after large ones it is asked to.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if large:
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


def numbered(docs: DataFrame) -> DataFrame:
    """docs with the columns _file and _row (long), which tell its rows apart and are the same whenever they are read.

    They are a hash of the file's path and the row's place in the file where docs is a table of Parquet files as it was
    read; the rows of any other plan are numbered once, in a copy in the shared folder.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return docs.select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        except AnalysisException:  # files of another kind have no row_index
            pass
    return cut(docs.withColumn("_file", F.lit(0).cast("long")).withColumn("_row", F.monotonically_increasing_id()))


def drop(df: DataFrame) -> None:
    """Delete a table made by cut() that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_cut_path", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a long, b long) as (node, component); component is the least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until no edge changes. Every step is a grouped
    minimum, which combines before the shuffle, and an equi-join; nothing but a count and a checksum reaches the driver.
    An empty input gives an empty result; loops and repeated edges have no effect.
    """
    now = cut(edges.select("a", "b").where("a <> b").distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if not mark["n"] or (mark["n"], mark["s"]) == seen:
            break
        seen = (mark["n"], mark["s"])
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        after = cut(small.union(least.select("u", "m")).where("a <> b").distinct())
        drop(now)
        now = after
    child = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    return child.union(child.select(F.col("component").alias("node"), "component").distinct())


def spread(size: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of `size` items as (item, parent); near(i, rest) tells which of `rest` are linked to i.

    Each item is compared once with those not yet reached, so a tight group costs about its size, and at most
    size - 1 links come out.
    """
    rest, out = np.arange(size), []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            hit = near(i, rest)
            front += (got := rest[hit].tolist())
            out += [(j, i) for j in got]
            rest = rest[~hit]
    return out


def _few_links(fp: np.ndarray, bits: int, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs of fingerprints that differ in at most `bits` bits; None if there are over `most`."""
    a, b, count = [], [], 0
    for i in range(len(fp) - 1):
        j = np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= bits) + i + 1
        a.append(np.full(len(j), i))
        b.append(j)
        count += len(j)
        if count > most:
            return None
    return np.concatenate(a), np.concatenate(b)


def without_repeats(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, fp, id), sorted by key and id, without repeated (key, id)."""
    last = None
    for batch in rows:
        key, ident = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        if not len(key):
            continue
        new = np.append((key[0], ident[0]) != last, (key[1:] != key[:-1]) | (ident[1:] != ident[:-1]))
        last = (key[-1], ident[-1])
        yield batch.filter(pa.array(new))


def bucket_links(rows: Iterator[pa.RecordBatch], bits: int, small: int, large: int, defer_all: bool = False, sparse: int = 0) -> Iterator[pa.RecordBatch]:
    """Links between members of equal key whose fingerprints differ in at most `bits` bits.

    rows: batches (key, fp, id), sorted by key. Out: (a, b, null) links, and (id, fp, key) members of groups that are
    left for a second pass: those with over `large` members, and with defer_all all of over `small`. Groups of up to
    `small` members give all their links, as do those of up to `sparse` with at most four links a member; larger ones
    give a spanning forest.
    """
    held: list[np.ndarray] = []
    count, passing = 0, None

    def out(a: list, b: list, key: list | None) -> pa.RecordBatch:
        keys = pa.array(key, pa.int64()) if key is not None else pa.nulls(len(a), pa.int64())
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), keys], ["a", "b", "key"])

    def compare(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, fp, ident = x[0], x[1].view(np.uint64), x[2]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[begin, len(key)])
        of = np.repeat(sizes, sizes)
        a, b = [], []
        for s in range(1, small):
            i = np.flatnonzero((key[s:] == key[:-s]) & (of[s:] <= small))
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + s]) <= bits]
            a.append(np.minimum(ident[i], ident[i + s]))
            b.append(np.maximum(ident[i], ident[i + s]))
        later = []
        for at, n in zip(begin[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
            if small < n <= sparse and (got := _few_links(fp[at : at + n], bits, 4 * n)) is not None:
                who = ident[at : at + n]
                a.append(np.minimum(who[got[0]], who[got[1]]))
                b.append(np.maximum(who[got[0]], who[got[1]]))
                continue
            if defer_all or n > large:
                later.append(np.arange(at, at + n))
                continue
            f, who = fp[at : at + n], ident[at : at + n]
            pairs = spread(n, lambda i, rest, f=f: np.bitwise_count(f[rest] ^ f[i]) <= bits)
            if pairs:
                p = np.array(pairs)
                a.append(np.minimum(who[p[:, 0]], who[p[:, 1]]))
                b.append(np.maximum(who[p[:, 0]], who[p[:, 1]]))
        if a and sum(map(len, a)):
            links = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
            yield out(links[0], links[1], None)
        if later:
            i = np.concatenate(later)
            yield out(ident[i], x[1][i], key[i])

    for batch in rows:
        x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
        while x.shape[1]:
            if passing is not None:  # the rest of a group that was too large to hold
                n = int(np.searchsorted(x[0], passing, "right"))
                if n:
                    yield out(x[2, :n], x[1, :n], x[0, :n])
                x = x[:, n:]
                passing = passing if not x.shape[1] else None
                continue
            held.append(x)
            count += x.shape[1]
            x = x[:, :0]
            if count < 200_000:
                break
            whole = np.concatenate(held, axis=1)
            last = int(np.searchsorted(whole[0], whole[0, -1]))
            if whole.shape[1] - last > large:
                passing = whole[0, -1]
                yield out(whole[2, last:], whole[1, last:], whole[0, last:])
                held, count = [], 0
            else:
                held, count = [whole[:, last:]], whole.shape[1] - last
            if last:
                yield from compare(whole[:, :last])
    if count:
        yield from compare(np.concatenate(held, axis=1))


def in_tiles(members: DataFrame, large: int) -> DataFrame:
    """`members` (key, id, ...) with the groups of over `large` dealt in tiles of about half that, by a hash of the id.

    Each pair of tiles gets a key of its own, under which both are found, so that all pairs of a group still meet.
    """
    tiles = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(large / 2)).cast("int").alias("tiles"))
    dealt = members.join(tiles.where(F.col("tiles") > 2), "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    key = F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))
    return dealt.withColumn("key", key).drop("tile", "tiles", "other")


def linked_in_buckets(keyed: DataFrame, bits: int, small: int = 16, large: int = 20_000) -> DataFrame:
    """Links (a, b) that connect all pairs of `keyed` (key, fp, id) which share a key and differ in at most `bits` bits.

    Groups of over `large` members never meet in one task: they are dealt in tiles, and each pair of tiles is compared
    in a task of its own. The links hold every connection, not every pair.
    """

    def run(rows):
        return bucket_links(rows, bits, small, large)

    def run_tiles(rows):
        return bucket_links(rows, bits, small, 1 << 62)

    first = cut(keyed.select("key", "fp", "id").repartition("key").sortWithinPartitions("key").mapInArrow(run, LINKS))
    links = first.where("key is null").select("a", "b")
    left = first.where("key is not null").select("key", F.col("b").alias("fp"), F.col("a").alias("id"))
    if left.isEmpty():
        return links
    dealt = in_tiles(left, large)
    return links.union(dealt.select("key", "fp", "id").repartition("key").sortWithinPartitions("key").mapInArrow(run_tiles, LINKS).select("a", "b"))


def append(df: DataFrame, text_col: str, kernel: Callable, fields: str, keep: list[str] | None = None, max_bytes: int = 1 << 19) -> DataFrame:
    """df, or its columns `keep`, with the columns `fields` ("name type, ...") that kernel makes of the text column.

    kernel(bytes, row offsets) returns one Arrow or NumPy array for each field. A null text counts as empty. Raises
    ValueError if a new column would clash with a kept one.
    """
    from cellweave.llm.kernels import releasing, text_slices

    kept = df.columns if keep is None else keep
    made = df.sparkSession.createDataFrame([], fields).schema
    if clash := {c.lower() for c in kept} & {c.lower() for c in made.names}:
        raise ValueError(f"columns already there: {sorted(clash)}")
    rows = df.select(F.col(text_col).cast("string").alias("__text"), *[df[c] for c in kept])
    schema = df.select(*[df[c] for c in kept]).schema
    for field in made:
        schema.add(field)
    names = [f.name for f in schema]
    types = [pa.int64() if t == "bigint" else pa.int32() if t == "int" else pa.float64() if t == "double" else pa.bool_() if t == "boolean" else pa.string() if t == "string" else pa.list_(pa.int64()) if t == "array<bigint>" else pa.list_(pa.list_(pa.int64())) if t == "array<array<bigint>>" else pa.list_(pa.float64()) for t in (f.dataType.simpleString() for f in made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(0), max_bytes):
                own = [batch.column(k + 1).slice(lo, hi - lo) for k in range(len(kept))]
                new = [pa.array(x, t, from_pandas=False) if not isinstance(x, pa.Array) else x.cast(t) for x, t in zip(kernel(data, offsets), types, strict=True)]
                yield pa.record_batch(own + new, names)

    return rows.mapInArrow(releasing(run), schema)


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Consecutive groups of values as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))
