"""Shared pieces of the training-data operators: scratch tables, size-checked
joins, connected components and vectorised word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a narrow id column (16 bytes or less a row) that a join may broadcast.
BROADCAST_ROWS = 1_000_000
#: Texts that go to a Python worker at once.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset, a session on one machine (local master) uses a
    temporary folder; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_STEADY = {"Project", "Filter", "Relation", "LocalRelation", "LogicalRDD", "SubqueryAlias", "Union", "OneRowRelation", "Range"}


def settled(docs: DataFrame) -> DataFrame:
    """docs, if its rows come in the same order and partitions on every read; else docs written once.

    Row numbers are monotonically_increasing_id of the input, which several
    scans must agree on. Plans of scans, projections and filters do, as long
    as files are split alike: so the least number of splits, which follows the
    number of live executors by default, is fixed here for the session, as is
    the size of the batches that go to Python.
    """
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default: whole texts want smaller batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism)))
    plan = docs._jdf.queryExecution().optimizedPlan()
    names = {m[1] for m in (re.match(r"^[\s:+|-]*(\w+)", line) for line in plan.toString().splitlines()) if m}
    return docs if names <= _STEADY and plan.deterministic() else written(docs, "input")


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores put before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs (settled) whose numbers are not in the written table rows (row); all columns stay as they are."""
    number = fresh(docs, "_row")
    gone = rows.select(F.col("row").alias(number))
    return filtered_by(docs.withColumn(number, F.monotonically_increasing_id()), gone, number, "left_anti").drop(number)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arbora/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it when no result that reads them is still needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/arbora/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fits_broadcast(ids: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ids (already written, narrow rows) has at most `most` rows."""
    return ids.count() <= most


def filtered_by(df: DataFrame, ids: DataFrame, on, how: str) -> DataFrame:
    """Semi or anti join of df with the written table ids: broadcast below a checked size, else a shuffle join."""
    return df.join(F.broadcast(ids) if fits_broadcast(ids) else ids, on, how)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of a written edge table (a long, b long): (node, comp), comp the least node.

    Min-label propagation with pointer jumping; the labels are written after
    each round, and the rounds end when no label changes. Hot nodes are
    reduced by map-side partial minima; the edges of a star's centre meet its
    label in a plain join, which adaptive execution splits where it is skewed.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        new = written(lower.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("root", "comp")).alias("comp")), "labels")
        changed = new.filter("was <> comp").limit(1).count()
        labels = new.select("node", "comp")
        if not changed:
            return labels


# --- vectorised hashing of words -------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier and of its inverse, modulo 2**64."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 21)
        p = np.full(size, _P)
        q = np.full(size, _P_INV)
        p[0] = q[0] = 1
        _tables[:] = [np.cumprod(p), np.cumprod(q)]
    return _tables[0][:n], _tables[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(separators: str) -> np.ndarray:
    """A byte table that lower-cases A-Z and turns each separator into a space."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    for x in separators.encode("latin-1"):
        out[x] = 32
    return out


SPACES = lowered("\t\n\x0b\x0c\r ")

#: Bytes of text that are hashed at once.
SLICE = 1 << 21


def slices(texts: pa.Array, most: int = SLICE):
    """(first row, bytes, offsets) over the texts of an Arrow batch, about `most` bytes at a time; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


#: Random words of each byte at the first places of a word.
_PLACES = 64
_BYTES = mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a slice, and each text's range in them (len(offsets) bounds).

    A word's hash sums a random word for each pair of byte and place, so that
    no structure of words makes them collide more often than chance.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    d = lut[data]
    inside = d != 32
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    bounds = offsets[:-1][offsets[:-1] < len(data)]
    starts[bounds] = inside[bounds]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    ends[lasts] = inside[lasts]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    place = np.arange(len(d), dtype=np.int32)
    place -= np.maximum.accumulate(np.where(starts, place, np.int32(0)))  # of each byte in its word
    far = np.flatnonzero(inside & (place >= _PLACES))
    value = np.where(inside, _BYTES.take((np.minimum(place, _PLACES - 1) << 8) | d), np.uint64(0))
    if len(far):
        value[far] = mix((place[far].astype(np.uint64) * np.uint64(256) + d[far] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    np.cumsum(value, out=value)
    before = np.where(s > 0, value[s - 1], np.uint64(0))
    hashes = mix(value[e - 1] - before + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(s, offsets).astype(np.int64)


_STEP = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; fewer words than width make one, none make none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(n, width)
    h = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        h = (h ^ words[i : n - k + 1 + i]) * _STEP[i]
        h ^= h >> np.uint64(29)
    h = np.sort(mix(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]
