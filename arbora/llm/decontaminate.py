"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are the test windows: ten consecutive words of a benchmark item,
or the whole of a shorter one. For the patterns of one length a block shift
table (blocks of two words) says how far the search may jump: a block that
ends no pattern and occurs in none lets it skip almost a whole window. Where
the shift is zero, a bucket of the block lists the patterns that end with it,
and a direct comparison confirms each. Every word under a confirmed window is
marked, so windows may overlap.

The documents are only mapped over; nothing of them is shuffled. The test
windows are broadcast in blocks of at most BLOCK_WINDOWS, one pass over the
documents for each block; with one block (the usual case) there is no shuffle
at all, and with more only the hits are merged by row.

Defined cases: null texts and texts without words have no words and no hits;
items without words are no patterns; a null item id counts as the empty one;
equal windows of several items count for
each of them; repeated documents are judged row by row; an empty benchmark
leaves every document clean; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import table

WINDOW = 10
#: Windows that are broadcast at once: about 100 bytes each, so at most some 20 MB.
BLOCK_WINDOWS = 200_000

#: Lower-cases A-Z; every other ASCII byte but a-z and 0-9 becomes a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    if not text:
        return []
    return (text.encode("utf-8") if isinstance(text, str) else text).translate(_WORDS).split()


def windows_of(text: str | None, width: int = WINDOW) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    if not words:
        return set()
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


class WuManber:
    """Shift and bucket tables for word patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.patterns = patterns
        self.m = len(next(iter(patterns)))
        self.block = min(2, self.m)
        self.jump = self.m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for p in patterns:
            for end in range(self.block, self.m + 1):
                key = p[end - 2 : end] if self.block == 2 else p[end - 1]
                self.shift[key] = min(self.shift.get(key, self.jump), self.m - end)
            self.bucket.setdefault(p[-2:] if self.block == 2 else p[-1], {}).setdefault(p[0], []).append(p)

    def find(self, words: list[bytes]):
        """(start, pattern) of every occurrence."""
        m, jump, shift, two = self.m, self.jump, self.shift.get, self.block == 2
        i, n = m - 1, len(words)
        while i < n:
            key = (words[i - 1], words[i]) if two else words[i]
            step = shift(key, jump)
            if step:
                i += step
                continue
            start = i - m + 1
            found = self.bucket[key].get(words[start])
            if found:
                here = tuple(words[start : i + 1])
                for p in found:
                    if p == here:
                        yield start, p
            i += 1


def matchers(items: list[tuple[str, list[tuple[bytes, ...]]]]) -> list[WuManber]:
    """A searcher for each pattern length of (item, windows) pairs."""
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, windows in items:
        for w in windows:
            by_length.setdefault(len(w), {}).setdefault(w, []).append(item)
    return [WuManber(p) for p in by_length.values()]


def search(words: list[bytes], searchers: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans of hit words, and the items whose windows occur."""
    spans, items = [], set()
    for s in searchers:
        for start, p in s.find(words):
            spans.append((start, start + s.m))
            items.update(s.patterns[p])
    return merged(spans), items


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HITS = "row long, id long, n_words long, starts array<long>, ends array<long>, items array<string>"


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int, most: int):
    """Item windows from the benchmark in blocks of at most about `most` windows; the driver holds one block."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    for row in rows.toLocalIterator():
        windows = list(windows_of(row.text, width))
        for i in range(0, len(windows), most):
            part = windows[i : i + most]
            if block and size + len(part) > most:
                yield block
                block, size = [], 0
            block.append((row.item if row.item is not None else "", part))
            size += len(part)
    yield block


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per row of docs: row, id, n_words, merged hit spans (starts, ends) and the items that occur."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = []
    for block in _blocks(benchmark, item_col, "text", width, block_windows):
        sent = spark.sparkContext.broadcast(block)

        def scan(batches, sent=sent):
            searchers = matchers(sent.value)
            for batch in batches:
                n, starts, ends, items = [], [], [], []
                for text in batch.column(2).cast(pa.binary()):
                    text = text.as_py()
                    words = words_of(text)
                    spans, found = search(words, searchers)
                    n.append(len(words))
                    starts.append([a for a, _ in spans])
                    ends.append([b for _, b in spans])
                    items.append(sorted(found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                    names=["row", "id", "n_words", "starts", "ends", "items"],
                )

        parts.append(rows.mapInArrow(scan, _HITS))
    if len(parts) == 1:
        return parts[0]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p.filter(F.size("items") > 0))
    return total.groupBy("row", "id").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items (sorted), contaminated."""
    found = hits(docs, benchmark, **options)
    # spans may overlap only after blocks were merged: count the union in order of starts
    spans = F.array_sort(F.arrays_zip("starts", "ends"))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["ends"] - F.greatest(acc["to"], s["starts"]))).alias("n"), F.greatest(acc["to"], s["ends"]).alias("to")),
    )["n"]
    return found.select(F.col("id").alias(options.get("id_col", "doc_id")), "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_sort("items").alias("items"), (F.size("items") > 0).alias("contaminated"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document under benchmark windows."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def brute_force(docs: list[tuple[int, str | None]], benchmark: list[tuple[object, str | None]], width: int = WINDOW) -> list[tuple]:
    """The registered query's rows by comparing every window, for tests."""
    out = []
    for doc_id, text in docs:
        words, hit, items = words_of(text), set(), set()
        for item, t in benchmark:
            for w in windows_of(t, width):
                for i in range(len(words) - len(w) + 1):
                    if tuple(words[i : i + len(w)]) == w:
                        hit.update(range(i, i + len(w)))
                        items.add(str(item))
        out.append((doc_id, len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


SQL: dict[str, str] = {}
