"""Suffix-array dedup: maximal repeats from the interval tree of a sparse, sharded suffix array.

Every string of `passage` bytes (three quarters of `length`) that occurs twice
holds, in both places, the same winnowing anchor: the least hash of its k-byte
strings (k = length / 4). Only suffixes that start at an anchor are indexed,
which keeps about one position in a hundred and loses no repeat:

1. Equal documents are found by their hash; of each set of copies one is
   searched, and the copies of a text of `length` bytes or more go whole.
2. Anchors (hash, row, position) are counted by hash; those that occur once
   end here.
3. Each other anchor gets its context: up to length - k bytes before it and as
   many after, named by a 128-bit hash. Two tables come of that: the
   occurrences (row, positions, context), which stay small, and the contexts
   themselves, of which each task sends equal ones once, with their count; so a
   large group of copies sends a row a task and not one a copy. Contexts are
   dealt by anchor hash: a shard holds all suffixes with the anchor's first k
   bytes. The contexts of a hot anchor go to two finer shards each: two
   occurrences that agree in passage - k bytes around the anchor agree in half
   of them on its right or on its left, so they meet in one of the shards, and
   a common passage of fewer bytes falls apart into small ones.
   (Texts meet their anchors, and later their runs, in sort-merge joins at
   every size.)
4. In a shard the suffixes are sorted and their common prefixes taken (the
   enhanced suffix array). A stack scan gives its common-prefix intervals. In
   an interval with n common bytes an occurrence is part of a repeat if
   another one extends as far to the left as to make up the wanted length;
   where the left extensions of an interval differ, the repeat is maximal.
   Every member of an interval is reported, not just neighbours in the array,
   with the extent of its repeats to the left and right.
5. The extents meet the occurrences by context, and those of a row are merged.
   The runs of strings of `length` bytes are cut out. The runs of strings of
   `passage` bytes with more than `words` words are reported as shared passages.

Defined cases: null counts as empty; texts shorter than `length` lose
nothing; matches never cross documents but may overlap within one; repeated
rows are copies of each other; a text is never cut to a prefix, and offsets
are those of its UTF-8 bytes, so what is kept may not be valid UTF-8; an empty
table gives an empty result; further columns are ignored. Anchors and contexts
are compared by 64-bit hash and by bytes respectively.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import _powers, fits_broadcast, mix, settled, slices, table, written

LENGTH = 400
#: Words that a shared passage has more than.
PASSAGE_WORDS = 50
#: Distinct contexts that a task gathers before it sends them.
GATHERED = 10_000
#: Occurrences from which an anchor's suffixes are dealt over finer shards.
HOT = 1000


def _sliding(x: np.ndarray, w: int, of: np.ufunc, pad: int) -> np.ndarray:
    """The least (np.minimum) or greatest (np.maximum) of each w neighbours, from running extremes of blocks of w."""
    n = len(x)
    grid = np.full(-(-n // w) * w, np.uint64(pad), np.uint64)
    grid[:n] = x
    grid = grid.reshape(-1, w)
    ahead = of.accumulate(grid, axis=1).ravel()
    behind = of.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(behind[: n - w + 1], ahead[w - 1 : n])


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Positions whose value is the least of some window of w values: the same ones in equal strings."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    least = _sliding(h, w, np.minimum, (1 << 64) - 1)
    none = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([none, least, none]), w, np.maximum, 0) == h)


def anchors(data: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the anchors of one text's bytes."""
    n = len(data) - k + 1
    if n < w:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p, q = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p, out=total[1:])
    h = mix((total[k:] - total[:-k]) * q[:n])
    at = _window_minima(h, w)
    return h[at], at


class _LeftOrder:
    """Common lengths of the (reversed) left contexts: their order, and range minima over its common prefixes."""

    def __init__(self, left: list[bytes]):
        n = len(left)
        order = sorted(range(n), key=left.__getitem__)
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        level = np.array([0] + [_common(left[order[i - 1]], left[order[i]]) for i in range(1, n)], np.int32)
        self.levels = [level]
        step = 1
        while 2 * step <= n:
            level = np.minimum(level[:-step], level[step:])
            self.levels.append(level)
            step *= 2

    def neighbours(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """members in the order of their left contexts, and for each the most bytes it shares with another one."""
        ranks = self.rank[members]
        order = np.argsort(ranks)
        ranks = ranks[order]
        lo, width = ranks[:-1] + 1, ranks[1:] - ranks[:-1]
        height = np.frexp(width)[1] - 1
        shared = np.empty(len(width), np.int32)
        for h in np.unique(height):
            at = height == h
            level = self.levels[h]
            shared[at] = np.minimum(level[lo[at]], level[lo[at] + width[at] - (1 << int(h))])
        best = np.zeros(len(members), np.int32)
        best[:-1] = shared
        best[1:] = np.maximum(best[1:], shared)
        return members[order], best


def _extents(left: list[bytes], right: list[bytes], k: int, lengths: tuple[int, ...], many: list[bool]) -> list[list[tuple[int, int] | None]]:
    """For each of lengths, and for each distinct context of one anchor, how far its repeats of that length reach, in bytes to the left and right of the anchor's start.

    left: bytes before the anchor, reversed; right: bytes after its k bytes;
    many: whether the context occurs more than once. The repeats of an
    occurrence all hold its anchor, so their union is one run.
    """
    n = len(right)
    if n == 2 and not any(many):
        a, b = _common(left[0], left[1]), k + _common(right[0], right[1])
        return [[(a, b) if a + b >= length else None] * 2 for length in lengths]
    before, after = np.zeros((len(lengths), n), np.int32), np.zeros((len(lengths), n), np.int32)
    for i in range(n):
        if many[i]:
            for j, length in enumerate(lengths):
                if len(left[i]) + k + len(right[i]) >= length:
                    before[j, i], after[j, i] = len(left[i]), k + len(right[i])
    if n > 1:
        order = sorted(range(n), key=right.__getitem__)  # the suffix array of the shard
        lcp = [0] + [_common(right[order[i - 1]], right[order[i]]) for i in range(1, n)] + [-1]
        suffixes, lefts = np.array(order), _LeftOrder(left)
        # stack scan of the common-prefix intervals: (common bytes, left bound)
        stack: list[tuple[int, int]] = []
        for i in range(1, n + 1):
            here, lo = lcp[i], i - 1
            while stack and stack[-1][0] > here:
                common, lo = stack.pop()
                # the interval lo .. i-1 shares k + common bytes; who shares the rest on the left with another member?
                members, best = lefts.neighbours(suffixes[lo:i])
                for j, length in enumerate(lengths):
                    repeat = best >= length - k - common
                    some, reach = members[repeat], best[repeat]
                    before[j, some] = np.maximum(before[j, some], reach)
                    after[j, some] = np.maximum(after[j, some], k + common)
            if here >= 0 and (not stack or stack[-1][0] < here):
                stack.append((here, lo))
    return [[(a, b) if b else None for a, b in zip(before[j].tolist(), after[j].tolist(), strict=True)] for j in range(len(lengths))]


def _shard(anchor: int, side: bytes, near: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(side + near, digest_size=8, key=anchor.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _context(anchor: int, left: bytes, right: bytes) -> bytes:
    """The 128-bit name of a context."""
    h = hashlib.blake2b(left, digest_size=16, key=anchor.to_bytes(8, "little", signed=True))
    h.update(len(left).to_bytes(4, "little"))
    h.update(right)
    return h.digest()


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Per row of docs with repeats: row, its runs of strings of `length` bytes and of three quarters of that (passages); both sorted, disjoint and not touching."""
    k = max(1, length // 4)
    passage = max(k, 3 * length // 4)
    w = passage - k + 1
    docs = settled(docs)
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digests = written(source.select("row", F.octet_length("text").alias("n"), F.unhex(F.md5("text")).alias("h")).filter(F.col("n") >= length), "doc-digests")
    groups = digests.groupBy("h").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies"))
    groups = written(groups, "doc-groups")

    def find(batches):
        for batch in batches:
            rows, hashes, positions = [], [], []
            ids = batch.column(0).to_numpy()
            for first, data, offsets in slices(batch.column(1)):
                for i in range(len(offsets) - 1):
                    h, at = anchors(data[offsets[i] : offsets[i + 1]], k, w)
                    rows.append(np.full(len(h), ids[first + i]))
                    hashes.append(h.view(np.int64))
                    positions.append(at)
            flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat(rows), pa.int64()), pa.array(flat(hashes), pa.int64()), pa.array(flat(positions), pa.int32())], names=["row", "anchor", "at"])

    # copies of a text are left out of the search before the scan if their ids fit a broadcast, else after it
    copies = written(digests.join(groups.filter("copies > 1"), "h").filter("row <> first").select("row"), "doc-copies")
    schema = "row long, anchor long, at int"
    if fits_broadcast(copies):
        found = source.join(F.broadcast(copies), "row", "left_anti").mapInArrow(find, schema)
    else:
        found = source.mapInArrow(find, schema).join(copies, "row", "left_anti")
    found = written(found, "anchors")
    # anchors that occur more than once: counted by partial sums, then joined as a table of its own so that hot ones can be split
    often = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("anchor").alias("often"), (F.col("n") > hot).alias("hot")), "often")
    live = found.join(often, F.col("anchor") == F.col("often"))
    places = live.groupBy("row").agg(F.collect_list(F.struct("at", "anchor", "hot")).alias("places"))  # a row's own anchors: bounded by its text

    side = length - k
    half = max(1, -(-(passage - k) // 2))

    def cut_out(batches):
        """Of each row: the row, and its contexts as (name, anchor, hot, left, right) with their positions."""
        for batch in batches:
            for row, text, spots in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                data = text.as_py()
                own: dict[tuple, list[int]] = {}
                for s in spots:
                    at, anchor = s["at"], s["anchor"]
                    left, right = data[max(0, at - side) : at][::-1], data[at + k : at + length]
                    own.setdefault((_context(anchor, left, right), anchor, s["hot"], left, right), []).append(at)
                yield row, own

    def occurrences(batches):
        out = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int32())))], names=["row", "context", "at"])
        for row, own in cut_out(batches):
            out.extend((row, key[0], at) for key, at in own.items())
            if len(out) >= 20_000:
                yield pack()
                out.clear()
        yield pack()

    def contexts(batches):
        held: dict[tuple, int] = {}

        def packed():
            rows = [(shard, anchor, name, n, left, right) for (name, anchor, is_hot, left, right), n in held.items() for shard in ((_shard(anchor, b"R", right[:half]), _shard(anchor, b"L", left[:half])) if is_hot else (anchor,))]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=["shard", "anchor", "context", "n", "left", "right"])

        for _, own in cut_out(batches):
            for key, at in own.items():
                held[key] = held.get(key, 0) + len(at)
            if len(held) >= GATHERED:
                yield packed()
        yield packed()

    texts = source.join(places.hint("merge"), "row").select("row", "text", "places")
    seen = texts.mapInArrow(contexts, "shard long, anchor long, context binary, n long, left binary, right binary")
    # a shard of an anchor's suffixes, equal contexts side by side
    shards = seen.repartition("shard").sortWithinPartitions("shard", "anchor", "right", "left")

    def tree(batches):
        key, held = None, []  # held: of each distinct context [left, right, name, occurrences]

        def done():
            many = [x[3] > 1 for x in held]
            if len(held) < 2 and not any(many):
                return
            long, short = _extents([x[0] for x in held], [x[1] for x in held], k, (length, passage), many)
            for (_, _, name, _), a, b in zip(held, long, short, strict=True):
                if b:
                    yield name, *(a or (None, None)), *b

        def packed(out):
            kinds = (pa.binary(), *[pa.int32()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["name", "before", "after", "p_before", "p_after"])

        for batch in batches:
            out = []
            for shard, anchor, name, n, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, anchor) != key:
                    out.extend(done())
                    key, held = (shard, anchor), []
                if held and held[-1][2] == name:
                    held[-1][3] += n
                else:
                    held.append([left, right, name, n])
            yield packed(out)
        yield packed(list(done()))

    extents = shards.mapInArrow(tree, "name binary, before int, after int, p_before int, p_after int")
    seen_at = texts.mapInArrow(occurrences, "row long, context binary, at array<int>")
    met = seen_at.join(extents, F.col("context") == F.col("name")).select("row", F.explode("at").alias("at"), "before", "after", "p_before", "p_after")
    span = lambda a, b: F.struct((F.col("at") - F.col(a)).alias("a"), (F.col("at") + F.col(b)).alias("b"))
    # a row's own spans: bounded by its text
    spans = met.groupBy("row").agg(F.collect_set(F.when(F.col("after").isNotNull(), span("before", "after"))).alias("runs"), F.collect_set(span("p_before", "p_after")).alias("passages"))
    one = spans.select("row", *[_merged(F.array_sort(c)).alias(c) for c in ("runs", "passages")])
    # a searched text with copies goes whole, and so do the copies
    all_of_it = F.array(F.struct(F.lit(0).alias("a"), F.col("n").cast("int").alias("b")))
    whole = digests.join(groups.filter("copies > 1").select(F.col("h").alias("of"), "copies"), F.col("h") == F.col("of")).select("row", all_of_it.alias("runs"), all_of_it.alias("passages"))
    return one.join(whole.select("row"), "row", "left_anti").unionByName(whole)


def _merged(spans):
    """Sorted spans as disjoint runs that do not touch."""
    kind = "array<struct<a:int,b:int>>"
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(
        spans,
        F.array().cast(kind),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= s["a"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(acc, F.lit(-1))["b"], s["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(s))).cast(kind),
    )


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, words: int = PASSAGE_WORDS) -> DataFrame:
    """Per row of docs: row, id, n_bytes, runs (removed), kept (binary), passages (shared, of more than `words` words)."""
    docs = settled(docs)
    runs = written(repeats(docs, id_col, text_col, length, hot), "runs")

    def run(batches):
        for batch in batches:
            n, kept, shared = [], [], []
            for text, spans, passages in zip(batch.column(2).cast(pa.binary()), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                data, at, parts = text.as_py(), 0, []
                for s in spans or []:
                    parts.append(data[at : s["a"]])
                    at = s["b"]
                parts.append(data[at:])
                n.append(len(data))
                kept.append(b"".join(parts))
                shared.append([s for s in passages or [] if len(data[s["a"] : s["b"]].split()) > words])
            spans_of = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), batch.column(3), pa.array(kept, pa.binary()), pa.array(shared, spans_of)], names=["row", "id", "n_bytes", "runs", "kept", "passages"])

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = "array<struct<a:int,b:int>>"
    return source.join(runs.hint("merge"), "row", "left").select("row", "id", "text", "runs", "passages").mapInArrow(run, f"row long, id long, n_bytes long, runs {kind}, kept binary, passages {kind}")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of LENGTH bytes and more that repeat anywhere in the documents, cut out; n_passages: shared passages of over 50 words, from 300 bytes on."""
    found = cut(table(spark, sf_dir, "documents"))
    removed = F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda acc, s: acc + (s["b"] - s["a"]).cast("long")), F.lit(0).cast("long"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.size("passages").cast("long").alias("n_passages"))


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH, words: int = PASSAGE_WORDS) -> list[tuple]:
    """The registered query's rows by looking at every string of `length` bytes, for tests."""
    from collections import Counter

    texts = [(i, (t or "").encode()) for i, t in docs]

    def covered(length):
        seen = Counter(d[p : p + length] for _, d in texts for p in range(len(d) - length + 1))
        for _, d in texts:
            hit = bytearray(len(d))
            for p in range(len(d) - length + 1):
                if seen[d[p : p + length]] > 1:
                    hit[p : p + length] = b"\x01" * length
            yield hit, [(m.start(), m.end()) for m in re.finditer(b"\x01+", hit)]

    out = []
    for (doc_id, d), (hit, spans), (_, passages) in zip(texts, covered(length), covered(3 * length // 4), strict=True):
        kept = bytes(b for b, x in zip(d, hit, strict=True) if not x)
        shared = sum(len(d[a:b].split()) > words for a, b in passages)
        out.append((doc_id, len(d), sum(hit), len(spans), hashlib.sha256(kept).hexdigest(), shared))
    return out


SQL: dict[str, str] = {}
