"""N-gram Jaccard join by parity sketches, and the components of its links.

A document is the set of its distinct word shingles; two link when
100 * |A n B| >= 85 * |A u B| (parameters). The join is exact:

* Every shingle hash is XORed into one segment of the document's sketch. A
  shingle of the symmetric difference changes one segment at most, so the
  number of differing segments is a lower bound of |A d B|, as is the Hamming
  distance of the 512-bit parity sketch that each document also carries.
* Linked sets of a and b shingles differ in at most d = (p-q)(a+b)/(p+q)
  shingles for a threshold of q/p. Sets are dealt into bands of sizes; all
  sketches of a band have m > d segments, so m - d segments at least agree.
  Segments are ordered by how many shingles they hold (fullest first, a rule
  on their content alone), and each set publishes only its first d + 1: by the
  pigeonhole principle two linked sets publish a common one. The emptiest
  segments, which unrelated sets share, are not published.
* Equal sets are one class from the start. A class meets, for every published
  segment, only its leader (the class that meets most others); verified links give
  components, and only pairs across components are then compared. A group of
  copies thus costs rows in proportion to its size, not pairs, and no link
  between different texts is lost.
* Candidates are pruned by the sketch bound and verified on the whole sets.

Defined cases: null and empty texts, and texts without words, have no
shingles and no links; a text of fewer words than the width is one shingle;
repeated rows fall into one class; a repeated doc_id gives a row for each
input row; a null doc_id sorts last; an empty table gives an empty result;
further columns are ignored. Shingles are 64-bit hashes, which are compared
only between the two sets of a pair. Sets of one class agree in a 64-bit sum,
their size and the 512-bit sketch; should sets share the sum alone, those that
do get ids from all three.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import SPACES, components, fits_broadcast, mix, settled, shingle_set, slices, table, without, word_hashes, written

#: Sets that a task remembers to have published; it then starts afresh, which only repeats keys.
SEEN = 200_000
#: Bytes of text whose words are hashed at once.
HASHED = 1 << 19
#: Words of the parity sketch.
WORDS = 8
_PARITY = [f"p{i}" for i in range(WORDS)]
_SKETCH = "row long, id long, n long, set_id long, " + ", ".join(f"{p} long" for p in _PARITY) + ", keys array<long>"


class Threshold:
    """Jaccard similarity of num / den or more."""

    def __init__(self, num: int = 85, den: int = 100):
        self.num, self.den = num, den

    def apart(self, a: int, b: int) -> int:
        """Most shingles by which linked sets of a and b shingles can differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def largest(self, a: int) -> int:
        return a * self.den // self.num

    def smallest(self, b: int) -> int:
        return -(-b * self.num // self.den)

    def segments(self, band: int) -> int:
        """Segments of the sketches in a band of 2**band .. 2**(band+1)-1 shingles."""
        top = (2 << band) - 1
        d = self.apart(top, self.largest(top))
        return d + 1 + (max(1, d // 4) if d else 0)


def _published(h: np.ndarray, t: Threshold) -> np.ndarray:
    """The keys that a set (sorted distinct hashes) publishes."""
    n = len(h)
    band = n.bit_length() - 1
    keys = _band_keys(h, band, t, t.apart(n, t.largest(n)))
    low = 1 << band  # of the band below, sets up to low - 1 may link with this one
    if band and t.smallest(n) <= low - 1:
        keys = np.concatenate([keys, _band_keys(h, band - 1, t, t.apart(low - 1, n))])
    return keys


def _band_keys(h: np.ndarray, band: int, t: Threshold, d: int) -> np.ndarray:
    m = t.segments(band)
    segment = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # sorted, as h is
    starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    held = np.zeros(m, np.int64)
    content = np.zeros(m, np.uint64)
    at = segment[starts].astype(np.int64)
    held[at] = np.diff(np.append(starts, len(h)))
    content[at] = np.bitwise_xor.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), starts)
    key = mix(content ^ mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 48)))
    order = np.lexsort((key, -held))[: d + 1]
    return key[order]


def _parity(h: np.ndarray) -> list[int]:
    """The words of a sketch in which each shingle flips one of 64 * WORDS bits."""
    counts = np.bincount((h & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _sets(texts, width: int):
    """The shingle set of each text of an Arrow array, in order."""
    for _, data, offsets in slices(texts, HASHED):
        words, bounds = word_hashes(data, offsets, SPACES)
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            yield shingle_set(words[s:e], width)


def _set_id(h: np.ndarray) -> int:
    return int(mix(h ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64).astype(np.int64))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, t: Threshold) -> DataFrame:
    """Per row of docs: its set's size, id and sketch; keys only where the task has not seen the set before."""

    def run(batches):
        seen: set[tuple] = set()
        for batch in batches:
            n, ids, parity, keys = [], [], [], []
            for h in _sets(batch.column(2), width):
                n.append(len(h))
                if not len(h):
                    ids.append(None)
                    parity.append((None,) * WORDS)
                    keys.append(None)
                    continue
                ids.append(_set_id(h))
                parity.append(tuple(_parity(h)))
                this = (ids[-1], len(h), *parity[-1][:2])
                keys.append(None if this in seen else _published(h, t).view(np.int64))
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(this)
            cols = list(zip(*parity, strict=True)) if parity else [()] * WORDS
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in cols], pa.array(keys, pa.list_(pa.int64()))],
                names=["row", "id", "n", "set_id", *_PARITY, "keys"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _SKETCH)


def _shingles(texts: DataFrame, width: int) -> DataFrame:
    """(set_id, shingles) of texts (set_id, text)."""

    def run(batches):
        for batch in batches:
            sets = [h.view(np.int64) for h in _sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["set_id", "shingles"])

    return texts.mapInArrow(run, "set_id long, shingles array<long>")


_BOUNDS = ["n", *_PARITY]


def may_link(a: str, b: str, t: Threshold) -> Column:
    """Whether sizes and parity sketches (columns a_n, a_p0 .., b_n, ..) leave a link possible."""
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    hamming = sum((F.bit_count(F.col(f"{a}_p{i}").bitwiseXOR(F.col(f"{b}_p{i}"))) for i in range(1, WORDS)), F.bit_count(F.col(f"{a}_p0").bitwiseXOR(F.col(f"{b}_p0"))))
    return (F.least(n, m) * t.den >= F.greatest(n, m) * t.num) & (hamming * (t.den + t.num) <= (n + m) * (t.den - t.num))


class _Verifier:
    """Checks candidate pairs of set ids on the whole sets."""

    def __init__(self, docs, classes, text_col, width, t: Threshold):
        self.docs, self.classes, self.text_col, self.width, self.t = docs, classes, text_col, width, t

    def __call__(self, pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(pairs that the sketch bound left, links among them), both written."""
        t = self.t
        side = lambda x: self.classes.select(F.col("set_id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in _BOUNDS])
        left = pairs.join(side("a"), "a").join(side("b"), "b").filter(may_link("a", "b", t)).select("a", "b", "a_n", "b_n")
        left = written(left, f"{name}-candidates")
        # one row of the corpus for each set that takes part
        wanted = left.select(F.col("a").alias("set_id")).unionByName(left.select(F.col("b").alias("set_id"))).distinct()
        wanted = written(self.classes.join(wanted, "set_id", "left_semi").select(F.col("rep").alias("row"), "set_id"), f"{name}-wanted")
        texts = self.docs.select(F.monotonically_increasing_id().alias("row"), F.col(self.text_col).alias("text"))
        texts = texts.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, "row").select("set_id", "text")
        sets = written(_shingles(texts, self.width), f"{name}-sets")
        one = lambda x: sets.select(F.col("set_id").alias(x), F.col("shingles").alias(f"{x}_set"))
        both = left.join(one("a"), "a").join(one("b"), "b")
        common = F.size(F.array_intersect("a_set", "b_set"))
        links = both.filter(common * t.den >= (F.col("a_n") + F.col("b_n") - common) * t.num).select("a", "b")
        return left, written(links, f"{name}-links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Per row of docs: row, id, n_shingles, component_id."""
    t = Threshold(num, den)
    docs = settled(docs)
    base = written(sketches(docs, id_col, text_col, width, t), "sketches")
    all_bounds = F.struct(*_BOUNDS)
    shared_ids = base.filter("n > 0").groupBy("set_id").agg(F.min(all_bounds).alias("lo"), F.max(all_bounds).alias("hi"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m"), F.min("row").alias("rep"))
    classes = written(shared_ids, "classes")
    clashes = classes.filter("lo <> hi")
    if clashes.limit(1).count():
        told = F.when(F.col("clash"), F.xxhash64("set_id", *_BOUNDS)).otherwise(F.col("set_id"))
        marked = base.join(clashes.select("set_id", F.lit(True).alias("clash")), "set_id", "left")
        base = written(marked.withColumn("set_id", told).select(*base.columns), "sketches")
        classes = written(base.filter("n > 0").groupBy("set_id").agg(F.min(all_bounds).alias("lo"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m"), F.min("row").alias("rep")), "classes")
    classes = classes.select("set_id", F.col("m.id").alias("least"), "rep", "lo.*")
    published = base.filter(F.col("keys").isNotNull()).select(F.explode("keys").alias("key"), "set_id")
    # keys of several sets, by partial sums; their sets by a join that can be split where a key is hot
    keys = published.groupBy("key").agg(F.min("set_id").alias("first"), F.max("set_id").alias("last"), F.count(F.lit(1)).alias("met"))
    keys = written(keys.filter("first <> last").select(F.col("key").alias("met_key"), "met"), "met-keys")
    met = written(published.join(keys, F.col("key") == F.col("met_key")).select("key", "set_id", "met").dropDuplicates(["key", "set_id"]), "met")
    # the leader of a segment is the set that meets most others in all: of a group of near copies, the text they were made from
    degrees = met.groupBy("set_id").agg(F.sum("met").alias("degree"))
    ranked = written(met.join(degrees, "set_id").select("key", "set_id", "degree"), "ranked")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("degree", "set_id"))["set_id"].alias("leader")).select(F.col("key").alias("led_key"), "leader")
    shared = written(ranked.join(leaders, F.col("key") == F.col("led_key")).select("key", "set_id", "leader"), "shared")
    verify = _Verifier(docs, classes, text_col, width, t)
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    tried, links = verify(shared.filter("set_id <> leader").select(*pair("set_id", "leader")).distinct(), "lead")
    comp = components(links)
    # what is left: pairs of a segment's sets that lie in different components
    own = comp.select(F.col("node").alias("set_id"), F.col("comp").alias("own"))
    led = comp.select(F.col("node").alias("leader"), F.col("comp").alias("led"))
    marked = shared.join(own, "set_id", "left").join(led, "leader", "left").select("key", "set_id", F.coalesce("own", "set_id").alias("own"), F.coalesce("led", "leader").alias("led"))
    marked = written(marked, "marked")
    # the bounds are part of the join's condition: pairs that cannot link are never rows
    bounds = lambda x: classes.select("set_id", *[F.col(c).alias(f"{x}_{c}") for c in _BOUNDS])
    out = marked.filter("own <> led").join(bounds("x"), "set_id").withColumnsRenamed({"set_id": "x", "own": "x_own"}).drop("led")
    rest = marked.join(out.select("key").distinct(), "key", "left_semi").join(bounds("y"), "set_id").withColumnsRenamed({"set_id": "y", "own": "y_own"})
    out, rest = written(out, "out-of-lead"), written(rest, "around")
    crossing = (F.col("x_own") != F.col("y_own")) & ((F.col("y_own") == F.col("led")) | (F.col("x") < F.col("y"))) & may_link("x", "y", t)
    across = out.join(rest.withColumnRenamed("key", "y_key"), (F.col("key") == F.col("y_key")) & crossing).select(*pair("x", "y")).distinct()
    across = across.join(tried.select("a", "b"), ["a", "b"], "left_anti")
    _, more = verify(across, "cross")
    if more.limit(1).count():
        comp = components(written(links.unionByName(more), "links"))
    # the least doc_id of all sets of a component
    placed = classes.join(comp, classes.set_id == comp.node, "left").select("set_id", "least", F.coalesce("comp", "set_id").alias("comp"))
    heads = written(placed.groupBy("comp").agg(F.min("least").alias("component_id")), "heads")
    of_set = written(placed.join(heads, "comp").select("set_id", "component_id"), "of-set")
    return base.select("row", "id", "n", "set_id").join(of_set, "set_id", "left").select("row", "id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose component has a row of a smaller id (of equal ids the first row stays)."""
    docs = settled(docs)
    found = written(jaccard_components(docs, id_col, text_col, **options).select("row", "id", "component_id", "n_shingles"), "components")
    keep = found.filter("n_shingles > 0").groupBy("component_id").agg(F.min(F.when(F.col("id").eqNullSafe(F.col("component_id")), F.col("row"))).alias("kept_row"))
    dropped = found.filter("n_shingles > 0").join(keep, found.component_id.eqNullSafe(keep.component_id)).filter("row <> kept_row").select("row")
    return without(docs, written(dropped, "near-dropped"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard_components(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def brute_force(docs: list[tuple[int, str | None]], width: int = 4, num: int = 85, den: int = 100) -> list[tuple[int, int, int]]:
    """The registered query's rows by comparing all pairs of word tuples, for tests."""
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in docs:
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(lower))
        k = min(width, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(docs)]


SQL = {
    "op5_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 1) + 1), lambda i: array_to_string(ws[i:i+3], ' '))) AS g
  FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(doc_id, to_id) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN l ON l.a = r.to_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.to_id) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
}
