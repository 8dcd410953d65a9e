"""Quality classifier: interpolated modified Kneser-Ney n-grams, perplexity, language quantiles.

The model is an interpolated modified Kneser-Ney model of word bigrams, trained
on all trusted text: the documents whose label says so. Words are what white
space parts; letters of scripts without spaces (Han, kana, Thai, Lao, Khmer,
Burmese) are words of their own. The WORDS most frequent words have ids; other
words share one id and are spelled by a trigram model over a fixed alphabet of
64 symbols (letters a-z, capitals, digits, each ASCII sign, white space, other
letters, other signs). Bigram counts are exact and grow with the trusted text:
each task counts its documents' bigrams, and the counts are summed in SHARDS
shards. The bigrams of all documents are counted by text, packed, and joined
with the shards (a cogroup by shard); the partial sums of log probabilities are
added up by document. Only what the words alone give is broadcast: at most
WORDS ids, totals, weights and lower-order probabilities, and 64**3 spellings.
A document's perplexity is that of its words.

Documents are dealt over FOLDS folds by a hash of their ids, and each is judged
by the model of the trusted documents of the other folds, since a model makes
the texts that it is trained on look better than any others.

A document's surprise is its cross entropy above the trusted median of its
language, damped for short texts by sqrt(n / (n + DAMP)). The limit of a
language is SLACK times (1: no more than) the QUANTILE of the surprise of its trusted documents
(of all languages' where a language has fewer than LEAST trusted documents).
Medians and quantiles are exact but for being rounded up to a grid of 1 / GRID,
from counts by value.
The same is done with the cross entropy a symbol of the spelling alone.
Documents above either limit are rejected.

Defined cases: null texts and texts without words have no perplexity and are kept; a null
language is a language of its own; repeated rows are judged row by row, and a
doc_id that labels has several times is trusted if any of its labels says so;
without trusted text nothing is rejected; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.common import filtered_by, mix, settled, slices, table, without, word_hashes, written

SYMBOLS = 64
#: Most words of the vocabulary; ids 1 .. WORDS, 0 for other words, START before a text.
WORDS = (1 << 16) - 2
START = WORDS + 1
#: Shards of the bigram counts.
SHARDS = 64
#: A document is judged by the model of the trusted documents of the other folds.
FOLDS = 2
#: What is held against a limit: nats a word, and nats a symbol by spelling alone.
MEASURES = ("entropy", "letters")
QUANTILE = 0.995
SLACK = 1.0
DAMP = 200
LEAST = 50
#: Steps of a nat in which quantiles are taken.
GRID = 10_000
#: Steps that are first counted together.
CELL = 100


def _alphabet() -> np.ndarray:
    lut = np.full(256, 63, np.int32)
    lut[97:123] = np.arange(1, 27)
    lut[65:91] = 27
    lut[48:58] = 28
    lut[[b for b in range(33, 127) if not chr(b).isalnum()]] = np.arange(29, 61)
    lut[[9, 10, 11, 12, 13, 32]] = 0
    lut[0xC2] = lut[0xE2] = 63
    lut[0xC3:0xCC] = 61
    lut[0xCC:0xE2] = 62
    lut[0xE3:0xF0] = 62
    return lut


_LUT = _alphabet()
_BLANKS = np.arange(256, dtype=np.uint8)
_BLANKS[[9, 10, 11, 12, 13]] = 32
_SHARDED = "shard int, n long, keys binary, counts binary"


def symbols(data: np.ndarray) -> np.ndarray:
    """Symbols of UTF-8 bytes, one for each code point; capitals of the first Latin block count as other letters."""
    s = _LUT[data]
    if not len(data):
        return s
    after = np.append(data[1:], np.uint8(0))
    s[(data == 0xC3) & (after < 0xA0)] = 62
    return s[(data < 0x80) | (data >= 0xC0)]


def trigrams(data: np.ndarray) -> np.ndarray:
    """Codes of the trigrams that end at each symbol of a text; two spaces stand before it."""
    s = np.concatenate([np.zeros(2, np.int32), symbols(data)])
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def _texts(column):
    """The bytes of each text of an Arrow array, in order."""
    for _, data, offsets in slices(column):
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            yield data[a:b]


def trigram_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram int, c long) over all rows of texts, sharded by trigram."""

    def count(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for data in _texts(batch.column(0)):
                if len(data):
                    np.add.at(total, g := trigrams(data), 1) if len(data) < 64 else np.add(total, np.bincount(trigrams(data), minlength=SYMBOLS**3), out=total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "c"])

    return texts.select(F.col(text_col).alias("text")).mapInArrow(count, "gram int, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts (for counts of 1, 2, 3 and more) from the counts of counts."""
    n = counts.agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    return discounts_of(*n)


def discounts_of(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    if not (n1 and n2 and n3 and n4):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def _order(counts: DataFrame, context, d: list[float]) -> tuple[DataFrame, DataFrame]:
    """Of an order's counts: (gram, context, share of its discounted count), (context, weight of the lower order)."""
    cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    counts = counts.withColumn("context", context).withColumn("cut", cut)
    contexts = counts.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("weight"))
    shares = counts.join(contexts, "context").select("gram", "context", ((F.col("c") - F.col("cut")) / F.col("total")).alias("share"))
    return shares, contexts.select("context", "weight")


def kneser_ney(texts: DataFrame, text_col: str = "text") -> np.ndarray | None:
    """Log probabilities of all trigrams, from sharded joins of the counts of texts; None without any text."""
    c3 = written(trigram_counts(texts, text_col), "trigrams")
    c2 = written(c3.groupBy((F.col("gram") % SYMBOLS**2).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "bigrams")
    c1 = written(c2.groupBy((F.col("gram") % SYMBOLS).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "unigrams")
    lower = np.full(1, 1.0 / SYMBOLS)
    for order, counts in ((1, c1), (2, c2), (3, c3)):
        shares, contexts = _order(counts, F.floor(F.col("gram") / SYMBOLS).cast("int") if order > 1 else F.lit(0), discounts(counts))
        # both sides are bounded by the alphabet: at most 64**order and 64**(order-1) rows
        contexts, shares = contexts.toPandas(), shares.select("gram", "share").toPandas()
        if not len(shares):
            return None
        weight = np.ones(SYMBOLS ** (order - 1))
        weight[contexts["context"].to_numpy()] = contexts["weight"].to_numpy()
        # p(w | u v) = share + weight(u v) * p(w | v)
        full = np.repeat(weight, SYMBOLS) * (np.tile(lower, SYMBOLS) if order > 1 else np.repeat(lower, SYMBOLS))
        full[shares["gram"].to_numpy()] += shares["share"].to_numpy()
        lower = full
    return np.log(lower).astype(np.float32)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: bytes and offsets with spaces around unspaced letters, word hashes, each text's range in them, word starts and ends."""
    after = np.append(data[1:], np.uint8(0))
    lone = (data >= 0xE3) & (data <= 0xE9) | (data == 0xE0) & (after >= 0xB8) & (after <= 0xBB) | (data == 0xE1) & ((after >= 0x80) & (after <= 0x82) | (after == 0x9E) | (after == 0x9F))
    far = (data == 0xF0) & (after >= 0xA0) & (after <= 0xAF)
    if lone.any() or far.any():
        at = np.concatenate([np.flatnonzero(lone | far), np.flatnonzero(lone) + 3, np.flatnonzero(far) + 4])
        at = np.unique(np.minimum(at, len(data)))
        data, offsets = np.insert(data, at, 32), offsets + np.searchsorted(at, offsets)
    hashes, bounds = word_hashes(data, offsets, _BLANKS)
    inside = _BLANKS[data] != 32
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    starts[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    return data, offsets, hashes, bounds, np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their summed counts."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def _tallied(parts) -> tuple[np.ndarray, np.ndarray] | None:
    """Counts over an iterator of key arrays, merged as they come."""
    keys, counts, size = [], [], 0
    for part in parts:
        k, c = np.unique(part, return_counts=True)
        keys.append(k)
        counts.append(c)
        size += len(k)
        if len(keys) > 1 and size > 2 * len(keys[0]) + (1 << 20):
            k, c = _merged(keys, counts)
            keys, counts, size = [k], [c], len(k)
    return _merged(keys, counts) if keys else None


def _sliced(batches, column: int):
    for batch in batches:
        for _, data, offsets in slices(batch.column(column)):
            if len(data):
                yield data, offsets


def vocabulary(texts: DataFrame, most: int, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the `most` most frequent words that texts has twice or more."""

    def count(batches):
        found = _tallied(_words(data, offsets)[2] for data, offsets in _sliced(batches, 0))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), pa.array(found[1])], names=["word", "c"])

    counts = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))
    top = counts.filter("c > 1").orderBy(F.desc("c"), "word").limit(most).select("word").toPandas()  # at most `most` rows
    return np.sort(top["word"].to_numpy(np.int64).view(np.uint64))


def _ids(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """1 + the place of each word in the vocabulary, 0 for other words."""
    if not len(known):
        return np.zeros(len(hashes), np.uint32)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at + 1, 0).astype(np.uint32)


def _bigrams(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Keys of the bigrams that end at each word; START stands before a text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    first = bounds[:-1]
    before[first[first < bounds[1:]]] = START
    return (before << np.uint32(16)) | ids


def _shard(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(SHARDS)).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(np.ascontiguousarray(x).tobytes(), asbytes=True)


def _unpack(x, n: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(x.as_buffer(), n * np.dtype(dtype).itemsize), dtype) if n else np.zeros(0, dtype)


def _delta(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=keys.dtype.type(0))


def _undelta(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint32)


def bigram_shards(texts: DataFrame, known: np.ndarray, text_col: str = "text") -> DataFrame:
    """(shard, n, keys, counts): for each shard the counts of its word bigrams over all rows of texts, packed."""
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        def keys():
            for data, offsets in _sliced(batches, 0):
                _, _, hashes, bounds, _, _ = _words(data, offsets)
                yield _bigrams(_ids(hashes, sent.value), bounds)

        found = _tallied(keys())
        if found:
            shard = _shard(found[0])
            order = np.argsort(shard, kind="stable")
            at = np.searchsorted(shard[order], np.arange(SHARDS + 1))
            for k in range(SHARDS):
                part = order[at[k] : at[k + 1]]
                if len(part):
                    yield _packed(k, found[0][part], found[1][part])

    def merge(found: pa.Table) -> pa.Table:
        parts = [(_undelta(_unpack(k, n.as_py(), np.uint32)), _unpack(c, n.as_py(), np.int64)) for n, k, c in zip(*[found[x] for x in ("n", "keys", "counts")], strict=True)]
        return pa.Table.from_batches([_packed(found["shard"][0].as_py(), *_merged(*map(list, zip(*parts, strict=True))))])

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(count, _SHARDED)
    return rows.groupBy("shard").applyInArrow(merge, _SHARDED)


def _packed(shard: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([_pack(_delta(keys))], pa.binary()), pa.array([_pack(counts)], pa.binary())], names=["shard", "n", "keys", "counts"])


def word_model(shards: DataFrame) -> tuple[list[float], np.ndarray, np.ndarray, np.ndarray]:
    """Discounts, and by word id: occurrences as a context, weight of the lower order, lower-order probability."""

    def count(batches):
        sums = np.zeros((WORDS + 2, 5), np.int64)
        of = np.zeros(5, np.int64)
        for batch in batches:
            for n, k, c in zip(*[batch.column(i) for i in (1, 2, 3)], strict=True):
                keys, counts = _undelta(_unpack(k, n.as_py(), np.uint32)), _unpack(c, n.as_py(), np.int64)
                v, w = keys >> np.uint32(16), keys & np.uint32(0xFFFF)
                sums[:, 0] += np.bincount(v, counts, WORDS + 2).astype(np.int64)
                for i, some in ((1, counts == 1), (2, counts == 2), (3, counts > 2)):
                    sums[:, i] += np.bincount(v[some], minlength=WORDS + 2)
                sums[:, 4] += np.bincount(w, minlength=WORDS + 2)
                of[:4] += np.bincount(np.minimum(counts, 5), minlength=6)[1:5]
        at = np.flatnonzero(sums.any(axis=1))
        columns = [np.append(at, -1), *np.vstack([sums[at], of]).T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x), pa.int64()) for x in columns], names=["id", *"abcde"])

    found = shards.mapInArrow(count, "id long, a long, b long, c long, d long, e long").groupBy("id").agg(*[F.sum(x).alias(x) for x in "abcde"]).toPandas()  # at most WORDS + 3 rows
    sums = np.zeros((WORDS + 3, 5))
    sums[found["id"].to_numpy()] = found[list("abcde")].to_numpy()  # id -1: counts of counts
    d = discounts_of(*sums[-1, :4])
    total, sums = np.maximum(sums[:-1, 0], 1.0), sums[:-1]
    weight = np.where(sums[:, 0] > 0, sums[:, 1:4] @ np.array(d) / total, 1.0)
    before = sums[: WORDS + 1, 4]
    e = discounts_of(*[(before == k).sum() for k in (1, 2, 3, 4)])
    cut = np.where(before > 2, e[2], np.where(before == 2, e[1], np.where(before == 1, e[0], 0.0)))
    lower = np.zeros(WORDS + 2)
    lower[: WORDS + 1] = (before - cut + cut.sum() / (WORDS + 1)) / max(before.sum(), 1.0)
    return d, total, weight, lower


def perplexities(docs: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row of docs: row, id, lang, n (symbols), entropy (nats a word), letters (nats a symbol, by spelling alone) under the model of texts. docs has a column row."""
    context = docs.sparkSession.sparkContext
    rows = docs.select("row", F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    letters = kneser_ney(texts)
    if letters is None:
        return rows.select("row", "id", "lang", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), F.lit(None).cast("double").alias("entropy"), F.lit(None).cast("double").alias("letters"))
    known = vocabulary(texts, WORDS)
    shards = written(bigram_shards(texts, known), "bigram-shards")
    spelled, words, model = context.broadcast(letters), context.broadcast(known), context.broadcast(word_model(shards))  # all of bounded sizes

    def base(batches):
        for batch in batches:
            n, m, cost, letter = [np.zeros(0)], [np.zeros(0)], [np.zeros(0)], [np.zeros(0)]
            for _, data, offsets in slices(batch.column(3), 1 << 19):
                lead = np.concatenate([[0], np.cumsum((data < 0x80) | (data >= 0xC0))])
                n.append(np.diff(lead[offsets]))
                data, offsets, hashes, bounds, starts, ends = _words(data, offsets)
                m.append(np.diff(bounds))
                if not len(data):
                    cost.append(np.zeros(len(offsets) - 1))
                    letter.append(cost[-1])
                    continue
                at = np.concatenate([[0], np.cumsum((data < 0x80) | (data >= 0xC0))])
                s = symbols(data)
                one, two = np.append(np.int32(0), s[:-1]), np.append(np.zeros(2, np.int32), s)[: len(s)]
                first = at[offsets[:-1]]
                one[first[first < len(s)]] = two[first[first < len(s)]] = 0
                two[first[first + 1 < len(s)] + 1] = 0
                sums = np.concatenate([[0.0], np.cumsum(spelled.value[(two * SYMBOLS + one) * SYMBOLS + s], dtype=np.float64)])
                text = np.searchsorted(bounds, np.arange(len(hashes)), "right") - 1
                cost_of = sums[np.minimum(at[ends] + 1, at[offsets[text + 1]])] - sums[at[starts]]
                letter.append(np.diff(sums[at[offsets]]) / np.maximum(np.diff(at[offsets]), 1))
                cost.append(np.bincount(text, np.where(_ids(hashes, words.value) == 0, cost_of, 0.0), len(offsets) - 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *[pa.array(np.concatenate(x), t) for x, t in ((n, pa.int64()), (m, pa.int64()), (cost, pa.float64()), (letter, pa.float64()))]], names=["row", "id", "lang", "n", "words", "spelling", "letters"])

    def pack(batches):
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for at, data, offsets in slices(batch.column(1)):
                _, _, hashes, bounds, _, _ = _words(data, offsets)
                if not len(hashes):
                    continue
                texts_of = np.searchsorted(bounds, np.arange(len(hashes)), "right") - 1
                many = len(offsets) - 1
                keys = _bigrams(_ids(hashes, words.value), bounds)
                both, counts = np.unique((keys.astype(np.uint64) << np.uint64(32)) | texts_of.astype(np.uint64), return_counts=True)
                keys, of = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.uint16 if many <= 1 << 16 else np.uint32)
                shard = _shard(keys)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(SHARDS + 1))
                parts = [(k, order[cuts[k] : cuts[k + 1]]) for k in range(SHARDS) if cuts[k] < cuts[k + 1]]
                columns = [pa.array([k for k, _ in parts], pa.int32()), pa.array([int(numbers[at])] * len(parts), pa.int64()), pa.array([many] * len(parts), pa.int64()), pa.array([len(p) for _, p in parts], pa.int64())]
                columns += [pa.array([_pack(f(p)) for _, p in parts], pa.binary()) for f in (lambda p: _delta(keys[p]), lambda p: of[p], lambda p: counts[p].astype(np.uint32))]
                columns.append(pa.array([_pack(np.diff(numbers[at : at + many], prepend=0))] + [None] * (len(parts) - 1), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "block", "many", "n", "keys", "texts", "counts", "rows"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        d, total, weight, lower = model.value
        known_keys, c = np.zeros(1, np.uint32), np.zeros(1, np.int64)
        for n, k, x in zip(*[left[name] for name in ("n", "keys", "counts")], strict=True):
            known_keys, c = _undelta(_unpack(k, n.as_py(), np.uint32)), _unpack(x, n.as_py(), np.int64)
        cut = np.array([0.0, *d])
        blocks, sums = [], []
        for block, many, n, k, t, x in zip(*[right[name] for name in ("block", "many", "n", "keys", "texts", "counts")], strict=True):
            many, n = many.as_py(), n.as_py()
            keys = _undelta(_unpack(k, n, np.uint32))
            at = np.minimum(np.searchsorted(known_keys, keys), len(known_keys) - 1)
            seen = np.where(known_keys[at] == keys, c[at], 0)
            v, w = keys >> np.uint32(16), keys & np.uint32(0xFFFF)
            p = (seen - cut[np.minimum(seen, 3)]) / total[v] + weight[v] * lower[w]
            blocks.append(block.as_py())
            sums.append(_pack(np.bincount(_unpack(t, n, np.uint16 if many <= 1 << 16 else np.uint32), np.log(p) * _unpack(x, n, np.uint32), many).astype(np.float32)))
        return pa.table([pa.array(blocks, pa.int64()), right["many"].combine_chunks(), pa.array(sums, pa.binary()), right["rows"].combine_chunks()], names=["block", "many", "sums", "rows"])

    def total_of(found: pa.Table) -> pa.Table:
        many = found["many"][0].as_py()
        sums = sum(_unpack(x, many, np.float32).astype(np.float64) for x in found["sums"])
        numbers = next(np.cumsum(_unpack(x, many, np.int64)) for x in found["rows"] if x.is_valid)
        return pa.table([pa.array(numbers), pa.array(sums, pa.float64())], names=["row", "joined"])

    payload = rows.select("row", "text").mapInArrow(pack, "shard int, block long, many long, n long, keys binary, texts binary, counts binary, rows binary")
    parts = shards.groupBy("shard").cogroup(payload.groupBy("shard")).applyInArrow(score, "block long, many long, sums binary, rows binary")
    joined = parts.groupBy("block").applyInArrow(total_of, "row long, joined double")
    bases = rows.mapInArrow(base, "row long, id long, lang string, n long, words long, spelling double, letters double")
    entropy = F.when(F.col("words") > 0, -(F.col("spelling") + F.col("joined")) / F.col("words"))
    return bases.join(joined, "row", "left").select("row", "id", "lang", "n", entropy.alias("entropy"), F.when(F.col("n") > 0, -F.col("letters")).alias("letters"))


def quantiles(rows: DataFrame, measures: dict[str, Column], q: float) -> DataFrame:
    """(lang, known, a column a measure): the least values that a share q of a language's rows do not exceed, on the grid; lang null: of all rows.

    Rows are counted by value first, and the result does not depend on how they
    lie in partitions. Only cells of CELL values and then one cell's values are
    ordered.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.ceil(c * GRID).cast("long").alias("v")) for m, c in measures.items()])).alias("x")
    counts = rows.select(F.explode(F.array("lang", F.lit(None))).alias("lang"), each).filter("x.v is not null").groupBy("lang", "x.measure", "x.v").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("cell", F.floor(F.col("v") / CELL))
    w = Window.partitionBy("lang", "measure")
    # the cell in which the share is reached, and then the value in it
    cells = counts.groupBy("lang", "measure", "cell").agg(F.sum("c").alias("c"))
    cells = cells.withColumn("upto", F.sum("c").over(w.orderBy("cell"))).withColumn("known", F.sum("c").over(w))
    reached = cells.filter(F.col("upto") >= F.col("known") * q).groupBy("lang", "measure").agg(F.min(F.struct("cell", F.col("known"), (F.col("upto") - F.col("c")).alias("before"))).alias("at"))
    reached = reached.select(F.col("lang").alias("of_lang"), F.col("measure").alias("of_measure"), "at.*").withColumnRenamed("cell", "of_cell")
    meets = F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("measure") == F.col("of_measure")) & (F.col("cell") == F.col("of_cell"))
    inner = counts.join(reached, meets).withColumn("below", F.col("before") + F.sum("c").over(w.orderBy("v")))
    at = F.min(F.when(F.col("below") >= F.col("known") * q, F.col("v"))) / float(GRID)
    found = inner.groupBy("lang", "measure").agg(at.alias("at"), F.max("known").alias("known"))
    value = lambda m: F.max(F.when(F.col("measure") == m, F.col("at"))).alias(m)
    return written(found.groupBy("lang").agg(F.max("known").alias("known"), *[value(m) for m in measures]), "quantiles")


def judged(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, slack: float = SLACK, damp: int = DAMP, least: int = LEAST) -> DataFrame:
    """Per row of docs: row, id, lang, n, perplexity, surprise, surprise_limit, letters_surprise, letters_limit, kept.

    trusted_ids: the ids (in a column `id`) of trusted documents.
    """
    docs = settled(docs)
    trusted = written(trusted_ids.select("id").distinct(), "trusted-ids")
    fold = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(FOLDS))
    rows = docs.withColumn("row", F.monotonically_increasing_id()).select("row", id_col, text_col, lang_col)
    parts = []
    for k in range(FOLDS):
        texts = filtered_by(docs.filter(fold != k).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), trusted, "id", "left_semi")
        parts.append(written(perplexities(rows.filter(fold == k), texts, id_col, text_col, lang_col), "scores"))
    scores = reduce(DataFrame.unionByName, parts)
    known = scores.join(trusted, "id", "left_semi").filter("entropy is not null")
    damping = F.sqrt(F.col("n") / (F.col("n") + damp))
    middle = quantiles(known, {m: F.col(m) for m in MEASURES}, 0.5)
    overall = middle.filter("lang is null").first()
    medians = middle.filter(F.col("lang").isNotNull() & (F.col("known") >= least)).select("lang", *[F.col(m).alias(f"{m}_median") for m in MEASURES])
    medians = written(medians, "medians")
    surprise = {f"{m}_surprise": (F.col(m) - F.coalesce(f"{m}_median", F.lit(overall[m] if overall else None).cast("double"))) * damping for m in MEASURES}
    of_known = known.join(F.broadcast(medians), "lang", "left").withColumns(surprise)  # a row a language
    top = quantiles(of_known, {m: F.col(f"{m}_surprise") for m in MEASURES}, quantile)
    general = top.filter("lang is null").first()
    limits = top.select("lang", *[(F.col(m) * slack).alias(f"{m}_limit") for m in MEASURES])
    limits = written(medians.join(limits, "lang", "left"), "limits")
    found = scores.join(limits, "lang", "left").withColumns(surprise)
    found = found.withColumns({f"{m}_limit": F.coalesce(f"{m}_limit", F.lit(general[m] * slack if general and general[m] is not None else None).cast("double")) for m in MEASURES})
    kept = reduce(Column.__and__, [F.coalesce(F.col(f"{m}_surprise") <= F.col(f"{m}_limit"), F.lit(True)) for m in MEASURES])
    return found.select("row", "id", "lang", "n", F.exp("entropy").alias("perplexity"), F.col("entropy_surprise").alias("surprise"), F.col("entropy_limit").alias("surprise_limit"), "letters_surprise", "letters_limit", kept.alias("kept"))


def trusted_labels(labels: DataFrame) -> DataFrame:
    """Ids of the documents that labels calls good."""
    return labels.filter("quality = 1").select(F.col("doc_id").alias("id"))


def passing(docs: DataFrame, trusted_ids: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    docs = settled(docs)
    return without(docs, written(judged(docs, trusted_ids, **options).filter("not kept").select("row"), "rejected"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    found = judged(table(spark, sf_dir, "documents"), trusted_labels(table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), "lang", F.col("n").alias("n_symbols"), "perplexity", "surprise", "surprise_limit", "letters_surprise", "letters_limit", "kept")


SQL: dict[str, str] = {}
