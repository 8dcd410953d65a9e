"""Token counts: best unigram segmentation of distinct pre-tokens, shared along a trie.

A text is cut into pre-tokens. The distinct pre-tokens of a batch are inserted
in a trie of bytes; a depth-first walk computes, for each node, the best
forward score of the prefix that it stands for and its number of tokens, once
for all pre-tokens that share the prefix. Terminal nodes store the counts, and
a text's count is the sum over its pre-tokens. Pre-tokens of more than LONG
bytes, which hardly share prefixes, run through the same recurrence on their
own, with the last few scores only, so that a run of millions of letters takes
no more memory than its bytes. The unigram scores are those of
a public vocabulary file under Zipf's law: the piece of rank r has the log
probability -log(r + 2) + constant. Every single byte is a piece, so each text
has a segmentation.

Documents are only mapped over. The vocabulary file is read once through Spark
and sent to the workers, each of which builds its tables once. A worker keeps the counts of the pre-tokens it
has met, up to CACHE of them, and then starts afresh: that bounds memory and
changes no count.

Defined cases: null and empty texts have 0 tokens; of segmentations with equal
scores the one with fewer tokens counts; repeated rows are counted row by row;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens whose counts a worker remembers.
CACHE = 500_000
#: Bytes from which a pre-token is counted outside the trie.
LONG = 256
#: A pre-token: words with a space before them, numbers, other signs, white space.
PATTERN = rb" ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[^\sA-Za-z0-9\x80-\xff]+|\s+"


class Vocabulary:
    """Pieces of a rank file (its path or its bytes) as a trie of bytes with scores."""

    def __init__(self, file: str | bytes):
        if isinstance(file, str):
            with open(file, "rb") as f:
                file = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line.strip())}
        self.scores = {piece: -math.log(rank + 2) for piece, rank in ranks.items()}
        self.longest = max(map(len, self.scores))
        floor = min(self.scores.values())
        for b in range(256):
            self.scores.setdefault(bytes([b]), floor)
        # pieces by reversed bytes: the walk looks back from a prefix's end
        self.back: dict = {}
        for piece, score in self.scores.items():
            node = self.back
            for b in reversed(piece):
                node = node.setdefault(b, {})
            node[-1] = score


@functools.lru_cache(maxsize=2)
def _built(file: bytes) -> Vocabulary:
    return Vocabulary(file)


def _long_count(vocabulary: Vocabulary, pretoken: bytes) -> int:
    """Token count of one pre-token; of the forward scores only as many are kept as a piece can look back."""
    size = vocabulary.longest + 1
    score, count = [0.0] * size, [0] * size  # by end modulo size
    back = vocabulary.back
    for end in range(1, len(pretoken) + 1):
        best, fewest, piece, i = -math.inf, 0, back, end
        while i:
            piece = piece.get(pretoken[i - 1])
            if piece is None:
                break
            i -= 1
            s = piece.get(-1)
            if s is not None:
                s += score[i % size]
                if s > best or (s == best and count[i % size] + 1 < fewest):
                    best, fewest = s, count[i % size] + 1
        score[end % size], count[end % size] = best, fewest
    return count[len(pretoken) % size]


def trie_counts(vocabulary: Vocabulary, pretokens) -> dict[bytes, int]:
    """Token count of each distinct pre-token; forward scores are computed once per shared prefix."""
    root: dict = {}
    found: dict[bytes, int] = {}
    for t in pretokens:
        if len(t) > LONG:
            found[t] = _long_count(vocabulary, t)
            continue
        node = root
        for b in t:
            nxt = node.get(b)
            if nxt is None:
                nxt = node[b] = {}
            node = nxt
        node[-1] = t
    back = vocabulary.back
    path: list[int] = []
    score: list[float] = [0.0]
    count: list[int] = [0]
    stack: list[tuple[int, int, dict]] = [(0, -1, root)]  # (depth, byte, node)
    while stack:
        depth, byte, node = stack.pop()
        if depth:
            del path[depth - 1 :], score[depth:], count[depth:]
            path.append(byte)
            best, fewest, piece, i = -math.inf, 0, back, depth
            while i:
                piece = piece.get(path[i - 1])
                if piece is None:
                    break
                i -= 1
                s = piece.get(-1)
                if s is not None:
                    s += score[i]
                    if s > best or (s == best and count[i] + 1 < fewest):
                        best, fewest = s, count[i] + 1
            score.append(best)
            count.append(fewest)
        for b, child in node.items():
            if b == -1:
                found[child] = count[depth]
            else:
                stack.append((depth + 1, b, child))
    return found


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, cache: int = CACHE) -> DataFrame:
    """Per row of docs: id, n_bytes, n_pretokens, n_tokens. vocabulary: the path of a rank file, which Spark reads."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(vocabulary).select("content").first()[0]))  # one vocabulary

    def run(batches):
        import re

        vocab, cut = _built(sent.value), re.compile(PATTERN).findall
        known: dict[bytes, int] = {}
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1).cast(pa.binary())]
            n, counts = [], []
            for first in range(0, len(texts), 200):
                parts = [cut(t) for t in texts[first : first + 200]]
                new = set().union(*parts).difference(known) if parts else set()
                if len(known) + len(new) > cache:
                    known, new = {}, set().union(*parts)
                known.update(trie_counts(vocab, new))
                n.extend(map(len, parts))
                counts.extend(sum(map(known.__getitem__, p)) for p in parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_pretokens long, n_tokens long").withColumnRenamed("id", id_col)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return counted(table(spark, sf_dir, "documents"))


def brute_force(vocabulary: Vocabulary, pretoken: bytes) -> int:
    """Tokens of the best segmentation by dynamic programming over one pre-token, for tests."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(pretoken) + 1):
        best.append(max((best[i][0] + vocabulary.scores[pretoken[i:end]], best[i][1] - 1) for i in range(max(0, end - vocabulary.longest), end) if pretoken[i:end] in vocabulary.scores))
    return -best[-1][1]


SQL: dict[str, str] = {}
