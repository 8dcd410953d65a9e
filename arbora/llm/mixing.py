"""Mixing sources to target weights: soft domain membership and projected-gradient document rates.

Membership. A naive Bayes classifier is fitted to the labelled table and gives
each document posteriors over the domains. Its features are the distinct words
of a text and a few pseudo-words for its shape (shares of distinct, repeated,
capitalised and oddly ended words). Kept are the words that tell domains apart
with significance (log-likelihood ratio G2). Words are not independent, and a
text without telling words tells something too, so the joint evidence is
calibrated: the least G2 (one of TELLING), a factor of the evidence and an
offset for each domain are those of the least log loss on the labelled
documents of one fold, under the words of the others. The offsets are drawn to
the class shares of the labelled documents that docs holds.

Rates. With w_i the share of row i in all tokens and t the target shares, the
rates minimise

    1/2 sum_k ((sum_i w_i r_i p_ik - t_k) / t_k)^2 + RIDGE/2 sum_i w_i (r_i - 1)^2,   r >= 0:

least squares relative to the targets, and of (nearly) equally good rates those
nearest to 1. The projected gradient is run in its lazy form: the gradients of
all rows are sums of their posteriors, so the accumulated steps are K numbers
y, and the projection onto r >= 0 is r_i = max(0, 1 - p_i . y). A step is one
aggregate over the narrow table of tokens and posteriors: the K domain totals
(the gradient) and the K x K second moments of the rows above 0 (the
curvature, which gives the step), with backtracking. It ends when the
gradient vanishes; if it doesn't, within STEPS steps, a warning says so.

DataFrame functions only.

Bounds: the classifier is fitted to at most FIT_ROWS labelled documents (the
ones with the least hashed ids) and has at most MODEL_WORDS words, which is
why its table may be broadcast. Words are told apart by 64-bit hashes.
Posteriors, totals and rates cover all rows.

Defined cases: null and empty texts have no tokens, the prior as their
posterior and no part in the totals; labelled documents without a domain are
not used; without labels all domains are equally likely; an id with several
labels counts for the last of their domains by name; repeated rows get equal rates; an
empty table gives an empty result; further columns are ignored. Targets out of
reach of the posteriors give the nearest totals; a target of 0 counts as LEAST
in the division.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import fresh, settled, table, written

FIT_ROWS = 20_000
#: Most words of the classifier.
MODEL_WORDS = 1 << 16
#: Least log-likelihood ratios (G2) between a word and the domains that are tried.
TELLING = [10.0, 15.0, 25.0, 40.0]
#: Documents that a word is taken to have been seen in besides, at the domains' shares.
PSEUDO = 2.0
#: Factors of the evidence that are tried.
TEMPERS = [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 1.0]
RIDGE = 1e-7
STEPS = 200
LEAST = 0.01
#: Wanted share of all tokens for each domain.
TARGETS = {"clean": 0.90, "toxic": 0.05, "poor": 0.05}


def domain_of_labels() -> Column:
    """The domain that a row of labels stands for."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), lambda w: w != "")


def _shape(words: str) -> list[Column]:
    """Pseudo-words for the shape of a text from its column of words: tenths of the words that are ... ."""
    n = F.size(words)
    tenth = lambda name, x: F.concat(F.lit(f" {name}"), F.floor(10 * x / n).cast("string"))
    count = lambda f: F.size(F.filter(words, f))
    return [
        tenth("distinct", F.size(F.array_distinct(words))),
        tenth("repeated", F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1)))),
        tenth("capital", count(lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1))),
        tenth("odd", count(lambda w: w.rlike(r"[^\p{L}\p{N}.,;:!?]$|[!?]{2}$"))),
    ]


def features(rows: DataFrame) -> DataFrame:
    """rows (.., text) with tokens and words (hashes of the distinct words and pseudo-words) instead of text."""
    others = [c for c in rows.columns if c != "text"]
    cut = rows.select(*others, tokens(F.col("text")).alias("_words"))
    hashed = F.transform(F.when(F.size("_words") > 0, F.concat("_words", F.array(*_shape("_words")))).otherwise(F.array().cast("array<string>")), lambda w: F.xxhash64(w))
    return cut.select(*others, F.size("_words").cast("long").alias("tokens"), F.array_distinct(hashed).alias("words"))


@dataclass
class Classifier:
    """Written (word, g2, w0..wK-1) of the telling words, the offset of each domain, and the factor of the evidence."""

    words: DataFrame
    offsets: list[float]
    temper: float


def _weights(counts: DataFrame, columns: list[str], sizes: list[int], least: float) -> DataFrame:
    """(word, g2, w0..wK-1) of the telling words; counts: (word, columns..), in how many documents of each domain."""
    whole = float(sum(sizes))
    n = sum((F.col(c) for c in columns), F.lit(0))
    log = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    known = [(F.col(c), float(size)) for c, size in zip(columns, sizes, strict=True) if size]
    g2 = 2 * sum((log(c, n * size / whole) + log(size - c, (whole - n) * size / whole) for c, size in known), F.lit(0.0))
    weights = [F.log((F.col(c) + PSEUDO * n / whole) / (size + PSEUDO) / (n / whole)) for c, size in zip(columns, sizes, strict=True)]
    telling = counts.filter(n > 0).select("word", g2.alias("g2"), *[w.alias(f"w{k}") for k, w in enumerate(weights)]).filter(F.col("g2") >= least)
    return telling.orderBy(F.desc("g2"), "word").limit(MODEL_WORDS)


def _evidence(rows: DataFrame, words: DataFrame, classes: int, least: list[float]) -> DataFrame:
    """rows (row, .., words) with s0..sK-1 instead of words: arrays, for each of least, of the sums of the weights of its words. words: bounded."""
    keys = [c for c in rows.columns if c != "words"]
    spread = rows.select(*keys, F.explode_outer("words").alias("word"))
    sums = [F.array(*[F.coalesce(F.sum(F.when(F.col("g2") >= g, F.col(f"w{k}"))), F.lit(0.0)) for g in least]).alias(f"s{k}") for k in range(classes)]
    return spread.join(F.broadcast(words), "word", "left").groupBy(*keys).agg(*sums)


def _posterior(scores: list[Column]) -> list[Column]:
    most = F.greatest(*scores)
    whole = sum((F.exp(s - most) for s in scores), F.lit(0.0))
    return [F.exp(s - most) / whole for s in scores]


def _shares(sizes: list[int]) -> list[float]:
    return [float(np.log((n + 1) / (sum(sizes) + len(sizes)))) for n in sizes]


def calibrated(scores: np.ndarray, truth: np.ndarray, shares: list[float], steps: int = 50) -> tuple[float, list[float], float]:
    """(log loss, offsets, temper) for scores (rows, classes) of documents of known domains.

    Newton steps for the offsets; they are drawn to the log class shares with
    the weight of one document a class.
    """
    n, classes = scores.shape
    one = np.eye(classes)[truth]
    best = (np.inf, shares, 1.0)
    for temper in TEMPERS:
        b = np.array(shares, float)
        for _ in range(steps):
            z = b + temper * scores
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            gradient = (p - one).sum(axis=0) + (b - shares)
            curvature = np.diag(p.sum(axis=0)) - p.T @ p + np.eye(classes)
            step = np.linalg.solve(curvature, gradient)
            b = b - step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-9:
                break
        loss = float(-np.log(np.maximum(p[np.arange(n), truth], 1e-12)).mean())
        if loss < best[0]:
            best = (loss, b.tolist(), temper)
    return best


def fitted(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str, fit_rows: int = FIT_ROWS) -> Classifier:
    """labelled: (id, domain)."""
    k = range(len(domains))
    sample = labelled.filter(F.col("domain").isin(domains)).groupBy("id").agg(F.max("domain").alias("domain"))
    sample = written(sample.orderBy(F.xxhash64("id"), "id").limit(fit_rows), "fit-sample")  # at most fit_rows narrow rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    known = features(texts.select(F.monotonically_increasing_id().alias("row"), "domain", (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)) == 2).alias("held"), "text")).drop("tokens")
    known = written(known, "labelled")
    of = lambda d, held: (F.col("domain") == d) & (F.col("held") == held)
    both = [(f"c{i}{'h' if held else 'f'}", of(d, held)) for held in (False, True) for i, d in enumerate(domains)]
    sizes = known.agg(*[F.count_if(x).alias(c) for c, x in both]).first()
    counts = known.select("domain", "held", F.explode("words").alias("word")).groupBy("word").agg(*[F.count_if(x).alias(c) for c, x in both])
    counts = written(counts, "word-counts")
    first = [sizes[f"c{i}f"] for i in k]
    every = [sizes[f"c{i}f"] + sizes[f"c{i}h"] for i in k]
    shares = _shares(every)
    part = written(_weights(counts, [f"c{i}f" for i in k], first, min(TELLING)), "words-of-part")
    held = _evidence(known.filter("held").select("row", "domain", "words"), part, len(domains), TELLING).collect()  # at most fit_rows rows of len(TELLING) * K numbers
    tries = [(np.inf, shares, 1.0, max(TELLING))]
    if held:
        truth = np.array([domains.index(r.domain) for r in held])
        for i, g in enumerate(TELLING):
            tries.append((*calibrated(np.array([[r[f"s{j}"][i] for j in k] for r in held]), truth, shares), g))
    _, offsets, temper, least = min(tries, key=lambda x: x[0])
    whole = counts.select("word", *[(F.col(f"c{i}f") + F.col(f"c{i}h")).alias(f"c{i}") for i in k])
    return Classifier(written(_weights(whole, [f"c{i}" for i in k], every, least), "telling"), offsets, temper)


def posteriors(docs: DataFrame, model: Classifier, id_col: str, text_col: str) -> DataFrame:
    """Per row of docs: row, id, tokens, p0..pK-1."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = _evidence(features(base), model.words, len(model.offsets), [0.0])
    p = _posterior([F.lit(x) + model.temper * F.get(F.col(f"s{i}"), F.lit(0)) for i, x in enumerate(model.offsets)])
    return found.select("row", "id", "tokens", *[x.alias(f"p{i}") for i, x in enumerate(p)])


@dataclass
class Fit:
    """The rates as an expression of p0..pK-1, and how the fit ended. totals: of all tokens, by domain; objective: without the ridge."""

    rate: Column
    totals: list[float]
    objective: float
    steps: int
    converged: bool


def objective(totals, shares) -> float:
    """Half the squared distance of totals from shares, relative to shares."""
    wanted = np.array(shares, float) / sum(shares)
    return float(0.5 * (((np.array(totals) - wanted) / np.maximum(wanted, LEAST)) ** 2).sum())


def rates(members: DataFrame, shares: list[float], steps: int = STEPS, tolerance: float = 1e-7) -> Fit:
    """The fitted rates. members: written (tokens, p0..pK-1)."""
    n = len(shares)
    p = [F.col(f"p{i}") for i in range(n)]
    total = float(members.agg(F.sum("tokens")).first()[0] or 0)
    wanted = np.array(shares, float) / sum(shares)
    if not total:
        return Fit(F.lit(1.0), [0.0] * n, objective([0.0] * n, shares), 0, True)
    ridge = RIDGE * np.maximum(wanted, LEAST) ** 2
    share = F.col("tokens") / total

    def rate(y):
        return F.greatest(F.lit(0.0), F.lit(1.0) - sum((x * float(v) for x, v in zip(p, y, strict=True)), F.lit(0.0)))

    def look(y):
        """The dual value, its gradient and curvature, and the totals, at y."""
        r = rate(y)
        live = F.when(r > 0, share).otherwise(0.0)
        upper = [(i, j) for i in range(n) for j in range(i, n)]
        found = members.agg(F.sum(share * r * r), *[F.sum(share * r * x) for x in p], *[F.sum(live * p[i] * p[j]) for i, j in upper]).first()
        totals, moments = np.array(found[1 : n + 1], float), np.zeros((n, n))
        for (i, j), x in zip(upper, found[n + 1 :], strict=True):
            moments[i, j] = moments[j, i] = x
        value = 0.5 * (ridge * y * y).sum() + wanted @ y + 0.5 * float(found[0])
        return value, ridge * y + wanted - totals, moments + np.diag(ridge), totals

    y = np.zeros(n)
    value, gradient, curvature, totals = look(y)
    done = 0
    while np.abs(gradient / np.maximum(wanted, LEAST)).max() > tolerance and done < steps:
        step = -np.linalg.solve(curvature, gradient)
        slope, scale, found = float(gradient @ step), 1.0, None
        while scale > 1e-12:
            found = look(y + scale * step)
            done += 1
            if found[0] <= value + 1e-4 * scale * slope or -slope * scale <= 1e-15 * max(1.0, abs(value)):
                break
            scale *= 0.25
        y = y + scale * step
        last, (value, gradient, curvature, totals) = value, found
        if abs(last - value) <= 1e-15 * max(1.0, abs(value)) and -slope <= 1e-15 * max(1.0, abs(value)):
            break  # as near as doubles get
    ended = bool(np.abs(gradient / np.maximum(wanted, LEAST)).max() <= max(tolerance, 1e-5))
    if not ended:
        warnings.warn(f"the rates had not converged after {done} steps: gradient {gradient.tolist()}", RuntimeWarning, stacklevel=2)
    return Fit(rate(y), totals.tolist(), objective(totals, shares), done, ended)


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> tuple[DataFrame, list[str]]:
    """Per row of docs: row, id, tokens, a posterior for each domain, rate, copies; and the domains.

    copies is the rate rounded up or down by a hash of the id, so that its
    expectation is the rate.
    """
    targets = targets or TARGETS
    domains = sorted(targets)
    docs = settled(docs)
    model = fitted(docs, labelled, domains, id_col, text_col, fit_rows)
    members = written(posteriors(docs, model, id_col, text_col), "members")
    fit = rates(members, [targets[d] for d in domains])
    chance = F.pmod(F.xxhash64("id", F.lit(42)), F.lit(1_000_000)) / 1_000_000.0
    found = members.withColumn("rate", fit.rate)
    return found.select("row", "id", "tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)], "rate", F.floor(F.col("rate") + chance).alias("copies")), domains


def label_domains(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").alias("id"), domain_of_labels().alias("domain"))


def weighted(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, **options) -> DataFrame:
    """The rows of docs with a rate above 0, with all their columns, rate and copies (which replace columns of these names)."""
    docs = settled(docs.drop("rate", "copies"))
    found, _ = mixed(docs, labelled, targets, **options)
    number = fresh(docs, "_row")
    found = written(found.filter("rate > 0").select(F.col("row").alias(number), "rate", "copies"), "rates")
    return docs.withColumn(number, F.monotonically_increasing_id()).join(found, number).drop(number)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors and rates of every document for TARGETS."""
    found, domains = mixed(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), "tokens", *[F.round(f"p_{d}", 6).alias(f"p_{d}") for d in domains], F.round("rate", 6).alias("rate"), "copies")


SQL: dict[str, str] = {}
