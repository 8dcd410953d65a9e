"""License scans: windows of a text against licence templates by Dice over word bigrams.

Texts and templates are normalised (lower case, letters and digits only) to
words. The bigrams of a text meet the bigrams of the templates in a broadcast
join; what remains are hits (position, bigram) by document and template. With
a threshold t, a text can only match a template of b bigrams if it has
b * t / (2 - t) of them at least: this size bound prunes templates by the size
of the text before the join, and nearly all candidates by their number of
different hits after it. Of each candidate every window that starts at a hit
and is as long as the template is compared: it ends with the last hit in it,
its set has the different hits and all other positions, and its coefficient is
2 * common / (its size + b). So notices are found that are wrapped over lines,
stand inside longer lines, or are long texts themselves. DataFrame functions
only; the hits of a document are folded within its task before the only
shuffle, which is dealt by document and cannot be skewed by a common licence.

Defined cases: null and empty texts, and texts of fewer than two words, have
no bigrams and match nothing; of equal coefficients the licence whose id comes
first wins; a licence with several templates counts once; repeated rows are
scanned row by row; an empty table or no templates give an empty result or
rows without a licence; further columns are ignored. Bigrams are told apart by
64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import fits_broadcast, table
from arbora.llm.licence_texts import TEMPLATES

DICE = 0.8
#: Most templates whose bigrams are broadcast (a few hundred each); more are joined by shuffle.
TEMPLATES_BROADCAST = 2_000


def words_of(text: Column) -> Column:
    """Normalised words of text."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9ß-öø-ÿ]+", " ")), " ")


def bigrams(words: str) -> Column:
    """The bigrams of a column of words in order, as 64-bit hashes.

    words must be a column and not an expression, which a lambda would compute
    for each element.
    """
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1)))


def _windows(hits: str, width: Column, size: Column) -> Column:
    """The greatest coefficient of the windows that start at each of the hits (sorted array of (at, gram))."""

    def value(x, i):
        inside = F.filter(F.slice(F.col(hits), i + 1, width), lambda y: y["at"] < x["at"] + width)
        common = F.size(F.array_distinct(F.transform(inside, lambda y: y["gram"])))
        span = F.element_at(inside, -1)["at"] - x["at"] + 1
        return 2.0 * common / (span - F.size(inside) + common + size)

    return F.array_max(F.transform(hits, value))


def scanned(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", dice: float = DICE) -> DataFrame:
    """Per row of docs: id, licence (best match or null), dice, n_matches (licences that match).

    templates: (licence string, notice string).
    """
    least = dice / (2 - dice)
    cut = templates.select("licence", F.col("notice").alias("notice"), words_of(F.col("notice")).alias("words")).filter(F.size("words") > 1)
    known = cut.select("licence", F.xxhash64("licence", "notice").alias("template"), bigrams("words").alias("g")).dropDuplicates(["template"])
    known = known.select("licence", "template", F.size("g").alias("width"), F.size(F.array_distinct("g")).alias("t_size"), F.explode(F.array_distinct("g")).alias("t_gram"))
    known = F.broadcast(known) if fits_broadcast(templates, TEMPLATES_BROADCAST) else known
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    grams = base.select("row", "id", bigrams("words").alias("g"))
    spread = grams.select("row", "id", F.size("g").alias("size"), F.posexplode("g").alias("at", "gram"))
    met = spread.join(known, (F.col("gram") == F.col("t_gram")) & (F.col("size") >= F.col("t_size") * least))
    hit = F.struct("at", "gram").alias("hit")
    # a row's own hits: bounded by its text
    found = met.groupBy("row", "licence", "template", "width", "t_size").agg(F.collect_list(hit).alias("hits"))
    likely = found.filter(F.size(F.array_distinct(F.transform("hits", lambda h: h["gram"]))) >= F.col("t_size") * least)
    sorted_hits = likely.select("row", "licence", "width", "t_size", F.array_sort("hits").alias("hits"))
    scored = sorted_hits.select("row", "licence", _windows("hits", F.col("width"), F.col("t_size")).alias("dice")).filter(F.col("dice") >= dice)
    by_licence = scored.groupBy("row", "licence").agg(F.max("dice").alias("dice"))
    top = by_licence.groupBy("row").agg(F.count(F.lit(1)).alias("n_matches"), F.min(F.struct((-F.col("dice")).alias("least"), "licence")).alias("best"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"))
    return rows.join(top, "row", "left").select(F.col("id").alias(id_col), F.col("best.licence").alias("licence"), (-F.col("best.least")).alias("dice"), F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best licence of every document."""
    return scanned(table(spark, sf_dir, "documents"), spark.createDataFrame(TEMPLATES, "licence string, notice string"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SQL = {
    "op8_licence_scan": """
WITH t(template, licence, notice) AS (VALUES %s),
tw AS (
  SELECT template, licence, string_split(trim(regexp_replace(lower(notice), '[^a-z0-9ß-öø-ÿ]+', ' ', 'g')), ' ') AS ws FROM t),
tl AS (
  SELECT template, licence, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) AS g FROM tw),
tg AS (
  SELECT template, licence, len(g) AS width, len(list_distinct(g)) AS b, unnest(list_distinct(g)) AS gram FROM tl),
w AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9ß-öø-ÿ]+', ' ', 'g')), ' ') AS ws FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(ws))) AS pos, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS gram FROM w),
h AS (
  SELECT g.doc_id, g.pos, g.gram, tg.template, tg.licence, tg.width, tg.b FROM g JOIN tg ON tg.gram = g.gram),
c AS (
  SELECT doc_id, template FROM h GROUP BY doc_id, template, b HAVING count(DISTINCT gram) >= b * (0.8::DOUBLE / 1.2::DOUBLE)),
v AS (
  SELECT x.doc_id, x.licence, 2.0::DOUBLE * count(DISTINCT y.gram) / (max(y.pos) - x.pos + 1 - count(*) + count(DISTINCT y.gram) + x.b) AS dice
  FROM h x JOIN c ON c.doc_id = x.doc_id AND c.template = x.template
  JOIN h y ON y.doc_id = x.doc_id AND y.template = x.template AND y.pos >= x.pos AND y.pos < x.pos + x.width
  GROUP BY x.doc_id, x.template, x.licence, x.pos, x.b),
m AS (
  SELECT doc_id, licence, max(dice) AS dice FROM v WHERE dice >= 0.8 GROUP BY doc_id, licence),
k AS (
  SELECT doc_id, licence, dice, count(*) OVER (PARTITION BY doc_id) AS n,
    row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, licence) AS k FROM m)
SELECT d.doc_id, k.licence, k.dice, coalesce(k.n, 0) AS n_matches
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id AND k.k = 1
"""
    % ", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(TEMPLATES))
}
