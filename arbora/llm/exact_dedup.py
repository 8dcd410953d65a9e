"""Exact dedup: 128-bit content hash groups, one stays, bytes compared inside the groups.

Texts are equal when identical after deleting white space bytes. A narrow
table (row, id, length, digests) is written once; groups are partial
aggregates of it, so a group with a third of all rows costs one row a task.
The bytes of each member of a group with copies are then compared with those
of the row that stays; members that differ (a collision of the 128-bit hash)
are grouped again by their text itself. DataFrame functions only.

Defined cases: null counts as empty, and empty texts are copies of each
other; of equal texts the one with the most code points stays, then the
smallest id, then the row read first (repeated rows keep one); a null id
sorts last; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import fits_broadcast, settled, table, without, written

WHITE_SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """text without white space bytes (0x20, 0x09-0x0D); null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _lite(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("row", "id", F.length("text").alias("n"), normalised(F.col("text")).alias("norm"))
    return base.select("row", "id", "n", F.unhex(F.md5("norm")).alias("h"), F.sha2("norm", 256).alias("sha"), "norm")


def _rank() -> Column:
    """Orders the rows of a group: the greatest one stays."""
    return F.struct("n", (-F.col("id")).alias("neg_id"), (-F.col("row")).alias("neg_row"))


def _collisions(lite: DataFrame, groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (row, h, norm) whose bytes differ from those of their group's staying row."""
    multi = written(groups.filter("size > 1").select("h", "keep_row"), "copies")
    hashes = multi.select("h")
    members = texts.select("row", "h", "norm").join(F.broadcast(hashes) if fits_broadcast(hashes) else hashes, "h", "left_semi")
    stay = members.join(F.broadcast(multi) if fits_broadcast(multi) else multi, "h").filter("row = keep_row").select(F.col("h").alias("kept_h"), F.col("norm").alias("kept_norm"))
    # keys under another name and form: both sides get exchanges of their own, so that a hot group can be split
    return members.join(stay, F.reverse("h") == F.reverse("kept_h")).filter("norm <> kept_norm").select("row", "h", "norm")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: row, id, keep_id, group_size, kept, text_sha256."""
    source = _lite(settled(docs), id_col, text_col)
    lite = written(source.drop("norm"), "digests")
    one = F.lit(None).cast("string")
    groups = written(_grouped(lite.withColumn("apart", one)), "groups")
    apart = written(_collisions(lite, groups, source), "collisions")
    if apart.limit(1).count():
        lite = lite.join(apart.select("row", F.col("norm").alias("apart")), "row", "left")
        groups = _grouped(lite)
    else:
        lite = lite.withColumn("apart", one)
    # the groups are dealt anew for the join, as above
    key = lambda h: F.concat(F.reverse(h), F.coalesce(F.encode("apart", "utf-8"), F.lit(b"")))
    left = lite.select("row", "id", "sha", key("h").alias("key"))
    right = groups.select(key("h").alias("key"), "keep_id", "keep_row", "size")
    return left.join(right, "key").select("row", "id", "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def _grouped(lite: DataFrame) -> DataFrame:
    best = F.max(_rank()).alias("best")
    return lite.groupBy("h", "apart").agg(best, F.count(F.lit(1)).alias("size")).select("h", "apart", (-F.col("best.neg_id")).alias("keep_id"), (-F.col("best.neg_row")).alias("keep_row"), "size")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    docs = settled(docs)
    return without(docs, written(exact_groups(docs, id_col, text_col).filter("not kept").select("row"), "dropped"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents, white space aside."""
    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


SQL = {
    "op3_exact_dedup": """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER g AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER g = 1 AS kept,
  sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
}
