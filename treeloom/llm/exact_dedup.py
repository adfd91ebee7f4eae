"""Exact deduplication by skew-safe combining, DataFrame operations only.

Texts are equal when identical after lower-casing A-Z. Three levels of combining, each of which has
the whole normalised text in its grouping key, so two texts that share a digest are never merged:

1. local: Spark's partial aggregation merges copies inside each map task before anything moves;
2. salted: digest groups are merged per (digest, salt), so a third of all rows with one text
   is spread over ``salts`` reducers;
3. global: at most ``salts`` winners per text meet and give the row that stays.

Every row then finds its winner by (digest, salt): again no reducer gets more than its salt's share.
Text moves only in the first two levels. If two different texts ever share a digest, the rows of
that digest also compare their texts in the final lookup.

Null text counts as empty; an empty table gives an empty result; repeated rows (same id and text)
are all returned, and all marked kept if their id is the largest; a null id is smaller than any other; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, row_mark, settle

SALTS = 32


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text)."""
    rows = docs.select(
        "doc_id",
        ascii_lower(F.col("text")).alias("norm"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    ).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("salt_keep"), F.count("*").alias("n"))
    winners = salted.groupBy("digest", "norm").agg(
        F.max("salt_keep").alias("keep_id"),
        F.sum("n").alias("group_size"),
        F.collect_set("salt").alias("in_salts"),  # at most `salts` values
    )
    # One text per digest, as good as always: the digest then stands for the compared text.
    by_digest = winners.groupBy("digest").agg(
        F.count("*").alias("texts"),
        F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
        F.flatten(F.collect_list("in_salts")).alias("in_salts"),
        # the texts themselves are carried only where a digest has several
        F.when(F.count("*") > 1, F.lit(True)).otherwise(F.lit(False)).alias("clash"),
    )
    found = settle(by_digest)
    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    lookup = found.filter(~F.col("clash")).select("digest", "keep_id", "group_size", F.explode(F.array_distinct("in_salts")).alias("salt"))
    plain = rows.select("doc_id", "digest", "salt").join(lookup, ["digest", "salt"]).select(*out)
    if not found.filter("clash").head(1):
        return plain
    clashing = found.filter("clash").select("digest")
    few = rows.join(clashing, "digest", "left_semi")
    exact = few.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return plain.unionByName(few.join(exact, ["digest", "norm"]).select(*out))


def drop_exact_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """docs with one row of each group of equal texts, that of the largest doc_id; all columns stay.

    A row is known by its whole content, so rows without an id or that share one are rows of their own: every text
    keeps exactly one row, that without an id only if no equal text has one. Of rows with the largest id of their
    text the one with the largest hash stays. Rows that are equal in all columns are first merged in map tasks;
    whole rows move once, by their hash, and so are dealt evenly whatever the groups.
    """
    names = docs.columns
    marked = docs.withColumn("__mark", row_mark(docs)).select("__mark", F.struct(*names).alias("__row"))
    narrow = marked.select("__mark", F.col("__row.doc_id").alias("doc_id"), ascii_lower(F.col("__row.text")).alias("norm"))
    narrow = narrow.withColumns({"salt": F.pmod(F.col("__mark.a"), F.lit(salts)).cast("int"), "digest": F.unhex(F.sha2("norm", 256))})
    best = F.max(F.struct("doc_id", "__mark"))
    local = narrow.groupBy("digest", "salt", "norm").agg(best.alias("best"))
    stays = local.groupBy("digest", "norm").agg(F.max("best").alias("best")).select(F.col("best.__mark").alias("__mark")).distinct()
    rows = marked.groupBy("__mark").agg(F.first("__row").alias("__row"))
    return rows.join(settle(stays), "__mark", "left_semi").select("__row.*")
