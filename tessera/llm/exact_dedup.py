"""Exact deduplication in DataFrame operations, safe for groups of copies of any size.

1. Copies in one map task meet in the partial aggregate (local deduplication).
2. Local winners meet by (digest, salt, content): the salt, from the row's id, deals a hot digest over ``salts`` groups.
3. Salt winners, at most ``salts`` a text, meet by (digest, content).
The whole normalised text is a grouping key at each stage, so equal digests alone never join two texts. Rows then learn
their group by (digest, salt), which is exact as long as stage 3 found one content for each digest; were there a digest
with two contents, rows of such digests are matched by content as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_name, materialize

SALTS = 32
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def exact_dedup(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty, and empty texts are equal to each other. The smallest id of a group stays; null ids are
    larger than all others (a group of null ids alone keeps them all, with a null ``keep_id``). Rows that repeat id and
    text can't be told apart and share one verdict; they count in ``group_size``. Texts of any length are compared whole.
    Other columns are ignored. An empty table gives no rows. ``digest`` is a parameter for tests of colliding digests."""
    id_ = F.col("doc_id").cast("long")
    rows = docs.select(id_.alias("doc_id"), normalised(F.col("text")).alias("content"))
    rows = rows.select("doc_id", "content", digest(F.col("content")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    salted = rows.groupBy("digest", "salt", "content").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    groups = salted.groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))
    light = materialize(groups.drop("content"), "dedup-groups")
    collided = light.groupBy("digest").agg(F.count("*").alias("contents")).where("contents > 1").select("digest")
    verdict = [F.col("doc_id"), F.col("keep_id"), F.col("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("text_sha256")]
    by_salt = light.select("digest", F.explode("salts").alias("salt"), "keep_id", "group_size")
    own = F.lower(F.hex("digest")) if digest is sha256 else F.sha2(F.col("content").cast("binary"), 256)
    if collided.isEmpty():
        return rows.withColumn("text_sha256", own).drop("content").join(by_salt, ["digest", "salt"]).select(*verdict)
    plain = rows.join(collided, "digest", "left_anti").withColumn("text_sha256", own).drop("content").join(by_salt, ["digest", "salt"])
    odd = rows.join(collided, "digest", "left_semi").withColumn("text_sha256", own).join(groups.join(collided, "digest", "left_semi").drop("salts"), ["digest", "content"])
    return plain.select(*verdict).unionByName(odd.select(*verdict))


def drop_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Rows of ``docs`` that stay, with their columns, whatever other columns are called. Null and empty texts are equal to
    each other; a row stays if its id is the smallest of a group of equal texts, so rows that repeat id and text stay
    together, and a row whose id stays for another text of that id stays too; of groups without any id all stay. Texts of
    any length are compared whole; an empty table gives no rows."""
    name = free_name(docs, "__kept_id")
    kept = exact_dedup(docs, salts).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col(name)), "left_semi")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents),
g AS (SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY content)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.content) AS text_sha256
FROM n JOIN g USING (content)
"""
