"""Line dedup: lines that many documents share stay in one document only.

Native throughout. Texts are never shuffled for counting: the lines long enough to count travel as a 96-bit hash and a
document id. Copies of a line meet only after each task has summed its own, so a line held by a third of all documents
is one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aquila.llm.tables import load, written
from aquila.llm.text import SQL_WHITE, UPPER, WHITE, ascii_lower


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.hash(key).alias("h2")]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, text (the lines that stay), n_lines, n_dropped, and the columns ``keep``.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least ``min_chars`` code points
    found in at least ``min_docs`` distinct ids lose their lines everywhere but in the largest id.
    Null and empty texts are one empty line. A null id counts as no document: its rows come back, and lose the lines
    that are dropped elsewhere. Rows that repeat an id count as one document, and each is cut on its own. An empty
    table gives an empty table. Other columns of ``docs``, whatever their names, are ignored unless in ``keep``.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*[F.col(c) for c in keep], F.lit(0).alias("_")).alias("kept_cols"))
    long_lines = lambda exploded: exploded.withColumn("key", F.btrim("line", F.lit(WHITE))).where(F.char_length("key") >= min_chars)
    counted = long_lines(base.where("doc_id is not null").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")))
    flooded = (
        counted.select("doc_id", *_hashes(ascii_lower(F.col("key")))).distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        .where(F.col("n") >= min_docs).select("h1", "h2", "last")
    )
    flooded = written(flooded, "flooded-lines")
    placed = long_lines(base.select("doc_id", F.xxhash64("text").alias("row_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")))
    marks = (
        placed.select("doc_id", "row_hash", "pos", *_hashes(ascii_lower(F.col("key"))))
        .join(flooded, ["h1", "h2"])
        .where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last")))
        .groupBy("doc_id", "row_hash").agg(F.collect_set("pos").alias("drop"))
        .select(F.col("doc_id").alias("m_id"), F.col("row_hash").alias("m_hash"), "drop")
    )
    whole = base.withColumn("row_hash", F.xxhash64("text"))
    joined = whole.join(marks, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("row_hash") == F.col("m_hash")), "left")
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return joined.withColumn("lines", lines).select(
        "doc_id", kept.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), *[F.col(f"kept_cols.`{c}`") for c in keep]
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(load(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {SQL_WHITE}), '{UPPER}', '{UPPER.lower()}') AS k FROM l),
f AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.k IS NOT NULL AND (doc_id IS NULL OR doc_id < last) AS gone FROM k LEFT JOIN f ON k.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
