"""Line dedup in DataFrame functions: hash normalised lines, count documents by hash, drop, reassemble.

Lines travel between executors as two 64-bit hashes and a position, never as text; those are kept in
the shared folder, for they are needed twice: to count and to find the lines again. The count of
documents is Catalyst's two-step distinct aggregate, so a line that a third of all documents hold is
first dealt by (line, document) and reaches its final task as partial counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.llm._shared import BLANKS, LOWER, UPPER, checkpoint, text_of

#: Lines that one in so many rows holds are sent to every task; there can't be more of them than this.
MOST_OFTEN = 1000


def _lines(docs: DataFrame, text: str, carry: tuple[str, ...]) -> DataFrame:
    own = docs.select("doc_id", text_of(text).alias("text"), *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)))
    return own.withColumn("row_hash", F.xxhash64("text")).withColumn("lines", F.split("text", "\n", -1))


def _key(line):
    """The line without blanks at its ends, A-Z as a-z. lower() says the same of ASCII, many times faster."""
    own = F.trim(line, F.lit(BLANKS))
    return F.when(F.octet_length(own) == F.length(own), F.lower(own)).otherwise(F.translate(own, UPPER, LOWER))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (what is kept), n_lines, n_dropped and the columns in carry: one row for each row of docs.

    A line's key is the line without blanks at its ends, A-Z lower-cased. A key of min_chars code
    points or more that min_docs documents hold keeps its lines only in the largest doc_id with it.
    Defined cases: null or empty text is one empty line; rows that share a doc_id count as one
    document and are each cleaned; a null doc_id counts as no document, and such rows lose the lines
    that others keep; an empty table gives an empty one; other columns are not looked at.
    """
    split = _lines(docs, text, carry)
    carried = [f"carried_{i}" for i in range(len(carry))]
    found = checkpoint(
        split.select("doc_id", "row_hash", F.posexplode("lines").alias("pos", "line"))
        .withColumn("line", _key(F.col("line")))
        .filter(F.length("line") >= min_chars)
        .select("doc_id", "row_hash", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    )
    repeated = checkpoint(found.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs))
    often = F.col("n") * MOST_OFTEN >= found.count()  # true of MOST_OFTEN lines at most, for each line found is one of theirs
    tried = found.join(F.broadcast(repeated.filter(often).select("h1", "h2", "keeper")), ["h1", "h2"], "left")
    rest = tried.filter("keeper is null").drop("keeper").join(repeated.filter(~often).select("h1", "h2", "keeper"), ["h1", "h2"])
    gone = (
        tried.filter("keeper is not null")
        .unionByName(rest)
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("gone_id"), F.col("row_hash").alias("gone_hash"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    none = F.array().cast("array<int>")
    return (
        split.select("doc_id", "row_hash", "text", *carried)
        .join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("row_hash") == F.col("gone_hash")), "left")
        .select("doc_id", F.split("text", "\n", -1).alias("lines"), F.coalesce("gone", none).alias("gone"), "text", *carried)
        .select(
            "doc_id",
            F.when(F.size("gone") == 0, F.col("text"))
            .otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda p: F.get("lines", p)), "\n"))
            .alias("text"),
            F.size("lines").cast("long").alias("n_lines"),
            F.size("gone").cast("long").alias("n_dropped"),
            *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)),
        )
    )


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.doc_id, k.pos, k.line, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone
  FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
