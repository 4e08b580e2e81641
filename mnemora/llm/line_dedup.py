"""Removal of lines that many documents share, in DataFrame functions only.

Lines are exploded with their position, normalised to a key and hashed; distinct documents are counted per
hash, and what the shared hashes take from each text is put together by position again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import lower_ascii, saved

# A key counts from this many code points, and as shared from this many documents.
LEAST_LENGTH, LEAST_DOCUMENTS = 20, 3
BLANKS = " \t\n\x0b\x0c\r"
KEY, ROW = ["k1", "k2"], ["id", "t1", "t2"]


def _hashes(value: Column) -> tuple[Column, Column]:
    """128 bits: two hashes of different seeds."""
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def normalised(line: Column) -> Column:
    """The key of a line: without blanks at both ends, A-Z lower-cased."""
    bare = F.trim(line, F.lit(BLANKS))
    # The plain function does the same for ASCII and is several times as fast.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(lower_ascii(bare))


def _rows(docs: DataFrame) -> DataFrame:
    """id, text and the hashes of the text; equal rows have equal names."""
    text = F.coalesce("text", F.lit(""))
    t1, t2 = _hashes(F.col("text"))
    return docs.select(F.col("doc_id").alias("id"), text.alias("text")).withColumns({"t1": t1, "t2": t2})


def keyed_lines(rows: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """id, t1, t2, at, k1, k2 of every line whose key is long enough; ``at`` is the line's place from 0."""
    lines = rows.select(*ROW, F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    keys = lines.select(*ROW, "at", normalised(F.col("line")).alias("key")).where(F.length("key") >= least_length)
    k1, k2 = _hashes(F.col("key"))
    return keys.select(*ROW, "at", k1.alias("k1"), k2.alias("k2"))


def shared_keys(lines: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """k1, k2, keeper: keys that enough documents hold, and the largest id among these."""
    pairs = lines.select(*KEY, "id").distinct()
    held = pairs.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
    return held.where(F.col("n") >= least_documents).drop("n")


def without_shared_lines(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """doc_id, text (of the kept lines), n_lines, n_dropped: one row for each row of ``docs``.

    Documents are counted by distinct id. A null id is a document of its own that comes before all others, so it keeps
    no shared line. Rows of one id with different texts are cut each by its own positions, repeated rows
    alike. Null and empty texts are one empty line. Other columns are ignored, and so cannot clash. No documents
    give no rows.

    The first shuffle holds two hashes and an id for each line, the second the same lines against the
    shared keys, which Spark may split where one line is very frequent, the last the texts and the
    places that they lose. Only the places of one text come together, never the lines of one key.
    """
    rows = _rows(docs)
    lines = keyed_lines(rows, least_length)
    # Written out, so that the join deals both sides anew and can split a frequent key.
    shared = saved(shared_keys(lines, least_documents), "shared-lines")
    lost = lines.join(shared, KEY).where(~F.col("id").eqNullSafe(F.col("keeper")))
    places = saved(lost.groupBy(*ROW).agg(F.collect_set("at").alias("lost")), "lost-lines")

    here, there = rows.alias("r"), places.alias("p")
    same = F.col("r.id").eqNullSafe(F.col("p.id")) & (F.col("r.t1") == F.col("p.t1")) & (F.col("r.t2") == F.col("p.t2"))
    whole = here.join(there, same, "left").select("r.id", F.split("r.text", "\n", -1).alias("lines"), "p.lost")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.transform(stay, lambda at: F.get(F.col("lines"), at))
    return whole.select(
        F.col("id").alias("doc_id"),
        F.array_join(F.when(F.col("lost").isNull(), F.col("lines")).otherwise(kept), "\n").alias("text"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    kept = without_shared_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


LINE_SQL = r"""
    WITH lines AS (
        SELECT doc_id, i, ls[i] AS line, len(ls) AS n
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d, unnest(range(1, len(ls) + 1)) u(i)),
    keyed AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
        FROM lines),
    shared AS (
        SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
        GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM (SELECT keyed.*, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN shared USING (k))
    GROUP BY doc_id
"""
