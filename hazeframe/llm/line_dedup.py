"""Line dedup; DataFrame functions only.

Every text is split at newlines and each line is normalised to its key: blanks stripped at both ends, A-Z lowered.
Keys of at least `min_chars` characters are hashed to 128 bits, written once without the text, and dealt by (hash, salt of the document), so that a line
that a third of all documents hold is counted in many tasks; counts of distinct documents and the largest doc_id of
each salt are summed over the salts, of which a key has at most as many as there are shuffle partitions. Keys of at
least `min_docs` documents lose their lines everywhere but in the largest doc_id. The places of lost lines go back to
their document, and the text is put together again from the stretches between them.

Edges: a null or empty text is one empty line. A null doc_id counts as no document: its lines never make a key common
and are dropped where the key is. Rows that repeat a doc_id are one document, so none of them counts twice and all of
them keep their lines where that doc_id is the largest. Repeated rows get equal results. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, staged

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def lowered(x: Column) -> Column:
    """A-Z in lower case and nothing else. Only where other than ASCII letters occur is the slower translate needed."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def line_keys(rows: DataFrame, min_chars: int) -> DataFrame:
    """id, hash, place, h1, h2: a row for each line whose key is long enough."""
    lines = rows.select("id", "hash", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    cores = lines.select("id", "hash", "place", F.btrim("line", F.lit(BLANKS)).alias("core")).where(F.char_length("core") >= min_chars)
    keys = cores.select("id", "hash", "place", lowered(F.col("core")).alias("key"))
    return keys.select("id", "hash", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def lost_lines(lines: DataFrame, min_docs: int, salts: int) -> DataFrame:
    """id, hash, places: the places of lines that go, in order."""
    salt = F.pmod(F.when(F.col("id").isNull(), F.xxhash64("hash")).otherwise(F.xxhash64("id")), F.lit(salts)).cast("int")
    key = ["h1", "h2", "salt"]
    dealt = lines.withColumn("salt", salt)
    held = dealt.groupBy(*key, "id").agg(F.lit(1).alias("one")).groupBy(*key).agg(F.count("id").alias("docs"), F.max("id").alias("newest"))
    over = Window.partitionBy("h1", "h2")
    common = held.select(*key, F.sum("docs").over(over).alias("docs"), F.max("newest").over(over).alias("newest")).where(F.col("docs") >= min_docs)
    gone = dealt.join(common, key).where(~F.col("id").eqNullSafe(F.col("newest")))
    return gone.groupBy("id", "hash").agg(F.sort_array(F.collect_set("place")).alias("places"))


def between(lines: Column, places: Column) -> Column:
    """lines without those at the given places (from 0, in order): the stretches between them, in one pass."""

    def cut(x: Column) -> Column:
        n, d = F.size(x["lines"]), x["places"]
        start = lambda i: F.when(i == 0, 0).otherwise(F.get(d, i - 1) + 1)
        end = lambda i: F.coalesce(F.get(d, i), n)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(d)), lambda i: F.slice(x["lines"], start(i) + 1, end(i) - start(i))))

    # the argument of a lambda is worked out once, an expression inside it for every element
    return F.element_at(F.transform(F.array(F.struct(lines.alias("lines"), places.alias("places"))), cut), 1)


def drop_common_lines(documents: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", output: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256; with output also kept_text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("id"), text.alias("text")).select("id", F.xxhash64("text").alias("hash"), "text")
    lost = lost_lines(staged(line_keys(rows, min_chars)), min_docs, partitions(documents.sparkSession))
    both = rows.alias("r").join(lost.alias("l"), F.col("r.id").eqNullSafe(F.col("l.id")) & (F.col("r.hash") == F.col("l.hash")), "left").select("r.id", "r.text", "l.places")
    kept = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(between(F.split("text", "\n"), F.col("places")), "\n"))
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    done = both.select(F.col("id").alias(id_col), (breaks + 1).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
    return done.select(id_col, "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), *(["kept_text"] if output else []))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS newest FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, place, line, newest IS NOT NULL AND newest <> doc_id AS gone FROM keyed LEFT JOIN common USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
