"""Line dedup: lines that several documents share stay in the first of them only.

Lines are exploded with their positions and hashed (128 bits of the normalised line), and
dealt once by hash and salt: the salt comes from the document, so that a line of a third of
all documents lies in SALTS tasks. Distinct documents are counted by hash and salt where the
lines lie, and added up by hash; what is over the threshold goes back to the hash's salts,
where the same dealt lines meet it. Positions to drop are gathered by document (bounded by
its own lines) and the rest is put together again by position. Only DataFrame functions are used.

Defined results: a null or empty text is one empty line; a text may be of any length. Rows
with a null id hold no claim on a line and keep theirs. Rows of the same id are one document
for counting; each row is rewritten by itself. Repeated rows give repeated results. The line
stays in the smallest id (ids are unique, so there are no ties). Other columns, whatever their
names, pass through `dedup_lines`. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import WHITE, ascii_lower

#: Tasks that the documents of one line are spread over; a power of two.
SALTS = 64


def line_key(line: Column) -> Column:
    """A line's key: stripped of ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(WHITE)))


def dropped_lines(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """id, mark and drop (positions) of rows (id, mark, text) that lose lines."""
    lines = rows.where("id IS NOT NULL AND text IS NOT NULL").select("id", "mark", F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("id", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    # no null can come of it, so the join below adds no filter that would make its side another plan
    salt = F.xxhash64("id").bitwiseAND(F.lit(SALTS - 1))
    keys = keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), salt.alias("salt"), "id", "mark", "pos")
    dealt = keys.repartition("h1", "h2", "salt")
    # every column is named, so that Catalyst prunes none below the exchange and can use it for the join as well
    by_doc = dealt.groupBy("h1", "h2", "salt", "id").agg(F.min(F.col("mark").bitwiseXOR(F.col("pos").cast("long"))).alias("held"))
    by_salt = by_doc.groupBy("h1", "h2", "salt").agg(F.count("held").alias("docs"), F.min("id").alias("first"))
    by_key = by_salt.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.min("first").alias("first"), F.collect_list("salt").alias("salts")).where(F.col("docs") >= min_docs)
    shared = by_key.select("h1", "h2", "first", F.explode_outer("salts").alias("salt"))
    gone = dealt.join(shared, ["h1", "h2", "salt"]).where("id > first")
    return gone.groupBy("id", "mark").agg(F.collect_set("pos").alias("drop"))


def annotate_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """row (a struct of all columns of docs), lines (as they were) and drop (positions to drop, or null)."""
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])  # no name of docs can clash
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("mark"), docs[text_col].alias("text"))
    drop = dropped_lines(rows, min_chars, min_docs).select(F.col("id").alias("drop_id"), F.col("mark").alias("drop_mark"), "drop")
    held = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("mark"), row.alias("row"))
    met = held.join(drop, (F.col("id") == F.col("drop_id")) & (F.col("mark") == F.col("drop_mark")), "left")
    # whole texts are dealt by id as they are, and split behind the join
    lines = F.split(F.coalesce(F.col(f"row.c{docs.columns.index(text_col)}"), F.lit("")), "\n", -1)
    return met.select("row", lines.alias("lines"), "drop")


def kept_text() -> Column:
    """The lines that stay, joined by a newline; linear in the lines."""
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    rest = F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")
    return F.when(F.col("drop").isNull(), F.array_join("lines", "\n")).otherwise(rest)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs, in the same columns, without the lines that an earlier document holds; null texts stay null."""
    out = annotate_lines(docs, id_col, text_col, min_chars, min_docs)
    text = F.when(F.col(f"row.c{docs.columns.index(text_col)}").isNotNull(), kept_text())
    return out.select(*[(text if c == text_col else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def line_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """For each row its id, n_lines (before), n_dropped and the text that is left."""
    out = annotate_lines(docs.select(id_col, text_col), id_col, text_col, min_chars, min_docs)
    return out.select(F.col("row.c0").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), kept_text().alias("kept_text"))
