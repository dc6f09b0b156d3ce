"""The session segmenter: headers, paragraphs, bullets, then short pieces merged and long ones cut.

Built-in functions split at headers, paragraphs and sentences; the greedy packing, which
depends on what came before, is a fold over a text's own pieces (aggregate()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import strip, token_count

SHORT, LONG, BULLETS = 5, 300, 20
_STRINGS = "array<string>"


def _empty() -> Column:
    return F.array().cast(_STRINGS)


def pack(pieces: Column, least: int) -> Column:
    """Neighbours joined until a group has `least` tokens; what is left at the end joins the last group."""
    start = F.struct(_empty().alias("done"), F.lit("").alias("open"))

    def step(acc: Column, piece: Column) -> Column:
        text = F.when(acc["open"] == "", piece).otherwise(F.concat_ws(" ", acc["open"], piece))
        full = token_count(text) >= least
        return F.struct(F.when(full, F.concat(acc["done"], F.array(text))).otherwise(acc["done"]).alias("done"), F.when(full, "").otherwise(text).alias("open"))

    def end(acc: Column) -> Column:
        n = F.size(acc["done"])
        glued = F.concat(F.slice(acc["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat_ws(" ", F.get(acc["done"], n - 1), acc["open"])))
        return F.when(acc["open"] == "", acc["done"]).when(n == 0, F.array(acc["open"])).otherwise(glued)

    return F.aggregate(pieces, start, step, end)


def merge_short(pieces: Column, least: int = SHORT) -> Column:
    """A piece under `least` tokens goes before the next one; the last stays as it is."""
    start = F.struct(_empty().alias("done"), F.lit("").alias("open"))

    def step(acc: Column, piece: Column) -> Column:
        text = F.when(acc["open"] == "", piece).otherwise(F.concat_ws(" ", acc["open"], piece))
        full = token_count(text) >= least
        return F.struct(F.when(full, F.concat(acc["done"], F.array(text))).otherwise(acc["done"]).alias("done"), F.when(full, "").otherwise(text).alias("open"))

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def cut_long(piece: Column, most: int = LONG) -> Column:
    """A piece over `most` tokens as groups of whole sentences within it; a longer sentence stays whole."""
    start = F.struct(_empty().alias("done"), F.lit("").alias("open"))

    def step(acc: Column, sentence: Column) -> Column:
        over = (acc["open"] != "") & (token_count(acc["open"]) + token_count(sentence) > most)
        return F.struct(F.when(over, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(over | (acc["open"] == ""), sentence).otherwise(F.concat_ws(" ", acc["open"], sentence)).alias("open"))

    packed = F.aggregate(F.split(piece, r"(?<=[.!?])\s+"), start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    return F.when(token_count(piece) <= most, F.array(piece)).otherwise(packed)


def paragraph(text: Column) -> Column:
    """A paragraph's prose and its bullet groups; without bullets the paragraph as it is."""
    rows = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    bullets = F.filter(rows, lambda x: x.rlike(r"^[-*]\s+"))
    prose = F.filter(rows, lambda x: ~x.rlike(r"^[-*]\s+"))
    lead = F.when(F.size(prose) > 0, F.array(F.array_join(prose, " "))).otherwise(_empty())
    return F.when(F.size(bullets) == 0, F.array(strip(text))).otherwise(F.concat(lead, pack(bullets, BULLETS)))


def segments(docs: DataFrame, id_col: str = "session_id", text_col: str = "text") -> DataFrame:
    """(id, pos, segment): the segments of each session's text, in order.

    The folds are applied to columns, never inside another lambda: there they lose their state.
    """
    blocks = F.flatten(F.transform(F.split(F.col(text_col), r"(?m)(?=^#{2,3}\s+\S)"), lambda b: F.filter(F.split(strip(b), r"\n{2,}"), lambda p: strip(p) != "")))
    raw = docs.select(F.col(id_col).alias("id"), F.posexplode(blocks).alias("at", "block")).select("id", "at", paragraph(F.col("block")).alias("pieces"))
    whole = raw.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "pieces"))), lambda x: x["pieces"])).alias("pieces"))
    merged = whole.select("id", F.posexplode(merge_short(F.col("pieces"))).alias("at", "piece"))
    cut = merged.select("id", "at", F.posexplode(cut_long(F.col("piece"))).alias("part", "segment")).where(strip(F.col("segment")) != "")
    order = Window.partitionBy("id").orderBy("at", "part")
    return cut.select("id", (F.row_number().over(order) - 1).alias("pos"), "segment")
