"""Anchors: the tokens of a segment that compression must keep."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import patterns as P
from lumenfold.functions.text import anchor_tokens, is_stopword_or_short, is_tier_one, typed_entities
from lumenfold.operators.ordered import join_same, keyed_fold, kinds_of, stage

#: Below so many segments only structural tokens are anchors, and so many anchors a segment has at most.
LEAST_SEGMENTS, MOST = 20, 10
#: Segments in a block, about: what a task folds, with its tokens.
BLOCK = 16_384


def anchors(segments: DataFrame, session: str = "session_id", seq: str = "seq", text: str = "text", most: int = MOST) -> DataFrame:
    """(session, seq, anchors): structural tokens in order, then the session's rare ones, rarest first.

    Rare is an idf of at least the median of the session's tokens. Counts are those of the whole
    session; `running_anchors` takes those up to each segment.
    """
    rows = segments.select(F.col(session).alias("session"), F.col(seq).alias("seq"), F.col(text).alias("text"))
    first = F.array_distinct(F.filter(anchor_tokens(F.col("text"), lower=False), is_tier_one))
    tokens = rows.select("session", "seq", F.explode(F.array_distinct(anchor_tokens(F.col("text")))).alias("tok")).where(~is_stopword_or_short(F.col("tok")) & ~is_tier_one(F.col("tok")))
    size = rows.groupBy("session").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEGMENTS)
    idf = tokens.groupBy("session", "tok").agg(F.count("*").alias("df")).join(size, "session").withColumn("idf", F.log(1 + F.col("n") / (1.0 + F.col("df"))))
    middle = idf.groupBy("session").agg(F.median("idf").alias("middle"))
    rare = idf.join(middle, "session").where(F.col("idf") >= F.col("middle")).select("session", "tok", "idf")
    second = tokens.join(rare, ["session", "tok"]).groupBy("session", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("order"), "tok"))), lambda x: x["tok"]).alias("second"))
    both = rows.withColumn("first", first).join(second, ["session", "seq"], "left")
    return both.select("session", "seq", F.slice(F.concat("first", F.coalesce("second", F.array().cast("array<string>"))), 1, most).alias("anchors"))


class Middle:
    """The median of document frequencies while they grow: counts by frequency, and a pointer that moves as they do."""

    def __init__(self) -> None:
        self.counts = np.zeros(64, np.int64)
        self.at, self.below, self.total = 1, 0, 0

    def _reach(self, level: int) -> None:
        if level >= len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(level + 1, np.int64)])

    def put(self, level: int, number: int) -> None:
        """So many more tokens that are in `level` segments already."""
        self._reach(level)
        self.counts[level] += number
        self.total += number
        self.below += number * (level < self.at)

    def grow(self, to: int | list[int]) -> None:
        """A token now is in `to` segments, one more than before; or several tokens are, each in its number."""
        to = np.array(to, np.int64, ndmin=1)
        if not len(to):
            return
        self._reach(int(to.max()))
        np.add.at(self.counts, to, 1)
        np.subtract.at(self.counts, to - 1, 1)
        self.counts[0] = 0
        new = np.count_nonzero(to == 1)
        self.total += new
        if self.at > 1:
            self.below += new - np.count_nonzero(to == self.at)

    def middle(self) -> tuple[int, int] | None:
        """The frequencies in the middle, the same one twice for an odd number of tokens."""
        if not self.total:
            return None
        low, high = (self.total + 1) // 2, self.total // 2 + 1
        while self.below >= low:
            self.at -= 1
            self.below -= int(self.counts[self.at])
        while self.below + self.counts[self.at] < low:
            self.below += int(self.counts[self.at])
            self.at += 1
        up = self.at
        if self.below + self.counts[up] < high:
            up += 1
            while not self.counts[up]:
                up += 1
        return self.at, up


#: Bytes outside anchor tokens, which are of ASCII alone, as spaces.
_BREAKS = bytes(b if b < 128 and re.fullmatch(P.ANCHOR_TOKEN, chr(b)) else 32 for b in range(256))
_TIER_ONE = re.compile("|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else p for p in P.TIER_ONE).replace(r"\p{L}\p{N}", "a-zA-Z0-9")).match
_STOPWORDS = frozenset(P.STOPWORDS)
#: The characters beyond ASCII whose lower case holds letters of ASCII.
_LOWER = {0x130: "i\u0307", 0x212A: "k"}


class Judged(dict):
    """Tokens with whether they are structural, and their lower case if that may be rare; so many are remembered."""

    def __missing__(self, token: str) -> tuple[bool, str | None]:
        if len(self) >= 1 << 18:
            self.clear()
        # no structural token is of small letters alone
        tier = lambda t: not (t.isalpha() and t.islower()) and _TIER_ONE(t) is not None
        low = token.lower()
        self[token] = found = tier(token), None if len(low) < 4 or low in _STOPWORDS or tier(low) else low
        return found


def _tokens(text: bytes) -> dict[str, None]:
    return dict.fromkeys(text.translate(_BREAKS).decode("ascii").split(" "))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the column text turned into its distinct structural tokens and, joined by spaces, its distinct other tokens in lower case."""
    judged = Judged()
    for batch in batches:
        structural, held = [], []
        for text in batch["text"].cast(pa.binary()).to_pylist():
            text = text or b""
            own = _tokens(text)
            found = [judged[t] for t in own]
            structural.append([t for t, (first, _) in zip(own, found, strict=True) if first])
            if any(chr(c).encode() in text for c in _LOWER):
                found = [judged[t] for t in _tokens(text.decode().translate(_LOWER).encode())]
            held.append(" ".join(dict.fromkeys(low for _, low in found if low)))
        rest = batch.drop_columns(["text"])
        yield rest.append_column("structural", pa.array(structural, pa.list_(pa.string()))).append_column("held", pa.array(held, pa.string()))


def _standing(blocks: DataFrame, counted: DataFrame) -> DataFrame:
    """(session, block, level, number): how many tokens are in `level` of the session's segments before the block begins.

    A token passes from level to level as blocks pass: sums of these steps hold from the block after them to the next step.
    """
    step = lambda level, by: F.struct(F.col(level).alias("level"), F.lit(by).alias("by"))
    steps = counted.select("session", "block", F.explode(F.array(step("after", 1), step("before", -1))).alias("s")).where("s.level > 0").groupBy("session", "block", "s.level").agg(F.sum("s.by").alias("by"))
    along = Window.partitionBy("session", "level").orderBy("block")
    held = steps.select("session", "level", F.sum("by").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("number"), (F.col("block") + 1).alias("start"), F.lead("block").over(along).alias("end"))
    held = join_same(held.where("number > 0"), blocks.groupBy("session").agg(F.max("block").alias("last")), ["session"])
    held = held.withColumn("end", F.coalesce("end", "last")).where("start <= end")
    return held.select("session", F.explode(F.sequence("start", "end")).alias("block"), "level", "number")


def running_anchors(segments: DataFrame, session: str = "session_id", seq: str = "seq", text: str = "text", most: int = MOST, least: int = LEAST_SEGMENTS) -> DataFrame:
    """(session, seq, n, median_idf, anchors): the anchors of each segment as its session stands then, its own tokens counted.

    First come typed entities and structural tokens. From the session's `least`-th segment on, tokens follow whose idf
    is at least the median of all the session's tokens so far, the rarest first (of equals the smaller); a
    new session begins anew. Repeated (session, seq) are not allowed; segments without one of them come last, are counted, and have no median and no anchors.

    Sessions are cut into blocks by ranges of order. Tokens are counted by block, and sums of the blocks before tell how a
    session stands where a block begins: the frequencies of the tokens the block has, and of all others one count
    for each frequency, from which the exact median follows. So blocks are folded apart, however long a session is.
    """
    rows = segments.select(F.col(session).alias("session"), F.col(seq).alias("seq"), F.col(text).alias("text"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / BLOCK))
    order = F.asc_nulls_last("seq")
    entities = F.coalesce(F.transform(typed_entities(F.col("text")), lambda e: e["text"]), F.array().cast("array<string>"))
    dealt = rows.repartitionByRange(parts, "session", order).select("session", "seq", F.spark_partition_id().alias("block"), entities.alias("entities"), "text")
    kinds = f"{kinds_of(rows, 'session', 'seq')}, block int"
    made = stage(dealt.mapInArrow(_split, f"{kinds}, entities array<string>, structural array<string>, held string"), "segments")
    # the blocks of each session, with the number of its segments before
    before = Window.partitionBy("session").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stage(made.groupBy("session", "block").agg(F.count("*").alias("number")).withColumn("past", F.sum("number").over(before)), "blocks")
    tokens = made.where("held <> ''").select("session", "block", F.explode(F.split("held", " ")).alias("tok")).groupBy("session", "block", "tok").agg(F.count("*").alias("number"))
    sums = F.sum("number").over(Window.partitionBy("tok", "session").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = stage(tokens.withColumn("after", sums).select("session", "block", "tok", (F.col("after") - F.col("number")).alias("before"), "after"), "frequencies")

    # in each block its session's number of segments, its frequencies, the tokens met before, then its own segments in order
    number, nothing = F.col("number").cast("long"), F.lit(None).cast("array<string>").alias("first")
    row = lambda df, kind, *columns: df.select("session", "block", F.lit(kind).alias("kind"), *columns)
    no_seq = F.lit(None).cast(rows.schema["seq"].dataType).alias("seq")
    states = [
        row(blocks.where("past > 0"), 0, no_seq, F.lit("").alias("tok"), F.lit(0).cast("long").alias("level"), F.col("past").alias("number"), nothing),
        row(_standing(blocks, counted), 1, no_seq, F.lit("").alias("tok"), F.col("level").cast("long"), number, nothing),
        row(counted.where("before > 0"), 2, no_seq, "tok", F.col("before").alias("level"), F.lit(0).cast("long").alias("number"), nothing),
        row(made, 3, "seq", F.col("held").alias("tok"), F.lit(0).cast("long").alias("level"), F.lit(0).cast("long").alias("number"), F.array_distinct(F.concat("entities", "structural")).alias("first")),
    ]

    def start():
        middle, seen, passed = Middle(), {}, [0]

        def step(row: dict) -> list[tuple]:
            kind, tok = row["kind"], row["tok"]
            if kind == 0:
                passed[0] = row["number"]
            elif kind == 1:
                middle.put(row["level"], row["number"])
            elif kind == 2:
                seen[tok] = row["level"]
            if kind < 3:
                return []
            passed[0] += 1
            n, held, levels = passed[0], tok.split(" ") if tok else [], []
            for t in held:
                seen[t] = df = seen.get(t, 0) + 1
                levels.append(df)
            middle.grow(levels)
            if row["session"] is None or row["seq"] is None:
                return [(row["session"], row["seq"], n, None, [], [])]
            low, high = middle.middle() or (0, 0)
            idf = lambda df: math.log(1 + n / (1 + df))
            # a frequency of at most the lower middle is an idf of at least the median: whole numbers, so equals are equal
            rare = sorted((df, t) for df, t in zip(levels, held, strict=True) if df <= low) if n >= least else []
            return [(row["session"], row["seq"], n, (idf(low) + idf(high)) / 2 if low else None, row["first"], [t for _, t in rare])]

        return step

    told = f"{kinds_of(rows, 'session', 'seq')}, n long, median_idf double, first array<string>, second array<string>"
    out = keyed_fold(reduce(DataFrame.unionByName, states), ["block", "session"], ["kind", order], start, told, parts)
    return out.select("session", "seq", "n", "median_idf", F.slice(F.array_distinct(F.concat("first", "second")), 1, most).alias("anchors"))


def token_roles(text: Column, held: Column) -> Column:
    """Each token with its role: anchor, stopword or compressible."""
    tokens = F.split(F.trim(text), r"\s+")
    bare = lambda t: F.regexp_replace(F.lower(t), r"^[^a-z0-9_/.\-]+|[^a-z0-9_/\-]+$", "")
    low = F.transform(held, F.lower)
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.when(F.array_contains(low, bare(t)), "anchor").when(is_stopword_or_short(bare(t)), "stopword").otherwise("compressible").alias("role")))
