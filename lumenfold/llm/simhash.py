"""SimHash near-dedup with a Gray-order hierarchical index.

1. Every text gets a 64-bit fingerprint: the majority of the bits of its shingles' XXH64. Texts of one
   fingerprint are one class from here on, so copies cost no pair.
2. Two fingerprints that differ in at most `within` bits are equal in one of within + 1 blocks. Each is
   dealt within + 1 times, with another block rotated to the top; those with the same top meet in a
   bucket. Buckets of one are dropped by their counts. A bucket of more than BUCKET fingerprints is dealt again by
   blocks of the bits left, until the bits left bound it: no bucket is unbounded, none is cut.
3. A task gets its buckets sorted by Gray rank, so neighbours share most bits. An index is built upwards:
   a node holds the mask of the bits that all below it share, and their pattern; a child holds
   only what its parent has not. Fingerprints walk it from their bucket's root, adding the
   differences that each node shows, and leave a whole group when there are too many.
4. What a task finds becomes one link a fingerprint at most (to the root of its group there); the links' components,
   with the smallest id of each, are the result.

All of it is exact: no link is lost and none is made up.

Defined results: null, empty and white texts have no shingles and the fingerprint zero, which links like any
other; with fewer words than a shingle has, the whole sequence is one. Rows with a null id keep their
fingerprint, link nothing and have a null component. Rows that repeat an id count each by its own text.
A bit that exactly half the hashes set is 0. Texts are read in pieces, so their length has no bound
of its own. Other columns take no part, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import materialize
from lumenfold.llm.components import connected_components

BITS, WORDS, SEED, WITHIN = 64, 3, 42, 2
#: Fingerprints in a bucket before it is dealt again.
BUCKET = 1_024
#: Children of a node, rows of an index, fingerprints that walk it together, bytes of a text taken at a time.
FAN, INDEX, WALK, PIECE = 8, 1 << 15, 2_048, 1 << 20

_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; bytes.split() knows exactly the ASCII white space."""
    start = 0
    while start < len(raw):
        cut = _WHITE.search(raw, start + PIECE)
        end = cut.start() if cut else len(raw)
        yield raw[start:end].split()
        start = end


def fingerprint(raw: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text: bit i is set if over half of its shingles' hashes set it."""
    from xxhash import xxh64_intdigest

    counts, total, held = np.zeros(BITS, np.int64), 0, []
    for some in _words((raw or b"").lower()):  # of bytes: A-Z only
        some = held + some
        shingles = map(b" ".join, zip(*(some[i:] for i in range(words)), strict=False))
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64)
        if len(hashes):
            counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            total += len(hashes)
        held = some[-(words - 1) :] if words > 1 else []
    if not total:
        return xxh64_intdigest(b" ".join(held), seed) if held else 0
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and print (64 bits as long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text")).mapInArrow(run, "doc_id long, print long")


class GrayIndex:
    """Hierarchical indexes over buckets of fingerprints that lie one after the other, each in Gray order.

    Level 0 are the fingerprints, above them nodes of up to FAN children, up to one root a bucket.
    `mask` has the bits that a node shares and its parent has not, `pattern` their values.
    """

    def __init__(self, prints: np.ndarray, buckets: np.ndarray) -> None:
        self.prints, self.buckets = prints, buckets
        starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        first, owner = np.arange(len(prints)), np.cumsum(np.isin(np.arange(len(prints)), starts)) - 1
        both, some = [prints], [prints]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        self.last = [first]
        while len(owner) > len(starts):
            own_start = np.searchsorted(owner, np.arange(len(starts)))
            heads = np.flatnonzero((np.arange(len(owner)) - own_start[owner]) % FAN == 0)
            both.append(np.bitwise_and.reduceat(both[-1], heads))
            some.append(np.bitwise_or.reduceat(some[-1], heads))
            ends = np.r_[heads[1:], len(owner)]
            self.children.append((heads, ends - heads))
            self.last.append(self.last[-1][ends - 1])
            owner = owner[heads]
        self.root = owner[np.cumsum(np.isin(np.arange(len(prints)), starts)) - 1] if len(prints) else owner
        shared = [~(a ^ b) for a, b in zip(both, some, strict=True)]
        above = [np.repeat(shared[n + 1], counts) for n, (_, counts) in enumerate(self.children)] + [np.zeros_like(shared[-1])]
        self.mask = [m & ~up for m, up in zip(shared, above, strict=True)]
        self.pattern = both

    def pairs(self, walk: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) of all pairs within so many bits, i in walk and j behind it in its bucket."""
        level = len(self.children)
        who, node = walk, self.root[walk]
        differences = np.bitwise_count((self.prints[who] ^ self.pattern[level][node]) & self.mask[level][node]).astype(np.int64)
        while level:
            heads, counts = self.children[level - 1]
            many = counts[node]
            at = np.repeat(heads[node] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            who, differences, level = np.repeat(who, many), np.repeat(differences, many), level - 1
            differences = differences + np.bitwise_count((self.prints[who] ^ self.pattern[level][at]) & self.mask[level][at])
            keep = (differences <= within) & (self.last[level][at] > who)
            who, node, differences = who[keep], at[keep], differences[keep]
        return who, node


def groups(index: GrayIndex, within: int) -> np.ndarray:
    """For each fingerprint the first one that links connect it to."""
    root = np.arange(len(index.prints))
    for start in range(0, len(root), WALK):
        one, two = index.pairs(np.arange(start, min(start + WALK, len(root))), within)
        while len(one):
            a, b = root[one], root[two]
            apart = a != b
            one, two, a, b = one[apart], two[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def _dealt(rows: DataFrame, within: int) -> DataFrame:
    """The rows (print, way, free, turned) once for each block of their free low bits, that block turned to the top of these; bucket: the bits above what is then free."""
    ways = within + 1
    each = rows.withColumn("block", F.explode(F.array(*[F.lit(j) for j in range(ways)])))
    cut = each.withColumns({"cut": F.expr(f"int(free * block div {ways})"), "width": F.expr(f"int(free * (block + 1) div {ways}) - int(free * block div {ways})"), "low": F.expr("shiftrightunsigned(-1L, 64 - free)")})
    turned = cut.withColumn("turned", F.expr("(turned & ~low) | ((shiftleft(turned & low, cut) | shiftrightunsigned(turned & low, free - cut)) & low)"))
    left = turned.select("print", (F.col("way") * ways + F.col("block") + 1).alias("way"), (F.col("free") - F.col("width")).alias("free"), "turned")
    return left.withColumn("bucket", F.expr("shiftrightunsigned(turned, free)"))


def _gray_rank(c: str) -> str:
    """SQL: the place of a long in Gray order, as bits."""
    for shift in (1, 2, 4, 8, 16, 32):
        c = f"({c} ^ shiftrightunsigned({c}, {shift}))" if shift == 1 else f"transform(array({c}), x -> x ^ shiftrightunsigned(x, {shift}))[0]"
    return c


def hamming_links(prints: DataFrame, within: int = WITHIN, bucket: int = BUCKET) -> DataFrame:
    """(a, b) of links that connect the distinct fingerprints of `prints` (print) just as all pairs within so many bits do."""
    rows, found = prints.select("print", F.lit(0).cast("long").alias("way"), F.lit(BITS).alias("free"), F.col("print").alias("turned")), None
    while True:
        dealt = _dealt(rows, within)
        counts = materialize(dealt.groupBy("way", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
        met = materialize(dealt.join(counts, ["way", "bucket"]), "simhash-dealt")
        bounded = (F.col("n") <= bucket) | (F.col("free") <= within)
        links = _indexed(met.where(bounded), within)
        found = links if found is None else found.unionByName(links)
        rows = met.where(~bounded).select("print", "way", "free", "turned")
        if rows.isEmpty():
            return found


def _indexed(dealt: DataFrame, within: int) -> DataFrame:
    """Links within the buckets of `dealt`: each task's buckets come sorted by Gray rank and are indexed some at a time."""

    def linked(prints: list[np.ndarray], ways: list[np.ndarray], tops: list[np.ndarray]) -> pa.RecordBatch:
        p, w, t = np.concatenate(prints), np.concatenate(ways), np.concatenate(tops)
        number = np.cumsum(np.r_[False, (w[1:] != w[:-1]) | (t[1:] != t[:-1])])
        root = groups(GrayIndex(p.view(np.uint64), number), within)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(p[root[moved]]), pa.array(p[moved])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        size = 0
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if size >= INDEX:  # what lies before the last bucket's first row is whole
                same = (new[1] == held[1][-1][-1]) & (new[2] == held[2][-1][-1])
                over = int(np.argmin(same)) if not same.all() else len(same)
                for kept, x in zip(held, new, strict=True):
                    kept.append(x[:over])
                size += over
                if over == len(same):
                    continue
                yield linked(*held)
                held, new, size = [[], [], []], [x[over:] for x in new], 0
            for kept, x in zip(held, new, strict=True):
                kept.append(x)
            size += len(new[0])
        if size:
            yield linked(*held)

    ranked = dealt.select("print", "way", "bucket", F.expr(_gray_rank("turned")).alias("rank"))
    return ranked.repartition("way", "bucket").sortWithinPartitions("way", "bucket", "rank").select("print", "way", "bucket").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", within: int = WITHIN) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest id that links reach) of every row."""
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash-prints")
    classes = materialize(prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    linked = materialize(connected_components(hamming_links(classes, within)).withColumnRenamed("node", "print").join(classes, "print"), "simhash-linked")
    firsts = materialize(linked.groupBy("component").agg(F.min("first_id").alias("component_id")), "simhash-firsts")
    named = linked.join(firsts, "component").select("print", "component_id")
    known = materialize(classes.join(named, "print", "left").select("print", F.coalesce("component_id", "first_id").alias("component_id")), "simhash-named")
    return prints.join(known, "print", "left").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
