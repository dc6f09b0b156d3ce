"""MinHash near-dedup by a signature-coordinate inverted join.

1. Every document's set of distinct shingles (64-bit hashes of five lower-cased words)
   gives a signature of COORDINATES values, each made of BAND min-hashes. Documents of
   equal sets are one from here on (a 128-bit hash of the sorted set names it).
2. Each set is posted under its coordinate-value pairs. Pairs that only one set has are
   dropped, then sets with fewer than MATCHES pairs left: they can't collide MATCHES times.
3. Prefix skipping: two sets with MATCHES common pairs share one among the rarest
   (own pairs - MATCHES + 1) of each, so only these are merged.
4. Most links are to the head of a list: each set meets the smaller one that heads most of its lists;
   their collisions are counted, and from MATCHES on the full sets are compared. One
   link a set at most, and the links' components become labels.
5. Only lists in which several labels are left need more. Their labels' components are clusters in which all
   partners are found; they are cut into chunks of bounded weight, and in each pair of chunks that
   holds different labels collisions are counted by merging posting lists, pairs with
   MATCHES of them are compared as full sets, and what a link connects bears one label from then on. So
   nothing is emitted for all pairs of a group, no set is left out, and a group that its
   heads connect costs no pair of chunks.
6. The links' components, carried over to equal sets, are the result.

Two sets of similarity s collide in a coordinate with probability s**BAND; at 0.85 a link is
missed with a probability of about 2e-7 (fewer than MATCHES of COORDINATES collisions), and
less above. Confirmation is exact.

Defined results: texts that are null, empty or white space have no shingles and link with
nothing; with fewer than five words the whole sequence is one shingle. Null ids are left out of
the groups, and kept. Rows that repeat an id share its component; if their texts differ, the
one whose set hash is least stands for the id. Ties between heads go to the smaller id. Texts of any
length are taken whole. Other columns, whatever their names, pass through `keep_first`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import materialize, remembering
from lumenfold.llm.components import connected_components

WORDS, BAND, COORDINATES, MATCHES = 5, 4, 40, 5
#: Shingles in a chunk of a cluster, at most (a single longer document is a chunk).
CHUNK = 200_000
#: Documents that a task compares with one pivot.
GROUP = 2_000
#: Words remembered by a process.
MEMO = 100_000

_ODD = np.random.default_rng(17).integers(0, 1 << 63, BAND * COORDINATES + WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _ODD[WORDS:, None]


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        got = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < MEMO:
            self[word] = got
        return got


_HASHES = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    total = np.full(n, min(len(h), WORDS), np.uint64)
    for k in range(min(WORDS, len(h))):
        total += h[k : k + n] * _ODD[k]
    return np.unique(_mix(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """COORDINATES values of 64 bits, each of BAND min-hashes."""
    lows = np.full(BAND * COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 1024):
        np.minimum(lows, (hashes[start : start + 1024] * _FACTORS).min(1), out=lows)
    return _mix((_mix(lows).reshape(COORDINATES, BAND) * _ODD[:BAND]).sum(1, dtype=np.uint64) + np.arange(COORDINATES, dtype=np.uint64))


def _name(raw: bytes) -> str:
    return hashlib.blake2b(raw, digest_size=16).hexdigest()


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_hash (32 hex digits, null for an empty set) and signature (array of long, empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("minhash", _HASHES.clear)
        for batch in batches:
            ids, counts, names, marks = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                counts.append(len(found))
                names.append(_name(found.tobytes()) if len(found) else None)
                marks.append(signature(found).view(np.int64) if len(found) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(marks, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_hash", "signature"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_hash string, signature array<long>")


def postings(sets: DataFrame) -> DataFrame:
    """(rep, pair) of the coordinate-value pairs under which sets (rep, signature) have to meet: the rarest of each, as partners share one of them."""
    posted = sets.select("rep", F.posexplode("signature").alias("at", "value")).select("rep", F.xxhash64("at", "value").alias("pair"))
    shared = posted.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1")
    own = posted.join(shared, "pair").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("own"))
    able = own.where(F.size("own") >= MATCHES)
    prefix = able.select("rep", F.explode(F.slice("own", F.lit(1), F.size("own") - (MATCHES - 1))).alias("x")).select("rep", F.col("x.pair").alias("pair"))
    return materialize(prefix, "prefix")


def pivots(prefix: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, pivot): for each set the smaller one that heads most of its lists, if they collide MATCHES times."""
    heads = prefix.groupBy("pair").agg(F.min("rep").alias("head"))
    met = prefix.join(heads, "pair").where("rep > head").groupBy("rep", "head").agg(F.count("*").alias("n"))
    best = met.groupBy("rep").agg(F.max_by("head", F.struct("n", -F.col("head"))).alias("pivot"))
    both = best.join(sets.select("rep", "signature"), "rep").join(sets.select(F.col("rep").alias("pivot"), F.col("signature").alias("other")), "pivot")
    collisions = F.size(F.filter(F.zip_with("signature", "other", lambda x, y: x == y), lambda same: same))
    return both.where(collisions >= MATCHES).select("rep", "pivot")


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes are at least that similar."""
    if len(one) > len(two):
        one, two = two, one
    if 100 * len(one) < percent * len(two):
        return False
    at = np.minimum(np.searchsorted(two, one), len(two) - 1)
    hits = int((two[at] == one).sum())
    return 100 * hits >= percent * (len(one) + len(two) - hits)


def _links(ids: np.ndarray, labels: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], marks: np.ndarray, same: bool, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is similar and bears different labels, in a pair of chunks.

    Collisions are counted by merging the posting lists of a document's rarest pairs; lists
    of one document are skipped, and so are documents that bear the same label by then. Only candidates
    with MATCHES collisions are compared as full sets.
    """
    n, width = marks.shape
    codes = _mix(marks.view(np.uint64) + np.arange(width, dtype=np.uint64) * _ODD[0]).ravel()
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], codes[order][1:] != codes[order][:-1]]))
    lengths = np.diff(np.append(starts, len(order)))
    of = np.empty(len(order), np.int64)
    of[order] = np.repeat(np.arange(len(starts)), lengths)
    of, owner = of.reshape(n, width), order // width
    lab = np.unique(labels, return_inverse=True)[1]
    out = []
    for i in range(n):
        if not same and sides[i]:
            continue
        own = of[i][lengths[of[i]] > 1]
        own = own[np.argsort(lengths[own], kind="stable")][: max(len(own) - MATCHES + 1, 0)]
        if not len(own):
            continue
        met = np.unique(np.concatenate([owner[starts[k] : starts[k] + lengths[k]] for k in own]))
        met = met[(lab[met] != lab[i]) & (met > i if same else sides[met])]
        if len(met):
            collisions = (marks[met] == marks[i]).sum(1)
            for j in met[np.argsort(-collisions, kind="stable")][: int((collisions >= MATCHES).sum())]:
                if lab[j] != lab[i] and _similar(sets[i], sets[j], percent):
                    out.append((int(ids[i]), int(ids[j])))
                    lab[lab == lab[j]] = lab[i]
    return out


def _sets(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in blobs]


def full_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(rep, hashes, marks) of members (rep, set_hash): the packed shingles and signature of docs (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("minhash", _HASHES.clear)
        for batch in batches:
            rows = [(rep, found) for rep, name, text in zip(*[batch.column(c).to_pylist() for c in ("rep", "set_hash", "text")], strict=True) if _name((found := shingles(text)).tobytes()) == name]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([f.tobytes() for _, f in rows], pa.binary()), pa.array([signature(f).tobytes() for _, f in rows], pa.binary())], names=["rep", "hashes", "marks"])

    held = docs.join(members.hint("shuffle_hash"), "rep").select("rep", "set_hash", "text").mapInArrow(run, "rep long, hashes binary, marks binary")
    return materialize(held.dropDuplicates(["rep"]), "sets")


def pivot_links(full: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (rep, pivot) that are similar, as links (a, b). A pivot is sent to a task for every GROUP of its documents, which pass by it one at a time."""
    counts = pairs.groupBy("pivot").agg((F.floor(F.count("*") / GROUP) + 1).alias("parts"))
    dealt = materialize(pairs.join(counts, "pivot").select("rep", "pivot", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part")), "pivots")
    theirs = full.select("rep", "hashes").join(dealt, "rep").select("pivot", "part", F.lit(1).alias("turn"), "rep", "hashes")
    heads = dealt.select("pivot", "part").distinct().join(full.select(F.col("rep").alias("pivot"), "hashes"), "pivot").select("pivot", "part", F.lit(0).alias("turn"), F.col("pivot").alias("rep"), "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, None
        for batch in batches:
            found = []
            for pivot, turn, rep, own in zip(batch.column("pivot").to_pylist(), batch.column("turn").to_pylist(), batch.column("rep").to_pylist(), _sets(batch.column("hashes").to_pylist()), strict=True):
                if not turn:
                    at, head = pivot, own.copy()
                elif pivot == at and _similar(head, own, percent):
                    found.append((rep, pivot))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return heads.unionByName(theirs).repartition("pivot", "part").sortWithinPartitions("pivot", "part", "turn", "rep").mapInArrow(run, "a long, b long")


def open_members(prefix: DataFrame, labels: DataFrame) -> DataFrame:
    """(rep, label, cluster) of what shares a posting list with another label; all partners that are not yet linked are in one cluster."""
    named = materialize(prefix.join(labels, "rep").select("pair", "rep", "label"), "named")
    opened = named.groupBy("pair").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("pair", "least")
    left = materialize(named.join(opened, "pair"), "open")
    stars = left.where("label > least").select(F.col("label").alias("a"), F.col("least").alias("b")).distinct()
    found = connected_components(stars).select(F.col("node").alias("label"), F.col("component").alias("cluster"))
    return left.select("rep", "label").distinct().join(found, "label")


def open_links(full: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links between members (rep, label, cluster, n_shingles) of different labels.

    A cluster is cut into chunks of about CHUNK shingles; a label of more than that has
    chunks of its own, which need not meet one another. Every other pair of chunks is a task.
    """
    weights = members.groupBy("cluster", "label").agg(F.sum("n_shingles").alias("weight"))
    weights = weights.withColumn("big", F.col("weight") > CHUNK)
    owner = F.when(F.col("big"), F.col("label"))
    packs = weights.groupBy("cluster", "big", owner.alias("owner")).agg((F.floor(F.sum("weight") / CHUNK) + 1).cast("int").alias("parts"))
    chunks = packs.select("cluster", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct("big", "owner", i.alias("part")))).alias("chunk"))
    others = chunks.groupBy("cluster").agg(F.collect_list("chunk").alias("chunks"))
    placed = members.join(weights.select("cluster", "label", "big"), ["cluster", "label"]).withColumn("owner", owner)
    placed = placed.join(packs.select("cluster", "big", F.col("owner").alias("whose"), "parts"), ["cluster", "big"]).where(F.col("owner").eqNullSafe(F.col("whose")))
    part = F.pmod(F.xxhash64(F.when(F.col("big"), F.col("rep")).otherwise(F.col("label"))), F.col("parts")).cast("int")
    placed = materialize(placed.select("rep", "label", "cluster", F.struct("big", "owner", part.alias("part")).alias("chunk")).join(others, "cluster"), "chunks")
    met = placed.select("rep", "label", "cluster", "chunk", F.explode(F.filter("chunks", lambda c: ~(c["big"] & c["owner"].eqNullSafe(F.col("chunk.owner"))))).alias("other"))
    met = met.select("rep", "label", "cluster", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), (F.col("chunk") > F.col("other")).alias("side"))
    met = met.join(full, "rep").withColumn("task", F.xxhash64("cluster", "one", "two")).withColumn("same", F.col("one") == F.col("two")).drop("one", "two", "cluster")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                ids, labels, sides, hashes, marks = zip(*held, strict=True)
                found = _links(np.array(ids), np.array(labels), np.array(sides, bool), _sets(list(hashes)), np.frombuffer(b"".join(marks), np.int64).reshape(len(ids), -1), key[1], percent)
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for task, same, *row in zip(*[batch.column(c).to_pylist() for c in ("task", "same", "rep", "label", "side", "hashes", "marks")], strict=True):
                if key != (task, same):
                    yield from flush()
                    key, held = (task, same), []
                held.append(row)
        yield from flush()

    return met.repartition("task").sortWithinPartitions("task", "same", "side", "rep").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and kept, for every row."""
    sketched = materialize(sketch(docs, id_col, text_col), "sketch")
    known = sketched.where("doc_id IS NOT NULL AND set_hash IS NOT NULL")
    sets = materialize(known.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles")), "classes")
    chosen = sets.groupBy("rep").agg(F.min_by(F.struct("set_hash", "n_shingles"), "set_hash").alias("x")).select("rep", "x.*")
    marks = known.select(F.col("doc_id").alias("rep"), "set_hash", "signature")
    reps = marks.join(chosen.select("rep", "set_hash"), ["rep", "set_hash"]).dropDuplicates(["rep"]).select("rep", "signature")
    prefix = postings(reps)
    pairs = materialize(pivots(prefix, reps), "pairs")
    texts = docs.select(docs[id_col].cast("long").alias("rep"), docs[text_col].alias("text"))
    full = full_sets(texts, chosen.select("rep", "set_hash").join(prefix.select("rep").distinct(), "rep"))
    first = materialize(connected_components(materialize(pivot_links(full, pairs, percent), "links")).select(F.col("node").alias("rep"), F.col("component").alias("label")), "first")
    labels = prefix.select("rep").distinct().join(first, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"))
    members = materialize(open_members(prefix, labels).join(chosen.select("rep", "n_shingles"), "rep"), "members")
    links = materialize(open_links(full, members, percent), "links")
    of_label = labels.select(F.col("rep").alias("a"), F.col("label").alias("la"))
    of_other = labels.select(F.col("rep").alias("b"), F.col("label").alias("lb"))
    merged = connected_components(links.join(of_label, "a").join(of_other, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    found = labels.join(merged.select(F.col("node").alias("label"), "component"), "label", "left").select("rep", F.coalesce("component", "label").alias("component"))
    classes = sets.join(found, "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles", "set_hash").join(classes, "set_hash", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """docs without the rows whose document is a near copy of one with a smaller id."""
    gone = near_duplicates(docs, id_col, text_col, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_mh_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_mh_gone"], "left_anti")
