"""Suffix-array dedup: bytes covered by a WIDTH-byte string that also starts in a document with a smaller id go.

Every window of WIDTH bytes names one of its GRAM-byte pieces by content alone: the one of
least hash, the leftmost of equals. Equal windows so name equal pieces (anchors), and the
windows from one anchor make a run (a segment) of at most 2 * WIDTH - GRAM bytes.

1. A text that an earlier document repeats as a whole is settled by its hash.
2. Anchors are packed by bucket of their hash (by its low bits, as least hashes have small high
   ones); each bucket keeps those of several documents and packs them by group of documents; each
   group sends one row a document. Only the low halves of the hashes are sent back: equal halves of
   different hashes merely send a segment that meets nothing.
3. Documents send the segments of such anchors; of equal segments in a batch only the first
   document's, as the others are covered by it (combining before the shuffle).
4. Segments meet by anchor, sorted: of equal ones again all but the first are covered. What is
   left is cut into shards of about SHARD bytes at ends of anchors, and a suffix array is built for
   each by Larsson-Sadakane refinement (doubling within unsorted groups only), with common prefixes
   by Kasai's rule, run in lockstep over the segments. Suffixes of WIDTH common bytes share the
   least document among them. An anchor with more than SHARD bytes of distinct segments spans
   several shards; these are merged: the sorted windows of one shard are looked up in those of the
   others by binary search.
5. Covered ranges are joined where they touch, packed by group of documents (one row a group, so rows
   don't grow with the places that a document is covered from) and return to their documents, which are cut.

The texts are shuffled by id once; Catalyst reuses that exchange in steps 2, 3 and 5.

Defined results: null texts are empty; texts under WIDTH bytes lose nothing; rows with null ids are
not compared and lose nothing. Rows that repeat an id are not compared with one another. Matches
never span documents, and bytes are judged on the input. Anything may be in the texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, GRAM = 50, 20
#: Bytes of a text looked at once, of a shard, and of text for each bucket of anchors and each shard task.
PIECE, SHARD, BUCKET_TEXT = 1 << 19, 1 << 21, 12 << 20
#: Covered ranges that a shard task holds (four numbers each) before it joins and sends them.
COVERS = 4 * 500_000
_LOW, _HALF = 20, np.uint64(0xFFFFFFFF)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]


def _grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    one = raw.astype(np.uint64)
    two = one[:-1] << np.uint64(8) | one[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    n = len(raw) - GRAM + 1
    h = eight[:n] * _C[0] + eight[8 : 8 + n] * _C[1] + four[16 : 16 + n] * _C[2]
    h = (h ^ (h >> np.uint64(32))) * _C[3]
    return h ^ (h >> np.uint64(29))


def runs(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of all windows, a piece at a time: their hashes, and first and last window starts of each run."""
    most = WIDTH - GRAM + 1
    for start in range(0, len(text) - WIDTH + 1, PIECE):
        raw = np.frombuffer(text, np.uint8, min(PIECE + WIDTH - 1, len(text) - start), start)
        h = _grams(raw)
        low = (h >> np.uint64(_LOW)) << np.uint64(_LOW) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= most:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < most:
            low = np.minimum(low[: len(low) - (most - width)], low[most - width :])
        at = (low & np.uint64((1 << _LOW) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        yield h[at[first]], first + start, last + start


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The order of all suffixes. It is complete, as Kasai's rule needs that: among suffixes sorted by some bytes only, it fails."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1

    def number(places: np.ndarray, suffixes: np.ndarray, fresh: np.ndarray) -> None:
        # a group's rank is the place of its last member
        ends = np.append(np.flatnonzero(fresh)[1:], len(places)) - 1
        rank[suffixes] = places[np.repeat(ends, np.diff(np.append(np.flatnonzero(fresh), len(places))))]

    number(np.arange(n), order, new)
    h = 8
    open_places = np.arange(n)
    while h < 2 * n:
        groups = rank[order[open_places]]
        single = np.concatenate([[True], groups[1:] != groups[:-1]]) & np.concatenate([groups[1:] != groups[:-1], [True]])
        open_places = open_places[~single]  # refine unsorted groups only
        if not len(open_places):
            break
        part = order[open_places]
        ahead = rank[np.minimum(part + h, n)]
        mine = rank[part]
        by = np.lexsort((ahead, mine))
        part, ahead, mine = part[by], ahead[by], mine[by]
        order[open_places] = part
        fresh = np.concatenate([[True], (mine[1:] != mine[:-1]) | (ahead[1:] != ahead[:-1])])
        number(open_places, part, fresh)
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """For each suffix the bytes, `most` at most, that it shares with the one before it in order.

    Kasai's rule: the next suffix shares at least one byte less. All segments advance
    together, one place at a time, so the rule works on arrays.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data.astype(np.int16), np.full(most + 1, -1, np.int16)])
    shared = np.zeros(n, np.int64)
    alive, held = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for step in range(int(lengths.max(initial=0))):
        alive = alive[lengths[alive] > step]
        i = starts[alive] + step
        other = before[i]
        got = np.maximum(held[alive] - 1, 0)
        grow = np.flatnonzero(other >= 0)
        got[other < 0] = 0
        while len(grow):
            a, b = i[grow] + got[grow], other[grow] + got[grow]
            more = (got[grow] < most) & (b < n) & (padded[a] == padded[np.minimum(b, n)]) & (padded[a] >= 0)
            grow = grow[more]
            got[grow] += 1
        shared[i] = got
        held[alive] = got
    return shared


def shard_windows(segments: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """The windows of a shard: segment and offset of each, the number of its string, and for each string its bytes (sorted) and least document."""
    lengths = np.array([len(s) for s in segments], np.int64)
    data = np.frombuffer(b"".join(segments), np.uint8)
    starts = np.cumsum(lengths) - lengths
    order = suffix_array(data)
    shared = common_prefixes(data, order, starts, lengths, WIDTH)
    owner = np.repeat(np.arange(len(segments)), lengths)
    offset = np.arange(len(data)) - starts[owner]
    whole = offset <= lengths[owner] - WIDTH
    # a window equals the one before it among windows if all suffixes between share WIDTH bytes
    breaks = np.cumsum(shared[order] < WIDTH)
    chosen = order[whole[order]]
    group = breaks[whole[order]]
    _, first, number = np.unique(group, return_index=True, return_inverse=True)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, number, docs[owner[chosen]])
    strings = [data[i : i + WIDTH].tobytes() for i in chosen[first]]
    return owner[chosen], offset[chosen], number, strings, least


def covered(segments: list[bytes], docs: np.ndarray) -> Iterator[tuple[int, int]]:
    """(segment, offset) of the windows that a smaller document holds; shards of about SHARD bytes, merged by binary search."""
    shards, start, size = [], 0, 0
    for i, s in enumerate(segments):
        if size + len(s) > SHARD and i > start:
            shards.append((start, i))
            start, size = i, 0
        size += len(s)
    shards.append((start, len(segments)))
    found = [shard_windows(segments[a:b], docs[a:b]) for a, b in shards]
    for k, ((a, _), (owner, offset, number, strings, least)) in enumerate(zip(shards, found, strict=True)):
        best = least.copy()
        for j, other in enumerate(found):
            if j != k and other[3]:
                # numpy drops zero bytes at the end; a final byte of one keeps them
                theirs = np.array([x + b"\1" for x in other[3]], f"S{WIDTH + 1}")
                mine = np.array([x + b"\1" for x in strings], f"S{WIDTH + 1}")
                at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
                same = theirs[at] == mine
                best[same] = np.minimum(best[same], other[4][at[same]])
        hit = best[number] < docs[a + owner]
        yield from zip((a + owner[hit]).tolist(), offset[hit].tolist(), strict=True)


def joined_ranges(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (document, mark, first, last) each document and mark, how many ranges it has left, and these, joined where they overlap or touch."""
    doc, mark, first, last = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))].T
    new = np.concatenate([np.ones(min(len(doc), 1), bool), (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])
    number = np.cumsum(new) << 32  # no range reaches from one document into the next
    reach = np.maximum.accumulate(number + last)
    begins = np.flatnonzero(new | np.concatenate([np.ones(min(len(doc), 1), bool), (number + first)[1:] > reach[:-1] + 1]))
    ends = reach[np.append(begins[1:], len(doc)) - 1] - number[begins] if len(begins) else begins
    heads = np.flatnonzero(new[begins])
    sizes = np.diff(np.append(heads, len(begins)))
    return doc[begins[heads]], mark[begins[heads]], sizes, np.column_stack([first[begins], ends])


def gathered(batches: Iterator[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together to about `most` bytes: the more documents, the more equal segments combine."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def covered_windows(docs: DataFrame, text_bytes: int) -> DataFrame:
    """(doc_id, mark, ranges) of docs (doc_id, mark, text, skip): packed pairs of first and last covered window starts."""
    buckets = max(1, -(-text_bytes // BUCKET_TEXT))

    def dealt(mixed: np.ndarray) -> np.ndarray:
        """The bucket of a hash, or the group of a document, by 32 mixed bits."""
        return (mixed & _HALF) * np.uint64(buckets) >> np.uint64(32)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            ids, hashes, owners = batch.column("doc_id").fill_null(0).to_numpy(), [], []
            skips = batch.column("skip").to_pylist()
            for i, text in enumerate(batch.column("text").to_pylist()):
                if not skips[i] and len(text) * 4 >= WIDTH:
                    h = np.unique(np.concatenate([x[0] for x in runs(text.encode())] or [np.empty(0, np.uint64)]))
                    hashes.append(h)
                    owners.append(np.full(len(h), i, np.uint32))
            if not hashes:
                continue
            h, owner = np.concatenate(hashes), np.concatenate(owners)
            bucket = dealt(h)
            order = np.argsort(bucket, kind="stable")
            h, owner = h[order], owner[order]
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(b, h[x:y].tobytes(), ids[owner[x:y]]) for b, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if y > x]
            names = [np.unique(r[2], return_inverse=True) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([n[0].tobytes() for n in names], pa.binary()), pa.array([n[1].astype(np.uint32).tobytes() for n in names], pa.binary())], names=["bucket", "hashes", "ids", "owners"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h = np.concatenate([np.frombuffer(x, np.uint64) for x, _, _ in held])
            ids = np.concatenate([np.frombuffer(i, np.int64)[np.frombuffer(o, np.uint32)] for _, i, o in held])
            order = np.argsort(h, kind="stable")
            h, ids = h[order], ids[order]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
            keep = np.repeat(several, np.diff(np.append(starts, len(h))))
            h, ids = (h[keep] & _HALF).astype(np.uint32), ids[keep]
            group = dealt(ids.view(np.uint64) * _C[0] >> np.uint64(32))
            order = np.lexsort((ids, group))
            h, ids, group = h[order], ids[order], group[order]
            begins = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), group[1:] != group[:-1]]))
            for x, y in zip(begins, np.append(begins[1:], len(h)), strict=True):
                names, sizes = np.unique(ids[x:y], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([group[x]], pa.int32()), pa.array([names.tobytes()], pa.binary()), pa.array([sizes.astype(np.uint32).tobytes()], pa.binary()), pa.array([h[x:y].tobytes()], pa.binary())], names=["part", "ids", "sizes", "anchors"])

        for batch in batches:
            for bucket, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket != at:
                    yield from flush()
                    at, held = bucket, []
                held.append(row)
        yield from flush()

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                ids = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(n, np.uint32)) for i, n, _ in held])
                h = np.concatenate([np.frombuffer(x, np.uint32) for _, _, x in held])
                order = np.argsort(ids, kind="stable")
                names, begins = np.unique(ids[order], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([x.tobytes() for x in np.split(h[order], begins[1:])], pa.binary())], names=["found_id", "anchors"])

        for batch in batches:
            for part, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if part != at:
                    yield from flush()
                    at, held = part, []
                held.append(row)
        yield from flush()

    # rows to skip are left to Python: a filter would go below the exchange of the texts, which then could not be used again
    sent = docs.select("doc_id", "text", "skip").mapInArrow(anchors, "bucket int, hashes binary, ids binary, owners binary")
    found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared, "part int, ids binary, sizes binary, anchors binary")
    by_doc = found.repartition("part").sortWithinPartitions("part").mapInArrow(unpacked, "found_id long, anchors binary")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            ids, marks, skips = batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), batch.column("skip").to_pylist()
            first: dict[bytes, int] = {}
            made, done = [], []
            for i, (text, blob) in enumerate(zip(batch.column("text").to_pylist(), batch.column("anchors").to_pylist(), strict=True)):
                if skips[i] or not blob:
                    continue
                raw, wanted = text.encode(), np.unique(np.frombuffer(blob, np.uint32))
                for h, start, end in runs(raw):
                    half = (h & _HALF).astype(np.uint32)
                    hit = wanted[np.minimum(np.searchsorted(wanted, half), len(wanted) - 1)] == half
                    for anchor, x, y in zip(h[hit].view(np.int64).tolist(), start[hit].tolist(), end[hit].tolist(), strict=True):
                        s = raw[x : y + WIDTH]
                        k = first.get(s)
                        if k is None or ids[i] < made[k][2]:
                            if k is not None:
                                done.append(made[k])
                                made[k] = None
                            first[s] = len(made)
                            made.append((anchor, s, ids[i], marks[i], x))
                        elif ids[i] > made[k][2]:
                            done.append((anchor, s, ids[i], marks[i], x))
                        else:
                            made.append((anchor, s, ids[i], marks[i], x))
            covers: dict[tuple[int, int], list[int]] = {}
            for _, s, doc, mark, x in done:
                covers.setdefault((doc, mark), []).extend((x, x + len(s) - WIDTH))
            rows = [m for m in made if m] + [(doc, None, doc, mark, -1) for doc, mark in covers]
            ranges = [None] * (len(rows) - len(covers)) + [np.array(v, np.int64).tobytes() for v in covers.values()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)] + [pa.array(ranges, pa.binary())], names=["anchor", "segment", "doc_id", "mark", "start", "ranges"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covers = array("q")  # document, mark, first and last of each range
        held: list[tuple] = []
        size, anchor, last, alone = 0, None, None, 0

        def flush() -> None:
            nonlocal size, alone
            if held:
                for i, offset in covered([h[0] for h in held], np.array([h[1] for h in held], np.int64)):
                    _, doc, mark, start = held[i]
                    covers.extend((doc, mark, start + offset, start + offset))
            held.clear()
            size, alone = 0, 0

        def packed() -> Iterator[pa.RecordBatch]:
            ids, marks, sizes, ranges = joined_ranges(np.array(covers, np.int64).reshape(-1, 4))
            del covers[:]
            begins = np.cumsum(sizes) - sizes
            group = dealt(ids.view(np.uint64) * _C[0] >> np.uint64(32))
            order = np.argsort(group, kind="stable")
            at = np.flatnonzero(np.concatenate([np.ones(min(len(ids), 1), bool), np.diff(group[order]) != 0]))
            for own in np.split(order, at[1:]) if len(order) else ():
                mine = np.concatenate([ranges[begins[i] : begins[i] + sizes[i]] for i in own])
                yield pa.RecordBatch.from_arrays([pa.array([group[own[0]]], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in (ids[own], marks[own], sizes[own].astype(np.uint32), mine)], names=["part", "ids", "marks", "sizes", "ranges"])

        for batch in batches:
            for a, s, doc, mark, start, ranges in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if len(covers) > COVERS:
                    yield from packed()
                if s is None:
                    for first, end in np.frombuffer(ranges, np.int64).reshape(-1, 2).tolist():
                        covers.extend((doc, mark, first, end))
                    continue
                if a != anchor:
                    if alone == 1:  # one segment of the last anchor is left: nothing to compare
                        size -= len(held.pop()[0])
                    if size > SHARD:
                        flush()
                    anchor, last, alone = a, None, 0
                if last is not None and s == last[0]:
                    if doc > last[1]:
                        covers.extend((doc, mark, start, start + len(s) - WIDTH))
                    else:  # the same document holds it again
                        held.append((s, doc, mark, start))
                        size, alone = size + len(s), alone + 1
                    continue
                last = (s, doc)
                held.append((s, doc, mark, start))
                size, alone = size + len(s), alone + 1
        if alone == 1:
            held.pop()
        flush()
        yield from packed()

    def returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows = [np.column_stack([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(n, np.uint32)), np.repeat(np.frombuffer(m, np.int64), np.frombuffer(n, np.uint32)), np.frombuffer(r, np.int64).reshape(-1, 2)]) for i, m, n, r in held]
                ids, marks, sizes, ranges = joined_ranges(np.concatenate(rows))
                blobs = [x.tobytes() for x in np.split(ranges, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "mark", "ranges"])

        for batch in batches:
            for part, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if part != at:
                    yield from flush()
                    at, held = part, []
                held.append(row)
        yield from flush()

    joined = docs.join(by_doc.hint("shuffle_hash"), F.col("doc_id") == F.col("found_id"), "left").select("doc_id", "mark", "text", "skip", "anchors")
    parts = joined.mapInArrow(segments, "anchor long, segment binary, doc_id long, mark long, start long, ranges binary")
    met = parts.repartition("anchor").sortWithinPartitions("anchor", "segment", "doc_id", "mark", "start")
    covers = met.mapInArrow(match, "part int, ids binary, marks binary, sizes binary, ranges binary")
    return covers.repartition("part").sortWithinPartitions("part").mapInArrow(returned, "doc_id long, mark long, ranges binary")


def cut(raw: bytes, ranges: list[bytes], copy: bool) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and what is left."""
    if len(raw) < WIDTH:
        return 0, 0, raw
    if copy:
        return len(raw), 1, b""
    if not ranges:
        return 0, 0, raw
    pairs = np.concatenate([np.frombuffer(r, np.int64) for r in ranges]).reshape(-1, 2)
    steps = np.zeros(len(raw) + 1, np.int64)
    np.add.at(steps, pairs[:, 0], 1)
    np.add.at(steps, np.minimum(pairs[:, 1] + WIDTH, len(raw)), -1)
    gone = np.cumsum(steps[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that are left) for every row."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marks = docs.select(docs[id_col].cast("long").alias("doc_id"), F.md5(text).alias("name"), F.xxhash64(text).alias("mark")).where("doc_id IS NOT NULL")
    firsts = marks.groupBy("name").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = marks.join(firsts, "name").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("mark").alias("copy_marks")).withColumnRenamed("doc_id", "copy_id")
    known = rows.join(copies.hint("shuffle_hash"), rows["doc_id"] == copies["copy_id"], "left").select("doc_id", "mark", "text", F.coalesce(F.array_contains("copy_marks", F.col("mark")), F.lit(False)).alias("copy"))
    known = known.withColumn("skip", F.col("copy") | F.col("doc_id").isNull())
    spans = covered_windows(known, total).groupBy(F.col("doc_id").alias("span_id")).agg(F.collect_list(F.struct("mark", "ranges")).alias("spans"))
    full = known.join(spans.hint("shuffle_hash"), known["doc_id"] == spans["span_id"], "left")
    full = full.select("doc_id", "text", "copy", F.transform(F.filter("spans", lambda s: s["mark"] == F.col("mark")), lambda s: s["ranges"]).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for t, copy, ranges in zip(*[batch.column(c).to_pylist() for c in ("text", "copy", "ranges")], strict=True):
                raw = t.encode()
                sizes.append(len(raw))
                out.append(cut(raw, ranges or [], copy))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return full.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
