"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens are a linked list of byte parts, many of them in one, cut between them. The pairs waiting to be merged lie
in buckets, one for each merge rank, that hold positions of the list; a
two-level bitmap over the ranks finds the lowest bucket by find-first-set.
Entries whose pair has changed meanwhile are stale and skipped when met. Each
merge costs O(log n) at most, so a pre-token of a megabyte takes about as long
as the same bytes in short words.

The vocabulary is a rank file (base64 token, rank, by line); its path and the
pattern of pre-tokens are parameters. The file is read on the executors, from
the same path as on the driver.

Defined results: a null text is an empty one; an empty text has no ids; repeated
rows give repeated results; ids of a decode call that the vocabulary lacks are an
error, null ids decode to empty bytes. Other columns pass through untouched unless
they bear the name of an output column, which replaces them.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import remembering

#: Pre-tokens of at most this many characters are remembered, so many of them in each of two generations, and so many pairs of ids.
MEMO_CHARS, MEMO_ENTRIES, PAIR_ENTRIES = 32, 200_000, 300_000
#: Bytes of pre-tokens that lie in one linked list (a longer one is alone).
GROUP_BYTES = 1 << 12


class RankQueue:
    """Positions by rank: a bucket for each rank in use, and a bitmap of two levels over the ranks, words of 256 bits each.

    A bucket is a list of positions, sorted when it is taken. `Bpe.encode_pieces` works on the
    fields themselves, as a call for each push and pop would take most of the time.
    """

    def __init__(self, ranks: int) -> None:
        self.low = [0] * -(-ranks // 256)
        self.top = 0
        self.buckets: list[list[int] | None] = [None] * (len(self.low) * 256)


def pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Bpe:
    """Encoder and decoder over a rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
        self.ranks = ranks
        self.vocab = {rank: token for token, rank in ranks.items()}
        self.first = {tuple(token): rank for token, rank in ranks.items() if len(token) == 2}
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.find = regex.compile(pattern).findall
        self.pairs: dict[int, int] = {}
        self.queue = RankQueue(max(self.vocab) + 1)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, a: int, b: int) -> int:
        """The id of two neighbours put together, which is its rank, or -1; remembered."""
        if len(self.pairs) > PAIR_ENTRIES:
            self.pairs.clear()
        got = self.pairs[a << 32 | b] = self.ranks.get(self.vocab[a] + self.vocab[b], -1)
        return got

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token. All of them lie in one linked list, cut between them, and share the queue: a rank's bucket is emptied at one go."""
        raw = b"".join(pieces)
        n = len(raw)
        ids = [*map(self.byte_id.__getitem__, raw)]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        # the rank under which a position waits, -1 for none
        waits = [*map(self.first.get, zip(raw, raw[1:]), repeat(-1)), -1]
        starts = [0, *accumulate(map(len, pieces))]
        for end in starts[1:]:
            if end:
                waits[end - 1], after[end - 1] = -1, n
            if end < n:
                before[end] = -1
        queue, pair, learn = self.queue, self.pairs.get, self.learn
        low, buckets, top = queue.low, queue.buckets, 0
        for i, rank in enumerate(waits):
            if rank >= 0:
                if buckets[rank] is None:
                    buckets[rank] = [i]
                    low[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
                else:
                    buckets[rank].append(i)
        while top:
            k = (top & -top).bit_length() - 1  # find first set, twice
            word = low[k]
            taken = k << 8 | (word & -word).bit_length() - 1
            bucket, buckets[taken] = buckets[taken], None
            word &= word - 1
            low[k] = word
            if not word:
                top &= top - 1
            if len(bucket) > 1:
                bucket.sort()
            lowest, met = taken, 0
            for i in bucket:
                met += 1
                if waits[i] != taken:
                    continue  # stale
                j = after[i]
                ids[i] = taken
                k = after[i] = after[j]
                waits[j] = -1
                if k < n:
                    before[k] = i
                    right = ids[k]
                    again = pair(taken << 32 | right)
                    if again is None:
                        again = learn(taken, right)
                    waits[i] = again
                    if again >= 0:  # push
                        if buckets[again] is None:
                            buckets[again] = [i]
                            low[again >> 8] |= 1 << (again & 255)
                            top |= 1 << (again >> 8)
                        else:
                            buckets[again].append(i)
                        if again < lowest:
                            lowest = again
                else:
                    waits[i] = -1
                h = before[i]
                if h >= 0:
                    left = ids[h]
                    again = pair(left << 32 | taken)
                    if again is None:
                        again = learn(left, taken)
                    if again != waits[h]:
                        waits[h] = again
                        if again >= 0:  # push
                            if buckets[again] is None:
                                buckets[again] = [h]
                                low[again >> 8] |= 1 << (again & 255)
                                top |= 1 << (again >> 8)
                            else:
                                buckets[again].append(h)
                            if again < lowest:
                                lowest = again
                if lowest < taken:  # a lower rank has come up: it goes first, and the rest of the bucket waits
                    if met < len(bucket):
                        buckets[taken] = bucket[met:] + (buckets[taken] or [])
                        low[taken >> 8] |= 1 << (taken & 255)
                        top |= 1 << (taken >> 8)
                    break
        out = []
        for i in starts[:-1]:
            own = []
            while i < n:
                own.append(ids[i])
                i = after[i]
            out.append(own)
        return out

    def learn_pieces(self, pieces: set[str]) -> None:
        """Put the packed ids of all pieces into the memo. What has not been met since the last but one generation is forgotten."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo, self.old = {}, self.memo
        new = pieces.difference(self.memo)
        held = new.intersection(self.old)
        self.memo.update(zip(held, map(self.old.__getitem__, held)))
        group, size = [], 0
        for piece in new.difference(held):
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.memo[piece] = pack([whole])
                continue
            group.append((piece, raw))
            size += len(raw)
            if size > GROUP_BYTES:
                self.memo.update((p, pack(x)) for (p, _), x in zip(group, self.encode_pieces([r for _, r in group])))
                group, size = [], 0
        if group:
            self.memo.update((p, pack(x)) for (p, _), x in zip(group, self.encode_pieces([r for _, r in group])))

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers, one after another."""
        cut = [self.find(t) for t in texts]
        pieces = set().union(*cut)
        self.learn_pieces(pieces)
        out = [b"".join(map(self.memo.__getitem__, x)) for x in cut]
        for piece in pieces:
            if len(piece) > MEMO_CHARS:
                del self.memo[piece]
        return out

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed([text])[0]).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


_LOADED: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """The encoder of this process."""
    remembering("bpe", _LOADED.clear)
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe(path, pattern)
    return _LOADED[path, pattern]


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces whose column holds about `most` bytes or a single row."""
    start, held = 0, 0
    sizes = pc.binary_length(batch.column(column)).to_pylist() if not pa.types.is_list(batch.column(column).type) else pc.list_value_length(batch.column(column)).to_pylist()
    for i, size in enumerate(sizes):
        if held and held + (size or 0) > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    yield batch.slice(start)


def _lists(packed: list[bytes]) -> pa.ListArray:
    """Packed ids as an Arrow column."""
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names) if name not in new} | new
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _schema(df: DataFrame, **new: str):
    """df's schema with the new columns last."""
    return df.select(*[df[c] for c in df.columns if c not in new], *[F.lit(None).cast(kind).alias(name) for name, kind in new.items()]).schema


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the token ids of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for whole in batches:
            for batch in _slices(whole, text_col, 1 << 20):
                yield _with(batch, {ids_col: _lists(bpe.packed([t or "" for t in batch.column(text_col).to_pylist()]))})

    return docs.mapInArrow(run, _schema(docs, **{ids_col: "array<int>"}))


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """tokens with the bytes that their ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for whole in batches:
            for batch in _slices(whole, ids_col, 1 << 20):
                raw = [bpe.decode(x or []) for x in batch.column(ids_col).to_pylist()]
                yield _with(batch, {bytes_col: pa.array(raw, pa.binary())})

    return tokens.mapInArrow(run, _schema(tokens, **{bytes_col: "binary"}))


def encode_decode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Both in one pass over the rows: the ids of the whole text, then the bytes decoded from these ids; text itself is left out."""
    slim = docs.select(*[c for c in docs.columns if c != text_col], text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for whole in batches:
            for batch in _slices(whole, text_col, 1 << 20):
                packed = bpe.packed([t or "" for t in batch.column(text_col).to_pylist()])
                raw = [bpe.decode(array("i", x)) for x in packed]
                rest = batch.drop_columns([text_col])
                yield _with(rest, {ids_col: _lists(packed), bytes_col: pa.array(raw, pa.binary())})

    return slim.mapInArrow(run, _schema(slim.drop(text_col), **{ids_col: "array<int>", bytes_col: "binary"}))
