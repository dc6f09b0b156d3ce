"""Three-way merge of two branches of a table, by cogrouping pair RDDs on the row id.

Base, left and right are pair RDDs by id. A base value is (columns, text): a tuple of strings and a text
of \\n-split lines. A branch value is a Change, an edit script over the base row: rows that a branch
leaves alone are not in it, so texts are shuffled once, not once a branch. Each side is first reduced to one
value an id (combined before the shuffle, so a repeated id is no hot group), all three by
the same partitioner; the cogroup then needs no further shuffle, and a generator merges one id at a time.

Columns, lines, the gaps behind lines and whole added rows merge separately, by value. A change of one side, or
equal changes, are one clean change; different ones are one conflict, which takes the left state: edit-edit,
edit-delete where one side drops the line, insert-insert for gaps and for rows added under one id by both
(ids that each branch made up from another source document may collide). A row that one side drops counts
alone: edit-delete if the other side keeps it with changes of its own, else clean.

Defined results: null columns and texts are empty first. Rows with a null id have nothing to be merged by
and take no part. Rows that repeat an id are one row, the least by columns and then text; of several
changes of one id in one branch the scripts are united, the least wins where they differ. Edits that leave a value as it is
are no change; changes of lines that the base row has not, or of ids that it has not, do nothing. A row added
under an id of the base is an insert-insert conflict, counted once, and the base's own merge stands. A text without a
line left is empty. Empty tables give an empty one. Texts are split one at a time, whatever their length;
other columns of `documents` take no part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import materialize

#: An edit: how many characters of the value are kept (None: all), and what follows them. None in its place drops a line.
Edit = tuple[int | None, str]


class Change(NamedTuple):
    """What a branch does under an id. `added` is a whole new row, (columns, text)."""

    dropped: bool = False
    columns: dict[int, Edit] = {}  # noqa: RUF012  (never changed)
    lines: dict[int, Edit | None] = {}  # noqa: RUF012
    gaps: dict[int, tuple[str, ...]] = {}  # noqa: RUF012
    added: tuple | None = None


#: The edit that changes nothing, and the texts of the codes.
WHOLE: Edit = (None, "")
MARKS = {1: "!", 2: "?", 3: "!", 4: "?"}


def _edited(value: str, edit: Edit | None) -> str | None:
    return None if edit is None else value[: edit[0]] + edit[1]


def _united(one: Change, two: Change) -> Change:
    """The changes of one branch under one id."""
    least = lambda a, b: b | a | {k: min(a[k], b[k], key=lambda x: (x is None, repr(x))) for k in a.keys() & b.keys()}
    return Change(one.dropped or two.dropped, least(one.columns, two.columns), least(one.lines, two.lines), least(one.gaps, two.gaps), min((x for x in (one.added, two.added) if x), default=None))


class _Counts:
    def __init__(self) -> None:
        self.clean = self.edit_edit = self.edit_delete = self.insert_insert = 0

    def take(self, base, left, right, conflict: str = "edit_edit"):
        """The merged state of one thing, whose change is counted; base is its state without one, None a line that is gone."""
        if left == right:
            self.clean += left != base
        elif base in (left, right):
            self.clean += 1
            return right if left == base else left
        else:
            conflict = "edit_delete" if conflict == "edit_edit" and None in (left, right) else conflict
            setattr(self, conflict, getattr(self, conflict) + 1)
        return left


def _merged(base: tuple, left: Change, right: Change, counts: _Counts) -> tuple:
    """(columns, text) of a row that both sides keep."""
    columns = tuple(counts.take(value, *(_edited(value, c.columns.get(k, WHOLE)) for c in (left, right))) for k, value in enumerate(base[0]))
    lines, out, done = base[1].split("\n"), [], 0
    for at in sorted({*left.lines, *right.lines, *left.gaps, *right.gaps}):
        if not -1 <= at < len(lines):
            continue
        if at >= 0:
            states = [_edited(lines[at], c.lines.get(at, WHOLE)) for c in (left, right)]
            kept = counts.take(lines[at], *states)
            out += lines[done:at] if kept is None else [*lines[done:at], kept]
            done = at + 1
        out += counts.take((), left.gaps.get(at, ()), right.gaps.get(at, ()), "insert_insert")
    return columns, "\n".join(out + lines[done:])


def merge_row(base: tuple | None, left: Change, right: Change) -> tuple | None:
    """(columns, text) or None for a row that is gone, then the counts of clean, edit-edit, edit-delete and insert-insert changes; None if no side has the id."""
    counts, row = _Counts(), None
    added = left.added or right.added
    if base is None:
        if not added:
            return None
        row = counts.take(None, left.added, right.added, "insert_insert")
    else:
        counts.insert_insert += bool(added)
        if left.dropped or right.dropped:
            alone = _Counts()
            kept = _merged(base, right if left.dropped else left, Change(), alone)
            if alone.clean and not (left.dropped and right.dropped):
                counts.edit_delete += 1
                row = None if left.dropped else kept
            else:
                counts.clean += 1
        else:
            row = _merged(base, left, right, counts)
    return row, counts.clean, counts.edit_edit, counts.edit_delete, counts.insert_insert


def merge(base: RDD, left: RDD, right: RDD, parts: int) -> RDD:
    """(id, what merge_row gives) of every id of three pair RDDs."""

    def merged(groups: Iterator[tuple]) -> Iterator[tuple]:
        for key, (bases, lefts, rights) in groups:
            row = merge_row(next(iter(bases), None), next(iter(lefts), Change()), next(iter(rights), Change()))
            if row is not None:
                yield key, row

    one, ours, theirs = base.reduceByKey(min, parts), left.reduceByKey(_united, parts), right.reduceByKey(_united, parts)
    return one.groupWith(ours, theirs).mapPartitions(merged, preservesPartitioning=True)


def merged_table(docs: DataFrame, left: RDD, right: RDD, id_col: str = "doc_id", columns: tuple[str, ...] = ("lang", "source"), text_col: str = "text") -> DataFrame:
    """id_col, columns, text_col (null where the row is gone), n_clean, n_edit_edit, n_edit_delete and n_insert_insert of every id of docs and both branches."""
    rows = _plain(docs, id_col, columns, F.coalesce(text_col, F.lit("")).alias("_text"))
    base = rows.rdd.map(lambda r: (r[0], (tuple(r[1]), r[2])))
    parts = max(base.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    none = (None,) * len(columns), None
    flat = merge(base, left, right, parts).map(lambda x: (x[0], *(x[1][0] or none)[0], (x[1][0] or none)[1], *x[1][1:]))
    kinds = [f"`{id_col}` long", *(f"`{c}` string" for c in columns), f"`{text_col}` string", *(f"n_{k} long" for k in ("clean", "edit_edit", "edit_delete", "insert_insert"))]
    return docs.sparkSession.createDataFrame(flat, ", ".join(kinds), verifySchema=False)


def _plain(docs: DataFrame, id_col: str, columns: tuple[str, ...], more) -> DataFrame:
    """_id, _columns (array of strings without nulls) and one more column of the rows with an id."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("_columns"), more)


def row_shapes(docs: DataFrame, id_col: str = "doc_id", columns: tuple[str, ...] = ("lang", "source"), text_col: str = "text") -> DataFrame:
    """_id, _columns and _lines (the number of lines) of the rows with an id, written to the shared folder: what branches are coded by, without the texts."""
    text = F.coalesce(text_col, F.lit(""))
    return materialize(_plain(docs, id_col, columns, (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("_lines")), "branch-shapes")


def coded_branch(shapes: DataFrame, name: str, shift: int, columns: tuple[str, ...] = ("lang", "source")) -> RDD:
    """A branch that a code decides: crc32("name:id:thing") modulo 17 of each row, column and line (numbered from 0) of row_shapes.

    0 drops it (a column: empties it), 1 and 2 append "!" or "?" to a column or line, 3 and 4 insert such a
    line after a line, or add a row of that text under the id shift - id with the columns of the row.
    """

    def changes(row) -> Iterator[tuple[int, Change]]:
        start = zlib.crc32(f"{name}:{row[0]}:".encode())
        code = lambda thing: zlib.crc32(thing.encode(), start) % 17
        own = code("row")
        cells = {k: (0, "") if c == 0 else (None, MARKS[c]) for k, x in enumerate(columns) if (c := code(x)) <= 2}
        coded = [(i, c) for i in range(row[2]) if (c := code(str(i))) <= 4]
        lines = {i: None if c == 0 else (None, MARKS[c]) for i, c in coded if c <= 2}
        gaps = {i: (MARKS[c],) for i, c in coded if c > 2}
        if own == 0 or cells or lines or gaps:
            yield row[0], Change(own == 0, cells, lines, gaps)
        if own in (3, 4):
            yield shift - row[0], Change(added=(tuple(row[1]), MARKS[own]))

    return shapes.rdd.flatMap(changes)
