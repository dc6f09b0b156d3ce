"""Ranked lexical retrieval and plain containment search."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenfold.functions import patterns as P
from lumenfold.functions.text import lexical_tokens
from lumenfold.operators.ordered import stage
from lumenfold.operators.vectors import best_of

K1, B = 1.5, 0.75


#: Query terms that are looked for within a document's tokens; beyond so many, tokens and terms meet by a join.
MOST_TERMS = 10_000
#: Terms times queries that a batch of documents is multiplied with; beyond, query terms meet postings by a join.
MOST_WEIGHTS = 4_194_304


def postings(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame | None = None) -> DataFrame:
    """(id, length, term, tf) of every document's terms; with `wanted` (term) only of these."""
    return counted(matched(docs, id_col, text_col, wanted), wanted)


def matched(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame | None = None) -> DataFrame:
    """(id, length, terms): the number of a document's tokens and its terms with their counts; of a bounded set of wanted terms, only these."""
    some = None if wanted is None else wanted.distinct().limit(MOST_TERMS + 1).collect()
    terms = None if some is None or len(some) > MOST_TERMS else {r["term"] for r in some}
    token = re.compile(P.LEXICAL_TOKEN, re.ASCII)

    def count(texts: pa.Array) -> pa.Array:
        lengths, offsets, names, times = [], [0], [], []
        for t in texts:
            tokens = token.findall(t.as_py()) if t.is_valid else ()
            held = Counter(tokens if terms is None else [x for x in tokens if x in terms])
            lengths.append(len(tokens))
            names += held.keys()
            times += held.values()
            offsets.append(len(names))
        pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(times, pa.int64())], ["term", "tf"])
        return pa.StructArray.from_arrays([pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], ["length", "terms"])

    found = F.arrow_udf(count, "length int, terms array<struct<term: string, tf: bigint>>")(F.lower(F.col(text_col)))
    return docs.select(F.col(id_col).alias("id"), found.alias("x")).select("id", "x.length", "x.terms")


def counted(rows: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """(id, length, term, tf) of what `matched` gives."""
    # the outer form: the inner one would work the tokens out once more, in a filter on them
    long = rows.select("id", "length", F.explode_outer("terms").alias("x")).where("x IS NOT NULL").select("id", "length", "x.*")
    long = long if wanted is None else long.join(wanted.select("term").distinct(), "term", "left_semi")
    return long.groupBy("id", "length", "term").agg(F.sum("tf").alias("tf"))


def corpus_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: n_docs, total_tokens, avg_length. Documents without tokens count as documents."""
    return _stats(docs.select(F.coalesce(F.size(lexical_tokens(F.col(text_col))), F.lit(0)).alias("length")))


def _stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_tokens"), F.avg("length").alias("avg_length"))


def query_terms(queries: DataFrame, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    return queries.select(F.col(query_id).alias("query_id"), F.explode(lexical_tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 10, query_id: str = "query_id", query_text: str = "query", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, id, score): the k best documents of each query.

    Texts are read once: what is written of them is their length and the tokens that a query names, so only these are
    shuffled, and documents that share no term are never scored. A repeated query term counts twice; equal scores go to smaller ids.
    """
    terms = query_terms(queries, query_id, query_text)
    wanted = terms.select("term").distinct()
    rows = stage(matched(docs, id_col, text_col, wanted), "matched")
    asked = _bounded(terms)
    if asked is None:
        return ranked(terms, counted(rows, wanted), _stats(rows), k)
    return scored(asked, rows, _stats(rows), k, *[t.dataType.simpleString() for t in (terms.schema["query_id"], rows.schema["id"])])


def _bounded(terms: DataFrame) -> list | None:
    """The rows of query terms, if terms times queries stay within MOST_WEIGHTS."""
    rows = terms.limit(MOST_WEIGHTS // 32 + 1).collect()
    few = len(rows) <= MOST_WEIGHTS // 32 and len({r["term"] for r in rows}) * len({r["query_id"] for r in rows}) <= MOST_WEIGHTS
    return rows if few else None


def scored(terms: list, rows: DataFrame, stats: DataFrame, k: int, query_type: str, id_type: str) -> DataFrame:
    """As `ranked`, of a bounded number of query terms and what `matched` gives: a document's row meets all queries at once.

    A batch of documents is multiplied with the queries' weights and keeps k a query, so no row stands for a document and a query.
    """
    # rows of one id are one document where they are as long, and are added up where not
    whole = rows.where("size(terms) > 0").repartition("id").groupBy("id", "length").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    whole = stage(whole.groupBy("id").agg(F.collect_list(F.struct("length", "terms")).alias("docs")), "documents")
    names = sorted({r["term"] for r in terms})
    asked = sorted({r["query_id"] for r in terms if r["query_id"] is not None}) + [None] * any(r["query_id"] is None for r in terms)
    held = whole.select(F.explode("docs").alias("x")).select(F.explode(F.array_distinct("x.terms.term")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = {r["term"]: r["df"] for r in held.where(F.col("term").isin(names)).collect()}  # as many as terms, at most
    n, mean = stats.select("n_docs", "avg_length").first()
    place, at = {t: i for i, t in enumerate(names)}, {q: i for i, q in enumerate(asked)}
    weights = np.zeros((len(names), len(asked)))
    for r in terms:
        if r["term"] in df:
            weights[place[r["term"]], at[r["query_id"]]] = r["times"] * np.log((n - df[r["term"]] + 0.5) / (df[r["term"]] + 0.5) + 1) * (K1 + 1)
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(asked), -np.inf)
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("id")))
            made = np.zeros((len(batch), len(names)))
            for i, docs in enumerate(batch.column("docs").to_pylist()):
                for doc in docs:
                    tf = Counter()
                    for x in doc["terms"]:
                        tf[x["term"]] += x["tf"]
                    for t, many in tf.items():
                        if t in place:
                            made[i, place[t]] += many / (many + K1 * (1 - B + B * doc["length"] / mean))
            scores = (made @ sent.value).T
            if len(batch) >= k and len(asked):
                least = np.maximum(least, np.partition(scores, len(batch) - k, axis=1)[:, -k])
            # what may be among the k by rounded scores: the margin is twice a unit of the ninth place
            queries, places = np.nonzero((scores >= (least - 2e-9)[:, None]) & (scores > 0))
            found = scores[queries, places]
            some = best_of(queries, places, found, k)
            ids = pa.array([asked[q] for q in queries[some]], kinds[0])
            yield pa.RecordBatch.from_arrays([ids, batch.column("id").take(pa.array(places[some])), pa.array(found[some], pa.float64())], names=["query_id", "id", "score"])

    schema = f"query_id {query_type}, id {id_type}, score double"
    kinds = to_arrow_schema(StructType.fromDDL(schema)).types
    out = whole.mapInArrow(run, schema).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def ranked(terms: DataFrame, hits: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score) of query terms (query_id, term, times) and all postings of these terms (id, length, term, tf)."""
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    scored = hits.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("part", part).join(terms, "term")  # stats is one row
    total = scored.groupBy("query_id", "id").agg(F.sum(F.col("part") * F.col("times")).alias("score")).where("score > 0")
    out = total.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")))  # sums differ in their last digits from run to run
    return out.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


@dataclass(frozen=True)
class Index:
    """A ranked index: base postings sorted by term with the documents' lengths, and what changed since.

    gone has the ids of base documents that are out; added and added_lengths what came in. A document is in the base or
    added, not both. `compact` makes a new base of it.
    """

    base: DataFrame
    lengths: DataFrame
    added: DataFrame | None = None
    added_lengths: DataFrame | None = None
    gone: DataFrame | None = None

    def _live(self, base: DataFrame, added: DataFrame | None) -> DataFrame:
        kept = base if self.gone is None else base.join(self.gone, "id", "left_anti")
        return kept if added is None else kept.unionByName(added)

    def documents(self) -> DataFrame:
        """(id, length) of what is indexed now."""
        return self._live(self.lengths, self.added_lengths)

    def postings(self, wanted: DataFrame | None = None) -> DataFrame:
        """(id, length, term, tf) now, of the wanted terms."""
        cut = lambda rows: rows if wanted is None or rows is None else rows.join(wanted.select("term").distinct(), "term", "left_semi")
        return self._live(cut(self.base), cut(self.added)).select("id", "length", "term", "tf")

    def search(self, queries: DataFrame, k: int = 10, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
        """As bm25_topk over the texts that are indexed now."""
        terms = query_terms(queries, query_id, query_text)
        hits, stats, asked = stage(self.postings(terms), "hits"), _stats(self.documents()), _bounded(terms)
        if asked is None:
            return ranked(terms, hits, stats, k)
        rows = hits.groupBy("id", "length").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
        return scored(asked, rows, stats, k, *[t.dataType.simpleString() for t in (terms.schema["query_id"], hits.schema["id"])])


def _sorted(rows: DataFrame) -> DataFrame:
    """Postings written in ranges of terms, so that a file's statistics tell which terms it can hold."""
    return stage(rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), "postings")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """An index of documents; rows that repeat an id are one document, the least text. Null ids take no part."""
    once = stage(matched(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(text_col).alias(text_col)), id_col, text_col), "tokens")
    return Index(_sorted(counted(once, None)), once.select("id", "length"))


def change(index: Index, changes: DataFrame, at: str = "at", id_col: str = "id", op: str = "op", text_col: str = "text") -> Index:
    """The index after changes in the order of `at`: op 'add' of an id that is indexed is a no-op, 'remove' takes it out; a later 'add' puts it in again.

    What the order comes to is found by aggregates: an id's last removal, and the first addition after it (or at all). Only
    postings of what is added are made, the base is left as it is. Two changes of an id at one time are not allowed.
    """
    rows = changes.select(F.col(id_col).alias("id"), F.col(at).alias("at"), F.col(op).alias("op"), F.col(text_col).alias("text")).where("id IS NOT NULL AND op IN ('add', 'remove')")
    last = rows.groupBy("id").agg(F.max(F.when(F.col("op") == "remove", F.col("at"))).alias("out"))
    came = rows.join(last, "id").where((F.col("op") == "add") & (F.col("out").isNull() | (F.col("at") > F.col("out")))).groupBy("id").agg(F.min_by("text", "at").alias("text"))
    out = stage(last.where("out IS NOT NULL").select("id"), "gone")
    live = index.documents().join(out, "id", "left_anti").select("id")
    fresh = stage(matched(came.join(live, "id", "left_anti"), "id", "text"), "tokens")
    keep = lambda rows: None if rows is None else rows.join(out, "id", "left_anti")
    both = lambda one, two: stage(two if one is None else keep(one).unionByName(two), "added")
    gone = out.join(index.lengths.select("id"), "id", "left_semi")
    gone = stage(gone if index.gone is None else gone.unionByName(index.gone).distinct(), "gone")
    return Index(index.base, index.lengths, both(index.added, counted(fresh, None)), both(index.added_lengths, fresh.select("id", "length")), gone)


def compact(index: Index) -> Index:
    """The same index with its changes worked into a new base."""
    return Index(_sorted(index.postings()), stage(index.documents(), "lengths"))


def contains_any(docs: DataFrame, words: list[str], text_col: str = "text") -> DataFrame:
    """Documents that contain one of the words, ASCII case aside; no wildcards."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower(F.col(text_col)).contains(w.lower())
    return docs.where(hit)


def search(docs: DataFrame, query: str, limit: int = 10, id_col: str = "doc_id", text_col: str = "text", session_col: str | None = None, session: str | None = None) -> DataFrame:
    """Ranked search, containment where that finds nothing, and else the first rows; within a session unless none is given."""
    scope = docs.where(F.col(session_col) == session) if session_col and session is not None else docs
    spark = docs.sparkSession
    best = bm25_topk(spark.createDataFrame([(0, query)], "query_id int, query string"), scope, limit, id_col=id_col, text_col=text_col).select("rank", "id", "score")
    first = lambda rows: rows.select(F.col(id_col).alias("id")).orderBy("id").limit(limit)
    tries = [best.select(F.lit(0).alias("try"), "rank", "id", "score")]
    for i, rows in enumerate((first(contains_any(scope, query.split(), text_col)), first(scope)), 1):
        tries.append(rows.select(F.lit(i).alias("try"), F.row_number().over(Window.orderBy("id")).alias("rank"), "id", F.lit(0.0).alias("score")))  # `limit` rows at most
    found = tries[0].unionByName(tries[1]).unionByName(tries[2])  # a few rows
    return found.withColumn("best", F.min("try").over(Window.partitionBy())).where("try = best").select("rank", "id", "score")
