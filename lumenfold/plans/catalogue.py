"""The registered queries over the standard tables, each with the same result as DuckDB SQL where SQL can tell it.

Sessions of `documents` are its sources, in the order of doc_id; of `conversations` the
conversations, in the order of turns. Doubles are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import fidelity as V
from lumenfold.functions import patterns as P
from lumenfold.functions import text as T
from lumenfold.operators import compress, gate, graph, induce, lexical, metrics, retrieve, state, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WORDS = "of the and that"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


# SQL fragments ------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def s_any(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {q(pattern)})"


def s_tokens(t: str) -> str:
    return f"[x for x in regexp_split_to_array(lower({t}), {q(P.TOKEN_BREAK)}) if length(x) >= 2]"


def s_words(t: str, pattern: str) -> str:
    return f"[w for w in regexp_extract_all({t}, {q(P.WORD)}) if {s_any('w', pattern)}]"


def s_entities(t: str) -> str:
    parts = [s_words(t, P.ALL_CAPS), f"regexp_extract_all({t}, {q(P.FILE)})", f"regexp_extract_all({t}, {q(P.STEP)})", s_words(t, P.NUMBER), s_words(t, P.ERROR_NAME)]
    both = parts[0]
    for p in parts[1:]:
        both = f"list_concat({both}, {p})"
    return f"list_sort(list_distinct([lower(e) for e in {both}]))"


def s_fit(t: str, kind: str) -> str:
    need = T.required(kind)
    return "(" + " + ".join(f"CAST({s_any(t, '(?i)(?:' + p + ')')} AS INT)" for p in need) + f") / {len(need)}.0"


def s_lost(a: str, b: str, kind: str) -> str:
    need = [f"(?i)(?:{p})" for p in T.required(kind)]
    lost = " + ".join(f"CAST({s_any(a, p)} AND NOT {s_any(b, p)} AS INT)" for p in need)
    had = " + ".join(f"CAST({s_any(a, p)} AS INT)" for p in need)
    return f"({lost}) / greatest({had}, 1)::DOUBLE"


def s_share(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / len({a})::DOUBLE END"


S_DOT = "list_dot_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"

# lexical ------------------------------------------------------------------


@query(f"""
WITH t AS (SELECT doc_id, {s_tokens('text')} AS toks FROM documents),
p AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM t),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p WHERE term IN ({', '.join(q(w) for w in WORDS.split())}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), c AS (SELECT count(*) AS n, avg(len(toks)) AS a FROM t),
s AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score
      FROM tf JOIN df USING (term), c GROUP BY doc_id),
r AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT CAST(rank AS INT) AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10""")
def lexical_topk(spark, d):
    wanted = spark.createDataFrame([(0, WORDS)], "query_id int, query string")
    return lexical.bm25_topk(wanted, read(spark, d, "documents"), 10).select("rank", F.col("id").alias("doc_id"), r6("score").alias("score"))


@query("SELECT doc_id, source FROM documents WHERE lower(text) LIKE '%license%' OR lower(text) LIKE '%token%'")
def contains_any_search(spark, d):
    return lexical.contains_any(read(spark, d, "documents"), ["license", "token"]).select("doc_id", "source")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def passage_contamination(spark, d):
    # candidates share the item's first six words; containment is then confirmed on the whole passage
    start = lambda t: F.slice(T.whitespace_tokens(t), 1, 6)
    items = read(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"), F.size(T.whitespace_tokens(F.col("text"))).alias("n"), F.xxhash64(*[F.get(start(F.col("text")), i) for i in range(1, 5)]).alias("key"))
    words = read(spark, d, "documents").select("doc_id", T.whitespace_tokens(F.col("text")).alias("w"))
    keys = words.select("doc_id", F.explode_outer(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w")), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(4)])))).alias("key"))
    met = keys.join(items, "key").select("doc_id", "item_id", "passage")
    return met.join(read(spark, d, "documents").select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("passage"))).select("doc_id", "item_id").distinct()


@query("SELECT doc_id, CAST(len([x for x in regexp_split_to_array(text, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\p{Z}]+') if x <> '']) AS BIGINT) AS n_tokens FROM documents")
def token_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@query(f"SELECT count(*) AS n_docs, CAST(sum(len({s_tokens('text')})) AS BIGINT) AS total_tokens, round(avg(len({s_tokens('text')})), 6) AS avg_length FROM documents")
def bm25_corpus_stats(spark, d):
    return lexical.corpus_stats(read(spark, d, "documents"), "text").select("n_docs", "total_tokens", r6("avg_length").alias("avg_length"))


# extraction ---------------------------------------------------------------


@query(f"SELECT doc_id, array_to_string({s_entities('text')}, '|') AS entities FROM documents WHERE len({s_entities('text')}) > 0")
def entity_extract(spark, d):
    # behind a generator a filter stays where it is, so the entities are found once
    found = read(spark, d, "documents").select("doc_id", F.explode_outer(F.array(T.entity_texts(F.col("text")))).alias("e"))
    return found.where(F.size("e") > 0).select("doc_id", F.array_join("e", "|").alias("entities"))


@query(f"""WITH t AS (SELECT conv_id, turn, unnest(list_distinct({s_words('text', P.KEY_TOKEN)})) AS token FROM conversations),
f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, token) AS first FROM t)
SELECT c.conv_id, c.turn, count(f.token) AS tokens, count(*) FILTER (WHERE f.first = f.turn) AS new_tokens
FROM conversations c LEFT JOIN f USING (conv_id, turn) GROUP BY ALL""")
def novel_token_first_seen(spark, d):
    return gate.first_seen(read(spark, d, "conversations"), "conv_id", "turn").select(F.col("session").alias("conv_id"), F.col("seq").alias("turn"), "tokens", "new_tokens")


S_FACTS = f"SELECT source AS session, doc_id AS seq, unnest({s_entities('text')}) AS entity FROM documents"


def _facts(spark, d):
    return read(spark, d, "documents").select(F.col("source").alias("session"), F.col("doc_id").alias("seq"), F.explode_outer(T.entity_texts(F.col("text"))).alias("entity")).where("entity IS NOT NULL").withColumn("type", F.lit("entity"))


@query(f"SELECT session, entity, min(seq) AS first_seq, count(*) AS ref_count FROM ({S_FACTS}) GROUP BY ALL")
def fact_ref_counts(spark, d):
    return state.fact_index(_facts(spark, d)).select("session", "entity", F.col("seq").alias("first_seq"), "ref_count")


@query(f"SELECT session, entity, count(*) AS ref_count FROM ({S_FACTS}) GROUP BY ALL HAVING count(*) >= 3")
def high_reference_entities(spark, d):
    return state.high_reference(state.fact_index(_facts(spark, d))).select("session", "entity", "ref_count")


@query(f"SELECT session, seq, entity, count(*) OVER (PARTITION BY session, entity ORDER BY seq RANGE UNBOUNDED PRECEDING) AS ref_count FROM ({S_FACTS})")
def running_ref_count(spark, d):
    return state.running_references(_facts(spark, d)).select("session", "seq", "entity", "ref_count")


S_TIER = " OR ".join(s_any("tok", p) for p in P.TIER_ONE)


@query(f"""WITH t AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), {q(P.ANCHOR_TOKEN)})) AS tok FROM conversations),
n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, tok, count(*) AS df FROM t WHERE length(tok) >= 4 AND tok NOT IN ({', '.join(q(w) for w in P.STOPWORDS)}) AND NOT ({S_TIER}) GROUP BY ALL)
SELECT conv_id, count(*) AS tokens, round(median(ln(1 + n / (1.0 + df))), 6) AS median_idf FROM f JOIN n USING (conv_id) GROUP BY conv_id""")
def anchor_idf_median(spark, d):
    rows = read(spark, d, "conversations")
    toks = rows.select("conv_id", "turn", F.explode(T.anchor_tokens(F.col("text"))).alias("tok")).distinct().where(~T.is_stopword_or_short(F.col("tok")) & ~T.is_tier_one(F.col("tok")))
    df = toks.groupBy("conv_id", "tok").agg(F.count("*").alias("df")).join(rows.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id")
    return df.groupBy("conv_id").agg(F.count("*").alias("tokens"), r6(F.median(F.log(1 + F.col("n") / (1.0 + F.col("df"))))).alias("median_idf"))


# fidelity -----------------------------------------------------------------


@query("SELECT doc_id, " + ", ".join(f"{s_any('text', '(?i)(?:' + p + ')')} AS {t}_{f}" for t, need, f, p in P.SCHEMAS if need) + " FROM documents")
def schema_facts(spark, d):
    text = F.col("text")
    return read(spark, d, "documents").select("doc_id", *[T.has_fact(text, p).alias(f"{t}_{f}") for t, need, f, p in P.SCHEMAS if need])


@query("SELECT doc_id, " + ", ".join(f"1 - {s_fit('text', k)} AS gap_{k}" for k in P.SCHEMA_TYPES) + " FROM documents")
def schema_gap(spark, d):
    return read(spark, d, "documents").select("doc_id", *[T.schema_gap(F.col("text"), k).alias(f"gap_{k}") for k in P.SCHEMA_TYPES])


S_NOVELTY = f"1 - greatest({', '.join(s_fit('text', k) for k in P.SCHEMA_TYPES)})"


@query(f"SELECT doc_id, {S_NOVELTY} AS novelty, {S_NOVELTY} > 0.5 AS is_novel FROM documents")
def schema_fit_novelty(spark, d):
    n = T.schema_novelty(F.col("text"))
    return read(spark, d, "documents").select("doc_id", n.alias("novelty"), (n > 0.5).alias("is_novel"))


S_KIND = "CASE " + " ".join(f"WHEN m = n_{k} AND m > 0 THEN '{k}'" for k in P.SCHEMA_TYPES) + " ELSE '' END"
S_COUNTS = ", ".join(f"CAST(round(({s_fit('text', k)}) * {len(T.required(k))}) AS INT) AS n_{k}" for k in P.SCHEMA_TYPES)


@query(f"WITH c AS (SELECT page_id, html AS text FROM pages), n AS (SELECT page_id, {S_COUNTS} FROM c), g AS (SELECT *, greatest({', '.join('n_' + k for k in P.SCHEMA_TYPES)}) AS m FROM n) SELECT page_id, {S_KIND} AS schema FROM g")
def schema_detect(spark, d):
    return read(spark, d, "pages").select("page_id", T.detect_schema(F.col("html")).alias("schema"))


@query(f"WITH x AS (SELECT doc_id, text, substr(text, 1, CAST(floor(length(text) * 0.4) AS INT)) AS short FROM documents) SELECT doc_id, {s_lost('text', 'short', 'error')} AS gap, round(({s_lost('text', 'short', 'error')}) * (1 - 0.5 * (1 - 0.4)), 6) AS aware FROM x")
def schema_gap_pair_truncated(spark, d):
    text = F.col("text")
    rows = read(spark, d, "documents").select("doc_id", "text", T.truncate(text, 0.4).alias("short"))
    gap = T.schema_gap_pair(text, F.col("short"), "error")
    return rows.select("doc_id", gap.alias("gap"), r6(T.truncation_aware_gap(gap, F.lit(0.4))).alias("aware"))


@query(f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {S_DOT.format('a.embedding', 'b.embedding')} AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(s, 6) AS score FROM r WHERE rank <= 5""")
def vector_topk(spark, d):
    rows = read(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.cosine_topk(asked, rows, 5).select("query_id", "rank", F.col("id").alias("vec_id"), r6("score").alias("score"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({S_DOT.format('a.embedding', 'b.embedding')}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE {S_DOT.format('a.embedding', 'b.embedding')} <= 0.1")
def vector_pair_filter(spark, d):
    rows = read(spark, d, "embeddings")
    pairs = rows.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")).join(rows.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb")), F.col("b") == F.col("a") + 1)
    return vectors.pair_filter(pairs, "va", "vb", 0.1).select("a", "b", r6("cosine").alias("cosine"))


@query(f"""WITH p AS (SELECT a.vec_id AS query_id, a.label AS l, b.label AS m, row_number() OVER (PARTITION BY a.vec_id ORDER BY {S_DOT.format('a.embedding', 'b.embedding')} DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT l AS label, count(*) AS neighbours, round(avg(CAST(l = m AS INT)), 6) AS agreement FROM p WHERE rank <= 5 GROUP BY l""")
def nearest_label_agreement(spark, d):
    rows = read(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = vectors.cosine_topk(asked, rows, 5)
    labels = rows.select(F.col("vec_id").alias("id"), F.col("label").alias("other"))
    own = rows.select(F.col("vec_id").alias("query_id"), "label")
    return near.join(labels, "id").join(own, "query_id").groupBy("label").agg(F.count("*").alias("neighbours"), r6(F.avg((F.col("label") == F.col("other")).cast("int"))).alias("agreement"))


S_NEXT = f"WITH p AS (SELECT a.vec_id, a.label, a.embedding AS va, b.embedding AS vb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), e AS (SELECT vec_id, label, (2 - 2 * {S_DOT.format('va', 'vb')} + ({S_DOT.format('va', 'va')} - 1) + ({S_DOT.format('vb', 'vb')} - 1)) / 4 AS epe FROM p)"


def _pairs(spark, d):
    rows = read(spark, d, "embeddings")
    return rows.select("vec_id", "label", F.col("embedding").alias("va")).join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("vb")), "vec_id")


@query(S_NEXT + " SELECT vec_id, label, round(epe, 6) AS epe, round((epe - avg(epe) OVER (PARTITION BY label)) / greatest(stddev_pop(epe) OVER (PARTITION BY label), 1e-9), 5) AS z FROM e")
def epe_zscore(spark, d):
    rows = _pairs(spark, d).select("vec_id", "label", V.epe(F.col("va"), F.col("vb")).alias("epe"))
    return rows.select("vec_id", "label", r6("epe").alias("epe"), F.round(V.z_score(F.col("epe"), Window.partitionBy("label")), 5).alias("z"))


@query(f"WITH x AS (SELECT doc_id, text, substr(text, 1, CAST(floor(length(text) * 0.5) AS INT)) AS short FROM documents), g AS (SELECT doc_id, 1 - length(short) / greatest(length(text), 1)::DOUBLE AS cosine, {s_lost('text', 'short', 'deployment')} AS gap FROM x) SELECT doc_id, round(cosine, 6) AS cosine, gap, round(0.5 * cosine + 0.5 * gap, 6) AS combined, round(least(greatest(0.6 * cosine + 0.4 * gap, 0), 1), 6) AS r_build FROM g")
def r_build_components(spark, d):
    text = F.col("text")
    rows = read(spark, d, "documents").select("doc_id", "text", T.truncate(text, 0.5).alias("short"))
    cosine = 1 - F.char_length("short") / F.greatest(F.char_length(text), F.lit(1)).cast("double")
    gap = T.schema_gap_pair(text, F.col("short"), "deployment")
    return rows.select("doc_id", r6(cosine).alias("cosine"), gap.alias("gap"), r6(V.combined_epe(cosine, gap)).alias("combined"), r6(V.r_build(cosine, gap)).alias("r_build"))


S_BY = lambda place: "CASE kind " + " ".join(f"WHEN '{k}' THEN {v[place]}" for k, v in P.BUDGETS.items()) + " END"
KINDS = list(P.BUDGETS)


@query(f"""WITH x AS (SELECT doc_id, source, n_chars::DOUBLE AS n, list_extract(['{"', '".join(KINDS)}'], CAST(doc_id % 6 AS INT) + 1) AS kind,
len([m for m in regexp_extract_all(text, '[0-9]+') if regexp_matches(m, '^[45][0-9][0-9]$')]) > 0 AS art, (doc_id % 10) / 10.0 AS conf FROM documents),
z AS (SELECT *, (n - avg(n) OVER (PARTITION BY source)) / greatest(stddev_pop(n) OVER (PARTITION BY source), 1e-9) AS z FROM x),
f AS (SELECT *, CASE WHEN conf < 0.5 THEN ({S_BY(0)}) * conf + 0.2 * (1 - conf) ELSE {S_BY(0)} END AS floor FROM z)
SELECT doc_id, kind, round(CASE WHEN art THEN 1.0 ELSE greatest(0.3, least(1.0, floor + ({S_BY(1)}) * z)) END, 5) AS budget FROM f""")
def budget_plan(spark, d):
    rows = read(spark, d, "documents")
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 6).cast("int"))
    z = V.z_score(F.col("n_chars").cast("double"), Window.partitionBy("source"))
    number = F.exists(T.artifacts(F.col("text")), lambda a: a.rlike("^[45][0-9][0-9]$"))
    planned = rows.select("doc_id", kind.alias("kind"), z.alias("z"), number.alias("art"), ((F.col("doc_id") % 10) / 10.0).alias("conf"))
    return planned.select("doc_id", "kind", F.round(V.budget_plan(F.col("z"), F.col("kind"), F.col("art"), F.col("conf")), 5).alias("budget"))


# compression --------------------------------------------------------------


@query("SELECT doc_id, md5(substr(text, 1, CAST(floor(length(text) * 0.5) AS INT))) AS short FROM documents")
def truncate_compress(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.truncate(F.col("text"), 0.5)).alias("short"))


@query("""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS s, unnest(range(len(parts))) AS pos FROM p),
t AS (SELECT doc_id, pos, trim(s) AS s FROM l WHERE trim(s) <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(s) ORDER BY pos) AS n FROM t)
SELECT doc_id, count(*) AS sentences, md5(string_agg(s, ' ' ORDER BY pos)) AS short FROM f WHERE n = 1 GROUP BY doc_id""")
def dedupe_sentences(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(T.dedup_sentences(F.col("text"))).alias("pos", "s")).select("doc_id", "pos", F.trim("s").alias("s")).where("s <> ''")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", F.lower("s")).orderBy("pos"))).where("n = 1")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), " ")
    return first.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.md5(joined).alias("short"))


@query(f"""WITH p AS (SELECT doc_id, [trim(x) for x in string_split(regexp_replace(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)) if trim(x) <> ''] AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS s, unnest(range(len(parts))) AS pos, len(parts) AS n FROM p),
k AS (SELECT doc_id, pos, n, unnest(regexp_extract_all(lower(s), '[a-z0-9_/\\.]+')) AS tok FROM l),
tf AS (SELECT doc_id, pos, n, tok, count(*) AS c FROM k GROUP BY ALL),
w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, tok) AS df, sum(c) OVER (PARTITION BY doc_id, pos) AS total FROM tf),
b AS (SELECT doc_id, pos, sum(c / total * (ln((n + 1) / (df + 1)) + 1)) AS base FROM w GROUP BY ALL),
s AS (SELECT l.doc_id, l.pos, round(coalesce(base, 0) + 0.3 * len(regexp_extract_all(s, {q(P.HIGH_VALUE)})), 6) AS score FROM l LEFT JOIN b USING (doc_id, pos)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM s)
SELECT doc_id, CAST(rank AS INT) AS rank, CAST(pos AS INT) AS pos, score FROM r WHERE rank <= 3""")
def extractive_topk(spark, d):
    scored = compress.sentence_scores(read(spark, d, "documents")).select(F.col("id").alias("doc_id"), "pos", r6("score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")))
    return ranked.where("rank <= 3").select("doc_id", "rank", "pos", "score")


@query("WITH b AS (SELECT CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.3 WHEN 2 THEN 0.5 ELSE 0.95 END AS b FROM documents) SELECT count(*) AS segments, round(avg(b), 6) AS mean_budget, count(*) FILTER (WHERE b >= 0.95) AS high, count(*) FILTER (WHERE b <= 0.35) AS low FROM b")
def compression_report(spark, d):
    k = F.col("doc_id") % 4
    plans = read(spark, d, "documents").select(F.when(k == 0, 1.0).when(k == 1, 0.3).when(k == 2, 0.5).otherwise(0.95).alias("budget"))
    return compress.report(plans).withColumn("mean_budget", r6("mean_budget"))


@query(r"""WITH a AS (SELECT DISTINCT unnest([n for n in regexp_extract_all(text, '[0-9]+') if regexp_matches(n, '^[45][0-9][0-9]$')]) AS x, doc_id % 2 AS half FROM documents),
f AS (SELECT DISTINCT x FROM a WHERE half = 0), t AS (SELECT DISTINCT x FROM a WHERE half = 1),
c AS (SELECT (SELECT count(*) FROM f JOIN t USING (x)) AS hits, (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM t) AS nt),
m AS (SELECT hits, CASE WHEN nt > 0 THEN hits / nt ELSE 0.0 END AS recall, CASE WHEN nf > 0 THEN hits / nf ELSE 0.0 END AS prec FROM c)
SELECT hits, round(recall, 6) AS recall, round(prec, 6) AS precision, round(CASE WHEN recall + prec > 0 THEN 2 * recall * prec / (recall + prec) ELSE 0.0 END, 6) AS f1 FROM m""")
def artifact_f1(spark, d):
    rows = read(spark, d, "documents").select(F.explode(T.artifacts(F.col("text"))).alias("artifact"), (F.col("doc_id") % 2).alias("half")).where(F.col("artifact").rlike("^[45][0-9][0-9]$"))
    return metrics.artifact_score(rows.where("half = 0"), rows.where("half = 1")).select("hits", r6("recall").alias("recall"), r6("precision").alias("precision"), r6("f1").alias("f1"))


# questions ----------------------------------------------------------------

S_CLASS = f"CASE WHEN {s_any('text', '(?i)' + '|'.join(f'(?:{p})' for p in P.PRECISION))} AND {s_any('text', '|'.join(f'(?:{p})' for p in P.LOOKUP))} THEN 'ambiguous' WHEN {s_any('text', '(?i)' + '|'.join(f'(?:{p})' for p in P.PRECISION))} THEN 'precision' WHEN {s_any('text', '|'.join(f'(?:{p})' for p in P.LOOKUP))} THEN 'entity' ELSE 'context' END"


@query(f"SELECT conv_id, turn, {S_CLASS} AS class FROM conversations")
def query_classify(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.query_class(F.col("text")).alias("class"))


S_TYPE = f"CASE WHEN len([e for e in {s_entities('text')} if contains(e, '.') OR contains(e, 'error') OR contains(e, 'step') OR regexp_matches(e, '^[0-9]')]) > 0 THEN 'entity' WHEN {s_any('lower(text)', P.VERIFY_ANY)} AND ({s_any('lower(text)', P.VERIFY_TRUTH)} OR {s_any('lower(text)', P.VERIFY_START)}) THEN 'verification' " + " ".join(f"WHEN {s_any('lower(text)', p)} THEN '{k}'" for k, p in P.QUESTION_RULES) + " ELSE 'unknown' END"


@query(f"WITH t AS (SELECT conv_id, turn, {S_TYPE} AS qa_type FROM conversations WHERE role = 'user') SELECT *, CAST(CASE qa_type " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in P.POLICY.items()) + " END AS INT) AS k, CASE qa_type " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in P.POLICY.items()) + " END AS route FROM t")
def qa_type_policy(spark, d):
    typed = read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.question_type(F.col("text")).alias("qa_type"))
    k, route = T.policy(F.col("qa_type"))
    return typed.select("conv_id", "turn", "qa_type", k.alias("k"), route.alias("route"))


@query(f"SELECT a.doc_id, round({s_share('a.e', 'b.e')}, 6) AS confidence FROM (SELECT doc_id, {s_entities('text')} AS e FROM documents) a JOIN (SELECT doc_id, {s_entities('text')} AS e FROM documents) b ON b.doc_id = a.doc_id + 1")
def query_confidence(spark, d):
    e = read(spark, d, "documents").select("doc_id", T.entity_texts(F.col("text")).alias("e"))
    return e.join(e.select((F.col("doc_id") - 1).alias("doc_id"), F.col("e").alias("c")), "doc_id").select("doc_id", r6(V.share(F.col("e"), F.col("c"))).alias("confidence"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, {s_words('text', '^[A-Z][a-z]+$')} AS e FROM conversations),
n AS (SELECT conv_id, turn, role, list_distinct(e) AS e, list_distinct(lead(e) OVER (PARTITION BY conv_id ORDER BY turn)) AS a, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM t)
SELECT conv_id, turn, round({s_share('a', 'e')}, 6) AS support, round({s_share('e', 'a')}, 6) AS coverage, round(least(1.0, 0.5 * ({s_share('a', 'e')}) + 0.3 * ({s_share('e', 'a')}) + 0.2), 6) AS confidence FROM n WHERE role = 'user' AND r = 'assistant'""")
def answer_confidence(spark, d):
    names = F.array_distinct(F.filter(T.words(F.col("text")), lambda w: w.rlike("^[A-Z][a-z]+$")))
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role", names.alias("e")).withColumn("a", F.lead("e").over(order)).withColumn("r", F.lead("role").over(order)).where("role = 'user' AND r = 'assistant'")
    support, cover, c = V.answer_confidence(F.col("e"), F.col("e"), F.col("a"), F.lit(1.0))
    return rows.select("conv_id", "turn", r6(support).alias("support"), r6(cover).alias("coverage"), r6(c).alias("confidence"))


S_POLAR = " OR ".join(f"(contains(lower(a.text), '{x}') AND contains(lower(b.text), '{y}')) OR (contains(lower(a.text), '{y}') AND contains(lower(b.text), '{x}'))" for x, y in P.POLARITY)


@query(f"SELECT a.conv_id, a.turn, b.turn AS stale_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE {S_POLAR}")
def contradiction_pairs(spark, d):
    rows = read(spark, d, "conversations").withColumn("vector", F.array(F.lit(0.0)))
    return state.contradictions(rows, "conv_id", "turn").select(F.col("session").alias("conv_id"), F.col("seq").alias("turn"), F.col("stale_seq").alias("stale_turn"))


# graph and cache ----------------------------------------------------------

S_EDGES = "WITH n AS (SELECT DISTINCT l_orderkey AS call, l_suppkey AS node FROM lineitem), e AS (SELECT a.node AS a, b.node AS b, count(*) AS count FROM n a JOIN n b ON a.call = b.call AND a.node < b.node GROUP BY ALL), w AS (SELECT *, count / (count + 2.0) AS weight FROM e)"


def _edges(spark, d):
    return graph.edges(read(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query(S_EDGES + " SELECT a, b, count, round(weight, 6) AS weight FROM w")
def co_retrieval_edges(spark, d):
    return _edges(spark, d).withColumn("weight", r6("weight"))


@query(S_EDGES + ", s AS (SELECT a AS node, b AS neighbor, weight FROM w UNION ALL SELECT b, a, weight FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, neighbor) AS rank FROM s WHERE weight >= 0.2) SELECT node, CAST(rank AS INT) AS rank, neighbor, round(weight, 6) AS weight FROM r WHERE rank <= 3")
def graph_neighbors(spark, d):
    return graph.neighbors(_edges(spark, d)).withColumn("weight", r6("weight"))


@query(S_EDGES + " SELECT a, b, count, round(weight * 0.95 * 0.95, 6) AS weight FROM w WHERE weight * 0.95 * 0.95 >= 0.35")
def graph_decay(spark, d):
    return graph.decay(_edges(spark, d), 2, 0.95, 0.35).withColumn("weight", r6("weight"))


S_LOG = "SELECT user_id, event_type, count(*) AS tokens, max(event_id) AS turn, count(*) FILTER (WHERE value > 50) AS hits, count(*) FILTER (WHERE value <= 10) AS misses FROM events GROUP BY ALL"


@query(f"""WITH e AS ({S_LOG}), n AS (SELECT *, max(turn) OVER w AS mt, max(hits) OVER w AS mh, max(misses) OVER w AS mm FROM e WINDOW w AS (PARTITION BY event_type)),
s AS (SELECT *, 0.3::DOUBLE * (turn / mt::DOUBLE) + 0.4::DOUBLE * CASE WHEN mm > 0 THEN misses / mm::DOUBLE ELSE 0.0 END - 0.2::DOUBLE * CASE WHEN mh > 0 THEN hits / mh::DOUBLE ELSE 0.0 END + 0.1::DOUBLE * 0.5::DOUBLE AS score FROM n),
l AS (SELECT *, sum(tokens) OVER (PARTITION BY event_type) - coalesce(sum(tokens) OVER (PARTITION BY event_type ORDER BY score DESC, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over FROM s)
SELECT event_type, user_id, round(score, 6) AS score, left_over > 0.7 * 1000 AS evicted FROM l""")
def eviction_prefix(spark, d):
    entries = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("tokens"), F.max("event_id").alias("turn"), F.count_if(F.col("value") > 50).alias("hits"), F.count_if(F.col("value") <= 10).alias("misses")).withColumn("novelty", F.lit(0.5))
    return state.evict(entries, 1000, ["event_type"], "user_id").select("event_type", "user_id", r6("score").alias("score"), "evicted")


@query("SELECT user_id AS key, count(*) FILTER (WHERE event_type = 'error') AS misses, count(*) FILTER (WHERE event_type <> 'error') AS hits, max(event_id) AS last_turn FROM events GROUP BY user_id")
def miss_counters(spark, d):
    return state.miss_counters(read(spark, d, "events"), "user_id", "event_id", "event_type", F.col("event_type") == "error")


# retrieval ----------------------------------------------------------------


# metrics ------------------------------------------------------------------


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus <> 'P') AS episodes, count(*) FILTER (WHERE o_orderstatus = 'P') AS errors, round(avg(o_totalprice) FILTER (WHERE o_orderstatus <> 'P'), 3) AS mean_score, round(coalesce(stddev_pop(o_totalprice) FILTER (WHERE o_orderstatus <> 'P'), 0), 3) AS std_score, CAST(sum(o_custkey) FILTER (WHERE o_orderstatus <> 'P') AS BIGINT) AS original_tokens FROM orders GROUP BY o_orderpriority")
def episode_metrics(spark, d):
    rows = read(spark, d, "orders").select("o_orderpriority", F.col("o_totalprice").alias("score"), F.lit(0.5).alias("compression_ratio"), F.col("o_custkey").alias("original_tokens"), F.col("o_custkey").alias("compressed_tokens"), F.when(F.col("o_orderstatus") == "P", "pending").alias("error"))
    return metrics.episode_metrics(rows, ["o_orderpriority"]).select("o_orderpriority", "episodes", "errors", F.round("mean_score", 3).alias("mean_score"), F.round("std_score", 3).alias("std_score"), "original_tokens")


@query("WITH m AS (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) SELECT event_type, round(avg(m), 5) AS mean_of_means, count(*) AS groups FROM m GROUP BY event_type")
def probe_two_level_mean(spark, d):
    return metrics.two_level_mean(read(spark, d, "events"), ["event_type"], "user_id", "value").withColumn("mean_of_means", F.round("mean_of_means", 5))


# schema induction, over the parameters of page addresses and the fields in pages --


S_FIELDS = r"""list_sort(list_distinct(list_concat(regexp_extract_all({0}, '"([^"]+)"\s*:', 1), regexp_extract_all({0}, '\b([a-zA-Z_][a-zA-Z0-9_]*)\s*[:=]\s*([^,\n}}]+)', 1))))"""


@query(f"SELECT event_id, array_to_string({S_FIELDS.format('props')}, '|') AS fields FROM events")
def key_signature(spark, d):
    return read(spark, d, "events").select("event_id", F.array_join(induce.signature(F.col("props"))["fields"], "|").alias("fields"))


S_PAGES = f"""a AS (SELECT page_id AS id, {S_FIELDS.format('artifact')} AS f FROM (SELECT page_id, replace(regexp_extract(coalesce(url, ''), '\\?([^#]*)', 1), '&', chr(10)) || chr(10) || coalesce(html, '') AS artifact FROM pages)),
s AS (SELECT f, min(id) AS id, count(*) AS n FROM a GROUP BY f),
e AS (SELECT x.id AS a, y.id AS b, x.n AS pages_a, y.n AS pages_b, 1 - len(list_intersect(x.f, y.f)) / len(list_distinct(list_concat(x.f, y.f)))::DOUBLE AS distance FROM s x JOIN s y ON x.id <> y.id WHERE distance <= 0.30)"""
S_FAMILIES = f"""WITH RECURSIVE {S_PAGES}, r AS (SELECT id, id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a),
c AS (SELECT id, min(root) AS family FROM r GROUP BY id),
m AS (SELECT a.id, c.family, a.f, count(*) OVER (PARTITION BY c.family) AS members FROM a JOIN s USING (f) JOIN c ON c.id = s.id)"""


def _pages(spark, d):
    """artifact_id and artifact of each page: the parameters of its address, one a line, and its HTML."""
    parameters = F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1), "&", "\n")
    return read(spark, d, "pages").select(F.col("page_id").alias("artifact_id"), F.concat(parameters, F.lit("\n"), F.coalesce("html", F.lit(""))).alias("artifact"))


@query(f"WITH {S_PAGES} SELECT a, b, round(distance, 6) AS distance, pages_a, pages_b FROM e WHERE a < b")
def page_close_sets(spark, d):
    sets = induce.field_sets(_pages(spark, d))
    sizes = lambda side: sets.select(F.col("first").alias(side), F.col("members").alias(f"pages_{side}"))
    return induce.close_sets(sets).join(sizes("a"), "a").join(sizes("b"), "b").select("a", "b", r6("distance").alias("distance"), "pages_a", "pages_b")


@query(f"{S_FAMILIES} SELECT id AS page_id, family, members FROM m WHERE members >= 2")
def page_families(spark, d):
    return induce.families(_pages(spark, d), least=2).select(F.col("id").alias("page_id"), "family", "members")


@query(f"{S_FAMILIES}, u AS (SELECT family, members, unnest(f) AS field FROM m WHERE members >= 5) SELECT family, field, round(count(*) / members::DOUBLE, 6) AS share, count(*) / members::DOUBLE >= 0.8 AS required FROM u GROUP BY family, members, field HAVING count(*) / members::DOUBLE >= 0.2")
def page_induced_fields(spark, d):
    return induce.induced_fields(induce.families(_pages(spark, d), least=5)).withColumn("share", r6("share"))


# pipelines ----------------------------------------------------------------


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts))) AS BIGINT) + 1800 AS end_s, count(*) AS events FROM s GROUP BY user_id, n""")
def session_windows(spark, d):
    from lumenfold.streaming.gate import session_windows as windows

    # wall-clock seconds, whatever the session's zone: timestamps without a zone are taken as they are
    out = windows(read(spark, d, "events"))
    wall = lambda c: F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")
    return out.select("user_id", wall("session_start").alias("start_s"), wall("session_end").alias("end_s"), "events")
