"""More registered queries: stores, look-ups, routes, summaries and scalar functions, each with its SQL. They go into the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions import fidelity as V
from lumenfold.functions import patterns as P
from lumenfold.functions import text as T
from lumenfold.operators import compress, gate, graph, lexical, memory, metrics, retrieve, state, vectors
from lumenfold.operators.ordered import stage
from lumenfold.plans.catalogue import KINDS, S_BY, S_COUNTS, S_DOT, S_EDGES, S_FACTS, S_KIND, _edges, _facts, _pairs, q, query, r6, read, s_any, s_fit, s_share, s_words

S_TOKENS = lambda t: f"len([x for x in regexp_split_to_array({t}, '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\p{{Z}}]+') if x <> ''])"
TYPED = [("file_path", P.FILE), ("error_code", r"[A-Z][A-Z_]+Error|HTTP [0-9]{3}|[0-9]{3} [A-Z]+"), ("step_reference", r"(?i)step\s+[0-9]+|\[step\s+[0-9]+\]")]
S_NUMBERS = "[n for n in regexp_extract_all(text, '[0-9]+') if regexp_matches(n, '^[45][0-9][0-9]$')]"
S_ARTIFACTS = f"list_distinct(list_concat(list_concat(regexp_extract_all(text, {q(P.ARTIFACTS[0])}), regexp_extract_all(text, {q(P.ARTIFACTS[1])})), list_concat(regexp_extract_all(text, '(^|[^\\p{{L}}\\p{{N}}_])(/api/[^\\s,;\"'']+)', 2), {S_NUMBERS})))"
S_TYPE_OF = "CASE WHEN starts_with(lower(a), 'src/') OR regexp_matches(lower(a), '\\.(ts|py|js|go|java)$') THEN 'file' WHEN starts_with(lower(a), '/api/') THEN 'endpoint' WHEN regexp_matches(a, '^[0-9]+$') OR regexp_matches(a, '^[45]') THEN 'error' ELSE 'variable' END"


# scalar functions over whole tables ---------------------------------------


@query(" UNION ALL ".join(f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, {q(p)}))) AS entity, '{k}' AS type FROM documents" for k, p in TYPED))
def typed_entities(spark, d):
    return state.fact_rows(read(spark, d, "documents"), "source", "doc_id").select(F.col("seq").alias("doc_id"), "entity", "type")


@query(f"WITH x AS (SELECT doc_id, unnest({S_ARTIFACTS}) AS a FROM documents) SELECT doc_id, a AS artifact, {S_TYPE_OF} AS kind FROM x")
def artifact_extract(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.explode_outer(T.artifacts(F.col("text"))).alias("artifact")).where("artifact IS NOT NULL")
    return rows.select("doc_id", "artifact", T.artifact_type(F.col("artifact")).alias("kind"))


@query(f"WITH x AS (SELECT doc_id, unnest({S_ARTIFACTS}) AS a FROM documents), k AS (SELECT lower(a) AS key, a, doc_id FROM x) SELECT key, {S_TYPE_OF.replace('lower(a)', 'key').replace('(a,', '(key,')} AS type, max(doc_id) AS turn FROM k GROUP BY key")
def artifact_last_mention(spark, d):
    return state.artifact_index(read(spark, d, "documents"), "doc_id").select("key", "type", "turn")


@query(f"SELECT doc_id, len({S_ARTIFACTS}) > 0 AS is_artifact FROM documents")
def artifact_flags(spark, d):
    return read(spark, d, "documents").select("doc_id", T.is_artifact(F.col("text")).alias("is_artifact"))


S_LINES = "[trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) for x in string_split(text, chr(10)) if trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '']"


@query(f"SELECT doc_id, len({S_LINES}) AS lines, md5(array_to_string({S_LINES}, '|')) AS digest FROM documents")
def text_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", T.lines(F.col("text")).alias("l")).select("doc_id", F.size("l").cast("long").alias("lines"), F.md5(F.array_join("l", "|")).alias("digest"))


S_HINTS = [f"regexp_extract(text, {q(p)})" for p in P.LOOKUP]


@query(f"WITH h AS (SELECT conv_id, turn, {', '.join(f'{x} AS h{i}' for i, x in enumerate(S_HINTS))}, TRY_CAST(regexp_extract(text, '(?i)\\bstep\\s+([0-9]+)\\b', 1) AS INT) AS step FROM conversations) SELECT conv_id, turn, step, nullif(CASE WHEN length(h2) > greatest(length(h0), length(h1)) THEN h2 WHEN length(h1) > length(h0) THEN h1 ELSE h0 END, '') AS hint FROM h")
def query_hints(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.step_number(F.col("text")).alias("step"), T.entity_hint(F.col("text")).alias("hint"))


@query("""WITH v AS (SELECT event_id, json_extract_string(props, '$.k') AS v FROM events)
SELECT event_id, CASE WHEN lower(v) IN ('true', 'false') THEN 'boolean' WHEN lower(v) = 'null' THEN 'null' WHEN regexp_matches(v, '^-?[0-9]+$') THEN 'integer' WHEN regexp_matches(v, '^-?[0-9]+\\.[0-9]+$') THEN 'float' ELSE 'string' END AS value_type, 'camelCase' AS key_style FROM v""")
def value_types(spark, d):
    v = F.get_json_object("props", "$.k")
    return read(spark, d, "events").select("event_id", T.value_type(F.coalesce(v, F.lit(""))).alias("value_type"), T.key_style(F.lit("k")).alias("key_style"))


@query("SELECT doc_id, md5(substr(text, 1, 12000)) AS digest FROM documents")
def long_context(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(F.substring("text", 1, 12000)).alias("digest"))


@query(f"WITH x AS (SELECT doc_id, {S_TOKENS('text')} AS before, {S_TOKENS('substr(text, 1, CAST(floor(length(text) * 0.5) AS INT))')} AS after FROM documents) SELECT doc_id, before, after, round(1 - after / greatest(before, 1)::DOUBLE, 6) AS reduction, round(after / greatest(before, 1)::DOUBLE, 6) AS ratio FROM x")
def token_reductions(spark, d):
    text = F.col("text")
    rows = read(spark, d, "documents").select("doc_id", T.token_count(text).alias("before"), T.token_count(T.truncate(text, 0.5)).alias("after"))
    less = compress.token_reduction(F.col("before"), F.col("after"))
    return rows.select("doc_id", "before", "after", r6(less).alias("reduction"), r6(1 - less).alias("ratio"))


# vectors ------------------------------------------------------------------


@query(f"SELECT vec_id, len(embedding) AS dim, round(embedding[1]::DOUBLE / sqrt({S_DOT.format('embedding', 'embedding')}), 6) AS head, round({S_DOT.format('embedding', 'embedding')} / {S_DOT.format('embedding', 'embedding')}, 6) AS size FROM embeddings")
def unit_vectors(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", V.normalize(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.size("u").cast("long").alias("dim"), r6(F.get("u", F.lit(0))).alias("head"), r6(V.dot(F.col("u"), F.col("u"))).alias("size"))


S_NEAR = f"SELECT a.vec_id AS query_id, b.vec_id, a.label AS l, b.label AS m, {S_DOT.format('a.embedding', 'b.embedding')} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {S_DOT.format('a.embedding', 'b.embedding')} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id"


def _asked(spark, d, *more):
    return read(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), *more)


@query(f"WITH p AS ({S_NEAR}) SELECT query_id, vec_id, round(s, 6) AS score FROM p WHERE rank = 1 AND s > 0.3")
def nearest_cached(spark, d):
    return vectors.nearest_cached(_asked(spark, d), read(spark, d, "embeddings"), 0.3).select("query_id", F.col("id").alias("vec_id"), r6("score").alias("score"))


@query(f"WITH m AS (SELECT a.vec_id, max({S_DOT.format('a.embedding', 'b.embedding')}) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND b.label = 0 AND a.vec_id <> b.vec_id GROUP BY a.vec_id) SELECT vec_id AS query_id, round(coalesce(1 - s, 1.0), 6) AS novelty FROM embeddings LEFT JOIN m USING (vec_id) WHERE vec_id % 50 = 0")
def matrix_novelty(spark, d):
    matrix = read(spark, d, "embeddings").where("label = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return memory.matrix_novelty(_asked(spark, d), matrix).select("query_id", r6("novelty").alias("novelty"))


@query(f"WITH p AS (SELECT a.label, a.embedding AS va, b.embedding AS vb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT label, count(*) AS pairs, round(sum({S_DOT.format('va', 'va')} + {S_DOT.format('vb', 'vb')} - 2 * {S_DOT.format('va', 'vb')}), 4) AS loss FROM p GROUP BY label")
def training_loss(spark, d):
    return _pairs(spark, d).groupBy("label").agg(F.count("*").alias("pairs"), F.round(F.sum(V.squared_distance(F.col("va"), F.col("vb"))), 4).alias("loss"))


S_EPE = f"({S_DOT.format('va', 'va')} + {S_DOT.format('vb', 'vb')} - 2 * {S_DOT.format('va', 'vb')}) / 4"


@query(f"WITH p AS (SELECT a.vec_id, a.label, a.embedding AS va, b.embedding AS vb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), k AS (SELECT label, list_extract(['{chr(39) + ', '.join(KINDS) + chr(39)}'], 1) AS unused, list_value({', '.join(q(k) for k in KINDS)})[CAST(label % 6 AS INT) + 1] AS kind, {S_EPE} AS epe FROM p) SELECT label, kind, count(*) AS segments, round(sum(epe * ({S_BY(3)})), 4) AS total FROM k GROUP BY label, kind".replace(f"list_extract(['{chr(39) + ', '.join(KINDS) + chr(39)}'], 1) AS unused, ", ""))
def risk_weighted(spark, d):
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("label") % 6)
    rows = _pairs(spark, d).select("label", kind.alias("kind"), V.epe(F.col("va"), F.col("vb")).alias("epe"))
    return rows.groupBy("label", "kind").agg(F.count("*").alias("segments"), F.round(F.sum(V.risk(F.col("epe"), F.col("kind"))), 4).alias("total"))


@query(f"WITH p AS (SELECT a.label, a.embedding AS va, b.embedding AS vb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT label, count(*) AS pairs, round(avg({S_DOT.format('va', 'vb')}), 6) AS mean_cosine FROM p GROUP BY label")
def pair_summary(spark, d):
    return metrics.pair_summary(_pairs(spark, d), "label", "va", "vb").select("label", "pairs", r6("mean_cosine").alias("mean_cosine"))


@query(f"WITH p AS (SELECT a.vec_id, CASE WHEN a.label = 0 THEN 'faithful' ELSE 'lossy' END AS l, {S_EPE.replace('va', 'a.embedding').replace('vb', 'b.embedding')} AS e FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), n AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY vec_id) AS n FROM p) SELECT round(avg(e) FILTER (WHERE l <> 'faithful') / avg(e) FILTER (WHERE l = 'faithful'), 5) AS separation FROM n WHERE n <= 50")
def pair_separation(spark, d):
    rows = _pairs(spark, d).withColumn("l", F.when(F.col("label") == 0, "faithful").otherwise("lossy"))
    return metrics.separation(rows, "l", "va", "vb", "vec_id").select(F.round("separation", 5).alias("separation"))


# confidence and budgets ---------------------------------------------------


@query(f"""WITH t AS (SELECT conv_id, turn, list_distinct({s_words('text', '^[A-Z][a-z]+$')}) AS e FROM conversations),
n AS (SELECT conv_id, turn, e, lead(e) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM t),
s AS (SELECT conv_id, turn, len(list_intersect(e, c)) / greatest(len(list_intersect(e, list_concat(e, c))), 1)::DOUBLE AS score FROM n WHERE c IS NOT NULL)
SELECT conv_id, turn, round(score, 6) AS score, CASE WHEN score >= 0.7 THEN 'hot_cache' WHEN score >= 0.4 THEN 'enriched' ELSE 'cold_storage' END AS route FROM s""")
def confidence_gate(spark, d):
    names = F.array_distinct(F.filter(T.words(F.col("text")), lambda w: w.rlike("^[A-Z][a-z]+$")))
    rows = read(spark, d, "conversations").select("conv_id", "turn", names.alias("e")).withColumn("c", F.lead("e").over(Window.partitionBy("conv_id").orderBy("turn"))).where("c IS NOT NULL")
    scored = rows.select("conv_id", "turn", V.gate_score(F.col("e"), F.col("c"), F.concat("e", "c")).alias("score"))
    return scored.select("conv_id", "turn", r6("score").alias("score"), V.gate_route(F.col("score")).alias("route"))


@query("WITH u AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT l_orderkey AS question, round(1 - coalesce(avg(p_size / 100.0), 0), 6) AS trust FROM u LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def hot_trust(spark, d):
    scores = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 100.0).alias("r_build"))
    return retrieve.hot_trust(read(spark, d, "lineitem"), scores, "l_orderkey", "l_partkey").select("question", r6("trust").alias("trust"))


@query("WITH z AS (SELECT doc_id, source, (n_chars - avg(n_chars) OVER w) / greatest(stddev_pop(n_chars) OVER w, 1e-9) AS z FROM documents WINDOW w AS (PARTITION BY source)) SELECT source AS session, doc_id AS seq, round(z, 5) AS z, round(greatest(0.3, least(1.0, 0.2 + 1.5 * z)), 5) AS budget FROM z")
def session_plans(spark, d):
    plans = memory.session_plans(read(spark, d, "documents"), "source", "doc_id", F.col("n_chars"))
    return plans.select("session", "seq", F.round("z", 5).alias("z"), F.round("budget", 5).alias("budget"))


S_GAP_BY = "CASE schema " + " ".join(f"WHEN '{k}' THEN 1 - ({s_fit('text', k)})" for k in P.SCHEMA_TYPES) + " ELSE 0.0 END"


@query(f"""WITH e AS ({' UNION ALL '.join(f"SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(text, {q(p)}))) AS entity FROM documents" for _, p in TYPED)}),
r AS (SELECT source, doc_id, max(n) AS most FROM (SELECT *, count(*) OVER (PARTITION BY source, entity ORDER BY doc_id RANGE UNBOUNDED PRECEDING) AS n FROM e) GROUP BY ALL),
n AS (SELECT source, doc_id, text, {S_COUNTS} FROM documents), g AS (SELECT *, greatest({', '.join('n_' + k for k in P.SCHEMA_TYPES)}) AS m FROM n), k AS (SELECT *, {S_KIND} AS schema FROM g),
b AS (SELECT k.source AS session, k.doc_id AS seq, schema, {S_GAP_BY} AS gap, coalesce(most, 0) AS most, len({S_ARTIFACTS}) > 0 AS art FROM k LEFT JOIN r USING (source, doc_id))
SELECT session, seq, schema, round(gap, 6) AS gap, most, round(CASE WHEN art OR most >= 3 THEN 1.0 ELSE least(0.2 * (1 + 0.5 + 0.5 * gap), 1.0) END, 6) AS budget FROM b""")
def write_budgets(spark, d):
    made = memory.write_budgets(read(spark, d, "documents"), "source", "doc_id")
    return made.select("session", "seq", "schema", r6("gap").alias("gap"), "most", r6("budget").alias("budget"))


# stores and look-ups ------------------------------------------------------

S_ASKED = "SELECT DISTINCT user_id AS conv_id, event_id % 8 AS turn FROM events"


@query(f"SELECT conv_id, turn, role, md5(text) AS digest FROM conversations JOIN ({S_ASKED}) USING (conv_id, turn)")
def cold_look_up(spark, d):
    asked = read(spark, d, "events").select(F.col("user_id").alias("conv_id"), (F.col("event_id") % 8).alias("turn"))
    return memory.look_up(read(spark, d, "conversations"), asked, ["conv_id", "turn"]).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("SELECT conv_id, count(*) AS cold_rows FROM conversations GROUP BY conv_id")
def cold_counts(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("cold_rows"))


S_INDEX = f"SELECT session, entity, min(seq) AS first_seq, count(*) AS ref_count FROM ({S_FACTS}) GROUP BY ALL"


@query(f"WITH i AS ({S_INDEX}), h AS (SELECT DISTINCT entity FROM i WHERE ref_count >= 3) SELECT entity, session, first_seq, ref_count FROM i JOIN h USING (entity)")
def fact_look_up(spark, d):
    index = state.fact_index(_facts(spark, d))
    return memory.look_up(index, state.high_reference(index), ["entity"]).select("entity", "session", F.col("seq").alias("first_seq"), "ref_count")


@query(f"WITH i AS ({S_INDEX}), h AS (SELECT DISTINCT entity FROM i WHERE ref_count >= 3) SELECT DISTINCT entity AS query_id, session, first_seq AS seq, md5(text) AS digest FROM i JOIN h USING (entity) JOIN documents ON source = session AND doc_id = first_seq")
def precise_retrieval(spark, d):
    index = state.fact_index(_facts(spark, d))
    cold = read(spark, d, "documents").select(F.col("source").alias("session"), F.col("doc_id").alias("seq"), "text")
    hints = state.high_reference(index).select("entity", F.col("entity").alias("query_id")).distinct()
    return memory.precise(hints, index, cold).select("query_id", "session", "seq", F.md5("text").alias("digest"))


S_HOT = f"SELECT source, doc_id, {S_TOKENS('text')} AS tokens, max(doc_id) OVER (PARTITION BY source, md5(text)) > doc_id AS stale FROM documents"


def _hot(spark, d):
    rows = read(spark, d, "documents").select("source", "doc_id", "text", F.md5("text").alias("name"))
    last = rows.groupBy("source", "name").agg(F.max("doc_id").alias("last"))
    # a text that comes again later in its session replaces the earlier ones
    old = rows.select("source", "name", "doc_id").join(last, ["source", "name"]).where("doc_id < last")
    return memory.mark_stale(memory.store(rows.drop("name")), old, ["source", "doc_id"])


@query(f"SELECT source, count(*) AS entries, CAST(sum(tokens) AS BIGINT) AS tokens FROM ({S_HOT}) WHERE NOT stale GROUP BY source")
def hot_cache_stats(spark, d):
    return state.hot_stats(_hot(spark, d), ["source"])


@query(f"SELECT source, doc_id, tokens FROM ({S_HOT}) WHERE NOT stale")
def hot_entries(spark, d):
    return memory.evict_stale(_hot(spark, d)).select("source", "doc_id", "tokens")


@query(f"WITH h AS ({S_HOT}), e AS (SELECT * FROM ({S_EDGES} SELECT * FROM w)) SELECT (SELECT count(*) FROM h WHERE NOT stale) AS hot_entries, (SELECT CAST(sum(tokens) AS BIGINT) FROM h WHERE NOT stale) AS hot_tokens, (SELECT count(*) FROM conversations) AS cold_rows, (SELECT count(*) FROM ({S_INDEX})) AS facts, (SELECT count(*) FROM e) AS edges")
def memory_stats(spark, d):
    return memory.stats(_hot(spark, d), read(spark, d, "conversations"), state.fact_index(_facts(spark, d)), _edges(spark, d))


@query(S_EDGES + ", p AS (SELECT DISTINCT l_suppkey AS a, (l_suppkey * 7 + l_linenumber) % 101 AS b FROM lineitem) SELECT p.a, p.b, round(coalesce(w.weight, 0), 6) AS weight FROM p LEFT JOIN w ON w.a = least(p.a, p.b) AND w.b = greatest(p.a, p.b)")
def edge_weights(spark, d):
    pairs = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 101).alias("b")).distinct()
    return graph.edge_weight(pairs, _edges(spark, d)).withColumn("weight", r6("weight"))


@query("SELECT conv_id AS session, md5(string_agg('[' || turn || '] ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def memory_dump(spark, d):
    return gate.dump(read(spark, d, "conversations"), "conv_id", "turn", "text").select(F.col("conv_id").alias("session"), F.md5("memory").alias("digest"))


# retrieval ----------------------------------------------------------------

LOOSE = [(1, "license token"), (2, "icens"), (3, "zzzzqqq vvvvkkk")]
S_T = f"[x for x in regexp_split_to_array(lower(text), {q(P.TOKEN_BREAK)}) if length(x) >= 2]"


@query(f"""WITH t AS (SELECT doc_id, {S_T} AS toks FROM documents), p AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM t),
w AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{x}')" for i, text in LOOSE for x in text.split())}) v(query_id, term)),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM w) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), c AS (SELECT count(*) AS n, avg(len(toks)) AS a FROM t),
s AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM tf JOIN df USING (term) JOIN w USING (term), c GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id AS id, 'ranked' AS how FROM s),
m AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank, doc_id AS id, 'contains' AS how FROM (SELECT DISTINCT query_id, doc_id FROM documents JOIN w ON contains(lower(text), term) WHERE query_id NOT IN (SELECT query_id FROM r))),
f AS (SELECT query_id, rank, id, 'first' AS how FROM (SELECT DISTINCT query_id FROM w WHERE query_id NOT IN (SELECT query_id FROM r) AND query_id NOT IN (SELECT query_id FROM m)), (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents))
SELECT query_id, CAST(rank AS INT) AS rank, id, how FROM (SELECT * FROM r UNION ALL SELECT * FROM m UNION ALL SELECT * FROM f) WHERE rank <= 5""")
def cold_fallback(spark, d):
    asked = spark.createDataFrame(LOOSE, "query_id int, query string")
    return memory.cold_fallback(asked, read(spark, d, "documents"), 5)


S_WALK = f"""n AS ({S_EDGES} SELECT node, neighbor, CAST(rank AS INT) AS step FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, neighbor) AS rank FROM (SELECT a AS node, b AS neighbor, weight FROM w UNION ALL SELECT b, a, weight FROM w) WHERE weight >= 0.2) WHERE rank <= 3)"""


@query(f"""WITH near AS ({S_NEAR}), {S_WALK}, x AS (SELECT query_id, vec_id AS id, 0 AS part, rank FROM near WHERE l % 3 = 1 AND rank <= 4 UNION ALL SELECT query_id, neighbor, 1, rank * 10 + step FROM near JOIN n ON node = vec_id WHERE l % 3 = 1 AND rank <= 4),
f AS (SELECT query_id, id, min((part, rank)) AS place FROM x GROUP BY ALL), e AS (SELECT query_id, 'enriched' AS route, row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS rank, id FROM f),
h AS (SELECT query_id, 'hot_cache' AS route, rank, vec_id AS id FROM near WHERE l % 3 = 0 AND rank <= 5),
c AS (SELECT q.vec_id AS query_id, 'cold_storage' AS route, rank, o.vec_id AS id FROM embeddings q, (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings) o WHERE q.vec_id % 50 = 0 AND q.label % 3 = 2 AND rank <= 5)
SELECT query_id, route, CAST(rank AS INT) AS rank, id FROM (SELECT * FROM h UNION ALL SELECT * FROM e WHERE rank <= 8 UNION ALL SELECT * FROM c)""")
def routed_retrieval(spark, d):
    rows, edges = read(spark, d, "embeddings"), _edges(spark, d)
    asked = _asked(spark, d, F.get(F.array(F.lit("hot_cache"), F.lit("enriched"), F.lit("cold_storage")), F.col("label") % 3).alias("route"))
    first = rows.select(F.col("vec_id").alias("id")).orderBy("id").limit(5).select("id", F.row_number().over(Window.orderBy("id")).alias("rank"))  # five rows
    near = lambda queries, k: vectors.cosine_topk(queries, rows, k)
    routes = {"hot_cache": lambda queries: near(queries, 5), "enriched": lambda queries: memory.walk(near(queries, 4).select("query_id", "rank", "id"), edges, 8), "cold_storage": lambda queries: queries.select("query_id").crossJoin(F.broadcast(first))}
    return memory.routed(asked, routes)


@query(f"""WITH p AS ({S_NEAR}), a AS (SELECT query_id, 1 AS attempt, 'hot_cache' AS route, 3 AS k, avg(CAST(l = m AS INT)) FILTER (WHERE rank <= 3) AS c FROM p GROUP BY query_id UNION ALL SELECT query_id, 2, 'enriched', 6, avg(CAST(l = m AS INT)) FILTER (WHERE rank <= 6) FROM p GROUP BY query_id UNION ALL SELECT query_id, 3, 'cold_storage', 8, avg(CAST(l = m AS INT)) FILTER (WHERE rank <= 8) FROM p GROUP BY query_id),
f AS (SELECT query_id, coalesce(min(attempt) FILTER (WHERE c >= 0.7), 3) AS attempt FROM a GROUP BY query_id)
SELECT query_id, attempt, route, k, round(c, 6) AS confidence FROM f JOIN a USING (query_id, attempt)""")
def escalation_ladder(spark, d):
    rows = read(spark, d, "embeddings")
    labels = rows.select(F.col("vec_id").alias("id"), F.col("label").alias("other"))
    own = rows.select(F.col("vec_id").alias("query_id"), "label")
    agree = lambda found: found.join(labels, "id").join(own, "query_id").groupBy("query_id").agg(F.avg((F.col("label") == F.col("other")).cast("int")).alias("confidence"))
    made = memory.retry(_asked(spark, d), lambda queries, route, k: vectors.cosine_topk(queries, rows, k), agree, 3, "hot_cache")
    return made.withColumn("confidence", r6("confidence"))


@query(f"""WITH a AS (SELECT DISTINCT l_orderkey AS query_id, l_suppkey AS seq FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS query_id, l_suppkey AS seq FROM lineitem),
u AS (SELECT query_id, seq, min(part) AS part FROM (SELECT *, 0 AS part FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY ALL),
w AS (SELECT *, 2 * row_number() OVER (PARTITION BY query_id ORDER BY part, seq) AS words FROM u)
SELECT query_id, seq, CASE part WHEN 0 THEN 'PRECISE' ELSE 'CONTEXT' END AS label FROM w WHERE words <= 8""")
def merged_results(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("seq"), F.lit("two words").alias("text"), "l_returnflag")
    return memory.merged(rows.where("l_returnflag = 'R'"), rows, 8).select("query_id", "seq", "label")


# summaries ----------------------------------------------------------------


@query("SELECT o_orderpriority AS kind, count(*) AS questions, round(avg(CAST(o_totalprice > 100000 AS INT)), 6) AS accuracy, round(avg(o_custkey % 10 / 10.0), 6) AS mean_reduction FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())")
def run_summary(spark, d):
    made = memory.run_summary(read(spark, d, "orders"), "o_orderpriority", F.col("o_totalprice") > 100000, F.col("o_custkey") % 10 / 10.0)
    return made.select("kind", "questions", r6("accuracy").alias("accuracy"), r6("mean_reduction").alias("mean_reduction"))


@query("SELECT role, count(*) AS messages FROM conversations GROUP BY role")
def message_counts(spark, d):
    return read(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("messages"))


EVENT_KINDS = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id % 5 AS session, " + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{k}'), 5) AS \"{k}\"" for k in EVENT_KINDS) + " FROM events GROUP BY 1")
def probe_table(spark, d):
    rows = read(spark, d, "events").select((F.col("user_id") % 5).alias("session"), "event_type", "value")
    return metrics.probe_table(rows, "session", "event_type", "value", EVENT_KINDS).select("session", *[F.round(k, 5).alias(k) for k in EVENT_KINDS])


# write path ---------------------------------------------------------------


def s_vector(t: str, dim: int = 64) -> str:
    """The default encoding of a text: hashed counts of its tokens as a unit vector, null without tokens."""
    places = f"[CAST(('0x' || substr(md5(x), 1, 8)) AS BIGINT) % {dim} for x in regexp_split_to_array(lower({t}), {q(P.TOKEN_BREAK)}) if length(x) >= 2]"
    counts = f"[len([p for p in {places} if p = i])::DOUBLE for i in range({dim})]"
    return f"CASE WHEN len({places}) > 0 THEN {counts} END"


S_UNIT = lambda v: f"[y / sqrt(list_dot_product({v}, {v})) for y in {v}]"
S_SEEN = f"t AS (SELECT conv_id, turn, unnest(list_distinct({s_words('text', P.KEY_TOKEN)})) AS token FROM conversations), o AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, token) AS first FROM t), w AS (SELECT conv_id, turn, count(*) FILTER (WHERE first = turn) AS new_tokens FROM o GROUP BY ALL)"
S_SURE = "(coalesce(new_tokens, 0) > 0 OR len(mem) = 0 OR vec IS NULL)"
S_SCORE = f"CASE WHEN {S_SURE} THEN 1.0::DOUBLE ELSE 1 - list_max([list_dot_product(m, vec) for m in mem]) END"
S_GATE = f"""{S_SEEN}, c AS (SELECT conv_id, turn, {s_vector('text')} AS counts FROM conversations),
v AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {S_UNIT('counts')} AS vec, new_tokens FROM c LEFT JOIN w USING (conv_id, turn)),
gate AS (SELECT conv_id, turn, n, true AS novel, 1.0::DOUBLE AS score, CASE WHEN vec IS NULL THEN CAST([] AS DOUBLE[][]) ELSE [vec] END AS mem FROM v WHERE n = 1
UNION ALL SELECT v.conv_id, v.turn, v.n, {S_SURE} OR ({S_SCORE}) > 0.05, {S_SCORE}, CASE WHEN vec IS NOT NULL AND ({S_SURE} OR ({S_SCORE}) > 0.05) THEN list_append(mem, vec)[-50:] ELSE mem END FROM gate JOIN v ON v.conv_id = gate.conv_id AND v.n = gate.n + 1)"""


@query(f"WITH RECURSIVE {S_GATE} SELECT conv_id AS session, turn AS seq, novel, round(score, 6) AS score FROM gate")
def novelty_gate(spark, d):
    rows = read(spark, d, "conversations").withColumn("vector", V.hashed_encoding(F.col("text")))
    return gate.novelty_gate(rows, session="conv_id", seq="turn").withColumn("score", r6("score"))


S_LOST = "CASE schema " + " ".join(f"WHEN '{k}' THEN {{}}" for k in P.SCHEMA_TYPES) + " ELSE 0.0 END"


def s_lost_by(a: str, b: str) -> str:
    from lumenfold.plans.catalogue import s_lost

    return S_LOST.format(*[s_lost(a, b, k) for k in P.SCHEMA_TYPES])


@query(f"""WITH RECURSIVE {S_GATE},
e AS ({' UNION ALL '.join(f"SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text, {q(p)}))) AS entity FROM conversations JOIN gate USING (conv_id, turn) WHERE novel" for _, p in TYPED)}),
r AS (SELECT conv_id, turn, max(n) AS most FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, entity ORDER BY turn RANGE UNBOUNDED PRECEDING) AS n FROM e) GROUP BY ALL),
k0 AS (SELECT conv_id, turn, text, {S_COUNTS} FROM conversations), k1 AS (SELECT *, greatest({', '.join('n_' + k for k in P.SCHEMA_TYPES)}) AS m FROM k0),
k AS (SELECT conv_id, turn, text, {S_KIND} AS schema, 1 - greatest({', '.join(s_fit('text', k) for k in P.SCHEMA_TYPES)}) > 0.5 AS schema_novel, len({S_ARTIFACTS}) > 0 AS art FROM k1),
b AS (SELECT k.*, novel, score, coalesce(most, 0) AS refs, CASE WHEN art OR coalesce(most, 0) >= 3 THEN 1.0 ELSE least(0.2 * (1 + 0.5 + 0.5 * ({S_GAP_BY})), 1.0) END AS budget FROM k JOIN gate USING (conv_id, turn) LEFT JOIN r USING (conv_id, turn)),
a AS (SELECT *, substr(text, 1, CAST(floor(length(text) * least(budget + 0.2 * i, 1.0)) AS INT)) AS short FROM b, (SELECT unnest([0, 1, 2]) AS i) UNION ALL SELECT *, 3, text FROM b),
x AS (SELECT *, {s_vector('text')} AS va, coalesce({s_vector('short')}, [0.0::DOUBLE for i in range(64)]) AS vb, {s_lost_by('text', 'short')} AS gap FROM a),
y AS (SELECT *, 1 - CASE WHEN list_dot_product(vb, vb) = 0 THEN 0.0 ELSE list_dot_product(va, vb) / sqrt(list_dot_product(va, va) * list_dot_product(vb, vb)) END AS far FROM x),
z AS (SELECT *, least(greatest(0.6 * far + 0.4 * gap, 0), 1) AS r FROM y),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS first FROM z WHERE i = 3 OR round(r, 9) <= 0.35)
SELECT conv_id AS session, turn AS seq, CASE WHEN novel THEN 'hot' ELSE 'cold_only' END AS action, round(score, 6) AS novelty, schema, schema_novel, refs AS "references", novel AND schema_novel AS queued,
CASE WHEN novel THEN round(budget, 6) END AS budget, CASE WHEN novel THEN round(abs(far), 6) END AS cosine_epe, CASE WHEN novel THEN round(gap, 6) END AS gap, CASE WHEN novel THEN round(abs(0.5 * far + 0.5 * gap), 6) END AS combined, CASE WHEN novel THEN round(r, 6) END AS r_build,
{S_TOKENS('text')} AS tokens, CASE WHEN novel THEN {S_TOKENS('short')} END AS kept_tokens FROM f WHERE first = 1""")
def ingest_pipeline(spark, d):
    made = gate.ingest(read(spark, d, "conversations"), session="conv_id", seq="turn")
    size = lambda c: F.round(F.abs(c), 6).alias(c)  # noqa: E731  no negative zero
    return made.select("session", "seq", "action", r6("novelty").alias("novelty"), "schema", "schema_novel", "references", "queued", r6("budget").alias("budget"), size("cosine_epe"), size("gap"), size("combined"), size("r_build"), "tokens", "kept_tokens")


@query(f"""WITH d AS (SELECT doc_id AS id, {s_vector('text')} AS c FROM documents), e AS (SELECT item_id AS query_id, {s_vector('text')} AS c FROM benchmark),
dn AS (SELECT id, {S_UNIT('c')} AS v FROM d WHERE c IS NOT NULL), en AS (SELECT query_id, {S_UNIT('c')} AS v FROM e WHERE c IS NOT NULL),
near AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(en.v, dn.v), 9) DESC, id) AS rank FROM dn, en),
t AS (SELECT doc_id, {S_T} AS toks FROM documents JOIN dn ON id = doc_id), p AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM t),
w AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({S_T}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM w) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n, avg(len(toks)) AS a FROM t),
s AS (SELECT query_id, doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM tf JOIN df USING (term) JOIN w USING (term), n GROUP BY ALL),
words AS (SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0),
x AS (SELECT query_id, id, 0 AS part, rank FROM near WHERE rank <= 10 UNION ALL SELECT query_id, id, 1, rank FROM words WHERE rank <= 10),
f AS (SELECT query_id, id, min((part, rank)) AS place FROM x GROUP BY ALL), r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS rank FROM f)
SELECT query_id, CAST(rank AS INT) AS rank, id FROM r WHERE rank <= 15""")
def fused_retrieval(spark, d):
    entries = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", V.hashed_encoding(F.col("text")).alias("vector"))
    entries = stage(entries, "entries").where("vector IS NOT NULL")
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), V.hashed_encoding(F.col("text")).alias("vector")).where("vector IS NOT NULL")
    near = vectors.cosine_topk(asked, entries, 10, query_vector="vector", id_col="id", vector_col="vector", skip_self=False)
    return retrieve.ordered_union([near, lexical.bm25_topk(asked, entries, 10, id_col="id")], 15)


@query(f"""WITH p AS (SELECT doc_id, text, [trim(x) for x in string_split(regexp_replace(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)) if trim(x) <> ''] AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS s, unnest(range(len(parts))) AS pos, len(parts) AS n FROM p),
k AS (SELECT doc_id, pos, n, unnest(regexp_extract_all(lower(s), '[a-z0-9_/\\.]+')) AS tok FROM l),
tf AS (SELECT doc_id, pos, n, tok, count(*) AS c FROM k GROUP BY ALL),
w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, tok) AS df, sum(c) OVER (PARTITION BY doc_id, pos) AS total FROM tf),
b AS (SELECT doc_id, pos, sum(c / total * (ln((n + 1) / (df + 1)) + 1)) AS base FROM w GROUP BY ALL),
s AS (SELECT l.doc_id, l.pos, l.n, l.s, round(coalesce(base, 0) + 0.3 * len(regexp_extract_all(s, {q(P.HIGH_VALUE)})), 6) AS score FROM l LEFT JOIN b USING (doc_id, pos)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM s),
j AS (SELECT doc_id, string_agg(s, ' ' ORDER BY pos) AS many FROM r WHERE rank <= greatest(1, ceil(n * 0.5)) GROUP BY doc_id),
o AS (SELECT doc_id, len(parts) AS n, [x for x in regexp_split_to_array(text, '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\p{{Z}}]+') if x <> ''] AS ws FROM p)
SELECT doc_id, md5(CASE WHEN n > 1 THEN many ELSE array_to_string(ws[1:greatest(1, CAST(ceil(len(ws) * 0.5) AS INT))], ' ') END) AS short FROM o LEFT JOIN j USING (doc_id)""")
def extractive_compress(spark, d):
    return compress.extractive(read(spark, d, "documents"), 0.5).select(F.col("id").alias("doc_id"), F.md5("compressed").alias("short"))
