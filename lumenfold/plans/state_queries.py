"""Registered queries over what depends on order: rewrites, reuse of contexts, the graph's decays, running anchors. They go into the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import fidelity as V
from lumenfold.functions import patterns as P
from lumenfold.functions import predictor
from lumenfold.functions import text as T
from lumenfold.operators import anchors, graph, lexical, memory, pairs, reuse, rewrites
from lumenfold.operators.ordered import stage
from lumenfold.plans.catalogue import S_TIER, q, query, r6, read
from lumenfold.plans.memory_queries import S_T, S_UNIT, TYPED, s_vector
from lumenfold.streaming import history

# rewrites -----------------------------------------------------------------

S_LOOK_UPS = "SELECT user_id AS key, event_id AS turn, event_type || ' ' || coalesce(props, '') AS query, event_type = 'error' AS miss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE user_id IS NOT NULL"
#: Every look-up in turn: misses since the last rewrite, its turn, and how many there were.
S_REWRITES = f"""WITH RECURSIVE l AS ({S_LOOK_UPS}), f AS (
  SELECT key, i, turn, query, miss, miss::INT AS m, NULL::BIGINT AS last, 0 AS nth, false AS due, 0 AS told FROM l WHERE i = 1
  UNION ALL
  SELECT key, i, turn, query, miss, CASE WHEN due THEN 0 ELSE c END, CASE WHEN due THEN turn ELSE last END, nth + due::INT, due, c
  FROM (SELECT l.key, l.i, l.turn, l.query, l.miss, f.m + l.miss::INT AS c, f.last, f.nth, f.m + l.miss::INT > 2 AND (f.last IS NULL OR l.turn - f.last > 5) AS due FROM f JOIN l ON l.key = f.key AND l.i = f.i + 1))"""


def _look_ups(spark, d):
    return read(spark, d, "events").withColumn("query", F.concat("event_type", F.lit(" "), F.coalesce("props", F.lit(""))))


def _schedule(spark, d):
    return rewrites.schedule(_look_ups(spark, d), "user_id", "event_id", "query", F.col("event_type") == "error")


@query(f"""{S_REWRITES}, w AS (SELECT key, turn, i, unnest([x for x in string_split_regex(lower(query), '\\s+') if length(x) >= 3]) AS word FROM f WHERE miss),
o AS (SELECT key, word, min(i) AS first FROM w GROUP BY ALL), r AS (SELECT * FROM f WHERE due)
SELECT r.key, r.turn, r.nth, r.told AS misses, (SELECT count(*) FROM o WHERE o.key = r.key AND o.first <= r.i) AS anchors FROM r""")
def rewrite_schedule(spark, d):
    return _schedule(spark, d).select("key", "turn", "nth", "misses", F.size("anchors").cast("long").alias("anchors"))


S_ORIGINAL = "SELECT conv_id AS key, string_agg(text, ' ' ORDER BY turn) AS original FROM conversations GROUP BY conv_id"


@query(f"""{S_REWRITES}, n AS (SELECT key, max(nth) AS nth FROM f WHERE due GROUP BY key), o AS ({S_ORIGINAL})
SELECT o.key, round(CASE WHEN n.nth IS NULL THEN 0.3::DOUBLE ELSE least(0.3::DOUBLE + 0.2::DOUBLE * n.nth, 1.0::DOUBLE) END, 6) AS budget, n.nth IS NOT NULL AS rewritten,
md5(substr(original, 1, CAST(floor(length(original) * CASE WHEN n.nth IS NULL THEN 0.3::DOUBLE ELSE least(0.3::DOUBLE + 0.2::DOUBLE * n.nth, 1.0::DOUBLE) END) AS INT))) AS digest FROM o LEFT JOIN n USING (key)""")
def rewritten_entries(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    originals = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.array_join(F.transform(turns, lambda x: x["text"]), " ").alias("original"))
    entries = originals.select("key", T.truncate(F.col("original"), 0.3).alias("text"), F.lit(0.3).alias("budget"), F.array(F.lit(0.0)).alias("vector"), F.lit(0.0).alias("score"))
    cut = lambda original, budget, words: T.truncate(original, budget)
    out = rewrites.swapped(entries, _schedule(spark, d), originals, cut, V.hashed_encoding, V.cosine_distance)
    return out.select("key", r6("budget").alias("budget"), "rewritten", F.md5("text").alias("digest"))


# reuse --------------------------------------------------------------------

S_REUSE = """SELECT label % 2 AS session, vec_id AS seq, vec_id % 211 AS uuid, [x::DOUBLE for x in embedding] AS v, row_number() OVER (PARTITION BY label % 2 ORDER BY vec_id) AS i FROM embeddings WHERE label IS NOT NULL"""
S_COS = "list_dot_product({}, {})"


@query(f"""WITH RECURSIVE l AS ({S_REUSE}), f AS (
  SELECT session, i, seq, 'miss' AS how, seq AS source_seq, NULL::BIGINT AS evicted_seq, [{{'u': uuid, 's': seq, 'v': v}}] AS cache FROM l WHERE i = 1
  UNION ALL
  SELECT session, i, seq, CASE WHEN own IS NOT NULL THEN 'uuid' WHEN near.c > 0.5 THEN 'similar' ELSE 'miss' END,
    CASE WHEN own IS NOT NULL THEN own.s WHEN near.c > 0.5 THEN -near.s ELSE seq END,
    CASE WHEN own IS NULL AND NOT near.c > 0.5 AND len(cache) >= 20 THEN cache[1].s END,
    CASE WHEN own IS NOT NULL OR near.c > 0.5 THEN cache ELSE list_append(CASE WHEN len(cache) >= 20 THEN cache[2:] ELSE cache END, {{'u': uuid, 's': seq, 'v': v}}) END
  FROM (SELECT l.*, f.cache, [x for x in f.cache if x.u = l.uuid][1] AS own, list_max([{{'c': round({S_COS.format('x.v', 'l.v')}, 12), 's': -x.s}} for x in f.cache]) AS near FROM f JOIN l ON l.session = f.session AND l.i = f.i + 1))
SELECT session, seq, how, source_seq, evicted_seq FROM f""")
def context_reuse(spark, d):
    rows = read(spark, d, "embeddings").where("label IS NOT NULL").select((F.col("label") % 2).alias("session"), F.col("vec_id").alias("seq"), (F.col("vec_id") % 211).alias("uuid"), F.col("embedding").alias("vector"))
    return reuse.context_reuse(rows, threshold=0.5, most=20).select("session", "seq", "how", "source_seq", "evicted_seq")


# graph --------------------------------------------------------------------


@query("""WITH RECURSIVE n AS (SELECT DISTINCT l_orderkey AS call, l_suppkey AS node FROM lineitem WHERE l_suppkey IS NOT NULL AND l_orderkey IS NOT NULL),
c AS (SELECT l_orderkey AS call, CASE WHEN bool_or(l_quantity > 49) THEN 3 ELSE 1 END AS step FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1),
k AS (SELECT call, step, row_number() OVER (ORDER BY call) - 1 AS epoch_at, count(*) OVER () AS calls FROM c),
t AS (SELECT a.node AS a, b.node AS b, step, CAST(floor(epoch_at / 50) AS BIGINT) AS e, CAST(floor(calls / 50) AS BIGINT) AS decays, row_number() OVER (PARTITION BY a.node, b.node ORDER BY a.call) AS i FROM n a JOIN n b ON a.call = b.call AND a.node < b.node JOIN k ON k.call = a.call),
f AS (SELECT a, b, i, e, decays, step::BIGINT AS count FROM t WHERE i = 1
  UNION ALL SELECT t.a, t.b, t.i, t.e, t.decays, CASE WHEN f.count / (f.count + 2.0::DOUBLE) * pow(0.95::DOUBLE, t.e - f.e) < 0.05 THEN 0 ELSE f.count END + t.step FROM f JOIN t ON t.a = f.a AND t.b = f.b AND t.i = f.i + 1),
z AS (SELECT a, b, arg_max(count, i) AS count, arg_max(e, i) AS e, max(decays) AS decays FROM f GROUP BY a, b),
w AS (SELECT a, b, count, count / (count + 2.0::DOUBLE) * pow(0.95::DOUBLE, decays - e) AS weight FROM z)
SELECT a, b, count, round(weight, 6) AS weight FROM w WHERE weight >= 0.05""")
def graph_replay(spark, d):
    rows = read(spark, d, "lineitem").withColumn("cold", F.col("l_quantity") > 49)
    return graph.replay(rows, "l_orderkey", "l_suppkey", "cold").withColumn("weight", r6("weight"))


# anchors ------------------------------------------------------------------

S_FIRST = "flatten([" + ", ".join(f"regexp_extract_all(text, {q(p)})" for _, p in TYPED) + f", [tok for tok in regexp_extract_all(text, {q(P.ANCHOR_TOKEN)}) if {S_TIER}]])"


@query(f"""WITH s AS (SELECT source AS session, doc_id AS seq, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
t AS (SELECT DISTINCT session, seq, n, tok FROM (SELECT session, seq, n, unnest(regexp_extract_all(lower(text), {q(P.ANCHOR_TOKEN)})) AS tok FROM s) WHERE length(tok) >= 4 AND tok NOT IN ({', '.join(q(w) for w in P.STOPWORDS)}) AND NOT ({S_TIER})),
o AS (SELECT *, row_number() OVER (PARTITION BY session, tok ORDER BY seq) AS df FROM t),
v AS (SELECT s.session, s.seq, s.n, o.tok, max(o.df) AS df FROM s JOIN o ON o.session = s.session AND o.n <= s.n GROUP BY ALL),
m AS (SELECT session, seq, n, median(ln(1 + n / (1.0 + df))) AS median_idf FROM v GROUP BY ALL),
r AS (SELECT v.session, v.seq, list(v.tok ORDER BY v.df, v.tok) AS second FROM v JOIN t USING (session, seq, tok) JOIN m USING (session, seq) WHERE v.n >= 20 AND ln(1 + v.n / (1.0 + v.df)) >= median_idf - 1e-12 GROUP BY ALL),
x AS (SELECT session, seq, n, {S_FIRST} AS first FROM s),
u AS (SELECT session, seq, n, tok, min(i) AS i FROM (SELECT session, seq, n, unnest(list_concat(first, coalesce(second, []))) AS tok, unnest(range(len(list_concat(first, coalesce(second, []))))) AS i FROM x LEFT JOIN r USING (session, seq)) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY session, seq ORDER BY i) AS place FROM u)
SELECT s.seq AS doc_id, s.n, round(m.median_idf, 6) AS median_idf, coalesce(string_agg(tok, '|' ORDER BY place) FILTER (WHERE place <= 10), '') AS anchors FROM s LEFT JOIN m USING (session, seq) LEFT JOIN p USING (session, seq) GROUP BY ALL""")
def running_anchors(spark, d):
    out = anchors.running_anchors(read(spark, d, "documents"), "source", "doc_id")
    return out.select(F.col("seq").alias("doc_id"), "n", r6("median_idf").alias("median_idf"), F.array_join("anchors", "|").alias("anchors"))


# retrieval ----------------------------------------------------------------

ROUTES = ["hot_cache", "enriched", "cold_storage"]


@query(f"""WITH d AS (SELECT doc_id AS id, {s_vector('text')} AS c FROM documents), e AS (SELECT item_id AS query_id, {s_vector('text')} AS c FROM benchmark),
dn AS (SELECT id, {S_UNIT('c')} AS v FROM d WHERE c IS NOT NULL), en AS (SELECT query_id, {S_UNIT('c')} AS v FROM e WHERE c IS NOT NULL),
near AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(en.v, dn.v), 9) DESC, id) AS rank FROM dn, en),
t AS (SELECT doc_id, {S_T} AS toks FROM documents), p AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM t),
w AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({S_T}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM w) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n, avg(len(toks)) AS a FROM t),
s AS (SELECT query_id, doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM tf JOIN df USING (term) JOIN w USING (term), n GROUP BY ALL),
words AS (SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0),
x AS (SELECT query_id, id, 0 AS part, rank FROM near WHERE rank <= 3 UNION ALL SELECT query_id, id, 1, rank FROM words WHERE rank <= 3),
f AS (SELECT query_id, id, min((part, rank)) AS place FROM x GROUP BY ALL), seeds AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS rank FROM f),
hot AS (SELECT query_id, id FROM near WHERE rank <= 3),
calls AS (SELECT query_id, CASE WHEN bool_or(h.id IS NULL) THEN 3 ELSE 1 END AS step, row_number() OVER (ORDER BY query_id) - 1 AS nth, count(*) OVER () AS calls FROM seeds LEFT JOIN hot h USING (query_id, id) GROUP BY query_id HAVING count(*) > 1),
edges AS (SELECT a.id AS a, b.id AS b, sum(step) AS c, max(CAST(floor(nth / 50) AS BIGINT)) AS last, max(CAST(floor(calls / 50) AS BIGINT)) AS decays FROM seeds a JOIN seeds b ON a.query_id = b.query_id AND a.id < b.id JOIN calls ON calls.query_id = a.query_id GROUP BY a.id, b.id),
g AS (SELECT a, b, c / (c + 2.0::DOUBLE) * pow(0.95::DOUBLE, decays - last) AS weight FROM edges), both_ways AS (SELECT a AS node, b AS neighbor, weight FROM g UNION ALL SELECT b, a, weight FROM g),
steps AS (SELECT node, neighbor, row_number() OVER (PARTITION BY node ORDER BY weight DESC, neighbor) AS step FROM both_ways WHERE weight >= 0.2),
y AS (SELECT query_id, id, 0 AS part, rank FROM seeds UNION ALL SELECT query_id, neighbor, 1, rank * 10 + step FROM seeds JOIN steps ON node = id WHERE rank <= 5 AND step <= 3),
z AS (SELECT query_id, id, min((part, rank)) AS place FROM y GROUP BY ALL), u AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS rank FROM z)
SELECT query_id, route, CAST(rank AS INT) AS rank, id, how FROM (
  SELECT query_id, 'hot_cache' AS route, rank, id, 'hot' AS how FROM near WHERE rank <= 3 AND query_id % 3 = 0
  UNION ALL SELECT u.query_id, 'enriched', u.rank, u.id, CASE WHEN h.id IS NULL THEN 'cold' ELSE 'hot' END FROM u LEFT JOIN hot h USING (query_id, id) WHERE u.rank <= 8 AND query_id % 3 = 1
  UNION ALL SELECT query_id, 'cold_storage', rank, id, 'ranked' FROM words WHERE rank <= 8 AND query_id % 3 = 2)""")
def retrieval_loop(spark, d):
    entries = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", V.hashed_encoding(F.col("text")).alias("vector"))
    entries = stage(entries, "entries")
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), V.hashed_encoding(F.col("text")).alias("vector"))
    _, record = memory.retrieve_batch(asked.withColumn("route", F.lit("enriched")), entries, entries, None, 8, 3)
    learnt = stage(graph.replay(record, cold="cold"), "graph")
    route = F.get(F.array(*[F.lit(r) for r in ROUTES]), (F.col("query_id") % 3).cast("int"))
    found, _ = memory.retrieve_batch(asked.withColumn("route", route), entries, entries, learnt, 8, 3)
    return found


@query(f"""WITH c AS (SELECT conv_id AS id, turn AS place, CASE WHEN role = 'user' OR turn = 0 THEN 'add' ELSE 'remove' END AS op, text FROM conversations),
l AS (SELECT id, max(place) FILTER (WHERE op = 'remove') AS gone FROM c GROUP BY id), a AS (SELECT id, arg_min(text, place) AS text FROM c JOIN l USING (id) WHERE op = 'add' AND (gone IS NULL OR place > gone) GROUP BY id),
docs AS (SELECT doc_id AS id, text FROM documents WHERE doc_id NOT IN (SELECT id FROM l WHERE gone IS NOT NULL) UNION ALL SELECT id, text FROM a WHERE id NOT IN (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM l WHERE gone IS NOT NULL))),
t AS (SELECT id, {S_T} AS toks FROM docs), p AS (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM t),
w AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({S_T}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM w) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n, avg(len(toks)) AS a FROM t),
s AS (SELECT query_id, id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM tf JOIN df USING (term) JOIN w USING (term), n GROUP BY ALL),
r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s WHERE score > 0)
SELECT query_id, CAST(rank AS INT) AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def changed_index(spark, d):
    changes = read(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("at"), F.when((F.col("role") == "user") | (F.col("turn") == 0), "add").otherwise("remove").alias("op"), "text")
    now = lexical.change(lexical.build(read(spark, d, "documents")), changes)
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return now.search(asked, 5).withColumn("score", r6("score"))


# training pairs and viewers -----------------------------------------------

S_WS = "[x for x in regexp_split_to_array({}, '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\p{{Z}}]+') if x <> '']"


@query(f"""WITH r AS (SELECT conv_id * 100000 + turn AS id, text AS original, {S_WS.format('text')} AS w FROM conversations), p AS (SELECT *, unnest(range(3)) AS copy FROM r),
c AS (SELECT 'head' AS strategy, 'faithful' AS label, 0.9::DOUBLE AS most, id, original, w, md5('7|head|' || id || '|' || copy) AS lot, 'head' AS kind FROM p UNION ALL SELECT 'part', 'hard_negative', 0.6::DOUBLE, id, original, w, md5('7|part|' || id || '|' || copy), 'part' FROM p),
m AS (SELECT *, CASE kind WHEN 'head' THEN array_to_string(w[1:CAST(ceil(len(w) * 0.7) AS INT)], ' ') ELSE array_to_string(w[1 + ('0x' || substr(lot, 1, 8))::BIGINT % 4:1 + ('0x' || substr(lot, 1, 8))::BIGINT % 4 + 3], ' ') END AS compressed FROM c),
a AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY lot) AS n FROM m WHERE compressed <> original AND len({S_WS.format('compressed')}) >= 3), t AS (SELECT * FROM a WHERE n <= 160),
v AS (SELECT *, {s_vector('original')} AS va, {s_vector('compressed')} AS vb FROM t),
k AS (SELECT *, coalesce(list_dot_product(va, vb) / sqrt(list_dot_product(va, va) * list_dot_product(vb, vb)), 0.0::DOUBLE) AS cosine FROM v),
f AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY lot) AS rank FROM k WHERE round(cosine, 9) <= most)
SELECT strategy, label, CAST(rank AS INT) AS rank, id, md5(compressed) AS digest, round(cosine, 6) AS cosine FROM f WHERE rank <= 40""")
def training_pairs(spark, d):
    rows = read(spark, d, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "text")
    words = lambda t: T.whitespace_tokens(t)
    head = lambda t, pick: F.array_join(F.slice(words(t), F.lit(1), F.ceil(F.size(words(t)) * 0.7).cast("int")), " ")
    part = lambda t, pick: F.array_join(F.slice(words(t), (F.lit(1) + pick % 4).cast("int"), F.lit(4)), " ")
    made = pairs.training_pairs(rows, {"head": (head, "faithful", 0.9), "part": (part, "hard_negative", 0.6)}, 40, V.hashed_encoding, copies=3)
    return made.select("strategy", "label", "rank", "id", F.md5("compressed").alias("digest"), r6("cosine").alias("cosine"))


@query(f"""WITH r AS (SELECT source AS session, doc_id AS seq, text, {S_WS.format('text')} AS w FROM documents), n AS (SELECT session, count(*) AS lines FROM r GROUP BY session HAVING count(*) > 4),
d AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY md5('7|' || session || '|' || seq), seq) AS rank FROM r JOIN n USING (session)), e AS (SELECT *, CAST(floor((rank - 1) / 2) AS BIGINT) AS pair FROM d WHERE rank <= 20),
g AS (SELECT a.session, a.text AS a, b.text AS b FROM e a JOIN e b ON a.session = b.session AND a.pair = b.pair AND a.rank < b.rank WHERE a.pair < least(10, CAST(floor(a.lines / 2) AS BIGINT)) AND a.text <> b.text)
SELECT session, 'positive' AS label, md5(array_to_string(w[1:CAST(floor(len(w) / 2) AS INT)], ' ')) AS compressed, md5(text) AS original FROM r WHERE len(w) > 12
UNION ALL SELECT session, 'negative', md5(substr(a, 1, 100)), md5(substr(b, 1, 300)) FROM g""")
def session_pairs(spark, d):
    made = pairs.session_pairs(read(spark, d, "documents"), "source", "doc_id")
    return made.select("session", "label", F.md5("compressed").alias("compressed"), F.md5("original").alias("original"))


@query(f"""WITH e AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS v FROM embeddings), p AS (SELECT a.vec_id AS id, b.vec_id AS positive, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id),
l AS (SELECT vec_id AS id, row_number() OVER (ORDER BY md5('7|' || vec_id), vec_id) - 1 AS place, count(*) OVER () AS total FROM e)
SELECT p.id, p.positive, CASE WHEN a.id <> p.positive THEN a.id ELSE b.id END AS negative FROM p JOIN l USING (id) JOIN l a ON a.place = (l.place + 1) % l.total JOIN l b ON b.place = (l.place + 2) % l.total WHERE rank = 1""")
def vector_triplets(spark, d):
    return pairs.triplets(read(spark, d, "embeddings")).select("id", "positive", "negative")


@query(f"""WITH t AS (SELECT conv_id AS session, turn AS seq, [tok for tok in regexp_extract_all(text, {q(P.ANCHOR_TOKEN)}) if length(tok) >= 6] AS held, {S_WS.format('text')} AS w FROM conversations),
x AS (SELECT session, seq, held, unnest(w) AS token, unnest(range(len(w))) AS pos FROM t) SELECT session, seq, CAST(pos AS INT) AS pos, token, list_contains(held, trim(token, '.,;:!?')) AS is_anchor FROM x""")
def token_events(spark, d):
    held = F.filter(T.anchor_tokens(F.col("text"), lower=False), lambda t: F.char_length(t) >= 6)
    return history.token_events(read(spark, d, "conversations").withColumn("anchors", held), "conv_id", "turn")


# a predictor --------------------------------------------------------------


@query()
def predicted_r_build(spark, d):
    """How near an untrained head comes to a document's vector from that of its shortened text, as part of the build's score."""
    text = F.col("text")
    rows = read(spark, d, "documents").select("doc_id", "text", T.truncate(text, 0.5).alias("short"))
    rows = rows.select("doc_id", V.hashed_encoding(text).alias("v"), V.hashed_encoding(F.col("short")).alias("s"), T.schema_gap_pair(text, F.col("short"), "deployment").alias("gap"))
    predict = predictor.predictor(predictor.fresh(spark, 64, 64))
    scored = rows.select("doc_id", "gap", V.dot(F.col("v"), F.col("s")).alias("cosine"), V.dot(F.col("v"), predict(F.col("s"))).alias("predicted"))
    return scored.select("doc_id", r6("cosine").alias("cosine"), r6("predicted").alias("predicted"), r6(V.r_build(F.col("cosine"), F.col("gap"), F.col("predicted"), (0.5, 0.3, 0.2))).alias("r_build"))


# shapes of texts ----------------------------------------------------------


@query("""WITH m AS (SELECT page_id, regexp_replace(coalesce(html, ''), '[^{}\\[\\]]', '', 'g') AS b FROM pages), c AS (SELECT page_id, b, unnest(range(1, length(b) + 1)) AS i FROM m),
s AS (SELECT page_id, i, sum(CASE WHEN substr(b, i, 1) IN ('{', '[') THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS s FROM c),
d AS (SELECT page_id, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS now FROM s) SELECT page_id, CAST(coalesce(max(now), 0) AS INT) AS depth FROM m LEFT JOIN d USING (page_id) GROUP BY page_id""")
def bracket_depths(spark, d):
    return read(spark, d, "pages").select("page_id", T.nesting_depth(F.coalesce("html", F.lit(""))).alias("depth"))


@query(f"""WITH c AS (SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'user' THEN '- ' ELSE '' END || text, chr(10) ORDER BY turn), '') AS text FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, trim(text, E' \\t\\n\\x0b\\x0c\\r') AS whole, [p FOR p IN [trim(x, E' \\t\\n\\x0b\\x0c\\r') FOR x IN regexp_split_to_array(text, {q(P.SECTION_START)})] IF p <> ''] AS p FROM c)
SELECT conv_id, CAST(CASE WHEN whole = '' THEN 0 ELSE greatest(len(p), 1) END AS INT) AS pieces, md5(CASE WHEN whole = '' THEN '' WHEN len(p) = 0 THEN whole ELSE array_to_string(p, '|') END) AS digest FROM s""")
def section_pieces(spark, d):
    """Pieces of whole conversations in which each question begins at a bullet."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.when(F.col("role") == "user", "- ").otherwise(""), F.col("text")).alias("line"))))
    texts = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["line"]), "\n").alias("text"))
    pieces = T.sections(F.col("text"))
    return texts.select("conv_id", F.size(pieces).alias("pieces"), F.md5(F.array_join(pieces, "|")).alias("digest"))
