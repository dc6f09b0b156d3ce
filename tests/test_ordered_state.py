"""Running totals, folds, rewrites, reuse, decays and running anchors against plain replays."""

import json
import math
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import anchors, graph, ordered, reuse, rewrites, state
from lumenfold.streaming import rewrite as stream


def test_running_totals_as_by_hand(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", None]), rng.randint(0, 5), rng.randint(-3, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, g string, at int, v int").withColumn("total_seen", F.lit(1))
    got = {r["id"]: (r["before"], r["total"]) for r in ordered.running_totals(df, ["g"], [F.desc("at"), "id"], "v", parts=7).collect()}
    for i, g, at, v in rows:
        group = [x for x in rows if x[1] == g]
        assert got[i] == (sum(x[3] for x in group if (-x[2], x[0]) < (-at, i)), sum(x[3] for x in group))
    whole = ordered.running_totals(df, [], ["id"], parts=5).orderBy("id").collect()
    assert [(r["before"], r["total"]) for r in whole] == [(i, 900) for i in range(900)]
    assert ordered.running_totals(df.limit(0), ["g"], ["id"]).count() == 0


def test_fold_holds_only_its_state(spark):
    df = spark.createDataFrame([(k, i) for i in range(300) for k in (1, 2, None)], "k int, i int").repartition(5)

    def start():
        sums = [0]

        def step(row):
            sums[0] += row["i"]
            return [(row["k"], row["i"], sums[0])] if row["i"] % 2 == 0 else []

        return step

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = ordered.keyed_fold(df, ["k"], ["i"], start, "k int, i int, s long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(str, got)) == sorted(map(str, [(k, i, i * (i + 1) // 2) for k in (1, 2, None) for i in range(0, 300, 2)])) or {(r["k"], r["i"], r["s"]) for r in got} == {(k, i, i * (i + 1) // 2) for k in (1, 2, None) for i in range(0, 300, 2)}


def test_eviction_in_groups_without_a_name(spark):
    rows = [(g, i, 10, i % 7, i % 3, i % 4, 0.5) for g in ("a", None) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, seq int, tokens int, turn int, misses int, hits int, novelty double")
    got = state.evict(df, 400, ["g"]).collect()
    for g in ("a", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (-r["score"], r["seq"]))
        assert len(own) == 60 and [r["evicted"] for r in own] == [600 - 10 * n > 280 for n in range(60)]


# rewrites


def look_ups(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["e1"] * 5 + ["e2", "e3", "e4"]), t, rng.choice(["Where is the log", "is it so", None, "the Config file", "a b"]), rng.random() < 0.5) for t in range(n)]


def plain_rewrites(log):
    counts, last, words, nth, out = {}, {}, {}, {}, []
    for key, turn, query, miss in log:
        if miss:
            counts[key] = counts.get(key, 0) + 1
            words.setdefault(key, {}).update(dict.fromkeys(w for w in (query or "").lower().split() if len(w) >= 3))
        if counts.get(key, 0) > 2 and turn - last.get(key, -6) > 5:
            nth[key] = nth.get(key, 0) + 1
            out.append((key, turn, nth[key], counts[key], list(words[key])))
            counts[key], last[key] = 0, turn
    return out


LOG = "key string, turn long, query string, miss boolean"


def test_schedule_as_a_replay(spark):
    log = look_ups(4)
    df = spark.createDataFrame([*log, (None, 3, "x", True), ("e1", None, "x", True)], LOG).repartition(6)
    got = sorted(tuple(r) for r in rewrites.schedule(df, "key", "turn", "query", F.col("miss")).collect())
    assert got == sorted(plain_rewrites(log)) and len(got) > 20


def test_swap_of_entries(spark):
    entries = spark.createDataFrame([("a", "aa", 0.3, [1.0], 0.5, 7), ("b", "bb", 0.9, [1.0], 0.5, 8), ("c", "cc", 0.5, [1.0], 0.5, 9)], "key string, text string, budget double, vector array<double>, score double, kept int")
    done = spark.createDataFrame([("a", 1, ["x"]), ("a", 2, ["x", "yy"]), ("b", 1, ["z"]), ("c", 1, ["z"])], "key string, nth int, anchors array<string>")
    originals = spark.createDataFrame([("a", "abcdefghij"), ("b", "0123456789")], "key string, original string")
    cut = lambda text, budget, words: F.concat(F.substring(text, F.lit(1), F.floor(budget * 10 + 1e-9).cast("int")), F.array_join(words, ""))
    size = lambda text: F.array(F.char_length(text).cast("double"))
    got = {r["key"]: tuple(r)[1:] for r in rewrites.swapped(entries, done, originals, cut, size, lambda a, b: a[0] - b[0]).collect()}
    assert {k: (v[0], round(v[1], 9), *v[2:]) for k, v in got.items()} == {"a": ("abcdefgxyy", 0.7, [10.0], 0.0, 7, True), "b": ("0123456789z", 1.0, [11.0], -1.0, 8, True), "c": ("cc", 0.5, [1.0], 0.5, 9, False)}


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(stream.STORE[0])
    spark.conf.set(*stream.STORE)
    yield spark
    spark.conf.set(stream.STORE[0], old)


def test_stream_of_rewrites_with_a_restart(rocks, tmp_path):
    folder, at, out = tmp_path / "in", tmp_path / "at", tmp_path / "out"
    folder.mkdir()
    log = look_ups(9, 240)

    def put(name, rows):
        (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("key", "turn", "query", "miss"), r, strict=True))) for r in rows))

    def run():
        rows = rocks.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(folder))
        asked = stream.stream_rewrites(rows, "key", "turn", "query", F.col("miss"))
        q = asked.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(at)).trigger(availableNow=True).start()
        q.awaitTermination()

    for n in range(3):
        put(n, log[n * 50 : n * 50 + 50])
    run()
    for n in range(3, 5):  # a new query on the same checkpoint goes on where the first one ended
        put(n, log[n * 50 : n * 50 + 50])
    run()
    got = sorted((r["key"], r["turn"], r["nth"], r["misses"], r["anchors"]) for r in rocks.read.parquet(str(out)).collect())
    assert got == sorted(plain_rewrites(log)) and any(t >= 150 for _, t, *_ in got)


def test_idle_entries_are_told_and_forgotten(rocks, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "0.json").write_text(json.dumps({"key": "a", "turn": 1, "query": "lost words", "miss": True}))
    rows = rocks.readStream.schema(LOG).json(str(folder))
    q = stream.stream_rewrites(rows, "key", "turn", "query", F.col("miss"), idle_ms=1, ttl_ms=600_000).writeStream.format("memory").queryName("idle_rewrites").option("checkpointLocation", str(tmp_path / "at")).start()
    try:
        until = time.time() + 60
        while time.time() < until and q.isActive:  # timers fire with later batches
            time.sleep(1)
            (folder / f"x{time.time()}.json").write_text(json.dumps({"key": "b", "turn": 1, "query": "", "miss": False}))
            got = [tuple(r) for r in rocks.table("idle_rewrites").where("key = 'a'").collect()]
            if got:
                break
        assert got == [("a", "idle", 1, 0, 1, ["lost words"])]
    finally:
        q.stop()


def test_stream_needs_its_store(spark):
    rows = spark.readStream.format("rate").load().selectExpr("'k' AS key", "value AS turn", "'q' AS query", "true AS miss")
    if spark.conf.get(stream.STORE[0]) != stream.STORE[1]:
        with pytest.raises(RuntimeError, match="stateStore"):
            stream.stream_rewrites(rows, "key", "turn", "query", F.col("miss"))


# graph


def plain_graph(calls, every, factor, least):
    counts, weights, n = {}, {}, 0
    for nodes, cold in calls:
        nodes = sorted(set(nodes))
        if len(nodes) < 2:
            continue
        for i, a in enumerate(nodes):
            for b in nodes[i + 1 :]:
                counts[a, b] = counts.get((a, b), 0) + (3 if cold else 1)
                weights[a, b] = counts[a, b] / (counts[a, b] + 2)
        n += 1
        if n % every == 0:
            weights = {k: w * factor for k, w in weights.items() if w * factor >= least}
            counts = {k: c for k, c in counts.items() if k in weights}
    return {(*k, counts[k]): w for k, w in weights.items()}


@pytest.mark.parametrize(("every", "factor", "least", "n"), [(50, 0.95, 0.05, 120), (3, 0.5, 0.2, 400), (1, 0.9, 0.3, 300), (2, 0.95, 0.05, 900)])
def test_graph_as_a_replay(spark, every, factor, least, n):
    rng = random.Random(n)
    calls = [([rng.choice([0, 1, 2, rng.randint(3, 14)]) for _ in range(rng.randint(1, 4))], rng.random() < 0.2) for _ in range(n)]
    rows = [(i * 3, node, cold) for i, (nodes, cold) in enumerate(calls) for node in nodes] + [(None, 1, False), (None, 2, False), (5, None, True)]
    df = spark.createDataFrame(rows, "call int, node int, cold boolean").repartition(4)
    got = {(r["a"], r["b"], r["count"]): r["weight"] for r in graph.replay(df, cold="cold", every=every, factor=factor, least=least).collect()}
    wanted = plain_graph(calls, every, factor, least)
    assert got.keys() == wanted.keys() and all(math.isclose(got[k], w, rel_tol=1e-9) for k, w in wanted.items())
    half = graph.replay(df, cold="cold", every=every, factor=factor, least=least, frozen=F.col("call") >= 3 * (n // 2))
    assert {(r["a"], r["b"], r["count"]) for r in half.collect()} == plain_graph(calls[: n // 2], every, factor, least).keys()


# reuse


def test_reuse_as_a_replay(spark):
    rng = random.Random(3)
    rows = [(s, i, f"u{rng.randint(0, 40)}", None if rng.random() < 0.1 else [math.cos(x := rng.random() * 6), math.sin(x)]) for s in ("a", "b", None) for i in range(120)]
    df = spark.createDataFrame(rows, "session string, seq int, uuid string, vector array<double>").repartition(5)
    wanted = {}
    for s in ("a", "b", None):
        cache = {}
        for _, i, u, v in (r for r in rows if r[0] == s):
            best = max((((c[1][0] * v[0] + c[1][1] * v[1]), -n, c[0]) for n, c in enumerate(cache.values()) if c[1]), default=None) if v else None
            if u in cache:
                wanted[s, i] = ("uuid", cache[u][0], None)
            elif best and best[0] > 0.999:
                wanted[s, i] = ("similar", best[2], None)
            else:
                gone = cache.pop(next(iter(cache)))[0] if len(cache) == 12 else None
                cache[u] = (i, v)
                wanted[s, i] = ("miss", i, gone)
    made = reuse.context_reuse(df, threshold=0.999, most=12)
    got = {(r["session"], r["seq"]): (r["how"], r["source_seq"], r["evicted_seq"]) for r in made.collect()}
    assert got == wanted and {h for h, *_ in got.values()} == {"uuid", "similar", "miss"} and any(e is not None for *_, e in got.values())
    asked = []
    named = reuse.with_contexts(made, df, lambda missed: asked.append(missed.count()) or missed.select("session", "seq", F.concat("uuid", F.lit("!")).alias("context")))
    uuids = {(r[0], r[1]): r[2] for r in rows}
    assert {(r["session"], r["seq"]): r["context"] for r in named.where("session = 'a'").collect()} == {k: uuids["a", w[1]] + "!" for k, w in wanted.items() if k[0] == "a"}
    assert asked == [sum(w[0] == "miss" for k, w in wanted.items() if k[0])]


# anchors


def test_middle_as_sorted():
    rng = random.Random(8)
    middle, seen = anchors.Middle(), {}
    assert middle.middle() is None
    for _ in range(3_000):
        tok = rng.choice([rng.randint(0, 5), rng.randint(0, 400)])
        seen[tok] = seen.get(tok, 0) + 1
        middle.grow(seen[tok])
        order = sorted(seen.values())
        assert middle.middle() == (order[(len(order) + 1) // 2 - 1], order[len(order) // 2])


def test_anchors_so_far(spark):
    rng = random.Random(2)
    vocab = [f"word{c}" for c in "abcdefghij"] + ["rare" + c for c in "klmnopqrstuvwxyz"]
    texts = [" ".join(rng.choice(vocab[: rng.choice([3, 10, 26])]) for _ in range(rng.randint(0, 6))) + (" HTTP 404 see src/a.py step 3" if i % 9 == 0 else "") for i in range(45)]
    rows = [("s", i, t) for i, t in enumerate(texts)] + [("same", i, "alpha beta gamma") for i in range(25)] + [("none", 0, None), ("none", 1, "")]
    got = {(r["session"], r["seq"]): r for r in anchors.running_anchors(spark.createDataFrame(rows, "session_id string, seq int, text string").repartition(4)).collect()}
    seen = {}
    for i, t in enumerate(texts):
        own = {w for w in t.lower().split() if w in vocab}
        for w in own:
            seen[w] = seen.get(w, 0) + 1
        extra = {"http": 0}
        if i % 9 == 0:
            seen["http"] = seen.get("http", 0) + 1
            seen["step"] = 0
        idfs = {w: math.log(1 + (i + 1) / (1 + n)) for w, n in seen.items() if w != "step"}
        r = got["s", i]
        assert r["n"] == i + 1
        if idfs:
            assert math.isclose(r["median_idf"], statistics.median(idfs.values()))
        first = ["src/a.py", "HTTP 404", "step 3", "HTTP", "404", "3"] if i % 9 == 0 else []
        second = [w for _, w in sorted((-idfs[w], w) for w in own | (extra.keys() if i % 9 == 0 else set()) if idfs[w] >= statistics.median(idfs.values()) - 1e-12)] if i >= 19 and idfs else []
        assert r["anchors"] == (first + second)[:10]
    assert got["same", 24]["anchors"] == ["alpha", "beta", "gamma"] and got["same", 18]["anchors"] == []
    assert [(got["none", i]["n"], got["none", i]["median_idf"], got["none", i]["anchors"]) for i in (0, 1)] == [(1, None, []), (2, None, [])]


def test_a_long_session_is_folded_by_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice(["long"] * 8 + ["a", "b"]), i, " ".join(f"word{chr(97 + min(int(rng.expovariate(0.2)), 25))}" for _ in range(rng.randint(0, 12)))) for i in range(400)]
    wanted, seen, passed = {}, {}, {}
    for s, i, t in rows:
        own, tokens, passed[s] = seen.setdefault(s, {}), sorted(set(t.split())), passed.get(s, 0) + 1
        for w in tokens:
            own[w] = own.get(w, 0) + 1
        low = statistics.median_low(own.values()) if own else 0
        idfs = [math.log(1 + passed[s] / (1 + n)) for n in own.values()]
        rare = [w for n, w in sorted((own[w], w) for w in tokens) if n <= low] if passed[s] >= 20 else []
        wanted[s, i] = (passed[s], round(statistics.median(idfs), 9) if idfs else None, rare[:10])
    sizes, fold = [], anchors.keyed_fold
    monkeypatch.setattr(anchors, "keyed_fold", lambda df, keys, *rest: sizes.append([r["count"] for r in df.groupBy(*keys).count().collect()]) or fold(df, keys, *rest))
    monkeypatch.setattr(anchors, "BLOCK", 20, raising=False)
    out = anchors.running_anchors(spark.createDataFrame(rows, "session_id string, seq int, text string").repartition(3))
    got = {(r["session"], r["seq"]): (r["n"], None if r["median_idf"] is None else round(r["median_idf"], 9), r["anchors"]) for r in out.collect()}
    assert got == wanted and any(len(w[2]) > 0 for w in wanted.values())
    assert max(sizes[0]) < 150


def test_anchors_of_rows_without_session_or_place_as_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from lumenfold.plans import catalogue, state_queries  # noqa: F401  (registers the query)

    rows = [(None if i % 7 == 0 else i, f"alpha beta{chr(97 + i % 5)} gamma{chr(97 + i % 3)} src/a.py", None if i % 4 == 0 else "s") for i in range(60) if i % 7 or i in (7, 14, 28)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").where("doc_id IS NOT NULL OR source IS NULL").union(spark.createDataFrame([(None, "alpha betaa new", "s")], "doc_id long, text string, source string")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = duckdb.sql(catalogue.SQL["running_anchors"]).fetchall()
    got = [tuple(r) for r in catalogue.QUERIES["running_anchors"](spark, str(tmp_path)).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(wanted, key=key) and any(r[0] is None for r in wanted)


def test_tokens_of_a_batch_as_catalyst(spark):
    odd = ["STEP12 Step\u212aey 12 ab.cd a.b.cde/x.py \u0130STANBULER the THE Abcd API_KEY TypeError x.p \u212aELVIN K-2 ÄRGERabcd", "", None, "...... ---- a/b_c-d.E1 4711 aaaaé.abc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, text string")
    held = F.filter(F.array_distinct(anchors.anchor_tokens(F.col("text"))), lambda t: ~anchors.is_stopword_or_short(t) & ~anchors.is_tier_one(t))
    first = F.array_distinct(F.filter(anchors.anchor_tokens(F.col("text"), lower=False), anchors.is_tier_one))
    wanted = {r["i"]: (r["first"] or [], " ".join(r["held"] or [])) for r in df.select("i", first.alias("first"), held.alias("held")).collect()}
    got = {r["i"]: (r["structural"], r["held"]) for r in df.mapInArrow(anchors._split, "i int, structural array<string>, held string").collect()}
    assert got == wanted and len(wanted[0][0]) > 5
    chars = spark.range(128, 0x110000).where("id NOT BETWEEN 55296 AND 57343").select("id", F.lower(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")).alias("low"))
    assert {r["id"]: r["low"] for r in chars.where(r"low RLIKE '[\\x00-\\x7f]'").collect()} == anchors._LOWER
