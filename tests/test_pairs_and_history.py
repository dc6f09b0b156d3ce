"""Training pairs against plain versions, and the history of a stream that late joiners read."""

import json
import random

from pyspark.sql import functions as F

from lumenfold.operators import pairs
from lumenfold.streaming import history


def plain_cut(left, most):
    """Word after word: past the half a small word goes with the one behind it, until there are enough."""
    out, skip = [], False
    for w in left:
        if len(out) >= most:
            break
        if skip:
            skip = False
        elif w in pairs.SMALL_WORDS and len(out) > most * 0.5:
            skip = True
        else:
            out.append(w)
    return out


def test_faithful_cut_as_word_by_word(spark):
    rng = random.Random(4)
    vocab = ["log", "disk", "node", "Server", "in", "on", "by", "of", "and", "x7", "a/b"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for ratio in (0.4, 0.7, 0.95):
        got = {r["id"]: r["c"] for r in rows.select("id", pairs.faithful_compress(F.col("t"), ratio).alias("c")).collect()}
        for i, t in enumerate(texts):
            words = t.split()
            most = max(3, int(len(words) * ratio))
            assert got[i] == " ".join(words if len(words) <= most else plain_cut(words, most)), t


def test_first_of_strata(spark):
    rows = [("hot", f"{i * 7919 % 1000:04}") for i in range(1_000)] + [(None, "5"), ("few", "1"), ("few", "2")]
    got = {}
    for r in pairs.first_of(spark.createDataFrame(rows, "g string, lot string"), ["g"], ["lot"], 30, buckets=8).orderBy("rank").collect():
        got.setdefault(r["g"], []).append((r["rank"], r["lot"]))
    assert got == {"hot": [(i + 1, f"{i:04}") for i in range(30)], "few": [(1, "1"), (2, "2")], None: [(1, "5")]}


def test_pairs_of_strategies(spark):
    rows = spark.createDataFrame([(i, f"one two three four{i} five six") for i in range(50)] + [(99, None), (98, "too short")], "id int, text string")
    strategies = {"same": (lambda t, pick: t, "faithful", 0.99), "short": (lambda t, pick: F.substring(t, 1, 7), "faithful", 0.99), "next": (lambda t, pick: F.concat(t, F.lit(" "), pick.cast("string")), "hard_negative", 0.99), "far": (lambda t, pick: F.lit("quite another text"), "hard_negative", 0.5)}
    encode = lambda t: F.when(t.contains("another"), F.array(F.lit(-0.6), F.lit(0.8))).otherwise(F.array(F.lit(0.8), F.lit(0.6)))
    made = pairs.training_pairs(rows, strategies, 20, encode)
    got = {}
    for r in made.collect():
        got.setdefault(r["strategy"], []).append(r)
    # pairs as they are, too short, or too near are left out
    assert set(got) == {"far"} and sorted(r["rank"] for r in got["far"]) == [*range(1, 21)]
    assert all((r["label"], r["compressed"], round(r["cosine"], 9)) == ("hard_negative", "quite another text", 0.0) for r in got["far"]) and {r["id"] for r in got["far"]} <= {*range(50), 98}
    assert made.select("strategy", "id", "compressed").exceptAll(pairs.training_pairs(rows.repartition(3), strategies, 20, encode).select("strategy", "id", "compressed")).count() == 0


def test_pairs_of_sessions(spark):
    lines = [("a", i, f"line {i} " + "w " * (i % 20)) for i in range(60)] + [("b", i, "same") for i in range(9)] + [("c", 1, "x " * 40), ("c", 2, None)]
    got = {}
    for r in pairs.session_pairs(spark.createDataFrame(lines, "session string, seq int, text string"), most=4).collect():
        got.setdefault((r["session"], r["label"]), []).append((r["compressed"], r["original"]))
    assert len(got["a", "negative"]) == 4 and all(a != b for a, b in got["a", "negative"]) and ("b", "negative") not in got and ("c", "negative") not in got
    assert sorted(got["a", "positive"]) == sorted((" ".join(t.split()[: len(t.split()) // 2]), t) for s, _, t in lines if s == "a" and len(t.split()) > 12) and len(got["c", "positive"]) == 1


def test_triplets(spark):
    rows = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(30)] + [(40, None)], "vec_id int, embedding array<double>")
    got = pairs.triplets(rows).collect()
    assert {r["id"] for r in got} == set(range(30)) and all(r["negative"] is not None and r["negative"] not in (r["id"], r["positive"]) for r in got)
    assert [(r["id"], r["negative"]) for r in pairs.triplets(rows.where("vec_id < 2")).orderBy("id").collect()] == [(0, None), (1, None)]


def test_history_of_a_stream(spark, tmp_path):
    folder, at, out = tmp_path / "in", str(tmp_path / "at"), str(tmp_path / "out")
    folder.mkdir()
    schema = "session string, seq long"

    def run(n):
        (folder / f"{n}.json").write_text("\n".join(json.dumps({"session": "s", "seq": n * 10 + i}) for i in range(5)))
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        history.keep_history(rows, out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination(60)

    run(0)
    run(1)
    seen, last = history.history(spark, out, schema)
    assert last == 1 and sorted(r["seq"] for r in seen.collect()) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]
    for commit in (tmp_path / "at" / "commits").glob("*1*"):
        commit.unlink()  # as if it had ended before it said that batch 1 was done: the batch runs again
    run(2)
    tail, last = history.history(spark, out, schema, after=last)
    assert last == 2 and sorted(r["seq"] for r in tail.collect()) == [20, 21, 22, 23, 24]
    whole, _ = history.history(spark, out, schema)
    assert whole.count() == 15 == whole.distinct().count()
    assert history.history(spark, out, schema, after=2)[1] == 2


def test_token_events(spark):
    rows = spark.createDataFrame([("s", 1, " Restart node-7, now. ", ["node-7", "now"]), ("s", 2, None, None), ("s", 3, "a", None)], "session string, seq int, text string, anchors array<string>")
    assert [tuple(r) for r in history.token_events(rows).orderBy("seq", "pos").collect()] == [("s", 1, 0, "Restart", False), ("s", 1, 1, "node-7,", True), ("s", 1, 2, "now.", True), ("s", 3, 0, "a", False)]
