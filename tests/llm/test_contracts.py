"""The registered queries against their SQL, and the operators with clashing columns, long texts and awkward orders."""

import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import bpe, common, decontaminate, html_wrapper, kdtree, line_dedup, minhash, queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got = queries.queries()[name](spark, SF)
    wanted = con.execute(queries.oracle_sql()[name])
    order = [x[0] for x in wanted.description]
    assert sorted(got.columns) == sorted(order)
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == sorted(tuple(map(plain, r)) for r in wanted.fetchall())


def test_line_dedup_with_any_names_and_long_texts(spark):
    names = ["_ld_lines", "_ld_drop", "_ld_id", "row", "lines", "drop", "mark", "id", "drop_id", "salt"]
    long = "\n".join(f"line number {i}" for i in range(30_000))
    docs = spark.createDataFrame([(1, long), (2, long + "\nanother line of two"), (3, None)], "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: long, 2: "another line of two", 3: None}
    assert all(r[n] == n for r in out.collect() for n in names)


def test_one_line_in_many_documents(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("the line of them all\nown "), F.lpad("id", 9, "0")).alias("text"))
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup_report(docs).collect()}
    assert got == {i: int(i > 0) for i in range(300)}
    none = line_dedup.line_dedup_report(docs, min_docs=301)
    assert none.agg(F.sum("n_dropped")).first()[0] == 0


def small_vocabulary(tmp_path):
    ranks = {bytes([i]): i for i in range(256)} | {t: 256 + k for k, t in enumerate([b"cd", b"abc", b"ab", b"abcd", b"bb", b"abab"])}
    path = tmp_path / "small.ranks"
    path.write_text("\n".join(f"{base64.b64encode(t).decode()} {r}" for t, r in ranks.items()))
    return str(path), ranks


def merged(raw, ranks):
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@pytest.mark.parametrize("group", [1, 100, 1 << 12])
def test_bpe_groups_as_one_by_one(tmp_path, group, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP_BYTES", group)
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 50)
    path, ranks = small_vocabulary(tmp_path)
    rng = random.Random(group)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 40))) for _ in range(600)]
    coder = bpe.Bpe(path, r"\S+|\s+")
    for part in (words[:300], words[200:], words):
        wanted = [[ranks[w.encode()]] if w.encode() in ranks else merged(w.encode(), ranks) for w in part]
        assert [coder.encode(w) for w in part[:40]] == wanted[:40]
        assert [list(bpe.array("i", x)) for x in coder.packed(part)] == wanted


def test_bpe_long_pre_token():
    P = pytest.importorskip("public_tokenizers")
    coder = bpe.Bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = "ab" * 200_000
    assert coder.decode(coder.encode(text)) == text.encode()
    assert text not in coder.memo


def test_html_with_any_names(spark):
    page = '<html><body><div id="top">Site</div><article><p>%s</p></article></body></html>'
    rows = [(i, f"http://h.org/{i}", page % (f"words of {i} " * 9)) for i in range(5)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit(n) for n in ("_wrapper", "_hw_host", "_host", "_layout", "row", "of_host")})
    out = html_wrapper.extract(pages)
    assert out.columns == [*pages.columns, "main_text"] and out.count() == 10
    assert {(r["page_id"], r["main_text"], r["_wrapper"], r["_hw_host"]) for r in out.collect()} == {(i, ("words of %d " % i * 9).strip(), "_wrapper", "_hw_host") for i in range(5)}


def test_candidates_lose_no_leak(spark, monkeypatch):
    rng = random.Random(6)
    vocab = ["river", "stone", "lamp", "Anna", "Berlin", "12", "3.5", "km", "walks", "over", "the", "old", "and", "sees", "Paul", "7", "kg", "green", "of"]
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, words(rng.randint(2, 30))) for i in range(25)] + [(100, "Anna Paul Berlin 12 7 3.5 Anna Berlin"), (101, None), (101, words(9))]
    docs = [(i, f"{words(12)} {rng.choice(items[:26])[1]} {words(12)}") for i in range(80)] + [(200, None), (201, ""), (202, words(4))] + [(5, words(40))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    some = {tuple(r) for r in decontaminate.contaminated_pairs(d, b).collect()}
    empty = spark.createDataFrame([], "item long, hash long, size int")
    monkeypatch.setattr(decontaminate, "necessary_windows", lambda *a: empty)  # all documents are read as templates
    assert some == {tuple(r) for r in decontaminate.contaminated_pairs(d, b).collect()} and some
    assert decontaminate.contaminated_pairs(d, b.limit(0)).count() == 0


def test_leaks_with_digits_in_words(spark, monkeypatch):
    items = [(1, "install python3.11 before using numpy1.26 here"), (2, "the mp3 file has 3.5mb and the h264 film has 60km of track"), (3, "walk 5km north then 12 km south of here")]
    docs = [(1, items[0][1]), (2, f"first {items[0][1]} and then rest"), (3, items[1][1]), (4, "so walk 5 km north then 12km south of here again"), (5, "install it before using here")]
    rng = random.Random(2)
    vocab = ["mp3", "v1.2", "python3.11", "1,250", "2.5kg", "7km", "km", "m", "and", "we", "read", "the", "old", "Anna", "x86", "3d", "4", "kg.", "c3.5", "9.9.9"]
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items += [(10 + i, words(rng.randint(3, 20))) for i in range(60)]
    glue = lambda t: t.replace(" km", "km") if rng.random() < 0.5 else t.replace("7km", "7 km")
    docs += [(10 + i, f"{words(6)} {glue(rng.choice(items)[1])} {words(6)}") for i in range(400)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    some = {tuple(r) for r in decontaminate.contaminated_pairs(d, b).collect()}
    assert {(1, 1), (2, 1), (3, 2), (4, 3)} <= {x[:2] for x in some} and (5, 1) not in {x[:2] for x in some}
    monkeypatch.setattr(decontaminate, "necessary_windows", lambda *a: spark.createDataFrame([], "item long, hash long, size int"))
    assert some == {tuple(r) for r in decontaminate.contaminated_pairs(d, b).collect()} and len(some) > 100


def test_scores_beyond_64_bits_are_refused(spark):
    for big in (1e8, 1e30):
        rows = spark.createDataFrame([(i, [big, big]) for i in range(3)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="beyond 64 bits"):
            kdtree.exact_topk(rows, F.col("vec_id") == 0).collect()


def test_large_group_needs_no_pair_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", 10)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*base, f"end{i}"])) for i in range(60)] + [(100, "another text " * 9), (101, None)]
    seen = []
    links = minhash.open_links
    monkeypatch.setattr(minhash, "open_links", lambda full, members, percent: seen.append(members.count()) or links(full, members, percent))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(60)} | {100: 100, 101: 101} and seen == [0]


def test_processes_remember_for_one_operator():
    held = {"a": 1}
    common.remembering("one", held.clear)
    common.remembering("one", held.clear)
    assert held
    common.remembering("two", lambda: None)
    assert not held
