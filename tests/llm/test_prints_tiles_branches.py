"""Fingerprints, whitening and branch merges against brute force, planted cases and awkward tables."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import branch_merge, queries, simhash, whitening

SF = "/root/testdata/sf0.001"


def slow_print(text):
    xxhash = pytest.importorskip("xxhash")
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for white in "\t\n\x0b\x0c\r":
        low = low.replace(white, " ")
    words = [w for w in low.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints, within):
    """The least key that each key reaches, over all pairs."""
    root = {k: k for k in prints}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= within:
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {k: top(k) for k in keys}


def test_fingerprint_as_by_hand(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \t\r\n", "one", "One Two", "a b c", "é É ß x y z", *(" ".join(rng.choice(["Ab", "cd", "é", "Ω9"]) for _ in range(n)) for n in (3, 4, 7, 300))]
    for piece in (1, 13, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert [simhash.fingerprint(t.encode() if t is not None else None) for t in texts] == [slow_print(t) for t in texts]


@pytest.mark.parametrize(("bucket", "index", "within"), [(1_024, 1 << 15, 2), (3, 20, 2), (2, 1, 1), (5, 100, 3)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, bucket, index, within):
    monkeypatch.setattr(simhash, "INDEX", index)
    monkeypatch.setattr(simhash, "WALK", 37)
    rng = random.Random(bucket)
    values = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(6):  # chains, near groups, and dense balls around one value
        at = rng.getrandbits(64)
        for _ in range(25):
            values.add(at)
            for _ in range(rng.randint(1, 4)):
                at ^= 1 << rng.randrange(64)
    ball = rng.getrandbits(64)
    values |= {ball ^ (1 << rng.randrange(12)) ^ (1 << rng.randrange(64)) for _ in range(80)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.hamming_links(spark.createDataFrame([(v,) for v in signed], "print long"), within, bucket).collect()
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") for r in links)
    root = {v: v for v in signed}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in links:
        low, high = sorted((top(r["a"]), top(r["b"])))
        root[high] = low
    assert {v: top(v) for v in signed} == slow_components({v: v & (1 << 64) - 1 for v in signed}, within)


def test_gray_index_finds_each_pair_once():
    rng = np.random.default_rng(5)
    prints = np.unique(np.uint64(7 << 40) ^ (np.uint64(1) << rng.integers(0, 20, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 20, 400).astype(np.uint64)) ^ rng.integers(0, 4, 400).astype(np.uint64))
    buckets = np.sort(rng.integers(0, 3, len(prints)))
    one, two = simhash.GrayIndex(prints, buckets).pairs(np.arange(len(prints)), 2)
    wanted = {(i, j) for j in range(len(prints)) for i in range(j) if buckets[i] == buckets[j] and int(prints[i] ^ prints[j]).bit_count() <= 2}
    assert sorted(zip(one.tolist(), two.tolist(), strict=True)) == sorted(wanted) and wanted


def test_near_prints_of_a_whole_table(spark):
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(words[: 190 + i % 9])) for i in range(40)] + [(50, None), (51, " "), (52, ""), (None, " ".join(words)), (7, "quite another text here"), (60, "x " * 60_000)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", F.lit(1)).withColumn("fingerprint", F.lit("x"))).collect()
    prints = {}
    for k, t in rows:
        if k is not None:
            prints.setdefault(slow_print(t), []).append(k)
    firsts = {p: min(ks) for p, ks in prints.items()}
    named = slow_components({p: p for p in prints}, 2)
    least = {}
    for p, c in named.items():
        least[c] = min(least.get(c, firsts[p]), firsts[p])
    assert sorted((r["doc_id"] is None, r["doc_id"], r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted((False, k, f"{slow_print(t):016x}", least[named[slow_print(t)]]) for k, t in rows if k is not None)
    assert [(r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is None] == [(f"{slow_print(' '.join(words)):016x}", None)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_of_prints(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: slow_print(r["text"]) for r in rows}
    wanted = slow_components(prints, 2)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op11_simhash_near_dedup(spark, SF).collect()} == {(k, f"{p:016x}", wanted[k]) for k, p in prints.items()}


def slow_whitening(vectors, components):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    centred = x - x.sum(0) / len(x)
    v = centred.T @ centred / len(x)
    e, p = np.linalg.eigh(v)
    e, p = e[::-1][:components], p[:, ::-1][:, :components]
    return ((len(x) * x - x.sum(0)) ** 2).sum(1), centred @ p / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("tile", [3, 16, 64])
def test_whitening_as_at_once(spark, tile):
    rng = np.random.default_rng(tile)
    vectors = (rng.normal(size=(700, 20)) @ rng.normal(size=(20, 20)) + 5).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, []), (902, [1.0] * 19 + [None]), (903, [float("nan")] * 20), (904, [float("-inf")] * 20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("n", "component", "at", "_v")}).repartition(5)
    got = whitening.whiten(frame, components=7, tile=tile).collect()
    deviation, white, share = slow_whitening(vectors, 7)
    assert len(got) == 700 * 7 and {r["n"] for r in got} == {700}
    flips = {r["component"]: np.sign(r["whitened"] * white[0, r["component"] - 1]) for r in got if r["vec_id"] == 0}
    for r in got:
        i, c = r["vec_id"], r["component"]
        assert r["deviation"] == deviation[i]
        assert abs(r["whitened"] * flips[c] - white[i, c - 1]) < 1e-7 and abs(r["explained"] / share[c - 1] - 1) < 1e-9
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_of_whitening(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    place = {r["vec_id"]: n for n, r in enumerate(rows)}
    deviation, white, share = slow_whitening([r["embedding"] for r in rows], 32)
    got = queries.op12_embedding_whitening(spark, SF).collect()
    assert len(got) == 32 * len(rows) and {r["n"] for r in got} == {len(rows)}
    out = np.zeros(white.shape)
    for r in got:
        out[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[place[r["vec_id"]]] and abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
    signs = np.sign((out * white).sum(0))
    assert np.abs(out * signs - white).max() < 1e-6


def test_whitening_of_awkward_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([(1, None)])).collect() == []
    one = whitening.whiten(make([(1, [0.5, 2.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    tied = whitening.whiten(make([(None, [1.0, 3.0]), (2, [-1.0, 3.0]), (2, [-1.0, 3.0]), (3, [1.0, 3.0])])).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["whitened"]) for r in tied if r["component"] == 1) == [("2", 1, -1.0), ("2", 1, -1.0), ("3", 1, 1.0), ("None", 1, 1.0)]
    assert {r["whitened"] for r in tied if r["component"] == 2} == {None}
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [1e30])]):
        with pytest.raises(Exception, match="different lengths|too large"):
            whitening.whiten(make(bad)).collect()


def slow_merge(rows):
    """The merge of the contract, thing by thing over plain dicts."""
    code = lambda b, i, x: zlib.crc32(f"{b}:{i}:{x}".encode()) % 17
    out, added = {}, {}
    for i, lang, source, text in rows:
        base = {"lang": lang or "", "source": source or ""} | {("line", n): x for n, x in enumerate((text or "").split("\n"))}
        last = len((text or "").split("\n"))
        side = {}
        for b, new in (("L", -1 - i), ("R", -5 - i)):
            here = {}
            for k in base:
                c = code(b, i, k if isinstance(k, str) else k[1])
                if c == 0:
                    here[k] = "" if isinstance(k, str) else None
                elif c in (1, 2):
                    here[k] = base[k] + " !?"[c]
                elif c in (3, 4) and not isinstance(k, str):
                    here["gap", k[1]] = "!?"[c - 3]
            here = {k: v for k, v in here.items() if k not in base or base[k] != v}
            own = code(b, i, "row")
            side[b] = None if own == 0 else here
            if own in (3, 4):
                added.setdefault(new, {})[b] = (base["lang"], base["source"], "!?"[own - 3])
        n = {"clean": 0, "edit_edit": 0, "edit_delete": 0, "insert_insert": 0}
        if None in side.values():
            other = side["R"] if side["L"] is None else side["L"]
            n["edit_delete" if other else "clean"] = 1
            state = side["L"] if other and side["L"] is not None else None
        else:
            state = {}
            for k in {*side["L"], *side["R"]}:
                a, b = side["L"].get(k, "same"), side["R"].get(k, "same")
                state[k] = side["L"][k] if k in side["L"] else side["R"][k]
                if "same" in (a, b) or a == b:
                    n["clean"] += 1
                elif k[0] == "gap":
                    n["insert_insert"] += 1
                else:
                    n["edit_delete" if None in (a, b) else "edit_edit"] += 1
        if state is None:
            out[i] = (None, None, None, *n.values())
        else:
            whole = base | state
            lines = [x for k in range(last) for x in (whole["line", k], whole.get(("gap", k))) if x is not None]
            out[i] = (whole["lang"], whole["source"], hashlib.sha256("\n".join(lines).encode()).hexdigest(), *n.values())
    for k, sides in added.items():
        lang, source, text = sides.get("L") or sides["R"]
        clash = len(set(sides.values())) > 1
        out[k] = (lang, source, hashlib.sha256(text.encode()).hexdigest(), int(not clash), 0, 0, int(clash))
    return out


def merged(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").withColumns(more).repartition(3)
    shapes = branch_merge.row_shapes(docs)
    table = branch_merge.merged_table(docs, branch_merge.coded_branch(shapes, "L", -1), branch_merge.coded_branch(shapes, "R", -5)).withColumn("text", F.sha2("text", 256))
    return {r[0]: tuple(r[1:]) for r in table.collect()}, table


def test_branches_as_thing_by_thing(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["en", "", None]), rng.choice(["web", None]), rng.choice([None, "", "\n", "\n".join(rng.choice(["a", "", "b!"]) for _ in range(rng.randint(1, 30)))])) for i in range(1_500)]
    rows.append((9_999, "en", "web", "\n".join(str(i) for i in range(40_000))))
    wanted = slow_merge(rows)
    got, table = merged(spark, rows, n_clean=F.lit("x"), _id=F.lit(0))
    assert got == wanted and table.count() == len(wanted)
    assert sum(v[-1] and k < 0 for k, v in wanted.items()) and sum(v[-1] and k >= 0 for k, v in wanted.items()) and all(sum(v[n] for v in wanted.values()) for n in (3, 4, 5, 6))


def test_branches_of_awkward_tables(spark):
    rows = [(i, "en", "web", "one\ntwo") for i in range(40)]
    assert merged(spark, rows * 3 + [(None, "en", "web", "x")])[0] == slow_merge(rows)
    assert merged(spark, [(3, "z", "web", "other"), (3, None, None, None)])[0] == slow_merge([(3, None, None, None)])
    assert merged(spark, [])[0] == {}


def test_merge_of_scripts():
    change, base = branch_merge.Change, (("en",), "a\nb\nc")
    merge = branch_merge.merge_row
    assert merge(base, change(), change()) == (base, 0, 0, 0, 0)
    assert merge(base, change(lines={1: (0, "x")}, gaps={-1: ("top",)}), change(lines={1: (None, ""), 2: None, 9: None})) == ((("en",), "top\na\nx"), 3, 0, 0, 0)
    assert merge(base, change(lines={1: (0, "x")}), change(lines={1: None}, columns={0: (1, "n")})) == ((("en",), "a\nx\nc"), 0, 0, 1, 0)
    assert merge(base, change(lines={1: None}), change(lines={1: (0, "x")})) == ((("en",), "a\nc"), 0, 0, 1, 0)
    assert merge(base, change(dropped=True), change(columns={0: (0, "en")})) == (None, 1, 0, 0, 0)
    assert merge(base, change(dropped=True), change(columns={0: (0, "de")})) == (None, 0, 0, 1, 0)
    assert merge(base, change(columns={0: (0, "de")}), change(dropped=True)) == ((("de",), "a\nb\nc"), 0, 0, 1, 0)
    assert merge(base, change(dropped=True), change(dropped=True, lines={0: None})) == (None, 1, 0, 0, 0)
    assert merge(base, change(gaps={0: ("p", "q")}), change(gaps={0: ("q",)})) == ((("en",), "a\np\nq\nb\nc"), 0, 0, 0, 1)
    assert merge(base, change(added=(("x",), "y")), change()) == (base, 0, 0, 0, 1)
    assert merge(None, change(lines={0: None}), change()) is None
    assert merge(None, change(added=(("x",), "y")), change(added=(("x",), "z"))) == ((("x",), "y"), 0, 0, 0, 1)
