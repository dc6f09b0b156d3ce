"""Line dedup, suffix dedup, near copies, decontamination and personal data against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import decontaminate, minhash, pii, suffix_dedup
from lumenfold.llm.line_dedup import dedup_lines, line_dedup_report

DOCS = "doc_id long, text string"


def rows_of(df, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in df.collect())


# line dedup


def test_line_dedup_cases(spark):
    docs = [(1, "a shared line here\nshort\n\n"), (2, " A SHARED line here\t\nshort\nown text of two"), (3, None), (4, ""), (5, "a shared line here\na shared line here"), (5, "a shared line here\na shared line here"), (None, "a shared line here")]
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup_report(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {(1, 4, 0, "a shared line here\nshort\n\n"), (2, 3, 1, "short\nown text of two"), (3, 1, 0, ""), (4, 1, 0, ""), (5, 2, 2, ""), (None, 1, 0, "a shared line here")}


def test_line_dedup_keeps_columns_and_nulls(spark):
    docs = spark.createDataFrame([(1, None, 7, "x"), (2, "t", 8, None)], "doc_id long, text string, n_lines int, _ld_pos string")
    out = dedup_lines(docs)
    assert out.columns == docs.columns and rows_of(out, *docs.columns) == rows_of(docs, *docs.columns)
    assert dedup_lines(docs.limit(0)).count() == 0


# suffix dedup


def brute_suffix(docs, width=50):
    first = {}
    for i, t in docs:
        raw = (t or "").encode()
        for k in range(len(raw) - width + 1):
            w = raw[k : k + width]
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - width + 1):
            if i is not None and first[raw[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1])), kept))
    return collections.Counter(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_as_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_TEXT", 2000)
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [word(rng.randint(40, 150)) for _ in range(5)] + ["ab" * 60, "z" * 200]
    docs = [(rng.randint(0, 60), word(rng.randint(0, 60)) + "".join(rng.choice(passages) + word(rng.randint(0, 9)) for _ in range(rng.randint(0, 4)))) for _ in range(60)]
    ids = {}
    docs = [(ids.setdefault(t, i), t) for i, t in enumerate(x[1] for x in docs)]
    docs += [(900 + i, t) for i, (_, t) in enumerate(docs[:8])] + [(1000, None), (1001, ""), (None, docs[0][1]), (902, docs[2][1]), (903, "x" * 49)]
    got = rows_of(suffix_dedup.dedup_substrings(spark.createDataFrame(docs, DOCS).repartition(3)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert collections.Counter({(a, b, c, d, bytes(e)): n for (a, b, c, d, e), n in got.items()}) == brute_suffix(docs)


def test_suffix_shards_merge_by_binary_search(monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "SHARD", 300)
    rng = random.Random(3)
    base = bytes(rng.choice(b"ab") for _ in range(90))
    segs = [base[k : k + rng.randint(50, 66)] for k in (rng.randint(0, 24) for _ in range(60))]
    ids = [rng.randint(0, 20) for _ in segs]
    first = {}
    for s, d in zip(segs, ids):
        for k in range(len(s) - 49):
            first[s[k : k + 50]] = min(first.get(s[k : k + 50], d), d)
    wanted = {(i, k) for i, (s, d) in enumerate(zip(segs, ids)) for k in range(len(s) - 49) if first[s[k : k + 50]] < d}
    assert set(suffix_dedup.covered(segs, np.array(ids))) == wanted


def test_suffix_ranges_come_back_once_a_document(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_TEXT", 2000)
    monkeypatch.setattr(suffix_dedup, "COVERS", 40)
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    docs = [(i, 7, base[100 * i : 100 * i + 1500] + str(i), False) for i in range(15)]
    got = suffix_dedup.covered_windows(spark.createDataFrame(docs, "doc_id long, mark long, text string, skip boolean").repartition(3), 22_000).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1, 15))  # a row a document, from however many anchors
    assert all(np.frombuffer(r["ranges"], np.int64).tolist() == [0, 1350] for r in got)


def test_suffix_joined_ranges_as_brute_force():
    rng = np.random.default_rng(3)
    rows = np.column_stack([rng.integers(-2, 3, 300), rng.integers(0, 2, 300), rng.integers(0, 400, 300), np.zeros(300, np.int64)]).astype(np.int64)
    rows[:, 3] = rows[:, 2] + rng.integers(0, 6, 300)
    ids, marks, sizes, ranges = suffix_dedup.joined_ranges(rows)
    got = {(i, m): r.tolist() for i, m, r in zip(ids.tolist(), marks.tolist(), np.split(ranges, np.cumsum(sizes)[:-1]), strict=True)}
    assert set(got) == {(a, b) for a, b, _, _ in rows.tolist()}
    for (i, m), r in got.items():
        places = {x for a, b, f, t in rows.tolist() if (a, b) == (i, m) for x in range(f, t + 1)}
        assert {x for f, t in r for x in range(f, t + 1)} == places and all(x[1] + 1 < y[0] for x, y in zip(r, r[1:]))
    assert [len(x) for x in suffix_dedup.joined_ranges(np.empty((0, 4), np.int64))] == [0, 0, 0, 0]


def test_suffix_empty_table(spark):
    assert suffix_dedup.dedup_substrings(spark.createDataFrame([], DOCS)).count() == 0


# near copies


def brute_near(docs, percent=85):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("chunk", [200_000, 400])
def test_near_duplicates_as_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rng = random.Random(chunk)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(30, 120))] for _ in range(4)]
    docs = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        docs.append((i, " ".join(words)))
    docs += [(500, "A b c"), (501, "a B\tc"), (502, ""), (503, None), (504, " \n"), (505, docs[3][1].upper())]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == brute_near(docs)


def test_near_duplicates_edges(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", 1), (1, "one two three four five six", 2), (2, "one two three four five six", 3), (None, "one two three four five six", 4)], "doc_id long, text string, kept int")
    out = minhash.keep_first(docs)
    assert out.columns == docs.columns and sorted(r["kept"] for r in out.collect()) == [1, 2, 4]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


# decontamination

ITEM = "A train leaves the old station at 9 and travels 120 km before Alice reaches the quiet village near the lake"


def test_decontamination_cases(spark):
    docs = [
        (1, f"some other words here {ITEM} and then more words follow"),
        (2, "so A train leaves the old station at 7 and travels 350 km before Robert reaches the quiet village near the lake again"),
        (3, "nothing of the kind is written in this one at all"),
        (4, "A train leaves the old station"), (5, None), (6, ""), (None, ITEM), (7, ITEM.upper()), (8, (ITEM + " ") * 3),
    ]
    bench = [(1, ITEM), (2, None), (3, ""), (4, "tiny item")]
    pairs = decontaminate.contaminated_pairs(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in pairs.collect()}
    assert {(1, 1), (2, 1), (8, 1)} <= got and {d for d, _ in got} <= {1, 2, 7, 8}


def test_leaks_in_other_case_numbers_and_lengths(spark):
    sold = "Natalia sold clips to 48 of her friends in April. Natalia then sold half as many clips in May. How many clips did Natalia sell altogether in April and May?"
    ride = "A rider covers 60 km in the first hour, then another 1,250 m at 1.5 times the speed before the rest stop"
    bench = spark.createDataFrame([(1, sold), (2, ride), (3, "purple lantern gossip")], "item_id long, text string")
    docs = [
        (1, "so we read " + sold.lower() + " and went on"), (2, "Today: " + sold.replace("Natalia", "Weng").replace("48", "52")), (3, sold.title()),
        (4, "x " + ride.replace("60 km", "60km")), (5, ride.replace("60", "75").replace("1,250", "900").replace("1.5", "2")), (6, ride.lower().replace("60", "75")),
        (7, "we all heard the purple lantern gossip last night again"), (8, "Purple curtains and a lantern, with gossip"), (9, "Maria went to town in May. Peter then stayed at home with 3 friends and 20 clips"),
    ]
    pairs = decontaminate.contaminated_pairs(spark.createDataFrame(docs, DOCS), bench)
    assert {(r["doc_id"], r["item_id"]) for r in pairs.collect()} == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2), (7, 3)}


def test_inconsistent_slots_are_no_leak(spark):
    item = "The number 5 plus the number 5 plus the number 5 plus the number 5 gives the number 20 in all cases"
    same = item.replace("5", "7").replace("20", "28")
    other = "The number 1 plus the number 2 plus the number 3 plus the number 4 gives the number 9 in all cases"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.contaminated_documents(spark.createDataFrame([(1, same), (2, other)], DOCS), bench)
    assert [r["doc_id"] for r in got.collect()] == [1]
    docs = spark.createDataFrame([(1, same, 1), (2, other, 2)], DOCS + ", item int")
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and [r["doc_id"] for r in left.collect()] == [2]
    assert decontaminate.contaminated_documents(docs.limit(0), bench).count() == 0


# personal data

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data_as_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.4", "é😀 a@b.co é 4111111111111111", "x" * 20000, "1" * 20000, "a." * 9000 + "@b", "a@" + "b." * 5000 + "c", "+1" + "(" * 3000]
    texts += ["".join(rng.choice("ab1.@+- ()45_%") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    docs = list(enumerate(texts)) + [(1, texts[3]), (None, texts[3])]
    got = rows_of(pii.find_personal_data(spark.createDataFrame(docs, DOCS)), "doc_id", "base_spans")
    assert got == collections.Counter((i, base_spans(t)) for i, t in docs)
    assert pii.find_personal_data(spark.createDataFrame([], DOCS)).count() == 0


def test_loose_spans_are_added(spark):
    docs = spark.createDataFrame([(i, f"call me at +1 (212) 555-01{i:02d} today, phone (743) 555-38{i:02d} is open") for i in range(20)] + [(50, "clean words only")], DOCS)
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    assert got[50] == "" and all(got[i].count("phone:") == 2 for i in range(20))


def _planted(rng, n):
    """Texts with spans that are personal data (True) and spans that only look so (False)."""
    low = ["river", "stone", "lamp", "walks", "over", "old", "sees", "green", "of", "small", "bread"]
    said = lambda: " ".join(rng.choice(low) for _ in range(rng.randint(4, 9)))
    one = lambda names: rng.choice(names.split())
    odd = lambda: "".join(rng.choice(["ka", "ro", "min", "tel", "va", "shu"]) for _ in range(3)).capitalize()
    makes = [
        (True, "name", lambda: ("it was signed by ", f"{odd()} {odd()}", " in full")),
        (True, "name", lambda: ("then ", f"{one(pii.FIRST_NAMES)} {one(pii.FAMILY_NAMES)}", " said so")),
        (True, "name", lambda: ("we asked, and ", f"{one(pii.FIRST_NAMES)} {odd()}", " wrote back")),
        (True, "name", lambda: ("Dear ", f"{one(pii.FIRST_NAMES)} {odd()}", ", hello")),
        (False, "name", lambda: ("it is under the ", rng.choice(["Apache License", "General Public License", "James River", "Hudson Bay"]), " now")),
        (False, "name", lambda: (f"{said()}. ", f"{odd()} {odd()}", f" {said()}")),
        (False, "name", lambda: ("noise ", rng.choice(["Orre Orre", "Sich Sich Sich", "Of Of"]), " noise")),
        (True, "phone", lambda: ("phone ", f"({rng.randint(2, 9)}43) {rng.randint(2, 9)}55-{rng.randint(1000, 9999)}", " is open")),
        (True, "phone", lambda: ("call me, ", f"{rng.randint(2, 9)}12-{rng.randint(2, 9)}31-{rng.randint(1000, 9999)}", " at noon")),
        (False, "phone", lambda: ("serial ", f"0{rng.randint(10, 99)}-0{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", " units")),
        (True, "email", lambda: ("mail ", f"{odd().lower()} [at] {odd().lower()} [dot] com", " today")),
        (True, "card", lambda: ("card ", "4111.1111.1111.1111", ", expires soon")),
        (False, "card", lambda: ("version ", f"{rng.randint(1000, 1999)}.{rng.randint(1000, 9999)}.1234.5671", " came")),
    ]
    for i in range(n):
        true, kind, make = makes[i % len(makes)]
        before, span, after = make()
        lead = f"{said()} "
        begin = len(lead) + len(before)
        yield i, f"{lead}{before}{span}{after} {said()}.", true, f"{kind}:{begin}:{begin + len(span)}"


def test_planted_spans_are_told_apart(spark):
    """Precision and recall over planted data; the same texts among many clean ones give the same."""
    planted = list(_planted(random.Random(11), 650))
    got = {r["doc_id"]: set(filter(None, r["spans"].split(","))) for r in pii.find_personal_data(spark.createDataFrame([(i, t) for i, t, _, _ in planted], DOCS)).collect()}
    luhn_free = [(i, t, true, span) for i, t, true, span in planted if true or not span.startswith("card")]
    right = sum(true and span in got[i] for i, _, true, span in luhn_free)
    wrong = [t for i, t, true, span in luhn_free if not true and got[i]]
    wanted = sum(true for _, _, true, _ in planted)
    assert right >= 0.95 * wanted, [t for i, t, true, span in planted if true and span not in got[i]][:10]
    assert len(wrong) <= 0.02 * len(planted), wrong[:10]
    clean = [(1000 + i, "the old lamp. Green stone walks. And over the river") for i in range(3000)]
    more = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame([(i, t) for i, t, _, _ in planted] + clean, DOCS)).collect()}
    assert not any(more[i] for i, _ in clean)
    assert sum(true and span in more[i].split(",") for i, _, true, span in planted) >= 0.95 * wanted


def test_no_names_where_nobody_is_named(spark):
    texts = ["Orre Orre Orre Orre", "Licensed under the Apache License, Version 2.", "a line. Steen Erachtz. Green Stone", "under the GNU General Public License, version 3."] * 50
    got = {r["spans"] for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == {""}
