"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans: the strict base forms of e-mail addresses, IP addresses, card and
phone numbers, and looser forms (obfuscated addresses, card numbers with dots, national phone
numbers, and runs of two or three capitalised words for names).
Three labelers vote for, against or not at all on each: the form and its checks (a loose number's
digits, where in a sentence a name stands), gazetteers (domain endings, number ranges, first and
family names, words of places and organisations), and the words before and after it. Votes are counted by pattern (a table of a few hundred rows at most,
as votes, kinds and length classes are few); expectation-maximisation over these counts
estimates how reliable each labeler is (its estimates lean by `TETHER` on votes taken at face value,
so that a kind whose candidates are nearly all of one class keeps its meaning), and its soft labels train a naive Bayes span
classifier over votes and length. Loose spans that it holds for personal data with at least
`threshold` are added; base spans that pass their checks always stay.

A span's offsets come from running sums of the lengths of gaps and matches in its text, by
a window over that one text's matches. Patterns are possessive and begin where a run
begins (or where the last match ended), so a long run of letters or digits costs one pass.

Defined results: a loose span that overlaps a base span of its kind gives way to it; one with as many votes
against it as for it (a tie), or more, is never added. Null texts are empty and hold nothing. Null ids are kept apart from others and
get rows too. Repeated rows get the same result each. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import materialize

KINDS = ["email", "ip", "card", "phone", "name"]
#: The base forms (of a contract), made possessive, which finds the same matches in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Names, domain endings, and words that speak for or against a kind.
FIRST_NAMES = "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Peter Paul Maria Pierre Marie Jean Hans Klaus Juan Carlos Luis Ana Sofia Emma Olivia Noah Liam Daniel Laura Martin Julia Andrea Marco Elena Ivan Olga Ahmed Fatima Mohammed Ali Wei Priya Raj Yuki Kenji Chloe Lucas Camille Louis Jürgen Ursula Miguel Carmen"
FAMILY_NAMES = "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Taylor Moore Jackson Thompson White Harris Clark Lewis Robinson Walker Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Hoffmann Dubois Moreau Laurent Lefebvre Bernard Durand Petit Rossi Russo Ferrari Fernández Sánchez Pérez Gómez Ivanov Petrov Kumar Singh Patel Sharma Chen Wang Zhang Nguyen Tanaka Suzuki Kim Khan Hussain"
NO_NAMES = "River Lake Street Road Avenue Park Island Bay Mountain Valley Bridge Square Station Airport County City North South East West University College School Institute Hospital Museum Church Bank Inc Ltd Corp Company Foundation Committee Association Department Ministry Council License Public General Software Apache Version Terms Service Privacy Policy Copyright Rights January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday New The This That And For With Und Der Die Das Les Des Los Las"
ENDINGS = "com org net edu gov io de fr es it uk eu us info biz co example"
FOR = {"email": "e-?mail|mail|contact|write|courriel|correo", "ip": "ip|address|host|server|login", "card": "card|visa|mastercard|amex|credit|carte|karte|tarjeta", "phone": "phone|tel|call|mobile|fax|telefon|t[eé]l[eé]fono", "name": "mr|mrs|ms|dr|prof|name|named|signed|signed by|sincerely|regards|author|written by|dear|herr|frau|monsieur|madame|señor|señora"}
#: A name's words must stand right at it.
CLOSE = {"name": r"(?:\x20is|\x20by)?[.,:]?\s{1,3}$"}
AFTER = {"email": "to reach|or call", "ip": "port|logged in|connected", "card": "exp|expires|expiry|cvv|cvc", "phone": "ext|extension|or e-?mail", "name": "said|says|wrote|writes|born|signed|lives|aged|dit|sagte|dijo"}
AGAINST = {"name": "lake|river|near|north of|south of|the|at|under"} | dict.fromkeys(["email", "ip", "card", "phone"], "isbn|issn|version|sku|order|invoice|serial|doi|page|chapter")
AGAINST_AFTER = {"name": "inc|ltd|gmbh|corp|river|street|university|license"} | dict.fromkeys(["email", "ip", "card", "phone"], "pieces|pages|items|units|eur|usd")
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{2,63}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,10}){1,4}",
    "card": r"(?<![0-9.])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9.])",
    "phone": r"(?<![0-9+().-])(?<!\+[0-9]{1,3}\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "name": r"(?<![\p{L}0-9])(?!(?:Mr|Mrs|Ms|Dr|Prof|Dear|Signed|Name|Author|Sincerely|Regards|Herr|Frau|Monsieur|Madame|Señor|Señora)\x20)\p{Lu}\p{Ll}{1,30}+(?:\x20\p{Lu}\p{Ll}{1,30}+){1,2}+(?![\p{L}0-9])",
}
#: Of a class's weight so much is added, at face value, when a labeler's reliability is estimated: shares of votes 1, 0 and -1.
TETHER, FACE = 0.2, {1: (0.6, 0.35, 0.05), 0: (0.05, 0.5, 0.45)}
#: What a text must contain for a pattern to be tried at all.
NEEDS = {("email", True): "@", ("phone", True): "+", ("ip", True): ".", ("email", False): "at"}
HELD = {"name": r"\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}"}
VOTES = ["pattern", "gazetteer", "context"]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the Luhn check."""
    total = F.lit(0)
    padded = F.lpad(digits, 19, "0")
    for i in range(19):
        d = F.substring(padded, 19 - i, 1).cast("int")
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if i % 2 else d)
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = [F.ltrim(F.split_part(match, F.lit("."), F.lit(i)), F.lit("0")) for i in range(1, 5)]
        fine = [(F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")) for p in parts]
        return fine[0] & fine[1] & fine[2] & fine[3]
    if kind == "card":
        n = F.length(_digits(match))
        return F.when(n.between(13, 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _checked(kind: str, base: Column, valid: Column, match: Column, before: Column) -> Column:
    """The form's vote."""
    digits = _digits(match)
    if kind == "card":
        loose = F.when(luhn(digits), 1).otherwise(-1)
    elif kind == "phone":
        # area codes and exchanges begin with 2 to 9; numbers of one digit are no numbers
        loose = F.when(digits.rlike("^([0-9])\\1+$"), -1).when(digits.rlike("^[2-9][0-9]{2}[2-9]"), 1).otherwise(0)
    elif kind == "email":
        loose = F.when(match.rlike(r"(?i)\[at\].*\[dot\]|\(at\).*\(dot\)"), 1).otherwise(0)
    elif kind == "name":
        words = F.split(match, " ")
        repeated = F.size(F.array_distinct(words)) < F.size(words)
        # a run that begins a sentence may owe its first capital to that
        loose = F.when(repeated, -1).when(before.rlike(r"[\p{Ll},;:]\x20$"), 1).otherwise(0)
    else:
        loose = F.lit(0)
    return F.when(base & valid, 1).when(base, -1).otherwise(loose)


def _gazetteer(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lower(match).rlike(rf"(?:{'|'.join(ENDINGS.split())})[\])]?$").cast("int")
    if kind == "card":
        return F.when(_digits(match).rlike("^[3-6]"), 1).otherwise(-1)
    if kind == "phone":
        return F.when(_digits(match).rlike("^(?:1|[2-9][0-9])"), 1).otherwise(0)
    if kind == "ip":
        return F.when(match.rlike(r"^0*(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\."), 1).otherwise(-1)
    words = F.split(match, " ")
    known = F.get(words, F.lit(0)).isin(FIRST_NAMES.split()) | F.element_at(words, -1).isin(FAMILY_NAMES.split())
    return F.when(F.exists(words, lambda w: w.isin(NO_NAMES.split())), -1).when(known, 1).otherwise(0)


def _context(kind: str, before: Column, after: Column) -> Column:
    """The vote of the words on both sides; none where they disagree."""
    close, edge = CLOSE.get(kind, r"(?!\p{L})"), r"(?<!\p{L})"
    against = before.rlike(rf"{edge}(?:{AGAINST[kind]}){close}") | after.rlike(rf"^\W{{0,3}}(?:{AGAINST_AFTER[kind]})(?!\p{{L}})")
    speaks = before.rlike(rf"{edge}(?:{FOR[kind]}){close}") | after.rlike(rf"^\W{{0,3}}(?:{AFTER[kind]})(?!\p{{L}})")
    return F.when(against & ~speaks, -1).when(speaks & ~against, 1).otherwise(0)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Proposed spans with their votes: id, mark, kind (number), base, valid, begin, end, three votes and a length class."""
    text = docs[text_col]
    forms = [(kind, True, pattern) for kind, pattern in BASE.items()] + [(kind, False, pattern) for kind, pattern in LOOSE.items()]
    arrays = []
    for kind, base, pattern in forms:
        zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("match"))
        held = text.contains(NEEDS[kind, base]) if (kind, base) in NEEDS else text.rlike(HELD.get(kind, "[0-9]"))
        arrays.append(F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), F.when(held, zipped).alias("found")))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("mark"), F.array(*arrays).alias("forms"))
    # outer generators: from inner ones Catalyst infers filters that would run every pattern once more
    rows = rows.select("id", "mark", F.explode_outer("forms").alias("f")).where("f.found IS NOT NULL AND size(f.found) > 1")
    rows = rows.select("id", "mark", F.col("f.kind").alias("kind"), F.col("f.base").alias("base"), F.posexplode_outer("f.found").alias("at", "x"))
    side = lambda cut: F.lower(cut(F.col("x.gap"), F.lit(40)))
    # before is needed in its own case by the form's check, so it is lowered only for the context
    rows = rows.select("id", "mark", "kind", "base", "at", F.char_length("x.gap").alias("gap"), F.col("x.match").alias("match"), F.right(F.col("x.gap"), F.lit(40)).alias("before"), side(F.left).alias("head"))
    rows = rows.dropDuplicates(["id", "mark", "kind", "base", "at"])
    order = Window.partitionBy("id", "mark", "kind", "base").orderBy("at")
    end = F.sum(F.col("gap") + F.char_length("match")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("end", end).withColumn("after", F.lead("head").over(order)).where("match IS NOT NULL")
    rows = rows.withColumn("begin", F.col("end") - F.char_length("match"))
    by_kind = lambda make: F.coalesce(*[F.when(F.col("kind") == i, make(kind)) for i, kind in enumerate(KINDS)])
    rows = rows.withColumn("valid", by_kind(lambda kind: _valid(kind, F.col("match"))))
    context = by_kind(lambda kind: _context(kind, F.lower("before"), F.coalesce("after", F.lit(""))))
    pattern = by_kind(lambda kind: _checked(kind, F.col("base"), F.col("valid"), F.col("match"), F.col("before")))
    return rows.select("id", "mark", "kind", "base", "valid", "begin", "end", pattern.alias("pattern"), by_kind(lambda kind: _gazetteer(kind, F.col("match"))).alias("gazetteer"), context.alias("context"), F.least(F.floor(F.char_length("match") / 6), F.lit(7)).cast("int").alias("size"))


def span_classifier(counts: list[tuple[int, int, int, int, int, int]], rounds: int = 25) -> dict[tuple[int, int, int, int, int], float]:
    """The probability of personal data for each (kind, three votes, length class), from counts of these.

    Expectation-maximisation with, for each kind, a prior and for each labeler the chances of its votes
    given either class; then naive Bayes with the length class as one more feature, from the soft labels.
    """
    out = {}
    for kind in sorted({c[0] for c in counts}):
        rows = [c for c in counts if c[0] == kind]
        # at first a vote is taken at face value
        soft = [1 / (1 + math.exp(-2.0 * (r[1] + r[2] + r[3]) + 0.5)) for r in rows]
        for n in range(rounds + 1):
            features = (1, 2, 3) if n < rounds else (1, 2, 3, 4)
            weight = [sum(r[5] * (s if y else 1 - s) for r, s in zip(rows, soft, strict=True)) for y in (0, 1)]
            odds = {}
            for f in features:
                values = 3 if f < 4 else 8
                for y in (0, 1):
                    for r, s in zip(rows, soft, strict=True):
                        key = (f, r[f], y)
                        odds[key] = odds.get(key, 0.0) + r[5] * (s if y else 1 - s)
                for y in (0, 1):
                    for value in {r[f] for r in rows}:
                        # at face value for the labelers; classes of length have no meaning of their own
                        lean = TETHER * weight[y] * FACE[y][1 - value] if f < 4 else 0.0
                        odds[f, value, y] = (odds.get((f, value, y), 0.0) + lean + 1) / (weight[y] * (1 + TETHER * (f < 4)) + values)
            prior = math.log((weight[1] + 1) / (weight[0] + 1))
            soft = [1 / (1 + math.exp(-max(-30.0, min(30.0, prior + sum(math.log(odds[f, r[f], 1] / odds[f, r[f], 0]) for f in features))))) for r in rows]
        out |= {r[:5]: s for r, s in zip(rows, soft, strict=True)}
    return out


def _joined(spans: Column) -> Column:
    """kind:start:end of sorted (kind, begin, end) structs, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """For each row its id, counts of base spans (n_email, n_ip, n_card, n_phone), base_spans and spans as text."""
    found = materialize(candidates(docs, id_col, text_col), "spans")
    counts = found.groupBy("kind", *VOTES, "size").agg(F.count("*").alias("n")).collect()
    odds = span_classifier([tuple(r) for r in counts])
    good = [k for k, p in odds.items() if p >= threshold and sum(k[1:4]) > 0]
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in ("kind", *VOTES, "size")])
    chosen = key.isin([":".join(map(str, k)) for k in good]) if good else F.lit(False)
    kept = found.where((F.col("base") & F.col("valid")) | (~F.col("base") & chosen))
    span = F.struct(F.col("kind"), F.col("begin"), F.col("end"))
    count = [F.count_if(F.col("base") & (F.col("kind") == i)).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:4])]
    by_row = kept.groupBy("id", "mark").agg(*count, F.collect_list(F.when(F.col("base"), span)).alias("fixed"), F.collect_list(F.when(~F.col("base"), span)).alias("more"))
    # a loose span stays out where a base span of its kind overlaps it
    apart = F.filter("more", lambda m: ~F.exists("fixed", lambda b: (b["kind"] == m["kind"]) & (b["begin"] < m["end"]) & (m["begin"] < b["end"])))
    by_row = by_row.select("id", "mark", *[f"n_{kind}" for kind in KINDS[:4]], _joined(F.col("fixed")).alias("base_spans"), _joined(F.concat("fixed", apart)).alias("spans"))
    rows = docs.select(docs[id_col], F.xxhash64(docs[text_col]).alias("_pii_mark"))
    out = rows.join(by_row.hint("shuffle_hash"), rows[id_col].eqNullSafe(by_row["id"]) & (rows["_pii_mark"] == by_row["mark"]), "left")
    return out.select(rows[id_col], *[F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS[:4]], F.coalesce("base_spans", F.lit("")).alias("base_spans"), F.coalesce("spans", F.lit("")).alias("spans"))
