"""Benchmark decontamination by template windows, with DataFrame functions only.

Texts become templates: numbers (1,250 and 1.5 are one), units after them or glued to them
and names (capitalised words; at the start of a sentence they are read both ways) turn into typed placeholders; the other words are lower-cased and
stripped of punctuation. Windows of WORDS template words are hashed and joined with the
benchmark's. A document holds an item if it has at least `min_cover` of the item's
distinct windows and, where windows have slots, the item's slot values map to the
document's consistently: for each value of the item the most frequent partner counts, and
these make up at least `min_consistency` of all slot matches. So a question with other
numbers or names is found, and a text that only shares a shape is not.

A window with placeholders is also compared by its lower-cased raw words, one of fewer than
LITERALS other words only so: its position counts as found by either. Items are read a second
time in lower case, as copies may be. An item of fewer than WORDS words makes one window, and
documents make windows of that length too where there is such an item. The benchmark's windows are written out first, so
Catalyst sees their size and broadcasts them only if they are small; beyond that the
join is by hash, which AQE splits where a window is frequent.

Words that are no placeholder match by their lower-cased form alone, so a document that holds an
item has some of its plain word sequences: one cheap pass over the plain windows of all texts finds
the documents with any, and only they are read as templates. Plain are only words without a digit that are no
unit either: the plain pass reads texts as they are, and there "3.11" and "60km" are other words than in a template.
For items without enough plain words all documents are read as templates; no document is left out.

Defined results: null, empty or wordless texts and items match nothing; null ids neither.
Rows that repeat a document id are one document, as are rows that repeat an item id.
A document that holds several items is told once for each (ties are all told).
Repeated windows count once. Other columns pass through `drop_contaminated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import materialize

WORDS, LITERALS, PART = 5, 2, 3
#: Private-use characters that stand for a name, a number, a unit, and the separator within a number.
NAME, NUMBER, UNIT, JOIN = "\ue001", "\ue002", "\ue003", "\ue004"
#: Units of measure and currency that may follow a number.
UNITS = "mm cm dm m km in ft yd mi mg g kg t lb lbs oz ml cl dl l gal s sec min h hr hrs ms d kb mb gb tb hz khz mhz ghz w kw mw v a ma c f k pct percent usd eur gbp dollars euros pounds cents hours minutes seconds days weeks months years meters metres kilometers kilometres miles feet inches grams kilograms liters litres degrees"
_BREAK = f"[^\\p{{L}}\\p{{N}}{NAME}{NUMBER}{UNIT}{JOIN}]+"
_ALONE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def normal(text: Column) -> Column:
    """The text without placeholders of its own, numbers with separators as one word, units apart from their numbers."""
    clean = F.translate(text, NAME + NUMBER + UNIT + JOIN, "    ")
    joined = F.regexp_replace(clean, r"(?<=[0-9])[.,](?=[0-9])", JOIN)
    apart = F.regexp_replace(joined, f"(?i){_ALONE}([0-9][0-9{JOIN}]*)({'|'.join(UNITS.split())}){_END}", "$1 $2")
    return F.when(clean.rlike("[0-9]"), apart).otherwise(clean)


def template(clean: Column, starts: bool = False) -> Column:
    """A normal text with placeholders for names (with `starts`, all capitalised words), numbers and units, one for each word."""
    amid, anywhere = rf" (?<=[\p{{Ll}}\p{{N}},;] )\p{{Lu}}\p{{Ll}}+{_END}", rf"\p{{Lu}}(?<![\p{{L}}\p{{N}}]\p{{Lu}})\p{{Ll}}+{_END}"
    named = F.regexp_replace(clean, anywhere, NAME) if starts else F.regexp_replace(clean, amid, " " + NAME)
    counted = F.regexp_replace(named, rf"{_ALONE}[0-9][0-9{JOIN}]*{_END}", NUMBER)
    united = F.regexp_replace(counted, f"(?i)(?<={NUMBER}[^\\p{{L}}\\p{{N}}]{{0,2}})(?:{'|'.join(UNITS.split())}){_END}", UNIT)
    return F.when(clean.rlike("[0-9]"), united).otherwise(named)


def words(text: Column) -> Column:
    """Lower-cased words without punctuation."""
    return F.array_remove(F.split(F.lower(text), _BREAK), "")


def windows(rows: DataFrame, key: str, text: str, shorter: tuple[int, ...] = ()) -> DataFrame:
    """_key, _at, _hash, _slots (for each word its raw form where it is a placeholder, null for a window without any and for raw words) and _size (words, WORDS at most).

    Windows have WORDS words, or all of a shorter text's; and besides each number of words in `shorter`.
    """
    shaped = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    shaped = shaped.select(F.col(key).alias("_key"), normal(F.col(text)).alias("_text"))
    shaped = shaped.select("_key", "_text", template(F.col("_text")).alias("_shape"), template(F.col("_text"), True).alias("_wide"))
    shaped = shaped.select("_key", words(F.col("_text")).alias("_raw"), words(F.col("_shape")).alias("_form"), words(F.col("_wide")).alias("_full"), F.col("_wide").rlike(f"[{NAME}{NUMBER}{UNIT}]").alias("_any"))
    held = lambda x: x.isin(NAME, NUMBER, UNIT)
    slotless = F.lit(None).cast("array<string>")

    def made_of(size: int) -> Column:
        short = F.size("_form") > 0 if size == WORDS else F.size("_form") >= size
        at = F.when(short, F.sequence(F.lit(0), F.greatest(F.size("_form") - size, F.lit(0))))
        # single elements are looked up: slice() copies the whole array each time when it is interpreted
        form, full, raw = (lambda i, c=c: [F.get(c, i + k) for k in range(size)] for c in ("_form", "_full", "_raw"))

        def reading(i: Column, shape: list[Column]) -> tuple[Column, Column, Column]:
            literals = sum((F.coalesce((~held(x)).cast("int"), F.lit(0)) for x in shape), F.lit(0))
            total = F.least(F.size("_form") - i, F.lit(size))
            slots = F.when(literals < total, F.array(*[F.when(held(x), r) for x, r in zip(shape, raw(i), strict=True)]))
            return F.when((literals >= LITERALS) | (literals == total), F.xxhash64(*shape)), slots, literals < total

        def mixed(i: Column) -> Column:
            mark, slots, held_any = reading(i, form(i))
            # a capitalised word that begins a sentence may be a name or not: both are looked up
            wide, wide_slots, _ = reading(i, full(i))
            other = F.xxhash64(*full(i)) != F.xxhash64(*form(i))
            plainly = F.when(held_any, F.xxhash64(*raw(i)))
            return F.struct(mark.alias("hash"), slots.alias("slots"), plainly.alias("raw"), F.when(other, wide).alias("wide"), F.when(other, wide_slots).alias("wide_slots"))

        def plain(i: Column) -> Column:
            none = F.lit(None).cast("long")
            return F.struct(F.xxhash64(*form(i)).alias("hash"), slotless.alias("slots"), none.alias("raw"), none.alias("wide"), slotless.alias("wide_slots"))

        return F.when(F.col("_any"), F.transform(at, mixed)).otherwise(F.transform(at, plain))

    # windows are made within the row: a generator beside the word arrays would copy them for every window
    size = F.least(F.size("_form"), F.lit(WORDS)).alias("_size")
    parts = [shaped.select("_key", size, made_of(n).alias("_made")) for n in (WORDS, *shorter)]
    cut = None
    for made in parts:
        # the outer form: from the inner one Catalyst infers a filter on the array, which it pushes below and so works out once more
        one = made.select("_key", "_size", F.posexplode_outer("_made").alias("_at", "_x")).where("_x IS NOT NULL")
        both = F.array(F.struct(F.col("_x.hash").alias("h"), F.col("_x.slots").alias("s")), F.struct(F.col("_x.raw").alias("h"), slotless.alias("s")), F.struct(F.col("_x.wide").alias("h"), F.col("_x.wide_slots").alias("s")))
        one = one.select("_key", "_size", "_at", F.explode_outer(both).alias("_y")).where("_y.h IS NOT NULL")
        cut = one if cut is None else cut.unionByName(one)
    return cut.select("_key", "_at", F.col("_y.h").alias("_hash"), F.col("_y.s").alias("_slots"), "_size")


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, at, hash, slots, n (the item's windows) and size (words of a window); of each item as it is and in lower case."""
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("_t"))
    plain = windows(items, "item", "_t")
    # behind another word a capitalised first word is a name: of that reading the first window is taken
    amid = windows(items.withColumn("_t", F.concat(F.lit("a "), "_t")), "item", "_t").where("_at = 1").withColumn("_at", F.lit(0))
    amid = amid.join(plain.where(F.col("_size") == WORDS).select("_key").distinct(), "_key", "left_semi")
    both = plain.unionByName(amid).unionByName(windows(items.withColumn("_t", F.lower("_t")), "item", "_t")).distinct()
    sizes = plain.groupBy("_key").agg(F.count_distinct("_at").alias("n"))
    return both.join(sizes, "_key").select(F.col("_key").alias("item"), F.col("_at").alias("at"), "_hash", F.col("_slots").alias("slots"), "n", F.col("_size").alias("size"))


def plain_windows(rows: DataFrame, key: str, text: str, shorter: tuple[int, ...] = ()) -> DataFrame:
    """_key and _hash of the windows of lower-cased words, without placeholders; sizes as in `windows`."""
    held = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    clean = F.when(F.col(text).rlike(f"[{NAME}{NUMBER}{UNIT}{JOIN}]"), F.translate(F.col(text), NAME + NUMBER + UNIT + JOIN, "    ")).otherwise(F.col(text))
    cut = held.select(F.col(key).alias("_key"), words(clean).alias("_raw"))

    def made_of(size: int) -> Column:
        short = F.size("_raw") > 0 if size == WORDS else F.size("_raw") >= size
        at = F.when(short, F.sequence(F.lit(0), F.greatest(F.size("_raw") - size, F.lit(0))))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(F.col("_raw"), i + k) for k in range(size)]))

    # arrays are put together within the row, so that texts are read once
    made = made_of(WORDS) if not shorter else F.flatten(F.array(*[F.coalesce(made_of(n), F.array().cast("array<bigint>")) for n in (WORDS, *shorter)]))
    return cut.select("_key", F.explode_outer(made).alias("_hash")).where("_hash IS NOT NULL")


def necessary_windows(benchmark: DataFrame, item_col: str, text_col: str, min_cover: float) -> DataFrame:
    """item, hash and size of plain word sequences one of which a document must hold if it holds the item.

    Words without a digit that are no unit and that no reading of the item turns into a placeholder are found by their lower-cased form
    only, so a window that is found has its plain sequences in the document. Whole windows are
    taken where those without any placeholder are so many that the rest can't make `min_cover`; else
    the first PART plain words of each window that has as many. Items that miss that as well
    (made of names and numbers nearly) have no rows.
    """
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("_t"))
    shaped = items.select("item", normal(F.col("_t")).alias("_text"))
    shaped = shaped.select("item", words(F.col("_text")).alias("_raw"), words(template(F.col("_text"), True)).alias("_full"))
    other = lambda full, raw: F.coalesce(full.isin(NAME, NUMBER, UNIT) | raw.rlike("[0-9]") | raw.isin(*UNITS.split()), F.lit(True))
    shaped = shaped.withColumn("_held", F.zip_with("_full", "_raw", other))
    size = F.least(F.size("_full"), F.lit(WORDS))
    at = F.when(F.size("_full") > 0, F.sequence(F.lit(0), F.size("_full") - size))
    held = lambda i: F.coalesce(F.get(F.col("_held"), i), F.lit(True))
    lower = lambda i, n: F.xxhash64(*[F.get(F.col("_raw"), i + k) for k in range(n)])
    plain = lambda i, n: ~sum((held(i + k).cast("int") for k in range(n)), F.lit(0)).cast("boolean")
    whole = lambda i: F.when(~F.exists(F.slice("_held", i + 1, WORDS), lambda w: w), lower(i, WORDS))
    part = lambda i: F.coalesce(*[F.when((k + PART <= F.col("size")) & plain(i + k, PART), lower(i + k, PART)) for k in range(WORDS - PART + 1)])
    made = shaped.withColumn("size", size).select("item", "size", F.explode_outer(F.transform(at, lambda i: F.struct(i.alias("at"), whole(i).alias("whole"), part(i).alias("part")))).alias("x"))
    made = materialize(made.select("item", "size", "x.*").where("at IS NOT NULL"), "places")
    # rows that repeat an id are one item: a place counts if all of them have it
    places = made.groupBy("item", "at").agg(F.min(F.col("whole").isNotNull()).alias("whole"), F.min(F.col("part").isNotNull()).alias("part"))
    able = places.groupBy("item").agg(*[(F.sum((~F.col(c)).cast("int")) < min_cover * F.count("*")).alias(f"by_{c}") for c in ("whole", "part")])
    met = made.join(places.select("item", "at", F.col("whole").alias("all_whole"), F.col("part").alias("all_part")), ["item", "at"]).join(able, "item")
    one = met.where("by_whole AND all_whole").select("item", F.col("whole").alias("hash"), "size")
    return one.unionByName(met.where("NOT by_whole AND by_part AND all_part").select("item", F.col("part").alias("hash"), F.lit(PART).alias("size"))).distinct()


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_cover: float = 0.8, min_consistency: float = 0.8) -> DataFrame:
    """doc_id, item_id, cover and consistency (1 without slots) of every document that holds an item."""
    wanted = materialize(benchmark_windows(benchmark, item_col, item_text_col), "items")
    must = materialize(necessary_windows(benchmark, item_col, item_text_col, min_cover), "must")
    slim = docs.select(docs[id_col].alias("_dc_id"), docs[text_col].alias("_dc_text"))
    some = wanted.join(must.select("item").distinct(), "item", "left_semi")
    rest = wanted.join(must.select("item").distinct(), "item", "left_anti")
    near = plain_windows(slim, "_dc_id", "_dc_text", sizes(must)).join(must.select(F.col("hash").alias("_hash")).distinct(), "_hash", "left_semi")
    near = materialize(near.select(F.col("_key").alias("_dc_id")).distinct(), "candidates")
    found = window_hits(slim.join(near, "_dc_id", "left_semi"), some)
    if not rest.isEmpty():  # of these items every document's windows are looked up
        found = found.unionByName(window_hits(slim, rest))
    hits = materialize(found, "hits")
    cover = hits.groupBy("_key", "item", "n").agg(F.count_distinct("at").alias("found")).where(F.col("found") >= min_cover * F.col("n"))
    pairs = hits.where("slots IS NOT NULL AND _slots IS NOT NULL").select("_key", "item", "times", F.explode(F.arrays_zip("slots", "_slots")).alias("x")).where("x.slots IS NOT NULL AND x._slots IS NOT NULL")
    pairs = pairs.groupBy("_key", "item", F.col("x.slots").alias("value"), F.col("x._slots").alias("partner")).agg(F.sum("times").alias("times"))
    best = pairs.groupBy("_key", "item", "value").agg(F.max("times").alias("best"), F.sum("times").alias("times"))
    held = best.groupBy("_key", "item").agg((F.sum("best") / F.sum("times")).alias("consistency"))
    out = cover.join(held, ["_key", "item"], "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0))).where(F.col("consistency") >= min_consistency)
    return out.select(F.col("_key").alias("doc_id"), F.col("item").alias("item_id"), (F.col("found") / F.col("n")).alias("cover"), "consistency")


def sizes(rows: DataFrame) -> tuple[int, ...]:
    """The window sizes under WORDS: 4 numbers at most."""
    return tuple(sorted(r["size"] for r in rows.where(F.col("size") < WORDS).select("size").distinct().collect()))


def window_hits(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """_key, item, n, at, _slots, slots and times of the windows that docs (_dc_id, _dc_text) and items share."""
    # equal windows of a document are one row before they meet the items that have them
    made = windows(docs, "_dc_id", "_dc_text", sizes(wanted)).groupBy("_key", "_hash", "_slots").agg(F.count("*").alias("times"))
    met = made.join(wanted.drop("size"), "_hash")
    # windows of an item are few, so what is kept of a document and an item is bounded by the item
    return met.groupBy("_key", "item", "n", "at", "_slots", "slots").agg(F.sum("times").alias("times"))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document that holds an item: doc_id, n_items, item_ids and the best cover."""
    pairs = contaminated_pairs(docs, benchmark, **options)
    return pairs.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("cover").alias("best_cover"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that hold an item."""
    found = contaminated_pairs(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("_dc_found")).distinct()
    return docs.join(found, docs[id_col] == found["_dc_found"], "left_anti")
