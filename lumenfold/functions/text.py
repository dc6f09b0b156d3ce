"""Scalar text functions: tokenizers, extractors, classifiers, facts and compressors, as Columns."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions import patterns as P


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def strip(text: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.trim(text, F.lit(" \t\n\x0b\x0c\r"))


def whitespace_tokens(text: Column) -> Column:
    """Tokens between white space of any script."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def token_count(text: Column) -> Column:
    return F.size(whitespace_tokens(text)).cast("long")


def lexical_tokens(text: Column) -> Column:
    """Lower-cased tokens of two characters or more, for ranking."""
    return F.filter(F.split(F.lower(text), P.TOKEN_BREAK), lambda x: F.char_length(x) >= 2)


def anchor_tokens(text: Column, lower: bool = True) -> Column:
    return _all(F.lower(text) if lower else text, P.ANCHOR_TOKEN)


def extractive_tokens(text: Column) -> Column:
    return _all(F.lower(text), r"[a-z0-9_/\.]+")


def extractive_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?;])\s+|\n+"), strip), lambda s: s != "")


def dedup_sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def sections(text: Column) -> Column:
    """Pieces that begin at a bullet, number or heading mark; the whole text if there is none."""
    parts = F.filter(F.transform(F.split(text, P.SECTION_START), strip), lambda s: s != "")
    return F.when(strip(text) == "", F.array().cast("array<string>")).when(F.size(parts) == 0, F.array(strip(text))).otherwise(parts)


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")


def words(text: Column) -> Column:
    return _all(text, P.WORD)


def _words_like(text: Column, pattern: str) -> Column:
    """Whole words that a pattern of single words (^...$) describes, found at once: other words are never cut out."""
    return _all(text, rf"(?<!{P.W})(?:{pattern[1:-1]})(?!{P.W})")


def files(text: Column) -> Column:
    """Matches of the file pattern, each begun where its run of characters begins: from there on a match is found if there is any, in one go.

    Texts without a dot and the start of an ending are not searched.
    """
    return F.when(text.contains(".") & text.rlike(rf"\.{P.W}{{2}}"), _all(text, r"(?<![\p{L}\p{N}_./\-])" + P.FILE)).otherwise(F.array().cast("array<string>"))


def steps(text: Column) -> Column:
    return F.when(text.rlike("(?i)step"), _all(text, P.STEP)).otherwise(F.array().cast("array<string>"))


def entity_texts(text: Column) -> Column:
    """The sorted set of technical entities, in lower case."""
    found = F.concat(_words_like(text, P.ALL_CAPS), files(text), steps(text), _words_like(text, P.NUMBER), _words_like(text, P.ERROR_NAME))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def typed_entities(text: Column) -> Column:
    """Distinct structs of text and type: file_path, error_code, step_reference, in this order.

    Only texts that hold what each match of a kind holds are searched for it.
    """
    none = F.array().cast("array<string>")
    codes = F.when(text.contains("Error") | text.contains("HTTP ") | text.rlike("[0-9]{3} [A-Z]"), _all(text, r"[A-Z][A-Z_]+Error|HTTP [0-9]{3}|[0-9]{3} [A-Z]+"))
    at = F.when(F.lower(text).contains("step"), _all(text, r"(?i)step\s+[0-9]+|\[step\s+[0-9]+\]"))
    kinds = [("file_path", files(text)), ("error_code", codes.otherwise(none)), ("step_reference", at.otherwise(none))]
    named = lambda k: lambda x: F.struct(x.alias("text"), F.lit(k).alias("type"))  # noqa: E731  a second parameter would be the place
    return F.when(text.isNotNull(), F.array_distinct(F.concat(*[F.transform(found, named(k)) for k, found in kinds])))


def key_tokens(text: Column) -> Column:
    """Numbers, capitalised and upper-case words: what makes a segment new."""
    return F.array_distinct(_words_like(text, P.KEY_TOKEN))


def is_tier_one(token: Column) -> Column:
    hit = F.lit(False)
    for p in P.TIER_ONE:
        hit = hit | token.rlike(p)
    return hit


def is_stopword_or_short(token: Column) -> Column:
    return (F.char_length(token) < 4) | token.isin(P.STOPWORDS)


def artifacts(text: Column) -> Column:
    return F.array_distinct(F.concat(*[_all(text, p) for p in P.ARTIFACTS]))


def is_artifact(text: Column) -> Column:
    hit = F.lit(False)
    for p in P.ARTIFACTS:
        hit = hit | text.rlike(p)
    return hit


def artifact_type(token: Column) -> Column:
    low = F.lower(token)
    return F.when(low.startswith("src/") | low.rlike(r"\.(ts|py|js|go|java)$"), "file").when(low.startswith("/api/"), "endpoint").when(low.rlike("^[0-9]+$") | low.rlike("^[45]"), "error").otherwise("variable")


def query_class(query: Column) -> Column:
    precise, named = query.rlike("(?i)" + "|".join(f"(?:{p})" for p in P.PRECISION)), query.rlike("|".join(f"(?:{p})" for p in P.LOOKUP))
    return F.when(precise & named, "ambiguous").when(precise, "precision").when(named, "entity").otherwise("context")


def step_number(query: Column) -> Column:
    return F.expr("try_cast(null as int)") if query is None else F.regexp_extract(query, r"(?i)\bstep\s+([0-9]+)\b", 1).try_cast("int")


def entity_hint(query: Column) -> Column:
    """The longest first match of the look-up patterns; of equals the earlier pattern's."""
    first = [F.regexp_extract(query, p, 0) for p in P.LOOKUP]
    best = first[0]
    for x in first[1:]:
        best = F.when(F.char_length(x) > F.char_length(best), x).otherwise(best)
    return F.nullif(best, F.lit(""))


def question_type(question: Column) -> Column:
    low = F.lower(question)
    entity = F.exists(entity_texts(question), lambda e: e.contains(".") | e.contains("error") | e.contains("step") | e.rlike("^[0-9]"))
    rule = F.when(entity, "entity").when(low.rlike(P.VERIFY_ANY) & (low.rlike(P.VERIFY_TRUTH) | low.rlike(P.VERIFY_START)), "verification")
    for name, pattern in P.QUESTION_RULES:
        rule = rule.when(low.rlike(pattern), name)
    return rule.otherwise("unknown")


def policy(kind: Column, table: dict[str, tuple[int, str]] | None = None) -> tuple[Column, Column]:
    """Depth and route of a question type; unknown types as 'unknown'."""
    table = table or P.POLICY
    depth, route = F.lit(table["unknown"][0]), F.lit(table["unknown"][1])
    for name, (k, r) in table.items():
        depth, route = F.when(kind == name, k).otherwise(depth), F.when(kind == name, r).otherwise(route)
    return depth, route


def polarity_inverted(a: Column, b: Column) -> Column:
    low_a, low_b = F.lower(a), F.lower(b)
    hit = F.lit(False)
    for x, y in P.POLARITY:
        hit = hit | (low_a.contains(x) & low_b.contains(y)) | (low_a.contains(y) & low_b.contains(x))
    return hit


def key_style(key: Column) -> Column:
    return F.when(key.contains("_") & (key == F.lower(key)) & (key != F.upper(key)), "snake_case").when(key.rlike("^[a-z][a-zA-Z0-9]*$"), "camelCase").when(key.rlike("^[A-Z][a-zA-Z0-9]*$"), "PascalCase").when(key.rlike("^[A-Z][A-Z0-9_]*$"), "SCREAMING_SNAKE").otherwise("mixed")


def value_type(value: Column) -> Column:
    v = F.trim(strip(value), F.lit("\"'"))
    return F.when(F.lower(v).isin("true", "false"), "boolean").when(F.lower(v) == "null", "null").when(v.rlike("^-?[0-9]+$"), "integer").when(v.rlike(r"^-?[0-9]+\.[0-9]+$"), "float").otherwise("string")


def nesting_depth(text: Column) -> Column:
    """The greatest depth of brackets; a stray closing one does not go below zero."""
    marks = F.split(F.regexp_replace(text, r"[^{}\[\]]", ""), "")

    def step(acc: Column, c: Column) -> Column:
        now = F.when(c.isin("{", "["), acc["now"] + 1).when(c.isin("}", "]"), F.greatest(acc["now"] - 1, F.lit(0))).otherwise(acc["now"])
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda acc: acc["most"])


def score_of_reply(reply: Column, most: int = 5) -> Column:
    """A judge's score: the JSON field `score`, else the first digit that is no more than `most`."""
    return F.coalesce(F.get_json_object(F.when(reply.rlike(r"^\s*\{"), reply), "$.score").try_cast("double"), F.regexp_extract(reply, f"[0-{most}]", 0).try_cast("double"))


# facts -------------------------------------------------------------------


def has_fact(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs, case ignored; null for a null text.

    RE2 (of Arrow) reads a text once, whatever the pattern, where Java's engine begins anew at each character; all
    facts asked of a text travel in one batch. Patterns that RE2 can't say (looking around, back references) stay with Java.
    """
    whole = "(?i)(?:" + pattern + ")"
    try:
        pc.match_substring_regex(pa.array([""]), whole)
    except pa.ArrowInvalid:
        return text.rlike(whole)

    def occurs(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, whole)

    return F.arrow_udf(occurs, "boolean")(text)


def facts(text: Column, kind: str, schemas=P.SCHEMAS) -> dict[str, Column]:
    return {fact: has_fact(text, p) for t, _, fact, p in schemas if t == kind}


def required(kind: str, schemas=P.SCHEMAS) -> list[str]:
    return [p for t, need, _, p in schemas if t == kind and need]


def fit(text: Column, kind: str, schemas=P.SCHEMAS) -> Column:
    """The share of a type's required facts that the text has."""
    need = required(kind, schemas)
    return sum((has_fact(text, p).cast("int") for p in need), F.lit(0)) / F.lit(float(len(need)))


def schema_gap(text: Column, kind: str, schemas=P.SCHEMAS) -> Column:
    return 1 - fit(text, kind, schemas) if required(kind, schemas) else F.lit(0.0)


def schema_gap_pair(original: Column, compressed: Column, kind: str, schemas=P.SCHEMAS) -> Column:
    """The share of the original's required facts that the compressed text lost."""
    have = [(has_fact(original, p), has_fact(compressed, p)) for p in required(kind, schemas)]
    lost = sum(((o & ~c).cast("int") for o, c in have), F.lit(0))
    return lost / F.greatest(sum((o.cast("int") for o, _ in have), F.lit(0)), F.lit(1)).cast("double")


def truncation_aware_gap(gap: Column, ratio: Column) -> Column:
    """The gap, halved at most as less of the text is kept; a null ratio leaves it."""
    return F.when(ratio.isNull(), gap).otherwise(gap * (1 - 0.5 * (1 - F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)))))


def detect_schema(text: Column, schemas=P.SCHEMAS) -> Column:
    """The type with the most required facts (a count); the first of equals; empty without any."""
    kinds = list(dict.fromkeys(s[0] for s in schemas))
    scored = [F.struct(sum((has_fact(text, p).cast("int") for p in required(k, schemas)), F.lit(0)).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, k in enumerate(kinds)]
    best = F.greatest(*scored)
    return F.when(best["n"] > 0, best["kind"]).otherwise("")


def schema_novelty(text: Column, schemas=P.SCHEMAS) -> Column:
    return 1 - F.greatest(*[fit(text, k, schemas) for k in dict.fromkeys(s[0] for s in schemas)])


# compressors -------------------------------------------------------------


def truncate(text: Column, budget: Column | float) -> Column:
    budget = F.lit(budget) if isinstance(budget, float) else budget
    return F.substring(text, F.lit(1), F.floor(F.char_length(text) * budget).cast("int"))


def dedupe_sentences(text: Column) -> Column:
    """Sentences without those that came before (case aside), in order."""
    parts = F.filter(F.transform(dedup_sentences(text), strip), lambda s: s != "")
    low = F.transform(parts, F.lower)
    return F.array_join(F.filter(parts, lambda s, i: F.array_position(low, F.lower(s)) == i + 1), " ")
