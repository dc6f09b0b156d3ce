"""Language ID by hierarchical discrimination: the family first, then one-versus-one linear support vector machines within it.

A text is lower-cased, all but letters become spaces, and hashed counts of its byte
pairs and triples over the whole text, damped by a square root and brought to
length one, are its features. One linear machine for each family (one versus
rest) picks the family; within it a machine for each pair of languages votes.

Fitting uses a bounded sample: `sample_rows` labelled rows in all, dealt evenly over
the languages and chosen by a hash of id and text. Prediction reads every row.

Defined results: null texts and texts without a letter are `und` with score 0; with no
labelled row at all every text is. One language only: it is predicted with score 1.
A null label is no label. Repeated rows get the same answer. Other columns pass through.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families of ISO 639-1 codes. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr uz",
    "indo-iranian": "bn fa gu hi mr ne pa ur",
    "semitic": "am ar he mt",
    "austronesian": "id jv ms su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
PAIRS, TRIPLES = 2048, 4096
#: Bytes of a text that are counted at a time.
PIECE = 1 << 20
_LETTERS = bytes((b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32) for b in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Hashed byte pairs and triples of the whole text, as a unit vector (zero for a text without any)."""
    counts = np.zeros(PAIRS + TRIPLES)
    for start in range(0, len(text), PIECE):
        raw = text[max(0, start - 2) : start + PIECE].lower().encode().translate(_LETTERS)
        b = np.frombuffer(b" " + b" ".join(raw.split()) + b" ", dtype=np.uint8).astype(np.uint32)
        if len(b) < 3:
            continue
        two = (b[:-1] << 8) | b[1:]
        counts[:PAIRS] += np.bincount(((two * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64), minlength=PAIRS)
        three = (two[:-1] << 8) | b[2:]
        counts[PAIRS:] += np.bincount(((three * np.uint32(2246822519)) >> np.uint32(20)).astype(np.int64), minlength=TRIPLES)
    x = np.sqrt(counts)
    size = np.sqrt(x @ x)
    return (x / size if size else x).astype(np.float32)


def fit_machine(x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 64, reg: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine (hinge loss, averaged subgradient steps); y is -1 or 1, both classes weigh the same."""
    rng = np.random.default_rng(7)
    at = [np.flatnonzero(y < 0), np.flatnonzero(y > 0)]
    w, b, mean_w, mean_b = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    for k in range(steps):
        rows = np.concatenate([rng.choice(a, batch // 2) for a in at])
        part, sign = x[rows], y[rows]
        wrong = sign * (part @ w + b) < 1
        rate = 4.0 / (1 + k / 40)
        w += rate * ((sign * wrong) @ part / batch - reg * w)
        b += rate * 0.1 * float((sign * wrong).mean())
        if 2 * k >= steps:
            mean_w, mean_b = mean_w + w, mean_b + b
    n = steps - (steps + 1) // 2
    return (mean_w / n).astype(np.float32), mean_b / n


@dataclass
class LanguageModel:
    families: list[str] = field(default_factory=list)
    members: list[list[str]] = field(default_factory=list)
    family_w: np.ndarray | None = None
    family_b: np.ndarray | None = None
    duels: list[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]] = field(default_factory=list)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.families or not has_letter(text):
            return "und", 0.0
        x = features(text)
        k, p = 0, 1.0
        if len(self.families) > 1:
            margin = np.clip(3 * (self.family_w @ x + self.family_b), -30, 30)
            odds = np.exp(margin - margin.max())
            k = int(odds.argmax())
            p = float(odds[k] / odds.sum())
        langs = self.members[k]
        if len(langs) == 1:
            return langs[0], p
        pairs, w, b = self.duels[k]
        wins = 1 / (1 + np.exp(-np.clip(3 * (w @ x + b), -30, 30)))
        votes, share = np.zeros(len(langs)), np.zeros(len(langs))
        for (i, j), win in zip(pairs, wins, strict=True):
            votes[i if win >= 0.5 else j] += 1
            share[i] += win
            share[j] += 1 - win
        best = max(range(len(langs)), key=lambda i: (votes[i], share[i], -i))
        return langs[best], p * float(share[best]) / (len(langs) - 1)


def fit_arrays(x: np.ndarray, langs: list[str]) -> LanguageModel:
    """The model of feature rows and their labels."""
    names = np.array(langs)
    by_family: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        by_family.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    model = LanguageModel(sorted(by_family), [by_family[f] for f in sorted(by_family)])
    if len(model.families) > 1:
        fitted = [fit_machine(x, np.where(np.isin(names, members), 1.0, -1.0)) for members in model.members]
        model.family_w, model.family_b = np.array([w for w, _ in fitted]), np.array([b for _, b in fitted])
    for members in model.members:
        pairs = [(i, j) for j in range(len(members)) for i in range(j)]
        fitted = []
        for i, j in pairs:
            rows = np.isin(names, [members[i], members[j]])
            fitted.append(fit_machine(x[rows], np.where(names[rows] == members[i], 1.0, -1.0)))
        model.duels.append((pairs, np.array([w for w, _ in fitted]), np.array([b for _, b in fitted])))
    return model


#: Languages that a model tells apart, at most; more are an error.
MOST_LANGS = 500


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 2400) -> LanguageModel:
    """The model of at most about `sample_rows` labelled rows (the bound of what is gathered in one task; 24 KB a row). The driver gets the model alone."""
    rows = labelled.where(labelled[lang_col].isNotNull() & labelled[text_col].isNotNull()).select(labelled[lang_col].alias("lang"), labelled[text_col].alias("text"), labelled[id_col].alias("id"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages are labelled")
    if not counts:
        return LanguageModel()
    each = max(1, sample_rows // len(counts))
    rate = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, each / n))])
    draw = F.pmod(F.xxhash64(F.col("id"), F.col("text")), F.lit(1_000_003)) / F.lit(1_000_003.0)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [has_letter(t) for t in batch["text"]]
            batch = batch[keep]
            yield pd.DataFrame({"lang": batch["lang"], "x": [features(t).tobytes() for t in batch["text"]]})

    def fitted(sample: pd.DataFrame) -> pd.DataFrame:
        got = sorted(zip(sample["lang"], map(bytes, sample["x"]), strict=True))
        model = fit_arrays(np.frombuffer(b"".join([x for _, x in got]), np.float32).reshape(len(got), -1), [lang for lang, _ in got])
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    drawn = rows.where(draw < rate[F.col("lang")]).select("lang", "text").mapInPandas(vectors, "lang string, x binary")
    told = drawn.groupBy(F.lit("all")).applyInPandas(fitted, "model binary").collect()
    return pickle.loads(told[0]["model"]) if told else LanguageModel()


def predictor(model: LanguageModel):
    """A column function: text to struct<lang, score>."""

    @F.pandas_udf("lang string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["lang", "score"])

    return predict


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """docs with out_col, a struct of lang and score."""
    return docs.withColumn(out_col, predictor(model)(docs[text_col]))


def held_out(id_col: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves `rest`; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == rest
