"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding undoes accents, homoglyphs and digit substitutions.  The lexicon (whole words, word beginnings and word
endings) and its weights come from labelled rows; words that a beginning or ending would hit but that clean rows use
become exception phrases.  A document's features are its weighted hits, also divided by its length; a logistic
regression of these gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialise, unboxed

#: Characters that look like a Latin letter, and digits and signs that stand for one.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ł": "l", "ø": "o", "ß": "s",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
#: At most about this many different labelled rows of each class train the lexicon and the regression, however often each
#: is repeated.  They bound what is fetched and broadcast too: the lexicon and its exceptions hold words of these rows
#: only, each in three of them at least.
TRAIN_ROWS = {1: 8000, 0: 16000}
#: What a text without any hit scores at most, so that no text is called toxic for nothing.
SILENT = 0.45
AFFIX = (4, 5, 6)

_TABLE = str.maketrans(HOMOGLYPHS | {d: c for d, c in DIGITS.items() if d.isdigit()})
_SIGNS = re.compile(r"(?<=[a-z])[@$!|€](?=[a-z])")
_GAPS = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Folded words between single spaces, with one in front and behind."""
    text = (text or "").lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    text = _SIGNS.sub(lambda m: DIGITS[m[0]], text.translate(_TABLE))
    return f" {_GAPS.sub(' ', text).strip()} "


@dataclass
class Model:
    """weights: pattern to weight, a space marking a word's edge; exceptions: phrases whose hits don't count."""

    weights: dict[str, float]
    exceptions: list[str]
    coefficients: list[float]

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, model: Model) -> None:
        self.model, self.automaton = model, ahocorasick.Automaton()
        for p, w in model.weights.items():
            self.automaton.add_word(p, (p, w))
        for p in model.exceptions:
            self.automaton.add_word(p, (p, None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, str, float]]:
        """(start, end, pattern, weight) outside of exception phrases."""
        if not len(self.automaton):
            return []
        found = [(end + 1 - len(p), end + 1, p, w) for end, (p, w) in self.automaton.iter(folded)]
        spared = sorted((s, e) for s, e, _, w in found if w is None)
        starts, reach = [s for s, _ in spared], [0, *accumulate((e for _, e in spared), max)]
        return [x for x in found if x[3] is not None and x[1] > reach[bisect_right(starts, x[0])]]

    def features(self, text: str | None) -> list[float]:
        folded = fold(text)
        hits = self.hits(folded)
        words = folded.count(" ")
        total, each = sum(x[3] for x in hits), sum({x[2]: x[3] for x in hits}.values())
        return [1.0, math.log1p(total), math.log1p(each), 10 * total / (10 + words), max((x[3] for x in hits), default=0.0)]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.model.coefficients, self.features(text)))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """text, toxic of a bounded choice, by a hash of id and text, of the different labelled rows whose crc32(doc_id as text)
    mod 5 is not 0; and by how much, as a logarithm, the choice raises the odds of toxic rows over those of all of them."""
    known = labels.filter("doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    there = materialise(keyed.select("doc_id", "text_hash").distinct().join(known, "doc_id"))
    count = {r["toxic"]: r["count"] for r in there.groupBy("toxic").count().collect()}
    shares = {label: min(1.0, bound / max(1, count.get(label, 0))) for label, bound in TRAIN_ROWS.items()}
    share = F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])
    chosen = there.filter(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 20)) < share * (1 << 20))
    found = keyed.join(F.broadcast(chosen), ["doc_id", "text_hash"])  # a row for each of the bound at most
    return found.groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), math.log(shares[1] / shares[0])


def _telling(n1, n0, all1, all0):
    """G squared of a pattern's presence against the label, 0 where it doesn't speak for toxicity; Columns or arrays."""
    log, zero = (F.log, None) if not isinstance(n1, np.ndarray) else (np.log, 0)
    p = (n1 + n0) / (all1 + all0)
    out = 2 * (n1 * log((n1 + 0.01) / (all1 * p + 0.01)) + n0 * log((n0 + 0.01) / (all0 * p + 0.01)))
    good = n1 * all0 > 2 * n0 * all1
    return F.when(good, out).otherwise(0.0) if zero is None else np.where(good, out, 0.0)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model that the labels give; without rows of both classes, one that scores every text below 0.01.

    Null texts and ids, repeated rows and rows without a label don't matter; of several labels of a doc_id the greatest
    counts.  Where no pattern tells the classes apart, every text scores the share of toxic labels, SILENT at most.
    """
    rows, raised = training_rows(docs, labels)
    rows = materialise(rows)
    count = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    all1, all0 = count.get(1, 0), count.get(0, 0)
    if not all1 or not all0:
        return Model({}, [], [-5.0, 0.0, 0.0, 0.0, 0.0])

    def words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), 100):
                seen: dict[str, list[int]] = {}
                for text, toxic in zip(part["text"][lo : lo + 100], part["toxic"][lo : lo + 100], strict=True):
                    for w in set(fold(text).split()):
                        seen.setdefault(w, [0, 0])[int(toxic)] += 1
                yield pd.DataFrame([(w, n1, n0) for w, (n0, n1) in seen.items()], columns=["word", "n1", "n0"])

    table = materialise(rows.mapInPandas(words, "word string, n1 long, n0 long").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))
    word = F.col("word")
    affixes = [F.when(F.length(word) > k, F.concat(F.lit(" "), F.substring(word, 1, k))) for k in AFFIX] + [F.when(F.length(word) > k, F.concat(F.right(word, F.lit(k)), F.lit(" "))) for k in AFFIX]
    forms = table.select(F.explode(F.array(F.concat(F.lit(" "), word, F.lit(" ")), *affixes)).alias("pattern"), "n1", "n0").filter("pattern is not null")
    forms = forms.groupBy("pattern").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    least = 8 + 2 * math.log(1 + table.count())  # so that chance alone gives about none
    forms = forms.withColumn("g", _telling(F.col("n1"), F.col("n0"), F.lit(all1), F.lit(all0))).filter(f"g >= {least} and n1 >= 3")
    first = sorted(r["pattern"] for r in forms.select("pattern").collect())

    # The same with each document counted once, for these patterns alone.
    probe = Model(dict.fromkeys(first, 1.0), [], [])

    def match(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = probe.matcher()
        for part in parts:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(part["text"], part["toxic"], strict=True):
                for p in {x[2] for x in matcher.hits(fold(text))}:
                    seen.setdefault(p, [0, 0])[int(toxic)] += 1
            yield pd.DataFrame([(p, n1, n0) for p, (n0, n1) in seen.items()], columns=["pattern", "n1", "n0"])

    exact = rows.mapInPandas(match, "pattern string, n1 long, n0 long").groupBy("pattern").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).orderBy("pattern").toPandas()
    n1, n0 = exact["n1"].to_numpy(float), exact["n0"].to_numpy(float)
    keep = _telling(n1, n0, float(all1), float(all0)) >= least
    weight = np.log((n1 + 0.5) / (all1 + 1)) - np.log((n0 + 0.5) / (all0 + 1))
    weights = {p: float(w) for p, w in zip(exact["pattern"][keep], weight[keep], strict=True)}
    # Words that a beginning or an ending hits, though clean rows use them as often.
    affix = F.explode(F.array(*affixes)).alias("pattern")
    hitting = rows.sparkSession.createDataFrame([(p,) for p in weights if p.count(" ") == 1], "pattern string")
    clean = table.filter((F.col("n0") >= 3) & (F.col("n1") * all0 <= F.col("n0") * all1)).select("word", affix)
    spared = sorted(f" {r['word']} " for r in clean.join(F.broadcast(hitting), "pattern").select("word").distinct().collect())
    model = Model(weights, spared, [])

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = model.matcher()
        for part in parts:
            yield pd.DataFrame([(*matcher.features(t), float(y)) for t, y in zip(part["text"], part["toxic"], strict=True)], columns=list("abcdey"))

    seen = rows.mapInPandas(measure, "a double, b double, c double, d double, e double, y double").toPandas().sort_values(list("abcdey")).to_numpy()
    fitted = _logistic(seen[:, :-1], seen[:, -1])
    fitted[0] = min(fitted[0] - raised, math.log(SILENT / (1 - SILENT)))
    model.coefficients = fitted.tolist()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> np.ndarray:
    c = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(c)), x.T @ (y - p) - ridge * c)
        c += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return c


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs (with a text column) and score, a double from 0 to 1, which replaces a column of that name.

    Null and empty texts are scored like texts without hits; texts of any length, repeated rows and null ids like others;
    an empty table gives an empty result.
    """

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = model.matcher()
        for part in parts:
            yield pd.Series([matcher.score(t) for t in part], dtype="float64")

    return docs.withColumn("score", score("text"))


def clean_rows(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """The rows of docs that score less than cut under a model learnt from labels (doc_id, toxic) of the same rows; all of
    them where nothing could be learnt.

    Null texts, null ids and repeated rows are scored like others; further columns, of whatever names, stay.  Labels of unknown documents,
    null labels and labels other than 0 and 1 are not learnt from; of several labels of a doc_id the greatest counts.
    """
    scored = toxicity(boxed(docs, text=F.col("text")), train(docs.select("doc_id", "text"), labels))
    return unboxed(scored.filter(F.col("score") < cut), docs.columns)
