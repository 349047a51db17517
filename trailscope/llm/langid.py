"""Language identification: known words first, shorter and shorter character n-grams for the rest.

Training counts words per language over a bounded sample of labelled documents
(``train_rows``) and keeps the ``max_grams`` most frequent words and as many
character n-grams (lengths 5 to 1 of the words between blanks), so what the tasks
receive is bounded by these two parameters at any input size. A known word scores its log frequency in
each language; an unknown one the mean over its longest n-grams that are known. A
document sums its words and a prior by documents per language.

Results: a null text, and one without a letter, is ``und`` with score 0, as is every text
when no labelled row exists. Ties go to the first language by code point. Repeated
rows get equal results, very long texts are scored whole, and an empty table gives an empty result. An input column named like the output is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailscope.llm.common import slices, store, text_udf

TRAIN_ROWS = 20_000
MAX_GRAMS = 60_000
MAX_N = 5
MEMO_WORDS = 300_000
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class LanguageModel:
    """Languages, their prior, and log-frequency rows by word (n = 0) or n-gram (n > 0)."""

    langs: list[str]
    prior: np.ndarray
    rows: dict[int, dict[str, int]]
    table: np.ndarray

    def scorer(self):
        return _Scorer(self)


class _Scorer(dict):
    """Word -> row of a matrix: first the known words, then unseen ones, backed off once and remembered up to ``MEMO_WORDS``."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.langs = max(1, len(model.langs))
        self.grams = [(n, {g: tuple(model.table[r].tolist()) for g, r in model.rows[n].items()}) for n in range(MAX_N, 0, -1)]
        self.known = {w: k for k, w in enumerate(model.rows[0])}
        self.matrix = np.zeros((len(self.known) + MEMO_WORDS, self.langs))
        self.matrix[: len(self.known)] = model.table[list(model.rows[0].values())].reshape(-1, self.langs) if self.known else 0
        self.update(self.known)

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k >= len(self.matrix):
            raise MemoryError
        self.matrix[k] = self.backoff(word)
        self[word] = k
        return k

    def backoff(self, word: str) -> tuple[float, ...]:
        """Mean over the longest n-grams of the word that are known; zeros where none is."""
        padded = f" {word} "
        for n, rows in self.grams:
            found = [r for r in map(rows.get, [padded[i : i + n] for i in range(len(padded) - n + 1)]) if r]
            if found:
                return tuple(sum(c) / len(found) for c in zip(*found))
        return (0.0,) * self.langs

    def score(self, words: list[str]) -> np.ndarray:
        total = np.zeros(self.langs)
        for at in range(0, len(words), MEMO_WORDS // 2):
            part = words[at : at + MEMO_WORDS // 2]
            try:
                ids = list(map(self.__getitem__, part))
            except MemoryError:
                self.clear()
                self.update(self.known)
                ids = list(map(self.__getitem__, part))
            total += self.matrix[ids].sum(axis=0)
        return total


def fit_language_model(df: DataFrame, text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, max_grams: int = MAX_GRAMS) -> LanguageModel:
    """Learn from rows with a non-null language; about ``train_rows`` of them, drawn reproducibly by a hash of the text."""
    labelled = df.select(df[text_col].alias("text"), df[lang_col].alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    docs = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    langs = sorted(docs)
    if not langs:
        return LanguageModel([], np.zeros(0), {n: {} for n in range(MAX_N + 1)}, np.zeros((0, 0)))
    n = sum(docs.values())
    share = min(1.0, train_rows / n)
    sample = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def grams(batches):
        import pyarrow as pa

        for batch in batches:
            by_lang: dict[str, Counter] = defaultdict(Counter)
            for part in slices([batch]):
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by_lang[lang].update(_WORDS.findall(text.lower()))
            out: dict[tuple[str, int, str], int] = defaultdict(int)
            for lang, words in by_lang.items():
                for w, c in words.items():
                    out[lang, 0, w] += c
                    padded = f" {w} "
                    for size in range(1, MAX_N + 1):
                        for i in range(len(padded) - size + 1):
                            out[lang, size, padded[i : i + size]] += c
            keys = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))] + [pa.array(list(out.values()), pa.int64())], ["lang", "n", "gram", "c"])

    counted = sample.mapInArrow(grams, "lang string, n int, gram string, c long").groupBy("n", "gram", "lang").agg(F.sum("c").alias("c"))
    per_gram = store(counted.groupBy("n", "gram").agg(F.sum("c").alias("c"), F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("by_lang")), "language-grams")
    # The most frequent words and n-grams of each language, so that a language with most of the text does not take the places of the others.
    place = Window.partitionBy("lang", "word").orderBy(F.desc("c"), "n", "gram")
    ranked = per_gram.select("n", "gram", F.explode("by_lang").alias("lang", "c")).withColumn("word", F.col("n") == 0).withColumn("place", F.row_number().over(place))
    chosen = ranked.where(F.col("place") <= max(1, max_grams // len(langs))).select("n", "gram").distinct()
    # at most max_grams words and as many n-grams
    top = sorted(per_gram.join(chosen, ["n", "gram"]).collect(), key=lambda r: (-r.c, r.n, r.gram))
    totals = np.zeros((MAX_N + 1, len(langs)))
    kinds = Counter(r.n for r in top)
    for r in top:
        for lang, c in r.by_lang.items():
            totals[r.n, langs.index(lang)] += c
    rows: dict[int, dict[str, int]] = {n: {} for n in range(MAX_N + 1)}
    table = np.zeros((len(top), len(langs)))
    for k, r in enumerate(top):
        rows[r.n][r.gram] = k
        for j, lang in enumerate(langs):
            table[k, j] = math.log((r.by_lang.get(lang, 0) + 0.1) / (totals[r.n, j] + 0.1 * kinds[r.n]))
    prior = np.log(np.array([docs[x] / n for x in langs]))
    return LanguageModel(langs, prior, rows, table)


def identify_language(df: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """Add ``out``, a struct of ``lang`` and ``score`` (posterior of that language, 0 to 1)."""

    def make():
        scorer = model.scorer()

        def work(texts):
            langs, scores = [], []
            for text in texts:
                words = _WORDS.findall(text.lower()) if text else []
                if not words or not model.langs or not any(map(str.isalpha, text)):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = scorer.score(words) + model.prior
                best = int(total.argmax())
                langs.append(model.langs[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            return [langs, scores]

        return work

    return df.withColumn(out, text_udf("lang string, score double", make)(df[text_col]))
