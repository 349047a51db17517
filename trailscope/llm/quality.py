"""Quality rules as a short-circuit cascade.

Each rule is a test on one text that says *reject*. The order of the tests is not
fixed: a bounded sample of documents is measured for what each rule costs and which
of them it rejects, and a greedy pass puts the rule with the most rejections
per second first, judged on the sampled documents that the rules before it kept.
Documents then run the rules in that order and stop at the first rejection.
The order changes the cost only, never the verdict.

Results: a null text has no words and fails the base rules like an empty one. Repeated rows get
equal verdicts, an empty table an empty result; texts are read whole. An input column named like the output is replaced.
Other columns of the input pass through untouched.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailscope.llm.common import spare_name, text_udf

#: Fixed by the contract: symbol characters, the floor of words, the share of repeated words.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SAMPLE_ROWS = 2000


class TextView:
    """One text with its derived views, each computed on first use only."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\x0b\x0c\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def word_ids(self) -> np.ndarray:
        seen: dict[bytes, int] = {}
        return np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, self.n_words)

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        ids, base = self.word_ids, n
        pairs = ids[:-1] * base + ids[1:]
        if n >= 1 << 20:  # three ids would not fit 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * base + ids[2:]
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        again = np.zeros(n - 2, bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        return int(covered.sum())

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


@dataclass(frozen=True)
class Rule:
    """A named test; ``rejects`` is true for a text to drop."""

    name: str
    rejects: Callable[[TextView], bool]


def _upper_share(v: TextView) -> float:
    upper = sum(map(str.isupper, v.text))
    return upper / max(1, v.word_chars)


def _odd_share(v: TextView) -> float:
    """Share of word characters that are neither letters, digits, marks nor everyday punctuation (``'`` to ``;``, quotes, ``!``, ``?``)."""
    plain = sum(map(str.isalnum, v.text)) + sum(map(v.text.count, ".,;:!?'\"()-/"))
    return 1 - min(1.0, plain / max(1, v.word_chars))


def _top_word_share(v: TextView) -> float:
    return Counter(v.word_ids.tolist()).most_common(1)[0][1] / v.n_words if v.n_words else 0.0


#: The rules after the base ones, loose enough for prose of any language.
DEFAULT_RULES = (
    Rule("symbols", lambda v: 10 * v.n_symbols > v.n_words),
    Rule("duplicate_lines", lambda v: 10 * v.n_dup_lines > 3 * len(v.lines)),
    Rule("word_length", lambda v: not 2 * v.n_words <= v.word_chars <= 25 * v.n_words),
    Rule("shouting", lambda v: 2 * _upper_share(v) > 1),
    Rule("odd_characters", lambda v: _odd_share(v) > 0.3),
    Rule("one_word", lambda v: _top_word_share(v) > 0.3),
)
BASE_RULES = (
    Rule("few_words", lambda v: v.n_words < MIN_WORDS),
    Rule("repeated_words", lambda v: 100 * v.n_repeat_words > MAX_REPEAT_PERCENT * v.n_words),
)


def measure_rules(df: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[list[float], list[tuple[frozenset[int], int]]]:
    """Seconds of each rule over a sample of about ``sample_rows`` rows, and how many sampled rows each set of rules rejects.

    The sample is bounded by ``sample_rows``; it only serves the order. Per text
    and rule the cost counts every view that the rule needs.
    """
    texts = df.select(df[text_col].alias("text"))
    n = df.select(F.lit(1)).count()
    if not n:
        return [0.0] * len(rules), []
    sample = texts.where(F.rand(seed=7) < min(1.0, sample_rows / n)).limit(sample_rows)

    def run(batches):
        import pyarrow as pa

        cost, sets = [0.0] * len(rules), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                hit = []
                for k, rule in enumerate(rules):
                    view, began = TextView(text), time.perf_counter()
                    if rule.rejects(view):
                        hit.append(k)
                    cost[k] += time.perf_counter() - began
                sets[tuple(hit)] += 1
        rows = [(list(s), c, None) for s, c in sets.items()] + [([], 0, cost)]
        yield pa.RecordBatch.from_pylist([{"hit": a, "n": b, "cost": c} for a, b, c in rows], schema=pa.schema([("hit", pa.list_(pa.int32())), ("n", pa.int64()), ("cost", pa.list_(pa.float64()))]))

    found = sample.mapInArrow(run, "hit array<int>, n long, cost array<double>").collect()  # a row per set of rules and task
    cost, sets = [0.0] * len(rules), Counter()
    for r in found:
        if r.cost is not None:
            cost = [a + b for a, b in zip(cost, r.cost)]
        else:
            sets[frozenset(r.hit)] += r.n
    return cost, list(sets.items())


def order_rules(rules: tuple[Rule, ...], cost: list[float], sets: list[tuple[frozenset[int], int]]) -> tuple[Rule, ...]:
    """Greedy order: most rejections per second among the sampled rows still kept; ties by the given order."""
    left, out = list(range(len(rules))), []
    while left:
        gain = {k: sum(n for s, n in sets if k in s) / max(cost[k], 1e-9) for k in left}
        best = max(left, key=lambda k: (gain[k], -k))
        out.append(best)
        left.remove(best)
        sets = [(s, n) for s, n in sets if best not in s]
    return tuple(rules[k] for k in out)


def apply_cascade(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + DEFAULT_RULES, out: str = "rejected_by", sample_rows: int = SAMPLE_ROWS, base_stats: bool = False) -> DataFrame:
    """Add ``out``: the first rule in the measured order that rejects the text, null for a kept one.

    Which of several rejecting rules is named depends on the measured order; whether
    it is null does not. With ``base_stats`` ``out`` is a struct that also carries the
    base numbers of every text (then the base rules' views cost nothing more).
    """
    ordered = order_rules(rules, *measure_rules(df, rules, text_col, sample_rows))

    def make():
        def work(texts):
            names, stats = [], [[] for _ in range(6)]
            for text in texts:
                view = TextView(text)
                if base_stats:
                    for c, v in zip(stats, (view.n_words, view.word_chars, view.n_symbols, view.n_dup_lines, view.n_repeat_words, view.base_failed)):
                        c.append(v)
                names.append(next((r.name for r in ordered if r.rejects(view)), None))
            return [names, *stats] if base_stats else [names]

        return work

    base = ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    verdict = text_udf("name string" + base * base_stats, make)(df[text_col])
    return df.withColumn(out, verdict if base_stats else verdict["name"])


def keep_good(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + DEFAULT_RULES) -> DataFrame:
    """The rows that no rule rejects, with the input's columns."""
    name = spare_name(df.columns, "rejected_by")
    return apply_cascade(df, text_col, rules, name).where(F.col(name).isNull()).drop(name)
