"""Quality rules: a decision list learned by sequential covering from labelled statistics of texts.

Every text gets counts (words, symbols, repeats, lines and so on). Features are rates of them, written as Spark
expressions. From the labelled rows a list of rules is learned that names documents of low quality: each rule is
a conjunction of thresholds. It grows on two thirds of the rows by the condition with the largest information
gain until it covers no good row, and is pruned on the other third to the prefix that separates best;
what it covers goes, and the next rule is learned from the rest, until a rule is not precise enough or covers
too few rows. The list becomes one conditional expression of Spark, first rule first, that also says which rule
decided; ``describe`` prints it.

Rules are learned from at most TRAIN_ROWS rows of statistics, picked by a hash of their id, outside the fold of
ids held out for measuring. A document that the fixed base rule rejects is no example.

Defined cases: null or empty text has no words, so the base rule rejects it; labels that are null or without a
document are not used; a document labelled twice is of low quality if any label says so; without usable
labels, or with labels of one kind, the list is empty and only the base rule decides; null ids are judged like others;
repeated rows give repeated rows; a text of any length counts whole; an empty table gives an empty result; other
columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import materialise

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: The model is fit on at most so many labelled rows.
TRAIN_ROWS = 32_768
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A rule has to be so precise on the rows it was pruned on, and to cover so many of low quality in all.
PRECISION, COVERED = 0.9, 6
MOST_RULES, MOST_CONDITIONS = 24, 6

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower", "n_digits", "n_marks", "n_shouts", "n_ends", "longest_word")
_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_MARKS = b"!\"'(),-./:;?[]_`{}~\\@^+="


def repeated(words: list[str]) -> int:
    """Words that lie in a window of three found twice or more, the first find included."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    _, pairs = np.unique(at[:-1] * len(number) + at[1:], return_inverse=True)
    _, which, n = np.unique(pairs[:-1] * len(number) + at[2:], return_inverse=True, return_counts=True)
    twice = n[which] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= twice
    return int(inside.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    raw = text.encode("utf-8", "surrogatepass")
    n = lambda letters: len(raw) - len(raw.translate(None, letters))
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(words), len(lines), len(set(words)),
        n(_UPPER), n(_LOWER), n(_DIGITS), n(_MARKS), text.count("!"), sum(x.rstrip("\x20\x09\x0b\x0c\x0d")[-1] in ".!?\"')" for x in lines), max(map(len, words), default=0),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the COUNTS of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([counts(t) for t in b.column("text").to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | {c: rows[:, k] for k, c in enumerate(COUNTS)})

    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def _share(part: str, *whole: str) -> str:
    return f"coalesce(try_divide({part}, {' + '.join(whole)}), 0D)"


#: What rules may test; each a rate, so that a rule means the same for short and long texts.
FEATURES = {
    "mean_word_chars": _share("word_chars", "n_words"),
    "symbols_a_word": _share("n_symbols", "n_words"),
    "duplicate_lines": _share("n_dup_lines", "n_lines"),
    "repeated_words": _share("n_repeat_words", "n_words"),
    "words_a_line": _share("n_words", "n_lines"),
    "distinct_words": _share("n_distinct", "n_words"),
    "upper_letters": _share("n_upper", "n_upper", "n_lower"),
    "digits_a_word": _share("n_digits", "n_words"),
    "marks_a_word": _share("n_marks", "n_words"),
    "shouts_a_word": _share("n_shouts", "n_words"),
    "ended_lines": _share("n_ends", "n_lines"),
    "longest_word": "double(longest_word)",
}
BASE_FAILED = f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    return reduce(and_, (c.holds(x, names) for c in rule), np.ones(len(x), bool))


def best_condition(x: np.ndarray, low: np.ndarray, names: list[str]) -> Condition | None:
    """The threshold with the largest information gain for ``low`` among all between neighbouring values."""
    found, most = None, 0.0
    had = np.log2(low.sum() / len(low))
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        v, p = x[order, j], np.cumsum(low[order])
        ends = np.flatnonzero(v[:-1] < v[1:])
        for above in (False, True):
            kept = (low.sum() - p[ends] if above else p[ends]).astype(float)
            rows = len(v) - ends - 1 if above else ends + 1
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(kept > 0, kept * (np.log2(kept / rows) - had), 0.0)
            if len(gain) and gain.max() > most + 1e-9:
                at = ends[gain.argmax()]
                found, most = Condition(name, above, float((v[at] + v[at + 1]) / 2 if (v[at] + v[at + 1]) / 2 < v[at + 1] else v[at])), float(gain.max())
    return found


def grown(x: np.ndarray, low: np.ndarray, names: list[str], conditions: int) -> Rule:
    """Conditions until no row of good quality is covered, or none helps."""
    rule: Rule = ()
    while len(rule) < conditions and low.any() and not low.all() and (c := best_condition(x, low, names)):
        rule, on = (*rule, c), c.holds(x, names)
        x, low = x[on], low[on]
    return rule


def pruned(rule: Rule, x: np.ndarray, low: np.ndarray, names: list[str]) -> tuple[Rule, int, int]:
    """The prefix with the largest (p - n) / (p + n) on rows it did not grow on, the shortest of equals; and its p and n."""
    best: tuple[float, Rule, int, int] = (-2.0, (), 0, 0)
    for k in range(1, len(rule) + 1):
        on = covered(rule[:k], x, names)
        p, n = int(low[on].sum()), int((~low[on]).sum())
        value = (p - n) / (p + n) if p + n else -1.0
        if value > best[0] + 1e-12:
            best = (value, rule[:k], p, n)
    return best[1:]


def learn(x: np.ndarray, low: np.ndarray, names: list[str], *, precision: float = PRECISION, least: int = COVERED, rules: int = MOST_RULES, conditions: int = MOST_CONDITIONS) -> list[Rule]:
    """Sequential covering; rows are dealt to growing and pruning by their place, every third to pruning."""
    out: list[Rule] = []
    place = np.arange(len(low)) % 3 == 2
    while len(out) < rules and low.any() and not low.all():
        rule = grown(x[~place], low[~place], names, conditions)
        if not rule:
            break
        rule, p, n = pruned(rule, x[place], low[place], names)
        on = covered(rule, x, names) if rule else np.zeros(len(low), bool)
        if p < precision * (p + n) or not p or low[on].sum() < max(least, precision * on.sum()):
            break
        out.append(rule)
        x, low, place = x[~on], low[~on], place[~on]
    return out


def deciding(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(reduce(and_, (c.column() for c in rules[k - 1])), F.lit(k)).otherwise(out)
    return out


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(map(str, r)) for r in rules]


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, **options) -> list[Rule]:
    """Rules from at most ``rows`` labelled rows of ``stats``; only their features reach the driver."""
    key = F.col("doc_id").cast("string")
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(key.alias("key")).agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("key"), "key").limit(rows)
    )
    features = stats.where(f"NOT ({BASE_FAILED})").select(key.alias("key"), *(F.expr(x).alias(n) for n, x in FEATURES.items()))
    got = features.join(F.broadcast(sample), "key").groupBy("key", *FEATURES).agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("key"), "key", *FEATURES).limit(rows).toArrow()
    names = list(FEATURES)
    x = np.stack([got.column(n).to_numpy() for n in names], axis=1) if got.num_rows else np.empty((0, len(names)))
    return learn(x, got.column("quality").to_numpy() == 0, names, **options)


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with base_failed, rule and kept."""
    failed, rule = F.expr(BASE_FAILED), deciding(rules)
    return stats.withColumns({"base_failed": failed, "rule": F.when(~failed, rule), "kept": ~failed & rule.isNull()})


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The op11 digest: each document's counts, whether it is kept, and the rule that decided against it."""
    stats = materialise(statistics(docs), "statistics")
    return judged(stats, train(stats, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
