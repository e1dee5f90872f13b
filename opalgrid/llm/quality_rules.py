"""Quality rules: text statistics and a learned decision list.

Statistics of whole texts come from one pass. Sequential covering then learns from labelled
rows: a rule grows threshold by threshold (FOIL gain) on two thirds of the rows, is pruned on
the last third, and the rows it covers leave; so it goes until no rule is precise enough. The
list is emitted as one ordered Spark conditional expression.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opalgrid.llm.common import WordHashes, column_bytes, column_of, hash_sample, stash, trimmed, tune, window_hashes

SYMBOLS = b"#*$%&|<>"
#: Most labelled rows the list is learnt from; rows with the smallest hashes of their identifier.
TRAIN_ROWS = 20_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_distinct_words", "n_upper", "n_digits", "n_marks", "n_lines", "n_bars"]
#: Shares that rules test, as numerator and denominator.
FEATURES = {
    "mean_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "bars_per_word": ("n_bars", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "words_per_line": ("n_words", "n_lines"),
}
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), b"0123456789", b"!?;:"
_SPACE = b" \t\n\r\x0b\x0c"


def repeated_words(h: np.ndarray) -> int:
    """Words in runs of three that the text holds twice or more."""
    g = window_hashes(h, 3)
    if len(g) < 2:
        return 0
    order = np.argsort(g)
    s = g[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h), bool)
    for i in range(3):
        covered[i : i + len(g)] |= twice
    return int(covered.sum())


def text_counts(text: bytes, hashes: WordHashes) -> tuple[int, ...]:
    words = text.split()
    n = len(words)
    chars = len(text) - len(text.translate(None, _SPACE))
    points = len(text) - int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80)) - chars
    lines = text.split(b"\n")
    dups = 0
    if len(set(lines)) < len(lines):
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                dups += bool(line.split())
            seen.add(line)
    h = hashes.of(words)
    less = lambda kind: len(text) - len(text.translate(None, kind))
    return (n, points, less(SYMBOLS), dups, repeated_words(h), len(np.unique(h)), less(_UPPER), less(_DIGITS), less(_MARKS), len(lines), text.count(b"|"))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text; null counts as empty."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = [text_counts(t, hashes) for t in column_bytes(column_of(batch, "text"))]
            if rows:
                yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), column_of(batch, "row_key"), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=["doc_id", "row_key", *COUNTS, *MORE])

    schema = "doc_id long, row_key long, " + ", ".join(f"{c} long" for c in [*COUNTS, *MORE])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text").mapInArrow(trimmed(run), schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _gain(p0: float, n0: float, p1: np.ndarray, n1: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p1 > 0, p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _best_test(x: np.ndarray, y: np.ndarray) -> tuple[float, int, str, float] | None:
    """The threshold test of highest FOIL gain: (gain, feature, sign, threshold)."""
    p0, n0, best = y.sum(), (~y).sum(), None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        edge = np.flatnonzero(v[1:] > v[:-1])
        if not len(edge):
            continue
        p, n = np.cumsum(t)[edge], np.cumsum(~t)[edge]
        for sign, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
            g = _gain(p0, n0, a.astype(float), b.astype(float))
            k = int(np.argmax(g))
            if np.isfinite(g[k]) and g[k] > 1e-9 and (best is None or g[k] > best[0] + 1e-9):
                best = (float(g[k]), f, sign, float((v[edge[k]] + v[edge[k] + 1]) / 2))
    return best


def _covers(rule: list, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, sign, t in rule:
        out &= x[:, f] <= t if sign == "<=" else x[:, f] > t
    return out


def learn(x: np.ndarray, bad: np.ndarray, least_precision: float = 0.97, least_rows: int = 5, most_rules: int = 24, most_tests: int = 4) -> list[list[tuple[int, str, float]]]:
    """Sequential covering: an ordered list of conjunctions that mark bad rows."""
    rules: list[list] = []
    third = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and (bad & left).sum() >= least_rows:
        grow, prune = left & ~third, left & third
        rule, inside = [], grow.copy()
        while len(rule) < most_tests and (~bad & inside).any() and (bad & inside).any():
            test = _best_test(x[inside], bad[inside])
            if test is None:
                break
            rule.append(test[1:])
            inside &= _covers(rule, x)

        def worth(r: list) -> tuple[float, int]:
            c = _covers(r, x) & prune
            p, n = (c & bad).sum(), (c & ~bad).sum()
            return ((p - n) / max(1, p + n), -len(r))

        while len(rule) > 1:
            shorter = max(([*rule[:i], *rule[i + 1 :]] for i in range(len(rule))), key=worth)
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        hit = _covers(rule, x) & left if rule else np.zeros(len(x), bool)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        if p < least_rows or p < least_precision * (p + n):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def feature(name: str) -> Column:
    a, b = FEATURES[name]
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def expression(rules: list[list[tuple[int, str, float]]]) -> Column:
    """The list as one conditional: the number of the first rule that holds, else null."""
    names, out = list(FEATURES), None
    for k, rule in enumerate(rules, 1):
        tests = [feature(names[f]) <= t if sign == "<=" else feature(names[f]) > t for f, sign, t in rule]
        holds = functools.reduce(lambda a, b: a & b, tests)
        out = F.when(holds, F.lit(k)) if out is None else out.when(holds, F.lit(k))
    return F.lit(None).cast("int") if out is None else out.cast("int")


def quality_rules(docs: DataFrame, labels: DataFrame | None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, row_key (hash of the text), the counts, base_failed, rule and kept for every row.

    A null text counts as empty and fails the base rule. Without labels the list is empty and
    the base rule alone decides. A document with several labels counts as bad if one says so;
    null labels are left out. Rows that repeat get equal verdicts; an empty table gives an
    empty result.
    """
    stats = stash(statistics(docs)).withColumn("base_failed", base_failed())
    rules: list = []
    if labels is not None:
        known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
        labelled = stats.where(~F.col("base_failed")).join(known, "doc_id").select("doc_id", "row_key", "quality", *(feature(f).alias(f) for f in FEATURES))
        rows = hash_sample(labelled, "doc_id", train_rows, ("row_key",)).toPandas()
        if len(rows):
            rules = learn(rows[list(FEATURES)].to_numpy(float), rows["quality"].to_numpy() == 0)
    return stats.withColumn("rule", expression(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
