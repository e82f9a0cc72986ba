"""Quality rules: text statistics, a base rule, and a learned decision list.

Sequential covering learns the list from labelled statistics: grow a conjunction of threshold tests
on two thirds of the sample by information gain, prune it on the rest, keep it while it is precise,
drop what it covers, go on.  The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import coded, slices, split_words

#: Bound of the labelled sample that is fitted on one machine.
MAX_LABELLED = 20_000
SYMBOLS = r"[#*$%&|<>]"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_RATIOS = {
    "mean_word": "word_chars / greatest(n_words, 1)", "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)", "dup_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)", "stop_share": "n_end / greatest(n_words, 1)", "distinct_share": "n_distinct / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)", "mean_line": "n_words / greatest(n_lines, 1)",
}
FEATURES = [*_RATIOS, *STATS]
_MORE = ["n_lines", "n_upper", "n_end", "n_distinct", "n_digits"]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _window_keys(codes: np.ndarray, row: np.ndarray, n_codes: int) -> np.ndarray:
    """One integer per 3-word window, equal exactly for equal windows of the same row."""
    n = max(1, n_codes)
    a, b, c, r = codes[:-2], codes[1:-1], codes[2:], row[:-2]
    if n**3 * (int(row[-1]) + 1) < 2**63:
        return ((r * n + a) * n + b) * n + c
    _, pair = np.unique(a * n + b, return_inverse=True)
    _, triple = np.unique(pair * n + c, return_inverse=True)
    return r * (int(triple.max()) + 1) + triple


def _repeated_words(codes: np.ndarray, n_codes: int, offsets: np.ndarray) -> np.ndarray:
    """Words of each row that lie in a 3-word window found twice or more in that row."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.zeros(len(codes), bool)
    if len(codes) >= 3:
        whole = np.flatnonzero(row[:-2] == row[2:])
        if len(whole):
            keys = _window_keys(codes, row, n_codes)[whole]
            order = np.sort(keys)
            twice = np.unique(order[1:][order[1:] == order[:-1]])
            if len(twice):
                spot = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
                starts = whole[twice[spot] == keys]
                for k in range(3):
                    inside[starts + k] = True
    return _sums(inside, offsets)


def _row_stats(texts) -> list[np.ndarray]:
    texts = pc.fill_null(texts, "")
    offsets, words = split_words(texts)
    codes, distinct = coded(words)
    lists = pc.split_pattern(texts, "\n")
    lines, cuts = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    line_codes, kinds = coded(lines)
    line_row = np.repeat(np.arange(len(texts)), np.diff(cuts))
    pairs = np.unique(line_row[full] * max(1, len(kinds)) + line_codes[full]) // max(1, len(kinds))
    n_lines = _sums(full, cuts)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    word_kinds = np.unique(row * max(1, len(distinct)) + codes) // max(1, len(distinct))
    per_word = lambda f: f(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(distinct) else np.zeros(0, np.int64)
    return [
        np.diff(offsets), _sums(per_word(pc.utf8_length), offsets), pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
        n_lines - np.bincount(pairs, minlength=len(texts)), _repeated_words(codes, len(distinct), offsets),
        n_lines, _sums(per_word(lambda d: pc.count_substring_regex(d, r"\p{Lu}")), offsets), _sums(per_word(lambda d: pc.match_substring_regex(d, r"[.!?]$")), offsets),
        np.bincount(word_kinds, minlength=len(texts)), _sums(per_word(lambda d: pc.count_substring_regex(d, r"\p{N}")), offsets),
    ]


def _counted(docs: DataFrame, into: str) -> DataFrame:
    """All columns of ``docs`` plus the counts as a struct ``into``."""
    names = [*STATS, *_MORE]
    kind = pa.struct([(n, pa.int64()) for n in names])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                columns = [pa.array(c.astype(np.int64)) for c in _row_stats(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(columns, fields=list(kind))], [*part.schema.names, into])

    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.StructType([T.StructField(n, T.LongType()) for n in names]))])
    return docs.mapInArrow(run, schema)


def _named(counts: str) -> list[Column]:
    """The statistics and ratios of a struct of counts, under their names."""
    ratio = lambda e: F.expr(re.sub(r"\b(?!greatest\b)([a-z]\w*)", rf"`{counts}`.\1", e)).cast("double")
    return [*[F.col(f"`{counts}`.{n}").alias(n) for n in STATS], *[ratio(e).alias(n) for n, e in _RATIOS.items()]]


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def statistics(docs: DataFrame) -> DataFrame:
    """Statistics of every whole text of ``docs`` (doc_id, text), row by row; null text has no words.

    A word is a run of anything but ASCII white space.  Columns as in ``STATS``, the ratios the
    learner uses, and ``base_failed``.  Rows that repeat come out as often; other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = _counted(plain, "_counts").select("doc_id", *_named("_counts"))
    return counted.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))


def passing(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs``, with all their columns, that pass the base rule and the list."""
    counted = _counted(docs, "_counts").withColumn("_stats", F.struct(*_named("_counts")))
    verdict, _ = decision(rules, "_stats.")
    return counted.where(~base_failed(F.col("_stats.n_words"), F.col("_stats.n_repeat_words")) & verdict).select(*docs.columns)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def column(self, prefix: str = "") -> Column:
        c = F.col(prefix + self.feature)
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects; ``precision`` is measured on the pruning part."""

    tests: tuple[Test, ...]
    precision: float
    covered: int


def _covered(tests, x, n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in tests:
        out &= t.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, candidates: list[Test], longest: int) -> list[Test]:
    """Add the test of the largest first-order information gain until no bad row of another kind is covered."""
    tests: list[Test] = []
    mask = np.ones(len(y), bool)
    while len(tests) < longest:
        p, n = int(y[mask].sum()), int((~y[mask]).sum())
        if not p or not n:
            break
        best, gain = None, 1e-9
        for t in candidates:
            sub = mask & t.holds(x)
            p1 = int(y[sub].sum())
            n1 = int(sub.sum()) - p1
            if p1 and p1 + n1 < p + n:
                g = p1 * (np.log2((p1 + 1) / (p1 + n1 + 1)) - np.log2((p + 1) / (p + n + 1)))
                if g > gain:
                    best, gain = t, g
        if best is None:
            break
        tests.append(best)
        mask &= best.holds(x)
    return tests


def _prune(tests: list[Test], x, y: np.ndarray) -> list[Test]:
    """Drop final tests while (covered bad - covered good) / covered does not fall."""
    worth = lambda ts: (lambda m: (2 * int(y[m].sum()) - int(m.sum())) / max(1, int(m.sum())))(_covered(ts, x, len(y)))
    best, value = tests, worth(tests)
    for k in range(len(tests) - 1, 0, -1):
        if (w := worth(tests[:k])) >= value:
            best, value = tests[:k], w
    return best


def _cuts(v: np.ndarray, bad: np.ndarray, n: int) -> list[float]:
    """Thresholds half-way between neighbouring values, at quantiles of each kind of row."""
    values = np.unique(v)
    if len(values) < 2:
        return []
    at = np.concatenate([np.quantile(v[m], np.linspace(0, 1, n), method="lower") for m in (bad, ~bad) if m.any()])
    k = np.unique(np.concatenate([np.searchsorted(values, at), np.searchsorted(values, at) - 1]))
    k = k[(k >= 0) & (k < len(values) - 1)]
    return ((values[k] + values[k + 1]) / 2).tolist()


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 15, most_rules: int = 20, longest: int = 4, cuts: int = 32) -> list[Rule]:
    """Ordered rejecting rules for the rows marked ``bad``; every third row prunes."""
    rules: list[Rule] = []
    left = np.arange(len(bad))
    while len(rules) < most_rules and bad[left].any():
        held = left % 3 == 0
        grow, prune = left[~held], left[held]
        if not bad[grow].any() or not len(prune):
            break
        gx = {k: v[grow] for k, v in x.items()}
        px = {k: v[prune] for k, v in x.items()}
        candidates = [Test(f, above, c) for f, v in gx.items() for c in _cuts(v, bad[grow], cuts) for above in (True, False)]
        tests = _grow(gx, bad[grow], candidates, longest)
        if not tests:
            break
        tests = _prune(tests, px, bad[prune])
        hit = _covered(tests, px, len(prune))
        right = int(bad[prune][hit].sum())
        if hit.sum() * 3 < least or right < precision * hit.sum():
            break
        rules.append(Rule(tuple(tests), right / max(1, int(hit.sum())), int(hit.sum())))
        left = left[~_covered(tests, {k: v[left] for k, v in x.items()}, len(left))]
    return rules


def decision(rules: list[Rule], prefix: str = "") -> tuple[Column, Column]:
    """(verdict, number of the rule that decided, from 1; 0 for the default) as ordered conditions."""
    verdict, number = None, None
    for k, rule in enumerate(rules, 1):
        cond = rule.tests[0].column(prefix)
        for t in rule.tests[1:]:
            cond = cond & t.column(prefix)
        verdict = F.when(cond, F.lit(False)) if verdict is None else verdict.when(cond, F.lit(False))
        number = F.when(cond, F.lit(k)) if number is None else number.when(cond, F.lit(k))
    return (F.lit(True), F.lit(0)) if verdict is None else (verdict.otherwise(F.lit(True)), number.otherwise(F.lit(0)))


def sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Statistics and marks of at most ``limit`` labelled documents (lowest hash first) that pass the base rule."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
        .groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    mine = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id").dropDuplicates(["doc_id"])  # at most `limit` ids
    got = (
        statistics(mine).where(~F.col("base_failed")).join(F.broadcast(chosen), "doc_id")
        .select(*[F.col(f).cast("double").alias(f) for f in FEATURES], "quality", "doc_id").toPandas().sort_values("doc_id")
    )
    order = np.random.default_rng(7).permutation(len(got))
    return {f: got[f].to_numpy()[order] for f in FEATURES}, (got["quality"].to_numpy() == 0)[order]


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the statistics, base_failed, kept, rule."""
    verdict, number = decision(rules)
    return statistics(docs).select("doc_id", *STATS, "base_failed", (~F.col("base_failed") & verdict).alias("kept"), number.alias("rule"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return apply_rules(docs, learn(*sample(docs, labels)))
