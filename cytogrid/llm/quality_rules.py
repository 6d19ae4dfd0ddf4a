"""Quality of texts by a learned decision list over countable statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytogrid.llm.common import BATCH_ROWS, binary_text, map_batches

#: Bound of the labelled rows that the list is learned from, taken by a hash of their ids.
SAMPLE = 6000
#: A rule stays only if it is right this often on rows that it was not grown on.
PRECISION = 0.97
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r "
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_marks", "n_digits", "n_same_next",
)
#: Statistics that rules may test: name, numerator, denominator. None of them follows the length of a text.
RATIOS = (
    ("symbols_per_word", "n_symbols", "n_words"),
    ("chars_per_word", "word_chars", "n_words"),
    ("duplicate_lines", "n_dup_lines", "n_lines"),
    ("repeated_words", "n_repeat_words", "n_words"),
    ("upper_share", "n_upper", "word_chars"),
    ("marks_per_word", "n_marks", "n_words"),
    ("digit_share", "n_digits", "word_chars"),
    ("same_next", "n_same_next", "n_words"),
)


def repeated_words(codes: np.ndarray, kinds: int) -> int:
    """Words inside three-word windows that occur at least twice."""
    if len(codes) < 4:
        return 0
    pairs, last = codes[:-2] * kinds + codes[1:-1], codes[2:]
    if kinds > 1_000_000:  # keep the next product within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, place, counts = np.unique(pairs * kinds + last, return_inverse=True, return_counts=True)
    twice = counts[place] > 1
    inside = np.zeros(len(codes), bool)
    for shift in range(3):
        inside[shift : len(codes) - 2 + shift] |= twice
    return int(inside.sum())


def count_statistics(raw: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``.

    >>> count_statistics(b"a b c\\na b c\\n")[:5]
    (6, 6, 0, 1, 6)
    """
    text, words = raw.decode(), raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    names: dict[bytes, int] = {}
    codes = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(codes, len(names)),
        len(lines),
        sum(map(str.isupper, text)) if not text.islower() else 0,
        text.count("!") + text.count("?"),
        sum(map(text.count, "0123456789")),
        int((codes[1:] == codes[:-1]).sum()),
    )


def with_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id and ``COUNTS``) of every row; a null text has none of anything."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([count_statistics(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            columns = [pa.array(rows[:, i]) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *COUNTS])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), binary_text(text_column).alias("text"))
    schema = ", ".join(f"{c} long" for c in ("id", *COUNTS))
    return map_batches(rows, work, schema).withColumnRenamed("id", id_column)


def ratio(name: str) -> Column:
    over, under = next((o, u) for n, o, u in RATIOS if n == name)
    return F.col(over).cast("double") / F.greatest(F.col(under), F.lit(1))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return (table[self.statistic] > self.threshold) == self.above

    def column(self) -> Column:
        return ratio(self.statistic) > self.threshold if self.above else ratio(self.statistic) <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def covers(self, table: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(table.values()))), bool)
        for condition in self.conditions:
            out &= condition.holds(table)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for condition in self.conditions:
            out = out & condition.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def best_condition(table: dict[str, np.ndarray], low: np.ndarray, inside: np.ndarray) -> Condition | None:
    """The condition with the highest information gain on the rows inside, or none."""
    p, n = int((inside & low).sum()), int((inside & ~low).sum())
    best, gained = None, 1e-9
    for name, values in table.items():
        v, y = values[inside], low[inside]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if not len(cuts):
            continue
        p_low, n_low = np.cumsum(y)[cuts], np.cumsum(~y)[cuts]
        for above, pc, nc in ((False, p_low, n_low), (True, p - p_low, n - n_low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pc > 0, pc * (np.log2(pc / (pc + nc)) - np.log2(p / (p + n))), 0)
            at = int(gain.argmax())
            if gain[at] > gained:
                gained, best = gain[at], Condition(name, above, float((v[cuts[at]] + v[cuts[at] + 1]) / 2))
    return best


def grow(table: dict[str, np.ndarray], low: np.ndarray, inside: np.ndarray) -> Rule:
    conditions: list[Condition] = []
    inside = inside.copy()
    while (inside & ~low).any():
        condition = best_condition(table, low, inside)
        if condition is None:
            break
        conditions.append(condition)
        inside &= condition.holds(table)
    return Rule(tuple(conditions))


def worth(rule: Rule, table: dict[str, np.ndarray], low: np.ndarray, inside: np.ndarray) -> float:
    covered = rule.covers(table) & inside
    p, n = int((covered & low).sum()), int((covered & ~low).sum())
    return (p - n) / (p + n) if p + n else -1.0


def prune(rule: Rule, table: dict[str, np.ndarray], low: np.ndarray, inside: np.ndarray) -> Rule:
    """Drops last conditions while the rule is worth no less on rows that it was not grown on."""
    while len(rule.conditions) > 1:
        shorter = Rule(rule.conditions[:-1])
        if worth(shorter, table, low, inside) < worth(rule, table, low, inside):
            break
        rule = shorter
    return rule


def learn(table: dict[str, np.ndarray], low: np.ndarray, pruning: np.ndarray, precision: float = PRECISION) -> list[Rule]:
    """An ordered list of rules for low quality, by sequential covering.

    ``pruning`` marks the third of the rows that prune and judge a rule; the rest grow it.
    """
    rules: list[Rule] = []
    left = np.ones(len(low), bool)
    while (left & low & ~pruning).any():  # every turn takes at least one row away
        rule = prune(grow(table, low, left & ~pruning), table, low, left & pruning)
        covered = rule.covers(table) & left
        right = int((covered & low).sum())
        unseen = covered & pruning
        if not rule.conditions or not right:
            break
        if right >= 3 and unseen.any() and worth(rule, table, low, left & pruning) >= 2 * precision - 1:
            rules.append(rule)
            left &= ~covered
        else:  # not to be trusted; go on without the rows that it was grown for
            left &= ~(covered & low & ~pruning)
    return rules


def fit(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Learns on the driver from counts of at most ``SAMPLE`` labelled rows, of those that pass the base."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    usable = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sample = F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))  # of a fixed number of ids at most
    rows = docs.select("doc_id", "text").join(sample.select("doc_id"), "doc_id", "left_semi")
    known = with_counts(rows).where(f"NOT ({BASE_FAILED})").join(sample, "doc_id").toPandas().sort_values(["doc_id", *COUNTS])
    if not len(known):
        return []
    table = {n: (known[o] / np.maximum(known[u], 1)).to_numpy("float64") for n, o, u in RATIOS}
    pruning = np.arange(len(known)) % 3 == 0
    return learn(table, known["quality"].to_numpy() == 0, pruning)


def rejected(rules: list[Rule]) -> Column:
    """The list as ordered conditional expressions: the first rule that covers a row decides."""
    if not rules:
        return F.lit(False)
    chain = F.when(rules[0].column(), F.lit(True))
    for rule in rules[1:]:
        chain = chain.when(rule.column(), F.lit(True))
    return chain.otherwise(F.lit(False))


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that pass the base and the list, with all their columns, whatever their names.

    Learns from the labelled ones among ``docs``; null and empty texts fail the base. Very long texts are counted whole.
    """
    rules = fit(docs, labels)
    counts = ", ".join(f"{c} long" for c in COUNTS)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    @F.pandas_udf(counts)
    def count(texts: pd.Series) -> pd.DataFrame:
        rows = np.array([count_statistics(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
        return pd.DataFrame(rows, columns=list(COUNTS))

    judged = docs.select(F.struct("*").alias("row"), count(binary_text()).alias("counts")).select("row", "counts.*")
    return judged.where(~F.expr(BASE_FAILED) & ~rejected(rules)).select("row.*")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the base counts, base_failed, kept, rule) of every row.

    A null or empty text has no words and fails the base; a very long one is counted whole, by one task. Labels other than 0 and 1 or without an
    id are left out; if no rule is found, the base alone decides. Rows are judged one by
    one: repeated rows come back repeated; other columns are ignored; an empty table gives no rows.
    ``rule`` is the place in the list of the rule that rejected the row, else null.
    """
    rules = fit(docs, labels)
    base_failed = F.expr(BASE_FAILED)
    place = F.coalesce(*[F.when(r.column(), F.lit(i + 1)) for i, r in enumerate(rules)], F.lit(None).cast("int"))
    return with_counts(docs).select(
        "doc_id",
        *COUNTS[:5],
        base_failed.alias("base_failed"),
        (~base_failed & ~rejected(rules)).alias("kept"),
        place.alias("rule"),
    )
