"""Glob rules over URLs, all simulated at once by bit-parallel Shift-And."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytogrid.llm.common import map_batches

#: (host and path prefix, verdict) of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
CUT = 1 << 16  # bytes of a URL that are laid out as a matrix at a time


class Automaton:
    """Globs packed into one Shift-And automaton of several 64-bit words.

    ``*`` stands for any run of bytes without a slash, ``**`` for any run. A star adds no
    position: it keeps the position before it alive for the bytes that it may stand for. Each
    glob gets its positions side by side; a glob fits if its last position is alive at the end.
    """

    def __init__(self, globs: list[bytes]):
        if any(not g or g[:1] == b"*" for g in globs):
            raise ValueError("a glob starts with a literal")
        chars, loops, self.ends, starts = [], [], [], []
        for glob in globs:
            starts.append(len(chars))
            at = 0
            while at < len(glob):
                if glob[at : at + 2] == b"**":
                    loops[-1], at = "any", at + 2
                elif glob[at : at + 1] == b"*":
                    loops[-1], at = loops[-1] or "host", at + 1
                else:
                    chars.append(glob[at])
                    loops.append(None)
                    at += 1
            self.ends.append(len(chars) - 1)
        self.words = -(-len(chars) // 64)
        self.step, self.stay = self.zeros(256), self.zeros(256)
        self.first, self.sure = self.zeros(1)[0], self.zeros(1)[0]
        for i, (char, loop) in enumerate(zip(chars, loops, strict=True)):
            word, bit = i // 64, np.uint64(1 << (i % 64))
            self.step[char, word] |= bit
            if loop:
                self.stay[:, word] |= bit
            if loop == "host":
                self.stay[ord("/"), word] &= ~bit
            if i in starts:
                self.first[word] |= bit
            if loop == "any" and i in self.ends:
                self.sure[word] |= bit
        self.open = ~self.first  # a start position is never reached from the glob before it

    def zeros(self, rows: int) -> np.ndarray:
        return np.zeros((rows, self.words), np.uint64)

    def run(self, texts: list[bytes]) -> np.ndarray:
        """A boolean matrix: which glob (column) fits which whole text (row)."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        alive = self.zeros(len(texts))
        live, at = order[lengths[order] > 0], 0
        while len(live):  # blocks of columns, so that one long URL does not widen a whole matrix
            width = min(int(lengths[live[0]]) - at, max(64, CUT // len(live)))
            block = np.zeros((len(live), width), np.uint8)
            for row, i in enumerate(live):
                part = texts[i][at : at + width]
                block[row, : len(part)] = np.frombuffer(part, np.uint8)
            for column in range(width):
                live = live[: int(np.searchsorted(-lengths[live], -(at + column), "left"))]  # the longer ones
                if not len(live):
                    break
                before, byte = alive[live], block[: len(live), column]
                moved = before << np.uint64(1)
                moved[:, 1:] |= before[:, :-1] >> np.uint64(63)
                moved &= self.open
                if at + column == 0:
                    moved |= self.first
                after = (moved & self.step[byte]) | (before & self.stay[byte])
                alive[live] = after
            at += width
            live = live[lengths[live] > at]
            live = live[(alive[live] & ~self.sure).any(1)]  # the rest can't change any more
        bits = np.array(self.ends)
        return (alive[:, bits // 64] >> (bits % 64).astype(np.uint64)) & np.uint64(1) == 1


def rule_glob(rule: str) -> bytes:
    """Host and subdomains, then a path prefix, over ``.host`` + path.

    >>> rule_glob("org/fr/")
    b'.*.org/fr/**'
    """
    return b".*." + rule.encode() + b"**"


def filter_urls(
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    default: str = "allow",
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row; the longest fitting rule decides.

    Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case.
    Path: from there up to ``?``, ``#`` or the end. A URL that is null or lacks ``://`` has neither
    and gets the default. Of equally long rules the smaller one by code point decides. Rows are
    judged one by one, so repeated rows and empty tables need no care; other columns are ignored. Very long URLs are
    read to their end.
    Globs are anchored twice, once for the host itself and once for its subdomains.
    """
    for rule, _ in rules:
        if "/" not in rule or "*" in rule:
            raise ValueError(f"a rule is a host and a path prefix: {rule}")
    ranked = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    rest = F.expr("case when locate('://', url) > 0 then substring(url, locate('://', url) + 3) else '' end")
    split = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url")).select(
        "id", F.coalesce(rest, F.lit("")).alias("rest")
    )
    host = F.translate(
        F.regexp_extract("rest", r"\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    parts = split.select("id", host.alias("host"), F.regexp_extract("rest", r"\A[^/?#]*([^?#]*)", 1).alias("path"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        globs = [g for rule, _ in ranked for g in (b"." + rule.encode() + b"**", rule_glob(rule))]
        automaton = Automaton(globs) if globs else None
        names = np.array([rule for rule, _ in ranked] + [None], object)
        verdicts = np.array([verdict for _, verdict in ranked] + [default], object)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            best = np.full(len(hosts), len(ranked))
            if automaton and hosts:
                fits = automaton.run([f".{h}{p}".encode() if h else b"" for h, p in zip(hosts, paths, strict=True)])
                fits = fits[:, ::2] | fits[:, 1::2]
                best = np.where(fits.any(1), fits.argmax(1), len(ranked))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(verdicts[best], pa.string())],
                ["id", "host", "path", "rule", "verdict"],
            )

    judged = map_batches(parts, work, "id long, host string, path string, rule string, verdict string", rows=4096)
    return judged.withColumnRenamed("id", id_column)
