"""Parsing of model replies into structure labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A continuation line is shorter than this and does not name evidence.
CONTINUATION_LENGTH = 50
# Ordered keyword rules; all words of one alternative must occur.
LABEL_RULES = (
    ("Glomeruli", (("glomerul",), ("peritubular capillar",))),
    ("Blood vessel", (("vasculature",), ("blood vessel",))),
    ("Distal tubules", (("distal", "tub"),)),
    ("Proximal tubules", (("prox", "tub"), ("tubul",))),
    ("Interstitium", (("interstiti",), ("basement membrane",), ("inflammatory",), ("immune",))),
)
# The classes of the confusion matrix, in order.
CLASSES = ("Proximal tubules", "Distal tubules", "Glomeruli", "Blood vessel", "Interstitium")
NO_LABEL = "NA"


def parse_response(reply: Column) -> Column:
    """Guesses of a reply: its first ``1.`` and first ``2.`` line with what follows.

    Short lines among the two after a numbered line belong to the guess. Without
    any numbered line the first line and short ones among the next four count.
    """
    lines = F.split(reply, "\n")

    def guess(at: Column, reach: int) -> Column:
        follow = F.filter(
            F.slice(lines, at + 1, reach),
            lambda line: (F.length(line) < CONTINUATION_LENGTH)
            & ~F.contains(F.lower(line), F.lit("evidence")),
        )
        return F.array_join(F.concat(F.slice(lines, at, 1), follow), "\n")

    def first(mark: str) -> Column:
        marked = F.transform(lines, lambda line: F.startswith(line, F.lit(mark)))
        return F.array_position(marked, F.lit(True)).cast("int")

    one, two = first("1."), first("2.")
    return (
        F.when((one == 0) & (two == 0), F.array(guess(F.lit(1), 4)))
        .when(two == 0, F.array(guess(one, 2)))
        .when(one == 0, F.array(guess(two, 2)))
        .when(one < two, F.array(guess(one, 2), guess(two, 2)))
        .otherwise(F.array(guess(two, 2), guess(one, 2)))
    )


def parse_guess(guess: Column) -> Column:
    """Items of a guess between asterisks, 6 to 99 characters long."""
    text = F.replace(guess, F.lit("\n"), F.lit(" "))
    for mark in ("1.", "2.", ":"):
        text = F.replace(text, F.lit(mark), F.lit(""))
    items = F.transform(F.split(text, r"\*"), lambda i: F.regexp_replace(i, r"^\s+|\s+$", ""))
    return F.filter(items, lambda i: (F.length(i) > 5) & (F.length(i) < 100))


def guess_to_label(item: Column) -> Column:
    """First rule that matches, case-insensitive; ``NA`` if none does."""
    text = F.lower(item)
    label = None
    for name, alternatives in LABEL_RULES:
        hit = F.lit(False)
        for words in alternatives:
            every = F.lit(True)
            for word in words:
                every = every & F.contains(text, F.lit(word))
            hit = hit | every
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise(NO_LABEL)


def predicted_labels(reply: Column) -> Column:
    """Labels of all guesses in order, without the unknown ones."""
    items = F.flatten(F.transform(parse_response(reply), parse_guess))
    return F.filter(F.transform(items, guess_to_label), lambda label: label != NO_LABEL)


# Scores go from 0 to 100; a score ends its line behind a comma, or follows its own name.
SCORE_LINE = r",\s*\[?(?:relevance score:?\s*)?(\d{1,3})(?:\s*/\s*100)?\]?\.?\s*$"
SCORE_NAMED = r"score\D{0,20}(\d{1,3})"
SCORE_RANGE = r"\(?0\s*(?:-|to)\s*100\)?"


def relevance_score(reply: Column) -> Column:
    """The relevance score a scorer's reply gives, 0 to 100; NULL if there is none.

    It stands at the end of the line with the phenotype, before the numbered evidence; where no such line is
    found, behind the word "score". Emphasis by asterisks and the range 0-100 are ignored.
    """
    plain = F.regexp_replace(F.replace(F.lower(reply), F.lit("*"), F.lit("")), SCORE_RANGE, "")
    lines = F.split(plain, "\n")
    evidence = F.transform(lines, lambda line: F.rlike(line, F.lit(r"^\s*1\.")))
    ahead = F.array_position(evidence, F.lit(True)).cast("int") - 1
    head = F.when(ahead >= 0, F.slice(lines, 1, ahead)).otherwise(lines)
    found = F.transform(head, lambda line: F.regexp_extract(line, SCORE_LINE, 1))
    at_end = F.get(F.filter(found, lambda score: score != ""), F.lit(0))
    named = F.nullif(F.regexp_extract(F.array_join(lines, "\n"), SCORE_NAMED, 1), F.lit(""))
    score = F.coalesce(at_end, named).cast("int")
    return F.when(score <= 100, score)
