"""Dialogues with a chat model: prompts as columns, replies through a backend."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import format_prompt, load_prompts, message
from ..functions.skew import attach

Values = Mapping[str, Column]


class ChatBackend(Protocol):
    """Anything picklable that answers a list of ``{role, content}`` messages."""

    def reply(self, dialogue: list[dict]) -> str: ...


def annotator_dialogue(values: Values) -> Column:
    """System, context, the three summaries, instruction."""
    p = load_prompts("omics_annotator")
    return F.array(
        message("system", format_prompt(p["system"], values)),
        message("human", format_prompt(p["user_context"], values)),
        message("human", format_prompt(p["user_input"], values)),
        message("human", format_prompt(p["user_instruction"], values)),
    )


def aggregate_dialogue(values: Values) -> Column:
    """System, context, number and text of the joined replies, instruction."""
    p = load_prompts("omics_annotator_aggregate")
    return F.array(
        message("system", format_prompt(p["system"], values)),
        message("human", format_prompt(p["context"], values)),
        message("human", format_prompt(p["input"], values)),
        message("human", format_prompt(p["instruction"], values)),
    )


def pathology_dialogue(values: Values) -> Column:
    """System, the annotator's prompt and reply, diagnosis with instruction."""
    p = load_prompts("pathology_scorer")
    question = F.concat(
        format_prompt(p["user_final_input"], values), format_prompt(p["user_instruction"], values)
    )
    return F.array(
        message("system", format_prompt(p["system"], values)),
        message("human", values["user_input"]),
        message("ai", values["ai_output"]),
        message("human", question),
    )


def curator_openings(values: Values) -> tuple[Column, Column]:
    """The curator's first two messages, and the question that follows the first reply."""
    p = load_prompts("context_curator")
    opening = F.array(
        message("system", format_prompt(p["system"], values)),
        message("human", format_prompt(p["user_structures"], values)),
    )
    return opening, message("human", format_prompt(p["user_biomarkers"], values))


def ask(
    dialogues: DataFrame,
    backend: ChatBackend,
    concurrency: int = 16,
    min_interval: float = 0.0,
) -> DataFrame:
    """Append the model's reply to the ``dialogue`` of every row.

    ``concurrency`` sets how many tasks call the service, ``min_interval`` the
    seconds between two calls of a task, not of all of them. Equal dialogues are asked once
    per run of a task; a task that is run again asks again. Write the result out and resume with
    :func:`not_done` rather than rerun.
    """
    if backend is None:
        raise ValueError("a chat backend is needed to ask")
    keyed = dialogues.withColumn("_ask", F.sha2(F.to_json(F.struct("dialogue")), 256))
    distinct = keyed.groupBy("_ask").agg(F.any_value("dialogue").alias("dialogue"))
    distinct = distinct.repartition(concurrency, "_ask")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for batch in batches:
            replies = []
            for dialogue in batch["dialogue"]:
                wait = min_interval - (time.monotonic() - last)
                if min_interval and wait > 0:
                    time.sleep(wait)
                last = time.monotonic()
                replies.append(backend.reply([_plain(m) for m in dialogue]))
            yield pd.DataFrame({"_ask": batch["_ask"], "reply": replies})

    answers = distinct.mapInPandas(call, "_ask string, reply string")
    spread = [c for c in dialogues.columns if c != "dialogue"]
    joined = attach(keyed, answers, ["_ask"], spread).drop("_ask")
    return joined.withColumn("dialogue", F.concat("dialogue", F.array(message("ai", F.col("reply")))))


def _plain(m) -> dict:
    return {"role": m["role"], "content": m["content"]}


def not_done(todo: DataFrame, done: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Rows without a stored result, for resuming a stage."""
    return todo if done is None else todo.join(done.select(*keys), list(keys), "left_anti")


def curate_context(
    studies: DataFrame, values: Values, backend: ChatBackend,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Two questions per study; the second is asked with the first reply in view.

    ``keep`` stores the replies between the two calls, see
    :func:`cytogrid.session.cut_lineage`.
    """
    opening, follow = curator_openings(values)
    first = ask(studies.withColumn("_next", follow).withColumn("dialogue", opening), backend)
    if keep is not None:
        first = keep(first)
    again = first.drop("reply").withColumn("dialogue", F.concat("dialogue", F.array("_next")))
    return ask(again.drop("_next"), backend)


def aggregate_texts(
    texts: DataFrame, keys: Sequence[str], text: str, order: str, per_prompt: int = 200,
    weight: str | None = None,
) -> DataFrame:
    """Texts of each group joined by a ``===`` line, with their number (or the sum of ``weight``).

    Groups above ``per_prompt`` texts become several parts of about that size, by
    the order column modulo the number of parts: no value grows without limit, and
    every text is in exactly one part. ``n_parts`` tells whether a group is whole.
    """
    sizes = texts.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(float(per_prompt))).cast("long").alias("n_parts")
    )
    placed = attach(texts, sizes, keys, [order]).withColumn(
        "part", F.pmod(F.col(order).cast("long"), F.col("n_parts"))
    )
    entry = F.struct(F.col(order).alias("o"), F.col(text).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["t"])
    return placed.groupBy(*keys, "part", "n_parts").agg(
        F.sum(F.col(weight) if weight else F.lit(1)).cast("long").alias("n_obs"), F.array_join(ordered, "\n===\n").alias("results")
    )
