"""Prompt templates and their expansion into message columns."""

from __future__ import annotations

import re
from collections.abc import Mapping
from importlib import resources

import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def load_prompts(agent: str) -> dict[str, dict]:
    """Sections of an agent's prompt file: ``variables`` and ``template`` each."""
    text = resources.files("cytogrid").joinpath("prompts", f"{agent}.yaml").read_text("utf-8")
    sections = yaml.safe_load(text)
    for name, section in sections.items():
        used = set(_PLACEHOLDER.findall(section["template"]))
        if used != set(section["variables"]):
            raise ValueError(f"{agent}.{name} declares {section['variables']} but uses {used}")
    return sections


def format_prompt(section: Mapping, values: Mapping[str, Column]) -> Column:
    """The template with its variables filled in.

    Text and columns are joined piece by piece, so braces inside a value are never
    expanded again. A variable without a column raises here, a NULL in a row when
    the job runs.
    """
    missing = set(section["variables"]) - set(values)
    if missing:
        raise KeyError(f"no value for {sorted(missing)}")
    pieces = []
    for i, part in enumerate(_PLACEHOLDER.split(section["template"])):
        if i % 2:
            value = values[part].cast("string")
            error = F.raise_error(F.lit(f"prompt variable {part} is NULL")).cast("string")
            pieces.append(F.when(value.isNotNull(), value).otherwise(error))
        elif part:
            pieces.append(F.lit(part))
    return F.concat(*pieces)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def transcript(dialogue: Column) -> Column:
    """A dialogue as one text, a line of dashes before every message."""
    texts = F.transform(dialogue, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"]))
    return F.concat(F.lit("---\n"), F.array_join(texts, "\n---\n"))
