"""Conversations and instructions as nested columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from curascore.functions.hashing import col_of
from curascore.functions.text import answer_text, display_text, escape_output, fill_template
from curascore.settings import (
    CHOICE_INSTRUCTION,
    CHOICE_KEYS,
    CONTEXT_INSTRUCTION,
    DISEASED_TEMPLATES,
    HEALTHY_TEMPLATES,
    PURE_INSTRUCTION,
    QUESTION,
    TRAIN_SYSTEM,
)


def _part(kind: str, text: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), (text if text is not None else F.lit(None).cast("string")).alias("text"))


def _message(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))


def _ask() -> Column:
    return _message("user", _part("text", F.lit(QUESTION)), _part("image"))


def training_conversation(crop: Column | str = "crop", disease: Column | str = "disease") -> Column:
    """System, user and assistant messages; the assistant gives the answer text."""
    return F.array(
        _message("system", _part("text", F.lit(TRAIN_SYSTEM))),
        _ask(),
        _message("assistant", _part("text", answer_text(crop, disease))),
    )


def label_list_text(labels: Sequence[str]) -> str:
    return "[" + ", ".join(repr(x) for x in labels) + "]"


def options_text(options: Column | str, keys: Sequence[str] = CHOICE_KEYS) -> Column:
    """The options as shown in the instruction: ``{'A': 'label', ...}``."""
    m = col_of(options)
    shown = [F.concat(F.lit(f"'{k}': "), escape_output(F.try_element_at(m, F.lit(k)))) for k in keys]
    return F.concat(F.lit("{"), F.array_join(F.array(*shown), ", "), F.lit("}"))


def instruction(regime: Column | str, labels: Sequence[str], options: Column | None = None) -> Column:
    """System text by regime: ``context`` lists the labels, ``mcq`` the options, anything else asks openly."""
    r = F.lit(regime) if isinstance(regime, str) else regime
    out = F.when(r == "context", F.lit(CONTEXT_INSTRUCTION.replace("{labels}", label_list_text(labels))))
    if options is not None:
        out = out.when(r == "mcq", fill_template(CHOICE_INSTRUCTION, options=options_text(options)))
    return out.otherwise(F.lit(PURE_INSTRUCTION))


def eval_conversation(system_text: Column) -> Column:
    return F.array(_message("system", _part("text", system_text)), _ask())


def class_prompts(crop: Column | str = "crop", disease: Column | str = "disease") -> Column:
    """Three prompts per class, worded by whether the class is a healthy one."""
    crop_text, disease_text = display_text(crop), display_text(disease)
    healthy = F.array(*[fill_template(t, crop=crop_text) for t in HEALTHY_TEMPLATES])
    diseased = F.array(*[fill_template(t, crop=crop_text, disease=disease_text) for t in DISEASED_TEMPLATES])
    return F.when(F.lower(disease_text) == "healthy", healthy).otherwise(diseased)
