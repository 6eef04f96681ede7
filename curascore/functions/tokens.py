"""Token-id arrays and training masks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from curascore.functions.hashing import col_of
from curascore.functions.lets import let
from curascore.settings import IGNORE_ID, MAX_TRAIN_LENGTH


def _first_start(v: Column, anchor: Sequence[int]) -> Column:
    n = len(anchor)

    def here(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.get(v, i + k) == a for k, a in enumerate(anchor)])

    starts = F.when(F.size(v) >= n, F.sequence(F.lit(0), F.size(v) - n))
    return F.get(F.filter(starts, here), F.lit(0))


def anchor_position(ids: Column | str, anchor: Sequence[int]) -> Column:
    """0-based index at which the anchor first occurs; null when it does not."""
    return let(col_of(ids), lambda v: _first_start(v, anchor))


def mask_before_anchor(ids: Column | str, anchor: Sequence[int], ignore: int = IGNORE_ID) -> Column:
    """Ids before the anchor become ``ignore``; null (a reject) when the anchor is missing."""
    return let(
        col_of(ids),
        lambda v: let(
            _first_start(v, anchor),
            lambda start: F.when(
                start.isNotNull(), F.transform(v, lambda x, i: F.when(i < start, F.lit(ignore)).otherwise(x))
            ),
        ),
    )


def mask_tokens(ids: Column | str, specials: Sequence[int], ignore: int = IGNORE_ID) -> Column:
    """Padding and image ids become ``ignore``."""
    return F.transform(col_of(ids), lambda x: F.when(x.isin(*specials), F.lit(ignore)).otherwise(x))


def truncate_sequence(ids: Column | str, n: int = MAX_TRAIN_LENGTH) -> Column:
    return F.slice(col_of(ids), 1, n)


def pad_to(ids: Column | str, length: Column, pad: int = 0, side: str = "left") -> Column:
    v = col_of(ids)
    filler = F.array_repeat(F.lit(pad), F.greatest(length - F.size(v), F.lit(0)))
    return F.concat(filler, v) if side == "left" else F.concat(v, filler)


def strip_prompt(ids: Column | str, prompt_length: Column | int) -> Column:
    """Ids after the first ``prompt_length``."""
    v = col_of(ids)
    n = F.lit(prompt_length) if isinstance(prompt_length, int) else prompt_length
    return F.slice(v, n + 1, F.greatest(F.size(v) - n, F.lit(0)))
