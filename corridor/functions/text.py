"""Text classification and labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from corridor.constants import BRIDGE_PATTERNS, STATUS_CODES


def first_match(text: Column, patterns=BRIDGE_PATTERNS, missing: int = -1) -> Column:
    """Number of the first pattern that occurs in ``text``."""
    picked = None
    for part, number in patterns:
        hit = text.contains(part)
        picked = F.when(hit, number) if picked is None else picked.when(hit, number)
    return picked.otherwise(missing)


def label(key: Column, names: dict) -> Column:
    """Look a key up in a constant map; null when it is not there."""
    pairs = F.create_map(*[F.lit(x) for x in chain(*names.items())])
    return F.try_element_at(pairs, key)


def status_code(status: Column) -> Column:
    """Traffic status text to its code, 0 for any other text."""
    return F.coalesce(label(status, STATUS_CODES), F.lit(0))


def city_rank(city: Column, order: list[str]) -> Column:
    """Position of a city in the report order, for sorting."""
    return F.array_position(F.array(*[F.lit(c) for c in order]), city)
