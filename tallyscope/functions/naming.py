"""Column names: normalisation (metadata, so plain Python) and keyword predicates (expressions)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_name(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def has_word(name: Column, words: Iterable[str]) -> Column:
    """True where the normalised name contains any of the words."""
    return name.rlike("|".join(words))


def first_column_with(columns: Iterable[str], words: Iterable[str]) -> str | None:
    """First column, in schema order, whose normalised name contains any of the words."""
    words = tuple(words)
    return next((c for c in columns if any(w in normalise_name(c) for w in words)), None)


def looks_like_identifier(
    name: Column, unique_ratio: Column, row_count: Column, exact_names, parts, business_words
) -> Column:
    no_business_word = ~has_word(name, business_words)
    return (
        name.isin(*exact_names)
        | name.endswith("_id")
        | (has_word(name, parts) & no_business_word)
        | ((row_count >= 20) & (unique_ratio >= 0.98) & no_business_word)
    )


def quoted(name: str) -> Column:
    """A column by its literal name, also when the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")
