"""Typed access to an element's content: of its six alternatives one is set, that of its kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import KINDS


def typed(kind: Column, content: dict[str, Column]) -> list[Column]:
    """A column for each kind: its content where the element is of that kind, else null. Kinds without content are left out."""
    return [F.when(kind == k, content[k]).alias(k) for k in KINDS if k in content]


def stored(kind: Column, content: dict[str, Column]) -> Column:
    """What is in the columns of typed(), as one struct, with nulls for all but the element's own."""
    return F.struct(*typed(kind, content))


def accessor(content: Column, kind: str) -> Column:
    """The content as one of a kind, or null if it is another's."""
    return content[kind]
