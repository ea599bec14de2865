"""Sequence functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def substituted(seq: Column, old: str, new: str) -> Column:
    return F.translate(seq, old, new)


def bases(text: Column) -> Column:
    """The text's letters A, C, G and T, in upper case."""
    return F.regexp_replace(F.upper(text), "[^ACGT]+", "")


def hamming(a: Column, b: Column) -> Column:
    """Differing places; null for unequal lengths."""
    return F.when(F.length(a) == F.length(b), F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d)))
