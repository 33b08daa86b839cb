"""Scalar column functions on record titles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The separators of title fields, as a regular-expression class.
SEPARATORS = r" ._,=:/\-#\x00"
_TOKEN = rf"([^{SEPARATORS}]*)([{SEPARATORS}]|$)"


def tokens(tag: Column) -> Column:
    """Fields with their trailing separator, in order."""
    all_ = F.regexp_extract_all(tag, F.lit(_TOKEN), F.lit(0))
    # the pattern matches once more, emptily, at the end of a text that does not end in a separator
    return F.when(tag.rlike(rf"[{SEPARATORS}]$") | (F.length(tag) == 0), all_).otherwise(F.slice(all_, 1, F.size(all_) - 1))


def field_text(token: Column) -> Column:
    return F.regexp_replace(token, rf"[{SEPARATORS}]$", "")


def separator(token: Column) -> Column:
    return F.regexp_extract(token, rf"[{SEPARATORS}]$", 0)


def project(tag: Column, fields: Iterable[int]) -> Column:
    """The kept fields (1-based) with their separators."""
    keep = F.array(*[F.lit(int(f)) for f in sorted(set(fields))])
    return F.array_join(F.filter(tokens(tag), lambda x, i: F.array_contains(keep, i + 1)), "")


def number(text: Column) -> Column:
    """Value of a field of digits without a leading zero; null for any other text, the empty one included."""
    return F.when(text.rlike("^(0|[1-9][0-9]{0,17})$"), text.try_cast("long"))


def separators(tag: Column) -> Column:
    """The separators of a title in order: its template."""
    return F.regexp_extract_all(tag, F.lit(rf"([{SEPARATORS}])"), F.lit(1))


def by_template(tag: Column, template: Column) -> Column:
    """Fields of a title cut at the separators of a template, each at its first place behind the one before; null if one is missing.

    A field may hold other separators; the last field is all of the rest.
    """
    start = F.struct(tag.alias("rest"), F.array().cast("array<string>").alias("out"))

    def step(acc, sep):
        at = F.instr(acc["rest"], sep)
        field = F.array(F.substring(acc["rest"], F.lit(1), at - 1))
        return F.when(at > 0, F.struct(F.substr(acc["rest"], at + 1).alias("rest"), F.concat(acc["out"], field).alias("out")))

    return F.aggregate(template, start, step, lambda acc: F.concat(acc["out"], F.array(acc["rest"])))
