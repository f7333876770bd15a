"""Scalar building blocks of rules as Columns: casts, replace, normalize, masks."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import Pattern, java_template, replace_all


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Separates the groups of a rewritten text; a text that holds it is read group by group.
SEPARATOR = "\u0001"


def captures(text: Column, p: Pattern) -> Column:
    """Array of "" and the named groups of the first match; one element or null without a match.

    One pass of the expression: the whole text is rewritten to its groups, then split.
    """
    groups = list(p.named.values())
    whole = rf"\A(?s:.*?)(?:{p.java})(?s:.*)\z"
    rewritten = F.regexp_replace(text, whole, SEPARATOR + SEPARATOR.join(f"${i}" for i in groups))
    slow = F.when(text.rlike(p.java), F.array(F.lit(""), *[F.regexp_extract(text, p.java, i) for i in groups] or [F.lit("")]))
    return F.when(text.contains(SEPARATOR), slow).otherwise(F.split(rewritten, SEPARATOR, -1))


def matched(groups: Column) -> Column:
    return F.size(groups) > 1


def cast_int(c: Column) -> Column:
    return F.when(c.rlike(r"\A[+-]?[0-9]+\z"), c.try_cast("bigint"))


def cast_float(c: Column) -> Column:
    plain = c.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z")
    value = c.try_cast("double")
    plain = plain | c.rlike(r"\A[+-]?0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+\z")
    finite = F.when(plain & (F.abs(value) < float("inf")), value)
    low = F.lower(c)
    word = (
        F.when(low.rlike(r"\A\+?inf(?:inity)?\z"), F.lit(float("inf")))
        .when(low.rlike(r"\A-inf(?:inity)?\z"), F.lit(float("-inf")))
        .when(low.rlike(r"\A[+-]?nan\z"), F.lit(float("nan")))
    )
    return F.coalesce(finite, word)


def replace(c: Column, p: Pattern, template: str) -> Column:
    if not p.may_be_empty:
        return F.regexp_replace(c, p.java, java_template(p, template))

    # abutting empty matches are counted differently by the JVM
    @F.pandas_udf("string")
    def slow(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else replace_all(p, template, x))

    return slow(c)


def normalize(c: Column, rules: list[tuple[Pattern, str]]) -> Column:
    """The value of the first pattern found anywhere takes the place of the whole."""
    out = None
    for p, value in rules:
        out = (F if out is None else out).when(c.rlike(p.java), F.lit(value))
    return c if out is None else out.otherwise(c)


_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_string(c: Column) -> Column:
    """A JSON string as payload.dumps writes it."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for x in [*map(chr, range(32)), *"<>&\u2028\u2029"]:
        out = F.replace(out, F.lit(x), F.lit(_SHORT.get(x, f"\\u{ord(x):04x}")))
    return F.concat(F.lit('"'), F.when(c.rlike(r'[\x00-\x1f"\\<>&\x{2028}\x{2029}]'), out).otherwise(c), F.lit('"'))


def json_object(members: Column) -> Column:
    """A JSON object of an array of struct<k, v> of strings."""
    return F.concat(F.lit("{"), F.array_join(F.transform(members, lambda m: F.concat(json_string(m["k"]), F.lit(":"), json_string(m["v"]))), ","), F.lit("}"))


def short_hash(c: Column, length: int) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, length)


def mask_hash(c: Column, p: Pattern, length: int) -> Column:
    """Every match replaced by its own truncated SHA-256."""
    if p.may_be_empty:

        @F.pandas_udf("string")
        def slow(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else mask_value(x, p, "hash", "", length))

        return slow(c)
    between = F.split(c, p.java, -1)
    hashed = F.transform(F.regexp_extract_all(c, F.lit(p.java), F.lit(0)), lambda m: short_hash(m, length))
    woven = F.zip_with(between, hashed, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(c.rlike(p.java), F.array_join(woven, "")).otherwise(c)


def mask(c: Column, p: Pattern, action: str, value: str, length: int) -> Column:
    return mask_hash(c, p, length) if action == "hash" else replace(c, p, value)


def mask_value(x: str, p: Pattern, action: str, value: str, length: int) -> str:
    if action != "hash":
        return replace_all(p, value, x)
    out, at, last = [], 0, -1
    for m in p.compiled.finditer(x):
        if m.start() == m.end() == last:
            continue
        out += [x[at : m.start()], hashlib.sha256(m[0].encode()).hexdigest()[:length]]
        at = last = m.end()
    return "".join(out) + x[at:]
