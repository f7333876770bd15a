"""What a rule set must satisfy: a table of independent invariants.

Each invariant is a generator over one subject (a rule set, a rule, a field within its rule, or a
mask) that yields one sentence per violation. `problems` runs them all; none depends on another's
outcome, and what cannot be decided because a pattern does not compile is left to the
invariant about patterns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from ..functions import timefmt
from ..functions.regex import Pattern, PatternError, translate
from ..sources.settings import SettingsError, resolve_compression, resolve_row_group

#: Rule names become file names.
_FILE_NAME = re.compile(r"(?!\.)[^/\\\x00-\x1f\x7f-\x9f]+\Z")

_TABLE: dict[str, list[Callable]] = {"set": [], "rule": [], "field": [], "mask": []}


def _about(subject: str):
    def add(f):
        _TABLE[subject].append(f)
        return f

    return add


def _compiled(text: str) -> Pattern | None:
    try:
        return translate(text)
    except PatternError:
        return None


def _origins(f) -> list[str]:
    """What a field takes its value from, besides the group of its name."""
    return [word for word, on in (("key", f.key), ("extra", f.extra), ("meta", f.meta)) if on]


def _has_payload(rule) -> bool:
    return bool(rule.payload or rule.source)


def _options(names) -> str:
    return ", ".join(sorted(names))


# ---- patterns, wherever they are written ---------------------------------------------------


@_about("set")
def patterns_compile(rules) -> Iterator[str]:
    written = [(f'mask[{i}]', m.pattern) for i, m in enumerate(rules.masks)]
    for r in rules.rules:
        written += [(f'rule "{r.name}": pattern', r.pattern)]
        written += [(f'rule "{r.name}": continuation', r.continuation)] if r.continuation else []
        written += [(f'rule "{r.name}": field "{f.name}"', text) for f in r.fields for text, _ in f.replace + f.normalize]
    for where, text in written:
        try:
            translate(text)
        except PatternError as e:
            yield f"{where}: {e}"


# ---- output tables -------------------------------------------------------------------------


@_about("rule")
def name_is_a_file_name(r) -> Iterator[str]:
    if not _FILE_NAME.match(r.name):
        yield "the name cannot be a file name: letters, digits and other visible characters, no slash or backslash, no dot in front"


@_about("set")
def one_name_one_schema(rules) -> Iterator[str]:
    shapes: dict[str, list] = {}
    for r in rules.rules:
        shape = [(f.name, f.type) for f in r.fields]
        if shapes.setdefault(r.name, shape) != shape:
            yield f'rule "{r.name}": another rule of this name has other columns; names, types and order must agree'


@_about("field")
def type_is_known(r, f) -> Iterator[str]:
    from .rules import TYPES

    if f.type not in TYPES:
        yield f'type "{f.type}" is none of {_options(TYPES)}'


@_about("field")
def timestamps_name_a_notation(r, f) -> Iterator[str]:
    if f.type != "timestamp":
        return
    try:
        if not f.format:
            yield "a timestamp needs a format"
        else:
            timefmt.resolve(f.format)
    except timefmt.FormatError as e:
        yield str(e)


# ---- where values come from ----------------------------------------------------------------


@_about("rule")
def preset_or_own_definition(r) -> Iterator[str]:
    from .rules import PRESETS, preset_fields

    if r.preset and r.preset not in PRESETS:
        yield f'there is no preset "{r.preset}" (known: {_options(PRESETS)})'
    elif r.preset and (r.pattern, r.fields) != (PRESETS[r.preset][0], preset_fields(r.preset)):
        yield "pattern and fields cannot be given beside a preset"


@_about("field")
def value_has_one_origin(r, f) -> Iterator[str]:
    from .rules import PRESETS

    found = _origins(f)
    p = _compiled(r.pattern)
    if len(found) > 1:
        yield f"takes its value from {' and '.join(found)} at once"
    if not found and p and f.name not in p.named and not (r.preset and r.preset not in PRESETS):
        yield "the pattern has no group of this name"


@_about("field")
def lineage_is_known_and_typed(r, f) -> Iterator[str]:
    from .rules import META

    if f.meta and f.meta not in META:
        yield f'meta "{f.meta}" is none of {_options(META)}'
    elif f.meta and f.type != META[f.meta]:
        yield f"meta {f.meta} gives a value of type {META[f.meta]}"


@_about("rule")
def one_remainder(r) -> Iterator[str]:
    takers = [f.name for f in r.fields if f.extra]
    if len(takers) > 1:
        yield f"the remainder of a payload can go to one field only, not to {_options(takers)}"


# ---- payloads ------------------------------------------------------------------------------


@_about("rule")
def payload_is_read_and_used(r) -> Iterator[str]:
    from .rules import PAYLOADS, PRESETS

    reads = any(f.key or f.extra for f in r.fields)
    if not _has_payload(r):
        if reads:
            yield "key and extra need a structured section"
        return
    p = _compiled(r.pattern)
    if r.payload not in (*PAYLOADS, *PRESETS):
        yield f'structured format "{r.payload}" is none of {_options((*PAYLOADS, *PRESETS))}'
    if p and r.source not in p.named:
        yield f'structured source "{r.source}" is no group of the pattern'
    if not reads:
        yield "the structured section feeds no field: none has key or extra"


# ---- entries of several lines --------------------------------------------------------------


@_about("rule")
def later_lines_feed_captured_fields(r) -> Iterator[str]:
    p = _compiled(r.continuation) if r.continuation else None
    feeds = {f.name: _origins(f) for f in r.fields}
    for g in p.named if p else ():
        if feeds.get(g, ["missing"]):
            yield f'continuation group "{g}" must be a field that is read from the pattern'


# ---- masks and settings --------------------------------------------------------------------


@_about("mask")
def mask_is_known(m) -> Iterator[str]:
    for what, value, known in (("type", m.type, ("key", "pattern")), ("action", m.action, ("redact", "hash"))):
        if value not in known:
            yield f'{what} "{value}" is neither {known[0]} nor {known[1]}'


@_about("mask")
def hashes_have_a_length(m) -> Iterator[str]:
    if m.action == "hash" and m.length not in range(1, 65):
        yield f"a hash keeps 1 to 64 characters, not {m.length}"


@_about("set")
def settings_resolve(rules) -> Iterator[str]:
    for name, check in (("compression", resolve_compression), ("row_group", resolve_row_group)):
        try:
            check({}, getattr(rules, name))
        except SettingsError as e:
            yield f"{name}: {e}"


def problems(rules) -> list[str]:
    """Every violation of a rule set, one sentence each."""
    out = [text for check in _TABLE["set"] for text in check(rules)]
    for r in rules.rules:
        out += [f'rule "{r.name}": {text}' for check in _TABLE["rule"] for text in check(r)]
        out += [f'rule "{r.name}": field "{f.name}": {text}' for f in r.fields for check in _TABLE["field"] for text in check(r, f)]
    out += [f"mask[{i}]: {text}" for i, m in enumerate(rules.masks) for check in _TABLE["mask"] for text in check(m)]
    return out
