"""Rewriting rule files: expanding presets to their patterns and collapsing them again.

Files are edited by line ranges taken from node positions, so everything outside the rewritten
lines, comments included, stays as it is; no change leaves the bytes as they were.
"""

from __future__ import annotations

import re
from re import _parser

import yaml

from ..functions.regex import translate
from ..sources.settings import ALIASES, CODECS
from .rules import PRESETS, parse_rules, preset_fields

SCAFFOLD = """\
# A worker log such as
#   17 2024-05-01T10:00:00Z WARN slow job {"job":"resize","ms":412,"user":"ann"}
# Columns keep the order of `fields`; lines that fit no rule go to unmatched.txt.
rules:
  - name: jobs
    pattern: '^(?P<worker>\\d+) (?P<at>\\S+) (?P<level>[A-Z]+) (?P<note>[^{]*) (?P<data>\\{.*\\})$'
    structured: {source: data, format: json}
    fields:
      at: {type: timestamp, format: rfc3339}
      worker: int
      level:
        type: string
        normalize:
          - {pattern: '^WARN', value: warning}
      note: string
      ms: {type: int, key: ms}
      rest: {type: string, extra: true}
  - name: web
    preset: apache_combined
mask:
  - {type: key, pattern: '^user$', action: hash, length: 12}
compression: {codec: zstd, level: normal}
"""


def _rules(root) -> list:
    if root is None:
        return []
    for k, v in root.value:
        # a sequence that begins before its key is an alias
        if k.value == "rules" and isinstance(v, yaml.SequenceNode) and v.start_mark.index > k.start_mark.index:
            return v.value
    return []


def _entries(node) -> dict:
    return {k.value: (k, v) for k, v in node.value} if isinstance(node, yaml.MappingNode) else {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _field_lines(fields, pad: str) -> list[str]:
    out = []
    for f in fields:
        if f.format:
            out += [f"{pad}  {f.name}:", f"{pad}    type: {f.type}", f"{pad}    format: {f.format}"]
        else:
            out.append(f"{pad}  {f.name}: {f.type}")
    return out


def _edit(text: str, edits: list[tuple[int, int, list[str]]]) -> str:
    lines = text.split("\n")
    for a, b, new in sorted(edits, reverse=True):
        lines[a:b] = new
    return "\n".join(lines)


def _tail_comment(line: str, end: int) -> str:
    rest = line[end:].strip()
    return f"  {rest}" if rest.startswith("#") else ""


def expand(text: str) -> tuple[str, int]:
    """The text with every preset written out, and how many there were."""
    parse_rules(text)
    edits = []
    lines = text.split("\n")
    for node in _rules(yaml.compose(text)):
        e = _entries(node)
        if "preset" not in e:
            continue
        k, v = e["preset"]
        pad = " " * k.start_mark.column
        lead = lines[k.start_mark.line][: k.start_mark.column]
        new = [f"{lead}pattern: {_quoted(PRESETS[v.value][0])}{_tail_comment(lines[v.end_mark.line], v.end_mark.column)}", f"{pad}fields:"]
        edits.append((k.start_mark.line, v.end_mark.line + 1, new + _field_lines(preset_fields(v.value), pad)))
    if not edits:
        return text, 0
    out = _edit(text, edits)
    parse_rules(out)
    return out, len(edits)


def _last_line(node) -> int:
    """First line after a node's own content."""
    if isinstance(node, yaml.MappingNode) and node.value and not node.flow_style:
        return max(_last_line(v) for _, v in node.value)
    m = node.end_mark
    return m.line if m.column == 0 and m.line > node.start_mark.line else m.line + 1


_DIGIT, _WORD_RANGES = ((48, 57),), ((48, 57), (65, 90), (95, 95), (97, 122))
_SPACES = ((9, 10), (12, 13), (32, 32))


def _tree(node, names: dict):
    """A parsed pattern with character sets as sorted ranges and groups by name."""
    if isinstance(node, _parser.SubPattern):
        return tuple(_tree(x, names) for x in node)
    if isinstance(node, tuple) and len(node) == 2 and isinstance(node[0], int):
        op, av = str(node[0]), node[1]
        if op in ("LITERAL", "NOT_LITERAL"):
            return "SET", op == "NOT_LITERAL", ((av, av),)
        if op == "IN":
            ranges, negated = [], False
            for kind, v in ((str(k), v) for k, v in av):
                if kind == "NEGATE":
                    negated = True
                elif kind == "LITERAL":
                    ranges.append((v, v))
                elif kind == "RANGE":
                    ranges.append(tuple(v))
                elif str(v) in ("CATEGORY_DIGIT", "CATEGORY_WORD", "CATEGORY_SPACE"):
                    ranges += {"D": _DIGIT, "W": _WORD_RANGES, "S": _SPACES}[str(v)[9]]
                else:
                    return "IN", str(av)
            merged: list[list[int]] = []
            for a, b in sorted(ranges):
                if merged and a <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            return "SET", negated, tuple(map(tuple, merged))
        if op == "SUBPATTERN":
            return op, names.get(av[0], av[0] is not None), *map(str, av[1:3]), _tree(av[3], names)
        return op, _tree(av, names)
    if isinstance(node, (tuple, list)):
        return tuple(_tree(x, names) for x in node)
    return str(node)


def _same_pattern(a: str, b: str) -> bool:
    """Whether two patterns parse to the same tree, however their sets and escapes are written."""
    if a == b:
        return True

    def tree(text: str):
        p = _parser.parse(translate(text).python)
        return _tree(p, {i: n for n, i in p.state.groupdict.items()})

    try:
        return tree(a) == tree(b)
    except re.error:
        return translate(a).java == translate(b).java


def _shared_lines(text: str) -> set[int]:
    """Lines where a node begins that an alias refers to."""
    begun, used = {}, set()
    for t in yaml.parse(text):
        if isinstance(t, yaml.AliasEvent):
            used.add(t.anchor)
        elif getattr(t, "anchor", None):
            begun[t.anchor] = t.start_mark.line
    return {line for name, line in begun.items() if name in used}


def collapse(text: str) -> tuple[str, int]:
    """The inverse: rules equal to a preset name it instead.

    Rules that are aliases, take part of themselves from an alias or a merge key, or hold what an
    alias refers to stay as they are."""
    rules = parse_rules(text)
    shared = _shared_lines(text)
    edits, seen = [], set()
    lines = text.split("\n")
    for node, rule in zip(_rules(yaml.compose(text)), rules.rules):
        e = _entries(node)
        own = id(node) not in seen
        seen.add(id(node))
        if not own or "preset" in e or "<<" in e or "pattern" not in e or "fields" not in e:
            continue
        first, last = node.start_mark.line, _last_line(node)
        # the node's first line may carry its own anchor
        if any(first <= n < last for n in shared) or not all(first <= v.start_mark.line < last for _, v in e.values()):
            continue
        name = next((n for n in sorted(PRESETS) if _same_pattern(rule.pattern, PRESETS[n][0]) and rule.fields == preset_fields(n)), None)
        if name is None or node.flow_style:
            continue
        (pk, pv), (fk, fv) = e["pattern"], e["fields"]
        lead = lines[pk.start_mark.line][: pk.start_mark.column]
        tail = _tail_comment(lines[pv.end_mark.line], pv.end_mark.column) if pv.style in ("'", '"', None) else ""
        edits.append((pk.start_mark.line, _last_line(pv), [f"{lead}preset: {name}{tail}"]))
        kept = [x for x in lines[fk.start_mark.line : _last_line(fv)] if x.strip().startswith("#")]
        if lines[fk.start_mark.line][: fk.start_mark.column].strip():
            kept.append(lines[fk.start_mark.line][: fk.start_mark.column].rstrip())
        edits.append((fk.start_mark.line, _last_line(fv), kept))
    if not edits:
        return text, 0
    out = _edit(text, edits)
    parse_rules(out)
    return out, len(edits) // 2


def json_schema() -> dict:
    """JSON Schema of rule files, for editors; stricter than the loader about unknown keys."""
    s = {"type": "string"}
    obj = lambda req=(), **p: {"type": "object", "additionalProperties": False, "properties": p, "required": list(req)}
    pairs = {"type": "array", "items": obj(("pattern", "value"), pattern=s, value=s)}
    detailed = obj(("type",), type={"enum": ["string", "int", "float", "timestamp"]}, format=s, replace=pairs, normalize=pairs, key=s, extra={"type": "boolean"}, meta={"enum": ["source_file", "source_line"]})
    rule = obj(
        ("name",), name=s, pattern=s, preset={"enum": sorted(PRESETS)}, continuation=s, structured=obj(("source", "format"), source=s, format=s),
        fields={"type": "object", "additionalProperties": {"anyOf": [{"enum": ["string", "int", "float", "timestamp"]}, detailed]}},
    )
    rule["oneOf"] = [
        {"required": ["preset"], "not": {"anyOf": [{"required": ["pattern"]}, {"required": ["fields"]}]}},
        {"required": ["pattern", "fields"], "not": {"required": ["preset"]}},
    ]
    mask = obj(("type", "pattern", "action"), type={"enum": ["key", "pattern"]}, pattern=s, action={"enum": ["redact", "hash"]}, value=s, length={"type": "integer", "minimum": 1, "maximum": 64})
    mask["if"], mask["then"], mask["else"] = {"properties": {"action": {"const": "hash"}}}, {"required": ["length"]}, {"not": {"required": ["length"]}}
    level = {"oneOf": [{"type": "integer"}, {"enum": list(ALIASES)}]}
    top = obj(
        ("rules",), rules={"type": "array", "minItems": 1, "items": rule}, mask={"type": "array", "items": mask},
        compression=obj(codec={"enum": sorted(CODECS)}, level=level), row_group=obj(max_rows={"type": "integer", "minimum": 1}),
    )
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", **top}
