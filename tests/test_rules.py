import pytest

from logweave.plans import rewrite
from logweave.plans.rules import RuleError, parse_rules
from logweave.sources.settings import SettingsError, resolve_compression, resolve_row_group

ONE = "rules: [{name: a, pattern: '(?P<x>.)', fields: {x: string}}]\n"


@pytest.mark.parametrize(
    "text, part",
    [
        ("rules: [{name: '', pattern: '(?P<x>.)', fields: {x: string}}]", "file name"),
        ("rules: [{name: a/b, pattern: x}]", "no slash"),
        ("rules: [{name: .a, pattern: x}]", "no dot in front"),
        ("rules: [{name: a, preset: nope}]", "no preset"),
        ("rules: [{name: a, preset: apache_clf, pattern: x}]", "beside a preset"),
        ("rules: [{name: a, pattern: x, fields: {y: string}}]", "no group of this name"),
        ("rules: [{name: a, pattern: '(?P<y>x)', fields: {y: bool}}]", "is none of float, int"),
        ("rules: [{name: a, pattern: '(?P<y>x)', fields: {y: timestamp}}]", "needs a format"),
        ("rules: [{name: a, pattern: '(?P<y>x)', fields: {y: {type: timestamp, format: '%j'}}}]", "%j is no directive"),
        ("rules: [{name: a, pattern: x, fields: {y: {type: string, key: k}}}]", "need a structured section"),
        ("rules: [{name: a, pattern: '(?P<b>x)', structured: {source: b, format: xml}, fields: {y: {type: string, key: k}}}]", "none of apache_clf"),
        ("rules: [{name: a, pattern: '(?P<b>x)', structured: {source: c, format: json}, fields: {y: {type: string, key: k}}}]", "structured source"),
        ("rules: [{name: a, pattern: '(?P<b>x)', structured: {source: b, format: json}, fields: {b: string}}]", "feeds no field"),
        ("rules: [{name: a, pattern: x, fields: {y: {type: int, meta: source_file}}}]", "of type string"),
        ("rules: [{name: a, pattern: x, fields: {y: {type: int, meta: nope}}}]", "is none of source_file"),
        ("rules: [{name: a, pattern: '(?P<x>.)', continuation: '(?P<z>.)', fields: {x: string}}]", "continuation group"),
        ("rules: [{name: a, pattern: '(?P<x>.)', fields: {x: string}}, {name: a, pattern: '(?P<x>.)', fields: {x: int}}]", "other columns"),
        (ONE + "mask: [{type: cell, pattern: x, action: redact}]", "neither key nor pattern"),
        (ONE + "mask: [{type: key, pattern: x, action: drop}]", "neither redact nor hash"),
        (ONE + "mask: [{type: key, pattern: x, action: hash, length: 65}]", "1 to 64"),
        (ONE + "mask: [{type: key, pattern: x, action: hash}]", "1 to 64"),
        ('rules: [{name: "a\\x85", pattern: x}]', "file name"),
        ("rules: [{name: a, pattern: '(?P<b>x)', structured: {source: b, format: json}, fields: {b: {type: string, key: k, extra: true}}}]", "key and extra at once"),
        ("rules: [{name: a, pattern: x, fields: {y: {type: string, extra: true}, z: {type: string, extra: true}}, structured: {source: b, format: json}}]", "one field only"),
        ("rules: [{name: a, pattern: '(?P<y>x)', fields: {y: {type: timestamp, format: '%H%'}}}]", "single %"),
        (ONE + "compression: {codec: rar}", "unknown codec"),
        (ONE + "row_group: {max_rows: -1}", "positive"),
        ("rules: [{name: a, pattern: '(?=x)'}]", "pattern"),
    ],
)
def test_problems(text, part):
    with pytest.raises(RuleError, match=part):
        parse_rules(text)


def test_settings():
    assert resolve_compression({}) == ("zstd", None)
    assert resolve_compression({"codec": "gzip"}, {"codec": "snappy", "level": 5}) == ("gzip", 5)
    assert resolve_compression({"level": "best"}) == ("zstd", 4)
    assert resolve_row_group({"max_rows": 3}, {"max_rows": 9}) == 3
    for bad in ({"codec": "snappy", "level": 1}, {"level": 9}, {"level": "x"}):
        with pytest.raises(SettingsError):
            resolve_compression(bad)


def test_expand_and_collapse_are_inverse():
    text = "# head\nrules:\n  # about\n  - name: a\n    preset: syslog_rfc5424  # tail\n  - name: b\n    pattern: '(?P<x>.)'\n    fields:\n      x: string\n"
    out, n = rewrite.expand(text)
    assert n == 1 and "# head" in out and "# about" in out and "# tail" in out and "preset" not in out
    assert [f.name for f in parse_rules(out).rules[0].fields] == [f.name for f in parse_rules(text).rules[0].fields]
    back, n = rewrite.collapse(out)
    assert n == 1 and back == text
    assert rewrite.expand(ONE) == (ONE, 0) and rewrite.collapse(ONE) == (ONE, 0)
    parse_rules(rewrite.SCAFFOLD)


PRESET_TEXT = rewrite.expand("rules:\n  - name: a\n    preset: syslog_rfc3164\n")[0]


def test_redactions_need_no_length():
    assert parse_rules(ONE + "mask: [{type: key, pattern: x, action: redact, length: 0}]").masks[0].length == 0


def test_collapse_compares_parse_trees():
    text = PRESET_TEXT.replace(r"\d+:\d+", r"[0-9]+\:[\d]+")
    assert text != PRESET_TEXT and rewrite.collapse(text)[1] == 1
    assert rewrite.collapse(PRESET_TEXT.replace(r"\d+:", r"\d*:"))[1] == 0
    assert rewrite.collapse(PRESET_TEXT.replace("host: string", "host: int"))[1] == 0
    assert rewrite.collapse(PRESET_TEXT.replace("host: string", "host: {type: string, normalize: [{pattern: x, value: y}]}"))[1] == 0
    assert rewrite.collapse(PRESET_TEXT.replace("      host: string\n", "      host: string\n      at: {type: int, meta: source_line}\n"))[1] == 0


def test_collapse_beside_aliases():
    block = PRESET_TEXT.split("\n", 1)[1]
    plain = block.replace("name: a", "name: plain")
    for head, more in (("- &base\n    name: a", "  - *base\n"), ("- &base\n    name: a", "  - {<<: *base}\n"), ("- name: a", "  - {name: z, pattern: *p, fields: *f}\n")):
        text = "rules:\n" + block.replace("- name: a", head)
        if "*p" in more:
            text = text.replace("pattern: '", "pattern: &p '").replace("fields:", "fields: &f")
        out, n = rewrite.collapse(text + more + plain)
        assert n == 1 and out == text + more + "  - name: plain\n    preset: syslog_rfc3164\n", more
    whole = "x: &r\n" + block + "rules: *r\n"
    assert rewrite.collapse(whole) == (whole, 0)


def test_comments_survive():
    text = PRESET_TEXT.replace("    pattern:", "    # before\n    pattern:").replace("    fields:", "    # between\n    fields:").rstrip("\n") + "\n    # foot\n\n  - name: b  # tail\n    pattern: '(?P<x>.)'\n    fields: {x: string}\n# end\n"
    out, n = rewrite.collapse(text)
    assert n == 1 and all(c in out for c in ("# before", "# between", "# foot", "# tail", "# end")) and "preset: syslog_rfc3164" in out
    again, n = rewrite.expand(out)
    assert n == 1 and all(c in again for c in ("# before", "# between", "# foot", "# tail", "# end"))
    assert parse_rules(again).rules == parse_rules(text).rules or [r.fields for r in parse_rules(again).rules] == [r.fields for r in parse_rules(text).rules]
    assert rewrite.expand("") == ("", 0) and rewrite.collapse("") == ("", 0)


def test_schema_states_conditions():
    s = rewrite.json_schema()
    assert s["properties"]["mask"]["items"]["then"] == {"required": ["length"]}
    assert set(s["properties"]["compression"]["properties"]) == {"codec", "level"} and len(s["properties"]["rules"]["items"]["oneOf"]) == 2
    rules = parse_rules(rewrite.SCAFFOLD)
    assert rules.rules[0].compiled.compiled.search('17 2024-05-01T10:00:00Z WARN slow job {"job":"resize","ms":412,"user":"ann"}')
