import hashlib
import random
from datetime import datetime, timezone
from heapq import heapify, heappop, heappush

import pytest
from pyspark.sql import functions as F

from logweave.functions import payload, timefmt, values
from logweave.functions.exprs import captures, cast_float, cast_int, json_string
from logweave.functions.regex import translate
from logweave.operators.order import emission_order
from logweave.operators.route import fold, parse_lines
from logweave.plans.rules import parse_rules

NOW = datetime(2024, 3, 1, 12, tzinfo=timezone.utc)
TIMES = [
    ("iso8601", "2024-02-29T01:02:03.123456789+01:30"), ("iso8601", "2024-02-30T01:02:03Z"), ("rfc2822", "Mon, 02 Jan 2006 15:04:05 -0700"), ("rfc822", "02 Jan 70 15:04 +0000"),
    ("clf", "31/dec/1999:23:59:59 -0000"), ("syslog", "Feb  3 04:05:06"), ("syslog", "Dec 31 23:59:59"), ("syslog", "Feb 29 00:00:00.5"), ("pylog", "2024-01-01 00:00:00,25"),
    ("unix", "1700000000"), ("unix", "1700000000.25"), ("unix_ms", "-1"), ("unix_ns", "-1"), ("unix", "99999999999"), ("unix", "x"), ("%Y/%m/%d %I:%M %p", "2024/05/06 12:30 AM"),
    ("%Y/%m/%d %I:%M %p", "2024/05/06 13:30 AM"), ("2006-01-02", "2024-5-06"), ("auto", "2024-01-01 00:00:00"), ("auto", "nope"), ("clf", "01/Jan/2024:1:02:03 +0000"), ("clf", "01/Jan/2024:25:02:03 +0000"),
]


def test_time_columns_agree_with_the_reader(spark):
    for fmt, text in TIMES:
        f = timefmt.resolve(fmt)
        row = spark.createDataFrame([(text,)], "t string").select(timefmt.parse_column(F.col("t"), f, NOW, "UTC").alias("v")).first()["v"]
        assert (row and (row["us"], row["ns"])) == timefmt.parse_value(text, f, NOW, "UTC"), (fmt, text)
    assert timefmt.parse_value("Dec 31 23:59:59", timefmt.resolve("syslog"), NOW, "UTC")[0] == 1704067199_000000
    assert timefmt.parse_value("1970-01-01T00:00:00.000001999Z", timefmt.resolve("iso8601"), NOW, "UTC") == (1, 999)


def test_casts_agree(spark):
    texts = ["1", "+7", " 1", "9223372036854775808", "-9223372036854775808", "1_0", "", "1.5", "1e3", "1e999", ".5", "5.", "inf", "-Infinity", "1.5d", "x", "0x1p-2", "-0X1.8P+1", "0x1", "0xp1", "0x1p99999"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cast_int(F.col("t")).alias("i"), cast_float(F.col("t")).alias("f")).collect()
    for r in rows:
        assert (r["i"], r["f"]) == (values.to_int(r["t"]), values.to_float(r["t"])), r["t"]


def test_payloads():
    flat, typed = payload.parse('{"a":1.10,"b":null,"c":{"z":[1,"<"],"y":true},"a":2e2}', "json", [])
    assert flat == {"a": "2e2", "b": "", "c": '{"y":true,"z":[1,"\\u003c"]}'} and payload.dumps(typed["a"]) == "2e2"
    assert payload.parse('{"a":1}}', "json", [])[0] == {"a": "1"}
    for bad in ("[1]", "1", "null", "", '{"a":1} x', "{'a':1}", '{"a":NaN}'):
        with pytest.raises(payload.PayloadError):
            payload.parse(bad, "json", [])
    assert payload.parse(r'a b="x \"y\" é\n" c=', "logfmt", [])[0] == {"a": "", "b": 'x "y" é\n', "c": ""}
    for bad in ('a="x', "=1", ""):
        with pytest.raises(payload.PayloadError):
            payload.parse(bad, "logfmt", [])


RULES = parse_rules(r"""
rules:
  - name: counter
    pattern: '^START (?P<n>\d+)$'
    continuation: '^(?:MORE (?P<n>\d+)|-+)$'
    fields: {n: int, line: {type: int, meta: source_line}}
  - name: note
    pattern: '^NOTE (?P<n>.*)$'
    continuation: '^MORE (?P<n>.*)$'
    fields: {n: string, line: {type: int, meta: source_line}}
  - name: raw
    pattern: '^(?:START|MORE) (?P<n>\d+)$'
    fields: {n: string, line: {type: int, meta: source_line}}
""")


def test_multi_line_entries_by_segments_equal_whole_files(spark):
    rng = random.Random(3)
    files = [[rng.choice(["START 1", "MORE 2", "MORE x", "NOTE a", "---", "junk"]) for _ in range(40)] for _ in range(6)]
    rows = [(i, f"f{i}", n, t) for i, f in enumerate(files) for n, t in enumerate(f, 1)]
    p = parse_lines(spark.createDataFrame(rows, "file_index int, source string, line_no bigint, text string"), RULES, NOW)
    got = sorted((r["file_index"], r["line_no"], -1 if r["rule"] is None else r["rule"], r["v"] or "") for r in p.lines.select("file_index", "line_no", "rule", F.coalesce(F.col("r0.n").cast("string"), "r1.n", "r2.n").alias("v")).collect())
    want = sorted((i, n, k, "" if k < 0 else v[0]) for i, f in enumerate(files) for n, k, v, _ in fold(list(enumerate(f, 1)), RULES, f"f{i}", NOW, "UTC"))
    assert got == want
    out = fold([(1, "START 5"), (2, "MORE 6"), (3, "junk"), (4, "NOTE a"), (5, "MORE b")], RULES, "f", NOW, "UTC")
    assert [(n, k, v[0]) for n, k, v, _ in out] == [(1, 2, "5"), (2, 2, "6"), (3, -1, "junk"), (4, 1, "a\nb")]


def test_merge_order_equals_a_heap(spark):
    rng = random.Random(4)
    for case in range(4):
        files = [[rng.choice([None, *range(6)]) for _ in range(rng.randint(0, 8))] for _ in range(3)]
        want, at = [], [0, 0, 0]

        def passing(i):
            while at[i] < len(files[i]) and files[i][at[i]] is None:
                want.append((i, at[i]))
                at[i] += 1

        for i in range(3):
            passing(i)
        heap = [(f[at[i]], i) for i, f in enumerate(files) if at[i] < len(f)]
        heapify(heap)
        while heap:
            _, i = heappop(heap)
            want.append((i, at[i]))
            at[i] += 1
            passing(i)
            if at[i] < len(files[i]):
                heappush(heap, (files[i][at[i]], i))
        rows = [(i, n, k) for i, f in enumerate(files) for n, k in enumerate(f)]
        if rows:
            df = spark.createDataFrame(rows, "file_index int, line_no int, k int")
            assert [(r[0], r[1]) for r in emission_order(df, F.col("k")).collect()] == want


def test_masks_reach_strings_and_rejects(spark):
    rules = parse_rules(r"""
rules:
  - {name: a, pattern: '^a (?P<n>\d+) (?P<t>.*)$', fields: {n: int, t: string}}
mask:
  - {type: pattern, pattern: '\d+', action: hash, length: 4}
""")
    p = parse_lines(spark.createDataFrame([(0, "f", 1, "a 12 x34y"), (0, "f", 2, "bad 7")], "file_index int, source string, line_no bigint, text string"), rules, NOW)
    short = lambda x: hashlib.sha256(x.encode()).hexdigest()[:4]
    assert [tuple(r) for r in p.table("a").collect()] == [(12, f"x{short('34')}y")]
    assert p.unmatched.first()["text"] == f"bad {short('7')}"


def _lines(spark, texts):
    return spark.createDataFrame([(0, "f", n, t) for n, t in enumerate(texts, 1)], "file_index int, source string, line_no bigint, text string")


def test_one_pass_gives_the_groups_of_the_first_match(spark):
    texts = ["k=1 k=2", "xk= y", "none", "", "a\nk=7\n", "k=\x01\x01 z", "\x01", "k=12\x01"]
    for source in (r"k=(?P<a>\d*)(?P<b> k)?", r"^(?:x)?(k)=(?P<b>.)", r"(?i)(?P<a>N)o|(?P<b>y)$", r"z"):
        p = translate(source)
        rows = _lines(spark, texts).select("text", captures(F.col("text"), p).alias("g"), F.col("text").rlike(p.java).alias("hit"), *[F.regexp_extract("text", p.java, i).alias(n) for n, i in p.named.items()]).collect()
        for r in rows:
            want = [r[n] for n in p.named]
            assert (r["g"][1:] == (want or r["g"][1:]) and len(r["g"]) > 1) if r["hit"] else (r["g"] is None or len(r["g"]) == 1), (source, r)


def test_json_strings_and_ltsv_agree_with_the_reader(spark):
    texts = ["", "plain", 'q"\\b', "<&>\u2028\u2029", "".join(map(chr, range(1, 40))), "é😀\x7f"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_string(F.col("t")).alias("j")).collect()
    assert all(r["j"] == payload.dumps(r["t"]) for r in got)
    rules = parse_rules("rules: [{name: p, pattern: '(?s)^(?P<body>.*)$', structured: {source: body, format: ltsv}, fields: {a: {type: string, key: a}, rest: {type: string, extra: true}}}]")
    lines = ["a:1\tb:2:3\tnone\ta:4", "b:1", "", "a:\t:x\tz:<\ty:\x0b", "none", "a:1\tc:1\tc:2"]
    got = [tuple(r) for r in parse_lines(_lines(spark, lines), rules, NOW).table("p").collect()]
    want = []
    for t in lines:
        try:
            flat = payload.parse_ltsv(t)
            want.append((flat["a"], payload.dumps({k: v for k, v in flat.items() if k != "a"})))
        except (payload.PayloadError, KeyError):
            pass
    assert got == want and len(got) == 3


def test_masked_keys_of_flat_payloads_and_chains(spark):
    for fmt, text in (("ltsv", "pw:x1\tuser:bob"), ("logfmt", "pw=x1 user=bob"), ("json", '{"pw":"x1","user":"bob"}')):
        rules = parse_rules(
            f"rules: [{{name: p, pattern: '^(?P<body>.*)$', structured: {{source: body, format: {fmt}}}, fields: {{pw: {{type: string, key: pw}}, rest: {{type: string, extra: true}}}}}}]\n"
            "mask: [{type: key, pattern: ^pw$, action: redact, value: $1}, {type: key, pattern: w, action: hash, length: 6}]"
        )
        row = parse_lines(_lines(spark, [text]), rules, NOW).table("p").first()
        assert tuple(row) == (hashlib.sha256(b"$1").hexdigest()[:6], '{"user":"bob"}'), fmt


def test_lone_surrogates_do_not_end_the_job(spark):
    rules = parse_rules("rules: [{name: p, pattern: '^(?P<body>.*)$', structured: {source: body, format: json}, fields: {a: {type: string, key: a}, rest: {type: string, extra: true}}}]")
    rows = parse_lines(_lines(spark, [r'{"a":"\ud800x","b":"\udc00"}', r'{"a":"\ud83d\ude00"}']), rules, NOW).table("p").collect()
    assert [tuple(r) for r in rows] == [("\ufffdx", '{"b":"\ufffd"}'), ("😀", "{}")]
    with pytest.raises(payload.PayloadError):
        payload.parse_logfmt(r'a="\ud800"')


def test_a_line_is_tried_once(spark):
    rules = parse_rules("""
rules:
  - {name: access, preset: apache_clf}
  - {name: p, pattern: '^(?P<body>.*)$', structured: {source: body, format: json}, fields: {a: {type: int, key: a}, rest: {type: string, extra: true}}}
""")
    parsed = parse_lines(_lines(spark, ["x", '{"a":1}']), rules, NOW)
    for df in (*parsed.tables.values(), parsed.unmatched, parsed.counts):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.count("remote_user") <= plan.count("proto") and plan.count("HTTP") == 0
        # one rewrite for the groups of each rule and one for the time
        assert plan.count("regexp_replace(") == 3, plan
