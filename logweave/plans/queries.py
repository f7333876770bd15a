"""Registered queries of the log engine over the synthetic tables, with their SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tools
from ..operators.order import with_carried
from ..operators.route import Parsed, parse_lines
from ..sources.lines import spread
from .rules import PRESETS, parse_rules

NOW = datetime(2024, 3, 1, tzinfo=timezone.utc)
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))


def _lines(df: DataFrame, text, source: str = "events", line="event_id", file=None) -> DataFrame:
    file = F.lit(0) if file is None else file
    return df.select(file.cast("int").alias("file_index"), F.lit(source).alias("source"), F.col(line).cast("bigint").alias("line_no"), text.alias("text"))


def _parse(lines: DataFrame, yaml_text: str) -> Parsed:
    return parse_lines(lines, parse_rules(yaml_text), NOW, "UTC")


def _us(df: DataFrame, *names: str) -> DataFrame:
    """df with timestamps as microseconds."""
    for n in names:
        df = df.withColumn(n, F.unix_micros(n))
    return df


def _stamp(pattern: str):
    return F.date_format("ts", pattern)


def _clf(tail: str = ""):
    return F.concat(
        F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".7 - u"), F.col("user_id").cast("string"), F.lit(" ["), _stamp("dd/MMM/yyyy:HH:mm:ss"),
        F.lit(' +0200] "GET /'), F.col("event_type"), F.lit("/"), F.col("event_id").cast("string"), F.lit(' HTTP/1.1" '), (200 + F.col("event_id") % 5).cast("string"),
        F.lit(" "), (F.col("event_id") * 7).cast("string"), F.lit(tail),
    )


def _clf_sql(tail: str = "") -> str:
    return (
        "'10.0.' || (user_id % 256) || '.7 - u' || user_id || ' [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0200] \"GET /' || event_type || '/' || event_id"
        f" || ' HTTP/1.1\" ' || (200 + event_id % 5) || ' ' || (event_id * 7) || '{tail}'"
    )


def _preset_sql(line: str, preset: str, columns: str, table: str = "events") -> str:
    names = [x.split(":")[0] for x in PRESETS[preset][1].split()]
    pattern = PRESETS[preset][0].replace("'", "''")
    return f"WITH l AS (SELECT {line} AS line FROM {table}), m AS (SELECT regexp_extract(line, '{pattern}', {names}) AS g FROM l WHERE regexp_matches(line, '{pattern}')) SELECT {columns} FROM m"


_CLF_COLUMNS = (
    "g.remote_addr AS remote_addr, g.remote_user AS remote_user, epoch_us(strptime(g.time, '%d/%b/%Y:%H:%M:%S %z')) AS time, g.method AS method, g.path AS path, "
    "g.proto AS proto, CAST(g.status AS BIGINT) AS status, CAST(g.bytes AS BIGINT) AS bytes"
)


@query(_preset_sql(_clf_sql(), "apache_clf", _CLF_COLUMNS))
def clf_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _us(_parse(_lines(_events(spark, sf_dir), _clf()), "rules: [{name: access, preset: apache_clf}]").table("access"), "time")


@query(_preset_sql(_clf_sql(' "http://a/b" "Agent x/1 (y)"'), "apache_combined", _CLF_COLUMNS + ", g.referer AS referer, g.user_agent AS user_agent"))
def combined_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(_events(spark, sf_dir), _clf(' "http://a/b" "Agent x/1 (y)"'))
    return _us(_parse(lines, "rules: [{name: access, preset: apache_combined}]").table("access"), "time")


_SYSLOG_SQL = "strftime(ts, '%b ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H:%M:%S') || ' host' || (user_id % 9) || ' app' || CASE WHEN event_id % 2 = 0 THEN '[' || event_id || ']' ELSE '' END || ': ' || event_type"


@query(
    _preset_sql(
        _SYSLOG_SQL, "syslog_rfc3164",
        "CASE WHEN t24 > TIMESTAMP '2024-03-01' THEN epoch_us(t24 - INTERVAL 1 YEAR) ELSE epoch_us(t24) END AS time, g.host AS host, g.tag AS tag, g.pid AS pid, g.message AS message",
    ).replace("SELECT CASE", ", k AS (SELECT g, strptime('2024 ' || g.time, '%Y %b %d %H:%M:%S') AS t24 FROM m) SELECT CASE").replace("FROM m", "FROM k").replace("AS t24 FROM k)", "AS t24 FROM m)")
)
def syslog3164_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    text = F.concat(
        _stamp("MMM "), F.lpad(F.dayofmonth("ts").cast("string"), 2, " "), _stamp(" HH:mm:ss"), F.lit(" host"), (F.col("user_id") % 9).cast("string"), F.lit(" app"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]"))).otherwise(""), F.lit(": "), F.col("event_type"),
    )
    return _us(_parse(_lines(e, text), "rules: [{name: sys, preset: syslog_rfc3164}]").table("sys"), "time")


@query(
    _preset_sql(
        "'<' || (event_id % 192) || '>1 ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.250Z h' || (user_id % 9) || ' app ' || event_id || ' - ' || CASE WHEN event_id % 3 = 0 THEN '-' ELSE '[id@1 k=\"v\"][b]' END || ' ' || event_type",
        "syslog_rfc5424",
        "CAST(g.pri AS BIGINT) AS pri, CAST(g.version AS BIGINT) AS version, epoch_us(strptime(g.time, '%Y-%m-%dT%H:%M:%S.%gZ')) AS time, g.host AS host, g.app AS app, g.procid AS procid, g.msgid AS msgid, g.sd AS sd, g.message AS message",
    )
)
def syslog5424_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit("<"), (F.col("event_id") % 192).cast("string"), F.lit(">1 "), _stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250Z h"), (F.col("user_id") % 9).cast("string"),
        F.lit(" app "), F.col("event_id").cast("string"), F.lit(" - "), F.when(F.col("event_id") % 3 == 0, "-").otherwise('[id@1 k="v"][b]'), F.lit(" "), F.col("event_type"),
    )
    return _us(_parse(_lines(_events(spark, sf_dir), text), "rules: [{name: sys, preset: syslog_rfc5424}]").table("sys"), "time")


_FALL = r"""
rules:
  - name: number
    pattern: '^v=(?P<v>\S+) (?P<kind>\w+)$'
    fields: {v: int, kind: string}
  - name: decimal
    pattern: '^v=(?P<v>\S+) (?P<kind>\w+)$'
    fields: {v: float, kind: string}
  - name: other
    pattern: '^v=(?P<v>[a-z]+)'
    fields: {v: string}
"""
_FALL_SQL = "CASE event_id % 4 WHEN 0 THEN 'v=' || event_id || ' ' || event_type WHEN 1 THEN 'v=' || (event_id % 100) || '.5 ' || event_type WHEN 2 THEN 'v=abc ' || event_type ELSE 'w ' || event_type END"


def _mixed(spark: SparkSession, sf_dir: str, file=None) -> Parsed:
    k, n = F.col("event_id") % 4, F.col("event_id").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("v="), n, F.lit(" "), "event_type")).when(k == 1, F.concat(F.lit("v="), (F.col("event_id") % 100).cast("string"), F.lit(".5 "), "event_type"))
        .when(k == 2, F.concat(F.lit("v=abc "), "event_type")).otherwise(F.concat(F.lit("w "), "event_type"))
    )
    return _parse(_lines(_events(spark, sf_dir), text, file=file), _FALL)


@query(f"""WITH l AS (SELECT event_id AS line_no, {_FALL_SQL} AS t FROM events)
SELECT line_no, CASE WHEN regexp_matches(t, '^v=[0-9]+ \\w+$') THEN 'number' WHEN regexp_matches(t, '^v=[0-9.]+ \\w+$') THEN 'decimal' WHEN regexp_matches(t, '^v=[a-z]+') THEN 'other' END AS rule_name,
CASE WHEN regexp_matches(t, '^v=[0-9]') THEN CAST(regexp_extract(t, '^v=([0-9.]+)', 1) AS DOUBLE) END AS v FROM l""")
def rule_fallthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _mixed(spark, sf_dir)
    name = F.when(F.col("rule") == 0, "number").when(F.col("rule") == 1, "decimal").when(F.col("rule") == 2, "other")
    return p.lines.select("line_no", name.alias("rule_name"), F.coalesce(F.col("r0.v").cast("double"), "r1.v").alias("v"))


@query(f"WITH l AS (SELECT event_id % 3 AS file_index, {_FALL_SQL} AS t FROM events) SELECT CAST(file_index AS INTEGER) AS file_index, CASE WHEN regexp_matches(t, '^v=[0-9]+ \\w+$') THEN 'number' WHEN regexp_matches(t, '^v=[0-9.]+ \\w+$') THEN 'decimal' WHEN regexp_matches(t, '^v=[a-z]+') THEN 'other' END AS rule_name, count(*) AS n_rows FROM l GROUP BY 1, 2")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, F.col("event_id") % 3).counts


_DOC_LINES = "d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return d.select(F.col("doc_id").cast("int").alias("file_index"), F.col("doc_id").cast("string").alias("source"), (F.col("pos") + 1).cast("bigint").alias("line_no"), "text")


@query(f"WITH {_DOC_LINES} SELECT CAST(doc_id AS VARCHAR) AS source, line_no, regexp_replace(t, '[\\w.+-]+@[\\w.-]+', '<mail>', 'g') AS text FROM d WHERE NOT regexp_matches(t, '^[A-Z][a-z]+ [a-z]+ ')")
def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = r"""
rules: [{name: prose, pattern: '^(?P<a>[A-Z][a-z]+) (?P<b>[a-z]+) ', fields: {a: string, b: string}}]
mask: [{type: pattern, pattern: '[\w.+-]+@[\w.-]+', action: redact, value: <mail>}]
"""
    return _parse(_doc_lines(spark, sf_dir), rules).unmatched


@query(f"WITH {_DOC_LINES} SELECT CAST(doc_id AS VARCHAR) AS log_file, line_no AS log_line, left(t, 20) AS head FROM d WHERE regexp_matches(t, '^.{{20}}')")
def meta_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = "rules: [{name: a, pattern: '^(?P<head>.{20})', fields: {head: string, log_file: {type: string, meta: source_file}, log_line: {type: int, meta: source_line}}}]"
    return _parse(_doc_lines(spark, sf_dir), rules).table("a")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), F.col("text"), "documents", "doc_id")


def _whole(fields: str, mask: str = "") -> str:
    return "rules:\n  - name: doc\n    pattern: '(?s)^(?P<text>.*)$'\n    fields:\n      id: {type: int, meta: source_line}\n" + f"      text: {fields}\n" + mask


@query(r"SELECT doc_id AS id, regexp_replace(regexp_replace(text, '(\w+)-(\w+)', '\2_\1', 'g'), '\s+', ' ', 'g') AS text FROM documents")
def replace_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _whole(r"{type: string, replace: [{pattern: '(\w+)-(\w+)', value: '${2}_$1'}, {pattern: '\s+', value: ' '}]}")
    return _parse(_documents(spark, sf_dir), rules).table("doc")


@query("SELECT doc_id AS id, CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'legal' WHEN regexp_matches(text, '@') THEN 'contact' ELSE text END AS text FROM documents")
def normalize_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parse(_documents(spark, sf_dir), _whole("{type: string, normalize: [{pattern: '(?i)licen[sc]e', value: legal}, {pattern: '@', value: contact}]}")).table("doc")


@query(r"SELECT doc_id AS id, regexp_replace(text, '([\w.+-]+)@([\w-]+)', '***@\2', 'g') AS text FROM documents")
def mask_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = r"mask: [{type: pattern, pattern: '([\w.+-]+)@([\w-]+)', action: redact, value: '***@$2'}]"
    return _parse(_documents(spark, sf_dir), _whole("string", m)).table("doc")


@query(r"""SELECT doc_id AS id, coalesce((SELECT string_agg(g || coalesce(left(sha256(m), 12), ''), '' ORDER BY i) FROM (
  SELECT unnest(regexp_split_to_array(text, '[0-9]{3,}')) AS g, unnest(list_concat(regexp_extract_all(text, '[0-9]{3,}'), [NULL])) AS m,
         unnest(range(len(regexp_split_to_array(text, '[0-9]{3,}')))) AS i)), text) AS text FROM documents""")
def mask_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = "mask: [{type: pattern, pattern: '[0-9]{3,}', action: hash, length: 12}]"
    return _parse(_documents(spark, sf_dir), _whole("string", m)).table("doc")


def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit('app {"id": '), F.col("event_id").cast("string"), F.lit(', "type": "'), "event_type", F.lit('", "p": '), "props", F.lit(', "email": "u'), F.col("user_id").cast("string"),
        F.lit('@x.org", "zero": 1.10, "none": null}'),
    )
    return _lines(_events(spark, sf_dir), text)


_JSON_RULES = r"""
rules:
  - name: app
    pattern: '^(?P<tag>\w+) (?P<body>\{.*\})$'
    structured: {source: body, format: json}
    fields:
      tag: string
      id: {type: int, key: id}
      kind: {type: string, key: type}
      nothing: {type: string, key: none}
      rest: {type: string, extra: true}
"""


@query("SELECT 'app' AS tag, event_id AS id, event_type AS kind, '' AS nothing, '{\"email\":\"u' || user_id || '@x.org\",\"p\":' || CAST(CAST(props AS JSON) AS VARCHAR).replace(' ', '') || ',\"zero\":1.10}' AS rest FROM events")
def json_key_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parse(_json_lines(spark, sf_dir), _JSON_RULES).table("app")


@query("SELECT event_id AS id, '{\"email\":\"' || left(sha256('u' || user_id || '@x.org'), 10) || '\",\"p\":\"gone\",\"zero\":1.10}' AS rest FROM events")
def json_key_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = "mask: [{type: key, pattern: '^email$', action: hash, length: 10}, {type: key, pattern: '^p$', action: redact, value: gone}]\n"
    return _parse(_json_lines(spark, sf_dir), _JSON_RULES + m).table("app").select("id", "rest")


def _payload_rules(fmt: str) -> str:
    return f"""
rules:
  - name: p
    pattern: '(?s)^(?P<body>.*)$'
    structured: {{source: body, format: {fmt}}}
    fields:
      id: {{type: int, key: id}}
      kind: {{type: string, key: kind}}
      rest: {{type: string, extra: true}}
"""


@query("""SELECT event_id AS id, event_type AS kind, '{"user":"a:' || user_id || '"}' AS rest FROM events""")
def ltsv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("id:"), F.col("event_id").cast("string"), F.lit("\tnocolon\tkind:"), "event_type", F.lit("\tuser:a:"), F.col("user_id").cast("string"))
    return _parse(_lines(_events(spark, sf_dir), text), _payload_rules("ltsv")).table("p")


@query("""SELECT event_id AS id, event_type AS kind, '{"flag":"","msg":"say \\"' || user_id || '\\" \\u003c\\tx"}' AS rest FROM events""")
def logfmt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("id="), F.col("event_id").cast("string"), F.lit(" flag kind="), "event_type", F.lit(' msg="say \\"'), F.col("user_id").cast("string"), F.lit('\\" <\\tx"'))
    return _parse(_lines(_events(spark, sf_dir), text), _payload_rules("logfmt")).table("p")


@query("SELECT event_id AS tag, '10.0.' || (user_id % 256) || '.7' AS remote_addr, 200 + event_id % 5 AS status, epoch_us(date_trunc('second', ts) - INTERVAL 2 HOUR) AS at, '{\"bytes\":\"' || (event_id * 7) || '\",\"method\":\"GET\",\"path\":\"/' || event_type || '/' || event_id || '\",\"proto\":\"HTTP/1.1\",\"remote_user\":\"u' || user_id || '\"}' AS rest FROM events")
def payload_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = r"""
rules:
  - name: p
    pattern: '^(?P<tag>\d+): (?P<body>.*)$'
    structured: {source: body, format: apache_clf}
    fields:
      tag: int
      remote_addr: {type: string, key: remote_addr}
      status: {type: int, key: status}
      at: {type: timestamp, format: clf, key: time}
      rest: {type: string, extra: true}
"""
    e = _events(spark, sf_dir)
    return _us(_parse(_lines(e, F.concat(F.col("event_id").cast("string"), F.lit(": "), _clf())), rules).table("p"), "at")


@query("SELECT event_id AS id, epoch_us(date_trunc('second', ts)) AS s, epoch_us(ts) // 1000 * 1000 AS ms, epoch_us(ts) AS us, epoch_us(ts) AS ns FROM events")
def epoch_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros("ts")
    text = F.concat_ws(" ", F.col("event_id").cast("string"), F.floor(us / 1_000_000).cast("string"), F.floor(us / 1000).cast("string"), us.cast("string"), F.concat(us.cast("string"), F.lit("789")))
    rules = r"""
rules:
  - name: t
    pattern: '^(?P<id>\d+) (?P<s>\d+) (?P<ms>\d+) (?P<us>\d+) (?P<ns>\d+)$'
    fields:
      id: int
      s: {type: timestamp, format: unix}
      ms: {type: timestamp, format: unix_ms}
      us: {type: timestamp, format: unix_us}
      ns: {type: timestamp, format: unix_ns}
"""
    return _us(_parse(_lines(_events(spark, sf_dir), text), rules).table("t"), "s", "ms", "us", "ns")


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(date_trunc('second', ts)) + 3600000000 WHEN 2 THEN epoch_us(date_trunc('second', ts))
ELSE epoch_us(date_trunc('minute', ts)) + 19800000000 END AS t FROM events""")
def time_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    t = (
        F.when(k == 0, _stamp("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(k == 1, _stamp("dd/MMM/yyyy:HH:mm:ss '-0100'"))
        .when(k == 2, _stamp("yyyy-MM-dd HH:mm:ss")).otherwise(_stamp("dd MMM yy HH:mm '-0530'"))
    )
    rules = r"rules: [{name: t, pattern: '^(?P<id>\d+) (?P<t>.*)$', fields: {id: int, t: {type: timestamp, format: auto}}}]"
    return _us(_parse(_lines(_events(spark, sf_dir), F.concat(F.col("event_id").cast("string"), F.lit(" "), t)), rules).table("t"), "t")


_TALK = r"""
rules:
  - name: turn
    pattern: '^#(?P<turn>\d+) (?P<role>\w+): (?P<text>.*)$'
    continuation: '^> (?P<text>.*)$'
    fields: {turn: string, role: string, text: string, line: {type: int, meta: source_line}}
"""


@query("""WITH l AS (SELECT conv_id, turn, role, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS t FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, n) AS line_no FROM l)
SELECT CAST(conv_id AS INTEGER) AS file_index, CAST(turn AS VARCHAR) AS turn, any_value(role) AS role, string_agg(t, chr(10) ORDER BY n) AS text, min(line_no) AS line FROM n GROUP BY conv_id, turn""")
def continuation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n", -1)).alias("n", "t"))
    c = c.withColumn("line_no", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "n")).cast("bigint"))
    text = F.when(F.col("n") == 0, F.concat(F.lit("#"), F.col("turn").cast("string"), F.lit(" "), "role", F.lit(": "), "t")).otherwise(F.concat(F.lit("> "), "t"))
    p = _parse(_lines(c, text, "talk", "line_no", F.col("conv_id")), _TALK)
    return p.lines.where("rule = 0").select("file_index", "r0.turn", "r0.role", "r0.text", "r0.line")


@query("""WITH l AS (SELECT event_id, CASE WHEN event_id % 16 = 1 THEN 'MORE' ELSE 'START' END AS t FROM events),
n AS (SELECT event_id, t, lead(t, 1, 'START') OVER (ORDER BY event_id) AS following FROM l)
SELECT event_id AS line, CASE WHEN t = 'START' AND following = 'START' THEN 'counter' ELSE 'raw' END AS rule_name FROM n""")
def continuation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose joined value no longer converts fall back line by line."""
    rules = r"""
rules:
  - name: counter
    pattern: '^START (?P<n>\d+)$'
    continuation: '^MORE (?P<n>\d+)$'
    fields: {n: int, line: {type: int, meta: source_line}}
  - name: raw
    pattern: '^(?:START|MORE) (?P<n>.*)$'
    fields: {n: string, line: {type: int, meta: source_line}}
"""
    e = _events(spark, sf_dir)
    # a START with a MORE after it joins to two numbers, which is no int; a START alone converts
    text = F.concat(F.when(F.col("event_id") % 16 == 1, "MORE ").otherwise("START "), F.col("event_id").cast("string"))
    p = _parse(_lines(e, text), rules)
    return p.lines.select(F.coalesce("r0.line", "r1.line").alias("line"), F.when(F.col("rule") == 0, "counter").when(F.col("rule") == 1, "raw").alias("rule_name"))


@query("""SELECT event_id, CAST(user_id % 3 AS INTEGER) AS file_index,
max(epoch_us(CASE WHEN event_id % 7 <> 0 THEN ts END)) OVER (PARTITION BY user_id % 3 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events""")
def kway_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three inputs with the key that orders their merge, in merged order."""
    e = _events(spark, sf_dir).select("event_id", (F.col("user_id") % 3).cast("int").alias("file_index"), F.when(F.col("event_id") % 7 != 0, F.unix_micros("ts")).alias("us"))
    out = with_carried(e, F.col("us"), "file_index", "event_id")
    return out.orderBy(F.col("carried").asc_nulls_first(), "file_index", "event_id").select("event_id", "file_index", "carried")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1")
def cat_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    return tools.concat([("even", o.where("o_orderkey % 2 = 0")), ("odd", o.where("o_orderkey % 2 = 1"))])


@query("SELECT o_orderkey, epoch_us(o_orderdate) AS day FROM orders")
def cat_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inputs merged by their timestamp column."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("day"))
    return _us(tools.concat([("even", o.where("o_orderkey % 2 = 0")), ("odd", o.where("o_orderkey % 2 = 1"))]), "day")


def _dumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.dump_lines(_events(spark, sf_dir).select("event_id", "ts", "event_type"))


@query("""SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0'), '0') END || 'Z"}' AS value FROM events""")
def dump_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dumped(spark, sf_dir)


@query("SELECT event_id, epoch_us(ts) AS ts, event_type FROM events")
def restore_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "ts", "event_type")
    return _us(tools.restore_rows(tools.dump_lines(e), e.schema), "ts")


@query("SELECT 1 AS n_files, count(*) AS n_columns, sum(n) AS n_values FROM (SELECT count(*) AS n, unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS c FROM events GROUP BY c)")
def info_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footer sums of a file that the shared file system holds."""
    f = tools.column_info(spark, [f"{sf_dir}/events.parquet"])
    return f.agg(F.countDistinct("path").cast("int").alias("n_files"), F.count(F.lit(1)).alias("n_columns"), F.sum("n_values").alias("n_values"))
