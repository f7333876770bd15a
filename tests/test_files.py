import bz2
import gzip
import json
import lzma

import pyarrow.parquet as pq
import pytest
import zstandard

from logweave import cli
from logweave.operators import tools
from logweave.sources.lines import read_lines

RULES = """
rules:
  - name: ev
    pattern: '^(?P<time>\\S+) (?P<msg>.*)$'
    fields: {time: {type: timestamp, format: iso8601}, msg: string}
"""
LINES = "2024-01-01T00:00:0{}Z m{}\n"


@pytest.fixture
def logs(tmp_path):
    a, b = tmp_path / "a.log", tmp_path / "b.log.gz"
    a.write_text(LINES.format(1, 1) + LINES.format(4, 4) + "garbage\r\n" + LINES.format(5, 5).rstrip())
    b.write_bytes(gzip.compress((LINES.format(2, 2) + LINES.format(3, 3)).encode()))
    (tmp_path / "rules.yaml").write_text(RULES)
    return tmp_path


def test_codecs_and_broken_files(spark, tmp_path):
    text = b"one\r\ntwo\n\nlast"
    for name, data in {"p.txt": text, "g.gz": gzip.compress(text), "x.XZ": lzma.compress(text), "b.bz2": bz2.compress(text), "z.zst": zstandard.compress(text)}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "bad.gz").write_bytes(b"nope")
    paths = [str(p) for p in sorted(tmp_path.iterdir())] + [str(tmp_path / "missing")]
    rows = read_lines(spark, paths).collect()
    for i, p in enumerate(paths):
        mine = [(r["line_no"], r["text"]) for r in rows if r["file_index"] == i and r["error"] is None]
        assert mine == ([] if "bad" in p or "missing" in p else [(1, "one"), (2, "two"), (3, ""), (4, "last")]), p
    assert {r["file_index"] for r in rows if r["error"]} == {i for i, p in enumerate(paths) if "bad" in p or "missing" in p}


def test_import_cat_dump_restore_info(spark, logs, capsys):
    out = logs / "out"
    assert cli.main(["import", "--rules", str(logs / "rules.yaml"), "--out", str(out), "--max-rows-per-row-group", "2", str(logs / "a.log"), str(logs / "b.log.gz")]) == 0
    t = pq.read_table(out / "ev.parquet")
    assert t["msg"].to_pylist() == ["m1", "m2", "m3", "m4", "m5"]
    assert (out / "unmatched.txt").read_text() == f"{logs / 'a.log'}\t3\tgarbage\n"
    meta = pq.ParquetFile(out / "ev.parquet")
    assert not meta.schema_arrow.field("msg").nullable and meta.metadata.row_group(0).column(0).compression == "ZSTD"
    assert cli.main(["cat", "--output", str(logs / "c.parquet"), str(out / "ev.parquet"), str(out / "ev.parquet")]) == 0
    assert pq.read_table(logs / "c.parquet")["msg"].to_pylist() == [f"m{i}" for i in (1, 1, 2, 2, 3, 3, 4, 4, 5, 5)]
    assert cli.main(["dump", str(out / "ev.parquet"), str(logs / "d.jsonl")]) == 0
    first, row = (logs / "d.jsonl").read_text().split("\n")[:2]
    assert json.loads(first)["compression"] == "zstd" and row == '{"msg":"m1","time":"2024-01-01T00:00:01Z"}'
    assert cli.main(["restore", "--compression", "brotli", str(logs / "d.jsonl"), str(logs / "r.parquet")]) == 0
    assert pq.read_table(logs / "r.parquet").to_pylist() == t.to_pylist()
    assert tools.source_codec(str(logs / "r.parquet")) == "brotli"
    capsys.readouterr()
    assert cli.main(["info", "--format", "json", str(out / "ev.parquet")]) == 0
    assert json.loads(capsys.readouterr().out)[0]["rows"] == 5


def test_exit_codes(logs):
    assert cli.main(["import", "x"]) == 2
    assert cli.main(["import", "--rules", str(logs / "rules.yaml"), "--compression", "rar", str(logs / "a.log")]) == 2
    assert cli.main(["import", "--rules", str(logs / "none.yaml"), str(logs / "a.log")]) == 1
    assert cli.main(["version"]) == 0 and cli.main(["schema"]) == 0 and cli.main(["scaffold"]) == 0


def test_schema_gate(spark):
    a, b = spark.createDataFrame([(1,)], "x bigint"), spark.createDataFrame([("1",)], "x string")
    with pytest.raises(tools.SchemaError):
        tools.concat([("a", a), ("b", b)])


def test_stream(spark, logs):
    from logweave.plans.rules import parse_rules
    from logweave.streaming.routing import route_stream, stream_lines

    (logs / "in").mkdir()
    (logs / "in" / "a.txt").write_text(LINES.format(1, 1) + "junk\n")
    q = route_stream(stream_lines(spark, str(logs / "in")), parse_rules(RULES)).table("ev").writeStream.format("memory").queryName("ev").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("ev").count() == 1
