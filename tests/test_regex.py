import duckdb
import pytest
from pyspark.sql import functions as F

from logweave.functions.regex import PatternError, java_template, replace_all, translate

PATTERNS = [r"^ab$", r"a.c", r"\bé", r"\s+", r"(?i)É", r"[[:alpha:]]+", r"[a&&b]", r"(?P<a_b>\d+)-(?P<c>\w*)", r"\x41|\t", r"(?s)a.c", r"[^\s]+$", r"x{2,3}?", r"\pL+", r"[\d.]+"]
TEXTS = ["ab\n", "ab", "a\rc", "a\nc", "é", "xé", "É", "a&b", "12-z_9", "A\t", " \x0b ", "xxx", "日本", "a[b]c", "", "1.5"]


def test_agrees_with_an_re2_engine(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "i int, t string")
    for p in PATTERNS:
        q = translate(p)
        got = {r["i"]: (r["m"], r["x"]) for r in df.select("i", F.col("t").rlike(q.java).alias("m"), F.regexp_extract("t", q.java, 0).alias("x")).collect()}
        for i, t in rows:
            want = duckdb.execute("SELECT regexp_matches(?, ?), regexp_extract(?, ?)", [t, p, t, p]).fetchall()[0]
            assert got[i] == want, (p, t)
            m = q.compiled.search(t)
            assert (m is not None, m[0] if m else "") == want, ("python", p, t)


@pytest.mark.parametrize("p", [r"(?=a)", r"(?<!a)b", r"(a)\1", r"a++", r"a**", r"(", r"a)", r"[a", r"\Z", r"*a", r"a{1001}", r"(?P<n>a)(?P<n>b)"])
def test_refused(p):
    with pytest.raises(PatternError):
        translate(p)


def test_templates():
    p = translate(r"(?P<k>\w+)=(\d+)")
    assert java_template(p, "$2:${k}$$") == r"$2:$1\$"
    assert java_template(p, "${2}0") == r"$2\0"
    assert replace_all(p, "$kx|$9|${k}", "a=1") == "||a"
    assert replace_all(translate("a*"), "x", "baaac") == "xbxcx"
