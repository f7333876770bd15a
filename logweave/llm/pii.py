"""Personal data: patterns propose spans, checksums confirm them, context adjusts a score.

Built from SQL functions only. Spans are half-open code-point ranges, found leftmost and
non-overlapping per kind. `split` and `regexp_extract_all` walk the same matches, so a match's
start is the length of all segments and matches before it.

A span's score is its kind's prior plus what the words within WINDOW characters before and after
it add or take (up to the neighbouring match of its kind). Base kinds (email, ip, card, phone)
are kept whatever their score. Added kinds are kept when it reaches THRESHOLD: iban (mod-97),
national (grouped national numbers such as 123-45-6789), mac (hardware addresses), credential
(keys of known issuers), secret (long random-looking strings beside words such as token).

The work is linear in a text and its matches. Patterns have possessive runs that start only
where a run starts (or where the last match ended), which leaves the matches as they are because
all starts within a run share its end. Running sums and maxima go over chunks of SIDE
matches, and a redacted text is put together from blocks of BLOCK characters.

Defined results: null text counts as empty and has no spans; repeated rows are each scanned;
overlapping spans of different kinds are each reported and redacted together under the first's
kind; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare

#: Code points on either side of a span that count as its context.
WINDOW = 40
THRESHOLD = 0.5

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){15,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
MAC = r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])"

CREDENTIAL = r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}+|xox[abprs]-[A-Za-z0-9-]{10,255}+|sk-[A-Za-z0-9_-]{20,255}+)(?![A-Za-z0-9_-])"
SECRET = r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+-]{20,512}+={0,2}(?![A-Za-z0-9_/+=-])"

#: kind, pattern, guard, prior score, words that raise it, words that lower it. A text without a match of
#: the guard has no match of the pattern; it is cheaper to test.
BASE = (
    ("email", EMAIL, "@", 0.8, "mail|email|contact|write|address", "example|sample"),
    ("ip", IP, r"[0-9]\.[0-9]", 0.6, "ip|host|server|client|address|from", "version|release|build|section|chapter"),
    ("card", CARD, r"[0-9](?:[ -]?[0-9]){15}", 0.8, "card|visa|credit|debit|payment", "order|invoice|serial|tracking|isbn"),
    ("phone", PHONE, r"\+[0-9]", 0.7, "phone|tel|call|mobile|fax|cell", "order|invoice|serial|version"),
)
EXTRA = (
    ("iban", IBAN, r"[A-Z]{2}[0-9]{2}", 0.6, "iban|account|bank|konto|cuenta|compte|transfer", "order|invoice|serial|model|version"),
    ("national", NATIONAL, r"[0-9]-[0-9]{2}-[0-9]", 0.4, "ssn|social|security|tax|national|passport|identity", "order|invoice|serial|part|version|phone|fax"),
    ("mac", MAC, r"[0-9A-Fa-f]:[0-9A-Fa-f]{2}:", 0.4, "mac|hardware|device|ethernet|adapter|wifi", "time|duration|clock"),
    ("credential", CREDENTIAL, r"AKIA|gh[pousr]_|xox[abprs]-|sk-", 0.9, "key|token", "example|sample"),
    ("secret", SECRET, r"[A-Za-z0-9_/+-]{20}", 0.3, "token|secret|password|passwd|pwd|api_key|apikey|access_key|secret_key|private_key|bearer|authorization|credential", "sha|sha1|sha256|md5|digest|checksum|commit|hash|http|https|www"),
)
_SPAN = "array<struct<start:bigint,end:bigint,kind:string,text:string,score:double>>"
SIDE, BLOCK = 128, 2048


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Luhn's check of a string of digits."""
    d = F.reverse(_digits(s))
    v = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))),
        lambda i: F.substring(d, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
    )
    return F.aggregate(v, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def mod97(s: Column) -> Column:
    """The mod-97 check of an IBAN: four characters moved to the end, letters as 10 to 35."""
    flat = F.regexp_replace(s, " ", "")
    turned = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, F.lit(1), F.lit(4)))
    codes = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.between("0", "9"), c.try_cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(codes, F.lit(0), lambda a, x: (F.when(x > 9, a * 100).otherwise(a * 10) + x) % 97) == 1


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return F.length(_digits(s)).between(16, 19) & luhn(s)
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(s, " ", "")).between(15, 34) & mod97(s)
    if kind == "secret":
        return s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    if kind == "national":
        return ~s.rlike("^(000|666|9[0-9]{2})-") & ~s.rlike("-00-") & ~s.rlike("-0000$")
    return F.lit(True)


def _check(kind: str):
    return lambda s: _valid(kind, s["text"])


def _before(values: Column, join) -> Column:
    """For every element of an array of bigints what join makes of 0 and all those before it; and,
    as one more element, of all. In chunks, as an array that grows by one is copied each time."""
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<bigint>")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / SIDE).cast("int") - 1, F.lit(0))), lambda k: F.slice(values, k * SIDE + 1, F.lit(SIDE)))

    def scan(a: Column, first: Column) -> Column:
        grown = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(join(acc["at"], x))).alias("out"))
        return F.aggregate(a, F.struct(first.alias("at"), F.array(first).alias("out")), grown, lambda acc: acc["out"])

    whole = scan(F.transform(chunks, lambda c: F.aggregate(c, zero, join)), zero)
    # the last value of each chunk is the first of the next one
    inner = F.zip_with(chunks, F.slice(whole, F.lit(1), F.size(chunks)), lambda c, first: F.slice(scan(c, first), F.lit(1), F.size(c)))
    return F.when(F.size(values) > 0, F.concat(F.flatten(inner), F.slice(whole, F.lit(-1), F.lit(1)))).otherwise(F.concat(none, F.array(zero)))


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _located(text: Column, pattern: str, kind: str) -> Column:
    """Matches as (start, end, kind, text, before, after), before validation; before and after are the
    characters around the match that count as its context."""

    def placed(m: Column) -> Column:
        found, gaps = m["found"], m["gaps"]
        ends = F.zip_with(gaps, found, lambda g, x: (F.length(g) + F.coalesce(F.length(x), F.lit(0))).cast("bigint"))
        around = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.slice(gaps, F.lit(2), F.size(found)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        at = F.slice(_before(F.slice(ends, F.lit(1), F.size(found)), lambda a, x: a + x), F.lit(1), F.size(found))

        def one(x: Column, y: Column) -> Column:
            start = y["at"] + F.length(y["g"]["a"])
            return F.struct(
                start.alias("start"), (start + F.length(x)).alias("end"), F.lit(kind).alias("kind"), x.alias("text"),
                F.right(y["g"]["a"], F.lit(WINDOW)).alias("before"), F.substring(y["g"]["b"], 1, WINDOW).alias("after"),
            )

        return F.zip_with(found, F.zip_with(at, around, lambda a, g: F.struct(a.alias("at"), g.alias("g"))), one)

    return _bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), placed)


def _scored(spans: Column, prior: float, up: str, down: str) -> Column:
    def one(s):
        near = F.lower(F.concat(s["before"], F.lit("\n"), s["after"]))
        score = F.lit(prior) + F.when(near.rlike(rf"\b(?:{up})\b"), 0.3).otherwise(0.0) - F.when(near.rlike(rf"\b(?:{down})\b"), 0.3).otherwise(0.0)
        score = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text"), score.alias("score"))

    return F.transform(spans, one)


def spans(text: Column) -> tuple[Column, Column]:
    """Base spans in the order kind, start; and added spans."""
    none = F.array().cast(_SPAN)

    def of(kind: str, pattern: str, guard: str, prior: float, up: str, down: str) -> Column:
        hit = _scored(F.filter(_located(text, pattern, kind), _check(kind)), prior, up, down)
        return F.when(text.contains("@") if guard == "@" else text.rlike(guard), hit).otherwise(none)

    more = F.concat(*[of(*x) for x in EXTRA])
    return F.concat(*[of(*x) for x in BASE]), F.filter(more, lambda s: s["score"] >= THRESHOLD)


def find_pii(docs: DataFrame, base: str = "base_spans", every: str = "all_spans") -> DataFrame:
    """docs with base_spans and all_spans (arrays of start, end, kind, text, score); a column of
    docs with such a name stays, and that of the spans has underscores before it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base, every, extra = spare(docs.columns, base), spare(docs.columns, every), spare(docs.columns, "extra_spans")
    first, more = spans(text)
    found = docs.withColumn(base, first).withColumn(extra, more)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], base, F.concat(base, extra).alias(every))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from start to end of a text given as blocks of BLOCK code points."""
    k = F.floor(start / BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, k + 1, F.floor(end / BLOCK).cast("int") - k + 1), "")
    return F.substring(some, (start - k * BLOCK).cast("int") + 1, F.greatest(end - start, F.lit(0)).cast("int"))


def _redacted(text: Column, spans: Column) -> Column:
    def written(v: Column) -> Column:
        sorted_spans, reach = v["s"], v["reach"]

        def part(s: Column, at: Column) -> Column:
            # a span that begins before an earlier one ends is covered by it
            return F.when(s["start"] >= at, F.concat(_cut(v["b"], at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

        parts = F.zip_with(sorted_spans, F.slice(reach, F.lit(1), F.size(sorted_spans)), part)
        return F.concat(F.array_join(parts, ""), _cut(v["b"], F.element_at(reach, -1), F.length(text).cast("bigint")))

    blocks = F.concat(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)), F.array(F.lit("")))
    s = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    reach = lambda x: _before(F.transform(x, lambda y: y["end"]), lambda a, e: F.greatest(a, e))
    return _bound(s, lambda x: _bound(F.struct(x.alias("s"), reach(x).alias("reach"), blocks.alias("b")), written))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; overlapping spans are
    replaced together under the kind of the first."""
    every = spare(docs.columns, "all_spans")
    found = find_pii(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    clean = F.when(F.size(F.col(every)) > 0, _redacted(text, F.col(every))).otherwise(F.col("text"))
    return found.select(*[clean.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def _written(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, and all spans as text."""
    f = find_pii(docs.select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return f.select(
        "doc_id", *[count(k) for k, *_ in BASE], F.sha2(_written(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), _written(F.col("all_spans")).alias("spans")
    )
