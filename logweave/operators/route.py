"""Ordered rule routing: the first rule whose pattern matches and whose fields all convert.

Lines without multi-line rules stay in Column expressions. With such rules, a file is cut at
every line that no continuation pattern matches: what follows is independent of what came
before, so only runs of two or more lines go through the row-wise state machine.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import payload, timefmt, values
from ..functions.exprs import captures, cast_float, cast_int, json_object, mask, mask_value, matched, normalize, replace
from ..functions.regex import replace_all, translate
from ..plans.rules import PAYLOADS, PRESETS, Rule, RuleSet
from .order import emission_order

_KEY = "struct<us: bigint, ns: smallint>"


def _ltsv(raw: Column, keys: list[str], want_extra: bool) -> list:
    """LTSV by SQL functions; of equal keys the last counts."""
    cut = lambda x: F.substring_index(x, ":", 1)

    def last(parts: Column, key) -> Column:
        head = F.concat(key, F.lit(":"))
        return F.try_element_at(F.transform(F.filter(parts, lambda x: x.startswith(head)), lambda x: F.substring(x, F.length(head) + 1, F.length(x))), F.lit(-1))

    def parsed(parts: Column) -> Column:
        extra = F.lit("")
        if want_extra:
            names = F.array_sort(F.array_distinct(F.transform(parts, cut)))
            if keys:
                names = F.filter(names, lambda k: ~k.isin(keys))
            extra = json_object(F.transform(names, lambda k: F.struct(k.alias("k"), last(parts, k).alias("v"))))
        return F.struct(F.array(*[last(parts, F.lit(k)) for k in keys]).cast("array<string>").alias("keys"), extra.alias("extra"))

    return [lambda raw: F.when(raw != "", F.filter(F.split(raw, "\t", -1), lambda x: x.contains(":"))), lambda parts: F.when(parts.isNotNull(), parsed(parts))]


def _payload_steps(rule: Rule, rules: RuleSet) -> list:
    """Steps from the payload's text to struct<keys: array<string>, extra>, null where it does not parse."""
    keys = [f.key for f in rule.fields if f.key]
    masks, want_extra = rules.key_masks, any(f.extra for f in rule.fields)
    if rule.payload not in PAYLOADS:
        p = translate(PRESETS[rule.payload][0])
        place = {n: i for i, n in enumerate(p.named, 1)}
        left = sorted(n for n in place if n not in keys)

        def of_preset(groups: Column) -> Column:
            pick = lambda n: F.get(groups, F.lit(place[n]))
            extra = json_object(F.array(*[F.struct(F.lit(n).alias("k"), pick(n).alias("v")) for n in left])) if left and want_extra else F.lit("{}")
            got = F.array(*[pick(k) if k in place else F.lit(None) for k in keys]).cast("array<string>")
            return F.when(matched(groups), F.struct(got.alias("keys"), extra.alias("extra")))

        return [lambda raw: captures(raw, p), of_preset]
    if rule.payload == "ltsv" and not masks:
        return _ltsv(None, keys, want_extra)
    shape = pa.struct([("keys", pa.list_(pa.string())), ("extra", pa.string())])

    @F.arrow_udf("struct<keys: array<string>, extra: string>")
    def parsed(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                flat, typed = payload.parse(text, rule.payload, masks)
                out.append({"keys": [flat[k] for k in keys], "extra": payload.dumps({k: v for k, v in typed.items() if k not in keys}) if want_extra else ""})
            except (payload.PayloadError, KeyError, AttributeError):
                out.append(None)
        return pa.array(out, shape)

    return [parsed]


def _field_steps(f, rules: RuleSet, now: datetime, tz: str) -> list:
    """Steps from a field's text to its value; for a timestamp, to struct<us, ns>."""
    out = [lambda c, q=translate(q), t=template: replace(c, q, t) for q, template in f.replace]
    if f.normalize:
        pairs = [(translate(q), v) for q, v in f.normalize]
        out.append(lambda c: normalize(c, pairs))
    if f.type == "int":
        return [*out, cast_int]
    if f.type == "float":
        return [*out, cast_float]
    if f.type == "timestamp":
        return [*out, *timefmt.steps(timefmt.resolve(f.format), now, tz)]
    return [*out, *[lambda c, m=m: mask(c, *m) for m in rules.pattern_masks]]


def attempt(lines: DataFrame, i: int, rules: RuleSet, now: datetime, tz: str) -> DataFrame:
    """lines (with rule, key and the rows of the rules before i) tried under rule i.

    Every step is a projection of its own, so what it reads is computed once; lines that an
    earlier rule took have null groups, which cost nothing further on.
    """
    rule, own = rules.rules[i], lines.columns
    caps = lines.select("*", F.when(F.col("rule").isNull(), captures(F.col("text"), rule.compiled)).alias("_g"))
    place = {n: k for k, n in enumerate(rule.compiled.named, 1)}
    group = lambda n: F.get(F.col("_g"), F.lit(place[n]))
    hit = matched(F.col("_g"))
    if rule.payload:
        caps = caps.select("*", group(rule.source).alias("_p"))
        for step in _payload_steps(rule, rules):
            caps = caps.select(*own, "_g", step(F.col("_p")).alias("_p"))
        hit = hit & F.col("_p.keys").isNotNull()
    keys = [f.key for f in rule.fields if f.key]
    cols, todo = [], []
    for f in rule.fields:
        if f.meta:
            cols.append(F.col("source") if f.meta == "source_file" else F.col("line_no").cast("bigint"))
        else:
            cols.append(F.col("_p.extra") if f.extra else F.get(F.col("_p.keys"), F.lit(keys.index(f.key))) if f.key else group(f.name))
        todo.append([] if f.meta else _field_steps(f, rules, now, tz))
    out = caps.select(*own, hit.alias("_hit"), *[c.alias(f"_f{j}") for j, c in enumerate(cols)])
    for k in range(max(map(len, todo), default=0)):
        nxt = [(s[k](F.col(f"_f{j}")) if k < len(s) else F.col(f"_f{j}")).alias(f"_f{j}") for j, s in enumerate(todo)]
        out = out.select(*own, "_hit", *nxt)
    times = [f.type == "timestamp" for f in rule.fields]
    value = [F.col(f"_f{j}.us" if t else f"_f{j}") for j, t in enumerate(times)]
    fine = F.coalesce(F.col("_hit"), F.lit(False))
    for v in value:
        fine = fine & v.isNotNull()
    out = out.select(*own, fine.alias("_hit"), *[c.alias(f"_f{j}") for j, c in enumerate(value)], (F.col(f"_f{rule.sort_field}") if rule.sort_field is not None else F.lit(None).cast(_KEY)).alias("_key"))
    row = F.struct(*[(F.timestamp_micros(F.col(f"_f{j}")) if t else F.col(f"_f{j}")).alias(f.name) for j, (f, t) in enumerate(zip(rule.fields, times))], F.lit(1).alias("_none"))
    done = {"rule": F.when(F.col("_hit"), F.lit(i)).otherwise(F.col("rule")), "key": F.when(F.col("_hit"), F.col("_key")).otherwise(F.col("key"))}
    return out.select(*[done.get(c, F.col(c)).alias(c) for c in own], F.when(F.col("_hit"), row).alias(f"r{i}"))


# ---- row-wise, for multi-line entries ----------------------------------------------------


def convert(rule: Rule, rules: RuleSet, raw: dict[str, str], source: str, line: int, now: datetime, tz: str):
    """(field texts, key) of captured values, or None; timestamps as microseconds."""
    flat = typed = {}
    if rule.payload:
        preset = translate(PRESETS[rule.payload][0]) if rule.payload not in PAYLOADS else None
        try:
            flat, typed = payload.parse(raw[rule.source], rule.payload, [] if preset else rules.key_masks, preset)
        except payload.PayloadError:
            return None
    used = {f.key for f in rule.fields if f.key}
    out, key = [], None
    for i, f in enumerate(rule.fields):
        if f.meta:
            out.append(source if f.meta == "source_file" else str(line))
            continue
        if f.key:
            if f.key not in flat:
                return None
            v = flat[f.key]
        else:
            v = payload.dumps({k: x for k, x in typed.items() if k not in used}) if f.extra else raw[f.name]
        for q, template in f.replace:
            v = replace_all(translate(q), template, v)
        v = next((value for q, value in f.normalize if translate(q).compiled.search(v)), v)
        if f.type == "int":
            n = values.to_int(v)
        elif f.type == "float":
            n = values.to_float(v)
        elif f.type == "timestamp":
            n = timefmt.parse_value(v, timefmt.resolve(f.format), now, tz)
            if n is not None:
                key = n if i == rule.sort_field else key
                n = n[0]
        else:
            for p, action, value, length in rules.pattern_masks:
                v = mask_value(v, p, action, value, length)
            n = v
        if n is None:
            return None
        out.append(n if isinstance(n, str) else repr(n))
    return out, key


def fold(lines: list[tuple[int, str]], rules: RuleSet, source: str, now: datetime, tz: str):
    """Rows of a run of lines: (line, rule or -1, field texts or the raw text, key)."""
    todo = deque((n, text, 0) for n, text in lines)
    out = []
    entry = None  # (rule index, captures, contributing lines)

    def captures(p, m) -> dict[str, str]:
        return {name: m[i] or "" for name, i in p.named.items()}

    def start(n: int, text: str, at: int) -> None:
        nonlocal entry
        for k in range(at, len(rules.rules)):
            r = rules.rules[k]
            m = r.compiled.compiled.search(text)
            if not m:
                continue
            raw = captures(r.compiled, m)
            if r.continuation:
                entry = (k, raw, [(n, text)])
                return
            if (got := convert(r, rules, raw, source, n, now, tz)) is not None:
                out.append((n, k, *got))
                return
        out.append((n, -1, [text], None))

    def close() -> None:
        nonlocal entry
        k, raw, parts = entry
        entry = None
        n, text = parts[0]
        if (got := convert(rules.rules[k], rules, raw, source, n, now, tz)) is not None:
            out.append((n, k, *got))
            return
        # the first line goes on with the next rule, the others are read anew
        todo.extendleft((a, b, 0) for a, b in reversed(parts[1:]))
        todo.appendleft((n, text, k + 1))

    while todo or entry:
        if not todo:
            close()
            continue
        n, text, at = todo.popleft()
        if entry and at == 0:
            more = rules.rules[entry[0]].more
            if m := more.compiled.search(text):
                for name, v in captures(more, m).items():
                    entry[1][name] += "\n" + v
                entry[2].append((n, text))
                continue
            todo.appendleft((n, text, 0))
            close()
            continue
        start(n, text, at)
    return out


@dataclass
class Parsed:
    """Routed lines: file_index, source, line_no, text, rule (null: rejected), key, r0, r1, ..."""

    lines: DataFrame
    rules: RuleSet

    def _of(self, name: str) -> list[int]:
        return [i for i, r in enumerate(self.rules.rules) if r.name == name]

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(r.name for r in self.rules.rules))

    def ordered(self) -> Parsed:
        return Parsed(emission_order(self.lines, F.col("key")), self.rules)

    def table(self, name: str) -> DataFrame:
        """The typed rows of all rules of a name."""
        at = self._of(name)
        row = F.coalesce(*[F.when(F.col("rule") == i, F.col(f"r{i}")) for i in at])
        out = self.lines.where(F.col("rule").isin(at)).select(row.alias("row"))
        return out.select(*[F.col(f"row.`{f.name}`").alias(f.name) for f in self.rules.rules[at[0]].fields])

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in self.names}

    @property
    def unmatched(self) -> DataFrame:
        text = F.col("text")
        for args in self.rules.pattern_masks:
            text = mask(text, *args)
        return self.lines.where("rule is null").select("source", "line_no", text.alias("text"))

    @property
    def counts(self) -> DataFrame:
        """Rows per file and rule name; the rejected under a null name."""
        names = F.array(*[F.lit(r.name) for r in self.rules.rules])
        return self.lines.groupBy("file_index", F.try_element_at(names, F.col("rule") + 1).alias("rule_name")).agg(F.count(F.lit(1)).alias("n_rows"))


def route(lines: DataFrame, rules: RuleSet, now: datetime, tz: str) -> DataFrame:
    """Every line on its own: rule, key and the rows of each rule.

    The result leaves through a generator: a filter on it (a rule's table, the rejected lines)
    cannot be pushed below, where it would repeat the whole attempt.
    """
    own = lines.columns
    out = lines.withColumn("rule", F.lit(None).cast("int")).withColumn("key", F.lit(None).cast(_KEY))
    for i in range(len(rules.rules)):
        out = attempt(out, i, rules, now, tz)
    new = [c for c in out.columns if c not in own]
    return out.select(*own, F.inline(F.array(F.struct(*new))))


def _typed(rule: Rule, i: int) -> Column:
    """The row of rule i from its field texts."""
    cols = []
    for j, f in enumerate(rule.fields):
        v = F.col("vals")[j]
        c = {"int": v.try_cast("bigint"), "float": v.try_cast("double"), "timestamp": F.timestamp_micros(v.try_cast("bigint"))}.get(f.type, v)
        cols.append(c.alias(f.name))
    return F.when(F.col("rule") == i, F.struct(*cols, F.lit(1).alias("_none"))).alias(f"r{i}")


def parse_lines(lines: DataFrame, rules: RuleSet, now: datetime | None = None, tz: str = "UTC") -> Parsed:
    """Route lines (file_index, source, line_no, text) through a rule set."""
    now = now or datetime.now(timezone.utc)
    lines = lines.select("file_index", "source", "line_no", "text")
    more = [r.more for r in rules.rules if r.continuation]
    if not more:
        return Parsed(route(lines, rules, now, tz), rules)
    goes_on = F.lit(False)
    for p in more:
        goes_on = goes_on | F.col("text").rlike(p.java)
    in_file = Window.partitionBy("file_index").orderBy("line_no")
    cut = lines.withColumn("__on", goes_on).withColumn("__seg", F.sum((~F.col("__on")).cast("bigint")).over(in_file))
    # a line belongs to a run if it goes on, or if the next one does
    cut = cut.withColumn("__run", F.col("__on") | F.coalesce(F.lead("__on").over(in_file), F.lit(False)))
    single = route(cut.where(~F.col("__run")).select(*lines.columns), rules, now, tz)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["file_index", "source", "line_no", "text", "rule", "vals", "key"]).astype({"rule": "Int32"})

    def run(batches):
        # runs are short and many, so they are read as sorted stretches of a partition
        read = (x for pdf in batches for x in zip(pdf["file_index"], pdf["__seg"], pdf["source"], pdf["line_no"], pdf["text"]))
        done = []
        for (index, _), stretch in groupby(read, key=lambda x: x[:2]):
            stretch = list(stretch)
            source = stretch[0][2]
            for n, k, v, key in fold([x[3:] for x in stretch], rules, source, now, tz):
                done.append((index, source, n, v[0] if k < 0 else None, None if k < 0 else k, v, key and {"us": key[0], "ns": key[1]}))
            if len(done) >= 1000:
                yield frame(done)
                done = []
        if done:
            yield frame(done)

    order = ["file_index", "__seg"]
    runs = cut.where("__run").select(*order, "source", "line_no", "text").repartition(*order).sortWithinPartitions(*order, "line_no").mapInPandas(
        run, "file_index int, source string, line_no bigint, text string, rule int, vals array<string>, key struct<us: bigint, ns: smallint>"
    )
    typed = runs.select("file_index", "source", "line_no", "text", "rule", "key", *[_typed(r, i) for i, r in enumerate(rules.rules)])
    return Parsed(single.unionByName(typed), rules)
