"""Translation of RE2-family patterns and templates for java.util.regex (Spark) and Python.

Rule patterns follow RE2: linear-time syntax without look-around, back-references or possessive
quantifiers, `$` as the end of text, ASCII `\\s`, `\\w` and `\\b`, and (?P<name>) groups.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import regex as _re

_WORD = "0-9A-Za-z_"
_AT_WORD = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_NOT_AT_WORD = rf"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))"
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": _WORD, "xdigit": "0-9A-Fa-f",
}
_SPACE = r"\t\n\f\r "


class PatternError(ValueError):
    pass


@dataclass(frozen=True)
class Pattern:
    source: str
    java: str
    python: str
    names: tuple[str, ...]  # per group, "" for unnamed

    def index(self, name: str) -> int | None:
        """Group number of a name; the last of equal names."""
        at = [i for i, n in enumerate(self.names, 1) if n == name]
        return at[-1] if at else None

    @property
    def named(self) -> dict[str, int]:
        return {n: i for i, n in enumerate(self.names, 1) if n}

    @property
    def compiled(self):
        return _compiled(self.python)

    @property
    def may_be_empty(self) -> bool:
        return self.compiled.search("") is not None or any(self.compiled.match(x, 0, 0) for x in ("a", "0", " "))


@lru_cache(maxsize=4096)
def _compiled(p: str):
    return _re.compile(p, _re.VERSION0)


class _Reader:
    def __init__(self, text: str, java: bool):
        self.s, self.i, self.java, self.names = text, 0, java, []

    def fail(self, what: str):
        raise PatternError(f"error parsing regexp: {what}: `{self.s}`")

    def escape(self, in_class: bool) -> str:
        s = self.s
        if self.i + 1 >= len(s):
            self.fail("trailing backslash at end of expression")
        c = s[self.i + 1]
        self.i += 2
        if c in "pP":
            if self.i < len(s) and s[self.i] == "{":
                end = s.find("}", self.i)
                if end < 0:
                    self.fail("invalid character class range")
                name = s[self.i + 1 : end]
                self.i = end + 1
            else:
                name = s[self.i : self.i + 1]
                self.i += 1
            if name.startswith("^"):
                c, name = ("P" if c == "p" else "p"), name[1:]
            if len(name) > 2 and self.java:
                name = f"Is{name}"
            return rf"\{c}{{{name}}}"
        if c == "s":
            return _SPACE if in_class else f"[{_SPACE}]"
        if c == "S":
            return f"[^{_SPACE}]" if self.java or not in_class else r"\S\x0B"
        if c in "dDwW":
            ascii_only = {"d": "0-9", "w": _WORD}[c.lower()]
            if self.java:
                return rf"\{c}"
            if c in "dw":
                return ascii_only if in_class else f"[{ascii_only}]"
            if in_class:
                self.fail("a negated class within a class")
            return f"[^{ascii_only}]"
        if c in "bB" and not in_class:
            return _AT_WORD if c == "b" else _NOT_AT_WORD
        if c == "A" and not in_class:
            return r"\A"
        if c == "z" and not in_class:
            return r"\z" if self.java else r"\Z"
        if c == "Q":
            end = s.find(r"\E", self.i)
            text = s[self.i : end if end >= 0 else len(s)]
            self.i = end + 2 if end >= 0 else len(s)
            return "".join(self.literal(x) for x in text)
        if c == "v":
            return r"\x0B"
        if c == "a":
            return r"\x07"
        if c in "tnfr":
            return rf"\{c}"
        if c == "x":
            if self.i < len(s) and s[self.i] == "{":
                end = s.find("}", self.i)
                digits = s[self.i + 1 : end]
                self.i = end + 1
            else:
                digits = s[self.i : self.i + 2]
                self.i += 2
            try:
                return self.literal(chr(int(digits, 16)))
            except ValueError:
                self.fail("invalid escape sequence")
        if c == "0" or (c in "1234567" and s[self.i : self.i + 1] in tuple("01234567")):
            digits = c
            while len(digits) < 3 and s[self.i : self.i + 1] in tuple("01234567"):
                digits += s[self.i]
                self.i += 1
            return self.literal(chr(int(digits, 8)))
        if c.isalnum():
            self.fail(f"invalid escape sequence: `\\{c}`")
        return self.literal(c)

    def literal(self, c: str) -> str:
        if ord(c) < 128 and not c.isalnum() and c not in " \n\t\r":
            return "\\" + c
        return c

    def cls(self) -> str:
        s, out = self.s, "["
        self.i += 1
        if s[self.i : self.i + 1] == "^":
            out += "^"
            self.i += 1
        first = True
        while True:
            if self.i >= len(s):
                self.fail("missing closing ]")
            c = s[self.i]
            if c == "]" and not first:
                self.i += 1
                return out + "]"
            first = False
            if s.startswith("[:", self.i) and (end := s.find(":]", self.i)) > 0:
                name = s[self.i + 2 : end]
                self.i = end + 2
                if name.lstrip("^") not in _POSIX:
                    self.fail(f"invalid character class range: `[:{name}:]`")
                inner = _POSIX[name.lstrip("^")]
                if name.startswith("^") and not self.java:
                    self.fail("a negated class within a class")
                out += f"[^{inner}]" if name.startswith("^") else inner
            elif c == "\\":
                if s[self.i + 1 : self.i + 2] == "b":
                    self.i += 2
                    out += r"\x08"
                else:
                    out += self.escape(True)
            else:
                self.i += 1
                out += "\\" + c if c in "[&~|^]" else c

    def run(self) -> str:
        s, out = self.s, []
        flags = [frozenset()]
        can_repeat = repeated = False
        while self.i < len(s):
            c = s[self.i]
            if c == "\\":
                out.append(self.escape(False))
                can_repeat, repeated = True, False
                continue
            if c == "[":
                out.append(self.cls())
                can_repeat, repeated = True, False
                continue
            if c == "(":
                m = _re.compile(r"\(\?P?<([A-Za-z_0-9]+)>").match(s, self.i)
                if m:
                    if m[1] in self.names:
                        self.fail(f"duplicate capture group name: `{m[1]}`")
                    self.names.append(m[1])
                    out.append("(")
                    self.i = m.end()
                    flags.append(flags[-1])
                elif s.startswith("(?", self.i):
                    m = _re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])").match(s, self.i)
                    if not m:
                        self.fail(f"invalid or unsupported Perl syntax: `{s[self.i : self.i + 4]}`")
                    on, off = set(m[1]), set(m[2] or "")
                    if "U" in on | off:
                        self.fail("unsupported flag: U")
                    now = frozenset((flags[-1] | on) - off)
                    extra = "".join(x + ("u" if x == "i" and self.java else "") for x in "ims" if x in on)
                    less = "".join(x for x in "ims" if x in off)
                    text = extra + (f"-{less}" if less else "")
                    if m[3] == ":":
                        out.append(f"(?{text}:")
                        flags.append(now)
                    else:
                        # the rest of the group
                        flags[-1] = now
                        if self.java:
                            out.append(f"(?{text})" if text else "")
                        else:
                            # Python scopes flags by groups only
                            rest = _Reader(s, False)
                            rest.i, rest.names = m.end(), self.names
                            raise _Scoped(text, m.start(), m.end())
                    self.i = m.end()
                else:
                    self.names.append("")
                    out.append("(")
                    self.i += 1
                    flags.append(flags[-1])
                can_repeat = repeated = False
                continue
            if c == ")":
                if len(flags) == 1:
                    self.fail("unexpected )")
                flags.pop()
                out.append(")")
                self.i += 1
                can_repeat, repeated = True, False
                continue
            m = _re.compile(r"[*+?]|\{(\d+)(?:,(\d*))?\}").match(s, self.i)
            if m:
                if not can_repeat:
                    self.fail("missing argument to repetition operator: `" + m[0] + "`")
                if repeated:
                    self.fail("invalid nested repetition operator: `" + m[0] + "`")
                if m[1] and max(int(m[1]), int(m[2] or 0)) > 1000:
                    self.fail("invalid repeat count: `" + m[0] + "`")
                self.i = m.end()
                lazy = s[self.i : self.i + 1] == "?"
                self.i += lazy
                out.append(m[0] + ("?" if lazy else ""))
                repeated = True
                continue
            can_repeat, repeated = c not in "^|", False
            if c == "$" and "m" not in flags[-1]:
                out.append(r"\z" if self.java else r"\Z")
            elif c == "{" or c == "}":
                out.append("\\" + c)
            else:
                out.append(c)
            self.i += 1
        if len(flags) > 1:
            self.fail("missing closing )")
        return "".join(out)


class _Scoped(Exception):
    def __init__(self, text: str, start: int, end: int):
        self.text, self.start, self.end = text, start, end


def _group_end(s: str, at: int) -> int:
    depth = 0
    while at < len(s):
        if s[at] == "\\":
            at += 1
        elif s[at] == "[":
            at = _re.compile(r"\[\^?\]?(?:\\.|\[:\^?\w+:\]|[^\]])*\]").match(s, at).end() - 1
        elif s[at] == "(":
            depth += 1
        elif s[at] == ")":
            if depth == 0:
                return at
            depth -= 1
        at += 1
    return at


def _python(pattern: str) -> str:
    while True:
        try:
            return _Reader(pattern, False).run()
        except _Scoped as e:
            # (?i)rest -> (?i:rest), up to the end of the group
            end = _group_end(pattern, e.end)
            inner = f"(?{e.text}:{pattern[e.end : end]})" if e.text else pattern[e.end : end]
            pattern = pattern[: e.start] + inner + pattern[end:]


@lru_cache(maxsize=4096)
def translate(pattern: str) -> Pattern:
    """Both forms of a pattern; PatternError where RE2 would refuse it."""
    r = _Reader(pattern, True)
    java = "(?d)" + r.run()
    out = Pattern(pattern, java, _python(pattern), tuple(r.names))
    try:
        out.compiled  # noqa: B018
    except _re.error as e:
        raise PatternError(f"error parsing regexp: {e}: `{pattern}`") from None
    return out


_REFERENCE = _re.compile(r"\$(?:\$|\{(\w+)\}|(\w+))")


def template_parts(p: Pattern, template: str) -> list[str | int]:
    """A replacement template as literal strings and group numbers; unknown groups are empty."""
    out: list[str | int] = []
    at = 0
    for m in _REFERENCE.finditer(template):
        out.append(template[at : m.start()])
        at = m.end()
        if m[0] == "$$":
            out.append("$")
            continue
        name = m[1] or m[2]
        if name.isdigit():
            if int(name) <= len(p.names):
                out.append(int(name))
        elif (i := p.index(name)) is not None:
            out.append(i)
    out.append(template[at:])
    return [x for x in out if x != ""]


def java_template(p: Pattern, template: str) -> str:
    """The template for regexp_replace: literals escaped, so no digit joins a group number."""
    return "".join(f"${x}" if isinstance(x, int) else "".join("\\" + c if c in "\\$" or c.isdigit() else c for c in x) for x in template_parts(p, template))


def replace_all(p: Pattern, template: str, text: str) -> str:
    """Replacement as RE2 does it: an empty match that abuts the preceding match is skipped."""
    parts, out, at, last = template_parts(p, template), [], 0, -1
    for m in p.compiled.finditer(text):
        if m.start() == m.end() == last:
            continue
        out.append(text[at : m.start()])
        out += [(m[x] or "") if isinstance(x, int) else x for x in parts]
        at = last = m.end()
    return "".join(out) + text[at:]
