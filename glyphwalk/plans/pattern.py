"""Pattern language: text to a syntax tree of code-point ranges, and back to a Java pattern.

Patterns match whole strings. The dialect: literals, escapes (\\n \\t \\r \\f \\v \\0 \\xHH \\x{H..}
\\uHHHH \\u{H..}), classes with ranges, negation, POSIX names and nested escapes, ``.`` (anything but
a line feed), \\d \\w \\s and their negations (Unicode by default, ASCII on demand), groups
(plain, ``?:``, named), alternation, and ``? * + {m} {m,} {m,n}``. Anchors, word boundaries and
non-greedy repetition have no meaning for whole strings and raise ``PatternUnsupported``.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

LAST = 0x10FFFF
Ranges = tuple[tuple[int, int], ...]


class PatternError(ValueError):
    """The pattern is not well formed."""


class PatternUnsupported(PatternError):
    """The construct has no meaning for whole-string patterns."""


@dataclass(frozen=True)
class Empty:
    """Matches the empty string."""


@dataclass(frozen=True)
class Chars:
    """One code point of any of the ranges; no ranges: nothing matches."""

    ranges: Ranges


@dataclass(frozen=True)
class Concat:
    parts: tuple


@dataclass(frozen=True)
class Alternatives:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    inner: object
    least: int
    most: int | None


Node = Empty | Chars | Concat | Alternatives | Repeat


def normalize(ranges) -> Ranges:
    """Sorted, disjoint and joined ranges."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple((a, b) for a, b in out)


def invert(ranges) -> Ranges:
    out, at = [], 0
    for lo, hi in normalize(ranges):
        if lo > at:
            out.append((at, lo - 1))
        at = hi + 1
    if at <= LAST:
        out.append((at, LAST))
    return tuple(out)


@lru_cache(maxsize=8)
def _unicode_class(kind: str) -> Ranges:
    def inside(c: str) -> bool:
        category = unicodedata.category(c)
        if kind == "d":
            return category == "Nd"
        if kind == "s":
            return c.isspace() and c not in "\x1c\x1d\x1e\x1f"
        return category[0] in "LM" or category in ("Nd", "Nl", "Pc") or c in "‌‍"

    return normalize((i, i) for i in range(LAST + 1) if not 0xD800 <= i <= 0xDFFF and inside(chr(i)))


def _of(text: str) -> Ranges:
    return normalize((ord(c), ord(c)) for c in text)


DIGIT, LOWER, UPPER = ((48, 57),), ((97, 122),), ((65, 90),)
ASCII = {"d": DIGIT, "s": _of(" \t\n\r\f\v"), "w": normalize([*DIGIT, *LOWER, *UPPER, (95, 95)])}
#: The fixed POSIX class names.
POSIX = {
    "alnum": normalize([*DIGIT, *LOWER, *UPPER]), "alpha": normalize([*LOWER, *UPPER]), "ascii": ((0, 127),), "blank": _of(" \t"),
    "cntrl": ((0, 31), (127, 127)), "digit": DIGIT, "graph": ((33, 126),), "lower": LOWER, "print": ((32, 126),),
    "punct": ((33, 47), (58, 64), (91, 96), (123, 126)), "space": ASCII["s"], "upper": UPPER, "word": ASCII["w"], "xdigit": ((48, 57), (65, 70), (97, 102)),
}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "0": "\0", "a": "\a", "e": "\x1b"}


class _Parser:
    def __init__(self, text: str, unicode: bool):
        self.text, self.at, self.unicode = text, 0, unicode

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise PatternError(f"pattern ends early: {self.text!r}")
        self.at += 1
        return self.text[self.at - 1]

    def parse(self) -> Node:
        node = self.alternatives()
        if self.at < len(self.text):
            raise PatternError(f"unmatched ) at {self.at} in {self.text!r}")
        return node

    def alternatives(self) -> Node:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else Alternatives(tuple(parts))

    def sequence(self) -> Node:
        parts: list[Node] = []
        while self.at < len(self.text) and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return Empty() if not parts else parts[0] if len(parts) == 1 else Concat(tuple(parts))

    def repeated(self, node: Node) -> Node:
        while (c := self.peek()) and (c in "?*+" or c == "{"):
            start = self.at
            self.take()
            if c == "{":
                least, comma, most = self._until("}").partition(",")
                if not least.isdigit() or (most and not most.isdigit()):
                    raise PatternError(f"bad repetition at {start} in {self.text!r}")
                bounds = (int(least), int(most) if most else None if comma else int(least))
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            if bounds[1] is not None and bounds[1] < bounds[0]:
                raise PatternError(f"repetition {bounds} is empty in {self.text!r}")
            if self.peek() == "?":
                raise PatternUnsupported(f"non-greedy repetition in {self.text!r}")
            node = Repeat(node, *bounds)
        return node

    def _until(self, end: str) -> str:
        stop = self.text.find(end, self.at)
        if stop < 0:
            raise PatternError(f"{end!r} is missing in {self.text!r}")
        out, self.at = self.text[self.at : stop], stop + len(end)
        return out

    def atom(self) -> Node:
        c = self.take()
        if c == "(":
            if self.peek() == "?":
                self.take()
                if self.peek() == ":":
                    self.take()
                elif self.peek(2) in ("P<", "<a") or self.peek() == "<" and self.peek(2) not in ("<=", "<!"):
                    self._until(">")
                else:
                    raise PatternUnsupported(f"group (?{self.peek()} in {self.text!r}")
            node = self.alternatives()
            if self.peek() != ")":
                raise PatternError(f") is missing in {self.text!r}")
            self.take()
            return node
        if c == "[":
            return Chars(self.char_class())
        if c == ".":
            return Chars(invert([(10, 10)]))
        if c in "^$":
            raise PatternUnsupported(f"anchor {c} in {self.text!r}")
        if c in "?*+{":
            raise PatternError(f"nothing to repeat at {self.at - 1} in {self.text!r}")
        return Chars(self.escape()) if c == "\\" else Chars(_of(c))

    def escape(self) -> Ranges:
        c = self.take()
        if c.lower() in "dws":
            ranges = _unicode_class(c.lower()) if self.unicode else ASCII[c.lower()]
            return ranges if c.islower() else invert(ranges)
        if c in "bBAzZG":
            raise PatternUnsupported(f"\\{c} in {self.text!r}")
        if c in "xuU":
            digits = self._until("}") if self.peek() == "{" and self.take() else "".join(self.take() for _ in range({"x": 2, "u": 4, "U": 8}[c]))
            try:
                return ((int(digits, 16),) * 2,)
            except ValueError:
                raise PatternError(f"bad code point {digits!r} in {self.text!r}") from None
        if c in ESCAPES:
            return _of(ESCAPES[c])
        if c.isalnum():
            raise PatternUnsupported(f"\\{c} in {self.text!r}")
        return _of(c)

    def char_class(self) -> Ranges:
        negate = self.peek() == "^" and bool(self.take())
        ranges: list[tuple[int, int]] = []
        first = True
        while first or self.peek() != "]":
            first = False
            if self.peek() == "[":
                self.take()
                if self.peek() == ":":
                    self.take()
                    name = self._until(":]")
                    out = name.removeprefix("^")
                    if out not in POSIX:
                        raise PatternError(f"no class {name} in {self.text!r}")
                    ranges += POSIX[out] if out == name else invert(POSIX[out])
                else:
                    ranges += self.char_class()
                continue
            low = self.class_item()
            if self.peek() == "-" and self.peek(2) not in ("-]", "-"):
                self.take()
                high = self.class_item()
                if len(low) != 1 or len(high) != 1 or low[0][0] != low[0][1] or high[0][0] != high[0][1] or high[0][0] < low[0][0]:
                    raise PatternError(f"bad range in {self.text!r}")
                low = ((low[0][0], high[0][0]),)
            ranges += low
        self.take()
        return invert(ranges) if negate else normalize(ranges)

    def class_item(self) -> Ranges:
        c = self.take()
        return self.escape() if c == "\\" else _of(c)


@lru_cache(maxsize=512)
def parse(pattern: str, unicode: bool = True) -> Node:
    return _Parser(pattern, unicode).parse()


def literal(text: str) -> str:
    """A pattern that matches just this text."""
    return "".join("\\" + c if c in "\\.+*?()|[]{}^$-#&~" else c for c in text)


def to_java(node: Node) -> str:
    """The same language as a Java pattern, in explicit code points: no dialect is left to differ."""
    match node:
        case Empty():
            return "(?:)"
        case Chars(ranges=()):
            return r"[^\x{0}-\x{10FFFF}]"
        case Chars(ranges=ranges):
            return "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in ranges) + "]"
        case Concat(parts=parts):
            return "".join(to_java(p) for p in parts)
        case Alternatives(parts=parts):
            return "(?:" + "|".join(to_java(p) for p in parts) + ")"
        case Repeat(inner=inner, least=least, most=most):
            return f"(?:{to_java(inner)}){{{least},{'' if most is None else most}}}"
    raise TypeError(node)


def java_full_match(pattern: str, unicode: bool = True) -> str:
    """A pattern for ``rlike`` that holds for whole strings in this dialect."""
    return rf"\A(?:{to_java(parse(pattern, unicode))})\z"


def explain(node: Node, depth: int = 0) -> str:
    """The tree as indented text."""
    pad = "  " * depth
    match node:
        case Empty():
            return f"{pad}empty\n"
        case Chars(ranges=ranges):
            shown = " ".join(chr(a) if a == b and chr(a).isprintable() else f"{a:x}-{b:x}" for a, b in ranges[:8])
            return f"{pad}chars {shown}{' ...' * (len(ranges) > 8)}\n"
        case Concat(parts=parts):
            return f"{pad}concat\n" + "".join(explain(p, depth + 1) for p in parts)
        case Alternatives(parts=parts):
            return f"{pad}alternatives\n" + "".join(explain(p, depth + 1) for p in parts)
        case Repeat(inner=inner, least=least, most=most):
            return f"{pad}repeat {least}..{'' if most is None else most}\n" + explain(inner, depth + 1)
    raise TypeError(node)


def cardinality(node: Node) -> int | None:
    """Number of ways to choose a string from the tree (alternatives that agree count twice); None: infinite."""
    match node:
        case Empty():
            return 1
        case Chars(ranges=ranges):
            return sum(b - a + 1 for a, b in ranges)
        case Concat(parts=parts):
            counts = [cardinality(p) for p in parts]
            if 0 in counts:
                return 0
            out = 1
            for c in counts:
                out = None if c is None or out is None else out * c
            return out
        case Alternatives(parts=parts):
            counts = [cardinality(p) for p in parts]
            return None if None in counts else sum(counts)
        case Repeat(inner=inner, least=least, most=most):
            n = cardinality(inner)
            if n == 0:
                return int(least == 0)
            if most is None or n is None:
                return 1 if most == 0 else None
            return sum(n**i for i in range(least, most + 1))
    raise TypeError(node)
