"""URL filter: all glob rules are simulated at once by a bit-parallel automaton.

Every rule is a pattern over the canonical URL ``.host 0xFF path`` (0xFF is no UTF-8 byte, so a
star for subdomains can't reach into the path). The patterns' characters are packed one per bit
into as many 64-bit words as needed; one Shift-And step moves every pattern over one byte, and
steps run over a whole batch of URLs at a time, a row of state words for each.

    state = ((state << 1 | starts) & mask[byte]) | (state & loops & any)

A star is a loop on the bit before it. A rule fits if the bit of its last character is set; rules
match prefixes of the path, so accepted bits are gathered on the way. Rules are constants of the
job (their number is bounded by the list given), so they travel with the task.

Null URLs, and those without ``://``, have empty host and path and get the default verdict. Of two
rules that fit, the longer wins, then the earlier. Rows are judged one by one: ties, repeated rows
and empty tables need no case of their own, and other columns are kept out of the way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
SEPARATOR = 0xFF
#: (host and path, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Globs over the canonical URL (host, path) that judge what no rule fits: words in hosts, kinds of hosts, files that are no pages, paths of machinery.
GLOBS = (
    *((f"*{word}*", "*", "block") for word in ("casino", "poker", "gambling", "lottery", "escort", "warez", "torrent", "payday", "viagra")),
    *((f"{kind}.*", "*", "block") for kind in ("ads", "ad", "adserver", "banner", "tracker", "click")),
    *(("*", f"/*.{end}", "block") for end in ("exe", "zip", "msi", "dmg", "iso", "apk", "rar", "gz", "7z", "bin", "dll", "mp4", "avi", "mp3")),
    *(("*", f"/{path}", "block") for path in ("*/wp-admin/*", "*/wp-login*", "cgi-bin/*", "*/login", "*/logout", "*/signup", "*/cart/*", "*/checkout/*", "*/print/*")),
)


def host_path(url: str | None) -> tuple[str, str]:
    """Host in lower case and path, as the rules read them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_pattern(rule: str) -> list[int]:
    """Canonical pattern of ``host/path``: the host and its subdomains, any continuation."""
    host, _, path = rule.partition("/")
    return [-1, *b".", *host.lower().encode(), SEPARATOR, *f"/{path}".encode()]


def glob_pattern(host: str, path: str) -> list[int]:
    """As rule_pattern, for globs; -1 is a star. The path must match to its end."""
    star = lambda s: [x for i, part in enumerate(s.split("*")) for x in ([-1] if i else []) + list(part.encode())]
    return [*b".", *star(host.lower()), SEPARATOR, *star(path), 0xFE]


class ShiftAnd:
    """Patterns of bytes and stars (-1), packed into masks over 64-bit words."""

    def __init__(self, patterns: Sequence[list[int]]):
        bits = sum(sum(c >= 0 for c in p) for p in patterns)
        self.words = max(1, -(-bits // 64))
        self.mask = np.zeros((256, self.words), U)
        self.first, self.loop = np.zeros(self.words, U), np.zeros(self.words, U)
        self.always = np.zeros(self.words, U)
        self.last: list[tuple[int, int]] = []
        at = 0
        one = lambda i: (i // 64, U(1) << U(i % 64))
        for p in patterns:
            begin = at
            for i, c in enumerate(p):
                if c >= 0:
                    w, b = one(at)
                    self.mask[c, w] |= b
                    if at == begin:
                        self.first[w] |= b
                        if i and p[i - 1] < 0:
                            self.always[w] |= b
                    elif p[i - 1] < 0:
                        pw, pb = one(at - 1)
                        self.loop[pw] |= pb
                    at += 1
            self.last.append(one(at - 1) if at > begin else (0, U(0)))
        self.begins = self.first.copy()

    def run(self, texts: list[bytes]) -> np.ndarray:
        """Which patterns matched, ending anywhere in the text: (texts, patterns)."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order])
        longest = int(lengths[0]) if len(lengths) else 0
        state = np.zeros((len(texts), self.words), U)
        seen = np.zeros_like(state)
        for begin in range(0, longest, 4096):
            alive = int(np.searchsorted(-lengths, -begin))  # those longer than begin
            block = np.zeros((alive, min(4096, longest - begin)), np.uint8)
            for r in range(alive):
                part = texts[order[r]][begin : begin + 4096]
                block[r, : len(part)] = np.frombuffer(part, np.uint8)
            for j in range(block.shape[1]):
                n = int(np.searchsorted(-lengths, -(begin + j)))
                s = state[:n]
                moved = s << U(1)
                moved[:, 1:] |= s[:, :-1] >> U(63)
                # A bit that left one pattern's end must not enter the next pattern.
                moved &= ~self.begins
                moved |= self.first if begin + j == 0 else self.always
                moved &= self.mask[block[:n, j]]
                moved |= s & self.loop
                state[:n] = moved
                seen[:n] |= moved
        out = np.zeros((len(texts), len(self.last)), bool)
        for k, (w, b) in enumerate(self.last):
            out[order, k] = (seen[:, w] & b) != 0
        return out


def judge(urls: Sequence[str | None], rules=RULES, globs=GLOBS, default: str = "allow") -> pd.DataFrame:
    """host, path, rule and verdict of each URL."""
    parts = [host_path(u) for u in urls]
    canonical = [b"." + h.encode("utf-8", "surrogatepass") + b"\xff" + p.encode("utf-8", "surrogatepass") + b"\xfe" for h, p in parts]
    automaton = ShiftAnd([*[rule_pattern(r) for r, _ in rules], *[glob_pattern(h, p) for h, p, _ in globs]])
    hit = automaton.run(canonical)
    best = sorted(range(len(rules)), key=lambda i: (-len(rules[i][0]), i))
    rule, verdict = [], []
    for row in hit:
        k = next((i for i in best if row[i]), None)
        rule.append(None if k is None else rules[k][0])
        g = next((v for i, (_, _, v) in enumerate(globs) if row[len(rules) + i]), default)
        verdict.append(g if k is None else rules[k][1])
    return pd.DataFrame({"host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": pd.Series(rule, dtype=object), "verdict": verdict})


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, globs=GLOBS, default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for each row. Batches are bounded by rows and by bytes."""
    kind = dict(pages.dtypes)[id_col]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for begin in range(0, whole.num_rows, 2000):
                part = whole.slice(begin, 2000)
                out = judge(part.column(1).to_pylist(), rules, globs, default)
                columns = [part.column(0), *[pa.array(out[c].tolist(), pa.string()) for c in out.columns]]
                yield pa.RecordBatch.from_arrays(columns, [id_col, *out.columns])

    return pages.select(F.col(id_col), F.col(url_col).alias("__url")).mapInArrow(
        run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string"
    )
