"""Token vocabularies: pieces of text with ids, encodings of strings, and lifting of automata to tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphwalk.plans.automaton import Automaton, Infinite, Nfa
from glyphwalk.plans.cut import cut


class Vocabulary:
    """Pieces by id. ``bos`` and ``eos`` are ids of marks that stand for no text."""

    def __init__(self, pieces: dict[str, int], bos: int | None = None, eos: int | None = None, ranks: dict[bytes, int] | None = None):
        if len(set(pieces.values())) != len(pieces):
            raise ValueError("two pieces share an id")
        if {bos, eos} & set(pieces.values()):
            raise ValueError("a mark's id is taken by a piece")
        self.ids, self.bos, self.eos, self.ranks = {p: i for p, i in pieces.items() if p}, bos, eos, ranks
        self.pieces = {i: p for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=0)

    @staticmethod
    def characters(alphabet: str, bos: int = -1, eos: int = 0x110000) -> Vocabulary:
        """One token for each character: its code point."""
        return Vocabulary({c: ord(c) for c in alphabet}, bos, eos)

    @staticmethod
    def from_tiktoken(path: str, eos: int | None = None) -> Vocabulary:
        """A byte-level BPE vocabulary from a file of base64 pieces and ranks; pieces are text in Latin-1, one character a byte."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        return Vocabulary({p.decode("latin-1"): i for p, i in ranks.items()}, None, eos, ranks)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, p, len(p)) for i, p in sorted(self.pieces.items())], "token int, piece string, piece_len int")

    @property
    def size(self) -> int:
        return len(self.ids)

    @cached_property
    def alphabet(self) -> list[str]:
        return sorted(p for p in self.ids if len(p) == 1)

    def with_space(self) -> list[str]:
        return sorted(p for p in self.ids if p.startswith(" "))

    def without_space(self) -> list[str]:
        return sorted(p for p in self.ids if not p.startswith(" "))

    def _text(self, text: str) -> str:
        return text.encode("utf-8", "surrogatepass").decode("latin-1") if self.ranks is not None else text

    def decode(self, tokens) -> str:
        """Text of the tokens; marks stand for nothing."""
        out = "".join(self.pieces[t] for t in tokens if t not in (self.bos, self.eos))
        return out.encode("latin-1").decode("utf-8", "replace") if self.ranks is not None else out

    def encodings(self, text: str) -> Iterator[tuple[int, ...]]:
        """All ways to write ``text`` in pieces; none if a character is unknown."""
        text = self._text(text)
        # Positions from which the end can be reached: no dead ends are walked.
        good = [False] * len(text) + [True]
        for i in range(len(text) - 1, -1, -1):
            good[i] = any(good[j] and text[i:j] in self.ids for j in range(i + 1, min(len(text), i + self.longest) + 1))

        def walk(i: int, path: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
            if i == len(text):
                yield path
                return
            for j in range(i + 1, min(len(text), i + self.longest) + 1):
                if good[j] and text[i:j] in self.ids:
                    yield from walk(j, (*path, self.ids[text[i:j]]))

        return walk(0, ()) if good[0] else iter(())

    def sentence_encodings(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ways to write a sentence in which no piece crosses into the next word (a space belongs to the word after it)."""
        words = text.split(" ")
        parts = [words[0]] * bool(words[0]) + [" " + w for w in words[1:]]

        def walk(i: int) -> Iterator[tuple[int, ...]]:
            if i == len(parts):
                yield ()
                return
            for head in self.encodings(parts[i]):
                for tail in walk(i + 1):
                    yield (*head, *tail)

        return walk(0)

    def canonical(self, text: str) -> tuple[int, ...] | None:
        """The encoding that a tokenizer gives: byte pairs merged by rank, or the longest piece first if there are no ranks."""
        if self.ranks is not None:
            return tuple(self._merged(text.encode("utf-8", "surrogatepass")))
        out, i = [], 0
        while i < len(text):
            for j in range(min(len(text), i + self.longest), i, -1):
                if text[i:j] in self.ids:
                    out.append(self.ids[text[i:j]])
                    i = j
                    break
            else:
                return None
        return tuple(out)

    @cached_property
    def _encoder(self):
        import tiktoken

        #: The fixed split pattern of byte-level BPE.
        split = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("vocabulary", pat_str=split, mergeable_ranks=self.ranks, special_tokens={})

    def _merged(self, raw: bytes) -> list[int]:
        return self._encoder.encode_ordinary(raw.decode("utf-8", "surrogatepass"))

    # --- lifting ------------------------------------------------------------------------------

    def lift(self, a: Automaton) -> Automaton:
        """Token sequences whose text the automaton accepts: every piece that can be followed from a state is an arc."""
        if self.ranks is not None:
            a = to_bytes(a)
        tree: dict = {}
        for p, i in self.ids.items():
            at = tree
            for c in p:
                at = at.setdefault(ord(c), {})
            at[None] = i
        out = Nfa()
        base = [out.state() for _ in a.arcs]
        out.skip(out.start, base[0])
        for s in range(len(a.arcs)):
            stack = [(tree, s)]
            while stack:
                node, at = stack.pop()
                if None in node and node is not tree:
                    out.arc(base[s], node[None], node[None], base[at])
                for lo, hi, dst in a.arcs[at]:
                    if hi - lo < len(node):
                        stack.extend((node[c], dst) for c in range(lo, hi + 1) if c in node)
                    else:
                        stack.extend((sub, dst) for c, sub in node.items() if c is not None and lo <= c <= hi)
        out.finals |= {base[s] for s in a.finals}
        return out.determinize()

    def lift_canonical(self, a: Automaton, max_len: int | None = None) -> Automaton:
        """The canonical encoding of every accepted string of at most ``max_len`` tokens; the language must be finite."""
        if a.is_cyclic:
            raise Infinite("canonical encodings of an infinite language can't be listed; check them during the search")
        texts = (self.canonical(t) for t in a.texts())
        return Automaton.of_strings(t for t in texts if t is not None and (max_len is None or len(t) <= max_len))

    def is_canonical(self, tokens) -> bool:
        return self.canonical(self.decode(tokens)) == tuple(tokens)


def to_bytes(a: Automaton) -> Automaton:
    """The UTF-8 bytes of an automaton over code points."""
    out = Nfa()
    base = [out.state() for _ in a.arcs]
    out.skip(out.start, base[0])

    def spans(lo: int, hi: int) -> Iterator[list[tuple[int, int]]]:
        """Byte ranges, position by position, that together encode lo..hi (same length)."""
        x, y = chr(lo).encode("utf-8", "surrogatepass"), chr(hi).encode("utf-8", "surrogatepass")

        def split(i: int, low: bytes, high: bytes) -> Iterator[list[tuple[int, int]]]:
            if i == len(low) - 1:
                yield [(low[i], high[i])]
            elif low[i] == high[i]:
                for rest in split(i + 1, low, high):
                    yield [(low[i], low[i]), *rest]
            else:
                n = len(low)
                first, last = low[i], high[i]
                if any(b != 0x80 for b in low[i + 1 :]):
                    for rest in split(i + 1, low, low[: i + 1] + b"\xbf" * (n - i - 1)):
                        yield [(first, first), *rest]
                    first += 1
                tail = None
                if any(b != 0xBF for b in high[i + 1 :]):
                    tail = [[(last, last), *rest] for rest in split(i + 1, high[: i + 1] + b"\x80" * (n - i - 1), high)]
                    last -= 1
                if first <= last:
                    yield [(first, last), *[(0x80, 0xBF)] * (n - i - 1)]
                yield from tail or ()

        yield from split(0, x, y)

    for s, arcs in enumerate(a.arcs):
        for lo, hi, dst in arcs:
            for a0, b0 in ((0, 0x7F), (0x80, 0x7FF), (0x800, 0xFFFF), (0x10000, 0x10FFFF)):
                if max(lo, a0) <= min(hi, b0):
                    for chain in spans(max(lo, a0), min(hi, b0)):
                        at = base[s]
                        for x, y in chain[:-1]:
                            out.arc(at, x, y, after := out.state())
                            at = after
                        out.arc(at, *chain[-1], base[dst])
    out.finals |= {base[s] for s in a.finals}
    return out.determinize()


# --- on DataFrames ----------------------------------------------------------------------------


def characters_of(text: Column) -> Column:
    """Array of the characters of a string."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def tokenizations(texts: DataFrame, vocab: DataFrame, text: str = "text", max_piece: int = 32) -> DataFrame:
    """(text, tokens) for all ways to write each distinct text in pieces, level by level.

    Each round joins what is left of a text with the vocabulary on the piece's own text, so the
    join is on equality; ``max_piece`` is the longest piece that is tried.
    """
    longest = vocab.agg(F.max("piece_len")).first()[0] or 0
    lengths = F.array(*[F.lit(i) for i in range(1, min(longest, max_piece) + 1)]) if longest else F.array().cast("array<int>")
    here = cut(texts.select(F.col(text).alias("text")).where("text is not null").distinct().select("text", F.col("text").alias("rest"), F.array().cast("array<int>").alias("tokens")))
    done = []
    while True:
        done.append(here.where("rest = ''").select("text", "tokens"))
        tried = here.where("rest <> ''").select("text", "rest", "tokens", F.explode(F.filter(lengths, lambda n: n <= F.length("rest"))).alias("n"))
        tried = tried.withColumn("piece", F.expr("substring(rest, 1, n)"))
        here = cut(tried.join(vocab.select("piece", "token"), "piece").select("text", F.expr("substring(rest, n + 1)").alias("rest"), F.array_append("tokens", F.col("token")).alias("tokens")))
        if here.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def lift_edges(edges: DataFrame, vocab: DataFrame) -> DataFrame:
    """(src, token, dst): arcs of every piece from every state, from character arcs (src, lo, hi, dst).

    Pieces advance together, one character a round: a range join with the arcs, which are
    broadcast while they are few (they come from a pattern), never a walk per piece.
    """
    small = edges.count() <= 1_000_000
    near = F.broadcast if small else lambda df: df
    arcs = edges.select(F.col("src").alias("at"), "lo", "hi", "dst")
    chars = vocab.select("token", "piece_len", characters_of(F.col("piece")).alias("chars"))
    longest = vocab.agg(F.max("piece_len")).first()[0] or 0
    code = F.ascii(F.element_at("chars", 1))
    here = chars.join(near(arcs), (code >= F.col("lo")) & (code <= F.col("hi"))).select("token", "piece_len", "chars", F.col("at").alias("src"), F.col("dst").alias("to"))
    here = cut(here)
    out = [here.where("piece_len = 1")]
    for i in range(2, longest + 1):
        code = F.ascii(F.element_at("chars", i))
        here = cut(
            here.where(F.col("piece_len") >= i).join(near(arcs), (F.col("to") == F.col("at")) & (code >= F.col("lo")) & (code <= F.col("hi")))
            .select("token", "piece_len", "chars", "src", F.col("dst").alias("to"))
        )
        out.append(here.where(F.col("piece_len") == i))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found.select("src", "token", F.col("to").alias("dst"))
