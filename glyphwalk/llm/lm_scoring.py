"""LM scoring by prediction by partial matching over bytes.

The model is a context trie: counts of the byte after every context of up to ``ORDER`` bytes, from
all training texts. A byte is predicted in the longest context seen; a byte that is new there costs
an escape (method D: each distinct symbol gives half a count to what is novel) and is looked up in
the next shorter context, from which the symbols of the longer one are excluded. What no context
knows is uniform over the rest of the alphabet. Every distribution sums to one.

Texts are lower-cased (A-Z), begin after ``ORDER`` start marks and end with an end mark. 0xFE and
0xFF are no UTF-8 bytes and serve as marks.

Distribution: texts are packed into blocks of about 12 MB that are written once. A block lists the
distinct (ORDER + 1)-grams and word hashes it needs, with its training counts, split into parts by
a hash of the key and packed as differences of sorted keys. Parts are merged as a stream, so memory
follows a part's distinct keys. The trie is evaluated where its parts meet: all contexts that share
their last two bytes meet in one group, for which only the orders 0 and 1 are needed from outside
(65,536 counts at most). Pairs of bytes with more than a part's share of the grams are split by the byte before
them; their contexts of order 2 are counted outside too (256 counts for each of at most as many pairs
as there are parts). Each part then holds its costs against the blocks' requests, again as a
stream, and sends values only: blocks know their own keys. Neither the trie nor any table that
grows is broadcast or collected; what is gathered grows with the corpus. Costs travel as 32-bit
floats (7 digits each) and are added as 64-bit ones.

Words are keyed by a 64-bit hash. Null texts are empty, null ids count as the empty string for
the split, repeated rows are texts of their own; without training texts every symbol is uniform. A
text longer than a block is a block of its own and is scored whole. An empty table gives an empty result.
Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphwalk.llm._blocks import blocks, pack, trim, unpack
from glyphwalk.llm._text import LOWER, batches, mix, word_hashes
from glyphwalk.plans.cut import cut

ORDER = 5
START, END, ALPHABET = 0xFE, 0xFF, 255
BLOCK = 12 << 20
GRAM, WORD, PAYLOAD = 0, 1, 2


class Trie:
    """The same model one text at a time in plain Python: adaptive code lengths, and the tests' oracle."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, defaultdict(lambda: defaultdict(int))

    def symbols(self, text: str | None) -> list[int]:
        return [START] * self.order + list((text or "").encode("utf-8", "surrogatepass").lower()) + [END]

    def learn(self, context: bytes, symbol: int) -> None:
        for k in range(self.order + 1):
            self.counts[context[self.order - k :]][symbol] += 1

    def log10(self, context: bytes, symbol: int) -> float:
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            seen = self.counts.get(context[self.order - k :])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            if left:
                total = 2 * sum(left.values())
                if symbol in left:
                    return out + float(np.log10((2 * left[symbol] - 1) / total))
                out += float(np.log10(len(left) / total))
            excluded = set(seen)
        return out - float(np.log10(ALPHABET - len(excluded)))

    def score(self, text: str | None, learn: bool = False) -> float:
        s, out = self.symbols(text), 0.0
        for i in range(self.order, len(s)):
            context = bytes(s[i - self.order : i])
            out += self.log10(context, s[i])
            if learn:
                self.learn(context, s[i])
        return out

    def train(self, text: str | None) -> None:
        s = self.symbols(text)
        for i in range(self.order, len(s)):
            self.learn(bytes(s[i - self.order : i]), s[i])


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def symbols_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts with their marks, and where each text begins (one more at the end)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(x for r in raw for x in (b"\xfe" * ORDER, r, b"\xff")), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) + ORDER + 1 for r in raw], dtype=np.int64)])
    return LOWER[data], offsets


def gram_ids(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the (ORDER + 1)-gram at each symbol, and the gram of each id; ids are in gram order.

    Ids grow byte by byte: a table over (id of the first bytes, next byte) renumbers what occurs.
    """
    n = max(0, len(data) - ORDER)
    alphabet, narrow = np.flatnonzero(np.bincount(data, minlength=256)), np.zeros(256, np.int32)
    narrow[alphabet] = np.arange(len(alphabet))
    small = narrow[data]
    ids, grams = small[:n].copy(), alphabet.astype(np.int64)
    for j in range(1, ORDER + 1):
        cells = len(grams) * len(alphabet)
        if cells <= 1 << 26:
            ids *= np.int32(len(alphabet))
            ids += small[j : j + n]
            seen = np.zeros(cells, bool)
            seen[ids] = True
            keep = np.flatnonzero(seen)
            table = np.zeros(cells, np.int32)
            table[keep] = np.arange(len(keep), dtype=np.int32)
            ids = table[ids]
        else:
            keep, ids = np.unique(ids.astype(np.int64) * len(alphabet) + small[j : j + n], return_inverse=True)
            ids = ids.astype(np.int32)
        grams = (grams[keep // len(alphabet)] << 8) | alphabet[keep % len(alphabet)]
    return ids, grams


def _spans(offsets: np.ndarray, n: int, mark: np.ndarray) -> np.ndarray:
    """Boolean over symbols: those of texts whose mark is set."""
    return np.repeat(mark, np.diff(offsets))[:n]


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte plane by byte plane, compressed."""
    steps = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    return zlib.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_values(values: np.ndarray) -> bytes:
    size = values.dtype.itemsize
    return zlib.compress(values.view(np.uint8).reshape(-1, size).T.tobytes(), 1)


def unpack_values(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def parts_of(kind: int, keys: np.ndarray, parts: int) -> list[np.ndarray]:
    """Indices of the keys of each part; keys stay in order. Grams that begin alike are in one part, so their differences are small."""
    at = (mix(keys.astype(np.uint64) >> np.uint64(24 if kind == GRAM else 0)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return np.split(order, np.searchsorted(at[order], np.arange(1, parts)))


NEED = pa.schema([("block", pa.int64()), ("kind", pa.int8()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("payload", pa.binary())])
MODEL = pa.schema([("kind", pa.int8()), ("part", pa.int32()), ("tail", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("kinds", pa.int64())])


def needs_of(texts: list, parts: int, train: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
    """(kind, part, sorted keys, training counts) of everything that the texts ask the model."""
    data, offsets = symbols_of(texts)
    at, grams = gram_ids(data)
    good = data[ORDER:] != START
    used = np.zeros(len(grams), bool)
    used[at[good]] = True
    counts = None
    if train is not None:
        good &= _spans(offsets, len(data), train)[ORDER:]
        counts = np.bincount(at[good], minlength=len(grams))[used]
    del at, good, data
    grams = grams[used]
    for part, i in enumerate(parts_of(GRAM, grams, parts)):
        if len(i):
            yield GRAM, part, grams[i], None if counts is None else counts[i]
    hashes, first = word_hashes(texts)
    keys, where = np.unique(hashes, return_inverse=True)
    counts = None if train is None else np.bincount(where, weights=np.repeat(train, np.diff(first)), minlength=len(keys)).astype(np.int64)
    for part, i in enumerate(parts_of(WORD, keys, parts)):
        if len(i):
            yield WORD, part, keys[i], None if counts is None else counts[i]


def blocks_of(docs: DataFrame, id_col: str, text_col: str, size: int, parts: int) -> DataFrame:
    """Per block its texts, and per part the keys that it needs with its training counts."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches_, 1, size):
            block = uuid.uuid4().int >> 65
            train = np.array([not held_out(i) for i in rows.column(0).to_pylist()], bool)
            yield pa.RecordBatch.from_pylist([{"block": block, "kind": PAYLOAD, "n": int(train.sum()), "payload": pack(rows)}], schema=NEED)
            out = [{"block": block, "kind": kind, "part": part, "keys": pack_keys(keys), "counts": pack_values(counts.astype(np.uint32)), "n": None, "payload": None} for kind, part, keys, counts in needs_of(rows.column(1).to_pylist(), parts, train)]
            yield pa.RecordBatch.from_pylist(out, schema=NEED)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "block long, kind byte, part int, keys binary, counts binary, n long, payload binary")


def _merged(batches_: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Sums of counts by key; input is sorted by kind and part. Grams go on by a hash of their tail (the two bytes before the last)."""

    def flush(kind: int, part: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        if kind == WORD:
            cuts, names = [np.arange(len(keys))], [-1]
        else:
            tail = (mix((keys >> np.uint64(8)) & np.uint64(65535)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(tail, kind="stable")
            names, first = np.unique(tail[order], return_index=True)
            cuts = np.split(order, first[1:])
        rows = [{"kind": kind, "part": part, "tail": int(t), "keys": pack_keys(keys[i]), "counts": pack_values(counts[i].astype(np.uint64)), "n": int(counts[i].sum()), "kinds": int((counts[i] > 0).sum())} for t, i in zip(names, cuts, strict=True)]
        return pa.RecordBatch.from_pylist(rows, schema=MODEL)

    def joined(held: list) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(where, weights=np.concatenate([c for _, c in held]), minlength=len(keys)).astype(np.int64)

    now, held, total = None, [], 0
    for batch in batches_:
        for row in batch.to_pylist():
            if (row["kind"], row["part"]) != now:
                if held:
                    yield flush(*now, *joined(held))
                now, held, total = (row["kind"], row["part"]), [], 0
            keys = unpack_keys(row["keys"])
            held.append((keys, unpack_values(row["counts"], np.uint32).astype(np.int64)))
            total += len(keys)
            if total > 2_000_000:
                held = [joined(held)]
                total = 0
    if held:
        yield flush(*now, *joined(held))


def _looked_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of the keys that blocks ask for; the rows of a part begin with its model (block null)."""
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int8()), ("part", pa.int32()), ("values", pa.binary())])
    now, keys, values, model = None, None, None, []
    for batch in parts:
        for row in batch.to_pylist():
            if (row["kind"], row["part"]) != now:
                now, keys, model = (row["kind"], row["part"]), None, []
            if row["block"] is None:
                model.append((unpack_keys(row["keys"]), unpack_values(row["counts"], np.float32 if row["kind"] == GRAM else np.uint64)))
                continue
            if keys is None:
                keys, values = (np.concatenate(x) for x in zip(*model, strict=True))
                order = np.argsort(keys, kind="stable")
                keys, values, model = keys[order], values[order], []
            found = values[np.searchsorted(keys, unpack_keys(row["keys"]))]
            yield pa.RecordBatch.from_pylist([{"block": row["block"], "kind": row["kind"], "part": row["part"], "values": pack_values(found)}], schema=schema)


def _dealt(batches_: Iterator[pa.RecordBatch], parts: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Grams by a hash of their tail; those whose two bytes before the last are ``hot`` (sorted) by that of three bytes."""
    for batch in batches_:
        for row in batch.to_pylist():
            keys = unpack_keys(row["keys"])
            split = np.isin((keys >> np.uint64(8)) & np.uint64(65535), hot)
            if not split.any():
                yield pa.RecordBatch.from_pylist([row], schema=batch.schema)
                continue
            tail = np.full(len(keys), row["tail"])
            tail[split] = (mix((keys[split] >> np.uint64(8)) & np.uint64(0xFFFFFF)) % np.uint64(parts)).astype(np.int64)
            counts, order = unpack_values(row["counts"], np.uint64), np.argsort(tail, kind="stable")
            names, first = np.unique(tail[order], return_index=True)
            rows = [{"tail": int(t), "part": row["part"], "keys": pack_keys(keys[i]), "counts": pack_values(counts[i])} for t, i in zip(names, np.split(order, first[1:]), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def evaluate(keys: np.ndarray, n: np.ndarray, pairs: np.ndarray, order: int = ORDER, hot: np.ndarray = (), triples: tuple = ((), ())) -> np.ndarray:
    """log10 of the probability of the last byte of each gram, given those before it.

    keys: distinct grams of order + 1 bytes, big-endian, that include all of those of the training
    texts with the same two bytes before the last, for each such pair that occurs; pairs: counts[256, 256] of (byte, next byte).
    For pairs in ``hot`` it is three bytes before the last; triples: sorted grams of order 2 with such a pair, and their counts.
    """
    grams: list = [None] * (order + 1)
    contexts: list = [None] * (order + 1)
    for k in range(order, 1, -1):
        part = keys & ((1 << 8 * (k + 1)) - 1)
        g, where = np.unique(part, return_inverse=True)
        c = np.bincount(where, weights=n, minlength=len(g)).astype(np.int64)
        if k == 2 and len(hot):
            cold = ~np.isin(g >> 8, hot)
            here = np.isin(triples[0] >> 8, g >> 8)
            g, c = np.concatenate([g[cold], triples[0][here]]), np.concatenate([c[cold], triples[1][here]])
            by = np.argsort(g, kind="stable")
            g, c = g[by], c[by]
        g, c = g[c > 0], c[c > 0]
        grams[k] = (g, c)
    for k in (1, 0):
        table = pairs if k else pairs.sum(0, keepdims=True)
        g = np.flatnonzero(table.ravel())
        grams[k] = (g, table.ravel()[g])

    def find(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
        return at, sorted_keys[at] == x

    for k in range(order, -1, -1):
        g, c = grams[k]
        ctx, where = np.unique(g >> 8, return_inverse=True)
        total, distinct = np.bincount(where, weights=c, minlength=len(ctx)), np.bincount(where, minlength=len(ctx))
        mass = np.zeros(len(ctx))
        if k:
            low, low_n = grams[k - 1]
            at, ok = find(low, g & ((1 << 8 * k) - 1))
            mass = np.bincount(where, weights=np.where(ok, low_n[at] if len(low_n) else 0, 0), minlength=len(ctx))
        contexts[k] = (ctx, total, distinct.astype(float), mass)
    out, left = np.zeros(len(keys)), np.ones(len(keys), bool)
    excluded, known = np.zeros(len(keys)), np.zeros(len(keys))
    for k in range(order, -1, -1):
        part = keys & ((1 << 8 * (k + 1)) - 1)
        ctx, total, distinct, mass = contexts[k]
        at, seen = find(ctx, part >> 8)
        if not len(ctx):
            continue
        g, c = grams[k]
        hit_at, hit = find(g, part)
        novel = distinct[at] - known
        whole = 2 * (total[at] - excluded)
        live = left & seen
        found = live & hit
        out[found] += np.log10((2 * c[hit_at[found]] - 1) / whole[found])
        left &= ~found
        escaped = live & ~hit
        some = escaped & (novel > 0)
        out[some] += np.log10(novel[some] / whole[some])
        excluded[escaped], known[escaped] = mass[at[escaped]], distinct[at[escaped]]
    out[left] -= np.log10(ALPHABET - known[left])
    return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK, parts: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    parts: into how many the model is split by key; by default as many as there are shuffle
    partitions, 64 at least.
    """
    kind = dict(docs.dtypes)[id_col]
    parts = parts or max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocked = cut(blocks_of(docs, id_col, text_col, block_bytes, parts))
    needs = blocked.where(F.col("kind") != PAYLOAD).select("block", "kind", "part", "keys", "counts")
    counts = cut(
        needs.select("kind", "part", "keys", "counts").repartition("kind", "part").sortWithinPartitions("kind", "part")
        .mapInArrow(lambda b: _merged(b, parts), "kind byte, part int, tail int, keys binary, counts binary, n long, kinds long")
    )
    n_words, n_kinds = counts.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    ends = blocked.where(F.col("kind") == PAYLOAD).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens, kinds = n_words + ends, n_kinds + (ends > 0)

    def last_pairs(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of (byte, next byte), and below zero the distinct grams of each pair before the last byte."""
        table, kinds_ = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
        for batch in batches_:
            for k, c in zip(batch["keys"], batch["counts"], strict=True):
                keys = unpack_keys(k.as_py())
                table += np.bincount((keys & np.uint64(65535)).astype(np.int64), weights=unpack_values(c.as_py(), np.uint64), minlength=65536).astype(np.int64)
                kinds_ += np.bincount(((keys >> np.uint64(8)) & np.uint64(65535)).astype(np.int64), minlength=65536)
        at, of = np.flatnonzero(table), np.flatnonzero(kinds_)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, -1 - of])), pa.array(np.concatenate([table[at], kinds_[of]]))], ["p", "n"])

    grams = counts.where(F.col("kind") == GRAM)
    pairs, share = np.zeros((256, 256), np.int64), np.zeros(65536, np.int64)
    for r in grams.select("keys", "counts").mapInArrow(last_pairs, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).collect():
        if r["p"] < 0:
            share[-1 - r["p"]] = r["n"]
        else:
            pairs[r["p"] >> 8, r["p"] & 255] = r["n"]
    hot = np.flatnonzero(share * parts > share.sum())

    def of_hot(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(hot), 256), np.int64)
        for batch in batches_:
            for k, c in zip(batch["keys"], batch["counts"], strict=True):
                keys = unpack_keys(k.as_py()).astype(np.int64)
                at, tail = np.searchsorted(hot, (keys >> 8) & 65535), (keys >> 8) & 65535
                mine = hot[np.minimum(at, len(hot) - 1)] == tail
                np.add.at(table, (at[mine], keys[mine] & 255), unpack_values(c.as_py(), np.uint64).astype(np.int64)[mine])
        i, x = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array((hot[i] << 8) | x), pa.array(table[i, x])], ["p", "n"])

    found = grams.select("keys", "counts").mapInArrow(of_hot, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).collect() if len(hot) else []
    triples = tuple(np.array(sorted((r["p"], r["n"]) for r in found), np.int64).reshape(-1, 2).T)

    def part_costs(table: pa.Table) -> pa.Table:
        each = [unpack_keys(k.as_py()).astype(np.int64) for k in table["keys"]]
        keys = np.concatenate(each)
        n = np.concatenate([unpack_values(c.as_py(), np.uint64).astype(np.int64) for c in table["counts"]])
        order = np.argsort(keys, kind="stable")
        cost = np.empty(len(keys), np.float32)
        cost[order] = evaluate(keys[order], n[order], pairs, hot=hot, triples=triples)
        return pa.table({"part": table["part"], "keys": table["keys"], "counts": pa.array([pack_values(c) for c in np.split(cost, np.cumsum([len(k) for k in each])[:-1])], pa.binary())})

    dealt = grams.select("tail", "part", "keys", "counts").mapInArrow(lambda b: _dealt(b, parts, hot), "tail int, part int, keys binary, counts binary")
    costs = dealt.groupBy("tail").applyInArrow(part_costs, "part int, keys binary, counts binary")
    none = F.lit(None).cast("long").alias("block")
    model = costs.select(none, F.lit(GRAM).cast("byte").alias("kind"), "part", "keys", "counts").unionByName(
        counts.where(F.col("kind") == WORD).select(none, "kind", "part", "keys", "counts")
    )
    asked = model.unionByName(needs.select("block", "kind", "part", "keys", F.lit(None).cast("binary").alias("counts")))
    answers = (
        asked.repartition("kind", "part").sortWithinPartitions("kind", "part", F.col("block").asc_nulls_first())
        .mapInArrow(_looked_up, "block long, kind byte, part int, values binary")
    )

    def score_block(payload: pa.Table, answers: pa.Table) -> pa.Table:
        rows = unpack(payload["payload"])
        ids, texts = rows.column(0), rows.column(1).to_pylist()
        told = {(r["kind"], r["part"]): r["values"] for r in answers.to_pylist()}
        data, offsets = symbols_of(texts)
        at, grams = gram_ids(data)
        cost = np.zeros(len(grams))
        used = np.zeros(len(grams), bool)
        used[at[data[ORDER:] != START]] = True
        used = np.flatnonzero(used)
        for part, i in enumerate(parts_of(GRAM, grams[used], parts)):
            if len(i):
                cost[used[i]] = unpack_values(told[GRAM, part], np.float32)
        # One sum per text: the gram at symbol i predicts symbol i + ORDER of the same text.
        total = np.zeros(len(texts))
        for piece in batches(np.diff(offsets).tolist(), 1 << 20):
            a, b = int(offsets[piece.start]), int(offsets[piece.stop]) - ORDER
            each = np.where(data[a + ORDER : b + ORDER] != START, cost[at[a:b]], 0.0)
            owner = np.repeat(np.arange(piece.start, piece.stop), np.diff(offsets[piece.start : piece.stop + 1]))[ORDER:]
            total += np.bincount(owner, weights=each, minlength=len(texts))
        del at, data
        hashes, first = word_hashes(texts)
        known, where = np.unique(hashes, return_inverse=True)
        value = np.zeros(len(known))
        for part, i in enumerate(parts_of(WORD, known, parts)):
            if len(i):
                value[i] = unpack_values(told[WORD, part], np.uint64)
        c = value[where]
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        base = np.bincount(owner, weights=np.log10((c + 1) / (tokens + kinds + 1)), minlength=len(texts))
        base = base + np.log10((ends + 1) / (tokens + kinds + 1))
        n_known = np.bincount(owner, weights=c > 0, minlength=len(texts)).astype(np.int64) + int(ends > 0)
        trim()
        return pa.table({
            id_col: ids, "held_out": [held_out(i) for i in ids.to_pylist()], "n_tokens": np.diff(first) + 1, "n_known": n_known,
            "train_tokens": np.full(len(texts), tokens, np.int64), "base_score": base, "score": total,
        })

    return (
        blocked.where(F.col("kind") == PAYLOAD).select(F.col("block").alias("home"), "payload").groupBy("home")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(score_block, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )


def adaptive_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(id, score): log10 probability of each text under a trie that starts empty and learns from it."""
    kind = dict(docs.dtypes)[id_col]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = pa.array([Trie(order).score(t, learn=True) for t in part.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([part.column(0), got], [id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double")
