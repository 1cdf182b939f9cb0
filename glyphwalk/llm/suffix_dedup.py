"""Exact substring dedup: every byte under a 200-byte string that also starts elsewhere is removed.

Sampling without loss. A window of WINDOW bytes is owned by the leftmost of its smallest GRAM-byte
hashes, its anchor; equal windows have equal anchors at the same offset, so only windows whose
anchors have equal grams can be equal. One anchor owns about 80 windows in a row; the bytes under
them are its context.

1. Texts are packed into blocks, written once. Blocks list (gram, context) of their anchors: the gram by
   a polynomial hash, the context by a cryptographic one of its bytes, 128 bits together.
2. A context that occurs twice is repeated as a whole; copies need no sort. A gram with one context is
   not repeated. Of grams with several contexts, one of them single, one copy of each context is sent.
3. Per gram, suffixes are sorted by a mergesort that compares them by their longest common
   extension, found by binary search over prefix polynomial hashes. First the suffixes at the anchors
   and, backwards, those before them: a window is a candidate if its bytes on each side of the anchor
   are within what the neighbours share. Then the suffixes at the candidates, an offset from the anchor
   at a time. Neighbours that share WINDOW bytes are repeated.
4. Every sort is verified: neighbours are compared byte by byte, which gives their true common
   length and proves the order. Where a hash collision misled the sort, it is done again on the bytes.
5. Grams with more than GROUP contexts are spread by the bytes of each window instead and counted.
6. Blocks get the answers and cut their texts.

A block is the unit of memory (about 16 MB of text, or one longer text); no gram's contexts meet in one
task beyond GROUP of them. Null text is empty; repeated rows are texts that repeat each other; rows
that share an id are texts of their own. An empty table gives an empty result. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphwalk.llm._blocks import trim
from glyphwalk.llm._runs import runs
from glyphwalk.llm._text import U, batches, join_texts, prefix_hashes, range_hashes, sliding_least
from glyphwalk.plans.cut import cut

WINDOW, GRAM, GROUP, BLOCK = 200, 40, 4096, 16 << 20


SALTS = [i.to_bytes(2, "little") for i in range(WINDOW)]


def contexts_of(raw: bytes, first: np.ndarray, last: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Cryptographic hashes of contexts: their bytes and the anchor's place in them."""
    new = hashlib.blake2b
    found = [new(raw[a : b + WINDOW], digest_size=8, salt=SALTS[x]).digest() for a, b, x in zip(first.tolist(), last.tolist(), lead.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), U)


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(anchor, first window, last window, gram hash) of a batch of texts."""
    prefix = prefix_hashes(data)
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, none.view(U)
    starts = np.arange(len(data) - gram + 1)
    bits = U(max(1, int(len(data)).bit_length()))
    keyed = (range_hashes(prefix, starts, starts + gram) >> bits << bits) | starts.astype(U)
    owner = (sliding_least(keyed, window - gram + 1) & ((U(1) << bits) - U(1))).astype(np.int64)
    del keyed
    inside = np.zeros(len(data) + 1, np.int32)
    fits = offsets[1:] - 1 - offsets[:-1] >= window
    np.add.at(inside, offsets[:-1][fits], 1)
    np.add.at(inside, offsets[1:][fits] - window, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1])[: len(owner)])
    if not len(at):
        return none, none, none, none.view(U)
    own = owner[at]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
    first, last, anchor = at[new], at[np.append(new[1:], len(at)) - 1], own[new]
    return anchor, first, last, range_hashes(prefix, anchor, anchor + gram)


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int | np.ndarray) -> np.ndarray:
    """Length up to ``limit`` of the longest common extension of positions a and b, by binary search."""
    low, high = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64) + limit
    for _ in range(int(np.max(limit, initial=0)).bit_length()):
        middle = (low + high + 1) >> 1
        same = range_hashes(prefix, a, a + middle) == range_hashes(prefix, b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def suffix_sort(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, segment: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Order of the suffixes ``at``, each of so many bytes, within each segment (adjacent, equal numbers); of equal beginnings the shorter is first.

    Bottom-up mergesort of all segments together: every suffix finds its place in the neighbouring
    run by binary search, and a comparison takes log2(length) hash probes and one byte.
    """
    n = len(at)
    order = np.arange(n)
    begin = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if n else np.zeros(0, int)
    size = np.diff(np.append(begin, n))
    start, end = np.repeat(begin, size), np.repeat(begin + size, size)
    local = np.arange(n) - start

    def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        shorter = np.minimum(length[x], length[y])
        common = common_extension(prefix, at[x], at[y], shorter)
        out = length[x] < length[y]
        apart = common < shorter
        out[apart] = data[at[x[apart]] + common[apart]] < data[at[y[apart]] + common[apart]]
        return out

    run = 1
    while n and run < size.max():
        odd = local // run % 2 == 1
        other = start + (local // run + np.where(odd, -1, 1)) * run
        low, stop = np.minimum(other, end), np.minimum(other + run, end)
        first = low.copy()
        while (live := np.flatnonzero(low < stop)).size:
            middle = (low[live] + stop[live]) // 2
            mine, theirs = order[live], order[middle]
            # Left elements count smaller ones on the right; right ones count those not larger on the left.
            go = np.where(odd[live], ~less(mine, theirs), less(theirs, mine))
            low[live[go]] = middle[go] + 1
            stop[live[~go]] = middle[~go]
        mine = local % run
        base = start + local // (2 * run) * 2 * run
        placed = np.empty(n, np.int64)
        placed[base + mine + (low - first)] = order
        order = placed
        run *= 2
    return order


def neighbours(data: np.ndarray, at: np.ndarray, length: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """True common length of each suffix in order with the one before it, compared byte by byte, and whether the two are in order."""
    common, right = np.zeros(len(order), np.int64), np.ones(len(order), bool)
    for part in np.array_split(np.arange(1, len(order)), max(1, len(order) // 20_000)):
        if not len(part):
            continue
        a, b = order[part - 1], order[part]
        shorter = np.minimum(length[a], length[b])
        step = np.arange(max(1, int(shorter.max())))
        x, y = (data[np.minimum(at[i][:, None] + step, len(data) - 1)] for i in (a, b))
        differ = (x != y) | (step >= shorter[:, None])
        n = np.where(differ.any(1), differ.argmax(1), shorter)
        common[part] = n
        inside = n < shorter
        rows, column = np.arange(len(part)), np.minimum(n, len(step) - 1)
        right[part] = np.where(inside, x[rows, column] < y[rows, column], length[a] <= length[b])
    return common, right


def sorted_suffixes(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, segment: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified order of the suffixes within each segment, and the bytes that each shares with its better neighbour there."""
    order = suffix_sort(data, prefix, at, segment, length)
    common, right = neighbours(data, at, length, order)
    if not len(order):
        return order, common
    new = np.concatenate([[True], segment[1:] != segment[:-1]])
    wrong = np.unique(segment[~(right | new)])
    if len(wrong):
        raw = data.tobytes()
        for s in wrong:  # a hash collision
            own = np.flatnonzero(segment == s)
            order[own] = sorted(own.tolist(), key=lambda i: raw[at[i] : at[i] + length[i]])
        common, _ = neighbours(data, at, length, order)
    common[new] = 0
    best = np.empty(len(order), np.int64)
    best[order] = np.maximum(common, np.append(common[1:], 0))
    return order, best


def repeated_windows(contexts: list[bytes], leads: np.ndarray, groups: np.ndarray, window: int = WINDOW, hashed=prefix_hashes) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset from the anchor) of windows that occur in two contexts of a group.

    leads: bytes before the anchor; groups: equal numbers for equal grams, adjacent.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    anchor = np.cumsum(sizes) - sizes + leads
    groups = np.cumsum(np.concatenate([[0], groups[1:] != groups[:-1]])) if len(groups) else groups
    prefix = hashed(data)
    _, ahead = sorted_suffixes(data, prefix, anchor, groups, np.minimum(window, sizes - leads))
    back = np.ascontiguousarray(data[::-1])
    _, behind = sorted_suffixes(back, hashed(back), len(data) - anchor, groups, np.minimum(window, leads))
    # Windows of which both sides of the anchor are found elsewhere, if not together.
    low, high = np.maximum(leads - (sizes - window), window - ahead), np.minimum(leads, behind)
    count = np.maximum(0, high - low + 1)
    which = np.repeat(np.arange(len(contexts)), count)
    lead = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
    by = np.lexsort((which, lead, groups[which]))
    which, lead = which[by], lead[by]
    _, best = sorted_suffixes(data, prefix, anchor[which] - lead, groups[which] * np.int64(window) + lead, np.full(len(which), window))
    hit = best >= window
    return which[hit], lead[hit]


def _pack(ids: pa.Array, texts: list) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({"i": ids, "t": pa.array(texts, pa.large_string())})
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(payload) -> tuple[pa.Array, list]:
    table = pa.concat_tables([pa.ipc.open_stream(p.as_py()).read_all() for p in payload])
    return table["i"].combine_chunks(), table["t"].to_pylist()


def _scan(texts: list):
    """Batches of texts as (slice, data, offsets, anchors ...)."""
    for piece in batches([len(t or "") for t in texts], 1 << 20):
        data, offsets = join_texts(texts[piece])
        yield piece, data, offsets, anchors(data, offsets)


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    names = ["block", "kind", "gram", "context", "n", "payload"]

    def block(ids: pa.Array, texts: list) -> Iterator[pa.RecordBatch]:
        name = uuid.uuid4().int >> 65
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([1], pa.int8()), none, none, none, pa.array([_pack(ids, texts)], pa.binary())], names)
        found = [(g, contexts_of(data.tobytes(), first, last, anchor - first)) for _, data, _, (anchor, first, last, g) in _scan(texts)]
        grams, contexts = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, U) for i in range(2))
        order = np.lexsort((contexts, grams))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(contexts[order]) != 0) | (np.diff(grams[order]) != 0)])) if len(order) else order
        n, at = np.diff(np.append(new, len(order))), order[new]
        for b in range(0, len(at), 1 << 16):
            part = at[b : b + (1 << 16)]
            k = len(part)
            columns = [x[part].view(np.int64) for x in (grams, contexts)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, name)), pa.array(np.zeros(k, np.int8)), *map(pa.array, columns), pa.array(n[b : b + (1 << 16)]), pa.nulls(k, pa.binary())], names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for part in parts:
            got, begin = part.column(1).to_pylist(), 0
            for i, t in enumerate(got):
                held += len(t or "") + 1
                if held >= size:
                    yield from block(pa.concat_arrays([*ids, part.column(0).slice(begin, i + 1 - begin)]), texts + got[begin : i + 1])
                    trim()
                    ids, texts, held, begin = [], [], 0, i + 1
            ids.append(part.column(0).slice(begin))
            texts += got[begin:]
        if texts:
            yield from block(pa.concat_arrays(ids), texts)

    return docs.mapInArrow(run, "block long, kind byte, gram long, context long, n long, payload binary")


class _Wanted:
    """Contexts by the hash of their gram and their own, as columns ``gram`` and ``context`` of a table."""

    def __init__(self, table: pa.Table):
        gram, context = (table[c].to_numpy().view(U) for c in ("gram", "context"))
        self.by = np.lexsort((gram, context))
        self.gram, self.context = gram[self.by], context[self.by]
        self.grams = np.unique(gram)

    def find(self, raw: bytes, grams: np.ndarray, first: np.ndarray, last: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the contexts that are wanted, and where each is. Contexts of other grams are not even hashed."""
        if not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hit = np.flatnonzero(self.grams[np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)] == grams)
        context, gram = contexts_of(raw, first[hit], last[hit], lead[hit]), grams[hit]
        at, end = np.searchsorted(self.context, context), len(self.context) - 1
        live = self.context[np.minimum(at, end)] == context
        hit, at, context, gram = hit[live], at[live], context[live], gram[live]
        while (bad := self.gram[at] != gram).any():  # contexts of one hash and different grams
            after = np.minimum(at + 1, end)
            keep = ~bad | ((after > at) & (self.context[after] == context))
            at = np.where(bad, after, at)[keep]
            hit, context, gram = hit[keep], context[keep], gram[keep]
        return hit, at


def _send(payload: pa.Table, asked: pa.Table) -> pa.Table:
    """One copy of each context that a block is asked for: its bytes, or those of each window if hot."""
    _, texts = _unpack(payload["payload"])
    wanted = _Wanted(asked)
    hot = asked["hot"].to_numpy(zero_copy_only=False)[wanted.by]
    open_ = np.ones(len(hot), bool)
    out: list[pa.Table] = []
    schema = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("lead", pa.int32()), ("hot", pa.bool_()), ("bytes", pa.binary())])

    def add(at: np.ndarray, lead: np.ndarray, raw: list[bytes]) -> None:
        kinds = [wanted.gram[at].view(np.int64), wanted.context[at].view(np.int64), lead.astype(np.int32), hot[at]]
        out.append(pa.table([*map(pa.array, kinds), pa.array(raw, pa.binary())], schema=schema))

    for _, data, _, (anchor, first, last, grams) in _scan(texts) if len(hot) else ():
        raw = data.tobytes()
        pick, at = wanted.find(raw, grams, first, last, anchor - first)
        new = np.unique(at, return_index=True)[1]
        pick, at = pick[new][open_[at[new]]], at[new][open_[at[new]]]
        open_[at] = False
        cold, warm = pick[~hot[at]], pick[hot[at]]
        if len(cold):
            add(at[~hot[at]], (anchor - first)[cold], [raw[a : b + WINDOW] for a, b in zip(first[cold], last[cold], strict=True)])
        for i, where in zip(warm, at[hot[at]], strict=True):
            p = np.arange(first[i], last[i] + 1)
            add(np.full(len(p), where), anchor[i] - p, [raw[x : x + WINDOW] for x in p.tolist()])
    return pa.concat_tables(out) if out else schema.empty_table()


def _sorted_groups(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the cold grams; many grams are sorted at once."""

    def flush(held: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(held).combine_chunks()
        which, lead = repeated_windows(table["bytes"].to_pylist(), table["lead"].to_numpy(), table["gram"].to_numpy())
        keys = [table[c].combine_chunks().take(pa.array(which)) for c in ("gram", "context")]
        return pa.RecordBatch.from_arrays([*keys, pa.array(lead.astype(np.int32))], ["gram", "context", "lead"])

    held, total = [], 0
    for group in runs(parts, ["gram"]):
        held.append(group)
        total += group.num_rows
        if total >= 4000:
            yield flush(held)
            held, total = [], 0
    if held:
        yield flush(held)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every text; with_text adds ``kept``.

    Kept bytes are decoded as UTF-8; a character that is cut in two is replaced in ``kept``.
    """
    kind = dict(docs.dtypes)[id_col]
    blocks = cut(_blocks(docs.select(F.col(id_col), F.col(text_col)), block_bytes))
    payload = blocks.where("kind = 1").select(F.col("block").alias("home"), "payload")
    key = ["gram", "context"]
    seen = blocks.where("kind = 0").select("block", *key, "n")
    each = seen.groupBy(*key).agg(F.sum("n").alias("n"), F.min("block").alias("first"))
    grams = each.groupBy("gram").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.count(F.when(F.col("n") == 1, 1)).alias("singles"))
    open_ = cut(
        each.join(grams.where("total > 1"), "gram")
        .select(*key, (F.col("n") > 1).alias("full"), "first", F.expr("kinds > 1 and singles > 0").alias("mixed"), (F.col("kinds") > GROUP).alias("hot"))
    )
    asked = open_.where("mixed").select(F.col("first").alias("block"), *key, "hot")
    sent = cut(
        payload.groupBy("home").cogroup(asked.groupBy("block"))
        .applyInArrow(_send, "gram long, context long, lead int, hot boolean, bytes binary")
    )
    cold = sent.where("not hot").select(*key, "lead", "bytes").repartition("gram").sortWithinPartitions("gram").mapInArrow(_sorted_groups, "gram long, context long, lead int")
    spread = sent.where("hot").select(*key, "lead", "bytes")
    twice = spread.groupBy("lead", "bytes").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    partly = cold.unionByName(spread.join(twice, ["lead", "bytes"]).select(*key, "lead"))
    leads = partly.groupBy(*key).agg(F.collect_set("lead").alias("leads"))
    told = open_.where("full").select(*key, F.lit(None).cast("array<int>").alias("leads")).unionByName(
        leads.join(open_.where("not full").select(*key), key).select(*key, "leads")
    )
    answers = seen.select("block", *key).join(told, key)

    def finish(payload: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = _unpack(payload["payload"])
        wanted = _Wanted(answers)
        told = answers["leads"].take(pa.array(wanted.by)).combine_chunks() if len(wanted.by) else None
        full = ~np.array(told.is_valid()) if told is not None else np.zeros(0, bool)
        n_bytes, removed, spans, digest, kept = [], [], [], [], []
        for _, data, offsets, (anchor, first, last, grams) in _scan(texts):
            edge = np.zeros(len(data) + 1, np.int64)
            hit, at = wanted.find(data.tobytes(), grams, first, last, anchor - first)
            part, part_at, whole = hit[~full[at]], at[~full[at]], hit[full[at]]
            np.add.at(edge, first[whole], 1)
            np.add.at(edge, last[whole] + WINDOW, -1)
            for i, where in zip(part, part_at.tolist(), strict=True):
                p = anchor[i] - np.asarray(told[where].values)
                np.add.at(edge, p, 1)
                np.add.at(edge, p + WINDOW, -1)
            gone = np.cumsum(edge[:-1]) > 0
            starts = gone & ~np.concatenate([[False], gone[:-1]])
            raw, keep = data, ~gone
            for a, b in zip(offsets[:-1], offsets[1:] - 1, strict=True):
                rest = raw[a:b][keep[a:b]].tobytes()
                n_bytes.append(int(b - a))
                removed.append(int(b - a) - len(rest))
                spans.append(int(starts[a:b].sum()))
                digest.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest.decode("utf-8", "replace"))
        columns = {id_col: ids, "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if with_text:
            columns["kept"] = pa.array(kept, pa.string())
        return pa.table(columns)

    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    return payload.groupBy("home").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)
