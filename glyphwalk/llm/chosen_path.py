"""MinHash near-dedup by a chosen-path set similarity join.

Each document is its set of word shingles. Rows with equal sets are one class, known by the set's
digest. A tree branches the classes: at each node every set moves to the child of its minwise token
under a hash seeded by the node's path, so two sets part with probability 1 - J per level. Nodes of
depth ``DEPTH`` that are small are compared exhaustively on the full sets. ``TREES`` independent
trees make the probability to miss a link there (1 - J**4)**24: 2e-8 at J = 0.85, 3e-6 at J = 0.80.

Larger nodes go on, and recall is held all the way down:

1. If few sets are outside the node's largest component, they are compared with all of the node, in
   blocks: exact, and linear in the node.
2. Otherwise random parts are compared first, so that what is alike becomes one component.
3. If many are left, every set goes to ``FAN`` children by independent seeds for every two levels. A linked
   pair then has 2 J**2 > 1 common children on average and stays together in some branch with the
   probability that ``survival`` gives, whatever the depth: misses by chance stay below 2e-4.
4. At ``MAX_DEPTH`` what is left is compared as in 1, in as many blocks as it takes.

Only sets of different components are compared, each of those outside the node's largest one with all.
Rounds of trees: after each, links become components, and a node of a later tree is only looked
at if it still holds two components. Large groups of near copies are therefore compared once or
twice, and only the spanning links of a node leave it: no pairs of a group are written. Links are
confirmed on full sets (64-bit shingle hashes), with integers: 100 * common >= percent * union.

Rows that share an id and differ in text are judged apart; the smallest id of a component names it.
Null ids are never representatives: such a row gets the component of its class, and stays alone
(component null, kept) if no row of the class has an id. Null, empty and blank texts have the
empty set, which links with nothing. Repeated rows are rows of one class. Long texts are read a
megabyte at a time; their sets are never cut. An empty table gives an empty result. Columns that are not
named in ``carry`` are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphwalk.llm._blocks import trim
from glyphwalk.llm._runs import runs
from glyphwalk.llm._text import U, batches, mix, shingle_hashes, words_of
from glyphwalk.plans.components import connected_components
from glyphwalk.plans.cut import cut, drop_cut

DEPTH, TREES, ROUNDS = 4, 24, ((0, 3), (3, 10), (10, 24))
#: A node is compared exhaustively up to so many sets and shingles, one of two sets always; MAX_DEPTH ends branching.
NODE_SETS, NODE_SHINGLES, MAX_DEPTH, FAN = 1500, 4_000_000, 12, 2
SEEDS = mix(np.arange(1, TREES + 1, dtype=U) * U(0xA24BAED4963EE407))
STEP = U(0x9FB21C651E98DF25)


def survival(j: float, depth: int, trees: int = TREES) -> float:
    """Probability that sets of similarity ``j`` share a node of ``depth`` in some tree."""
    together = 1.0
    for _ in range((depth - DEPTH) // 2):
        together = 1 - (1 - j**2 * together) ** FAN
    return 1 - (1 - j**DEPTH * together) ** trees


def shingle_sets(texts: list, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words are one shingle."""
    for piece in batches([len(t or "") for t in texts], 1 << 20):
        words, _, _, first, _ = words_of(texts[piece])
        for a, b in zip(first[:-1], first[1:], strict=True):
            n = int(b - a)
            yield np.unique(shingle_hashes(words[a:b], k)) if n >= k else shingle_hashes(words[a:b], n) if n else np.zeros(0, U)


def descend(tokens: np.ndarray, paths: np.ndarray, levels: int) -> np.ndarray:
    """Paths after so many levels: each takes in the minwise token under the hash that it seeds."""
    paths = paths.astype(U, copy=True)
    for _ in range(levels):
        least = np.full(len(paths), ~U(0))
        for b in range(0, len(tokens), 16384):
            x = tokens[b : b + 16384, None] ^ paths
            x *= STEP
            np.minimum(least, x.min(axis=0), out=least)
        paths = mix(paths * U(0xD6E8FEB86659FD93) + least)
    return paths


def link_sets(sets: list[np.ndarray], percent: int, components: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of a node between components: pairs of indices; ``components`` are those known before (none: each set its own)."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    label = np.arange(m) if components is None else np.unique(components, return_inverse=True)[1]
    if m == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if label[0] != label[1] and 100 * common >= percent * (sizes.sum() - common) else []
    rows = np.flatnonzero(label != np.bincount(label).argmax())
    if not len(rows):
        return []
    at_row = np.full(m, -1)
    at_row[rows] = np.arange(len(rows))
    owner = np.repeat(np.arange(m), sizes)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Tokens of one set, or of none outside the largest component, are common to no pair that counts.
    useful = (count > 1) & (np.bincount(token[at_row[owner] >= 0], minlength=len(count)) > 0)
    rank, n = np.cumsum(useful) - 1, int(useful.sum())
    shared = useful[token]
    owner, token = owner[shared], rank[token[shared]]
    width = max(1, (1 << 23) // m)
    common = np.zeros((len(rows), m), np.float32 if sizes.max() < 1 << 24 else np.float64)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    for b in range(0, n, width):
        i, j = np.searchsorted(token, (b, b + width))
        x = np.zeros((m, min(width, n - b)), np.float32)
        x[owner[i:j], token[i:j] - b] = 1
        common += x[rows] @ x.T
    common = np.rint(common).astype(np.int64)
    linked = 100 * common >= percent * (sizes[rows, None] + sizes[None, :] - common)
    up = list(range(int(label.max()) + 1))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for r, i in enumerate(rows.tolist()):
        near = np.flatnonzero(linked[r])
        for j in near[np.unique(label[near], return_index=True)[1]].tolist():
            a, b = root(int(label[i])), root(int(label[j]))
            if a != b:
                up[a] = b
                out.append((i, j))
    return out


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, digest, paths): set size, digest of the set, and its node at DEPTH in every tree; further columns of ``docs``."""
    carry = docs.columns[2:]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, digest, paths = [], [], []
            for s in shingle_sets(part.column(1).to_pylist(), k):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                paths.append(descend(s, SEEDS, DEPTH).view(np.int64) if len(s) else np.zeros(0, np.int64))
            flat = np.concatenate(paths) if paths else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists, *[part[c] for c in carry]], ["id", "n", "digest", "paths", *carry])
            trim()

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join(["id long, n long, digest binary, paths array<long>", *[f"`{c}` {kinds[c]}" for c in carry]]))


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """(cls, tokens) of (cls, t), each class once a task."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in parts:
            found: dict[int, int] = {c: i for i, c in enumerate(part.column(0).to_pylist()) if c not in seen}
            seen.update(found)
            tokens = [s.tobytes() for s in shingle_sets(part.column(1).take(pa.array(list(found.values()), pa.int64())).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(tokens, pa.binary())], ["cls", "tokens"])
            del tokens
            trim()

    return texts.mapInArrow(run, "cls long, tokens binary")


def _branch(members: DataFrame, levels: int) -> DataFrame:
    """Every set in ``FAN`` children, by independent seeds, so many levels below its node."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            seeds = mix(part["node"].to_numpy().view(U)[:, None] + np.arange(1, FAN + 1, dtype=U) * U(0xA24BAED4963EE407))
            deeper = [descend(np.frombuffer(t.as_py(), U), seeds[i], levels) for i, t in enumerate(part["tokens"])]
            deeper = np.array(deeper, U).reshape(-1, FAN).view(np.int64)
            for child in range(FAN):
                columns = [pa.array(deeper[:, child]) if c == "node" else part[c] for c in part.schema.names]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return members.mapInArrow(run, members.schema)


def _random_parts(sized: DataFrame) -> DataFrame:
    """Large nodes dealt into random nodes of bounded size."""
    return sized.withColumn("node", F.xxhash64("node", F.pmod(F.xxhash64("tree", "cls"), F.ceil(F.col("pieces") / 2))))


def _nodes(members: DataFrame) -> DataFrame:
    """Nodes that hold two components: the main one, into how many pieces the sets are dealt, and those outside the main one (1 and 1 if small)."""
    each = members.groupBy("tree", "node", "component").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    top = F.max(F.struct("sets", "shingles", "component"))
    nodes = each.groupBy("tree", "node").agg(F.sum("sets").alias("sets"), F.sum("shingles").alias("shingles"), top.alias("top"), F.count(F.lit(1)).alias("c"))
    small = (F.col("sets") == 2) | (F.col("sets") <= NODE_SETS) & (F.col("shingles") <= NODE_SHINGLES)
    pieces = lambda sets, shingles: F.when(small, F.lit(1)).otherwise(F.ceil(F.greatest(2 * sets / NODE_SETS, 2 * shingles / NODE_SHINGLES))).cast("long")
    return nodes.where("c > 1").select(
        "tree", "node", F.col("top.component").alias("main"), pieces(F.col("sets"), F.col("shingles")).alias("pieces"),
        pieces(F.col("sets") - F.col("top.sets"), F.col("shingles") - F.col("top.shingles")).alias("others"),
    )


def _crossed(members: DataFrame) -> DataFrame:
    """Nodes of one piece of the sets and one of those outside the main component, for every pair of pieces."""
    piece, other = F.pmod(F.xxhash64("cls"), F.col("pieces")), F.pmod(F.xxhash64(F.lit(1), "cls"), F.col("others"))
    row = F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda j: piece * F.col("others") + j)
    column = F.transform(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1), lambda i: i * F.col("others") + other)
    cells = F.when(F.col("component") == F.col("main"), row).otherwise(F.array_distinct(F.concat(row, column)))
    return members.withColumn("cell", F.explode(cells)).withColumn("node", F.xxhash64("node", "cell"))


def _compare(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): components that a link ties."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node in runs(parts, ["tree", "node"]):
            labels = node["component"].to_numpy()
            if (labels != labels[0]).any():
                links = link_sets([np.frombuffer(t.as_py(), U) for t in node["tokens"]], percent, labels)
                if links:
                    a, b = np.array(links).T
                    yield pa.RecordBatch.from_arrays([pa.array(labels[a]), pa.array(labels[b])], ["a", "b"])
            if node.nbytes > 1 << 22:
                del node
                trim()

    dealt = members.select("tree", "node", "component", "tokens").repartition("tree", "node").sortWithinPartitions("tree", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _merged(found: DataFrame, links: list[DataFrame]) -> DataFrame:
    """Components of what was found and new links between components: a graph of those that change only."""
    new = reduce(DataFrame.unionByName, links)
    if new.isEmpty():
        return found
    moved = cut(connected_components(new)).select(F.col("vertex").alias("was"), F.col("component").alias("now"))
    old = found.join(moved, F.col("component") == F.col("was"), "left").select("vertex", F.coalesce("now", "component").alias("component"))
    first = moved.join(found, F.col("was") == F.col("vertex"), "left_anti").select(F.col("was").alias("vertex"), F.col("now").alias("component"))
    after = cut(old.unionByName(first))
    for table in (found, *links):
        drop_cut(table)
    return after


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members with their component as it is now."""
    rest = [c for c in members.columns if c != "component"]
    return members.select(*rest).join(found, F.col("cls") == F.col("vertex"), "left").select(*rest, F.coalesce("component", "cls").alias("component"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row, and the columns ``carry`` as they are."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("__tv"), *carry)
    profiles = cut(_profiles(texts, k))
    classes = cut(
        profiles.where("n > 0 and id is not null").groupBy("digest")
        .agg(F.min(F.struct("id", "__tv")).alias("of"), F.first("n").alias("n"), F.first("paths").alias("paths"))
        .select(F.monotonically_increasing_id().alias("cls"), F.col("of.id").alias("rep"), F.col("of.__tv").alias("version"), "digest", "n", "paths")
    )
    spread = classes.select("cls", "n", F.posexplode("paths").alias("tree", "node"))
    crowded = spread.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    members = cut(spread.join(crowded, ["tree", "node"]))
    # The text of a class is that of its smallest id, of one version if the id has several.
    wanted = classes.join(members.select("cls").distinct(), "cls").select("cls", "rep", "version")
    sets = cut(_sets(texts.join(wanted, (F.col("id") == F.col("rep")) & (F.col("__tv") == F.col("version"))).select("cls", "t"), k).dropDuplicates(["cls"]))
    found = spark.createDataFrame([], "vertex long, component long")
    for begin, end in ROUNDS:
        now = _labelled(members.where(F.col("tree").between(begin, end - 1)), found)
        now = cut(now.join(_nodes(now).select("tree", "node"), ["tree", "node"]).join(sets, "cls"))
        depth, done, parted = DEPTH, [], False
        while True:
            nodes = cut(_nodes(now))
            ready = (F.col("others") <= 1) | F.lit(depth >= MAX_DEPTH)
            done.append(cut(_compare(_crossed(now.join(nodes.where(ready), ["tree", "node"])), percent)))
            large = nodes.where(~ready)
            if large.isEmpty():
                break
            before, rest = now, now.join(large, ["tree", "node"])
            if parted:
                now = cut(_branch(rest.select(*now.columns), 2))
                depth += 2
            else:
                found, done, parted = _merged(found, [*done, cut(_compare(_random_parts(rest), percent))]), [], True
                now = cut(_labelled(rest.select(*now.columns), found).select(*now.columns))
            drop_cut(before)
        found = _merged(found, done)
        drop_cut(now)
    named = classes.join(found, F.col("cls") == F.col("vertex")).groupBy("component").agg(F.min("rep").alias("least"))
    kept = found.join(named, "component").select("vertex", "least")
    of_class = classes.join(kept, F.col("cls") == F.col("vertex"), "left").select("digest", F.coalesce("least", "rep").alias("component_id"))
    return (
        profiles.join(of_class.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("n") > 0), "left")
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
            *carry,
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
