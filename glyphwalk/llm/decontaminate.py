"""Benchmark decontamination: item-sized windows of documents, SimHash candidates, exact similarity.

1. A window similar to an item shares shingles with it. Shingles of the documents at every
   ``stride``-th position are joined with those of the items, in one scan. The stride is chosen so that
   nothing is lost: of the L shingles of a window as long as its item, at most (1 - t) / (1 + t) * L
   differ, which is fewer than there are sampled ones.
2. In the documents found, shared shingles are taken at every position. A document of which fewer
   than t of an item's shingles are known holds no window similar to it and is dropped for that
   item. Elsewhere each shared shingle sets an item-sized window so that it stands where the item has it.
3. Windows and items get SimHash fingerprints of ``BITS`` bits over their shingles; pairs further apart
   than ``RADIUS`` are dropped. At similarity 0.8 a bit differs with probability 0.151, so RADIUS is six
   standard deviations above the mean, and unrelated pairs are within it once in 5,000.
4. The similarity of the remaining pairs is exact: shared over united shingle weights, the weight
   being the number of times a shingle stands in the window or item.

Fingerprints cut into RADIUS + 1 blocks, one of which must agree, would find the same pairs, but can't
be an index here: with 15% of the bits different a block is two or three bits wide, and unrelated
fingerprints agree on one with probability 0.99. Candidates therefore come from shared shingles.

Only DataFrame operations run here. Items are broadcast only if their shingles number at most
``BROADCAST_ROWS`` (counted first), otherwise joined by shuffle. Items of fewer than ``k`` words are
one shingle of all their words. Null and empty texts have no shingles and are never found. Long texts
are read whole. Rows with the same id and different texts are judged apart; rows without an id can't be
named in the result and are not reported. Repeated rows are one. Of items that share an id the best is reported. Empty tables give an empty result.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphwalk.plans.cut import cut

RADIUS, BITS, BROADCAST_ROWS = 44, 128, 200_000


def words_of(text: Column) -> Column:
    """Lower-case words; an empty array for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def shingles_of(words: Column, k: int, stride: int = 1) -> Column:
    """(position from 0, shingle hash) at every stride-th position, as an array of structs."""
    last = F.size(words) - k
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(words, i + 1, k)).alias("h")))


def simhash(strings: Column) -> Column:
    """One boolean per bit: most of the hashes of the strings have it set. Every 64 bits are a hash of their own."""

    def word(seed: int) -> Column:
        hashes = F.transform(strings, lambda x: F.xxhash64(F.lit(seed), x))
        return F.transform(
            F.sequence(F.lit(0), F.lit(63)),
            lambda b: F.aggregate(hashes, F.lit(0), lambda s, h: s + F.when(F.getbit(h, b) == 1, 1).otherwise(-1)) > 0,
        )

    return F.concat(*[word(seed) for seed in range(BITS // 64)])


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.8, with_version: bool = False) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance, similarity) of the best window of each pair.

    with_version: per text of an id, and its ``version`` (hash) too.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    bench = cut(
        items.select(F.col(item_id).cast("long").alias("item_id"), words_of(F.col(item_text)).alias("item")).where("item_id is not null")
        .distinct().withColumn("n", F.size("item")).where("n > 0").withColumn("k", F.least("n", F.lit(k))).withColumn("iv", F.xxhash64("item"))
    )
    lengths = sorted((r["k"], r["l"]) for r in bench.groupBy("k").agg(F.min(F.col("n") - F.col("k") + 1).alias("l")).collect())
    spread = reduce(
        DataFrame.unionByName,
        [bench.where(F.col("k") == c).select("item_id", "iv", "n", "k", F.explode(shingles_of(F.col("item"), c)).alias("s")) for c, _ in lengths] or [bench.select("item_id", "iv", "n", "k", F.lit(None).cast("struct<pos:int,h:long>").alias("s"))],
    )
    spread = cut(spread.select("item_id", "iv", "n", "k", F.col("s.pos").alias("q"), F.col("s.h").alias("h")))
    small = spread.count() <= BROADCAST_ROWS
    near = F.broadcast if small else lambda df: df

    def stride(least: int) -> int:
        """The largest step that meets a shared shingle in every window of at least so many shingles."""
        lost = lambda n: int((1 - threshold) / (1 + threshold) * n + 1e-9)
        fits = [s for s in range(1, 9) if all(n // s > lost(n) for n in range(max(1, least), 500)) and 1 / s > (1 - threshold) / (1 + threshold)]
        return max(fits, default=1)

    if not lengths:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, " + "version long, " * with_version + "start_word long, n_words long, distance int, similarity double")
    sizes = [(c, stride(least)) for c, least in lengths]

    def every(words: Column, steps: list[tuple[int, int]]) -> Column:
        """A row (k, pos, h) for each shingle of each size at its step."""
        sized = lambda c, step: F.transform(shingles_of(words, c, step), lambda s: F.struct(F.lit(c).alias("k"), s["pos"].alias("pos"), s["h"].alias("h")))
        return F.explode(F.concat(*[sized(c, step) for c, step in steps]))

    tokens = texts.select("doc_id", F.xxhash64("text").alias("version"), words_of(F.col("text")).alias("words"))  # split once, not for each shingle
    here = tokens.select("doc_id", "version", every(F.col("words"), sizes).alias("s"))
    keys = near(spread.select("k", "h").distinct())
    found = cut(here.select("doc_id", "version", F.col("s.k").alias("k"), F.col("s.h").alias("h")).join(keys, ["k", "h"], "left_semi").select("doc_id", "version").distinct())
    suspects = texts.withColumn("version", F.xxhash64("text")).join(found, ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"])
    suspects = cut(suspects.select("doc_id", "version", words_of(F.col("text")).alias("words")))
    here = suspects.select("doc_id", "version", F.size("words").alias("total"), every(F.col("words"), [(c, 1) for c, _ in lengths]).alias("s"))
    here = here.select("doc_id", "version", "total", F.col("s.k").alias("k"), F.col("s.pos").alias("pos"), F.col("s.h").alias("h"))
    # Each pair of a document and an item is one row: which of the item's shingles it has, and the starts that they set.
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("q"), F.col("total") - F.col("n")))
    pairs = (
        here.join(near(spread), ["k", "h"]).groupBy("doc_id", "version", "item_id", "iv", "k", "n")
        .agg(F.collect_set("q").alias("known"), F.collect_set(start).alias("starts"))
        .where(F.size("known") >= F.lit(threshold - 1e-9) * (F.col("n") - F.col("k") + 1))
    )
    windows = pairs.select("doc_id", "version", "item_id", "iv", "k", "n", F.explode("starts").alias("start"))
    strings = lambda w, c: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - c)), lambda i: F.concat_ws(" ", F.slice(w, i + 1, c))
    )
    own = cut(bench.withColumn("i", strings(F.col("item"), F.col("k"))).select("item_id", "iv", "i", simhash(F.col("i")).alias("ib")))
    key = ["doc_id", "version", "item_id", "iv", "start"]
    prints = windows.join(suspects, ["doc_id", "version"]).withColumn("w", strings(F.slice("words", F.col("start") + 1, F.col("n")), F.col("k")))
    distance = F.size(F.filter(F.zip_with("wb", "ib", lambda a, b: a != b), lambda x: x))
    pairs = cut(
        prints.select(*key, "n", "w", simhash(F.col("w")).alias("wb")).join(near(own), ["item_id", "iv"])
        .withColumn("distance", distance).where(F.col("distance") <= RADIUS).select(*key, "n", "distance", "w", "i")
    )
    weights = (
        pairs.select(*key, F.explode("w").alias("s"), F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(pairs.select(*key, F.explode("i").alias("s"), F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy(*key, "s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .groupBy(*key).agg(F.sum(F.least("a", "b")).alias("shared"), F.sum(F.greatest("a", "b")).alias("united"))
    )
    similar = weights.where(F.col("shared") >= F.lit(threshold) * F.col("united")).join(pairs.select(*key, "n", "distance"), key)
    by = ["doc_id", "item_id", *["version"] * with_version]
    best = similar.groupBy(*by).agg(
        F.min(F.struct((-F.col("shared") / F.col("united")).alias("s"), "start", "n", "distance")).alias("m")
    )
    return best.select(
        *by, F.col("m.start").cast("long").alias("start_word"), F.col("m.n").cast("long").alias("n_words"),
        F.col("m.distance").alias("distance"), (-F.col("m.s")).alias("similarity"),
    )
