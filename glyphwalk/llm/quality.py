"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are fitted: one of the target text (labelled good), one
of the raw text (the labelled rows whatever their label, a random part of the corpus). A document's
log importance weight is the sum, over its distinct n-grams, of the log ratio of the two models; a
ratio that the counts can't tell from 1 is shrunk towards it by ``1 - (SHRINK / z)**2``, where z is
its standard score. Documents are then drawn without replacement by Gumbel top-k: the ``k`` largest
of ``log weight / temperature + Gumbel noise``, k being the labelled share of good rows times the
number of documents. Documents outside the sample are rejected.

n-grams: words as written, words in lower case without punctuation, pairs of the latter, and
n-grams of word classes, 2, 4 and 8 in a row, a word's class being whether it is the one before
again. Each is hashed to one of 2**BITS buckets of its kind. The two models are therefore 4 * 2**BITS
numbers, which is all that is sent to the driver and to tasks. Models are fitted on at most
``max_labels`` labelled rows (those of smallest hash, so any part of the corpus has its share);
everything else covers all rows.

The noise is a hash of id and text, so reruns agree. The k-th largest key is found by histograms of
4,096 bins, each narrowing the last, never by a global sort. Rows whose key ties with it are kept
too. Null text is the empty text (weight 0); null ids have no label; repeated rows have
equal keys and share their fate. Long texts are read whole, however long. Without labels every
document is kept; an empty table gives an empty result. Other columns pass through; one named like
a column of the result (``__weight``, ``__key``, ``__kept``) gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphwalk.llm._blocks import trim
from glyphwalk.llm._text import LOWER, U, batches, join_texts, mix, prefix_hashes, range_hashes, shingle_hashes, word_spans
from glyphwalk.plans.cut import cut

BITS = 17
PRIOR, SHRINK, TEMPERATURE, CLASSES = 1.0, 2.0, 1.0, (2, 4, 8)
PLAIN = np.full(256, 0x20, np.uint8)
for _i in range(256):
    if _i >= 128 or chr(_i).isalnum():
        PLAIN[_i] = LOWER[_i]


def class_ngrams(doc: np.ndarray, hashes: np.ndarray, texts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text index, n-gram hash) of the distinct n-grams of word classes of each text."""
    again = np.zeros(len(hashes), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    out = []
    for size in CLASSES:
        n = len(hashes) - size + 1
        if n <= 0:
            continue
        code = np.zeros(n, np.int64)
        for j in range(size):
            code = 2 * code + again[j : j + n]
        inside = doc[size - 1 :] == doc[:n]
        seen = np.zeros((texts, 1 << size), bool)
        seen[doc[:n][inside], code[inside]] = True
        at, code = np.nonzero(seen)
        out.append((at, mix((code + (1 << size)).astype(U) * U(0x9E3779B97F4A7C15))))
    return out


def features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, bucket) of the distinct hashed n-grams of each text, in order, and a hash of each text."""
    data, offsets = join_texts(texts)
    found = []
    for kind, view in enumerate((data, PLAIN[data])):
        if kind:
            view = view.copy()
            view[offsets[1:] - 1] = 0x0A
        starts, ends = word_spans(view)
        prefix = prefix_hashes(view)
        hashes = range_hashes(prefix, starts, ends)
        if not kind:
            whole = range_hashes(prefix, offsets[:-1], offsets[1:] - 1)
        doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
        found.append((doc, hashes, kind))
        if kind and len(hashes) > 1:
            same = doc[1:] == doc[:-1]
            found.append((doc[1:][same], shingle_hashes(hashes, 2)[same], 2))
        if kind:
            found += [(d, h, 3) for d, h in class_ngrams(doc, hashes, len(texts))]
    keys = np.concatenate([(d.astype(np.int64) << (BITS + 2)) | (k << BITS) | (h >> U(64 - BITS)).astype(np.int64) for d, h, k in found])
    keys = np.unique(keys)
    return keys >> (BITS + 2), keys & ((1 << (BITS + 2)) - 1), whole


def _batches(texts: pa.Array) -> Iterator[tuple[slice, list]]:
    values = texts.to_pylist()
    for part in batches([len(t or "") for t in values], 1 << 20):
        yield part, values[part]


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labels: int) -> tuple[np.ndarray, float | None]:
    """Log ratios of all buckets, and the share of good rows among the labelled."""
    judged = cut(
        labels.select(F.col("doc_id").cast("long").alias("i"), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good"))
        .where("i is not null and good is not null")
        .groupBy("i").agg(F.min("good").alias("good"))
        .withColumn("h", -F.pmod(F.xxhash64("i"), F.lit(1 << 52)).cast("double"))
    )
    if judged.count() > max_labels:
        judged = judged.where(F.col("h") >= F.lit(kth_largest(judged, "h", max_labels)))
    chosen = judged.select("i", "good").toArrow().sort_by("i")  # max_labels rows, of 9 bytes each
    if not chosen.num_rows:
        return np.zeros(1 << (BITS + 2), np.float32), None
    ids, good = chosen["i"].to_numpy(), chosen["good"].to_numpy()

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << (BITS + 2), np.int64), np.zeros(1 << (BITS + 2), np.int64)
        n = np.zeros(2, np.int64)
        for part in parts:
            i = part.column(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, i), len(ids) - 1)
            hit = np.flatnonzero(ids[at] == i)
            if not len(hit):
                continue
            mark = good[at[hit]]
            n += (len(hit), mark.sum())
            for piece, texts in _batches(part.column(1).take(pa.array(hit))):
                doc, bucket, _ = features(texts)
                raw += np.bincount(bucket, minlength=len(raw))
                target += np.bincount(bucket[mark[piece][doc]], minlength=len(raw))
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(raw[at], n[0])), pa.array(np.append(target[at], n[1]))], ["bucket", "raw", "target"])

    counted = (
        docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
        .join(F.broadcast(docs.sparkSession.createDataFrame(chosen.select(["i"]))), "i", "left_semi")  # at most max_labels rows
        .mapInArrow(count, "bucket long, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    )
    raw, target = np.zeros(1 << (BITS + 2)), np.zeros(1 << (BITS + 2))
    bucket, all_raw, all_target = (counted[c].to_numpy() for c in ("bucket", "raw", "target"))
    n, m = float(all_raw[bucket < 0].sum()), float(all_target[bucket < 0].sum())
    raw[bucket[bucket >= 0]], target[bucket[bucket >= 0]] = all_raw[bucket >= 0], all_target[bucket >= 0]
    del counted, bucket, all_raw, all_target
    trim()
    share = float(good.mean())
    if not n:
        return np.zeros(1 << (BITS + 2), np.float32), share
    expected = raw * (m / n)
    z = (target - expected) / np.sqrt(np.maximum(expected * (1 - m / n), 1e-9))
    ratio = np.log((target + PRIOR) / (expected + PRIOR))
    return (ratio * np.maximum(0, 1 - (SHRINK / np.maximum(np.abs(z), 1e-9)) ** 2)).astype(np.float32), share


def score(docs: DataFrame, ratios: np.ndarray, id_col: str, text_col: str, temperature: float = TEMPERATURE, seed: int = 7) -> DataFrame:
    """All columns of ``docs`` and __weight (log importance weight), __key (with Gumbel noise)."""
    names = docs.columns
    at_id, at_text = names.index(id_col), names.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("__weight", T.DoubleType()), T.StructField("__key", T.DoubleType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            weight, noise = np.zeros(part.num_rows), np.zeros(part.num_rows)
            ids = mix(pc.fill_null(part.column(at_id).cast(pa.int64()), -1).to_numpy(zero_copy_only=False).view(U) + U(seed))
            for piece, texts in _batches(part.column(at_text)):
                doc, bucket, whole = features(texts)
                weight[piece] = np.bincount(doc, weights=ratios[bucket], minlength=len(texts))
                noise[piece] = ((mix(whole + ids[piece]) >> U(11)).astype(np.float64) + 0.5) / 2.0**53
            weight = np.round(weight, 9)
            key = weight / temperature - np.log(-np.log(noise))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(weight), pa.array(key)], [*names, "__weight", "__key"])
            trim()

    return docs.mapInArrow(run, schema)


def kth_largest(df: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest value of a column without a sort: histograms narrow the range that holds it."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    above = 0
    while low is not None and low < high:
        width = (high - low) / 4096
        bin_of = F.least(F.lit(4095), F.floor((F.col(key) - low) / width)).cast("int")
        bins = {r[0]: r[1:] for r in df.where(F.col(key).between(low, high)).groupBy(bin_of.alias("b")).agg(F.count(F.lit(1)), F.min(key), F.max(key)).collect()}
        for b in sorted(bins, reverse=True):
            n, first, last = bins[b]
            if above + n >= k:
                if (first, last) == (low, high):
                    return last
                low, high = first, last
                break
            above += n
    return low


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_share: float | None = None,
    max_labels: int = 200_000,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """All rows and columns of ``docs`` with __weight, __key and __kept (in the sample)."""
    docs = docs.drop("__weight", "__key", "__kept")
    ratios, share = fit(docs, labels, id_col, text_col, max_labels)
    share = keep_share if keep_share is not None else 1.0 if share is None else share
    scored = cut(score(docs, ratios, id_col, text_col, temperature))
    k = round(share * scored.count())
    least = kth_largest(scored, "__key", k) if k > 0 else None
    return scored.withColumn("__kept", F.lit(False) if least is None else F.col("__key") >= F.lit(least))
