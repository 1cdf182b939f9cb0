"""Streams of texts: scored against a model, and counted by pattern in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphwalk.operators.analytics import contains
from glyphwalk.operators.language_model import LanguageModel


def score_stream(texts: DataFrame, model: LanguageModel, path: str, checkpoint: str, key: str = "id", tokens: str = "tokens") -> StreamingQuery:
    """Appends (batch, key, n_tokens, log_p, perplexity) of each arriving sequence to Parquet in ``path``.

    A batch that is run again after a failure replaces its own rows, so every sequence is there once.
    """

    def each(batch: DataFrame, number: int) -> None:
        model.sequence_scores(batch, key, tokens).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.select(key, tokens).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pattern_counts(texts: DataFrame, patterns: dict[str, str], time: str, window: str, late: str, text: str = "text", slide: str | None = None) -> DataFrame:
    """(window, pattern, n): texts that contain each pattern, per event-time window; rows later than ``late`` are left out."""
    named = F.filter(F.array(*[F.when(contains(F.col(text), p), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull())
    hits = texts.withWatermark(time, late).select(time, F.explode(named).alias("pattern"))
    return hits.groupBy(F.window(time, window, slide or window).alias("window"), "pattern").agg(F.count(F.lit(1)).alias("n"))
