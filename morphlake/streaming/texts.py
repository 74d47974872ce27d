"""An addition of this library: lemmatization of a stream of texts against a static dictionary, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from morphlake.operators.lemmatize import by_arrow, collected, lemmatize_texts, shared_map
from morphlake.operators.lookup import SINGLE_THREAD, Variant


def lemmatize_batches(stream: DataFrame, dictionary: DataFrame, keys: list[str], path: str, checkpoint: str, text: str = "text", variant: Variant = SINGLE_THREAD) -> StreamingQuery:
    """Every micro-batch lemmatized and written under its batch number, so a batch that is run again replaces itself. The
    dictionary is collected and broadcast once, or joined in every batch if it is too large for that."""
    rows = collected(dictionary, variant) if variant.token_bytes is None and variant.misses else None
    shared = None if rows is None else shared_map(stream.sparkSession, rows)

    def write(batch: DataFrame, number: int) -> None:
        if shared is None:
            found = lemmatize_texts(batch, dictionary, keys, text, variant=variant, plan="join")
        else:
            found = by_arrow(batch, shared, keys, text, "whitespace", variant, "lemmatized")
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
