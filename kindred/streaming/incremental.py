"""Linking noisy records as they arrive, against a fixed reference list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking, decode, knn, vectors
from ..plans.linker import Fitted, Linker, prepare
from ..sources import scratch


def record_stream(spark: SparkSession, path: str, schema: str, format: str = "parquet", per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", per_batch).load(path)


class Reference:
    """The fixed side: its names' weights and their frequencies, computed once for all batches."""

    def __init__(self, s1: DataFrame):
        texts = self._names(s1)
        self.idf = scratch.written(vectors.idf(texts), "idf")
        self.weights = scratch.written(vectors.tfidf(texts, fitted=self.idf), "weights")

    @staticmethod
    def _names(records: DataFrame) -> DataFrame:
        return blocking.texts_of(records, blocking.default_views()[0])

    def match(self, new: DataFrame, threshold: float) -> DataFrame:
        """(id1, id2, p): each new record's most similar name, whatever else arrives with it."""
        weights = vectors.tfidf(self._names(new), fitted=self.idf)
        return decode.decode(knn.sparse_best(self.weights, weights, 0, 2).withColumnRenamed("sim", "p"), threshold)


def link_stream(
    records: DataFrame, s1: DataFrame, sink: str, checkpoint: str, fitted: Fitted | None = None, threshold: float = 0.6
) -> StreamingQuery:
    """A query that appends (id1, id2, p, batch) to the folder `sink` for each micro-batch of raw records.

    Without a fitted model, names alone decide, by frequencies frozen on s1: a
    record's result doesn't depend on its batch. With a model, the features that
    set a reference record's candidates against each other see its batch only.
    A batch that is run again after a failure writes its own folder anew, which
    makes results exactly-once; what it wrote on the way is deleted at its end.
    """
    reference = None if fitted else Reference(s1)

    def link(batch: DataFrame, number: int) -> None:
        marks = scratch.since()
        new = prepare(batch.dropDuplicates(["entity_id"]))
        matches = Linker(fitted.config).transform(fitted, s1, new)[1] if fitted else reference.match(new, threshold)
        matches.select("id1", "id2", "p").write.mode("overwrite").parquet(f"{sink}/batch={number}")
        scratch.since(marks)

    return records.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
