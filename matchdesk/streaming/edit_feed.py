"""ST1: apply a feed of edits continuously (Structured Streaming).

Edits arrive as Parquet files in a folder. The newest value of every (row, field) is a
keyed aggregate in update mode, so it lives in Spark's own state store (RocksDB): a late
edit loses to a newer one in any file order, a replayed or restarted batch changes nothing,
and a batch costs what it brings, whatever came before. Two sinks hang on the feed:

* ``changes/batch=<n>``: the values that batch n touched, as they then stood. A replayed
  batch overwrites its own folder. Read in order of batches this is the audit trail.
* ``rejects``: edits of unknown fields and flags that are no integers (a file sink, exactly
  once).

The current table is the base with the state's values laid over it; the state is read
where it is (the ``statestore`` source). Whether a row exists is asked then, by the join that is needed
anyway: values of unknown rows find none, and ``unknown_rows`` lists them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchdesk import schema as S
from matchdesk.operators import edits as E
from matchdesk.operators.joins import known_keys, lookup, small_side

FEED_SCHEMA = T.StructType([T.StructField(f.name, f.dataType, True) for f in S.EDITS_SCHEMA.fields])
CHANGES_SCHEMA = "id bigint, field string, seq bigint, new_value string, edited_at timestamp_ntz, batch bigint"
REJECTS_SCHEMA = "seq bigint, id bigint, field string, new_value string, status string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class EditFeed:
    def __init__(self, spark: SparkSession, root: str, base: DataFrame):
        self.spark, self.root, self.base = spark, root.rstrip("/"), base

    def start(self, source_dir: str, files_per_batch: int | None = None, processing_time: str | None = None) -> list:
        """Start the stream over ``source_dir``; its two queries are returned.

        Default: process what is there and stop. With ``processing_time`` (e.g. "30 seconds")
        they keep running and the caller stops them. Started again, both go on where
        they were."""
        self.spark.conf.set(PROVIDER, ROCKSDB)
        reader = self.spark.readStream.schema(FEED_SCHEMA)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        checked = E.shape_checked(reader.parquet(source_dir))
        last = (checked.filter("status = 'ok'").groupBy("id", "field")
                .agg(F.max(F.struct("seq", "new_value", "edited_at")).alias("last")))
        writers = [
            last.writeStream.queryName("changes").outputMode("update").foreachBatch(self._log)
            .option("checkpointLocation", f"{self.root}/checkpoint"),
            checked.filter("status <> 'ok'").select("seq", "id", "field", "new_value", "status")
            .writeStream.queryName("rejects").format("parquet").option("path", f"{self.root}/rejects")
            .option("checkpointLocation", f"{self.root}/checkpoint-rejects")]
        trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
        queries = [w.trigger(**trigger).start() for w in writers]
        if not processing_time:
            for q in queries:
                q.awaitTermination()
        return queries

    def _log(self, batch: DataFrame, batch_id: int) -> None:
        batch.select("id", "field", "last.*").write.mode("overwrite").parquet(f"{self.root}/changes/batch={batch_id}")

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":  # no batch has been written yet
                return self.spark.createDataFrame([], schema)
            raise

    def last_values(self) -> DataFrame:
        """(id, field, seq, new_value) of every (row, field) edited so far, from the state store."""
        state = self.spark.read.format("statestore").option("path", f"{self.root}/checkpoint").load()
        return state.select("key.id", "key.field", "value.max.seq", "value.max.new_value")

    def current(self) -> DataFrame:
        """The table as of the last batch."""
        return E.overlay(self.base, self.last_values())

    def rejects(self) -> DataFrame:
        """Edits refused for their field or value."""
        return self._read(f"{self.root}/rejects", REJECTS_SCHEMA)

    def unknown_rows(self) -> DataFrame:
        """Values whose row is not in the table."""
        v = self.last_values()
        return v.join(small_side(known_keys(v, self.base, "id"), v.select("id")), "id", "left_anti")

    def changes(self) -> DataFrame:
        """What each batch left in the (row, field) pairs it touched."""
        return self._read(f"{self.root}/changes", CHANGES_SCHEMA)

    def audit(self) -> DataFrame:
        """The audit trail: key, field, old and new value of every change of an existing row, by batch.
        The old value is that of the batch before, or the base's."""
        c = self.changes()
        w = Window.partitionBy("id", "field").orderBy("batch")
        c = (c.withColumn("before", F.lag(F.struct("new_value", "seq")).over(w))
             .filter(F.col("before").isNull() | (F.col("before.seq") < F.col("seq"))))  # a late edit alters nothing
        rows = lookup(c, self.base.select("id", "canvas_id", "canvas_ssn", *S.EDITABLE_FIELDS), "id")
        old = F.when(F.col("before").isNull(), E.field_text(F.col("field"))).otherwise(F.col("before.new_value"))
        return rows.select(F.col("seq").alias("id"), "canvas_id", "canvas_ssn", F.col("field").alias("field_name"),
                           old.alias("old_value"), "new_value", F.col("edited_at").alias("updated_at"), "batch")
