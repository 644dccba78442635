"""Reading change messages: one JSON text per message, ``{resource, type, params}``.

The same functions serve batch and stream. Parameters are read as text first, because senders disagree about types: an
id may be a number, a state a number or text, a list of administrators a single text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_ENVELOPE = "resource string, type string, params string"


def _administrators(raw: Column) -> Column:
    one = F.when(raw.isNotNull(), F.array(raw))
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(one)


def _plain(raw: Column) -> Column:
    return raw


# Parameters of each message kind: name -> how its text becomes a value.
KINDS: dict[str, dict[str, object]] = {
    "BgAuth": {"id": _plain, "state": _plain, "msg": _plain},
    "BgDSDGrant": {"id": _plain, "dsd_val": lambda raw: raw.try_cast("double")},
    "BgFeedbackResp": {"id": _plain, "msg": _plain},
    "BgExamine": {"id": _plain, "state": lambda raw: raw.try_cast("int"), "state_msg": _plain},
    "BgXDImagesTag": {"id": _plain, "res": _plain, "err_reason": _plain},
    "BgFacsModify": {"id": _plain, "name": _plain, "title": _plain, "administrators": _administrators},
}


def parsed(messages: DataFrame) -> DataFrame:
    """``value`` split into resource, type and params; ``known`` tells messages that can be routed."""
    envelope = F.from_json("value", _ENVELOPE)
    opened = messages.select("value", envelope.alias("m")).select("value", "m.*")
    known = F.col("resource").isin(*KINDS) & F.coalesce(F.col("params").startswith("{"), F.lit(False))
    return opened.withColumn("known", F.coalesce(known, F.lit(False)))


def params_of(routed: DataFrame, resource: str) -> DataFrame:
    """The typed parameters of one kind of message."""
    fields = KINDS[resource]
    texts = F.from_json("params", ", ".join(f"`{name}` string" for name in fields))
    mine = routed.where(F.col("known") & (F.col("resource") == resource)).select("type", texts.alias("p"))
    return mine.select("type", *[read(F.col(f"p.{name}")).alias(name) for name, read in fields.items()])


def rejects(routed: DataFrame) -> DataFrame:
    return routed.where(~F.col("known")).select("value")


def read_messages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A folder of JSON lines as a stream."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def read_messages_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A topic as a stream; needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.col("value").cast("string").alias("value"))


def route(messages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Every kind of message into its own table under ``out``, the rest into ``out/rejects``.

    Folders are named after the micro-batch and overwritten, so a repeated batch leaves one copy.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        routed = parsed(batch).persist()
        try:
            for resource in KINDS:
                params_of(routed, resource).write.mode("overwrite").parquet(f"{out}/{resource}/batch={batch_id}")
            rejects(routed).write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")
        finally:
            routed.unpersist()

    return (
        messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
