"""Exact deduplication over keyed streaming state.

Rows are staged as narrow keys (digest, id, content locator) in the shared folder and run through a Structured Streaming
aggregation whose state, held on disk by RocksDB and never expired, keeps for each digest the stable identifier that stays,
its locator and the group's size. Every hit is then checked byte by byte: in a digest's group the least and the greatest
text must be the same. Groups that fail are split by the whole text, so a weak or colliding digest can't drop a row.

Only DataFrame functions run on the main path. Hot groups: all aggregates combine before they shuffle, so a group of a
third of all rows sends one row a task; the final join on the digest is one that adaptive execution splits.

Defined cases: a null text is the empty text. A null id ranks below every other. Equal ids with equal texts are one
document: each such row is reported as kept or dropped alike, and `kept_rows` returns one of them. An empty table gives an
empty result. Further columns pass through `kept_rows` untouched and can't clash with the working names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelore.llm.store import new_path, remove, written
from voxelore.llm.text import ascii_lower

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Without it each state partition takes 4 MB of disk before it holds a row.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # A second file and its renames for each file of a state that is removed after the stream; the file system has its own sums.
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}
#: Keys in a partition of the state. Each partition is a RocksDB instance of its own, which costs memory, files and (for
#: files on local disks, whose modes and links Hadoop handles by commands) processes in each micro-batch, however few its rows.
STATE_ROWS = 50_000
#: The filter of byte checks has so many buckets at most, whatever the size of the input: about 8 MB as a broadcast.
HIT_BUCKETS = 1 << 20


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _bucket(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(HIT_BUCKETS))


def _keys(docs: DataFrame, digest: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        digest(normalised(F.col(text_col))).alias("digest"),
        F.col(id_col).alias("id"),
        F.input_file_name().alias("file"),
        F.monotonically_increasing_id().alias("position"),
    )


def run_state(keys_path: str, schema, spark: SparkSession, micro_batches: int) -> DataFrame:
    """Stream the staged keys through the keyed state; returns a row for each digest: head (id, file, position) and n."""
    updates, checkpoint = new_path(spark, "exact-updates"), new_path(spark, "exact-state")
    files = len(spark.read.schema(schema).parquet(keys_path).inputFiles())
    rows = spark.read.schema(schema).parquet(keys_path).count() if files else 0
    partitions = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // STATE_ROWS)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // micro_batches))).parquet(keys_path)
    state = stream.groupBy("digest").agg(F.max(F.struct("id", "file", "position")).alias("head"), F.count(F.lit(1)).alias("n"))
    conf = STATE_CONF | {"spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, _: batch.write.mode("append").parquet(updates))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    remove(spark, checkpoint)
    # A digest's head and count only grow, so the greatest of its updates is the last one.
    read = spark.read.schema(state.schema).parquet(updates) if files else spark.createDataFrame([], state.schema)
    return read.groupBy("digest").agg(F.max("head").alias("head"), F.max("n").alias("n"))


def _unlike(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column], text_col: str) -> DataFrame:
    """Digests whose rows do not all have the same bytes. Only rows in the bucket of a hit take part."""
    hits = state.where("n > 1").select(_bucket(F.col("digest")).alias("bucket")).distinct()
    texts = docs.select(normalised(F.col(text_col)).alias("text")).withColumn("digest", digest(F.col("text")))
    texts = texts.join(F.broadcast(hits), _bucket(texts["digest"]) == hits["bucket"], "left_semi")
    return texts.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most")).where("least <> most").select("digest")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    micro_batches: int = 4,
) -> DataFrame:
    """One row for each row of docs: id, digest, keep_id, group_size, kept, and the locator (keep_file) of the row that stays."""
    spark = docs.sparkSession
    keys_path = new_path(spark, "exact-keys")
    keys = written(_keys(docs, digest, id_col, text_col), "exact-keys", keys_path)
    state = written(run_state(keys_path, keys.schema, spark, micro_batches), "exact-groups")
    unlike = written(_unlike(docs, state, digest, text_col), "exact-unlike")
    heads = state.select("digest", F.col("head.id").alias("keep_id"), F.col("head.file").alias("keep_file"), F.col("n").alias("group_size"))
    if unlike.isEmpty():
        return keys.join(heads, "digest").select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "keep_file")
    good = keys.join(heads, "digest").join(unlike, "digest", "left_anti")
    texts = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"), F.input_file_name().alias("file"))
    texts = texts.withColumn("digest", digest(F.col("text"))).join(unlike, "digest", "left_semi")
    split = texts.groupBy("digest", "text").agg(F.max(F.struct("id", "file")).alias("head"), F.count(F.lit(1)).alias("group_size"))
    bad = texts.join(split, ["digest", "text"]).select("id", "digest", F.col("head.id").alias("keep_id"), "group_size", F.col("head.file").alias("keep_file"))
    rows = good.select(*bad.columns).unionByName(bad)
    return rows.select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "keep_file")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one for each group of equal texts, with all their columns."""
    spark = docs.sparkSession
    groups = exact_groups(docs, id_col, text_col)
    stays = written(groups.where("kept").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")), "exact-stays")
    clash = "__digest"
    while clash in docs.columns:
        clash += "_"
    keyed = docs.withColumn(clash, sha256(normalised(F.col(text_col))))

    def those(part: DataFrame) -> DataFrame:
        part = part.select(F.col("id").alias("__id"), F.col("digest").alias("__stays"))
        return keyed.join(part, keyed[id_col].eqNullSafe(part["__id"]) & (keyed[clash] == part["__stays"]), "left_semi")

    if stays.where("n > 1").isEmpty():
        return those(stays).drop(clash)
    repeated = those(stays.where("n > 1")).dropDuplicates([id_col, clash])
    return those(stays.where("n = 1")).unionByName(repeated).drop(clash)
