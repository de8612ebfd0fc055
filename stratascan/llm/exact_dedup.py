"""Exact deduplication with a streaming, disk-backed keyed state.

Documents arrive as a stream of Parquet files. The state of a streaming aggregation, held by RocksDB and
checkpointed to the shared folder without expiry, keeps for every digest the stable identifier and the content
locator (file and row) of the first document and a count. The digest only proposes: where a key is hit more than
once, whole normalised texts are compared, and digests shared by different texts are split.

Null text counts as empty. Of equal texts the smallest doc_id stays; null ids come last, and rows with the same
id are told apart by their locator, so one row of a group stays even if it is repeated. An empty table gives an
empty result. Texts are compared whole, however long. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratascan.llm.common import materialize, shared_path

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # an open store keeps megabytes of local files per partition, however few keys it has
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}

#: Rows of one digest in one task, at most about.
ROWS_PER_SALT = 2000
#: A digest with more than this share of all rows is told to every task; there are at most HOT_KEYS of them.
HOT_KEYS = 1000
#: Bitmaps of 4096 rows each that every task is told at a time, about half a kilobyte of each.
TOLD_BITMAPS = 40_000


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; a single space already is one."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def located(docs: DataFrame, digest: Callable[[Column], Column] = sha256, with_text: bool = False) -> DataFrame:
    """(doc_id, file, row, digest[, content]) of a frame that reads files."""
    content = normalised(F.col("text"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
        digest(content).alias("digest"), *([content.alias("content")] if with_text else []),
    )


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row"))


def fold(arrivals: DataFrame, state_dir: str, updates_dir: str) -> None:
    """Run the stream of located documents to its present end, folding it into the state in ``state_dir``.

    A later call with the same folders takes up where this one ended: documents seen before are still known.
    """
    spark = arrivals.sparkSession
    state = arrivals.groupBy("digest").agg(_first().alias("first"), F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates_dir}/epoch={epoch}")

    with _settings(spark, _STATE):
        query = state.writeStream.outputMode("update").option("checkpointLocation", state_dir).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()


def current_state(spark: SparkSession, updates_dir: str) -> DataFrame:
    """(digest, first, n) as of the last epoch: firsts only fall and counts only grow."""
    schema = "digest string, first struct<no_id:boolean,doc_id:bigint,file:string,row:bigint>, n bigint"
    updates = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(updates_dir)
    return updates.groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))


def _with_state(rows: DataFrame, repeated: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows with the state of their digest where it is repeated; hot ones are dealt out over several tasks."""
    salts = F.ceil(F.col("hot_n") / ROWS_PER_SALT).cast("int")
    rows = rows.join(F.broadcast(hot), "digest", "left")
    rows = rows.withColumn("_salt", F.when(F.col("hot_n").isNull(), 0).otherwise(F.pmod(F.xxhash64("file", "row"), salts))).drop("hot_n")
    dealt = repeated.join(F.broadcast(hot), "digest", "left")
    dealt = dealt.withColumn("_salt", F.explode(F.when(F.col("hot_n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), salts - 1)))).drop("hot_n")
    return rows.join(dealt, ["digest", "_salt"], "left").drop("_salt")


def bitmaps(chosen: DataFrame) -> DataFrame:
    """(_file, _block, _bits, _batch) of rows (file, row): 64 words for every 4096 rows of a file that hold one; a written table. A batch has whole files, ``TOLD_BITMAPS`` bitmaps and those of
    its last file."""
    words = chosen.groupBy("file", F.shiftright("row", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(row & 63 as int))) AS bits"))
    held = words.groupBy("file", F.shiftright("word", 6).alias("_block")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(F.lit(63)).cast("int"), "bits"))).alias("m"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    held = materialize(held.select(F.col("file").alias("_file"), "_block", bits.alias("_bits")), "dedup-bits")
    files = held.groupBy("_file").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy("_file")) - F.col("n")  # a row per file
    return materialize(held.join(files.select("_file", F.floor(before / TOLD_BITMAPS).cast("int").alias("_batch")), "_file"), "dedup-bitmaps")


def pick(rows: DataFrame, chosen: DataFrame, inside: bool = True) -> DataFrame:
    """The rows (file, row, ..) that are among the chosen (file, row), or those that are not. Rows stay where they are read: tasks are told the bitmaps of a batch of files at a time, and
    each batch reads its own files."""
    bits = bitmaps(chosen)
    batches: dict[int, list[str]] = {}
    top = bits.agg(F.max("_batch")).first()[0] or 0
    if top:  # names of files, as many as there are
        for r in bits.select("_batch", "_file").distinct().collect():
            batches.setdefault(r["_batch"], []).append(r["_file"])
    at = (F.col("file") == F.col("_file")) & (F.shiftright("row", 12) == F.col("_block"))
    here = F.bit_get(F.get("_bits", F.shiftright("row", 6).bitwiseAND(F.lit(63)).cast("int")), F.col("row").bitwiseAND(F.lit(63)).cast("int")) == 1
    parts = []
    for b in sorted(batches) or [0]:
        own = rows.where(F.col("file").isin(batches[b])) if top else rows
        found = own.join(F.broadcast(bits.where(F.col("_batch") == b).drop("_batch")), at, "inner" if inside else "left")
        parts.append(found.where(here if inside else ~F.coalesce(here, F.lit(False))).select(rows.columns))
    if top and not inside:
        parts.append(rows.where(~F.col("file").isin([f for own in batches.values() for f in own])))
    return reduce(DataFrame.unionByName, parts)


def resolve(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, file, row, digest, keep_id, group_size, kept), after comparing whole texts wherever a digest was hit again."""
    repeated = materialize(state.where("n > 1"), "dedup-repeated")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = repeated.where(F.col("n") > max(ROWS_PER_SALT, total // HOT_KEYS)).select("digest", F.col("n").alias("hot_n"))
    rows = materialize(_with_state(located(docs, digest), repeated, hot), "dedup-rows")

    # whole texts are compared of those hit again; only these leave the tasks that read them, equal ones of a task as one
    texts = pick(located(docs, digest, with_text=True), rows.where("n IS NOT NULL").select("file", "row"))
    hits = texts.groupBy("digest", "content").agg(_first().alias("first"), F.count(F.lit(1)).alias("n"))
    classes = materialize(hits.withColumn("content", F.sha2(F.concat(F.lit("text:"), "content"), 256)), "dedup-classes")
    split = materialize(classes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "dedup-split")

    whole = rows.join(split, "digest", "left_anti")
    if not split.isEmpty():  # one digest, several texts: each text is a group of its own
        clashing = texts.withColumn("content", F.sha2(F.concat(F.lit("text:"), "content"), 256)).join(split, "digest")
        whole = whole.unionByName(clashing.join(classes, ["digest", "content"]).drop("content"))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    first = F.coalesce("first", own)
    return whole.select(
        "doc_id", "file", "row", "digest", first["doc_id"].alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"),
        ((first["file"] == F.col("file")) & (first["row"] == F.col("row"))).alias("kept"),
    )


def exact_dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """Deduplicate the Parquet documents under ``path``; see :func:`resolve` for the columns."""
    docs = spark.read.parquet(path)
    reader = spark.readStream.schema(docs.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    base = shared_path(spark, "dedup-state")
    arrivals = reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, it may name a folder or a single file
    fold(located(arrivals, digest), f"{base}/checkpoint", f"{base}/updates")
    if spark._jvm.org.apache.hadoop.fs.Path(f"{base}/updates").getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/updates")):
        state = current_state(spark, f"{base}/updates")
    else:  # no file arrived
        state = located(docs, digest).groupBy("digest").agg(_first().alias("first"), F.count(F.lit(1)).alias("n"))
    return resolve(docs, state, digest)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns. The rows are staged as files, which the stream then reads."""
    spark = docs.sparkSession
    path = shared_path(spark, "dedup-docs")
    staged = materialize(docs, "dedup-docs", path)
    drop = exact_dedup(spark, path).where("not kept").select("file", "row")
    at = staged.select(F.struct("*").alias("_doc"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return pick(at, drop, inside=False).select("_doc.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equals that stays."""
    out = exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


OP2_SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
"""
