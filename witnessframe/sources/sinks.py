"""Evidence sinks: content-addressed objects, statement sidecars, idempotent outcomes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_key
from ..operators.ledger import first_writers, put_if_absent
from ..session import durable


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or an empty one while nothing has been written."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def of_prefixes(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stored rows in the partitions that ``wanted`` names: at most 256 two-digit prefixes, read on the driver."""
    prefixes = [r[0] for r in wanted.where("prefix is not null").distinct().collect()]
    return known.where(F.col("prefix").isin(prefixes)) if prefixes else known.where("false")


def write_content(objects: DataFrame, path: str) -> DataFrame:
    """Append contents under their digest key unless the key is stored already.

    objects: id, content. Returns every object with its key and whether it was deduplicated.
    """
    spark = objects.sparkSession
    keyed = objects.withColumn("key", content_key(F.col("content")))
    known = stored(spark, path, "id BIGINT, content STRING, key STRING, prefix STRING")
    known = of_prefixes(known, keyed.select(F.substring("key", 6, 2).alias("prefix"))).select("key")
    # Fixed before the write below changes what is stored.
    result = durable(first_writers(keyed.select("id", "key"), "key", "id", known).select("id", "key", "deduplicated"))
    fresh = put_if_absent(keyed, known, "key", "id").withColumn("prefix", F.substring("key", 6, 2))
    # Ranges of (prefix, key) keep a task to few prefixes and split a large prefix over tasks.
    fresh.repartitionByRange("prefix", "key").write.partitionBy("prefix").mode("append").parquet(path)
    return result


def write_sidecars(statements: DataFrame, path: str) -> None:
    """One JSON statement per object, filed by environment."""
    sidecars = statements.withColumn("sidecar_key", F.concat("key", F.lit(".attestation.json")))
    sidecars.write.partitionBy("env").mode("append").json(path)


def write_evidence(objects: DataFrame, path: str) -> None:
    """Evidence objects filed by environment and one of 256 issue buckets, so issues may be many; ``issue`` stays a column."""
    spread = [c for c in objects.columns if c not in ("env", "issue")]
    filed = objects.withColumn("issue_bucket", F.pmod(F.xxhash64("issue"), F.lit(256)).cast("int"))
    filed.repartitionByRange("env", "issue_bucket", "issue", *spread[:1]).write.partitionBy("env", "issue_bucket").mode("append").parquet(path)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """``app, batch, place``: which batches of the store at ``path`` are committed, in which order."""
    rows = [(app, int(batch), place) for place, (app, batch) in _commits(spark, path).items()]
    return spark.createDataFrame(rows, "app STRING, batch BIGINT, place BIGINT")


def _commits(spark: SparkSession, path: str) -> dict[int, tuple[str, str]]:
    """Records of the commit log; one small file name per batch, ``place--batch--app``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return {}
    names = [f.getPath().getName() for f in system.listStatus(folder)]
    places = {int(n): None for n in names if n.isdigit()}
    for place in places:
        lines = system.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/{place:020d}"))
        places[place] = tuple(spark._jvm.org.apache.commons.io.IOUtils.toString(lines, "UTF-8").split("\n", 1))
        lines.close()
    return {place: (app, batch) for place, (batch, app) in sorted(places.items())}


def commit(spark: SparkSession, path: str, app: str, batch_id: int) -> int:
    """The place of (app, batch) in the commit log; takes the next free one unless it has one.

    A record is created only if no other writer has taken its place, so of two writers at once one goes first.
    """
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    while True:
        known = _commits(spark, path)
        for place, of in known.items():
            if of == (app, str(batch_id)):
                return place
        place = max(known, default=-1) + 1
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/{place:020d}")
        system = target.getFileSystem(hadoop)
        draft = jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/draft-{uuid.uuid4().hex}")
        out = system.create(draft, True)
        out.write(bytearray(f"{batch_id}\n{app}".encode()))
        out.close()
        if not system.exists(target) and system.rename(draft, target):
            return place
        system.delete(draft, False)


def read_store(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The rows of the store, one per key: of rows that two writers stored at once, that of the batch committed first.

    Batches without a commit record are not read.
    """
    rows = stored(spark, path, f"{schema}, app STRING, batch BIGINT, prefix STRING")
    columns = [c for c in rows.columns if c != key]
    placed = rows.join(F.broadcast(committed(spark, path)), ["app", "batch"])
    first = placed.groupBy(key).agg(F.min_by(F.struct(*columns), "place").alias("_row"))
    return first.select(key, "_row.*").select(rows.columns)


def batch_store(path: str, app: str, schema: str, key: str, digest):
    """``foreachBatch`` function that stores the rows of each key once among all apps and batches.

    An (app, batch) owns one folder and replaces it, so a batch delivered again rewrites the
    same rows and can remove no other's. Keys that batches committed before it have stored are left out; they are looked up in
    the partitions of the batch's own key prefixes. Two writers at once may both store a key; the commit log says which was
    first, and ``read_store`` returns that row alone. ``app`` names the stream with its
    checkpoint: a stream that starts anew must come under a new name.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        filed = rows.withColumn("prefix", F.substring(digest(F.col(key)), 1, 2))
        known = of_prefixes(stored(spark, path, f"{schema}, app STRING, batch BIGINT, prefix STRING"), filed.select("prefix"))
        log = {of: place for place, of in _commits(spark, path).items()}
        own = log.get((app, str(batch_id)))
        # A batch delivered again leaves out what was committed before it was, no more.
        earlier = [(other_app, int(batch)) for (other_app, batch), place in log.items() if own is None or place < own]
        before = F.broadcast(spark.createDataFrame(earlier, "app STRING, batch BIGINT"))
        other = known.join(before, ["app", "batch"], "left_semi").select(key).distinct()
        filed.join(other, key, "left_anti").write.mode("overwrite").partitionBy("prefix").parquet(f"{path}/app={app}/batch={batch_id}")
        commit(spark, path, app, batch_id)

    return write


def outcome_writer(path: str, schema: str, app: str = "outcomes"):
    """``foreachBatch`` function keeping one row per outcome key; ``app`` names the delivering stream."""
    store = batch_store(path, app, schema, "outcome_key", F.sha1)

    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c != "outcome_key"]
        first = batch.groupBy("outcome_key").agg(F.min(F.struct(*rest)).alias("o")).select("outcome_key", "o.*")
        store(first, batch_id)

    return write
