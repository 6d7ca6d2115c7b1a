"""Adding reads to a clustering as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ClusterConfig
from ..operators.cluster import add
from ..session import Durable


class GrowingClusters:
    """The reads so far and their clustering, in a folder that outlives the session: reads as parts, one for each batch, and
    the clustering as numbered versions, of which the last complete one holds.

    ``absorb`` clusters a batch of new reads into it. A version is complete once its table is, and its name tells the
    batch, so a batch that is run again after a failure, or after ``resume`` in another session, starts from the version
    before or is skipped. Of old versions only the last but one is kept.
    """

    def __init__(self, reads: DataFrame | None, clusters: DataFrame | None, config: ClusterConfig | None = None, folder: str | None = None, spark: SparkSession | None = None):
        self.spark, self.config = spark or reads.sparkSession, config or ClusterConfig()
        self.folder = (folder or Durable(self.spark, "growing").base).rstrip("/")
        self.done: set[int] = set()
        if reads is not None:
            reads.select("seq_id", "bases").write.mode("overwrite").parquet(f"{self.folder}/reads/part=-1")
            clusters.select("seq_id", "cluster_id").write.mode("overwrite").parquet(f"{self.folder}/clusters/0_start")
        self._load()

    @classmethod
    def resume(cls, spark: SparkSession, folder: str, config: ClusterConfig | None = None) -> GrowingClusters:
        """What a session left in a folder; an empty or unknown one is an error."""
        return cls(None, None, config, folder, spark)

    def _load(self) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/clusters")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
        versions = sorted((int(n.split("_")[0]), n) for n in names if files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/clusters/{n}/_SUCCESS")))
        if not versions:
            raise ValueError(f"no clustering in {self.folder}")
        self.version, name = versions[-1]
        log = [n.split("_")[1] for _, n in versions]
        self.done |= {int(x) for x in log if x.lstrip("-").isdigit()}
        self.clusters = self.spark.read.schema("seq_id bigint, cluster_id bigint").parquet(f"{self.folder}/clusters/{name}")
        # parts of batches whose clustering is not complete are written again
        parts = self.spark.read.schema("seq_id bigint, bases string, part int").parquet(f"{self.folder}/reads")
        self.reads = parts.where(F.col("part") < self.version).select("seq_id", "bases")
        for _, old in versions[:-2]:
            if old.split("_")[1] == "start" or not old.split("_")[1].isdigit():
                files.delete(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/clusters/{old}"), True)
            else:  # its name still tells that the batch is done
                for f in files.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/clusters/{old}")):
                    if f.getPath().getName().endswith(".parquet"):
                        files.delete(f.getPath(), False)

    def absorb(self, batch: DataFrame, number: int | None = None) -> None:
        """New reads must have ids above all others; reads known already and batches absorbed already are skipped."""
        if number in self.done:
            return
        part = f"{self.folder}/reads/part={self.version}"
        new = batch.select("seq_id", "bases").dropna().dropDuplicates(["seq_id"]).join(self.reads.select("seq_id"), "seq_id", "left_anti")
        new.write.mode("overwrite").parquet(part)
        new = self.spark.read.schema("seq_id bigint, bases string").parquet(part)
        grown = self.clusters if new.isEmpty() else add(self.reads, self.clusters, new, self.config)
        name = f"{self.version + 1}_{number if number is not None else 'one'}"
        grown.select("seq_id", "cluster_id").write.mode("overwrite").parquet(f"{self.folder}/clusters/{name}")
        self._load()

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Absorbs every micro-batch of a stream of (seq_id, bases)."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.absorb(df, n)).start()
