"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sets as U


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the session (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


# S08 ------------------------------------------------------------------------
def write_user_partitions(df: DataFrame, root: str, by=("data_subset", "split"), mode: str = "overwrite") -> None:
    """JSONL per user subset and split (``data_subset=<s>/split=<t>/part-*.json``)."""
    df.write.mode(mode).partitionBy(*by).json(root)


# S09 ------------------------------------------------------------------------
def write_if_absent(df: DataFrame, path: str, fmt: str = "parquet", **opts) -> bool:
    """Write only when ``path`` does not exist yet (checked before any work is planned).
    Returns whether it wrote."""
    spark = df.sparkSession
    if path_exists(spark, path):
        return False
    df.write.mode("ignore").format(fmt).options(**opts).save(path)
    return True


# S10 ------------------------------------------------------------------------
def write_report_csv(df: DataFrame, path: str) -> None:
    """A report table (one row per run: tiny by construction) as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


# S11 ------------------------------------------------------------------------
class AnnotationStore:
    """Persisted annotations as Parquet versions (``path/version=<n>``), unique on the key columns.

    A version counts once its ``_SUCCESS`` file is there, which Spark writes last; a save that breaks off leaves
    the version before it in force.  Versions older than the two last ones are removed by the next save.
    """

    def __init__(self, spark: SparkSession, path: str,
                 keys=("instruction", "input", "output_1", "output_2", "annotator")):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[tuple[int, bool]]:
        """(number, complete) of the folders there, ascending."""
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted((int(n.split("=")[1]), path_exists(self.spark, f"{self.path}/{n}/_SUCCESS")) for n in names if n.startswith("version="))

    def load(self) -> DataFrame | None:
        done = [v for v, ok in self._versions() if ok]
        return self.spark.read.parquet(f"{self.path}/version={done[-1]}") if done else None

    def save(self, new: DataFrame) -> DataFrame:
        """Merge ``new`` into the store (old rows win, noisy labels are not kept, one row per key), write it as a new
        version and return it."""
        old = self.load()
        store, _ = U.merge_store(new.limit(0) if old is None else old, new, self.keys)
        there = self._versions()
        path = f"{self.path}/version={there[-1][0] + 1 if there else 1}"
        store.write.mode("overwrite").parquet(path)
        for v, _ in there[:-2]:
            fs, p = self._fs(f"{self.path}/version={v}")
            fs.delete(p, True)
        return self.spark.read.parquet(path)


# S12 / S13 / S14 ------------------------------------------------------------
def write_generations(df: DataFrame, path: str, output: str = "output") -> None:
    """Prompt rows plus the generated text and its length, as JSON."""
    df.withColumn("output_length", F.length(output)).write.mode("overwrite").json(path)


def eval_prompt_table(df: DataFrame, path: str, prompt_id: str = "prompt_id", text: str = "text") -> None:
    """One row per prompt id (instead of one text file per id), as Parquet."""
    df.select(prompt_id, text).write.mode("overwrite").parquet(path)


def cache_embeddings(df: DataFrame, root: str, split: str) -> DataFrame:
    """Embedding table saved per split and reused when present."""
    path = f"{root.rstrip('/')}/split={split}"
    write_if_absent(df, path)
    return df.sparkSession.read.parquet(path)
