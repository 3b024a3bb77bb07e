"""The saved index: Parquet tables partitioned by repository and branch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables below one root folder. A partition (repository and branch) is replaced as a whole, by Spark's dynamic overwrite:
    its files are written aside and moved in at the end; without rows, the partition's folder goes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def save(self, table: str, df: DataFrame, repo: str, branch: str = "") -> None:
        """Replaces the rows of one repository and branch, by none if df has none; others stay."""
        if df.isEmpty() and self.exists(table):
            return self.drop(table, repo, branch)
        df.withColumns({"repo": F.lit(repo), "branch": F.lit(branch or "-")}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo", "branch").parquet(self.path(table))

    def load(self, table: str, repo: str | None = None, branch: str = "") -> DataFrame:
        df = self.spark.read.parquet(self.path(table))
        return df if repo is None else df.where((F.col("repo") == repo) & (F.col("branch") == (branch or "-"))).drop("repo", "branch")

    def update(self, table: str, new: DataFrame, gone: DataFrame, key: str, repo: str, branch: str = "") -> None:
        """Rows whose key is in gone or new are dropped, new rows come in. The result is written aside first, as the
        partition that it replaces is also what it reads."""
        old = self.load(table, repo, branch)
        keys = gone.select(key).unionByName(new.select(key)).distinct()
        aside = f"{self.root}/.staging/{uuid.uuid4().hex}"
        old.join(keys, key, "left_anti").unionByName(new, allowMissingColumns=True).write.parquet(aside)
        self.save(table, self.spark.read.parquet(aside), repo, branch)
        self._delete(aside)

    def append(self, table: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path(table))

    def upsert_delta(self, table: str, delta: DataFrame, repo: str, branch: str) -> None:
        """A branch's delta (file, action and payload): for each file the new rows replace those stored before."""
        if not self.exists(table):
            return self.save(table, delta, repo, branch)
        self.update(table, delta, delta.select("file").limit(0), "file", repo, branch)

    def trim(self, table: str, k: int, order: str = "ts") -> DataFrame:
        """The last k rows of an append-only table."""
        return self.spark.read.parquet(self.path(table)).orderBy(F.desc(order)).limit(k)

    def drop(self, table: str, repo: str, branch: str = "") -> None:
        name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName  # as the writer names folders
        self._delete(f"{self.path(table)}/repo={name(repo)}/branch={name(branch or '-')}")

    def repositories(self, table: str = "symbols") -> DataFrame:
        return self.spark.read.parquet(self.path(table)).groupBy("repo", "branch").agg(F.count("*").alias("rows"))

    def _delete(self, folder: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def carry_tokens(old: DataFrame, new: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens of symbols that kept id and content, symbols to tokenise again)."""
    same = new.join(old.select("id", "content_hash").distinct(), ["id", "content_hash"], "left_semi")
    return tokens.join(same.select("id"), "id", "left_semi"), new.join(same.select("id"), "id", "left_anti")
