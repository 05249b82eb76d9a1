"""The project's tables: Parquet folders under the project folder."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecairn.config import Config
from codecairn.plans.answers import FAILED, Answers, GenerationFailed
from codecairn.plans.versions import BucketedTable

# Columns of the stored tables.
SCHEMAS = {
    "source_facts": None,
    "articles": "name string, title string, type string, model string, commit string, "
    "commit_dirty boolean, content string",
    "article_sources": "name string, path string, hash string",
    "file_descriptions": "path string, language string, summary string, source_hash string, "
    "model string, markdown string",
    "symbol_descriptions": "path string, sym_ord int, scope_path string, kind string, "
    "signature string, description string, line_start int, line_end int",
    "sources": "path string, source_hash string, source string",
    "meta": "index string, key string, value string",
}


# Tables in buckets: the key of a merge or a look-up, and what tells its rows apart.
KEYS = {
    "articles": (("name",), ()),
    "article_sources": (("name",), ("path",)),
    "file_descriptions": (("path",), ()),
    "sources": (("path",), ()),
    "functions": (("path",), ()),
    "calls": (("path",), ()),
    "symbol_descriptions": (("path",), ()),
}

# Keys a reader looks single rows up by.
_POINT_KEYS = ("path", "chunk_ord")


class Store:
    """Named tables of one project."""

    def __init__(self, spark: SparkSession, config: Config) -> None:
        self.spark = spark
        self.config = config
        self.run = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")

    def exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.config.table(name))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(path)

    def bucketed(self, name: str) -> BucketedTable:
        key, within = KEYS[name]
        return BucketedTable(self.spark, self.config.table(name), key, within)

    def read(self, name: str) -> DataFrame:
        """The table; one that was never written is empty, or an error without a schema."""
        if name in KEYS and self.bucketed(name).exists():
            return self.bucketed(name).read()
        if not self.exists(name):
            schema = SCHEMAS.get(name)
            if schema is None:
                raise FileNotFoundError(f"table {name} was not built yet")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(self.config.table(name))

    def lookup(self, name: str, value: str) -> DataFrame:
        """Rows of one key of a merged table; one bucket is read."""
        table = self.bucketed(name)
        return table.lookup(value) if table.exists() else self.read(name)

    def write(self, name: str, df: DataFrame, by: str | None = None, rank: tuple[str, ...] = ()) -> None:
        """Replace the table, in buckets if it is one of ``KEYS``.

        With ``rank`` rows are range-partitioned in that order, so that a
        filter on its first column skips most row groups; used for narrow
        rows.  With ``by`` the table is partitioned by that column and sorted
        inside each task, without a shuffle.
        """
        if name in KEYS:
            self.bucketed(name).replace(df)
            return
        if rank:
            df = df.repartitionByRange(*rank).sortWithinPartitions(*rank)
        elif by:
            df = df.sortWithinPartitions(by, *(c for c in _POINT_KEYS if c in df.columns))
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(self.config.table(name))

    def merge(self, name: str, fresh: DataFrame, gone: DataFrame | None = None) -> None:
        """Replace the rows of the keys in ``fresh``, drop those in ``gone``, keep the others (``KEYS``)."""
        self.bucketed(name).merge(fresh, gone)

    # -- generated text ---------------------------------------------------------

    def ask(self, prompts: DataFrame, keys: list[str], model: str, force: bool = False) -> DataFrame:
        """``(keys…, prompt, max_tokens)`` to ``(keys…, state, attempts, response, error)``."""
        return Answers(self.spark, self.config.table("attempts"), model, self.run).ask(prompts, keys, force)

    def answer(self, prompts: DataFrame, keys: list[str], model: str, force: bool = False) -> DataFrame:
        """``(keys…, prompt, max_tokens)`` to ``(keys…, response)``, an error if one is missing."""
        asked = self.ask(prompts, keys, model, force)
        failed = asked.where(F.col("state") == FAILED).select("error").limit(1).collect()
        if failed:
            raise GenerationFailed(failed[0].error)
        return asked.select(*keys, "response")
