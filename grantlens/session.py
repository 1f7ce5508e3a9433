"""Session and table access shared by all jobs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(app: str = "grantlens", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for scripts and tests; on a cluster use the session it gives you."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One input table. Only the columns a job selects are read from the files."""
    return spark.read.parquet(f"{base}/{name}.parquet")


#: Rows of an input table that one task takes where the work on each is heavy or makes it much wider.
SPREAD_ROWS = 100_000


def spread(tables: dict[str, DataFrame], by: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of `by` dealt by the hash of a column to one number of tasks, which grows with the largest of them.

    A file may hold all rows in one row group, which a single task reads, and narrow rows that are shuffled come
    in few, large partitions; what follows would run in as few tasks. Tables dealt by their join columns meet
    without another shuffle, and what is grouped by such a column stays where it is.
    """
    import math

    most = max(tables[name].count() for name in by)
    cores = next(iter(tables.values())).sparkSession.sparkContext.defaultParallelism
    n = max(math.ceil(most / SPREAD_ROWS), min(2 * cores, math.ceil(most / 1000)), 1)
    return tables | {name: tables[name].repartition(n, column) for name, column in by.items()}


def sql_over(spark: SparkSession, base: str, text: str, by: dict[str, str] | None = None) -> DataFrame:
    """Run SQL text over the input tables it mentions, those of `by` spread over tasks by a column.

    Every table is bound as a relation of this statement only, so nothing stays
    registered in the session.
    """
    import re

    reference = re.compile(r"\b(from|join)\s+(" + "|".join(TABLES) + r")\b", re.I)
    used = {m[2].lower() for m in reference.finditer(text)}
    bound = reference.sub(r"\1 {\2}", text)
    tables = {t: table(spark, base, t) for t in used}
    return spark.sql(bound, **(spread(tables, by) if by else tables))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as the cluster names it in `spark.checkpoint.dir`.

    Only a session whose executors live in the driver's own process may go without one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if named is None:
            import tempfile

            named = tempfile.mkdtemp(prefix="run-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    import uuid

    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate result that several branches read.

    The rows go to the shared checkpoint folder, so they survive lost executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark then drops the shuffle files of a query at its end, not when the driver's garbage collector meets their owner.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same as durable() for many rows: columns in Parquet files, whose size the planner knows."""
    path, conf = new_folder(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, None)
    conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(DROP_SHUFFLES) if before is None else conf.set(DROP_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
