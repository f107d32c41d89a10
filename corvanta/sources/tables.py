"""Readers of the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")


#: Bytes from which a table of few row groups is spread over the cores, and files of which footers are read for that.
SPREAD_BYTES = 4 << 20
FOOTERS = 64


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of ``folder``, through Spark's own reader, so any Hadoop path works."""
    return spread(spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))


def spread(table: DataFrame) -> DataFrame:
    """A scan of Parquet files, dealt anew if it has fewer row groups than there are cores.

    A row group is one task's, so that a file of a single one keeps all but one core
    idle in what follows. Columns are pruned and filters pushed before rows are dealt.
    Tables of at least as many files as cores are left as they are, without a look at
    their footers, and so are small ones.
    """
    spark = table.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = table.inputFiles()
    if not 0 < len(files) < min(cores, FOOTERS):
        return table
    hadoop, parquet = spark._jvm.org.apache.hadoop.fs, spark._jvm.org.apache.parquet.hadoop
    groups = size = 0
    for file in files:
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(hadoop.Path(file), spark._jsc.hadoopConfiguration()))
        blocks = reader.getFooter().getBlocks()
        groups += blocks.size()
        size += sum(block.getTotalByteSize() for block in blocks)
        reader.close()
    return table.repartition(cores) if groups < cores and size >= SPREAD_BYTES else table
