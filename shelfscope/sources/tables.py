"""Named tables: free SQL and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def custom_sql(spark: SparkSession, frames: dict[str, DataFrame], query: str) -> DataFrame:
    """Run any Spark SQL over the given frames under their names. Afterwards the names mean
    what they meant before: the caller's own temporary views are put back."""
    before = {
        name: spark.table(name)
        for name in frames
        if any(t.isTemporary and t.name.lower() == name.lower() for t in spark.catalog.listTables(pattern=name))
    }
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(query)  # names are resolved here
    finally:
        for name in frames:
            spark.catalog.dropTempView(name)
        for name, df in before.items():
            df.createOrReplaceTempView(name)


def table_info(df: DataFrame) -> DataFrame:
    """Per column: name, type, filled rows, distinct values, least and greatest value (as
    text), from one scan.

    The columns are turned into (name, value, n) rows that are combined on the map side.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("c"), F.lit(k).alias("k"), F.col(f"`{c}`").cast("string").alias("v"))
            for c, k in kinds.items()
        ]
    )
    values = df.select(F.explode(pairs).alias("p")).select("p.*")
    counts = values.groupBy("c", "k", "v").agg(F.count("*").alias("n"))
    return counts.groupBy(F.col("c").alias("column_name"), F.col("k").alias("column_type")).agg(
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"),
        F.count("v").alias("distinct_values"),
        F.min("v").alias("least"),
        F.max("v").alias("greatest"),
    )
