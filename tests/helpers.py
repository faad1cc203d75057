from pyspark.sql import functions as F


def value(spark, column, **inputs):
    """Value of a column expression over one row of typed literals: name=(value, type)."""
    row = spark.range(1).select(*(F.lit(v).cast(t).alias(n) for n, (v, t) in inputs.items()), F.lit(1).alias("_one"))
    return row.select(column.alias("out")).first().out


def values(spark, column, rows, schema):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"_i int, {schema}")
    return [r.out for r in df.select("_i", column.alias("out")).orderBy("_i").collect()]


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
