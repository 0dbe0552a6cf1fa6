"""Spark vs DuckDB column types, for the oracle checks."""

DUCK_OF_SPARK = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE",
}


def duck_type(spark_type: str) -> str:
    if spark_type.startswith("array<"):
        return duck_type(spark_type[6:-1]) + "[]"
    return DUCK_OF_SPARK.get(spark_type, spark_type.upper())
