"""sparkseek: a PySpark-native query engine for append-only, schema-less record files."""

__version__ = "0.1.0"


def open(source, spark=None, **options):  # noqa: A001 - the name users expect
    """Open a DataFrame, or the path of a JSONL, CSV or Parquet file, as a ``Database``."""
    from sparkseek.plans.database import Database

    return Database.open(source, spark=spark, **options)
