"""SparkSession builder with the settings every query of the library assumes."""

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", app: str = "docsense", **conf: str) -> SparkSession:
    """UTC session time zone and adaptive execution on; further settings by keyword (dots as ``__``)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
