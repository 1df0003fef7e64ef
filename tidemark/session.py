"""Session settings that the engine's results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings every session gets: UTC timestamps and ANSI arithmetic.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "tidemark", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; ``settings`` override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RESULT_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def check_settings(spark: SparkSession) -> None:
    """Results depend on the zone in which times are read and on strict arithmetic; other settings are an error."""
    wrong = {k: spark.conf.get(k, None) for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled") if spark.conf.get(k, None) != RESULT_SETTINGS[k]}
    if wrong:
        raise ValueError(f"these settings change results: {wrong}")


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
