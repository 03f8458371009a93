"""Session settings that the operators count on."""

from __future__ import annotations

import tempfile
import tomllib
import uuid

from pyspark.sql import SparkSession

#: UTC timestamps; partition values stay text (a site may be called 2024); a rewrite replaces only its own sites.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def read_settings(text: str) -> dict[str, object]:
    """The settings of a run from TOML text: tables become dotted names, such as ``grid.patch``."""
    out: dict[str, object] = {}

    def add(table: dict, path: str) -> None:
        for k, v in table.items():
            if isinstance(v, dict):
                add(v, f"{path}{k}.")
            else:
                out[f"{path}{k}"] = v

    add(tomllib.loads(text), "")
    return out


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; where it is unset a fresh temporary
    folder is set on a single machine (a local master), and a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
