"""Folders for cases that write: always new, under the folder the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from geoledger.session import job_dir


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{job_dir(spark)}/{name}-{uuid.uuid4().hex}"
