"""Run manifests: what ran, with which parameters, over which files."""

from __future__ import annotations

import hashlib
import json
import sys
import time

from pyspark.sql import SparkSession

from .readers import checksums


def file_digests(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of each file under a glob, computed by the executors; a row for each file comes back."""
    return {r.file: r.sha256 for r in checksums(spark, path).collect()}


def data_digest(digests: dict[str, str]) -> str:
    """One key for a set of files, whatever their order: names and contents."""
    return hashlib.sha256(json.dumps(sorted((f.rsplit("/", 1)[-1], d) for f, d in digests.items())).encode()).hexdigest()


def manifest(params: dict, digests: dict[str, str]) -> dict:
    made = time.strftime("%Y%m%dT%H%M%SZ", time.gmtime())
    return {"run_id": f"{made}-{data_digest(digests)[:8]}", "argv": sys.argv, "params": params, "files": digests, "data": data_digest(digests)}
