"""Session settings."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the jobs rely on. Nothing here fixes a partition count: that
# is the cluster's business, and adaptive execution coalesces or splits from it.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even when that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A repeated JSON key keeps its last value, as dict-based readers do.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def get_session(app: str = "tripfold", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Gives the package to the executors, once for each context, as a zip that Spark hands out itself."""
    context = spark.sparkContext
    if getattr(context, "_tripfold_shipped", False):
        return spark
    package = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="tripfold-code-")) / "tripfold.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    context._tripfold_shipped = True
    return spark


def written(df: DataFrame) -> DataFrame:
    """df, written as a table below spark.checkpoint.dir and read again, so that plans which use it more than
    once don't run it more than once. A local session without that setting gets a temporary folder; a cluster
    must have it, since executors don't see one another's files."""
    context = df.sparkSession.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tripfold-")
    path = f"{base.rstrip('/')}/tripfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
