"""Many cases at once: every rule file with the layout of its name, compared with the expected answer where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netweave.functions.geometry import canonical_ring
from netweave.plans.trace import TraceOptions, trace_files
from netweave.sources.layout_text import format_ring, read_layout


def answer_rings(spark: SparkSession, path: str) -> DataFrame:
    """``name, ring`` of a result file or folder, a row for each polygon, whatever vertex its ring begins with."""
    made = read_layout(spark, path)
    return made.polygons.join(made.layers, "lid").select("name", format_ring(canonical_ring(F.col("v"))).alias("ring"))


def differences(spark: SparkSession, got: str, want: str) -> DataFrame:
    """``side, name, ring``: polygons that only one of two results has, as often as they do."""
    a, b = answer_rings(spark, got), answer_rings(spark, want)
    return a.exceptAll(b).withColumn("side", F.lit("got")).unionByName(b.exceptAll(a).withColumn("side", F.lit("want"))).select("side", "name", "ring")


def run_cases(spark: SparkSession, rules: str, layouts: str, answers: str | None, output: str, options: TraceOptions | None = None) -> DataFrame:
    """Trace every ``<name>.txt`` of ``rules`` with that of ``layouts``; ``name, reachable, equal``.

    ``equal`` is null where ``answers`` has no such file. Files are listed by Spark's file systems, so the folders may
    be anywhere it can read.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    where = path(rules)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in files.listStatus(where) if f.getPath().getName().endswith(".txt"))
    rows = []
    for name in names:
        out = f"{output}/{name.removesuffix('.txt')}"
        result = trace_files(spark, f"{layouts}/{name}", f"{rules}/{name}", out, options)
        equal = None
        if answers is not None and path(f"{answers}/{name}").getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(f"{answers}/{name}")):
            equal = differences(spark, out, f"{answers}/{name}").isEmpty()
        rows.append((name.removesuffix(".txt"), result.metrics.first()["reachable"], equal))
    return spark.createDataFrame(rows, "name string, reachable bigint, equal boolean")
