"""The tree grower that runs inside Spark's executors, compiled by the compiler that Spark brings along."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SOURCE = Path(__file__).with_name("Grower.java")

#: The class of each application, whose executors have it in a jar.
_classes: dict[str, object] = {}


def grower(spark: SparkSession):
    """The class of ``Grower.java``, compiled and sent to the executors once per application."""
    key = spark.sparkContext.applicationId
    if key not in _classes:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(SOURCE.read_text())
        jar = Path(tempfile.mkdtemp(prefix="carespend-")) / "carespend-grower.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(f"{name.replace('.', '/')}.class", code)
        spark.sparkContext._jsc.addJar(str(jar))
        _classes[key] = compiler.getClassLoader().loadClass("carespend.Grower")
    return _classes[key]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole or floating-point numbers as bytes, each after its length."""
    return b"".join(np.array([len(a)], "<i4").tobytes() + np.ascontiguousarray(a, a.dtype.newbyteorder("<")).tobytes() for a in arrays)


def grown(rows: DataFrame, known: bytes, schema: str) -> DataFrame:
    """The trees of the lots that ``rows`` are dealt by, a partition per lot."""
    spark = rows.sparkSession
    made = grower(spark).getDeclaredConstructor(spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Class, 0)).newInstance(
        spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 0)
    )
    made.configure(known)
    kind = spark._jsparkSession.parseDataType(T._parse_datatype_string(schema).json())
    return DataFrame(rows._jdf.mapPartitions(made, spark._jvm.org.apache.spark.sql.Encoders.row(kind)), spark)
