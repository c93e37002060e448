"""Whole fits inside one task, in the JVM.

A converged fit takes thousands of steps of a few hundred moves each, so it runs
where its graph is, in one task; many fits run side by side.  Its loops are a Java
UDF (``Walkers.java``), which the Java compiler that Spark brings along (Janino)
translates at run time and Spark ships to the executors as a jar, so nothing has to be
built or installed.  Rows never leave the JVM.

``batch`` draws hash-uniform numbers, the same as ``operators.step`` does, so k
steps of it equal k steps of the DataFrame plan; ``sequential`` draws from one xorshift32
stream.  Both add up in a fixed order: equal input gives equal bits.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

CHECK_EVERY = 10
NAME = "starling_walkers"

_SOURCE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "Walkers.java")
_RESULT = StructType([
    StructField("cls", ArrayType(IntegerType())), StructField("dom", ArrayType(ArrayType(DoubleType()))), StructField("own", ArrayType(ArrayType(DoubleType()))),
    StructField("iterations", IntegerType()), StructField("seconds", DoubleType()),
])
_ready: dict[str, object] = {}


def _compiled(spark: SparkSession):
    """The UDF object; its classes go to the executors once an application."""
    app = spark.sparkContext.applicationId
    if app not in _ready:
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        with open(_SOURCE, encoding="utf-8") as f:
            compiler.cook(f.read())
        path = os.path.join(tempfile.mkdtemp(prefix="starling-jar-"), "walkers.jar")  # on the driver, which serves it to the executors
        classes = compiler.getBytecodes()
        with zipfile.ZipFile(path, "w") as z:
            for name in classes:
                z.writestr(name.replace(".", "/") + ".class", bytes(classes[name]))
        spark.sql(f"ADD JAR '{path}'")
        _ready[app] = compiler.getClassLoader().loadClass("starling.Walkers").getDeclaredConstructor(None).newInstance(None)
    return _ready[app]


def fit_column(spark: SparkSession, mode: str, c: int, weights: list[float], most: int, early: bool, p_grd: float, delta_v: float, deltap: float, max_iter: int, nodes: Column, classes: Column, src: Column, dst: Column, seed: Column) -> Column:
    """``cls, dom, own, iterations, seconds`` of a fit; ``nodes`` ascending with their ``classes`` (-1: unknown), edges sorted by (src, dst).

    The potential is looked at every CHECK_EVERY steps; more than ``most`` looks without a new best end the fit.
    """
    session = spark._jsparkSession
    session.udf().register(NAME, _compiled(spark), session.parseDataType(_RESULT.json()))
    settings = [float(mode == "sequential"), c, most, float(early), p_grd, delta_v, deltap, max_iter, CHECK_EVERY]
    literal = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    return F.call_udf(NAME, nodes, classes, src, dst, seed, literal(settings), literal(weights))
