"""The coder of ``mixing_coder`` as columns that executors evaluate in the JVM, a block of ids each.

Both write and read the same bytes.  The source, ``BlockCoder.java``, is compiled
by the driver with the compiler that Spark itself uses for its plans, and goes to
the executors as a jar.
"""

from __future__ import annotations

import pkgutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_PACKAGE = "tidemark"
#: Classes by application, so that it compiles them once.
_LOADED: dict[str, dict] = {}


def _coders(spark: SparkSession) -> dict:
    sc = spark.sparkContext
    if sc.applicationId not in _LOADED:
        source = f"package {_PACKAGE};\n" + pkgutil.get_data(__package__, "BlockCoder.java").decode()
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(source)
        path = Path(tempfile.mkdtemp(prefix="tidemark-")) / f"tidemark-coder-{sc.applicationId}.jar"
        with zipfile.ZipFile(path, "w") as jar:
            for name, code in compiler.getBytecodes().items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(path.as_uri())
        loader = compiler.getClassLoader()
        _LOADED.clear()
        _LOADED[sc.applicationId] = {name: loader.loadClass(f"{_PACKAGE}.{name}").getDeclaredConstructor(None).newInstance(None) for name in ("EncodeBlock", "DecodeBlock")}
    return _LOADED[sc.applicationId]


def _applied(spark: SparkSession, name: str, column: Column) -> Column:
    """Through a function registered by name: that call takes Java functions of one argument and no Scala ones."""
    binary = spark.sparkContext._jvm.org.apache.spark.sql.types.DataTypes.BinaryType
    spark._jsparkSession.udf().register(f"{_PACKAGE}_{name}", _coders(spark)[name], binary)
    return F.call_function(f"{_PACKAGE}_{name}", column)


def encoded(spark: SparkSession, ids: Column) -> Column:
    """The coded form of little-endian uint32 ids; ids from 65536 on are an error."""
    return _applied(spark, "EncodeBlock", ids)


def decoded(spark: SparkSession, coded: Column) -> Column:
    """The ids of a coded block, as little-endian uint32; a damaged block is an error."""
    return _applied(spark, "DecodeBlock", coded)
