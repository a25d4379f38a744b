"""Java sources of this package as Spark functions.

The driver compiles a source with Janino, the compiler that Spark brings for its own generated
code, and gives the classes to the executors as a jar. So no node needs a Java compiler.
"""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql.classic.column import _to_java_column, _to_seq

#: Class loaders by the application and the source's file name.
_loaders: dict[tuple[str, str], object] = {}


def _loader(spark: SparkSession, source: str):
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    key = (context.applicationId, source)
    if key not in _loaders:
        text = Path(__file__).with_name(source).read_text()
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook(text)
        folder = Path(tempfile.mkdtemp(prefix="routeloom-"))
        path = folder / f"{Path(source).stem}-{hashlib.sha256(text.encode()).hexdigest()[:16]}.jar"
        with zipfile.ZipFile(path, "w") as jar:
            for name, code in dict(compiler.getBytecodes()).items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        context._jsc.addJar(str(path))
        _loaders[key] = compiler.getClassLoader()
    return _loaders[key]


def _array(spark: SparkSession, kind, *items):
    out = spark.sparkContext._gateway.new_array(kind, len(items))
    for k, item in enumerate(items):
        out[k] = item
    return out


def function(spark: SparkSession, source: str, name: str, returns: str):
    """A function over columns: the class `name` in the file `source`, which has one of Spark's Java interfaces UDF0 to UDF22."""
    jvm, lang = spark.sparkContext._jvm, spark.sparkContext._jvm.java.lang
    own, kind = _loader(spark, source).loadClass(name), jvm.org.apache.spark.sql.types.DataType.fromDDL(returns)
    instance = own.getConstructor(_array(spark, lang.Class)).newInstance(_array(spark, lang.Object))
    # functions.udf by its signature: it also has one for any object, which py4j may choose
    make = lang.Class.forName("org.apache.spark.sql.functions").getMethod("udf", _array(spark, lang.Class, own.getInterfaces()[0], lang.Class.forName("org.apache.spark.sql.types.DataType")))
    # not deterministic: so that the optimiser does not put a call in several places
    found = make.invoke(None, _array(spark, lang.Object, instance, kind)).asNondeterministic()
    return lambda *columns: Column(found.apply(_to_seq(spark.sparkContext, columns, _to_java_column)))
