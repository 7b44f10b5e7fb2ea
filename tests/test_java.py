import pytest
from pyspark.sql import functions as F

from bytelens.functions import java


def one(spark, column, **values):
    t = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return t.select(column).first()[0]


@pytest.mark.parametrize("d,want", [("V", "void"), ("[[I", "int[][]"), ("Ljava/util/List;", "java.util.List"), ("[La/B;", "a.B[]"), ("Q", "Q"), ("", "")])
def test_descriptor(spark, d, want):
    assert one(spark, java.descriptor_to_java(F.col("d")), d=d) == want


@pytest.mark.parametrize("f,cls,want", [(0x19, False, "public static final"), (0x601, True, "public interface abstract"), (0x21, False, "public synchronized"), (0, True, "")])
def test_flags(spark, f, cls, want):
    assert one(spark, java.access_flags(F.col("f"), cls), f=f) == want


@pytest.mark.parametrize("c,want", [("v0 == 0", "v0 != 0"), ("v1 <= v2", "v1 > v2"), ("v1 < v2", "v1 >= v2"), ("flag", "!(flag)")])
def test_negate(spark, c, want):
    assert one(spark, java.negate(F.col("c")), c=c) == want


def test_filters(spark):
    assert one(spark, java.in_package(F.col("c"), "a.b."), c="a.b.C") and not one(spark, java.in_package(F.col("c"), "a.b"), c="a.bc.D")
    assert one(spark, java.excluded(F.col("c"), ["android.*"]), c="android.app.X")
    assert one(spark, java.receiver_call(F.col("m"), F.col("a")), m="a.B.run", a="v0, v1, v2") == "v0.run(v1, v2)"
    assert one(spark, java.shorten(F.col("t")), t="java.lang.String x; my.java.lang.Y") == "String x; my.Y"
    assert one(spark, java.shorten(F.col("t")), t="java.io.A myjava.io.B java.io.C") == "A myjava.io.B java.io.C"  # stops where a letter stands before
    assert one(spark, java.shorten(F.col("t")), t="android.widget.Text of java.net.URL") == "Text of java.net.URL"
    assert one(spark, java.receiver_call(F.col("m"), F.col("a")), m="a.B.run", a="f(v0, v1), v2") == "f(v0, v1).run(v2)"
    assert one(spark, java.receiver_call(F.col("m"), F.col("a")), m="a.B.run", a="") == "a.B.run()"
    assert one(spark, java.access_flags(F.col("f"), True), f=0x1011) == "public final synthetic"
    assert one(spark, java.is_branch_offset(F.col("t")), t="+008h") and not one(spark, java.is_branch_offset(F.col("t")), t="v0")
