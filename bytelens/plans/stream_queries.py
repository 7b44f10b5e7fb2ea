"""Queries of payload literals and of what streams compute, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bytelens.functions import stubs
from bytelens.plans import dex_queries, flow_queries
from bytelens.plans.encode import instructions
from bytelens.runtime import fresh_path, materialize
from bytelens.sources import bytecode, dex, payloads
from bytelens.streaming import pairing

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_X = "((o_orderkey % 100000) * 7919 + {i} * 31) * 2654435761 - 1000000000000000000"


@query(
    f"""WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS n, [1, 2, 4, 8][o_orderkey % 4 + 1] AS w FROM orders),
v AS (SELECT *, list_transform(range(0, n), lambda i: CAST(({_X.format(i='i')} + power(2, 8 * w - 1)::HUGEINT) % power(2, 8 * w)::HUGEINT + CASE WHEN ({_X.format(i='i')} + power(2, 8 * w - 1)::HUGEINT) % power(2, 8 * w)::HUGEINT < 0 THEN power(2, 8 * w)::HUGEINT ELSE 0 END - power(2, 8 * w - 1)::HUGEINT AS BIGINT)) AS xs FROM o)
SELECT o_orderkey AS method_uid, '/* v' || (o_orderkey % 16) || ' = {{ ' || array_to_string(list_transform(xs, lambda x: CAST(x AS VARCHAR)), ', ') || ' }} */' AS line, CAST(list_sum(list_transform(xs, lambda x: x % 1000)) AS BIGINT) AS check_sum FROM v"""
)
def array_literals(spark: SparkSession, d: str) -> DataFrame:
    """Array data of each width, read from code bytes that are built from orders."""
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("method_uid"), (k % 6).alias("n"), F.element_at(F.array(*map(F.lit, (1, 2, 4, 8))), (k % 4 + 1).cast("int")).alias("w"), (k % 16).alias("reg"), (k % 100000).alias("k"))
    le = lambda x, n: F.concat(*[F.substring(F.lpad(F.hex(x.cast("long")), 16, "0"), 17 - 2 * (j + 1), 2) for j in range(n)])
    x = lambda i: (F.col("k") * 7919 + i * 31) * F.lit(2654435761) - F.lit(1000000000000000000)
    value = lambda i: F.substring(le(x(i), 8), F.lit(1), 2 * F.col("w"))
    data = F.array_join(F.transform(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.array().cast("array<long>")), value), "")
    insns = F.concat(F.lit("26"), le(F.col("reg"), 1), le(F.lit(3), 4), F.lit("0003"), le(F.col("w"), 2), le(F.col("n"), 4), data, F.when((F.col("n") * F.col("w")) % 2 == 1, "00").otherwise(""))
    code = materialize(o.select("method_uid", F.unhex(insns).alias("insns")), "array-code")
    t = payloads.literals(code, bytecode.instructions(code))
    total = F.when(F.size("values") > 0, F.aggregate("values", F.lit(0).cast("long"), lambda a, v: a + v % 1000))
    return t.select("method_uid", "line", total.alias("check_sum"))


@query(
    f"""WITH {dex_queries._P} SELECT dex_id, class_name, 'switch (v2) {{ ' || array_to_string(list_concat(list_transform(range(0, cases), lambda i: 'case ' || CASE WHEN s % 2 = 0 THEN s + i ELSE 10 * s + 7 * i END || ':'), ['default: break; }}']), ' ') AS line FROM z"""
)
def switch_lines(spark: SparkSession, d: str) -> DataFrame:
    """Switches with their cases, from built DEX files."""
    f = dex_queries.built(spark, d)
    c = materialize(dex.code(f), "dex-code")
    names = dex.methods(f).select("dex_id", "method_idx", F.col("class").alias("class_name"))
    t = payloads.literals(c, bytecode.instructions(c))
    return t.join(c.select("method_uid", "dex_id", "method_idx"), "method_uid").join(names, ["dex_id", "method_idx"]).select("dex_id", "class_name", "line")


@query(f"WITH {flow_queries.RW} SELECT * FROM src")
def streamed_sources(spark: SparkSession, d: str) -> DataFrame:
    """API results found as instructions arrive: four batches of rows in no order."""
    path, out = fresh_path(spark, "arrivals"), fresh_path(spark, "streamed")
    ins = instructions(spark, d).select("method_uid", "off", F.lit(2).alias("size"), "mnemonic", "operands")
    ins.repartition(4, F.xxhash64("off", "method_uid")).write.parquet(path)
    pairing.use_store(spark)
    arrivals = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    pairing.paired(arrivals).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("method_uid long, off long, reg long, method_ref string").parquet(out)


_D = "(l_extendedprice - 30000.0)"
_E = "(l_quantity - 25.5)"


@query(
    f"SELECT l_orderkey, l_linenumber, {_D} + {_E} AS add_, {_D} - {_E} AS sub_, {_D} * {_E} AS mul_, {_D} / {_E} AS div_, sign({_D}) * fmod(abs({_D}), abs({_E})) AS rem_, CASE WHEN {_D} > 0 THEN 'Infinity' WHEN {_D} < 0 THEN '-Infinity' ELSE 'NaN' END AS by_zero FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem)"
)
def double_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Doubles: a zero divisor gives an infinity or no number."""
    a, b = F.col("l_extendedprice").cast("double") - 30000.0, F.col("l_quantity").cast("double") - 25.5
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.select("l_orderkey", "l_linenumber", *[stubs.double_op(o, a, b).alias(o + "_") for o in ("add", "sub", "mul", "div", "rem")], stubs.double_op("div", a, F.lit(0.0)).cast("string").alias("by_zero"))


@query("SELECT o_orderkey, CAST(((o_orderkey * 40503 + 2147483648) % 4294967296) - 2147483648 AS INTEGER) AS boxed, CAST(((o_orderkey * 40503 + 2147483648) % 4294967296) - 2147483648 AS VARCHAR) AS shown, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 0 END AS unboxed, 0 AS clock FROM orders")
def boxed_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Integers in boxes, and the clock, which stands still."""
    k = F.col("o_orderkey")
    i = (((k * 40503 + 2147483648) % 4294967296) - 2147483648).cast("int")
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", stubs.integer_value(i).alias("boxed"), stubs.integer_text(i).alias("shown"), stubs.integer_value(F.when(k % 2 == 0, k)).cast("long").alias("unboxed"), stubs.clock().alias("clock"))
