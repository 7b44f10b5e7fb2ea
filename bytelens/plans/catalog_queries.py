"""Queries over names, flags, intervals and the scalar library, on the driver's tables; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from bytelens.functions import java, stubs
from bytelens.operators.intervals import overlaps

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_CLS = "(SELECT p_partkey, 'com.' || replace(lower(p_type), ' ', '.') AS cls, p_size FROM part)"


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", F.concat(F.lit("com."), F.replace(F.lower("p_type"), F.lit(" "), F.lit("."))).alias("cls"), "p_size", "p_name")


@query(f"SELECT p_partkey, cls FROM {_CLS} WHERE (cls = 'com.small' OR starts_with(cls, 'com.small.') OR cls = 'com.large' OR starts_with(cls, 'com.large.')) AND NOT (cls = 'com.small.plated' OR starts_with(cls, 'com.small.plated.'))")
def class_filter(spark: SparkSession, d: str) -> DataFrame:
    c = _classes(spark, d)
    return c.where((java.in_package(F.col("cls"), "com.small.") | java.in_package(F.col("cls"), "com.large")) & ~java.excluded(F.col("cls"), ["com.small.plated.*"])).select("p_partkey", "cls")


@query(f"SELECT cls, p_partkey FROM (SELECT cls, p_partkey, row_number() OVER (PARTITION BY cls ORDER BY p_size, p_partkey) AS n FROM {_CLS}) WHERE n = 1")
def find_first(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("cls").orderBy("p_size", "p_partkey")
    return _classes(spark, d).withColumn("n", F.row_number().over(w)).where("n = 1").select("cls", "p_partkey")


@query(
    f"""WITH c AS (SELECT p_partkey, cls, regexp_extract(cls, '([^.]*)$', 1) AS simple FROM {_CLS}), want AS (SELECT DISTINCT 'com.small.plated.' || simple AS name, simple FROM c),
m AS (SELECT w.name, c.cls, c.p_partkey, CASE WHEN c.cls = w.name THEN 0 ELSE 1 END AS pr FROM want w JOIN c ON c.cls = w.name OR c.simple = w.simple)
SELECT name, cls, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pr, p_partkey) AS n FROM m) WHERE n = 1"""
)
def simple_name_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Exact class name first, else the simple name in any package; each side an equi-join."""
    c = _classes(spark, d).withColumn("simple", java.simple_name(F.col("cls")))
    want = c.select("simple").distinct().withColumn("name", F.concat(F.lit("com.small.plated."), "simple"))
    first = lambda t: t.groupBy("name").agg(F.min_by("cls", "p_partkey").alias("cls"), F.min("p_partkey").alias("p_partkey"))
    by_simple = first(c.groupBy("simple").agg(F.min_by("cls", "p_partkey").alias("cls"), F.min("p_partkey").alias("p_partkey")).join(want, "simple"))
    exact = first(c.select(F.col("cls").alias("name"), "cls", "p_partkey").join(want.select("name"), "name"))
    return by_simple.join(exact.withColumnsRenamed({"cls": "c2", "p_partkey": "p2"}), "name", "left").select("name", F.coalesce("c2", "cls").alias("cls"), F.coalesce("p2", "p_partkey").alias("p_partkey"))


_DESC = """(SELECT p_partkey, repeat('[', p_size % 3) || CASE p_size % 11 WHEN 0 THEN 'V' WHEN 1 THEN 'Z' WHEN 2 THEN 'B' WHEN 3 THEN 'S' WHEN 4 THEN 'C' WHEN 5 THEN 'I' WHEN 6 THEN 'J' WHEN 7 THEN 'F' WHEN 8 THEN 'D' WHEN 9 THEN 'Q'
 ELSE 'L' || replace(p_type, ' ', '/') || ';' END AS descriptor, p_size FROM part)"""


@query(
    f"""SELECT p_partkey, descriptor, CASE WHEN starts_with(b, 'L') THEN replace(regexp_extract(b, '^L([^;]*)', 1), '/', '.') ELSE
CASE b WHEN 'V' THEN 'void' WHEN 'Z' THEN 'boolean' WHEN 'B' THEN 'byte' WHEN 'S' THEN 'short' WHEN 'C' THEN 'char' WHEN 'I' THEN 'int' WHEN 'J' THEN 'long' WHEN 'F' THEN 'float' WHEN 'D' THEN 'double' ELSE b END END || repeat('[]', n) AS java_name
FROM (SELECT *, ltrim(descriptor, '[') AS b, p_size % 3 AS n FROM {_DESC})"""
)
def descriptor_to_java(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "part").selectExpr("p_partkey", _DESC[_DESC.index("repeat(") : _DESC.rindex(" AS descriptor")] + " AS descriptor")
    return t.select("p_partkey", "descriptor", java.descriptor_to_java(F.col("descriptor")).alias("java_name"))


def _flag_sql(table) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN (f & {bit}) != 0 THEN '{w}' END" for bit, w in table) + "], lambda x: x IS NOT NULL), ' ')"


@query(f"SELECT o_orderkey, {_flag_sql(java.FLAGS[:5] + java.CLASS_FLAGS + java.FLAGS[5:])} AS class_flags, {_flag_sql(java.FLAGS[:5] + java.MEMBER_FLAGS + java.FLAGS[5:])} AS member_flags FROM (SELECT o_orderkey, o_orderkey % 2048 AS f FROM orders)")
def access_flags(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("o_orderkey") % 2048
    return _t(spark, d, "orders").select("o_orderkey", java.access_flags(f, True).alias("class_flags"), java.access_flags(f, False).alias("member_flags"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') AS escaped FROM pages""")
def java_escape(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", java.escape(F.col("html")).alias("escaped"))


@query(f"SELECT p_partkey, cls, replace(cls, '.', '/') || '.java' AS path, regexp_extract(cls, '^(.*)[.][^.]*$', 1) AS package, regexp_extract(cls, '([^.]*)$', 1) AS simple FROM {_CLS}")
def class_path(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("cls")
    return _classes(spark, d).select("p_partkey", "cls", java.class_path(c).alias("path"), java.package_of(c).alias("package"), java.simple_name(c).alias("simple"))


@query("SELECT l_orderkey, l_linenumber, coalesce(p_name, 'string@' || CAST(l_partkey AS VARCHAR)) || ', ' || coalesce(s_name, 'type@' || CAST(l_suppkey AS VARCHAR)) || ', ' || coalesce('f' || CAST(o_custkey AS VARCHAR), 'field@' || CAST(l_orderkey AS VARCHAR)) AS operands FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) p ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') o ON o_orderkey = l_orderkey")
def operand_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Pool lookups by left joins; what is not in a pool stays as its token. Spark picks broadcast by size."""
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = _t(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    o = _t(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    t = li.join(p, "l_partkey", "left").join(s, "l_suppkey", "left").join(o, "l_orderkey", "left")
    tok = lambda kind, c: F.concat(F.lit(kind + "@"), F.col(c).cast("string"))
    return t.select("l_orderkey", "l_linenumber", F.concat_ws(", ", F.coalesce("p_name", tok("string", "l_partkey")), F.coalesce("s_name", tok("type", "l_suppkey")), F.coalesce(F.concat(F.lit("f"), F.col("o_custkey").cast("string")), tok("field", "l_orderkey"))).alias("operands"))


_FQN = "CASE WHEN p_size % 5 = 0 THEN 'int' WHEN p_size % 5 = 1 THEN 'java.lang.T' || CAST(p_size AS VARCHAR(9)) WHEN p_size % 5 = 2 THEN 'app.s' || CAST(l_suppkey % 3 AS VARCHAR(9)) || '.C' || CAST(p_size AS VARCHAR(9)) ELSE 'lib.' || replace(lower(p_type), ' ', '.') END"


@query(
    f"""SELECT l_suppkey, string_agg(fqn, ',' ORDER BY fqn) AS imports FROM (SELECT DISTINCT l_suppkey, {_FQN} AS fqn, 'app.s' || CAST(l_suppkey % 3 AS VARCHAR) AS own FROM lineitem JOIN part ON p_partkey = l_partkey)
WHERE contains(fqn, '.') AND NOT starts_with(fqn, 'java.lang.') AND NOT starts_with(fqn, own || '.') GROUP BY l_suppkey"""
)
def imports(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names a class uses but primitives, java.lang, its own package and those below; sorted."""
    t = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(_t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    t = t.selectExpr("l_suppkey", f"{_FQN} AS fqn", "'app.s' || CAST(l_suppkey % 3 AS STRING) AS own").distinct()
    t = t.where(F.col("fqn").contains(".") & ~F.col("fqn").startswith("java.lang.") & ~F.expr("startswith(fqn, own || '.')"))
    return t.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("fqn")), ",").alias("imports"))


@query("SELECT o_orderkey, 'v' || CAST(o_orderkey % 7 AS VARCHAR) || ' ' || op || ' ' || CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE 'v' || CAST(o_custkey % 5 AS VARCHAR) END AS cond, 'v' || CAST(o_orderkey % 7 AS VARCHAR) || ' ' || neg || ' ' || CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE 'v' || CAST(o_custkey % 5 AS VARCHAR) END AS negated FROM (SELECT *, ['==', '!=', '<', '>=', '>', '<='][o_custkey % 6 + 1] AS op, ['!=', '==', '>=', '<', '<=', '>'][o_custkey % 6 + 1] AS neg FROM orders)")
def conditions(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").withColumn("kind", F.element_at(F.array(*[F.lit(x) for x in java.CONDITIONS]), (F.col("o_custkey") % 6 + 1).cast("int")))
    even = F.col("o_orderkey") % 2 == 0
    m = F.concat(F.lit("if-"), "kind", F.when(even, "z").otherwise(""))
    ops = F.concat(F.lit("v"), (F.col("o_orderkey") % 7).cast("string"), F.when(even, "").otherwise(F.concat(F.lit(", v"), (F.col("o_custkey") % 5).cast("string"))), F.lit(", +8"))
    c = o.select("o_orderkey", java.condition(m, ops).alias("cond"))
    return c.withColumn("negated", java.negate(F.col("cond")))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_chars, CASE WHEN strpos(text, 'the') = 0 THEN -1 ELSE CAST(strlen(substr(text, 1, strpos(text, 'the') - 1)) AS BIGINT) END AS index_of, CAST(contains(text, 'ou') AS BIGINT) AS has_ou, CAST(starts_with(text, 'The') AS BIGINT) AS starts, CAST(suffix(text, '.') AS BIGINT) AS ends, CAST(text = '' AS BIGINT) AS is_empty, CAST(CASE WHEN length(text) > 3 THEN unicode(substr(text, 4, 1)) ELSE 0 END AS BIGINT) AS char_at, substr(text, 3, 5) AS sub, replace(text, 'e', '3') AS replaced FROM documents")
def string_stubs(spark: SparkSession, d: str) -> DataFrame:
    t, b = F.col("text"), lambda c: c.cast("long")
    return _t(spark, d, "documents").select(
        "doc_id", b(stubs.string_length(t)).alias("n_bytes"), b(F.char_length(t)).alias("n_chars"), b(stubs.index_of(t, F.lit("the"))).alias("index_of"), b(t.contains("ou").cast("int")).alias("has_ou"), b(t.startswith("The").cast("int")).alias("starts"),
        b(t.endswith(".").cast("int")).alias("ends"), b((t == "").cast("int")).alias("is_empty"), b(stubs.char_at(t, F.lit(3))).alias("char_at"), F.substring(t, 3, 5).alias("sub"), F.replace(t, F.lit("e"), F.lit("3")).alias("replaced"),
    )


_A, _B = "(o_orderkey * 715827883) % 4294967296 - 2147483648", "(o_custkey * 1540483477) % 4294967296 - 2147483648"


def _w(e: str) -> str:
    return f"((({e}) % 4294967296 + 4294967296) % 4294967296 + 2147483648) % 4294967296 - 2147483648"


@query(
    f"""SELECT o_orderkey, CAST({_w('a + b')} AS BIGINT) AS add_, CAST({_w('a - b')} AS BIGINT) AS sub_, CAST({_w('CAST(a AS HUGEINT) * b')} AS BIGINT) AS mul_, (a & b) AS and_, (a | b) AS or_, xor(a, b) AS xor_,
CAST({_w('CAST(a AS HUGEINT) * (1 << (b & 31))')} AS BIGINT) AS shl_, CAST(floor(CAST(a AS DOUBLE) / (1 << (b & 31))) AS BIGINT) AS shr_, greatest(a, b) AS max_, least(a, b) AS min_, abs(a) AS abs_, a % b AS rem_
FROM (SELECT o_orderkey, {_A} AS a, {_B} AS b FROM orders)"""
)
def int_stubs(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "orders").selectExpr("o_orderkey", f"{_A} AS a", f"{_B} AS b")
    a, b = F.col("a"), F.col("b")
    return t.select("o_orderkey", *[stubs.int_op(o, a, b).cast("long").alias(o + "_") for o in ("add", "sub", "mul", "and", "or", "xor", "shl", "shr")], F.greatest(a, b).alias("max_"), F.least(a, b).alias("min_"), F.abs(a).alias("abs_"), stubs.int_op("rem", a, b).alias("rem_"))


@query("SELECT event_id, CASE WHEN regexp_matches(s, '^[+-]?[0-9]{1,11}$') THEN coalesce(TRY_CAST(s AS INTEGER), 0) ELSE 0 END AS parsed FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(event_id * 7919 * 1000 AS VARCHAR) END AS s FROM events)")
def parse_int(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise((F.col("event_id") * 7919 * 1000).cast("string"))
    return _t(spark, d, "events").select("event_id", F.coalesce(stubs.parse_int(s), F.lit(0)).cast("int").alias("parsed"))


@query("SELECT l_orderkey, CAST(min(l_linenumber) AS INTEGER) AS handler_start, nxt AS handler_end FROM (SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nxt FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) GROUP BY l_orderkey, nxt")
def handler_bounds(spark: SparkSession, d: str) -> DataFrame:
    """A handler ends at the next larger boundary."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber")
    t = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return t.select("l_orderkey", F.col("l_linenumber").alias("handler_start"), F.lead("l_linenumber").over(w).alias("handler_end"))


_TRY = "(SELECT o_custkey AS m, o_orderkey AS tid, o_orderkey % 200 AS a, o_orderkey % 200 + 20 AS z FROM orders)"
_BLOCKS = "(SELECT o_custkey AS m, o_orderkey AS bid, (o_orderkey * 13) % 200 AS a, (o_orderkey * 13) % 200 + 15 AS z FROM orders)"


@query(f"SELECT t.m, t.tid, b.bid FROM {_TRY} t JOIN {_BLOCKS} b ON b.m = t.m AND b.a < t.z AND b.z > t.a")
def try_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that overlap a try range, by a join on cells of powers of two."""
    o = _t(spark, d, "orders")
    t, b = o.selectExpr("o_custkey AS m", "o_orderkey AS tid", "o_orderkey % 200 AS a", "o_orderkey % 200 + 20 AS z"), o.selectExpr("o_custkey AS m", "o_orderkey AS bid", "(o_orderkey * 13) % 200 AS ba", "(o_orderkey * 13) % 200 + 15 AS bz")
    return overlaps(t, b, ["m"], ("a", "z"), ("ba", "bz")).select("m", "tid", "bid")


@query("SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY ALL")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("event_id"))


@query("SELECT doc_id, p AS pattern FROM documents, (SELECT unnest(['the', 'idiot', 'token', '@mail', 'License']) AS p) WHERE contains(text, p)")
def pattern_scan(spark: SparkSession, d: str) -> DataFrame:
    """Contains-any over whole texts; the fixed pattern list is an array, not a join side."""
    hits = F.filter(F.array(*map(F.lit, ["the", "idiot", "token", "@mail", "License"])), lambda p: F.contains(F.col("text"), p))
    return _t(spark, d, "documents").select("doc_id", F.explode(hits).alias("pattern"))


@query("SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) AS name FROM pages) GROUP BY name")
def string_pool(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)[ >]"), 1)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
