"""A second encoding of `events`: every family of mnemonics, with operands of its form; and its queries with SQL.

The SQL names each mnemonic's effect and text in a table of values, so it shares nothing with the column expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bytelens.functions import java
from bytelens.operators import cfg, dataflow, detectors, ir, statements
from bytelens.runtime import materialize
from bytelens.sources.bytecode import absolute_branches

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _families() -> list[tuple[str, str, str, str]]:
    """(mnemonic, form of operands, effect, value). effect: w and r for the first and the other registers, R for reads of
    all; value: what is assigned, in terms of {a}, {b}, {c}; empty if nothing is."""
    out = []
    for name, sign in statements.SIGNS.items():
        for kind in ("int", "long", "float", "double"):
            if kind in ("int", "long") or name in ("add", "sub", "mul", "div", "rem"):
                out.append((f"{name}-{kind}", "abc", "wr", "{b} " + sign + " {c}"))
                out.append((f"{name}-{kind}/2addr", "ab", "", "{a} " + sign + " {b}"))
        if name != "sub":
            out.append((f"{name}-int/lit8", "abl", "wr", "{b} " + sign + " {c}"))
        if name not in ("sub", "shl", "shr", "ushr"):
            out.append((f"{name}-int/lit16", "abl", "", "{b} " + sign + " {c}"))
    out += [("rsub-int/lit8", "abl", "wr", "{c} - {b}"), ("rsub-int", "abl", "", "{c} - {b}")]
    out += [(f"neg-{k}", "ab", "", "-{b}") for k in ("int", "long", "float", "double")] + [(f"not-{k}", "ab", "", "~{b}") for k in ("int", "long")]
    out += [(m, "ab", e, "{b}") for m, e in (("move", "wr"), ("move/from16", "wr"), ("move/16", "wr"), ("move-object", "wr"), ("move-wide", ""), ("move-wide/from16", ""), ("move-object/from16", ""))]
    out += [(f"{a}-to-{b}", "ab", "", f"({b}) {{b}}") for a in ("int", "long", "float", "double") for b in ("int", "long", "float", "double") if a != b] + [(f"int-to-{b}", "ab", "", f"({b}) {{b}}") for b in ("byte", "char", "short")]
    out += [(m, "al", "w", "{b}") for m in ("const/4", "const/16", "const")] + [(m, "al", "", "{b}") for m in ("const/high16", "const-wide/16", "const-wide/32", "const-wide", "const-wide/high16")]
    out += [(m, "as", "w", "{b}") for m in ("const-string", "const-string/jumbo")] + [("const-class", "at", "w", "{b}.class")]
    kinds = ("", "-wide", "-object", "-boolean", "-byte", "-char", "-short")
    out += [(f"iget{k}", "abf", "wr", "{b}.{f}") for k in kinds] + [(f"iput{k}", "abf", "R", "") for k in kinds] + [(f"sget{k}", "af", "w", "{b}") for k in kinds] + [(f"sput{k}", "af", "R", "") for k in kinds]
    out += [(f"aget{k}", "abc", "wr" if not k else "", "{b}[{c}]") for k in kinds] + [(f"aput{k}", "abc", "R" if not k else "", "") for k in kinds]
    out += [("array-length", "ab", "", "{b}.length"), ("new-array", "abn", "wr", "new int[{b}]"), ("new-instance", "at", "w", "new {b}()"), ("check-cast", "at", "", "({b}) {a}"), ("instance-of", "abt", "wr", "{b} instanceof {c}")]
    out += [("cmp-long", "abc", "", "({b} > {c}) ? 1 : (({b} < {c}) ? -1 : 0)")] + [(f"cmp{x}-{k}", "abc", "", "({b} < {c}) ? -1 : (({b} > {c}) ? 1 : 0)") for x in "lg" for k in ("float", "double")]
    out += [(f"invoke-{k}", "inv", "R", "") for k in ("virtual", "super", "direct", "static", "interface")] + [("invoke-static", "inv0", "R", "")]
    out += [(f"move-result{k}", "a", "w", "") for k in ("", "-wide", "-object")] + [("move-exception", "a", "", "")]
    out += [(f"if-{k}", "abj", "R", "") for k in java.CONDITIONS] + [(f"if-{k}z", "aj", "R", "") for k in java.CONDITIONS] + [(f"goto{k}", "j", "", "") for k in ("", "/16", "/32")]
    out += [(f"{k}-switch", "aj", "R", "") for k in ("packed", "sparse")] + [(m, "a", "R", "") for m in ("return", "return-wide", "return-object", "throw")] + [("return-void", "", "", "")]
    out += [(f"monitor-{k}", "a", "", "") for k in ("enter", "exit")] + [("filled-new-array", "inv", "", ""), ("fill-array-data", "aj", "", ""), ("nop", "", "", "")]
    return out


FAMILIES = _families()
_REFS = (*(s for d in detectors.DETECTORS.values() for s in d[1]), "getStringExtra", "getText", "getDeviceId", "nothing")
_TABLE = ", ".join(f"({i}, '{m}', '{form}')" for i, (m, form, _, _) in enumerate(FAMILIES))
_REF_TABLE = ", ".join(f"({i}, '{r if '.' in r else 'Cls.' + r}')" for i, r in enumerate(_REFS))
_WIDE = f"""
fam(fi, mnemonic, form) AS (VALUES {_TABLE}), refs(ri, ref) AS (VALUES {_REF_TABLE}),
raw AS (SELECT user_id AS method_uid, event_id, coalesce(CAST(@K AS BIGINT), 0) AS k FROM events),
num AS (SELECT method_uid, event_id, k, CAST(row_number() OVER (PARTITION BY method_uid ORDER BY event_id) - 1 AS BIGINT) AS idx FROM raw),
ins AS (SELECT method_uid, event_id, idx, 2 * idx AS off, mnemonic, form, 'v' || CAST(k % 13 AS VARCHAR(9)) AS a, 'v' || CAST(event_id % 11 AS VARCHAR(9)) AS b,
        CASE WHEN form = 'abl' THEN CAST(k - 50 AS VARCHAR(9)) WHEN form IN ('abt') THEN 'app.T' || CAST(k % 7 AS VARCHAR(9)) WHEN form = 'abn' THEN 'int[]' WHEN form = 'abf' THEN 'app.C.f' || CAST(k % 9 AS VARCHAR(9)) ELSE 'v' || CAST(k % 3 AS VARCHAR(9)) END AS c,
        CASE form WHEN 'al' THEN CAST(k - 50 AS VARCHAR(9)) WHEN 'as' THEN '"s' || CAST(k AS VARCHAR(9)) || '"' WHEN 'at' THEN 'app.T' || CAST(k % 7 AS VARCHAR(9)) WHEN 'af' THEN 'app.C.f' || CAST(k % 9 AS VARCHAR(9)) END AS v, 'app.' || ref AS ref
        FROM num JOIN fam ON fi = (event_id * 31 + k * 7) % {len(FAMILIES)} JOIN refs ON ri = (event_id * 5 + k) % {len(_REFS)}),
wide AS (SELECT method_uid, event_id, idx, off, mnemonic, form, a, coalesce(v, b) AS b, c, ref, CASE WHEN form IN ('ab') THEN a || ', ' || b WHEN form IN ('abc', 'abl', 'abt', 'abn', 'abf') THEN a || ', ' || b || ', ' || c WHEN form IN ('al', 'as', 'at', 'af') THEN a || ', ' || v
        WHEN form = 'inv' THEN a || ', ' || b || ', ' || ref || '(int, long)' WHEN form = 'inv0' THEN ref || '()' WHEN form = 'abj' THEN a || ', ' || b || ', +008h' WHEN form = 'aj' THEN a || ', +008h' WHEN form = 'j' THEN '+008h' WHEN form = 'a' THEN a ELSE '' END AS operands FROM ins)"""
DUCK = _WIDE.replace("@K", "json_extract_string(props, '$.k')")
_SPARK = _WIDE.replace("@K", "get_json_object(props, '$.k')").replace("FROM events", "FROM {events}").replace("VARCHAR(9)", "STRING")


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {_SPARK} SELECT method_uid, off, mnemonic, operands FROM wide", events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def _value_sql(text: str) -> str:
    """SQL that fills a value's {a}, {b}, {c} and {f} (the field's last name) in."""
    out = "'" + text.replace("'", "''") + "'"
    for key, col in (("{a}", "a"), ("{b}", "b"), ("{c}", "c"), ("{f}", "split_part(c, '.', 3)")):
        out = f"replace({out}, '{key}', {col})" if key in text else out
    return out


_EFFECT = "(VALUES " + ", ".join(dict.fromkeys(f"('{m}', '{form}', '{e}')" for m, form, e, _ in FAMILIES)) + ") e(em, eform, effect)"
_RW = f"""we AS (SELECT wide.*, effect FROM wide JOIN {_EFFECT} ON em = mnemonic AND eform = form),
rw AS (SELECT method_uid, off, a AS v, true AS is_write, 0 AS pos FROM we WHERE effect LIKE 'w%'
 UNION ALL SELECT method_uid, off, b, false, 0 FROM we WHERE effect = 'wr' UNION ALL SELECT method_uid, off, c, false, 1 FROM we WHERE effect = 'wr' AND form = 'abc'
 UNION ALL SELECT method_uid, off, a, false, 0 FROM we WHERE effect = 'R' AND form NOT IN ('inv0', 'j', '') UNION ALL SELECT method_uid, off, b, false, 1 FROM we WHERE effect = 'R' AND form IN ('abc', 'abf', 'inv', 'abj')
 UNION ALL SELECT method_uid, off, c, false, 2 FROM we WHERE effect = 'R' AND form = 'abc')"""


@query(f"WITH {DUCK} SELECT method_uid, off, mnemonic, operands FROM wide")
def wide_listing(spark: SparkSession, d: str) -> DataFrame:
    return instructions(spark, d)


@query(f"WITH {DUCK}, {_RW} SELECT method_uid, off, CAST(substr(v, 2) AS BIGINT) AS reg, is_write, CAST(pos AS BIGINT) AS pos FROM rw")
def rw_sets_wide(spark: SparkSession, d: str) -> DataFrame:
    """Reads and writes of every family of mnemonics."""
    return dataflow.rw_sets(instructions(spark, d))


@query(f"WITH {DUCK}, {_RW} SELECT DISTINCT method_uid, off, CAST(substr(v, 2) AS BIGINT) AS reg FROM rw w WHERE is_write AND NOT EXISTS (SELECT 1 FROM rw r WHERE NOT r.is_write AND r.method_uid = w.method_uid AND r.v = w.v)")
def dead_registers(spark: SparkSession, d: str) -> DataFrame:
    """Assignments to registers that the whole method never reads."""
    return ir.dead_registers(dataflow.rw_sets(instructions(spark, d)))


_ASSIGN = "CASE " + " ".join(f"WHEN mnemonic = '{m}' THEN {_value_sql(v)}" for m, _, _, v in FAMILIES if v) + " END"
_ASSIGN = f"CASE WHEN mnemonic IN ('add-int/lit8', 'add-int/lit16') AND c LIKE '-_%' THEN b || ' - ' || substr(c, 2) ELSE {_ASSIGN} END"


@query(f"WITH {DUCK} SELECT method_uid, off, mnemonic, {_ASSIGN} AS assigned FROM wide")
def assigned_values(spark: SparkSession, d: str) -> DataFrame:
    ins = instructions(spark, d)
    return ins.select("method_uid", "off", "mnemonic", statements.assigned(F.col("mnemonic"), F.col("operands")).alias("assigned"))


_LINE = f"""CASE WHEN {_ASSIGN} IS NOT NULL THEN a || ' = ' || ({_ASSIGN}) || ';' WHEN mnemonic LIKE 'if-%' OR mnemonic LIKE 'goto%' OR mnemonic = 'nop' THEN ''
WHEN mnemonic = 'return-void' THEN 'return;' WHEN mnemonic LIKE 'return%' THEN 'return ' || a || ';' WHEN mnemonic = 'throw' THEN 'throw ' || a || ';'
WHEN mnemonic LIKE 'iput%' THEN b || '.' || split_part(c, '.', 3) || ' = ' || a || ';' WHEN mnemonic LIKE 'sput%' THEN b || ' = ' || a || ';' WHEN mnemonic LIKE 'aput%' THEN b || '[' || c || '] = ' || a || ';'
WHEN mnemonic LIKE 'monitor-%' THEN '/* ' || mnemonic || '(' || a || ') */' WHEN mnemonic LIKE 'invoke-%' AND form = 'inv' THEN ref || '(' || a || ', ' || b || ');' ELSE operands || '; /* ' || mnemonic || ' */' END"""


@query(f"WITH {DUCK} SELECT method_uid, off, {_LINE} AS line FROM wide")
def statement_lines(spark: SparkSession, d: str) -> DataFrame:
    ins = instructions(spark, d)
    return ins.select("method_uid", "off", statements.statement(F.col("mnemonic"), F.col("operands")).alias("line"))


_IR = f"""val AS (SELECT *, {_ASSIGN} AS val, {_LINE} AS line FROM wide),
ir AS (SELECT method_uid, off, CASE WHEN form = 'inv' AND mnemonic LIKE 'invoke-%' THEN 'call' WHEN mnemonic LIKE 'move-result%' THEN 'take' WHEN mnemonic LIKE 'return%' THEN 'return' WHEN val IS NOT NULL THEN 'assign' ELSE 'raw' END AS kind, a, ref || '(' || a || ', ' || b || ')' AS call, val, line, mnemonic FROM val),
near AS (SELECT *, lead(kind) OVER w AS k1, lead(a) OVER w AS a1, lead(kind, 2) OVER w AS k2, lead(a, 2) OVER w AS a2, lead(mnemonic, 2) OVER w AS m2, lag(kind) OVER w AS p1, lag(a) OVER w AS pa1, lag(kind, 2) OVER w AS p2 FROM ir WINDOW w AS (PARTITION BY method_uid ORDER BY off)),
chained AS (SELECT method_uid, off, CASE WHEN kind = 'call' AND k1 = 'take' AND k2 = 'return' AND m2 != 'return-void' AND a2 = a1 THEN 'return ' || call || ';' WHEN kind = 'call' AND k1 = 'take' THEN a1 || ' = ' || call || ';' WHEN kind = 'call' THEN call || ';'
        WHEN kind = 'take' THEN a || ' = <result>;' WHEN kind = 'assign' AND regexp_matches(val, '^' || a || ' [^ ]+ ') AND regexp_matches(val, '^v[0-9]+ ([-+*/%&|^]|<<|>>>?) ') THEN
          CASE WHEN regexp_matches(val, '^v[0-9]+ [-+] 1$') THEN a || repeat(split_part(val, ' ', 2), 2) ELSE a || ' ' || split_part(val, ' ', 2) || '= ' || trim(regexp_replace(val, '^[^ ]+ [^ ]+ ', '')) END || ';' ELSE line END AS line
        FROM near WHERE NOT (kind = 'take' AND coalesce(p1, '') = 'call') AND NOT (kind = 'return' AND mnemonic != 'return-void' AND coalesce(p1, '') = 'take' AND coalesce(p2, '') = 'call' AND pa1 = a))"""


@query(f"WITH {DUCK}, {_IR} SELECT * FROM chained")
def chained_lines(spark: SparkSession, d: str) -> DataFrame:
    """Statements after calls are joined with the taking of their results, and compound assignments."""
    return statements.lines(statements.chain_calls(statements.intermediate(instructions(spark, d))))


@query(
    f"""WITH {DUCK}, v AS (SELECT mnemonic, form, b, c, {_ASSIGN} AS val, method_uid, off FROM wide) SELECT method_uid, off, val AS text,
CASE WHEN mnemonic = 'new-array' THEN 'int[]' WHEN mnemonic = 'new-instance' THEN b WHEN form = 'as' THEN 'java.lang.String' WHEN form = 'al' OR mnemonic IN ('rsub-int', 'rsub-int/lit8') THEN 'int' END AS raw_type FROM v WHERE val IS NOT NULL"""
)
def raw_types(spark: SparkSession, d: str) -> DataFrame:
    t = instructions(spark, d).select("method_uid", "off", statements.assigned(F.col("mnemonic"), F.col("operands")).alias("text")).where("text is not null")
    return t.withColumn("raw_type", statements.raw_type(F.col("text")))


@query(f"WITH {DUCK}, v AS (SELECT method_uid, off, {_ASSIGN} AS val FROM wide) SELECT method_uid, off, array_to_string(list_sort(list_distinct(regexp_extract_all(val, 'v[0-9]+'))), ',') AS used FROM v WHERE val IS NOT NULL AND NOT contains(val, '\"')")
def used_registers(spark: SparkSession, d: str) -> DataFrame:
    t = instructions(spark, d).select("method_uid", "off", statements.assigned(F.col("mnemonic"), F.col("operands")).alias("val")).where("val is not null and not contains(val, '\"')")
    return t.select("method_uid", "off", F.array_join(F.array_sort(statements.used_variables(F.col("val"))), ",").alias("used"))


@query(
    f"""WITH {DUCK}, v AS (SELECT method_uid, off, a, mnemonic, {_ASSIGN} AS val FROM wide), asg AS (SELECT *, CASE WHEN regexp_matches(val, '^v[0-9]+$') THEN 'var' ELSE 'raw' END AS form FROM v WHERE val IS NOT NULL),
said AS (SELECT method_uid, unnest(regexp_extract_all(CASE WHEN mnemonic LIKE 'invoke-%' AND form = 'inv' THEN ref || ' ' || a || ', ' || b WHEN mnemonic LIKE 'return%' THEN CASE WHEN mnemonic = 'return-void' THEN '' ELSE a END WHEN mnemonic LIKE 'move-result%' THEN '' ELSE coalesce({_ASSIGN}, {_LINE}) END, 'v[0-9]+')) AS reg FROM wide)
SELECT method_uid, off, a AS dst FROM asg WHERE NOT EXISTS (SELECT 1 FROM said WHERE said.method_uid = asg.method_uid AND said.reg = asg.a)"""
)
def dead_statements(spark: SparkSession, d: str) -> DataFrame:
    """Assignments that the dead-assignment pass drops."""
    ir = materialize(statements.intermediate(instructions(spark, d)), "ir")
    return ir.where("kind = 'assign' and form in ('raw', 'var')").select("method_uid", "off", "dst").join(statements.drop_dead(ir).select("method_uid", "off"), ["method_uid", "off"], "left_anti")


@query(f"WITH {DUCK} SELECT method_uid, off, CASE WHEN form = 'inv' AND mnemonic LIKE 'invoke-%' THEN a || '.' || split_part(ref, '.', -1) || '(' || b || ')' ELSE split_part(ref, '(', 1) || '()' END AS called FROM wide WHERE mnemonic LIKE 'invoke-%'")
def receiver_calls(spark: SparkSession, d: str) -> DataFrame:
    ins = instructions(spark, d).where(F.col("mnemonic").startswith("invoke-"))
    o = F.col("operands")
    has = o.contains(",")
    ref = F.when(has, dataflow.callee(o)).otherwise(F.regexp_extract(o, r"^([^(]*)", 1))
    return ins.select("method_uid", "off", java.receiver_call(ref, F.when(has, statements.call_arguments(o)).otherwise("")).alias("called"))


_ALL = ", ".join(f"('{c}', '{p}')" for c, d in detectors.DETECTORS.items() if not d[0] for p in d[1])


@query(f"WITH {DUCK} SELECT DISTINCT category, method_uid, off AS sink_off, ref AS sink_desc FROM wide JOIN (VALUES {_ALL}) p(category, pattern) ON contains(ref, pattern) WHERE form = 'inv' AND mnemonic LIKE 'invoke-%'")
def invoke_scans(spark: SparkSession, d: str) -> DataFrame:
    """Detectors that need no source: dynamic loading and JavaScript interfaces."""
    hits = detectors.matching(dataflow.invoke_map(instructions(spark, d)), detectors.pattern_table(spark), "invoke")
    return hits.select("category", "method_uid", F.col("off").alias("sink_off"), F.col("method_ref").alias("sink_desc"))


@query(f"WITH {DUCK} SELECT method_uid, off, CASE WHEN mnemonic LIKE '%-switch' THEN a WHEN mnemonic LIKE '%z' THEN a || ' ' || sign || ' 0' ELSE a || ' ' || sign || ' ' || b END AS cond FROM wide LEFT JOIN (VALUES ('eq', '=='), ('ne', '!='), ('lt', '<'), ('ge', '>='), ('gt', '>'), ('le', '<=')) s(name, sign) ON name = substr(mnemonic, 4, 2) WHERE mnemonic LIKE 'if-%' OR mnemonic LIKE '%-switch'")
def branch_conditions(spark: SparkSession, d: str) -> DataFrame:
    ins = instructions(spark, d).where("mnemonic like 'if-%' or mnemonic like '%-switch'")
    return ins.select("method_uid", "off", java.condition(F.col("mnemonic"), F.col("operands")).alias("cond"))


_PUTS = f"CASE WHEN {_ASSIGN} IS NOT NULL OR mnemonic LIKE 'move-result%' THEN a END"


BLOCKS = """heads AS (SELECT wide.*, mnemonic LIKE 'goto%' OR mnemonic LIKE 'if-%' OR mnemonic LIKE 'return%' OR mnemonic = 'throw' OR mnemonic LIKE '%-switch' AS is_end FROM wide),
leads AS (SELECT *, coalesce(lag(is_end) OVER (PARTITION BY method_uid ORDER BY off), true) OR (method_uid, off) IN (SELECT (method_uid, off + 16) FROM wide WHERE mnemonic LIKE 'goto%' OR mnemonic LIKE 'if-%') AS head FROM heads),
blk AS (SELECT *, CAST(sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY method_uid ORDER BY off) - 1 AS BIGINT) AS block_id FROM leads)"""


@query(
    f"""WITH {DUCK}, {BLOCKS}, e AS (SELECT method_uid, block_id, off, mnemonic, a, b, {_PUTS} AS reg, CASE WHEN mnemonic IN ('const', 'const/4', 'const/16', 'const/high16') THEN b END AS lit FROM blk),
p AS (SELECT *, lag(reg) OVER n AS r1, lag(lit) OVER n AS l1, lag(reg, 2) OVER n AS r2, lag(lit, 2) OVER n AS l2, lag(reg, 3) OVER n AS r3, lag(lit, 3) OVER n AS l3 FROM e WINDOW n AS (PARTITION BY method_uid, block_id ORDER BY off)),
v AS (SELECT *, unnest([a, CASE WHEN mnemonic LIKE '%z' THEN '0' ELSE b END]) AS x, unnest([1, 2]) AS k FROM p WHERE mnemonic LIKE 'if-%'),
f AS (SELECT method_uid, off, mnemonic, k, CASE WHEN x = r1 THEN coalesce(l1, x) WHEN x = r2 THEN coalesce(l2, x) WHEN x = r3 THEN coalesce(l3, x) ELSE x END AS y FROM v)
SELECT method_uid, off, max(CASE WHEN k = 1 THEN y END) || ' ' || CASE substr(max(mnemonic), 4, 2) WHEN 'eq' THEN '==' WHEN 'ne' THEN '!=' WHEN 'lt' THEN '<' WHEN 'ge' THEN '>=' WHEN 'gt' THEN '>' ELSE '<=' END || ' ' || max(CASE WHEN k = 2 THEN y END) AS cond FROM f GROUP BY method_uid, off"""
)
def folded_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Constants put into conditions, block by block: jumps land between some constants and their branches."""
    return statements.folded_conditions(cfg.placed(absolute_branches(instructions(spark, d))))
