"""Queries of the passes, block by block, over the wide encoding: the default pipeline, types, names, and names put into text; each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bytelens.functions import java
from bytelens.operators import cfg, passes, statements
from bytelens.plans import wide
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


# What calls return, by reference; what methods are, by their number. The same values in SQL.
_RETURNS = ("java.lang.String", "int", "android.content.Intent", "boolean[]", "java.util.List", "app.Thing")
_SIGNATURES = [(f"app.{r if '.' in r else 'Cls.' + r}", 2, _RETURNS[i % len(_RETURNS)]) for i, r in enumerate(wide._REFS)]


def signatures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SIGNATURES, "target string, n_args int, return_type string")


def methods(spark: SparkSession, d: str) -> DataFrame:
    """A method for each user of events: thirteen registers, the last three of parameters."""
    t = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("method_uid")).distinct()
    static = F.col("method_uid") % 2 == 0
    params = F.when(static, F.array(F.lit("long"), F.lit("java.lang.String"))).otherwise(F.array(F.lit("int"), F.lit("boolean")))
    returns = F.element_at(F.array(F.lit("void"), F.lit("int"), F.lit("java.util.ArrayList")), (F.col("method_uid") % 3 + 1).cast("int"))
    return t.select("method_uid", F.lit("app.Main").alias("class_name"), params.alias("params"), returns.alias("return_type"), static.alias("is_static"), F.lit(13).alias("registers_size"), F.lit(3).alias("ins_size"))


def program(spark: SparkSession, d: str) -> DataFrame:
    return absolute_branches(wide.instructions(spark, d))


def passed(spark: SparkSession, d: str) -> DataFrame:
    return passes.default_runner().run(statements.intermediate(cfg.placed(program(spark, d))))


_TOKENS = "regexp_extract_all({x}, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+')"
_APPLY = "array_to_string(list_transform(" + _TOKENS + ", lambda t: coalesce({m}[t], t)), '')"
_IR = f"""{wide.BLOCKS}, val AS (SELECT *, {wide._ASSIGN} AS val, {wide._LINE} AS line FROM blk),
raw_ir AS (SELECT method_uid, block_id, off, CASE WHEN form = 'inv' AND mnemonic LIKE 'invoke-%' THEN 'call' WHEN mnemonic LIKE 'move-result%' THEN 'take' WHEN mnemonic = 'return-void' THEN 'leave' WHEN mnemonic LIKE 'return%' THEN 'return' WHEN val IS NOT NULL THEN 'assign' ELSE 'raw' END AS k, a, b, ref, val, line FROM val),
near AS (SELECT *, lead(k) OVER w AS k1, lead(a) OVER w AS a1, lead(k, 2) OVER w AS k2, lead(a, 2) OVER w AS a2, lag(k) OVER w AS p1, lag(a) OVER w AS pa, lag(k, 2) OVER w AS p2 FROM raw_ir WINDOW w AS (PARTITION BY method_uid, block_id ORDER BY off)),
chained AS (SELECT method_uid, block_id, off, CASE WHEN k = 'call' AND k1 = 'take' AND k2 = 'return' AND a2 = a1 THEN 'return' WHEN k = 'call' AND k1 = 'take' THEN 'assign' WHEN k = 'call' THEN 'expr' WHEN k = 'take' THEN 'assign' WHEN k = 'leave' THEN 'return' ELSE k END AS kind,
  CASE WHEN k = 'call' AND k1 = 'take' AND k2 = 'return' AND a2 = a1 THEN NULL WHEN k = 'call' AND k1 = 'take' THEN a1 WHEN k IN ('assign', 'take') THEN a END AS dst,
  CASE WHEN k = 'call' THEN 'call' WHEN k = 'take' THEN 'pending' WHEN k = 'leave' THEN 'none' WHEN k = 'return' OR (k = 'assign' AND regexp_matches(val, '^v[0-9]+$')) THEN 'var' ELSE 'raw' END AS form,
  CASE WHEN k = 'call' THEN ref END AS target, CASE WHEN k = 'call' THEN a || ', ' || b WHEN k IN ('take', 'leave') THEN '' WHEN k = 'return' THEN a WHEN k = 'assign' THEN val ELSE line END AS text
  FROM near WHERE NOT (k = 'take' AND coalesce(p1, '') = 'call') AND NOT (k = 'return' AND coalesce(p1, '') = 'take' AND coalesce(p2, '') = 'call' AND pa = a)),
said AS (SELECT DISTINCT method_uid, block_id, off, v FROM (SELECT method_uid, block_id, off, unnest({_TOKENS.format(x="coalesce(target, '') || ' ' || text")}) AS v FROM chained) WHERE regexp_matches(v, '^v[0-9]+$')),
defs AS (SELECT method_uid, block_id, off, dst AS v, row_number() OVER (PARTITION BY method_uid, block_id, dst ORDER BY off) AS n FROM chained WHERE dst IS NOT NULL),
vers AS (SELECT s.method_uid, s.block_id, s.off, s.v, s.v || CASE WHEN count(d.off) = 0 THEN '' ELSE '_' || count(d.off) END AS name FROM said s LEFT JOIN defs d ON d.method_uid = s.method_uid AND d.block_id = s.block_id AND d.v = s.v AND d.off < s.off GROUP BY s.method_uid, s.block_id, s.off, s.v),
maps AS (SELECT method_uid, block_id, off, map(list(v), list(name)) AS m FROM vers GROUP BY method_uid, block_id, off),
ssa AS (SELECT c.method_uid, c.block_id, c.off, kind, CASE WHEN d.n IS NOT NULL THEN c.dst || '_' || d.n END AS dst, form, CASE WHEN m IS NULL OR target IS NULL THEN target ELSE {_APPLY.format(x="target", m="m")} END AS target, CASE WHEN m IS NULL THEN text ELSE {_APPLY.format(x="text", m="m")} END AS text
  FROM chained c LEFT JOIN defs d USING (method_uid, block_id, off) LEFT JOIN maps USING (method_uid, block_id, off)),
words AS (SELECT method_uid, block_id, off, unnest({_TOKENS.format(x="coalesce(target, '') || ' ' || text")}) AS v, generate_subscripts({_TOKENS.format(x="coalesce(target, '') || ' ' || text")}, 1) AS pos FROM ssa),
used AS (SELECT DISTINCT method_uid, block_id, v FROM words WHERE regexp_matches(v, '^v[0-9]+(_[0-9]+)?$')),
fin AS (SELECT * FROM ssa WHERE NOT (kind = 'assign' AND form IN ('raw', 'var') AND NOT EXISTS (SELECT 1 FROM used u WHERE u.method_uid = ssa.method_uid AND u.block_id = ssa.block_id AND u.v = ssa.dst)))"""
_TEXT = """CASE WHEN kind = 'assign' THEN dst || ' = ' || CASE form WHEN 'call' THEN target || '(' || text || ')' WHEN 'pending' THEN '<result>' ELSE text END || ';' WHEN kind = 'return' AND form = 'none' THEN 'return;'
WHEN kind = 'return' THEN 'return ' || CASE form WHEN 'call' THEN target || '(' || text || ')' ELSE text END || ';' WHEN kind = 'expr' THEN target || '(' || text || ');' ELSE text END"""


@query(f"WITH {wide.DUCK}, {_IR} SELECT method_uid, block_id, off, {_TEXT} AS line FROM fin")
def default_passes(spark: SparkSession, d: str) -> DataFrame:
    """The default pipeline's statements: one exchange, after which calls are chained, versions made, constructors merged, and unread assignments dropped."""
    return statements.lines(passed(spark, d))


_METHODS = """meth AS (SELECT DISTINCT user_id AS method_uid, user_id % 2 = 0 AS is_static, ['void', 'int', 'java.util.ArrayList'][user_id % 3 + 1] AS return_type FROM events)"""
_SIG = ", ".join(f"('{t}', '{r}')" for t, _, r in _SIGNATURES)
_TYPES = f"""{_METHODS}, sig(target, type) AS (VALUES {_SIG}), scopes AS (SELECT DISTINCT method_uid, block_id FROM fin),
asg AS (SELECT method_uid, block_id, off, dst AS v, form, target, CASE WHEN form = 'raw' THEN CASE WHEN regexp_matches(text, '^new [^\\[]*\\S[^\\[]*\\[') THEN regexp_extract(text, '^new ([^\\[]*)\\[', 1) || '[]' WHEN regexp_matches(text, '^new ') THEN regexp_extract(text, '^new ([^(]*)\\(', 1)
   WHEN regexp_matches(text, '^\\([A-Z][^)]*\\) ') THEN regexp_extract(text, '^\\(([A-Z][^)]*)\\) ', 1) WHEN text LIKE '"%"' THEN 'java.lang.String' WHEN regexp_matches(text, '^-?[0-9]+($|[ ;])') THEN 'int' END END AS own,
   CASE WHEN form != 'call' THEN list_filter({_TOKENS.format(x="text")}, lambda t: regexp_matches(t, '^v[0-9]+(_[0-9]+)?$'))[1] END AS source FROM fin WHERE kind = 'assign' AND form IN ('raw', 'var', 'call')),
ret AS (SELECT method_uid, block_id, min_by(text, off) AS v FROM fin WHERE kind = 'return' AND form = 'var' GROUP BY ALL),
seed AS (SELECT method_uid, block_id, v, type FROM scopes JOIN meth USING (method_uid), (VALUES (true, 'v10', 'long'), (true, 'v12', 'java.lang.String'), (false, 'v10', 'app.Main'), (false, 'v11', 'int'), (false, 'v12', 'boolean')) p(st, v, type) WHERE p.st = is_static
  UNION ALL SELECT method_uid, block_id, v, return_type FROM ret JOIN meth USING (method_uid) WHERE return_type != 'void' AND NOT (v = 'v10' OR v = 'v12' OR (v = 'v11' AND NOT is_static))),
base AS (SELECT * FROM seed UNION ALL SELECT method_uid, block_id, v, type FROM (SELECT a.method_uid, a.block_id, a.v, coalesce(a.own, s.type) AS type FROM asg a LEFT JOIN sig s ON a.form = 'call' AND s.target = a.target) x WHERE type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM seed WHERE seed.method_uid = x.method_uid AND seed.block_id = x.block_id AND seed.v = x.v)),
known AS (SELECT * FROM base UNION ALL SELECT a.method_uid, a.block_id, a.v, k.type FROM known k JOIN asg a ON a.method_uid = k.method_uid AND a.block_id = k.block_id AND a.source = k.v AND a.own IS NULL AND a.form != 'call'
  WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.method_uid = a.method_uid AND base.block_id = a.block_id AND base.v = a.v))"""


def _typed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ir = materialize(passed(spark, d), "passed")
    m = methods(spark, d)
    given = passes.parameter_seeds(m).join(ir.select(*passes.BLOCK).distinct(), "method_uid").select(*passes.BLOCK, "v", "type")
    returned = passes.return_seeds(ir, m).join(given, [*passes.BLOCK, "v"], "left_anti")
    return ir, m, passes.typed(ir, given.union(returned), signatures(spark))


@query(f"WITH RECURSIVE {wide.DUCK}, {_IR}, {_TYPES} SELECT method_uid, block_id, v, type FROM known")
def inferred_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of variables from the signatures of the method and of what it calls, passed on through copies."""
    return _typed(spark, d)[2]


_NAMES = f"""{_TYPES}, facts AS (SELECT method_uid, block_id, off, 0 AS spot, 'array' AS role, regexp_extract(text, '^[^\\[]*?([A-Za-z0-9_]+)\\s*\\[', 1) AS v FROM fin WHERE kind = 'raw' OR (kind = 'assign' AND form = 'raw')
  UNION ALL SELECT method_uid, block_id, off, 1, 'index', regexp_extract(text, '^[^\\[]*\\[\\s*(v[0-9]+(_[0-9]+)?)\\s*\\]', 1) FROM fin WHERE kind = 'raw' OR (kind = 'assign' AND form = 'raw')
  UNION ALL SELECT method_uid, block_id, off, 2, 'array', regexp_extract(text, '([A-Za-z0-9_]+)\\.length', 1) FROM fin WHERE kind = 'raw' OR (kind = 'assign' AND form = 'raw')
  UNION ALL SELECT method_uid, block_id, off, 3, 'length', dst FROM fin WHERE kind = 'assign' AND form = 'raw' AND contains(text, '.length')),
role AS (SELECT method_uid, block_id, v, arg_max(role, off * 4 + spot) AS role FROM facts WHERE regexp_matches(v, '^v[0-9]+(_[0-9]+)?$') GROUP BY ALL),
seen AS (SELECT method_uid, block_id, v, min(spot) AS spot FROM (SELECT w.method_uid, w.block_id, w.v, w.off * 1000 + w.pos AS spot FROM words w JOIN fin USING (method_uid, block_id, off) WHERE regexp_matches(w.v, '^v[0-9]+(_[0-9]+)?$')
  UNION ALL SELECT method_uid, block_id, dst, off * 1000 + 999 FROM fin WHERE dst IS NOT NULL) GROUP BY ALL),
grp AS (SELECT s.*, CASE WHEN r.v = s.v THEN 'result' WHEN s.v = 'v10' AND NOT is_static THEN 'this' WHEN s.v IN ('v10', 'v11', 'v12') THEN 'p' || (CAST(substr(s.v, 2) AS INTEGER) - CASE WHEN is_static THEN 10 ELSE 11 END) WHEN role = 'length' THEN 'length' END AS fixed,
  CASE WHEN role = 'index' THEN '#' WHEN role = 'array' THEN 'arr' WHEN type IS NULL THEN 'local' WHEN type IN ('int', 'short', 'byte') THEN 'n' WHEN type = 'boolean' THEN 'z' WHEN type = 'long' THEN 'j' WHEN type IN ('float', 'double', 'char') THEN substr(type, 1, 1) WHEN type = 'java.lang.String' THEN 'str'
    WHEN type = 'android.content.Intent' THEN 'intent' WHEN suffix(type, '[]') THEN 'arr' WHEN suffix(type, 'List') THEN 'list' ELSE 'v' END AS grp
  FROM seen s JOIN meth USING (method_uid) LEFT JOIN ret r ON r.method_uid = s.method_uid AND r.block_id = s.block_id LEFT JOIN known k ON k.method_uid = s.method_uid AND k.block_id = s.block_id AND k.v = s.v LEFT JOIN role o ON o.method_uid = s.method_uid AND o.block_id = s.block_id AND o.v = s.v),
named AS (SELECT method_uid, block_id, v, CASE WHEN fixed IS NOT NULL THEN fixed WHEN grp = '#' THEN ['i', 'j', 'k'][least(nth, 3)] ELSE grp || (nth - 1) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY method_uid, block_id, fixed IS NULL, grp ORDER BY spot) AS nth FROM grp))"""


def _named(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ir, m, types = _typed(spark, d)
    return ir, m, passes.names(ir, types, m)


@query(f"WITH RECURSIVE {wide.DUCK}, {_IR}, {_NAMES} SELECT method_uid, block_id, v, name FROM named")
def scoped_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of variables in their block: results, parameters, indices, lengths, arrays, and prefixes by type."""
    return _named(spark, d)[2]


_SUBST = f"nmaps AS (SELECT method_uid, block_id, map(list(v), list(name)) AS nm FROM named GROUP BY ALL), put AS (SELECT method_uid, block_id, off, kind, form, " + ", ".join(f"CASE WHEN {c} IS NULL OR nm IS NULL THEN {c} ELSE {_APPLY.format(x=c, m='nm')} END AS {c}" for c in ("dst", "target", "text")) + " FROM fin LEFT JOIN nmaps USING (method_uid, block_id))"


@query(f"WITH RECURSIVE {wide.DUCK}, {_IR}, {_NAMES}, {_SUBST} SELECT method_uid, block_id, off, {_TEXT} AS line FROM put")
def named_lines(spark: SparkSession, d: str) -> DataFrame:
    """Statements with names in place of variables."""
    ir, _, named = _named(spark, d)
    return statements.lines(passes.renamed(ir, named), shorten=False)


_COND = """conds AS (SELECT method_uid, block_id, off, CASE WHEN mnemonic LIKE '%z' THEN a || ' ' || sign || ' 0' ELSE a || ' ' || sign || ' ' || b END AS cond FROM blk JOIN (VALUES ('eq', '=='), ('ne', '!='), ('lt', '<'), ('ge', '>='), ('gt', '>'), ('le', '<=')) s(nm, sign) ON nm = substr(mnemonic, 4, 2) WHERE mnemonic LIKE 'if-%')"""


@query(
    f"""WITH RECURSIVE {wide.DUCK}, {_IR}, {_NAMES}, {_COND}, lastv AS (SELECT method_uid, block_id, regexp_extract(v, '^(v[0-9]+)', 1) AS reg, arg_max(name, coalesce(TRY_CAST(nullif(regexp_extract(v, '_([0-9]+)$', 1), '') AS INTEGER), 0)) AS name FROM named GROUP BY ALL),
parms AS (SELECT method_uid, unnest(['v10', 'v11', 'v12']) AS reg, unnest(CASE WHEN is_static THEN ['p0', 'p1', 'p2'] ELSE ['this', 'p0', 'p1'] END) AS name FROM meth),
parts AS (SELECT method_uid, block_id, off, cond, unnest({_TOKENS.format(x="cond")}) AS t, generate_subscripts({_TOKENS.format(x="cond")}, 1) AS pos FROM conds)
SELECT p.method_uid, p.block_id, p.off, string_agg(coalesce(l.name, q.name, p.t), '' ORDER BY p.pos) AS cond FROM parts p LEFT JOIN lastv l ON l.method_uid = p.method_uid AND l.block_id = p.block_id AND l.reg = p.t LEFT JOIN parms q ON q.method_uid = p.method_uid AND q.reg = p.t GROUP BY ALL"""
)
def renamed_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Conditions of branches with the names that their registers have at the block's end."""
    _, m, named = _named(spark, d)
    at = cfg.placed(program(spark, d)).where("mnemonic like 'if-%'")
    cond = at.select(*passes.BLOCK, "off", java.condition(F.col("mnemonic"), F.regexp_replace("operands", r"\d+$", "+0h")).alias("cond"))
    return passes.renamed_conditions(cond, materialize(named, "named"), m)
