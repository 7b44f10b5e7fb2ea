"""Passes over statements: a pass is a DataFrame transform, a runner puts them in order, and all of them work on one exchange.

Statements (see statements.intermediate) have the keys method_uid and, for passes that work block by block, block_id. `cfg.placed` deals
instructions to tasks by method once; everything after it groups and windows by keys that hold the method, which that exchange already
satisfies, so a chain of passes costs sorts inside tasks and no further exchange.

Names go into text by one look-up for each word: a map of a statement's (or a scope's) variables, never a chain of replacements, so
v1 and v10 stay apart whatever is renamed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bytelens.operators import statements as st
from bytelens.runtime import Rounds, materialize

BLOCK = ("method_uid", "block_id")
_WORD = r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"
_ROW = ("kind", "dst", "form", "target", "text")


@dataclass
class Pass:
    name: str
    run: Callable[[DataFrame], DataFrame]


@dataclass
class Runner:
    """Runs passes one after the other on statements; add takes a Pass, or a name and a transform of one's own that keeps the columns."""

    passes: list[Pass] = field(default_factory=list)

    def add(self, one: Pass | str, run: Callable[[DataFrame], DataFrame] | None = None) -> Runner:
        self.passes.append(one if isinstance(one, Pass) else Pass(one, run))
        return self

    def run(self, ir: DataFrame) -> DataFrame:
        for p in self.passes:
            after = p.run(ir)
            if after.columns != ir.columns:
                raise ValueError(f"pass {p.name} changes the columns to {after.columns}")
            ir = after
        return ir


def words_replaced(text: Column, names: Column) -> Column:
    """The text with each word that names has as a key replaced by its value."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_WORD), 0), lambda t: F.coalesce(F.try_element_at(names, t), t)), "")


def mentions(ir: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """scope, off, row, v, is_def: each variable that a statement reads (once) or assigns; a statement without any has a row without v."""
    uses = st.used_variables(F.concat_ws(" ", F.coalesce("target", F.lit("")), "text"))
    both = F.concat(F.transform(uses, lambda v: F.struct(v.alias("v"), F.lit(False).alias("is_def"))), F.when(F.col("dst").isNotNull(), F.array(F.struct(F.col("dst").alias("v"), F.lit(True).alias("is_def")))).otherwise(F.array().cast("array<struct<v:string,is_def:boolean>>")))
    return ir.select(*scope, "off", F.struct(*_ROW).alias("row"), F.explode_outer(both).alias("m")).select(*scope, "off", "row", "m.v", "m.is_def")


def versions(scope: tuple[str, ...] = BLOCK) -> Pass:
    """Each assignment makes a new version of its register, from 1 in each scope; what is read is the last version, the bare name before any."""

    def run(ir: DataFrame) -> DataFrame:
        t = mentions(ir, scope)
        bare = F.col("v").rlike(r"^v\d+$")
        before = F.coalesce(F.sum(F.col("is_def").cast("long")).over(W.partitionBy(*scope, "v").orderBy("off").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
        ver = before + F.col("is_def").cast("long")
        t = t.withColumn("name", F.when(bare & (ver > 0), F.concat("v", F.lit("_"), ver.cast("string"))).otherwise(F.col("v")))
        used = F.collect_list(F.when(~F.col("is_def"), F.struct("v", "name")))
        t = t.groupBy(*scope, "off").agg(F.first("row").alias("row"), F.map_from_entries(used).alias("names"), F.max(F.when(F.col("is_def"), F.col("name"))).alias("dst"))
        return t.select(*scope, "off", "row.kind", "dst", "row.form", words_replaced(F.col("row.target"), F.col("names")).alias("target"), words_replaced(F.col("row.text"), F.col("names")).alias("text"))

    return Pass("versions", run)


def drop_unread(scope: tuple[str, ...] = BLOCK) -> Pass:
    """Without assignments to variables that no statement of the scope reads; calls stay."""

    def run(ir: DataFrame) -> DataFrame:
        t = mentions(ir, scope)
        read = F.max(~F.col("is_def")).over(W.partitionBy(*scope, "v"))
        t = t.withColumn("dead", F.coalesce(F.col("is_def") & ~read, F.lit(False)))
        t = t.groupBy(*scope, "off").agg(F.first("row").alias("row"), F.max("dead").alias("dead"))
        gone = F.col("dead") & (F.col("row.kind") == "assign") & ~F.col("row.form").isin("call", "pending")
        return t.where(~gone).select(*scope, "off", *(f"row.{c}" for c in _ROW))

    return Pass("drop_unread", run)


def chain(scope: tuple[str, ...] = BLOCK) -> Pass:
    return Pass("chain_calls", lambda ir: st.chain_calls(ir, scope))


def constructors(scope: tuple[str, ...] = BLOCK) -> Pass:
    return Pass("merge_constructors", lambda ir: st.merge_constructors(ir, scope))


def _simplified(ir: DataFrame) -> DataFrame:
    short = F.when((F.col("kind") == "assign") & (F.col("form") == "raw"), st.compound(F.col("dst"), F.col("text")))
    t = ir.withColumn("short", short)
    return t.withColumns({"form": F.when(F.col("short").isNotNull(), "compound").otherwise(F.col("form")), "text": F.coalesce("short", "text")}).drop("short")


#: v = v + 1 becomes v++, v = v op x becomes v op= x: the form is compound, and the text the whole statement.
SIMPLIFY = Pass("simplify", _simplified)


def default_runner(scope: tuple[str, ...] = BLOCK) -> Runner:
    """Calls with their results, versions, constructors, compound assignment, unread assignments: in this order."""
    return Runner([chain(scope), versions(scope), constructors(scope), SIMPLIFY, drop_unread(scope)])


def identity() -> Pass:
    return Pass("identity", lambda ir: ir)


# -- types


def parameter_seeds(methods: DataFrame) -> DataFrame:
    """method_uid, v, type: the types of the parameter registers, the last ins_size ones of a method, the receiver's class first unless it is static.
    methods: method_uid, class_name, params (array of types), is_static, registers_size, ins_size. A long or a double takes two registers."""
    wide = lambda p: p.isin("long", "double")
    own = F.when(F.col("is_static"), F.array().cast("array<string>")).otherwise(F.array("class_name"))
    kinds = F.concat(own, F.coalesce("params", F.array().cast("array<string>")))
    slots = F.flatten(F.transform(kinds, lambda p: F.when(wide(p), F.array(p, F.lit(None).cast("string"))).otherwise(F.array(p))))
    t = methods.select("method_uid", (F.col("registers_size") - F.col("ins_size")).alias("base"), F.posexplode(slots).alias("i", "type")).where("type IS NOT NULL")
    return t.select("method_uid", F.concat(F.lit("v"), (F.col("base") + F.col("i")).cast("string")).alias("v"), "type")


def return_seeds(ir: DataFrame, methods: DataFrame, scope: tuple[str, ...] = BLOCK) -> DataFrame:
    """scope, v, type: the first variable that the scope returns has the method's return type."""
    r = ir.where("kind = 'return' AND form = 'var'").groupBy(*scope).agg(F.min_by("text", "off").alias("v"))
    return r.join(methods.select("method_uid", F.col("return_type").alias("type")).where("type != 'void'"), "method_uid").select(*scope, "v", "type")


def argument_count(args: Column) -> Column:
    return F.size(F.filter(F.split(args, ","), lambda x: F.trim(x) != ""))


def typed(ir: DataFrame, seeds: DataFrame, signatures: DataFrame, scope: tuple[str, ...] = BLOCK) -> DataFrame:
    """scope, v, type of variables: seeds (scope, or method_uid only, v, type) first, then what assignments say, each variable by its first that tells.

    A copy has its source's type; a call the return type of the method of that name and number of arguments (signatures: target `Class.m`,
    n_args, return_type), with a receiver's type in place of its name; other text its own type (statements.raw_type) or that of the first variable it mentions.
    What is known is passed on round by round; a variable gets its type once, so there are no more rounds than a chain has variables."""
    keys = [*scope, "v"]
    if scope != ("method_uid",) and "block_id" not in seeds.columns:
        seeds = seeds.join(ir.select(*scope).distinct(), "method_uid").select(*keys, "type")
    sig = materialize(signatures.groupBy("target", "n_args").agg(F.min("return_type").alias("type")), "signatures")
    a = ir.where("kind = 'assign' AND form IN ('raw', 'var', 'call')").select(*scope, "off", F.col("dst").alias("v"), "form", "target", "text")
    receiver = F.when(F.col("form") == "call", F.nullif(F.regexp_extract("target", r"^(v\d+(?:_\d+)?)\.[^.]*$", 1), F.lit("")))
    uses = F.when(F.col("form") != "call", F.try_element_at(st.used_variables(F.col("text")), F.lit(1)))
    a = a.select(*keys, "off", F.when(F.col("form") == "raw", st.raw_type(F.col("text"))).alias("own"), F.coalesce(uses, receiver).alias("source"), "form", "target", F.substring_index("target", ".", -1).alias("member"), argument_count(F.col("text")).alias("n_args"))
    direct = a.where("form = 'call'").join(sig, ["target", "n_args"]).select(*keys, "off", "type")
    a = materialize(a, "assignments")
    first = lambda t: t.groupBy(*keys).agg(F.min_by("type", "off").alias("type"))
    said = a.where("own IS NOT NULL").select(*keys, "off", F.col("own").alias("type")).union(direct)
    known = Rounds(first(said.union(seeds.select(*keys, F.lit(-1).cast("long"), "type"))), "types")
    try:
        while known.size:
            front = known.front.select(*scope, F.col("v").alias("source"), F.col("type").alias("from"))
            new = a.where("own IS NULL AND source IS NOT NULL").join(front, [*scope, "source"])
            by_call = new.where("form = 'call'").withColumn("target", F.concat("from", F.lit("."), "member")).join(sig, ["target", "n_args"]).select(*keys, "off", "type")
            passed = new.where("form != 'call'").select(*keys, "off", F.col("from").alias("type"))
            known.add(first(passed.union(by_call)).join(known.all(), keys, "left_anti"))
        return materialize(known.all(), "typed")
    finally:
        known.drop()


# -- names

# Prefixes of variables by their type: fixed values.
PREFIXES = {
    "int": "n", "short": "n", "byte": "n", "boolean": "z", "long": "j", "float": "f", "double": "d", "char": "c", "java.lang.String": "str", "String": "str", "java.lang.Object": "obj", "Object": "obj",
    "java.lang.StringBuilder": "sb", "StringBuilder": "sb", "android.content.Intent": "intent", "Intent": "intent", "android.os.Bundle": "bundle", "Bundle": "bundle",
    "android.content.Context": "context", "Context": "context", "android.view.View": "view", "View": "view",
}
ENDINGS = (("[]", "arr"), ("Exception", "e"), ("List", "list"), ("Map", "map"), ("Set", "set"))


def prefix_of(kind: Column) -> Column:
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv]), kind)
    out = F.when(kind.isNull(), "local").when(known.isNotNull(), known)
    for end, name in ENDINGS:
        out = out.when(kind.endswith(end), name)
    return out.otherwise("v")


def roles(ir: DataFrame, scope: tuple[str, ...] = BLOCK) -> DataFrame:
    """scope, v, role: array (before [ or .length), index (between [ and ]), length (takes .length); of several the one that is said last."""
    t = ir.where("kind = 'raw' OR (kind = 'assign' AND form = 'raw')")
    got = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    var = r"(v\d+(?:_\d+)?)"
    fact = lambda at, role, v: F.struct(F.lit(at).alias("at"), F.lit(role).alias("role"), v.alias("v"))
    facts = F.array(
        fact(0, "array", got(rf"^[^\[]*?(?<![A-Za-z0-9_]){var}\s*\[")), fact(1, "index", got(rf"^[^\[]*\[\s*{var}\s*\]")), fact(2, "array", got(rf"^.*?(?<![A-Za-z0-9_]){var}\.length")),
        fact(3, "length", F.when(F.col("text").contains(".length"), F.col("dst"))),
    )
    t = t.select(*scope, "off", F.inline(F.filter(facts, lambda x: x["v"].isNotNull())))
    return t.groupBy(*scope, "v").agg(F.max_by("role", F.struct("off", "at")).alias("role"))


def names(ir: DataFrame, types: DataFrame, methods: DataFrame | None = None, scope: tuple[str, ...] = BLOCK) -> DataFrame:
    """scope, v, name of every variable: result for the first that is returned; this and pN for parameter registers before any assignment; i, j, k for
    indices (k for all after the third), length, arrN; else a prefix by type with a number. Numbers count by first appearance, what a statement reads before what it assigns.

    methods: method_uid, registers_size, ins_size, is_static; without it no variable is a parameter."""
    uses = st.used_variables(F.concat_ws(" ", F.coalesce("target", F.lit("")), "text"))
    every = F.concat(uses, F.when(F.col("dst").isNotNull(), F.array("dst")).otherwise(F.array().cast("array<string>")))
    t = ir.select(*scope, "off", F.posexplode(every).alias("pos", "v")).groupBy(*scope, "v").agg(F.min(F.struct("off", "pos")).alias("at"))
    given = ir.where("kind = 'return' AND form = 'var'").groupBy(*scope).agg(F.min_by("text", "off").alias("given"))
    t = t.join(given, [*scope], "left").join(types.select(*scope, "v", "type"), [*scope, "v"], "left").join(roles(ir, scope), [*scope, "v"], "left")
    parameter = F.lit(None).cast("string")
    if methods is not None:
        t = t.join(methods.select("method_uid", "registers_size", "ins_size", "is_static"), "method_uid", "left")
        nth = F.regexp_extract("v", r"^v(\d+)$", 1).try_cast("long") - (F.col("registers_size") - F.col("ins_size"))
        inside = (nth >= 0) & (nth < F.col("ins_size"))
        parameter = F.when(inside & ~F.col("is_static") & (nth == 0), F.lit("this")).when(inside, F.concat(F.lit("p"), F.when(F.col("is_static"), nth).otherwise(nth - 1).cast("string")))
    fixed = F.when(F.col("v") == F.col("given"), F.lit("result")).otherwise(F.coalesce(parameter, F.when(F.col("role") == "length", F.lit("length"))))
    group = F.when(F.col("role") == "index", "#index").when(F.col("role") == "array", "arr").otherwise(prefix_of(F.col("type")))
    t = t.withColumn("fixed", fixed).withColumn("group", F.when(F.col("fixed").isNull(), group))
    nth = F.row_number().over(W.partitionBy(*scope, "group").orderBy("at")) - 1
    name = F.when(F.col("group") == "#index", F.element_at(F.array(F.lit("i"), F.lit("j"), F.lit("k")), F.least(nth, F.lit(2)) + 1)).otherwise(F.concat("group", nth.cast("string")))
    return t.select(*scope, "v", F.coalesce("fixed", name).alias("name"))


def renamed(ir: DataFrame, named: DataFrame, scope: tuple[str, ...] = BLOCK) -> DataFrame:
    """Statements with variables replaced by their names: one map for each scope, looked up word by word."""
    maps = named.groupBy(*scope).agg(F.map_from_entries(F.collect_list(F.struct("v", "name"))).alias("names"))
    t = ir.join(maps, [*scope], "left")
    put = lambda c: F.when(F.col("names").isNull(), F.col(c)).otherwise(words_replaced(F.col(c), F.col("names"))).alias(c)
    return t.select(*scope, "off", "kind", put("dst"), "form", put("target"), put("text"))


def renamed_conditions(conditions: DataFrame, named: DataFrame, methods: DataFrame | None = None, scope: tuple[str, ...] = BLOCK) -> DataFrame:
    """scope, off, cond with bare registers replaced by the name of their last version in the block, of parameters also where the block doesn't mention them; others stay.
    conditions: scope, off, cond."""
    reg, ver = F.regexp_extract("v", r"^(v\d+)", 1), F.coalesce(F.regexp_extract("v", r"_(\d+)$", 1).try_cast("long"), F.lit(0))
    last = named.select(*scope, reg.alias("reg"), ver.alias("ver"), "name").groupBy(*scope, "reg").agg(F.max_by("name", "ver").alias("name"))
    maps = last.groupBy(*scope).agg(F.map_from_entries(F.collect_list(F.struct("reg", "name"))).alias("names"))
    t = conditions.join(maps, [*scope], "left").withColumn("names", F.coalesce("names", F.create_map().cast("map<string,string>")))
    if methods is not None:
        t = t.join(methods.select("method_uid", "registers_size", "ins_size", "is_static"), "method_uid", "left")
        first = F.col("registers_size") - F.col("ins_size")
        nth = F.sequence(F.lit(0).cast("long"), F.col("ins_size").cast("long") - 1)
        name = lambda i: F.when(~F.col("is_static") & (i == 0), F.lit("this")).otherwise(F.concat(F.lit("p"), F.when(F.col("is_static"), i).otherwise(i - 1).cast("string")))
        entries = F.when(F.coalesce(F.col("ins_size"), F.lit(0)) > 0, F.transform(nth, lambda i: F.struct(F.concat(F.lit("v"), (first + i).cast("string")).alias("k"), name(i).alias("x")))).otherwise(F.array().cast("array<struct<k:string,x:string>>"))
        extra = F.filter(entries, lambda e: ~F.map_contains_key("names", e["k"]))
        t = t.withColumn("names", F.map_concat("names", F.map_from_entries(extra)))
    return t.select(*scope, "off", words_replaced(F.col("cond"), F.col("names")).alias("cond"))
