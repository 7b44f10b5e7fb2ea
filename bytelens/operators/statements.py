"""Instructions as Java text: the value an instruction assigns, its statement, and the program passes that merge
statements, all as column expressions and windows over methods.

Where a known decompiler slips, the text here is what Java means: xor is ^, and a string keeps its commas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bytelens.operators.dataflow import callee, has_callee

# Operators of arithmetic mnemonics: fixed values.
SIGNS = {"add": "+", "sub": "-", "mul": "*", "div": "/", "rem": "%", "and": "&", "or": "|", "xor": "^", "shl": "<<", "shr": ">>", "ushr": ">>>"}
_ARITH = "^(" + "|".join(SIGNS) + ")-"
MOVES = r"^move(-wide|-object)?(/from16)?$|^move/16$"
CASTS = r"^(?:int|long|float|double)-to-(int|long|float|double|byte|char|short)$"


def operand(operands: Column, i: int) -> Column:
    return F.trim(F.try_element_at(F.split(operands, ","), F.lit(i)))


def sign_of(mnemonic: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SIGNS.items() for x in kv]), F.nullif(F.regexp_extract(mnemonic, _ARITH, 1), F.lit("")))


# What an instruction puts into its first register, by mnemonic: {a}, {b}, {c} are its operands, {f} the last name of the
# third, {s} the sign, {rest} all after the first comma, {t} a cast's type, {n} a type without its [].
VALUES = (
    (r"^const(/4|/16|-string(/jumbo)?|-wide.*|/high16)?$", "{rest}"),
    (_ARITH + ".*/2addr$", "{a} {s} {b}"),
    (_ARITH + "int/lit(8|16)$", "{b} {s} {c}"),
    ("^rsub-int(/lit8)?$", "{c} - {b}"),
    (_ARITH + "(int|long|float|double)$", "{b} {s} {c}"),
    ("^neg-", "-{b}"),
    ("^not-", "~{b}"),
    (MOVES, "{b}"),
    (CASTS, "({t}) {b}"),
    ("^new-array$", "new {n}[{b}]"),
    ("^iget", "{b}.{f}"),
    ("^sget", "{b}"),
    ("^aget", "{b}[{c}]"),
    ("^array-length$", "{b}.length"),
    ("^new-instance$", "new {b}()"),
    ("^check-cast$", "({b}) {a}"),
    ("^instance-of$", "{b} instanceof {c}"),
    ("^const-class$", "{b}.class"),
    ("^cmp-long$", "({b} > {c}) ? 1 : (({b} < {c}) ? -1 : 0)"),
    ("^cmp[lg]-", "({b} < {c}) ? -1 : (({b} > {c}) ? 1 : 0)"),
)
# Statements that assign nothing.
OTHERS = (
    ("^(if-|goto|nop$)", ""),
    ("^return-void$", "return;"),
    ("^return", "return {a};"),
    ("^throw$", "throw {a};"),
    ("^iput", "{b}.{f} = {a};"),
    ("^sput", "{b} = {a};"),
    ("^aput", "{b}[{c}] = {a};"),
    ("^monitor-(enter|exit)$", "/* {m}({a}) */"),
)


def _choose(mnemonic: Column, table) -> Column:
    out = None
    for pattern, form in table:
        out = F.when(mnemonic.rlike(pattern), form) if out is None else out.when(mnemonic.rlike(pattern), form)
    return out


def _once(body, **columns: Column) -> Column:
    """body over the columns, each computed once for a row however often body names it."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])), lambda x: body(*(x[n] for n in columns)))[0]


def _fill(form: Column, mnemonic: Column, operands: Column) -> Column:
    """A form with its marks filled in; null where it needs more operands than there are."""
    a, b, c = (operand(operands, i) for i in (1, 2, 3))
    none = F.lit("")
    enough = F.size(F.split(operands, ",")) >= F.when(form.contains("{c}") | form.contains("{f}") | form.contains("{n}"), 3).when(form.contains("{b}") | form.contains("{rest}"), 2).otherwise(1)
    marks = {
        "{s}": F.coalesce(sign_of(mnemonic), none), "{t}": F.regexp_extract(mnemonic, CASTS, 1), "{m}": mnemonic, "{n}": F.coalesce(F.regexp_replace(c, r"\[\]$", ""), none), "{f}": F.coalesce(F.substring_index(c, ".", -1), none),
        "{a}": F.coalesce(a, none), "{b}": F.coalesce(b, none), "{c}": F.coalesce(c, none), "{rest}": F.trim(F.regexp_replace(operands, r"^[^,]*,", "")), "{ops}": operands,
    }
    text = F.regexp_replace(F.when(enough, form), r"^(.*)\{b\} \{s\} \{c\}(;?)$", F.when((mnemonic.rlike("^add-int/lit")) & c.rlike("^-.+"), F.concat(F.lit("$1{b} - "), F.trim(F.substring(c, F.lit(2), F.length(c))), F.lit("$2"))).otherwise(F.lit("$0")))
    for mark, value in marks.items():
        text = F.replace(text, F.lit(mark), value)
    return text


def assigned(mnemonic: Column, operands: Column) -> Column:
    """The text of what an instruction puts into its first register; null for others and for too few operands. A negative
    literal that is added is subtracted."""
    form = F.when(operand(operands, 1).rlike(r"^v\d+$"), _choose(mnemonic, VALUES))
    return _once(_fill, f=form, m=mnemonic, o=operands)


def statement(mnemonic: Column, operands: Column) -> Column:
    """The Java line of an instruction; empty for branches, and operands with the mnemonic where there is no form."""
    value = F.when(operand(operands, 1).rlike(r"^v\d+$"), F.concat(F.lit("{a} = "), _choose(mnemonic, VALUES), F.lit(";")))
    line = _once(_fill, f=F.coalesce(value, _choose(mnemonic, OTHERS), F.lit("{ops}; /* {m} */")), m=mnemonic, o=operands)
    return F.when(mnemonic.startswith("invoke-") & operands.contains(","), F.concat(callee(operands), F.lit("("), call_arguments(operands), F.lit(");"))).otherwise(line)


def call_arguments(operands: Column) -> Column:
    """An invoke's argument registers, comma-separated."""
    return F.array_join(F.filter(F.transform(F.split(F.regexp_replace(operands, r"\(.*$", ""), ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^v\d+$")), ", ")


def intermediate(ins: DataFrame) -> DataFrame:
    """method_uid, off, kind, dst, form, target, text: a row for each instruction but payloads. kind: assign, expr, return or
    raw; form, of what is assigned or returned: var, call (target, text its arguments), pending (a result to be taken) or raw."""
    m, o, value = F.col("mnemonic"), F.col("operands"), F.col("value")
    keys = [c for c in ("method_uid", "block_id") if c in ins.columns]
    ins = ins.where(~m.endswith("-payload")).select(*keys, "off", "mnemonic", "operands", assigned(m, o).alias("value"), statement(m, o).alias("line"))
    call = has_callee()
    kind = F.when(call, "expr").when(m.startswith("move-result"), "assign").when(m.startswith("return"), "return").when(value.isNotNull(), "assign").otherwise("raw")
    form = F.when(call, "call").when(m.startswith("move-result"), "pending").when(m == "return-void", "none").when(m.startswith("return") | value.rlike(r"^v\d+$"), "var").otherwise("raw")
    text = F.when(call, call_arguments(o)).when(m.rlike("^(move-result|return-void)"), F.lit("")).when(m.startswith("return"), F.coalesce(operand(o, 1), F.lit(""))).otherwise(F.coalesce(value, "line"))
    dst = F.when(kind == "assign", operand(o, 1))
    return ins.select(*keys, "off", kind.alias("kind"), dst.alias("dst"), form.alias("form"), F.when(call, callee(o)).alias("target"), text.alias("text"))


def chain_calls(ir: DataFrame, scope: tuple[str, ...] = ("method_uid",)) -> DataFrame:
    """A call whose result is taken at once becomes what is assigned, and what is returned if it is returned at once. scope: columns
    that keep methods, or their blocks, apart."""
    w = W.partitionBy(*scope).orderBy("off")
    row = F.struct("kind", "dst", "form", "target", "text")
    at = lambda n: F.lead(row, n).over(w) if n > 0 else F.lag(row, -n).over(w)
    t = ir.select("*", at(1).alias("n1"), at(2).alias("n2"), at(-1).alias("p1"), at(-2).alias("p2"))
    is_call, pending = lambda x: (x["kind"] == "expr") & (x["form"] == "call"), lambda x: (x["kind"] == "assign") & (x["form"] == "pending")
    gives = lambda x, dst: (x["kind"] == "return") & (x["form"] == "var") & (x["text"] == dst)
    bound = lambda x: (x["kind"] == "assign") & (x["form"] == "call")
    yes = lambda c: F.coalesce(c, F.lit(False))
    me = {c: F.col(c) for c in ("kind", "dst", "form", "target", "text")}
    taken = yes(is_call(me) & pending(F.col("n1")))
    returned = yes(taken & gives(F.col("n2"), F.col("n1.dst"))) | yes(bound(me) & gives(F.col("n1"), F.col("dst")))
    gone = yes(pending(me) & is_call(F.col("p1"))) | yes(gives(me, F.col("p1.dst")) & ((pending(F.col("p1")) & is_call(F.col("p2"))) | bound(F.col("p1"))))
    kind = F.when(returned, "return").when(taken, "assign").otherwise(F.col("kind"))
    dst = F.when(returned, F.lit(None).cast("string")).when(taken, F.col("n1.dst")).otherwise(F.col("dst"))
    return t.where(~gone).select(*scope, "off", kind.alias("kind"), dst.alias("dst"), "form", "target", "text")


def merge_constructors(ir: DataFrame, scope: tuple[str, ...] = ("method_uid",)) -> DataFrame:
    """v = new Foo() and v.<init>(args) after it become v = new Foo(args). The receiver is in the target or the first argument."""
    w = W.partitionBy(*scope).orderBy("off")
    fresh = (F.col("kind") == "assign") & (F.col("form") == "raw") & F.col("text").rlike(r"^new .*\(\)$")
    init = (F.col("kind") == "expr") & (F.col("form") == "call") & F.col("target").endswith(".<init>")
    t = ir.withColumn("fresh", fresh).withColumn("receiver", F.when(init, F.when(F.col("target").rlike(r"^v\d+(_\d+)?\.<init>$"), F.regexp_replace("target", r"\.<init>$", "")).otherwise(F.regexp_extract("text", r"^(v\d+(_\d+)?)", 1))))
    rest = F.when(F.col("target").rlike(r"^v\d+(_\d+)?\.<init>$"), F.col("text")).otherwise(F.regexp_replace("text", r"^v\d+(_\d+)?(,\s*)?", ""))
    t = t.withColumn("rest", F.when(F.col("receiver").isNotNull(), rest))
    before, after = F.lag(F.when(F.col("fresh"), F.col("dst"))).over(w), F.lead(F.struct("receiver", "rest")).over(w)
    t = t.withColumn("gone", F.coalesce(F.col("receiver") == before, F.lit(False))).withColumn("after", after)
    merges = F.col("fresh") & F.coalesce(F.col("after.receiver") == F.col("dst"), F.lit(False))
    text = F.when(merges, F.concat(F.regexp_replace("text", r"\)$", ""), F.col("after.rest"), F.lit(")"))).otherwise(F.col("text"))
    return t.where("not gone").select(*scope, "off", "kind", "dst", "form", "target", text.alias("text"))


def compound(dst: Column, text: Column) -> Column:
    """v + 1 assigned to v is v++, v - 1 is v--, v op x is v op= x; null where the value doesn't begin with the variable."""
    sign = F.regexp_extract(text, r"^\S+ (\+|-|\*|/|%|&|\||\^|<<|>>>|>>) ", 1)
    rest = F.trim(F.substring(text, F.length(dst) + F.length(sign) + 3, F.length(text)))
    short = F.when((rest == "1") & sign.isin("+", "-"), F.concat(dst, sign, sign)).otherwise(F.concat(dst, F.lit(" "), sign, F.lit("= "), rest))
    return F.when((sign != "") & text.startswith(F.concat(dst, F.lit(" "))), short)


def used_variables(text: Column) -> Column:
    """Variables vN and vN_k that a text mentions, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])(v\d+(?:_\d+)?)(?![A-Za-z0-9_])"), 1))


def drop_dead(ir: DataFrame) -> DataFrame:
    """Without assignments to variables that no other statement of the method mentions; calls stay."""
    said = F.concat_ws(" ", F.coalesce("target", F.lit("")), "text")
    used = ir.select("method_uid", F.explode(used_variables(said)).alias("dst")).distinct()
    dead = (F.col("kind") == "assign") & ~F.col("form").isin("call", "pending")
    return ir.where(~dead).unionByName(ir.where(dead).join(used, ["method_uid", "dst"], "left_semi"))


def lines(ir: DataFrame, shorten: bool = True) -> DataFrame:
    """method_uid, off, line: the statements as Java text. shorten: v = v + 1 is v++ and so on; not after variables got names, as two of them may
    share one."""
    call = F.concat("target", F.lit("("), "text", F.lit(")"))
    value = F.when(F.col("form") == "call", call).when(F.col("form") == "pending", F.lit("<result>")).otherwise(F.col("text"))
    c = compound(F.col("dst"), F.col("text"))
    line = (
        F.when(F.col("form") == "compound", F.concat("text", F.lit(";")))
        .when(F.col("kind") == "assign", F.when(F.lit(shorten) & (F.col("form") == "raw") & c.isNotNull(), F.concat(c, F.lit(";"))).otherwise(F.concat("dst", F.lit(" = "), value, F.lit(";"))))
        .when(F.col("kind") == "return", F.when(F.col("form") == "none", "return;").otherwise(F.concat(F.lit("return "), value, F.lit(";"))))
        .when(F.col("kind") == "expr", F.concat(call, F.lit(";")))
        .otherwise(F.col("text"))
    )
    return ir.select(*(c for c in ("method_uid", "block_id") if c in ir.columns), "off", line.alias("line"))


def raw_type(text: Column) -> Column:
    """The type of a value by its text alone: arrays, instances, casts, strings and numbers; null if it doesn't tell."""
    t = F.trim(text)
    got = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    array = F.trim(got(r"^new ([^\[]*\S[^\[]*)\["))
    return F.coalesce(
        F.when(array.endswith("]"), array).otherwise(F.concat(array, F.lit("[]"))), F.trim(got(r"^new ([^(\[]*\S[^(\[]*)\(")), got(r"^\(([A-Z][^)]*)\) "),
        F.when(t.rlike('^".*"$') & (F.length(t) >= 2), "java.lang.String"), F.when(t.rlike(r"^-?\d+[lL]"), "long"), F.when(t.rlike(r"^-?\d+($|[ ;])"), "int"),
        F.when(t.rlike(r"^-?\d+(\.\d*)?[fF]"), "float"), F.when(t.rlike(r"^-?\d+\."), "double"),
    )


def folded_conditions(ins: DataFrame) -> DataFrame:
    """method_uid, off, cond: conditions of branches, with registers replaced by constants that one of the three instructions before,
    in the same block, puts into them and none after it overwrites. ins from cfg.placed: what stands before a place that is jumped to
    is in another block, so it says nothing about registers there."""
    from bytelens.functions import java

    m, first = F.col("mnemonic"), operand(F.col("operands"), 1)
    puts = F.when(assigned(m, F.col("operands")).isNotNull() | m.startswith("move-result"), first)
    t = ins.withColumn("puts", F.struct(puts.alias("reg"), F.when(m.rlike("^const(/4|/16|/high16)?$"), operand(F.col("operands"), 2)).alias("value")))
    near = W.partitionBy("method_uid", "block_id").orderBy("off")
    before = [F.lag("puts", i).over(near).alias(f"p{i}") for i in (1, 2, 3)]
    t = t.select("method_uid", "off", "mnemonic", "operands", *before).where(m.rlike("^if-"))
    cond = java.condition(m, F.col("operands"))
    for i in (1, 2, 3):
        free = F.lit(True)
        for j in range(1, i):
            free = free & ~F.coalesce(F.col(f"p{j}.reg") == F.col(f"p{i}.reg"), F.lit(False))
        hit = F.col(f"p{i}.value").isNotNull() & free
        cond = F.regexp_replace(cond, F.when(hit, F.concat(F.lit(r"\b"), F.col(f"p{i}.reg"), F.lit(r"\b"))).otherwise("^$"), F.coalesce(F.col(f"p{i}.value"), F.lit("")))
    return t.select("method_uid", "off", cond.alias("cond"))
