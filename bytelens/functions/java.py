"""Column functions of the Java view of bytecode: descriptors, flags, names, conditions, escapes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Primitive descriptors and access flags: fixed values of the file format.
PRIMITIVES = {"V": "void", "Z": "boolean", "B": "byte", "S": "short", "C": "char", "I": "int", "J": "long", "F": "float", "D": "double"}
FLAGS = ((0x1, "public"), (0x2, "private"), (0x4, "protected"), (0x8, "static"), (0x10, "final"), (0x400, "abstract"), (0x1000, "synthetic"))
MEMBER_FLAGS = ((0x20, "synchronized"), (0x40, "volatile"), (0x80, "transient"), (0x100, "native"))
CLASS_FLAGS = ((0x200, "interface"),)
# Comparisons of conditional branches: fixed values.
CONDITIONS = {"eq": "==", "ne": "!=", "lt": "<", "ge": ">=", "gt": ">", "le": "<="}
OPPOSITE = {"!=": "==", "==": "!=", ">=": "<", "<": ">=", ">": "<=", "<=": ">"}
# Packages whose names are shortened: fixed values.
SHORTENED = ("java.lang.", "java.util.", "java.io.", "android.content.", "android.os.", "android.app.", "android.view.", "android.widget.")


def descriptor_to_java(d: Column) -> Column:
    """[ becomes a trailing [], Lpkg/Name; the dotted name, a primitive its keyword; others stay as they are."""
    depth = F.length(F.regexp_extract(d, r"^(\[*)", 1))
    base = F.regexp_extract(d, r"^\[*(.*)$", 1)
    name = F.regexp_replace(F.regexp_extract(base, "^L([^;]*)", 1), "/", ".")
    simple = F.element_at(F.create_map(*[F.lit(x) for kv in PRIMITIVES.items() for x in kv]), base)
    return F.concat(F.when(base.startswith("L"), name).otherwise(F.coalesce(simple, base)), F.repeat(F.lit("[]"), depth))


def access_flags(flags: Column, for_class: bool) -> Column:
    table = FLAGS[:5] + (CLASS_FLAGS if for_class else MEMBER_FLAGS) + FLAGS[5:]
    return F.array_join(F.array_compact(F.array(*[F.when(flags.bitwiseAND(bit) != 0, word) for bit, word in table])), " ")


def escape(s: Column) -> Column:
    for raw, out in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(raw), F.lit(out))
    return s


def class_path(name: Column) -> Column:
    return F.concat(F.replace(name, F.lit("."), F.lit("/")), F.lit(".java"))


def package_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)


def simple_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def in_package(name: Column, package: str) -> Column:
    p = package.rstrip(".")
    return (name == p) | name.startswith(p + ".")


def excluded(name: Column, entries: list[str]) -> Column:
    """Whether any entry covers the class; a trailing * means the package, as its help promises."""
    out = F.lit(False)
    for e in entries:
        out = out | in_package(name, e.strip().rstrip("*"))
    return out


def shorten(text: Column) -> Column:
    """Strips each prefix where no letter, digit or _ stands before it, up to the first place where one does."""

    def strip(t: Column, p: Column) -> Column:
        stop = F.regexp_instr(t, F.concat(F.lit("[A-Za-z0-9_]"), p))
        head = F.when(stop > 0, F.substring(t, F.lit(1), stop)).otherwise(t)
        tail = F.when(stop > 0, F.substring(t, stop + 1, F.length(t))).otherwise(F.lit(""))
        return F.concat(F.regexp_replace(head, F.concat(F.lit("(?<![A-Za-z0-9_])"), p), F.lit("")), tail)

    return F.aggregate(F.array(*[F.lit(p.replace(".", r"\.")) for p in SHORTENED]), text, strip)


def goto_operand(raw_hex: Column, operands: Column) -> Column:
    """A two-byte goto's operand: its offset byte is signed, which decoders show as unsigned."""
    two = raw_hex.rlike(r"^\s*\S+\s+[0-9A-Fa-f]{2}\s*$")
    value = F.conv(F.regexp_extract(raw_hex, r"([0-9A-Fa-f]{2})\s*$", 1), 16, 10).cast("int")
    return F.when(two & (value >= 128), F.concat(F.lit("-"), F.lpad(F.lower(F.hex((256 - value).cast("long"))), 2, "0"), F.lit("h"))).otherwise(operands)


def enum_constants(class_name: Column, super_name: Column, fields: Column) -> Column:
    """Names of the constants of an enum, in order; empty for other classes. fields: array of type, name, flags."""
    own = F.filter(fields, lambda f: (f["flags"].bitwiseAND(0x18) == 0x18) & (f["type"] == class_name))
    return F.when(F.trim(super_name) == "Enum", F.transform(own, lambda f: f["name"])).otherwise(F.array().cast("array<string>"))


def condition(mnemonic: Column, operands: Column) -> Column:
    """The Java comparison of an if- instruction, whose last operand is the target; of a switch its register."""
    ops = F.transform(F.split(operands, ","), lambda x: F.trim(x))
    kind = F.regexp_extract(mnemonic, r"^if-(eq|ne|lt|ge|gt|le)", 1)
    sign = F.element_at(F.create_map(*[F.lit(x) for kv in CONDITIONS.items() for x in kv]), F.when(kind != "", kind))
    return F.when(mnemonic.endswith("-switch"), ops[0]).otherwise(F.concat_ws(" ", ops[0], sign, F.when(mnemonic.endswith("z"), F.lit("0")).otherwise(F.try_element_at(ops, F.lit(2)))))


def negate(cond: Column) -> Column:
    """The first comparison found in the order of OPPOSITE is flipped; without one, !(cond)."""
    out = F.concat(F.lit("!("), cond, F.lit(")"))
    for op in reversed(OPPOSITE):
        at = F.locate(f" {op} ", cond)
        out = F.when(at > 0, F.concat(F.substring(cond, F.lit(1), at), F.lit(OPPOSITE[op]), F.substring(cond, at + 1 + len(op), F.lit(1 << 20)))).otherwise(out)
    return out


def is_branch_offset(token: Column) -> Column:
    t = F.trim(token)
    return (t == "") | t.rlike(r"^[+-]\s*[0-9A-Fa-fh]*$") | t.rlike(r"^0x[0-9A-Fa-f]*$")


def receiver_call(call: Column, args: Column) -> Column:
    """Class.m with arguments recv, a, b becomes recv.m(a, b); without arguments the class stays. The receiver ends at
    the first comma outside parentheses."""
    args = F.trim(args)
    first = F.trim(F.regexp_extract(args, r"^((?:[^,(]|\((?:[^()]|\([^()]*\))*\))*)", 1))
    rest = F.regexp_replace(F.substring(args, F.length(F.regexp_extract(args, r"^((?:[^,(]|\((?:[^()]|\([^()]*\))*\))*)", 1)) + 1, F.length(args)), r"^,\s*", "")
    return F.when(args == "", F.concat(call, F.lit("()"))).otherwise(F.concat(first, F.lit("."), F.substring_index(call, ".", -1), F.lit("("), rest, F.lit(")")))
