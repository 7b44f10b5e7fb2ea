"""The emulated scalar library as columns. Lengths and indices of strings are in UTF-8 bytes, as emulated."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

string_length = F.octet_length


def index_of(s: Column, part: Column) -> Column:
    at = F.call_function("locate", part, s)
    return F.when(at == 0, -1).otherwise(F.octet_length(F.substring(s, F.lit(1), at - 1)))


def char_at(s: Column, i: Column) -> Column:
    """Code point at i, 0 out of range."""
    c = F.substring(s, i + 1, F.lit(1))
    return F.when((i < 0) | (i >= F.char_length(s)), 0).otherwise(F.conv(F.hex(F.encode(c, "utf-32")), 16, 10).cast("int"))


def parse_int(s: Column) -> Column:
    """0 where the text is no int."""
    return F.when(s.rlike(r"^[+-]?[0-9]{1,11}$"), s.try_cast("int")).otherwise(0)


def wrap_int(x: Column) -> Column:
    """A long's low 32 bits as an int."""
    low = x.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= F.lit(1 << 31), low - F.lit(1 << 32)).otherwise(low)


def int_op(op: str, a: Column, b: Column) -> Column:
    """add, sub, mul, and, or, xor, shl, shr, ushr, div, rem of ints as Java does; null for a zero divisor."""
    a, b = a.cast("long"), b.cast("long")
    s = b.bitwiseAND(31).cast("int")
    nz = F.when(b != 0, b)
    return {
        "add": lambda: wrap_int(a + b), "sub": lambda: wrap_int(a - b), "mul": lambda: wrap_int(a * b),
        "and": lambda: wrap_int(a.bitwiseAND(b)), "or": lambda: wrap_int(a.bitwiseOR(b)), "xor": lambda: wrap_int(a.bitwiseXOR(b)),
        "shl": lambda: wrap_int(F.call_function("shiftleft", a, s)), "shr": lambda: F.call_function("shiftright", a, s),
        "ushr": lambda: wrap_int(F.call_function("shiftright", a.bitwiseAND(F.lit(0xFFFFFFFF)), s)),
        "div": lambda: wrap_int(F.call_function("div", a, nz)), "rem": lambda: a % nz,
    }[op]()


# Blanks that trim takes off: the white space of Unicode, fixed values.
BLANKS = r"[\u0009-\u000D \u0085   -     　]"


def trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^{BLANKS}+|{BLANKS}+$", "")


def substring(s: Column, start: Column, end: Column | None = None) -> Column:
    """Characters from start to end; the default end is the length in bytes, beyond which there is nothing anyway."""
    e = F.octet_length(s) if end is None else end
    return F.when(e > start, F.substring(s, start + 1, e - start)).otherwise("")


def wrap_long(x: Column) -> Column:
    """A decimal's low 64 bits as a long."""
    two64 = F.lit("18446744073709551616").cast("decimal(38,0)")
    low = F.pmod(x.cast("decimal(38,0)"), two64)
    return F.when(low >= F.lit("9223372036854775808").cast("decimal(38,0)"), low - two64).otherwise(low).cast("long")


def long_op(op: str, a: Column, b: Column) -> Column:
    """add, sub, mul, and, or, xor, div, rem of longs as Java does; null for a zero divisor. mul takes the product of halves,
    as a decimal doesn't hold that of two longs."""
    a, b = a.cast("long"), b.cast("long")
    d = lambda c: c.cast("decimal(20,0)")
    low, high = a.bitwiseAND(F.lit(0xFFFFFFFF)), F.call_function("shiftright", a, F.lit(32))
    top = F.lit("4294967296").cast("decimal(11,0)")
    nz = F.when(b != 0, b)
    return {
        "add": lambda: wrap_long(d(a) + d(b)), "sub": lambda: wrap_long(d(a) - d(b)),
        "mul": lambda: wrap_long(low.cast("decimal(10,0)") * d(b) + F.pmod(high.cast("decimal(11,0)") * d(b), F.lit("4294967296").cast("decimal(38,0)")).cast("decimal(11,0)") * top),
        "and": lambda: a.bitwiseAND(b), "or": lambda: a.bitwiseOR(b), "xor": lambda: a.bitwiseXOR(b),
        "div": lambda: F.when((a == F.lit(-(2**63))) & (b == -1), a).otherwise(F.call_function("div", a, F.when(nz == -1, F.lit(1)).otherwise(nz)) * F.when(nz == -1, -1).otherwise(1)), "rem": lambda: F.when(b == -1, F.lit(0).cast("long")).otherwise(a % nz),
    }[op]()


def double_op(op: str, a: Column, b: Column, kind: str = "double") -> Column:
    """add, sub, mul, div, rem of doubles (or floats, by kind) as Java does: a zero divisor gives an infinity or no number, a remainder has the
    dividend's sign."""
    a, b = a.cast(kind), b.cast(kind)
    none, infinity = F.lit(float("nan")).cast(kind), F.lit(float("inf")).cast(kind)
    zero = b == 0  # the sign of a zero shows in the text of its quotient only
    negative = (a < 0) != b.cast("string").startswith("-")
    some = F.when(~zero, b)
    return {
        "add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b,
        "div": lambda: F.when(zero, F.when(F.isnan(a) | (a == 0), none).when(negative, -infinity).otherwise(infinity)).otherwise(a / some).cast(kind),
        "rem": lambda: F.when(zero | F.isnan(a) | F.isnan(b) | (F.abs(a) == infinity), none).when(F.abs(b) == infinity, a).otherwise(a % some).cast(kind),
    }[op]()


def integer_value(x: Column) -> Column:
    """Integer.valueOf and intValue: boxes are their numbers; what isn't there counts as 0."""
    return F.coalesce(x, F.lit(0)).cast("int")


def integer_text(x: Column) -> Column:
    return integer_value(x).cast("string")


def clock() -> Column:
    """System.currentTimeMillis: time stands still."""
    return F.lit(0).cast("long")


def to_int(x: Column) -> Column:
    """A float or double as an int: towards zero, held at the ends, 0 for what is no number."""
    return F.when(F.isnan(x), 0).when(x >= 2147483647, 2147483647).when(x <= -2147483648, -2147483648).otherwise(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))).cast("int")


def to_byte(x: Column) -> Column:
    low = x.cast("long").bitwiseAND(0xFF)
    return F.when(low >= 128, low - 256).otherwise(low).cast("int")


def to_short(x: Column) -> Column:
    low = x.cast("long").bitwiseAND(0xFFFF)
    return F.when(low >= 32768, low - 65536).otherwise(low).cast("int")


def to_char(x: Column) -> Column:
    return x.cast("long").bitwiseAND(0xFFFF).cast("int")


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; 0 if either is no number."""
    return F.when(F.isnan(a.cast("double")) | F.isnan(b.cast("double")), 0).when(a > b, 1).when(a < b, -1).otherwise(0)


def array_copy(src: Column, src_pos: Column, dst: Column, dst_pos: Column, n: Column) -> Column:
    """dst with n elements of src from dst_pos on, by way of a copy; what doesn't fit is left out."""
    m = F.least(n, F.size(src) - src_pos, F.size(dst) - dst_pos)
    return F.transform(dst, lambda x, i: F.when((i >= dst_pos) & (i < dst_pos + m), F.get(src, i - dst_pos + src_pos)).otherwise(x))


def array_fill(a: Column, value: Column) -> Column:
    return F.transform(a, lambda _: value)


def log_line(level: str, tag: Column, message: Column) -> Column:
    return F.concat(F.lit(f"[Log.{level}] "), tag, F.lit(": "), message)


def put(m: Column, key: Column, value: Column) -> Column:
    """A bundle's or an intent's extras with one more entry, which replaces one of its key."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def get(m: Column, key: Column, missing=None) -> Column:
    v = F.try_element_at(m, key)
    return v if missing is None else F.coalesce(v, F.lit(missing))


def builder(*parts: Column) -> Column:
    """What a string builder holds after appends; what its constructor is given is not kept."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def parameter(text: Column) -> Column:
    """A parameter's text as a value: null, a list of numbers ([1,2], [I]1,2 or [B]1,2), an int, a long, or a string."""
    t = F.trim(text)
    body = F.regexp_extract(t, r"^(?:\[[IB]\]|\[)([^\]]*)\]?$", 1)
    numbers = F.transform(F.split(body, ","), lambda x: F.coalesce(F.trim(x).try_cast("long"), F.lit(0).cast("long")))
    i, n = t.try_cast("int"), t.try_cast("long")
    plain = t.rlike(r"^[+-]?\d+$")
    tag = F.when(t == "null", "Null").when(t.startswith("["), "Array").when(plain & i.isNotNull(), "Int").when(plain & n.isNotNull(), "Long").otherwise("Str")
    return F.struct(tag.alias("tag"), F.when(tag.isin("Int", "Long"), n).alias("number"), F.when(tag == "Array", F.when(F.trim(body) == "", F.array().cast("array<long>")).otherwise(numbers)).alias("items"), F.when(tag == "Str", t).alias("text"))
