"""Programs of a few instructions, all machines at once."""

from bytelens.operators import emulator

KIND = "method_uid long, off long, mnemonic string, operands string"
# name: (code, registers, parameters, expected status, returned (tag, i, s), console)
PROGRAMS = {
    "add": ([(0, "const/4", "v0, 5"), (2, "const/4", "v1, 3"), (4, "add-int", "v2, v0, v1"), (8, "return", "v2")], 3, [], "finished", ("Int", 8, None), ""),
    "taken": ([(0, "const/4", "v0, 0"), (2, "if-eqz", "v0, 6"), (4, "const/16", "v1, 10"), (6, "const/4", "v2, 2"), (8, "return", "v1")], 3, [], "finished", ("Unset", None, None), ""),
    "not taken": ([(0, "const/4", "v0, 1"), (2, "if-eqz", "v0, 6"), (4, "const/16", "v1, 10"), (6, "const/4", "v2, 2"), (8, "return", "v1")], 3, [], "finished", ("Int", 10, None), ""),
    "parameters": ([(0, "add-int", "v0, v1, v2"), (4, "return", "v0")], 3, [10, 20], "finished", ("Int", 30, None), ""),
    "by zero": ([(0, "const/16", "v0, 10"), (4, "const/4", "v1, 0"), (6, "div-int", "v2, v0, v1"), (10, "return", "v2")], 3, [], "error", None, ""),
    "wraps": ([(0, "const", "v0, 2147483647"), (6, "add-int/lit8", "v0, v0, 1"), (10, "rsub-int/lit8", "v1, v0, 5"), (14, "xor-int/2addr", "v0, v1"), (16, "return", "v1")], 2, [], "finished", ("Int", -2147483643, None), ""),
    "strings": ([(0, "const-string", 'v0, "hello"'), (4, "invoke-virtual", "v0, java.lang.String.length()"), (10, "move-result", "v1"), (12, "return", "v1")], 2, [], "finished", ("Int", 5, None), ""),
    "max": ([(0, "const/4", "v0, -5"), (2, "const/4", "v1, 3"), (4, "invoke-static", "v0, v1, java.lang.Math.max(int, int)"), (10, "move-result", "v2"), (12, "return", "v2")], 3, [], "finished", ("Int", 3, None), ""),
    "prints": ([(0, "const-string", 'v1, "test message"'), (4, "invoke-virtual", "v0, v1, java.io.PrintStream.println(java.lang.String)"), (10, "return-void", "")], 2, [], "finished", None, "test message\n"),
    "logs": ([(0, "const-string", 'v0, "MyTag"'), (4, "const-string", 'v1, "hi"'), (8, "invoke-static", "v0, v1, android.util.Log.d(a, b)"), (14, "move-result", "v2"), (16, "return", "v2")], 3, [], "finished", ("Int", 0, None), "[Log.d] MyTag: hi"),
    "unknown call": ([(0, "invoke-virtual", "v0, pkg.A.b()"), (6, "move-result-object", "v1"), (8, "return-object", "v1")], 2, [], "finished", ("Unknown", None, "result of pkg.A.b"), ""),
    "endless": ([(0, "goto", "0")], 1, [], "limit", None, ""),
    "past the end": ([(0, "const/4", "v0, 1")], 1, [], "finished", None, ""),
}


def test_programs(spark):
    names = list(PROGRAMS)
    ins = spark.createDataFrame([(i, *x) for i, n in enumerate(names) for x in PROGRAMS[n][0]], KIND)
    machines = spark.createDataFrame([(i, PROGRAMS[n][1], [("Int", p, None) for p in PROGRAMS[n][2]]) for i, n in enumerate(names)], f"method_uid long, registers_size int, params array<{emulator.VALUE}>")
    last = {}
    rows = sorted(emulator.run(ins, machines, max_steps=8).collect(), key=lambda r: r.step)
    for r in rows:
        last[names[r.method_uid]] = r
    for n, (_, _, _, status, returned, console) in PROGRAMS.items():
        r = last[n]
        assert (n, r.status, tuple(r.returned) if r.returned else None, r.console) == (n, status, returned, console)
    assert last["by zero"].error == "division by zero" and last["endless"].step == 8
    assert sum(names[r.method_uid] == "add" for r in rows) == 5  # the start and four steps
