"""Pending intents of random methods against plain Python, and the exchanges they take."""

import random

from bytelens.operators import dataflow as d, detectors

CALLS = ("android.app.PendingIntent.getActivity", "android.content.Intent.setAction", "x.setContentIntent", "x.other")


def methods():
    r = random.Random(11)
    rows, sources, invokes, placed = [], [], [], []
    for m in range(400):
        block, last = 0, None
        for off in range(0, 2 * r.randint(4, 24), 2):
            block += r.random() < 0.1
            placed.append((m, block, off))
            if last is not None and r.random() < 0.7:
                reg = r.randrange(5)
                sources.append((m, off, reg, last))
                rows.append((m, off, reg, True, 0))
                last = None
            elif r.random() < 0.6:
                last = r.choice(CALLS)
                invokes.append((m, off, last))
                rows += [(m, off, r.randrange(5), False, i) for i in range(r.choice((1, 2, 4, 4)))]
            else:
                last = None
                rows.append((m, off, r.randrange(5), True, 0))
                rows += [(m, off, r.randrange(5), False, i) for i in range(r.randint(0, 2))]
    return rows, sources, invokes, placed


def expected(rows, sources, invokes, placed):
    reads, writes, defs = {}, {}, {}
    for m, off, reg, w, _ in rows:
        (writes if w else reads).setdefault((m, off), []).append(reg)
    for (m, off), regs in reads.items():
        for reg in regs:
            before = [o for (n, o), w in writes.items() if n == m and o < off and reg in w]
            if before:
                defs[m, off, reg] = max(before)
    taken, at, out = {(m, off): (reg, ref) for m, off, reg, ref in sources}, {}, []
    for m, block, off in sorted(placed):
        at.setdefault((m, block), []).append(off)
    after = {(m, a): b for (m, _), offs in at.items() for a, b in zip(offs, offs[1:])}
    for m, off, ref in invokes:
        regs, result = reads.get((m, off), []), after.get((m, off))
        if ref != CALLS[0] or len(regs) < 4 or (m, result) not in taken:
            continue
        seen, todo, filled = set(), [(off, regs[2])], False
        while todo:
            x = todo.pop()
            if x in seen or (m, *x) not in defs:
                continue
            seen.add(x)
            at_def = defs[m, *x]
            filled |= taken.get((m, at_def), (0, ""))[1] == CALLS[1]
            if len(reads.get((m, at_def), [])) == 1:
                todo.append((at_def, reads[m, at_def][0]))
        seen, todo, danger = set(), [(result, taken[m, result][0])], False
        while todo:
            x = todo.pop()
            if x in seen:
                continue
            seen.add(x)
            for (n, use, reg), at_def in defs.items():
                if n == m and (at_def, reg) == x:
                    danger |= (m, use, CALLS[2]) in invokes
                    todo += [(use, w) for w in writes.get((m, use), [])]
        out.append((m, off, not filled, danger))
    return sorted(out)


def test_random_methods(spark):
    rows, sources, invokes, placed = methods()
    rw = spark.createDataFrame(rows, "method_uid long, off long, reg long, is_write boolean, pos long")
    t = detectors.pending_intents(
        rw, d.linear_use_def(rw), spark.createDataFrame(sources, "method_uid long, off long, reg long, method_ref string"),
        spark.createDataFrame(invokes, "method_uid long, off long, method_ref string"), spark.createDataFrame(placed, "method_uid long, block_id long, off long"),
    )
    got = sorted((r.method_uid, r.invoke_off, r.base_intent_empty, r.dangerous_destination) for r in t.collect())
    want = expected(rows, sources, set(invokes), placed)
    assert got == want and {x[2:] for x in want} == {(a, b) for a in (True, False) for b in (True, False)}
    plan = t._jdf.queryExecution().explainString(t.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.split("Initial Plan")[-1].count("Exchange") <= 2  # definitions, and all parts by method
