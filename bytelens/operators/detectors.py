"""Vulnerability detectors: one closure over all methods and sources, joined to patterns and sinks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from bytelens.operators.bymethod import NONE, by_method, tagged
from bytelens.operators.dataflow import api_sources, closure, flow_edges, invoke_map, linear_use_def, rw_sets, tainted_reads
from bytelens.runtime import materialize

# Detector categories in the order of a full run, their source and sink patterns: fixed values.
_INTENT = ("getIntent", "getData", "getStringExtra", "getDataString", "getExtras", "getCharSequenceExtra")
_START = ("startActivity", "startActivityForResult", "setResult", "sendBroadcast")
DETECTORS = {
    "intent_spoofing": (_INTENT, _START),
    "rce_dynamic_loading": (None, ("DexClassLoader", "PathClassLoader", "InMemoryDexClassLoader", "loadClass")),
    "insecure_logging": (
        ("getLastLocation", "getCurrentLocation", "getDeviceId", "getSubscriberId", "getAndroidId", "getPrimaryClip", "getText", "getString", "getToken"),
        ("Log.d", "Log.i", "Log.e", "Log.w", "Log.v", "println", "print"),
    ),
    "sql_injection": (("getStringExtra", "getText", "getData", "getDataString", "getCharSequenceExtra"), ("rawQuery", "execSQL", "query")),
    "webview_unsafe_url": (("getStringExtra", "getText", "getData", "getDataString"), ("loadUrl", "loadDataWithBaseURL", "loadData")),
    "webview_javascript_interface": (None, ("addJavascriptInterface",)),
    "ipc_intent_validation": (_INTENT, _START),
}
PI_CREATE = ("PendingIntent.getActivity", "PendingIntent.getBroadcast", "PendingIntent.getService", "PendingIntent.getForegroundService")
PI_SETTERS = ("Intent.setAction", "Intent.setPackage", "Intent.setData", "Intent.setDataAndType", "Intent.setClipData")


def pattern_table(spark: SparkSession, detectors: dict | None = None) -> DataFrame:
    """rank, category, role, pattern: a row for each pattern; a few dozen rows, so it may be broadcast."""
    rows = []
    for rank, (name, (sources, sinks)) in enumerate((detectors or DETECTORS).items()):
        rows += [(rank, name, "source", p) for p in sources or ()] + [(rank, name, "sink" if sources else "invoke", p) for p in sinks]
    return spark.createDataFrame(rows, "rank int, category string, role string, pattern string")


def matching(refs: DataFrame, patterns: DataFrame, role: str) -> DataFrame:
    """refs with the categories any of whose patterns their method_ref contains, each once."""
    p = F.broadcast(patterns.where(F.col("role") == role).select("rank", "category", "pattern"))
    return refs.join(p, F.col("method_ref").contains(F.col("pattern"))).drop("pattern").distinct()


def with_sources(category: str, patterns: list[str], detectors: dict | None = None) -> dict:
    """The detectors with other sources for one of them: the given patterns replace its own."""
    table = dict(detectors or DETECTORS)
    table[category] = (tuple(patterns), table[category][1])
    return table


def scan(spark: SparkSession, ins: DataFrame, detectors: dict | None = None, categories: list[str] | None = None) -> DataFrame:
    """find over straight-line definitions of ins, a table: reads and writes are made of the methods that have both a source and a sink only."""
    table = {c: d for c, d in (detectors or DETECTORS).items() if not categories or c in categories}
    patterns, sources, invokes = pattern_table(spark, table), api_sources(ins), invoke_map(ins)
    both = matching(sources, patterns, "source").select("method_uid", "category").join(matching(invokes, patterns, "sink").select("method_uid", "category"), ["method_uid", "category"], "left_semi")
    rw = rw_sets(ins.join(both.select("method_uid").distinct(), "method_uid", "left_semi"))
    return find(spark, rw, linear_use_def(rw), sources, invokes, detectors, categories)


def find(spark: SparkSession, rw: DataFrame, use_def: DataFrame, sources: DataFrame, invokes: DataFrame, detectors: dict | None = None, categories: list[str] | None = None) -> DataFrame:
    """category, method_uid, source_off (null for plain invoke scans), source_desc, sink_off, sink_desc; of
    findings that share category, method and sink the first source stays. Only sources that a wanted detector names, in
    methods that have one of its sinks, are followed."""
    table = {c: d for c, d in (detectors or DETECTORS).items() if not categories or c in categories}
    patterns = pattern_table(spark, table)
    src = matching(sources.select("method_uid", F.col("off").alias("seed_off"), F.col("reg").alias("seed_reg"), "method_ref"), patterns, "source").withColumnRenamed("method_ref", "source_desc")
    snk = materialize(matching(invokes, patterns, "sink").withColumnRenamed("method_ref", "sink_desc"), "sinks")
    src = materialize(src.join(snk.select("method_uid", "category").distinct(), ["method_uid", "category"], "left_semi"), "sources")
    seeds = src.select("method_uid", F.col("seed_off").alias("off"), F.col("seed_reg").alias("reg")).distinct()
    reads = tainted_reads(closure(seeds, flow_edges(rw, use_def)), use_def.join(snk.select("method_uid", F.col("off").alias("use_off")).distinct(), ["method_uid", "use_off"], "left_semi"))
    flows = reads.join(src, ["method_uid", "seed_off", "seed_reg"]).join(snk, ["method_uid", "off", "rank", "category"])
    flows = flows.select("rank", "category", "method_uid", F.col("seed_off").alias("source_off"), "source_desc", F.col("off").alias("sink_off"), "sink_desc")
    plain = matching(invokes, patterns, "invoke").select("rank", "category", "method_uid", F.lit(None).cast("long").alias("source_off"), F.lit("").alias("source_desc"), F.col("off").alias("sink_off"), F.col("method_ref").alias("sink_desc"))
    w = W.partitionBy("category", "method_uid", "sink_off").orderBy(F.col("source_off").asc_nulls_first(), "source_desc")
    return flows.union(plain).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "rank")


def pending_intents(rw: DataFrame, use_def: DataFrame, sources: DataFrame, invokes: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """method_uid, invoke_off, base_intent_empty, dangerous_destination, destination_kind. placed: method_uid, off, block_id of all
    instructions; without it a method is one block of the offsets that rw has.

    A PendingIntent creation with at least four argument registers whose result is taken right after it, in the same block. The base
    intent (third argument) is empty unless a setter's result is among its transitive definitions, followed
    through instructions that read exactly one register. The destination is dangerous if the result
    reaches setContentIntent."""
    any_of = lambda ps: F.exists(F.array(*map(F.lit, ps)), lambda p: F.col("method_ref").contains(p))
    placed = rw.select("method_uid", F.lit(0).alias("block_id"), "off").distinct() if placed is None else placed
    kinds = invokes.select("method_uid", "off", any_of(PI_CREATE).alias("create"), F.col("method_ref").contains("setContentIntent").alias("sink")).where("create or sink")
    parts = tagged(
        rw.select("method_uid", "off", "reg", "is_write", "pos"), use_def.select("method_uid", "use_off", "reg", "def_off"), sources.select("method_uid", "off", "reg", any_of(PI_SETTERS).alias("setter")),
        kinds, placed.select("method_uid", "block_id", "off"), columns=("a", "b", "c", "d"),
    )
    out = by_method(parts, _pending, ["invoke_off", "empty", "danger"], together=True)
    hit = F.col("danger") == 1
    return out.select("method_uid", "invoke_off", (F.col("empty") == 1).alias("base_intent_empty"), hit.alias("dangerous_destination"), F.when(hit, "Notification/setContentIntent").otherwise("other").alias("destination_kind"))


class _Lookup:
    """Values by key, several for a key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hit, which of the keys it is of, and its value."""
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = hi - lo
        of = np.repeat(np.arange(len(keys)), n)
        return of, self.values[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]


def _follow(seeds: np.ndarray, step: _Lookup, onwards: _Lookup, wanted: np.ndarray) -> np.ndarray:
    """For each seed, whether a step from it, or from a place it leads to, meets one of wanted. Places are numbers; onwards gives the places that what is met leads to.
    All seeds go on together; each comes to a place once."""
    met, seen = np.zeros(len(seeds), bool), set()
    of, at = np.arange(len(seeds)), seeds
    while len(of):
        hit, reached = step(at)
        of = of[hit]
        met[of[np.isin(reached, wanted)]] = True
        hit, at = onwards(reached)
        of = of[hit]
        new = [i for i, x in enumerate(zip(of.tolist(), at.tolist())) if x not in seen and not seen.add(x)]
        of, at = of[new], at[new]
    return met


def _pending(x: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Pending intents of many methods: the parts are reads and writes, uses and definitions, sources, invokes, places in blocks. A place of code is one
    number, of its method and offset, and with a register another."""
    part, uid = x["part"], x["method_uid"]
    nth = np.cumsum(np.concatenate(([0], uid[1:] != uid[:-1])))
    (m, a, b, c, d) = zip(*[[v[part == k] for v in (nth, *(x[n] for n in "abcd"))] for k in range(5)])
    b = [np.where(v == NONE, -1, v) if k == 2 else v for k, v in enumerate(b)]  # a result that goes to no register
    none = [np.empty(0, np.int64)] * 4
    if not (b[3] == 1).any():
        return none
    offs = np.concatenate([a[0], a[1], c[1], a[2], a[3], b[4]])
    regs = np.concatenate([b[0], b[1], b[2], [0]])
    low, width, least, count = int(offs.min()), int(offs.max() - offs.min()) + 1, int(regs.min()), int(regs.max() - regs.min()) + 1
    if (int(nth[-1]) + 1) * width * count >= 1 << 62:
        if nth[-1] == 0:
            raise ValueError("offsets or registers of a method are out of range")
        half = nth <= nth[-1] // 2
        return [np.concatenate(v) for v in zip(*(_pending({k: v[side] for k, v in x.items()}) for side in (half, ~half)))]
    place = lambda m, off: m * width + (off - low)
    held = lambda at, reg: at * count + (reg - least)
    at, reads = place(m[0], a[0]), c[0] == 0
    sites, n_reads = np.unique(at[reads], return_counts=True)
    third = reads & (d[0] == 2)
    invokes, taken = place(m[3], a[3]), place(m[2], a[2])
    create = invokes[b[3] == 1]
    create = create[np.isin(create, sites[n_reads >= 4])]
    of, intent = _Lookup(at[third], b[0][third])(create)
    create = create[of]
    # the result is taken by what follows in the block
    order = np.lexsort((b[4], a[4], m[4]))
    pm, block, off = m[4][order], a[4][order], b[4][order]
    same = np.flatnonzero((pm[1:] == pm[:-1]) & (block[1:] == block[:-1]))
    follows = _Lookup(place(pm[same], off[same]), place(pm[same + 1], off[same + 1]))
    of, result = follows(create)
    create, intent = create[of], intent[of]
    of, reg = _Lookup(taken, b[2])(result)
    create, intent, result = create[of], intent[of], result[of]
    if not len(create):
        return none
    use, defined = place(m[1], a[1]), place(m[1], c[1])
    # backwards: definitions of the intent, on through instructions of one read; forwards: uses of the result, on to what they write
    single = reads & np.isin(at, sites[n_reads == 1])
    filled = _follow(held(create, intent), _Lookup(held(use, b[1]), defined), _Lookup(at[single], held(at, b[0])[single]), taken[c[2] == 1])
    danger = _follow(held(result, reg), _Lookup(held(defined, b[1]), use), _Lookup(at[~reads], held(at, b[0])[~reads]), invokes[c[3] == 1])
    first = np.flatnonzero(np.concatenate(([True], uid[1:] != uid[:-1])))
    return [uid[first[create // width]], create % width + low, (~filled).astype(np.int64), danger.astype(np.int64)]


def risk_label(findings: DataFrame) -> DataFrame:
    both = F.col("base_intent_empty") & F.col("dangerous_destination")
    return findings.withColumn("risk", F.when(both, "RISK").when(F.col("base_intent_empty") | F.col("dangerous_destination"), "review").otherwise("ok"))

