"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree, DataFrame and SQL only.

A source's words form one stream: its documents in hashed order, repeated once more where the target asks
for it. The first `target` words of the stream are taken, cut into blocks of block_words words; the number
of blocks is the source's exact quota. The tree splits all quotas among output shards: each node draws how
many blocks of each source go to its left half from the multivariate hypergeometric law (source by source, each
draw by ratio of uniforms), down to a shard's exact quotas. A shard then gets that many
blocks of each source's permuted sequence, disjoint from all others', and orders its pieces by a hash.

No source is gathered in one task: streams are summed over hashed buckets of about bucket_rows rows, and those over
ranges of RANGE buckets. A shard's share of a source is a range of the permuted sequence, never a list of blocks; pieces
find it by an equi-join on steps of the sequence. Null texts have no words; a null source is a source of its own, the last.
Empty tables give no rows. Rows that repeat are taken as so many documents. Columns of docs named like the results are
not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bytelens.runtime import KEY, Scratch, keyed

WORD = r"[^\x20\x09-\x0D]+"
PRIME = 2147483647
RANGE = 4096  # buckets whose sums are added up in one group
TRIES = 64  # of a draw; each is accepted with odds over one half


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _sized(s: Scratch, docs: DataFrame, bucket_rows: int, seed: int) -> tuple[DataFrame, int]:
    """One slim row for each document, and the total of sizes. Documents without an id are placed by their text."""
    h = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), F.col("text"))).otherwise(F.xxhash64(F.lit(seed), F.col("doc_id")))
    slim = docs.select(*KEY, "doc_id", "source", word_count(F.col("text")).alias("size"), h.alias("h"))
    slim = s.write(slim.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "mixing-sizes")
    rows, total = slim.agg(F.count("*"), F.sum("size")).first()
    buckets = max(1, math.ceil(rows / bucket_rows))
    return slim.withColumn("bucket", F.pmod("h", F.lit(buckets))), int(total or 0)


def targets(slim: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """skey, rank, source_size, target: shares by weight, stopped at limit times the source's size, the
    excess going to the others by weight. One row for each source; the level lambda at which
    sum(min(weight * lambda, limit * size)) meets the total is found by sorting the stopping levels."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by_name = W.orderBy(F.col("skey") == "n", "skey")
    everything = W.partitionBy()
    s = slim.groupBy("skey").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", (F.row_number().over(by_name) - 1).cast("long")).withColumn("w", w).withColumn("stop", F.col("source_size") * limit)
    before = W.orderBy(F.col("stop") / F.col("w"), "rank").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("stopped", F.coalesce(F.sum("stop").over(before), F.lit(0.0))).withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", (share * F.sum("source_size").over(everything) - F.col("stopped")) / F.col("w_left"))
    fits = F.col("level") <= F.col("stop") / F.col("w")
    s = s.withColumn("lam", F.max(F.when(fits, F.col("level"))).over(everything))  # levels that fit don't rise further
    target = F.when(F.col("lam").isNull(), F.col("stop")).otherwise(F.least(F.col("w") * F.col("lam"), F.col("stop")))
    return s.select("skey", "rank", "source_size", target.alias("target"))


def _log_factorial(x: str) -> str:
    small = ", ".join(f"{math.lgamma(i + 1)!r}D" for i in range(12))
    return (
        f"(CASE WHEN {x} < 12 THEN element_at(array({small}), CAST({x} AS INT) + 1) ELSE "
        f"{x} * ln({x}) - {x} + 0.5D * ln(6.283185307179586D * {x}) + 1D / (12D * {x}) - 1D / (360D * power({x}, 3)) + 1D / (1260D * power({x}, 5)) END)"
    )


def _draw(pop: str, good: str, n: str, uniform: str) -> str:
    """SQL: how many of n draws without replacement from pop blocks, good of one source, are that source's. Ratio of
    uniforms: points (x, y) of a box around the law's root are tried until one lies under it; uniform is the SQL of a
    number in (0, 1) for the i-th of them. Time and space don't depend on the quotas."""
    lf = _log_factorial
    p = f"named_struct('pop', CAST({pop} AS DOUBLE), 'g', CAST({good} AS DOUBLE), 'n', CAST({n} AS DOUBLE))"
    at = lambda k: f"{lf(k)} + {lf(f'(p.g - {k})')} + {lf(f'(p.n - {k})')} + {lf(f'(p.pop - p.g - p.n + {k})')}"  # noqa: E731  minus the log of the odds of k, but for a constant
    mode = "floor((p.n + 1D) * (p.g + 1D) / (p.pop + 2D))"
    spread = "sqrt(greatest(0D, (p.pop - p.n) * p.n * p.g * (p.pop - p.g)) / (p.pop * p.pop * greatest(1D, p.pop - 1D)) + 0.5D)"
    # the box of table mountain hats: mean + 1/2, and 2 sqrt(2 / e) spreads and some more to both sides
    x, y = uniform.replace("@I", "(2 * i)"), uniform.replace("@I", "(2 * i + 1)")
    k = f"floor(q.mid + (1.7155277699214135D * q.sd + 0.8989161620588988D) * ({y} - 0.5D) / {x})"
    inside = "z.k >= greatest(0D, p.n + p.g - p.pop) AND z.k <= least(p.n, p.g)"
    tried = f"aggregate(array(named_struct('k', {k}, 'x', {x})), a, (b, z) -> IF({inside}, IF(2D * ln(z.x) <= q.top - ({at('z.k')}), z.k, b), b))"
    prepared = f"named_struct('mid', p.n * p.g / p.pop + 0.5D, 'sd', {spread}, 'mode', {mode}, 'top', {at(mode)})"
    return (
        f"CAST(element_at(transform(array({p}), p -> IF(p.pop = 0 OR p.n = 0 OR p.g = 0, 0D, IF(p.g = p.pop, p.n, IF(p.n = p.pop, p.g, element_at(transform(array({prepared}), "
        f"q -> aggregate(sequence(0L, {TRIES - 1}L), -1D, (a, i) -> IF(a >= 0D, a, {tried}), a -> IF(a >= 0D, a, q.mode))), 1))))), 1) AS BIGINT)"
    )


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """rank, shard, first, quota: the blocks [first, first + quota) of each source's permuted sequence that
    each shard gets. quotas: rank, blocks. shards: a power of two. A node holds a number for each source; nodes are
    dealt to tasks anew every four levels."""
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "blocks"))).alias("s")).select(F.lit(0).cast("long").alias("node"), F.expr("transform(s, x -> named_struct('q', x.blocks, 'first', 0L))").alias("q"))
    for level in range(int(math.log2(shards))):
        if level and level % 4 == 0:
            node = node.repartition("node")
        uniform = f"((shiftrightunsigned(xxhash64({seed}L, {level}L, node, size(st.out), @I), 11) + 0.5D) / 9007199254740992D)"
        draw = _draw("st.pop", "x.q", "st.n", uniform)
        node = node.selectExpr("node", "q", "aggregate(q, 0L, (a, x) -> a + x.q) AS total")
        node = node.selectExpr(
            "node", "q",
            f"aggregate(q, named_struct('pop', total, 'n', total div 2, 'out', CAST(array() AS ARRAY<BIGINT>)), (st, x) -> aggregate(array({draw}), st, "
            "(b, d) -> named_struct('pop', st.pop - x.q, 'n', st.n - d, 'out', array_append(st.out, d))), st -> st.out) AS l",
        )
        node = node.selectExpr(
            "inline(array(named_struct('node', node * 2, 'q', zip_with(q, l, (a, b) -> named_struct('q', b, 'first', a.first))), "
            "named_struct('node', node * 2 + 1, 'q', zip_with(q, l, (a, b) -> named_struct('q', a.q - b, 'first', a.first + b)))))"
        )
    leaf = node.selectExpr("node AS shard", "posexplode(q) AS (rank, part)")
    return leaf.select(F.col("rank").cast("long"), "shard", F.col("part.first"), F.col("part.q").alias("quota"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, block_words: int = 1024, shard_words: int = 1 << 22, bucket_rows: int = 1024, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). documents: __file, __at (the row's key), doc_id, source, size, source_size, target.
    pieces: __file, __at, doc_id, copy (0 or 1), first_word, n_words, block, shard, pos (the piece's place in its shard)."""
    docs = keyed(docs, "mixing-keyed")
    with Scratch(docs.sparkSession) as s:
        slim, total = _sized(s, docs, bucket_rows, seed)
        t = s.keep(targets(slim, weights=weights, share=share, limit=limit), "mixing-targets")
        quota_words = F.least(F.round("target").cast("long"), (F.col("source_size") * limit).cast("long"))
        t = t.withColumn("take", quota_words).withColumn("blocks", F.ceil(F.col("take") / block_words).cast("long"))
        shards = 1 << max(0, math.ceil(math.log2(max(1.0, total * share / shard_words))))
        sums = slim.groupBy("skey", "bucket").agg(F.sum("size").alias("in_bucket")).withColumn("range", F.expr(f"bucket div {RANGE}"))
        upto = W.rowsBetween(W.unboundedPreceding, -1)
        ranges = sums.groupBy("skey", "range").agg(F.sum("in_bucket").alias("in_range"))
        ranges = ranges.select("skey", "range", F.coalesce(F.sum("in_range").over(upto.partitionBy("skey").orderBy("range")), F.lit(0)).alias("before"))
        sums = sums.withColumn("ahead", F.coalesce(F.sum("in_bucket").over(upto.partitionBy("skey", "range").orderBy("bucket")), F.lit(0)))
        sums = sums.join(ranges, ["skey", "range"]).select("skey", "bucket", (F.col("ahead") + F.col("before")).alias("ahead")).join(t, "skey")
        inside = W.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size", *KEY)
        placed = slim.withColumn("upto", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        placed = placed.join(sums, ["skey", "bucket"]).withColumn("at", F.col("ahead") + F.col("upto") - F.col("size"))
        placed = s.keep(placed.select(*KEY, "doc_id", "source", "size", "source_size", "target", "rank", "take", "blocks", "at"), "mixing-placed")
        copies = math.ceil(limit)
        cuts = placed.where("size > 0").select(*KEY, "doc_id", "rank", "take", "blocks", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), (F.col("at") + F.col("copy") * F.col("source_size")).alias("a"), "size")
        cuts = cuts.withColumn("z", F.least(F.col("a") + F.col("size"), F.col("take"))).where("z > a")
        pieces = cuts.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block_words), F.floor((F.col("z") - 1) / block_words))))
        lo, hi = F.greatest("a", F.col("block") * block_words), F.least("z", (F.col("block") + 1) * block_words)
        step = lambda x, blocks: F.floor(F.col(x) / F.ceil(F.col(blocks) / shards)).cast("long")  # noqa: E731  about one step for each shard
        # the permuted sequence: a block's place in it
        pieces = pieces.withColumn("nth", F.expr(f"pmod(pmod(block * {PRIME}L, blocks) + pmod(xxhash64({seed}L, rank), blocks), blocks)"))
        pieces = pieces.select(*KEY, "doc_id", "rank", "copy", "block", (lo - F.col("a")).alias("first_word"), (hi - lo).alias("n_words"), "nth", step("nth", "blocks").alias("step"))
        drawn = split_tree(t.select("rank", "blocks"), shards, seed).where("quota > 0").join(t.select("rank", "blocks"), "rank").withColumn("last", F.col("first") + F.col("quota") - 1)
        drawn = s.keep(drawn.select("rank", "shard", "first", "last", F.explode(F.sequence(step("first", "blocks"), step("last", "blocks"))).alias("step")), "mixing-drawn")
        pieces = pieces.join(drawn, ["rank", "step"]).where("first <= nth and nth <= last").drop("first", "last", "step", "nth")
        local = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "rank", "block"), "rank", "block", *KEY, "copy")
        return placed, pieces.withColumn("pos", F.row_number().over(local)).drop("rank")


def digest(mixed: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The contract's columns of op4."""
    placed, pieces = mixed
    taken = pieces.groupBy(*KEY).agg(F.sum("n_words").alias("taken"))
    return placed.join(taken, [*KEY], "left").select("doc_id", F.col("size").cast("long"), F.col("source_size").cast("long"), F.col("target").cast("double"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of docs: a row for each document and copy, cut to its first words where the target
    ends inside it, dealt to shards and in the shards' order. n_chars, if there, follows a cut."""
    cols = [c for c in docs.columns if c not in KEY]
    rows = keyed(docs, "mixing-rows")
    placed, pieces = mix(rows, **options)
    plan = pieces.groupBy(*KEY, "copy").agg(F.sum("n_words").alias("words"), F.min_by(F.struct("shard", "pos"), "first_word").alias("to"))
    plan = plan.join(placed.select(*KEY, "size"), [*KEY]).select(*KEY, F.col("size").alias("__size"), F.col("words").alias("__p_words"), F.col("to").alias("__p_to"))
    out = rows.join(plan, [*KEY])
    head = F.array_join(F.slice(F.expr(r"regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0)"), 1, F.col("__p_words").cast("int")), "")
    out = out.withColumn("text", F.when(F.col("__p_words") < F.col("__size"), head).otherwise(F.col("text")))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(F.col("__p_words") < F.col("__size"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.repartition("__p_to.shard").sortWithinPartitions("__p_to").select(*cols)
