"""Search lists that are too long to send at once go out in blocks: each block's hits are written by row key, and merged once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from bytelens.runtime import KEY, file_keys, keyed, materialize

#: Rows of merged hits up to which they are broadcast to the documents; about 100 bytes each.
BROADCAST = 1 << 16


def with_keys(docs: DataFrame) -> DataFrame:
    """docs with __file and __at: those it has, those of the files it is read from, or, written once, some of its own."""
    return keyed(docs if set(KEY) <= set(docs.columns) else file_keys(docs), "blocks-keyed")


def merged(docs: DataFrame, hits: Iterator[DataFrame], **merge: Callable[[Column], Column]) -> DataFrame:
    """The rows of docs (with KEY) and a column for each of merge: what it makes of the arrays of that name that hits (KEY and arrays, rows
    of documents with hits only) have for the row, joined end to end; an empty array for rows without any."""
    found = None
    for h in hits:
        h = materialize(h, "block-hits")
        found = h if found is None else found.unionByName(h)
    all_of = found.groupBy(*KEY).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in merge])  # a row's hits in all blocks
    all_of = materialize(all_of.select(*KEY, *[f(F.col(c)).alias(c) for c, f in merge.items()]), "merged-hits")
    if all_of.count() <= BROADCAST:
        all_of = F.broadcast(all_of)
    out = docs.join(all_of, [*KEY], "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in merge})
