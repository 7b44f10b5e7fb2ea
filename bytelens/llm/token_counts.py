"""Token counts: pieces are counted once per distinct pre-token, joined to the documents' pre-token
frequencies and summed; ids are never made.

A task cuts each batch into pre-tokens, numbers the distinct ones, asks the tokenizer for the number of
pieces of those it has not met before, and sums counts times frequencies by document (the join is a gather
by number). Its table of counts is dropped when it reaches table_limit entries, which costs time only.

Pre-tokens come from the tokenizer's own rules. Texts whose characters are all below U+0300 (but for
U+0130) are lower-cased by Python, which is what the library's normalizer does to them; any other text goes
through the library's normalizer. Added tokens inside a text count one each, and what stands between two of
them is cut separately, as the library does. Null is the empty text, of no tokens.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from bytelens.llm import textcore as tc
from bytelens.runtime import ship

_loaded: dict[str, "Counter_"] = {}


class Counter_:
    """Counts a tokenizer file's tokens in texts."""

    def __init__(self, path: str, table_limit: int):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        split = next(p for p in rules["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        assert split["behavior"] == "Removed" and split["invert"], "a tokenizer that keeps matches as pre-tokens"
        assert [n["type"] for n in rules["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.cut = regex.compile(split["pattern"]["Regex"]).findall
        self.added = regex.compile("|".join(regex.escape(a["content"]) for a in rules["added_tokens"]))
        self.odd = regex.compile("[^\x00-įı-˿]").search
        self.normal = self.tok.normalizer.normalize_str
        self.limit, self.pieces = table_limit, {}

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        parts, n = [text], 0
        if "<|" in text:
            parts = self.added.split(text)
            n = len(parts) - 1
        out: list[str] = []
        for p in parts:
            out += self.cut(self.normal(p) if self.odd(p) else p.lower())
        return out, n

    def count(self, texts: list[str]) -> list[int]:
        freq, extra = [], []
        for x in texts:
            got, n = self.pre_tokens(x)
            freq.append(Counter(got))
            extra.append(n)
        new = list({w for f in freq for w in f if w not in self.pieces})
        if len(self.pieces) + len(new) > self.limit:
            self.pieces = {}
            new = list({w for f in freq for w in f})
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            self.pieces.update(zip(part, map(len, self.tok.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        get = self.pieces.__getitem__
        return [n + sum(map(int.__mul__, map(get, f), f.values())) for f, n in zip(freq, extra, strict=True)]


def count_tokens(docs: DataFrame, tokenizer_path: str, *, keep_columns: list[str] = ("doc_id",), table_limit: int = 400_000) -> DataFrame:
    """keep_columns, n_bytes (UTF-8) and n_tokens of each row's whole text. The tokenizer file is sent to the
    executors with the job.

    A row for each row: repeated rows, and null or repeated doc_ids, are counted one by one. Null and empty texts have no bytes and no tokens; a text
    of any length is counted whole; an empty table gives no rows. Columns of docs that are neither kept nor text are not read; kept ones must not be
    called n_bytes or n_tokens."""
    spark = ship(docs.sparkSession)
    with open(tokenizer_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    keep = list(keep_columns)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import os
        import tempfile

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = hashlib.sha256(sent.value).hexdigest()
        if key not in _loaded:
            with tempfile.NamedTemporaryFile(suffix=".json") as f:
                f.write(sent.value)
                f.flush()
                _loaded[key] = Counter_(f.name, table_limit)
        counter = _loaded[key]
        for batch in batches:
            text = batch.column("text")
            _, offs = tc.text_bytes(text)
            tokens: list[int] = []
            for lo, hi in tc.chunks(offs):
                tokens += counter.count([x or "" for x in text.slice(lo, hi - lo).to_pylist()])
            own = [pa.array(offs[1:] - offs[:-1], pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *own], names=[*keep, "n_bytes", "n_tokens"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def digest(counted: DataFrame, limit: int = 2048) -> DataFrame:
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
