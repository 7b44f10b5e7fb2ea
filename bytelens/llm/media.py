"""Media columns: interleaved document sequences. HTML is parsed into an ordered array of text and media-reference
structs; a join on the digest resolves the payloads; positions and captions stay aligned.

Media are 8-bit gray PNG images, 64 samples wide, holding any bytes without loss. The store keeps a medium
once for each task that meets it; reading back, a task decodes the media where they lie, and the small
facts found (not the bytes) meet by digest, once each, and are joined to the references. Null pages are empty; references that the store doesn't know keep null facts.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bytelens.llm import textcore as tc
from bytelens.runtime import materialize, ship

WIDTH = 64
SEGMENT = "struct<pos:int,kind:string,text:string,src:string,digest:string,caption:string>"
_SEGMENT = pa.struct([("pos", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "src", "digest", "caption"))])
_SKIP, _BREAK = {"script", "style", "template", "noscript", "title"}, {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "br", "section", "article", "header", "footer", "nav", "figure", "blockquote", "pre", "table"}
_MEDIA = {"img", "video", "audio", "source"}


def payload_of(text: bytes) -> bytes:
    """The text padded with zero bytes to a positive multiple of WIDTH."""
    return text + b"\0" * (WIDTH - len(text) % WIDTH if len(text) % WIDTH or not text else 0)


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _part(b"IHDR", head) + _part(b"IDAT", zlib.compress(rows.tobytes(), level)) + _part(b"IEND", b"")


def decode_png(png: bytes) -> bytes:
    """The samples of an image that encode_png made; checks its checksums."""
    at, data, size = 8, [], (0, 0)
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged image")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    return rows[:, 1:].tobytes()


def facts_of(png: bytes) -> tuple[int, str, int, int, str, str]:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; all from the stored bytes."""
    payload = decode_png(png)
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    bits = -(share[share > 0] * np.log2(share[share > 0])).sum()
    feature = f"gray8 {WIDTH}x{len(x) // WIDTH} mean={x.mean():.4f} zero={share[0]:.4f} bits={bits:.4f} max={x.max()}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), feature


class _Parser(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figures: list[dict] = []  # open ones, the innermost last: media, captions, whether the last caption is open

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.out.append({"pos": len(self.out), "kind": "text", "text": text, "src": None, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.hidden += 1
        elif tag in _MEDIA and not self.hidden:
            a = dict(attrs)
            if a.get("src"):
                self.flush()
                src = a["src"]
                ref = {"pos": len(self.out), "kind": "media", "text": None, "src": src, "digest": src[7:] if src.startswith("sha256:") else None, "caption": a.get("alt") or None}
                self.out.append(ref)
                if self.figures:
                    self.figures[-1]["media"].append(ref)
        elif tag == "figcaption":
            self.flush()
            if self.figures:  # elsewhere its text is text
                place = {"pos": len(self.out), "kind": "caption", "text": [], "src": None, "digest": None, "caption": None}
                self.out.append(place)
                self.figures[-1]["captions"].append(place)
                self.figures[-1]["open"] = True
        elif tag in _BREAK:
            self.flush()
            if tag == "figure":
                self.figures.append({"media": [], "captions": [], "open": False})
            elif self.in_caption():
                self.handle_data(" ")

    def in_caption(self) -> bool:
        return bool(self.figures) and self.figures[-1]["open"]

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.flush()
            if self.figures:
                self.figures[-1]["open"] = False
        elif tag in _BREAK:
            self.flush()
            if tag == "figure" and self.figures:
                self.end_figure()
            elif self.in_caption():
                self.handle_data(" ")

    def end_figure(self) -> None:
        """The innermost figure's caption goes to all its media; without media it stays where it was, as text. Media
        of a figure without a caption belong to the figure around it too."""
        figure = self.figures.pop()
        for place in figure["captions"]:
            place["text"] = " ".join("".join(place["text"]).split())
        caption = " ".join(place["text"] for place in figure["captions"] if place["text"])
        if caption and figure["media"]:
            for ref in figure["media"]:
                ref["caption"] = caption
        else:
            for place in figure["captions"]:
                place["kind"] = "text" if place["text"] else "caption"
            if self.figures:
                self.figures[-1]["media"] += figure["media"]

    def segments(self) -> list[dict]:
        self.flush()
        while self.figures:
            self.end_figure()
        self.out = [s for s in self.out if s["kind"] != "caption"]
        for pos, s in enumerate(self.out):
            s["pos"] = pos
        return self.out

    def handle_data(self, data):
        if not self.hidden:
            (self.figures[-1]["captions"][-1]["text"] if self.in_caption() else self.text).append(data)


def parse_html(html: str | None) -> list[dict]:
    """Ordered segments of a page: pos, kind (text or media), text, src, digest (of sha256: references), caption."""
    p = _Parser()
    p.feed(html or "")
    p.close()
    return p.segments()


def interleave(pages: DataFrame, *, html: str = "html", key: str = "page_id") -> DataFrame:
    """key, segments: the ordered segments of each row's page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(html)
            _, offs = tc.text_bytes(col)
            for lo, hi in tc.chunks(offs):
                segments = [parse_html(x) for x in col.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(lo, hi - lo), pa.array(segments, pa.list_(_SEGMENT))], names=[key, "segments"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, segments array<{SEGMENT}>")


def media_facts(media: DataFrame) -> DataFrame:
    """digest and facts of each distinct digest of media(digest, media); rows of one digest hold equal media."""
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *facts_of(png.as_py())) for d, png in zip(batch.column("digest").to_pylist(), batch.column("media"), strict=True)]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(run, kind).dropDuplicates(["digest"])


def resolve(interleaved: DataFrame, media: DataFrame, *, key: str = "page_id") -> DataFrame:
    """A row for each media reference: key, pos, caption, digest and its facts (null where unknown)."""
    refs = interleaved.select(key, F.explode("segments").alias("s")).where("s.kind = 'media'").select(key, "s.pos", "s.caption", "s.digest")
    return refs.join(media_facts(media), "digest", "left")


def _page(digest: str, own) -> str:
    caption = "" if own is None else f"<figcaption>document {escape(str(own))}</figcaption>"
    return f'<figure><img src="sha256:{digest}">{caption}</figure>'


def text_media(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, store): each text stored as a medium, and a page that refers to it. pages: doc_id, n_bytes, html.
    The store is written to the shared folder and read back.

    A page for each row: repeated rows, and ids that repeat or are null, have pages of their own; null ids have no caption. Ids are escaped,
    so markup in them is text. Null texts are empty, and an empty text is a medium of one line of zeros. A long text is one medium. Columns other than
    doc_id and text are not read. An empty table gives no pages and no media."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            data, offs = tc.text_bytes(batch.column("text"))
            for lo, hi in tc.chunks(offs):
                n, digests, media = [], [], []
                for i in range(lo, hi):
                    text = data[offs[i] : offs[i + 1]].tobytes()
                    payload = payload_of(text)
                    d = hashlib.sha256(payload)
                    n.append(len(text))
                    digests.append(d.hexdigest())
                    media.append(None if d.digest() in seen else encode_png(payload))
                    if len(seen) < 100_000:
                        seen.add(d.digest())
                ids = batch.column("doc_id").slice(lo, hi - lo)
                html = [_page(d, x) for d, x in zip(digests, ids.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(html), pa.array(digests), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "html", "digest", "media"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    store = materialize(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_kind}, n_bytes long, html string, digest string, media binary"), "media-store")
    return store.select("doc_id", "n_bytes", "html"), store.where("media is not null").select("digest", "media")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of op10: texts stored, referred to from pages, parsed and resolved."""
    pages, store = text_media(docs)
    found = resolve(interleave(pages.withColumn("key", F.struct("doc_id", "n_bytes")), key="key"), store, key="key")
    return found.select("key.doc_id", "key.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
