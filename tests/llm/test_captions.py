"""Captions of figures as pages have them."""

import hashlib

import pytest

from bytelens.llm import media

PAGES = {
    "caption first": ("<figure><figcaption>c</figcaption><img src=a></figure>t", [("media", "c"), ("text", "t")]),
    "several media": ("<figure><img src=a><video src=b></video><figcaption>c <b>d</b></figcaption></figure>", [("media", "c d"), ("media", "c d")]),
    "no media": ("x<figure><figcaption>c</figcaption><pre>code</pre></figure>t<img src=a>", [("text", "x"), ("text", "c"), ("text", "code"), ("text", "t"), ("media", None)]),
    "open at the figure's end": ("<figure><img src=a><figcaption>c</figure><p>one</p>two", [("media", "c"), ("text", "one"), ("text", "two")]),
    "open at the page's end": ("<figure><figcaption>c<p>one</p><p>two", [("text", "c one two")]),
    "figure open at the page's end": ("<figure><img src=a><figcaption>c</figcaption>t", [("media", "c"), ("text", "t")]),
    "without a figure": ("<img src=a><figcaption>c</figcaption>t", [("media", None), ("text", "c"), ("text", "t")]),
    "of another figure": ("<figure><img src=a></figure><figure><figcaption>c</figcaption></figure>", [("media", None), ("text", "c")]),
    "nested": ("<figure><figure><img src=a><figcaption>c</figcaption></figure><figure><img src=b></figure><figcaption>d</figcaption></figure>", [("media", "c"), ("media", "d")]),
    "two captions, empty one": ("<figure><img src=a alt=x><figcaption>c</figcaption><figcaption>d</figcaption></figure><figure><img src=b alt=y><figcaption> </figcaption></figure>", [("media", "c d"), ("media", "y")]),
    "end tags without starts": ("a</figcaption>b</figure>c", [("text", "a"), ("text", "b"), ("text", "c")]),
}


@pytest.mark.parametrize("name", PAGES)
def test_captions(name):
    page, want = PAGES[name]
    got = media.parse_html(page)
    assert [(s["kind"], s["caption"] if s["kind"] == "media" else s["text"]) for s in got] == want
    assert [s["pos"] for s in got] == list(range(len(got)))


def test_ids_with_markup(spark):
    """Ids are text in the page; a row of documents has one medium, whatever its id holds."""
    ids = ['<img src="sha256:00">', "a&amp;b", "</figure><p>", None, "x", "x"]
    docs = spark.createDataFrame([(i, "same" if i == "x" else "text of " + str(i), "clash") for i in ids], "doc_id string, text string, html string")
    got = media.digest(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, ids)) and all(r.payload_bytes for r in got)
    pages, store = media.text_media(docs)
    seen = media.interleave(pages, key="doc_id").collect()
    assert sorted(str(r.segments[0].caption) for r in seen) == sorted("None" if i is None else "document " + " ".join(i.split()) for i in ids)
    assert all(len(r.segments) == 1 for r in seen)
    assert media.digest(docs.limit(0)).count() == 0


def test_another_decoder_reads_the_media(spark, tmp_path):
    """Spark's own image reader gives back the samples that a text was stored as, a text of over 1 MiB included."""
    texts = ["", "é", "x" * 64, "y" * 65, "long text " * 150_000]
    _, store = media.text_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in store.collect():
        (tmp_path / f"{r.digest}.png").write_bytes(r.media)
    read = spark.read.format("image").load(f"file://{tmp_path}").select("image.origin", "image.width", "image.height", "image.nChannels", "image.data").collect()
    got = {r.origin[-68:-4]: bytes(r.data) for r in read}
    want = {hashlib.sha256(p).hexdigest(): p for p in (media.payload_of(x.encode()) for x in texts)}
    assert got == want and all(r.nChannels == 1 and r.width == media.WIDTH for r in read)
