"""Text files, EPUB archives and HTML pages."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from booktext_spark.sources import epub, files

XHTML = 'xmlns="http://www.w3.org/1999/xhtml"'
CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="inner/pack.opf"/></rootfiles></container>'
OPF = """<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>山の手帖</dc:title><dc:language>ja</dc:language></metadata>
<manifest><item id="two" href="text/two.xhtml" media-type="application/xhtml+xml"/><item id="one" href="text/one.xhtml" media-type="application/xhtml+xml"/>
<item id="toc" href="toc.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="front" href="front.png" media-type="image/png" properties="cover-image"/></manifest>
<spine><itemref idref="one"/><itemref idref="two"/><itemref idref="toc" linear="no"/></spine></package>"""
ONE = f'<html {XHTML}><head><title>unseen</title></head><body><h2>峠</h2><p>朝の<ruby>霧<rt>きり</rt></ruby>が<br/>晴れた<script>x</script>。</p></body></html>'
TWO = f'<html {XHTML}><body><h2>沢</h2><p>水は <a href="one.xhtml#up">前の頁</a><img src="../front.png" alt="橋"/></p></body></html>'
TOC = f'<html {XHTML}><body><nav><a href="text/one.xhtml">峠</a><a href="text/two.xhtml#down">沢<br/>の道</a><a href="text/lost.xhtml">x</a></nav></body></html>'


def archive(extra=None, **changed):
    parts = {"META-INF/container.xml": CONTAINER, "inner/pack.opf": OPF, "inner/text/one.xhtml": ONE, "inner/text/two.xhtml": TWO, "inner/toc.xhtml": TOC, "inner/front.png": b"\x89PNG"} | (extra or {}) | changed
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def parsed(body, **limits):
    return epub.parse_book(archive({"inner/text/one.xhtml": f"<html {XHTML}>{body}</html>"}))["sections"][0]["blocks"]


def test_epub_tables(spark):
    df = spark.createDataFrame([("hike.epub", archive())], "path string, content binary")
    t = epub.read_epub(df)
    assert [(r.title, r.language) for r in t["books"].collect()] == [("山の手帖", "ja")]
    assert [r.title for r in t["sections"].orderBy("ordinal").collect()] == ["峠", "沢"]
    blocks = t["blocks"].orderBy("section_ordinal", "ordinal").collect()
    assert [b.source_text for b in blocks] == ["峠", "朝の霧が\n晴れた。", "沢", "水は 前の頁"]
    assert [(i.kind, i.text, i.annotation) for i in blocks[1].inlines] == [("text", "朝の", None), ("ruby", "霧", "きり"), ("text", "が", None), ("line_break", "\n", None), ("text", "晴れた。", None)]
    assert [(i.kind, i.href, i.asset_path) for i in blocks[3].inlines][1:] == [("link", "one.xhtml#up", None), ("image", None, "inner/front.png")]
    assert [(r.title, r.fragment) for r in t["toc"].orderBy("toc_ordinal").collect()] == [("峠", None), ("沢\nの道", "down")]
    assert [r.is_cover for r in t["assets"].collect()] == [True]
    assert t["rejects"].count() == 0
    again = epub.read_epub(df)["blocks"].select("stable_id").collect()
    assert {r.stable_id for r in again} == {b.stable_id for b in blocks}
    assert all(x.count() == 0 for x in epub.read_epub(df.limit(0)).values())


def test_inlines_of_a_chapter():
    inlines = lambda body: [(i["kind"], i["text"], i["annotation"]) for i in parsed(f"<body><p>{body}</p></body>")[0]["inlines"]]
    assert inlines("a<ruby><rb>b</rb><rp>(</rp><rt>c<i>d</i></rt><rp>)</rp>e<rt>f</rt></ruby><b>g<i>h</i></b>i") == [("text", "a", None), ("ruby", "be", "cd f"), ("text", "ghi", None)]
    assert inlines("x<rt>no<img src='front.png'/></rt>y<a href='http://far/'>z<br/>w<img src='q.png'/></a>") == [("text", "xy", None), ("link", "z\nw", None)]
    places = parsed("<body><p> </p><div><ul><li>p<p>q</p></li></ul></div><style>s</style><p>r</p></body>")
    assert [(b["kind"], b["source_text"], b["locator"]) for b in places] == [("list_item", "pq", "li[1]:1"), ("paragraph", "r", "p[2]:2")]
    assert [(b["source_text"], b["locator"]) for b in parsed("<head><title>t</title></head><body>only<br/>text<script>no</script></body>")] == [("only\ntext", "body:0")]
    deep = parsed(f"<body>{'<div>' * 5000}<p>{'<i>' * 3000}low{'</i>' * 3000}</p>{'</div>' * 5000}</body>")
    assert [b["source_text"] for b in deep] == ["low"]


def torn(data):
    at = data.index("朝の".encode())
    return data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]


def listed(method, uri):
    return {"META-INF/encryption.xml": f'<encryption><EncryptedData><EncryptionMethod Algorithm="{method}"/><CipherReference URI="{uri}"/></EncryptedData></encryption>'}


@pytest.mark.parametrize(
    ("data", "code"),
    [
        (b"these bytes are no archive", "UNSUPPORTED_FORMAT"),
        (None, "UNSUPPORTED_FORMAT"),
        (torn(archive()), "UNSUPPORTED_FORMAT"),
        (archive({"inner/text/one.xhtml": "<html><body><p>open</body></html>"}), "UNSUPPORTED_FORMAT"),
        (archive({"inner/text/one.xhtml": '<?xml version="1.0" encoding="none-such"?><html/>'}), "UNSUPPORTED_FORMAT"),
        (archive({"../up": "x"}), "UNSAFE_ARCHIVE"),
        (archive({"%2e%2e/up": "x"}), "UNSAFE_ARCHIVE"),
        (archive({"in/../up": "x"}), "UNSAFE_ARCHIVE"),
        (archive({"in\\up": "x"}), "UNSAFE_ARCHIVE"),
        (archive({"/up": "x"}), "UNSAFE_ARCHIVE"),
        (archive({"inner/text/one.xhtml": '<!DOCTYPE html [<!ENTITY a "b">]><html/>'}), "UNSAFE_ARCHIVE"),
        (archive(listed("some:cipher", "inner/text/one.xhtml")), "UNSUPPORTED_DRM"),
        (archive(listed("http://www.idpf.org/2008/embedding", "inner/front.png")), "UNSUPPORTED_DRM"),
        (archive(listed("http://www.idpf.org/2008/embedding", "inner/gone.otf")), "UNSAFE_ARCHIVE"),
    ],
)
def test_bad_archives_are_rejects(spark, data, code):
    t = epub.read_epub(spark.createDataFrame([("bad.epub", data), ("good.epub", archive())], "path string, content binary"))
    assert [(r.path, r.error_code) for r in t["rejects"].collect()] == [("bad.epub", code)]
    assert t["books"].count() == 1


def test_limits():
    with pytest.raises(epub.Rejected) as e:
        epub.parse_book(archive(), limits=epub.EpubLimits(total_bytes=10))
    assert e.value.code == "UNSAFE_ARCHIVE"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<head><p>no</p></head><body><p>a<p>b<br>c<ruby>x<rt>y</rt></ruby></p><div><li>d<ul><li>e</li></ul></li></div><blockquote><p>f</p></blockquote>", [("paragraph", "a"), ("paragraph", "b\ncx"), ("list_item", "de"), ("quote", "f")]),
        ("<p><ruby>a<rt>b</ruby>c</p><p>d</p>", [("paragraph", "ac"), ("paragraph", "d")]),
        ("<p><ruby>a<rp>(<rt>b<rp>)</ruby>c<p>d", [("paragraph", "ac"), ("paragraph", "d")]),
        ("<li>a<li>b<li>c</ul><p>d</p>", [("list_item", "a"), ("list_item", "b"), ("list_item", "c"), ("paragraph", "d")]),
        ("<ul><li>a<ol><li>b<li>c</ol>d<li>e</ul>f", [("list_item", "abcd"), ("list_item", "e")]),
        ("<p>a<h2>b</h2>", [("paragraph", "a"), ("heading", "b")]),
        ("<h1>a<h2>b</h2>c", [("heading", "a"), ("heading", "b")]),
        ("<div><p>a</div>b<p>c", [("paragraph", "a"), ("paragraph", "c")]),
        ("<b><p>a</b>b</p>c<p>d", [("paragraph", "ab"), ("paragraph", "d")]),
        ("<p>a<table><tr><td><p>b</td></tr></table>", [("paragraph", "a"), ("paragraph", "b")]),
        ("<p>a<script>if (x) '</p>'</script>b</p>", [("paragraph", "ab")]),
        ("<pre>a\n b</pre></p><p/><p>&lt;&eacute;", [("preformatted", "a\n b"), ("paragraph", "<é")]),
        ("", []),
        ("<p>", []),
    ],
)
def test_page_blocks(html, want):
    assert epub.page_blocks(html) == want


CASES = [
    ("plain", "\n道は細い。\n二行目も道。\n\n\n橋を渡る。\n".encode(), None, "utf-8", 2),
    ("cp932", "夏の終わりに手紙が来た。".encode("cp932"), None, "cp932", 1),
    ("bom8", b"\xef\xbb\xbf" + "あ".encode(), None, "utf-8-sig", 1),
    ("bom16", "あ".encode("utf-16"), None, "utf-16", 1),
    ("sure", "＋－×".encode("cp932"), "Shift_JIS", "cp932", 1),
]


def test_decode_and_split(spark):
    rows = [(n, d, c) for n, d, c, *_ in CASES] + [("doubt", "＋－×".encode("cp932"), None), ("torn", b"\xff\xfe\x00", None)]
    ok, rejects = files.decode_text(spark.createDataFrame(rows, "name string, content binary, confirmed_encoding string"))
    assert {r.name: r.encoding for r in ok.collect()} == {n: e for n, _, _, e, _ in CASES}
    assert {r.name: r.error_code for r in rejects.collect()} == dict.fromkeys(["doubt", "torn"], "ENCODING_CONFIRMATION_REQUIRED")
    counts = files.split_text_blocks(ok, id_col="name").groupBy("book_id").count()
    assert sorted(r["count"] for r in counts.collect()) == sorted(k for *_, k in CASES)


@pytest.mark.parametrize(("text", "want"), [("\n道は細い。\n二行目も道。\n\n\n橋を渡る。\n", None), ("a\r\n\r\nb", "a\n\nb"), ("\n\n\n", "\n\n\n\n\n\n"), ("", None), ("a\n\n\n\nb\n\nc", None)])
def test_export_gives_the_text_back(spark, text, want):
    blocks = files.split_text_blocks(spark.createDataFrame([("k", text)], "source_hash string, text string"))
    assert files.export_text(blocks).first().text == (text if want is None else want)


def test_export_uses_translations(spark):
    blocks = files.split_text_blocks(spark.createDataFrame([("k", "a\n\nb")], "source_hash string, text string"))
    ids = {r.ordinal: r.stable_id for r in blocks.collect()}
    effective = spark.createDataFrame([(ids[1], "")], "stable_id string, text string")
    assert files.export_text(blocks, effective).first().text == "a\n\n"


def test_write_parsed_twice(spark, tmp_path):
    blocks = files.split_text_blocks(spark.createDataFrame([("k", "a\n\nb")], "source_hash string, text string"))
    for _ in range(2):
        files.write_parsed({"blocks": blocks}, str(tmp_path))
    assert files.read_parsed(spark, str(tmp_path), "blocks").count() == 2


def _books(spark, *names):
    blocks = files.split_text_blocks(spark.createDataFrame([(n, f"{n} a\n\n{n} b") for n in names], "source_hash string, text string"))
    return {"sections": blocks.select("book_id", "section_id").distinct(), "blocks": blocks}


def _stored(spark, path):
    return [sorted(r.book_id for r in t.collect()) if (t := files.read_parsed(spark, path, name)) is not None else None for name in ("sections", "blocks")]


def test_a_run_that_breaks_off_between_tables_leaves_nothing(spark, tmp_path):
    path, one = str(tmp_path), _books(spark, "k", "l")
    with pytest.raises(Exception, match="broken"):
        files.write_parsed({"sections": one["sections"], "blocks": one["blocks"].withColumn("kind", F.raise_error(F.lit("broken")).cast("string"))}, path)
    assert _stored(spark, path) == [None, None]
    assert files.write_parsed(_books(spark, "k"), path) == 1
    before = _stored(spark, path)
    with pytest.raises(Exception, match="broken"):
        files.write_parsed({"sections": one["sections"], "blocks": one["blocks"].withColumn("kind", F.raise_error(F.lit("broken")).cast("string"))}, path)
    assert _stored(spark, path) == before
    assert files.write_parsed(one, path) == 2
    sections, blocks = _stored(spark, path)
    assert len(sections) == len(set(sections)) == 2 and len(blocks) == 4


def test_two_writers_leave_each_book_once_and_whole(spark, tmp_path, monkeypatch):
    path, commit, others = str(tmp_path), files._commit, [_books(spark, "l", "m")]

    def late(*args):
        if others:  # another writer is done between this one's tables and its commit
            files.write_parsed(others.pop(), path)
        return commit(*args)

    monkeypatch.setattr(files, "_commit", late)
    assert files.write_parsed(_books(spark, "k", "l"), path) == 2
    sections, blocks = _stored(spark, path)
    assert len(sections) == len(set(sections)) == 3 and len(blocks) == 6 and len(set(blocks)) == 3


def test_json_round_trip(spark):
    blocks = files.split_text_blocks(spark.createDataFrame([("k", "a\n\nb")], "source_hash string, text string")).withColumn("metadata", F.to_json("metadata"))
    books = blocks.select("book_id", F.lit("t").alias("title")).distinct()
    sections = blocks.select("book_id", "section_id", F.lit(0).alias("ordinal"), F.lit("s").alias("title")).distinct()
    assets = books.select("book_id", F.lit("p").alias("path"), F.lit(b"\x00\xff").alias("data"))
    toc = books.select("book_id", F.explode(F.array(F.struct(F.lit(1).alias("toc_ordinal"), F.lit("in it").alias("title"), F.lit(0).alias("parent")), F.struct(F.lit(0).alias("toc_ordinal"), F.lit("part").alias("title"), F.lit(None).cast("int").alias("parent")))).alias("e")).select("book_id", "e.*")
    schema = "struct<book_id:string,title:string,sections:array<struct<ordinal:int,section_id:string,title:string,blocks:array<struct<ordinal:int,stable_id:string,kind:string,source_text:string,locator:string>>>>,assets:array<struct<path:string,data:string>>,toc:array<struct<toc_ordinal:int,title:string,parent:int>>>"
    made = files.documents_to_json(books, sections, blocks.drop("metadata"), assets, toc)
    back = files.documents_from_json(made, schema)
    want = sorted((r.stable_id, r.source_text) for r in blocks.collect())
    assert sorted((r.stable_id, r.source_text) for r in back["blocks"].collect()) == want
    assert bytes(back["assets"].first().data) == b"\x00\xff"
    assert sorted(map(tuple, back["toc"].drop("book_id").collect())) == [(0, "part", None), (1, "in it", 0)]
    assert back["books"].columns == ["book_id", "title"]


def test_read_books(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("x")
    (tmp_path / "b.doc").write_text("x")
    ok, rejects = files.read_books(spark, str(tmp_path))
    assert [r.extension for r in ok.collect()] == ["txt"]
    assert [r.error_code for r in rejects.collect()] == ["UNSUPPORTED_FORMAT"]
