"""Archives, pages, conversations and the pipeline."""

import hashlib
import io
import os
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from packetlens.llm import chat, html_extract, queries, warc
from packetlens.llm.common import connected_components, shared_folder, stored
from tests.compare import connect, difference
from tests.llm.helpers import no_documents, odd_documents

SF = "/root/testdata/sf0.001"
PAGE = "page_id long, url string, html string, digest string, host string, template string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "h", "t") for r in rows], PAGE)


def test_archive_round_trip(spark):
    big, small = "x" * 120 + "\r\n\r\n\u00e9", "WARC/1.1\r\n\r\n"
    rows = [(3, "u3", big), (1, "u\r\n1", big), (1, "u1", big), (2, None, big), (4, "u4", small), (5, "u5", small), (None, "n", None), (6, "u6", ""), (None, "m", big)]
    path = shared_folder(spark, "archive")
    warc.write_archive(pages(spark, rows), path)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.digest) for r in warc.read_archive(spark, path).collect()), key=repr)
    size, digest = len(big.encode()), hashlib.sha256(big.encode()).hexdigest()
    assert [g for g in got if g[4] == digest] == sorted(
        [(0, "revisit", 1, size, digest), (1, "response", None, size, digest), (1, "response", None, size, digest), (2, "revisit", 1, size, digest), (3, "revisit", 1, size, digest)], key=repr
    )
    assert sum(g[1] == "response" for g in got) == 6 and len(got) == 9
    out = f"{path}/files"
    warc.export(spark, path, out)
    read = {(r.head, bytes(r.block)) for r in warc.read_warc(spark, out).collect()}
    assert len(read) == 9
    assert all(b.endswith(b"\r\n\r\n") if "revisit" in h else any(b.endswith(p) for p in (big.encode(), small.encode(), b"\r\n\r\n")) for h, b in read)
    again = warc.rebuilt(spark, path).collect()
    assert {(r.head.split(warc.END)[0] + warc.END, bytes(r.block)) for r in again} == read
    assert sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.digest) for r in again), key=repr) == got
    for h, b in read:
        assert f"\r\nContent-Length: {len(b)}{warc.END}" in h and h.startswith("WARC/1.1\r\n")
    empty = shared_folder(spark, "archive")
    warc.write_archive(pages(spark, []), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_damaged_payload_ends_the_job(spark):
    path = shared_folder(spark, "archive")
    warc.write_archive(pages(spark, [(1, "u", "y" * 200)]), path)
    rows = spark.read.parquet(f"{path}/payloads").selectExpr("digest", "cast('other' as binary) payload", "first_id", "size")
    rows.write.parquet(f"{path}/bad/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}/bad/records")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, f"{path}/bad").collect()
    with pytest.raises(Exception, match="differs from its stated length"):
        warc.rebuilt(spark, f"{path}/bad").collect()
    same_size = rows.withColumn("payload", F.expr("cast(repeat('z', 200) as binary)"))
    same_size.write.parquet(f"{path}/worse/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}/worse/records")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.rebuilt(spark, f"{path}/worse").collect()


def test_files_are_bounded_by_bytes_and_read_forward(spark, tmp_path, monkeypatch):
    """Records of all size classes, files of a few records, reads smaller than a record; damage ends the job."""
    rows = [(i, f"u{i}", chr(97 + i % 26) * (i * i * 7)) for i in range(60)]
    path, out = shared_folder(spark, "archive"), str(tmp_path / "files")
    warc.write_archive(pages(spark, rows), path)
    monkeypatch.setattr(warc, "SIZE_CLASSES", (1000, 8000))
    warc.export(spark, path, out, file_bytes=16_000)
    sizes = [f.stat().st_size for f in (tmp_path / "files").glob("part-*")]
    assert len(sizes) > 20 and max(sizes) < 16 * 1500 + 16_000 and sum(n > 16_000 for n in sizes) >= 12
    got = [(r.head, bytes(r.block)) for r in warc.read_warc(spark, out).collect()]
    assert sorted(b.split(b"\r\n\r\n", 1)[1].decode() for _, b in got) == sorted(r[2] for r in rows)
    data = b"".join(h.encode() + b + warc.END.encode() for h, b in got)
    for step in (37, 4096):
        monkeypatch.setattr(warc, "READ_BYTES", step)
        assert list(warc._parse(io.BytesIO(data))) == got and list(warc._parse(io.BytesIO(b""))) == []
    for bad in (data[:-9], data.replace(b"Content-Length", b"Content-Strength"), b"WARC/1.1\r\nno end"):
        with pytest.raises(ValueError):
            list(warc._parse(io.BytesIO(bad)))


def test_extraction_rules():
    main = lambda x, t=(): html_extract.Page(x).main_text(t)
    assert main("<nav><a>m</a></nav><article><h1>T &amp; x</h1><p>a <b>b<br><p>c\n d<script>if(a<b){'</p>'}</script><footer>f</footer></article><p>out") == "T & x\na b\nc d"
    assert main("<body class='has-sidebar'><div id=sidebar>s</div><div>one<div class='x ad'>no</div>two</div><!-- <p>c --><p>3") == "one\ntwo\n3"
    assert main("<main><ul><li>a<li>b</ul><form>q</form><div class=comments><article>c</article></div></main>") == "a\nb"
    assert main("a < b <i>c</i> &lt;p&gt; <a title='x>y'>d</a> <") == "a < b c <p> d <"
    assert main("") == "" and main("<script>never ends") == "" and main("<p" * 50) == html_extract.Page("<p" * 50).main_text()
    deep = "<div>" * 20_000 + "x"
    assert main(deep) == "x"


def test_names_are_whole_classes():
    main = lambda x: html_extract.Page(x).main_text()
    for wrapper in ("class='content-sidebar-wrap'", "class='layout no-sidebar'", "id=page class=has-sidebar", "class=with-header", "class=sidebar", "id=header"):
        assert main(f"<div {wrapper}><main><p>a<p>b</main></div>") == "a\nb"
        assert main(f"<div {wrapper}><div><article><p>a<p>b</article></div></div>") == "a\nb"
    assert main("<article><p class='share-price'>1<p class=related-work>2<p class='no-ads'>3</article>") == "1\n2\n3"
    for name in ("site-header", "cookie_notice", "x ad-slot", "social-share-buttons", "left-sidebar", "related-posts", "main-nav"):
        assert main(f"<div class='{name}'>no</div><p>yes") == "yes"
        assert main(f"<article><div class='{name}'>no<article>no</article></div><p>yes</article>") == "yes"
    assert main("<div id=comments><div class=sidebar><article>no</article></div></div><p>yes") == "yes"
    assert main("<div class=sidebar><div id=comments><article>no</article></div></div><p>yes") == "yes"
    assert main("<div class=sidebar><article>no</article><nav><main>no</main></nav></div><main>yes</main>") == "yes"


def test_templates_are_counted_per_host(spark):
    rows = []
    for i in range(12):  # on a.com a box recurs in different articles; copies of a page are no template
        rows.append((i, f"http://a.com/{i}", f"<article><p>shared prose</p><p>text {i}</p><div>read more here</div></article>"))
        rows.append((100 + i, f"http://b.com/{i}", "<article><div>the same page</div></article>"))
        rows.append((200 + i, f"http://c{i}.com/", f"<div>read more here</div><p>own {i}</p>"))
    rows += [(None, None, None), (7, "odd url", ""), (None, "http://a.com", "<p>x</p>")]
    got = {(r.page_id, r.url): r for r in html_extract.extract(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got[3, "http://a.com/3"].text == "shared prose\ntext 3"
    assert got[103, "http://b.com/3"].text == "the same page"
    assert got[203, "http://c3.com/"].text == "read more here\nown 3"
    assert got[None, None].text == "" and got[None, None].n_chars == 0 and got[None, "http://a.com"].text == "x"
    assert html_extract.extract(pages(spark, [])).count() == 0


def test_templates_are_a_share_of_a_large_host(spark):
    rows = []
    for i in range(600):  # ten pages share a paragraph, a cell and a table; most share a menu, all a heading
        shared = "<p>quoted</p><table><tr><td>cell</td></tr></table>" if i < 10 else ""
        menu = "<div><ul><li>home</ul></div>" if i < 500 else ""
        rows.append((i, f"http://a.com/{i}", f"{menu}<h2>site</h2><p>own {i}</p>{shared}"))
        rows.append((1000 + i, f"http://b.com/{i}", f"{menu}<article><p>own {i}</p>{shared}<div>more</div></article>"))
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    want = {i: f"own {i}" + ("\nquoted\ncell" if i < 10 else "") for i in range(600)}
    assert got == want | {1000 + i: t for i, t in want.items()}


def test_chat_round_trip_and_digests(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", "a\\|<|b"), (1, 1, "assistant", "a\\|<|b"), (1, None, "system", None), (2, 5, None, "x"), (None, 1, "assistant", "y"), (2, 1, "ro\nle<|", "\\n\n<")]
    turns = spark.createDataFrame([(*r, "f", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, loss int")
    formatted = chat.format_turns(turns)
    for r in formatted.collect():
        role, text = chat.parse_turn(r.formatted)
        assert (r.conv_id, r.turn, role, text) in {(a, b, c or "", d or "") for a, b, c, d in rows}
        assert r.formatted.count("<|") == 2
    got = {r.conv_id: r for r in chat.summarise(formatted).collect()}
    want = "".join(f"{r}\n{t}\n" for r, t in [("system", ""), ("user", odd), ("assistant", "a\\|<|b"), ("assistant", "a\\|<|b")])
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[1].n_turns == 4
    assert got[1].loss_chars == 12 and got[1].loss_sha256 == hashlib.sha256(("a\\|<|b" * 2).encode()).hexdigest()
    assert got[2].loss_chars == 0 and got[None].n_turns == 1 and len(got) == 3
    assert chat.summarise(chat.format_turns(turns.limit(0))).count() == 0


def test_typed_parts(spark):
    parts = [{"type": "text", "text": "see <|image|>"}, {"type": "image", "ref": "i.png", "width": 57, "height": 28}, {"type": "audio", "ref": "a", "seconds": 2.1}, {"type": "document", "ref": "d", "pages": 2}, {"type": "text", "text": "!"}]
    text, loss, attached = chat.format_turn("assistant", parts)
    assert [(a["kind"], a["ref"], a["tokens"]) for a in attached] == [("image", "i.png", 3), ("audio", "a", 27), ("document", "d", 1024)]
    assert all(text[a["at"] :].startswith(f"<|{a['kind']}|>") for a in attached)
    assert [chat.unescape(text[a:b]) for a, b in zip(loss[::2], loss[1::2])] == ["see <|image|>", "!"]
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])
    table = spark.createDataFrame([(1, 0, "assistant", [(p["type"], p.get("text"), p.get("ref"), p.get("width"), p.get("height"), p.get("seconds"), p.get("pages")) for p in parts])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    assert chat.format_turns(table).first().attachment_tokens == 1054


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100), (300, 200), (200, 250), (None, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {200: 200, 250: 200, 300: 200}


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name]) is None


def test_pipeline_stages(spark):
    import corpus_pipeline

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    for docs in (odd_documents(spark, ["Plain words in a sentence that says nothing odd, only more of them here."] * 3), no_documents(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, SF), name)
            assert docs.columns == columns
        assert len([1 for r in docs.collect() if r.doc_id and r.doc_id >= 100]) <= 1
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    packed = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in packed.select("doc_id").collect()}
    labels = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    assert ids and not ids & labels and ids < {r.doc_id for r in documents.select("doc_id").collect()}


def test_heads_forms_and_comments():
    main = lambda x: html_extract.Page(x).main_text()
    assert main("<head><title>t</title><body><article><p>Hello</article>") == "Hello"
    assert main("<html><head><meta a=b><script>x</script><p>one</head><p>two") == "one\ntwo"
    assert main("<head><title>t</title>Hello <b>you</b>") == "Hello you" and main("<head>\n<img src=x>text") == "text"
    assert main("<main><p>mine</p><article class=comment><p>reader comment</article><article class='post'>more</article></main>") == "mine\nmore"
    assert main("<body><form id=page><nav>no</nav><div><article><h1>T</h1><p>a</article></div><p>other</form>") == "T\na"
    assert main("<article><p>a<form>q<article>no</article></form></article>") == "a"
    assert main("<form class=search><p>q</form><p>yes") == "yes"
    assert main("<article><header><h1>gone</h1></header><p>kept</article>") == "kept"
    assert main("<p>a <span class=ad>b</span> c") == "a c" and main("<p>a<button>b</button>c</p>") == "ac"


@pytest.mark.parametrize(
    "part", ["<a x=\"1", "<a '\">", "<a x='1>", "<!", "<", "<b><i></b>", "</p>", "<p \"'", "<a x=\"1>'", "&lt", "<div>", "<!--", "</b></div><i>", "<li><b>", "<script>"]
)
def test_malformed_pages_take_linear_time(part):
    for size in (1 << 16, 5 << 20):
        began = time.process_time()
        html_extract.Page(part * (size // len(part)) + "<p>end").main_text({1})
        took = time.process_time() - began
    assert took < 25


def test_quotes_as_before():
    names = lambda x: [t for t in html_extract.Page(x).main_text().split("\n") if t]
    assert names("<p a='>' b=\">\">x<p c=>y<p d='e>z") == ["x", "y", "z"]
    assert names("<p a='b\" c>x</p>'>y") == ["y"] and names("a <b c='d") == ["a <b c='d"]


def test_templates_equal_plain_counts(spark):
    """Counts per host by loops over the pages' subtrees."""
    rng, rows = random.Random(8), []
    parts = ["<nav><ul><li>home<li>news</ul></nav>", "<footer><p>about us</p></footer>", "<div><p>box</p><table><tr><td>1</table></div>", "<p>shared</p>", "<h2>head</h2>"]
    for i in range(400):
        host = "abcde"[min(4, rng.randrange(8))]
        own = f"<p>text {rng.randrange(300)}</p>"
        body = "".join(p for p in parts if rng.random() < 0.5) + (f"<article>{own}<div>more</div></article>" if host < "c" else own)
        rows.append((i, f"http://{host}.com/{i}", body))
    where, bodies = defaultdict(set), defaultdict(set)
    for i, url, source in rows:
        page = html_extract.Page(source)
        bodies[url[7]].add(page.body())
        for c in page.candidates():
            where[url[7], c].add(page.body())
    template = {(h, c[0]) for (h, c), n in where.items() if len(n) >= 10 and len(n) >= (0.5 if c[1] else 0.05) * len(bodies[h])}
    want = {i: html_extract.Page(s).main_text({t for h, t in template if h == url[7]}) for i, url, s in rows}
    assert {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()} == want
    removed = [sum(html_extract.Page(s).template_blocks({t for h, t in template if h == url[7]})) for i, url, s in rows]
    assert sum(removed) > len(rows)


def test_split_parts_form_no_control_string():
    rng = random.Random(4)
    for _ in range(3_000):
        texts = ["".join(rng.choice(["<", "|", "\\", "im_end", "|>", "<|im_start|>", "\n", "a"]) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 6))]
        text, loss, _ = chat.format_turn("assistant", [{"type": "text", "text": t} for t in texts])
        assert text.count("<|") == 2
        assert [chat.unescape(text[a:b]) for a, b in zip(loss[::2], loss[1::2])] == texts
        assert chat.parse_turn(text) == ("assistant", "".join(texts))
