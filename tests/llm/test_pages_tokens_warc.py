import html
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pulsegrid.llm import html_text, pieces, token_files, warc
from pulsegrid.llm.common import file_system

SF = "/root/testdata/sf0.01"


class Article(HTMLParser):
    """All text inside article elements, for pages whose main text is just that."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("p", "h1", "br", "div"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in ("p", "h1", "article"):
            self.parts.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_main_text_of_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = html_text.op2_main_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == " ".join("".join(Article(pages[r["page_id"]]).parts).split())
        assert r["n_chars"] == len(r["text"])


def test_main_text_leaves_out_boilerplate():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><header><a href=/>Site</a></header>
    <div class="cookie-notice">We use cookies. Please accept them, now.</div><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
    <div id="content"><h1>A title</h1><p>First&nbsp;line &lt;b&gt; of <b>te</b>xt, with a <a href=x>link</a>.<p>Second one,
    which goes on.<div class="ad-banner">Buy now!</div><p>Third, the last of them.<ul><li>item one<li>item two</ul></div>
    <aside><p>Other stories that you may like, all of them long.</p></aside><form><label>Mail</label><input></form>
    <section class="comments"><p>Reader: I liked this text, it was very good.</p></section><footer>&copy; x</footer><script>var a="<p>no</p>"</script></body></html>"""
    assert html_text.main_text(page, {}) == "A title First line <b> of text, with a link. Second one, which goes on. Third, the last of them. item one item two"
    assert html_text.main_text(None, {}) == "" and html_text.main_text("", {}) == "" and html_text.main_text("<p>", {}) == ""
    assert html_text.main_text("just  words &amp; more", {}) == "just words & more"


def brute_cut(content, boilerplate, edges):
    n, best = len(content), None
    for m in range(1 << n):
        keep = [bool(m >> i & 1) for i in range(n)]
        cost = sum(boilerplate[i] if keep[i] else content[i] for i in range(n)) + sum(w for a, b, w in edges if keep[a] != keep[b])
        best = cost if best is None else min(best, cost)
    return best


def test_minimum_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 8)
        content, boilerplate = [rng.randint(0, 5) for _ in range(n)], [rng.randint(0, 5) for _ in range(n)]
        edges = [(i, j, rng.randint(1, 3)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]
        keep = html_text.minimum_cut(content, boilerplate, edges)
        cost = sum(boilerplate[i] if keep[i] else content[i] for i in range(n)) + sum(w for a, b, w in edges if keep[a] != keep[b])
        assert cost == pytest.approx(brute_cut(content, boilerplate, edges))


def test_odd_pages(spark, folder_of):
    deep = "<div>" * 2000 + "deep text" + "</div>" * 2000
    long = "<article>" + "<p>word</p>" * 20000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article>a<article>b"), (4, "u", deep), (None, "u", long), (4, "u", "<!-- open"), (5, "u", "a < b > c & d &amp; <"), (6, "u", '<p class="x>y')]
    got = html_text.op2_main_text(spark, folder_of(pages=spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(got) == len(rows)
    text = {(r["page_id"], r["n_chars"]): r["text"] for r in got}
    assert ("deep text" in text.values()) and text[(None, 20000 * 5 - 1)].startswith("word word")
    assert html_text.op2_main_text(spark, folder_of(pages=spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_token_files_equal_direct_encoding(spark, documents, folder_of):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(-5, None), (-4, ""), (-3, " \t \n\n  x  y  z "), (-2, "a\n  b   c\r\n d's <|endoftext|> é😀"), (-1, "don't  \n \n stop  "), (None, "null id"), (7, "again"), (7, "again")]
    odd = frame.union(spark.createDataFrame(odd, "doc_id long, text string"))
    folder = folder_of(documents=odd)
    got = token_files.op7_token_files(spark, folder).collect()
    want = []
    for d, t in sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(str, [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got])) == sorted(map(str, want))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == [w[0] for w in want]
    assert token_files.op7_token_files(spark, folder_of(documents=odd.limit(0))).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, np.uint32), np.full(1000, 7, np.uint32), rng.integers(0, 50_000, 5_001).astype(np.uint32),
                np.where(rng.random(3_000) < 0.02, 4_000_000_000, rng.integers(100, 130, 3_000)).astype(np.uint32), np.array([2 ** 32 - 1, 0], np.uint32)):
        data, sizes = token_files.pack(ids)
        assert np.array_equal(token_files.unpack(data, sizes), ids)
    assert len(token_files.pack(np.where(np.arange(2560) % 100 == 0, 40_000, 9).astype(np.uint32))[0]) < 2560


def test_warc_equals_brute_force(spark, folder_of):
    rows = [(3, "u", "same"), (1, "u\n", "same"), (2, None, "other"), (4, "u", None), (5, "u", ""), (6, "u", "same"), (None, "u", "same"), (None, "u", "only null"),
            (9, "u", "\x1f�" * 1000), (10, "u", "x" * 3_000_000), (11, "u", "é")]
    folder = folder_of(pages=spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.op9_warc(spark, folder).collect()), key=str)
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in rows:
        b, f = (h or "").encode(), first.get(h or "")
        want.append((p, len(b), warc.base32_sha1(b), "response" if p == f else "revisit", None if p == f else f))
    assert got == sorted(want, key=str)
    assert warc.op9_warc(spark, folder_of(pages=spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_reader_owns_each_record_once(tmp_path):
    rng = random.Random(5)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(0, 400))) + b"\x1f\x8b\x08" * rng.randrange(3) for _ in range(60)]
    data = b"".join(warc.record(i, "u", p, None) for i, p in enumerate(payloads))
    (tmp_path / "a.warc.gz").write_bytes(data)
    fs, path = file_system(str(tmp_path / "a.warc.gz"))
    for split in (37, 500, 10 ** 6):
        got = [b for lo in range(0, len(data), split) for _, b in warc.read_range(fs, path, lo, lo + split)]
        assert got == payloads


def brute_best(model, text):
    """Best sum over all segmentations by dynamic programming over all substrings."""
    score = {p: s for p, (_, s, _) in ((k, v) for k, v in model.automaton.items())}
    best = [0.0] + [-1e18] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 40), e):
            if text[s:e] in score:
                best[e] = max(best[e], best[s] + score[text[s:e]])
        best[e] = max(best[e], best[e - 1] + model.missing) if best[e] < -1e17 or best[e - 1] + model.missing > best[e] else best[e]
    return best[-1]


def total(model, ids):
    score = {i: s for _, (_, s, i) in ((k, v) for k, v in model.automaton.items())}
    out, k = 0.0, 0
    raw = bytearray()
    for i in ids:
        if i in model.byte_of:
            raw.append(model.byte_of[i])
        else:
            out += score[i]
    return out + model.missing * len(raw.decode()) + 0 * k


def test_pieces_are_best_and_round_trip(spark, documents):
    model = pieces.Pieces(pieces.default_model())
    assert model.splits
    texts = ["Hello world", "  two  blanks \n and a line ", "éèê ñ ß 日本語 😀", "Thtionheer ereing", "a" * 300, "x\ty z", "</s> <unk> <0x41>"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(12).collect() if r["text"]]
    for t in texts:
        ids = model.encode(t)
        marked = pieces.MARK + t.replace(" ", pieces.MARK)
        assert model.decode(ids) == t
        assert total(model, ids) == pytest.approx(brute_best(model, marked))
        model.splits = False
        assert total(model, model.encode(t)) == pytest.approx(total(model, ids)) and model.encode(t) == ids
        model.splits = True
    rows = documents([None, "", "one▁two", "a b", "a b"]).withColumn("piece_ids", __import__("pyspark.sql.functions").sql.functions.lit(1))
    out = pieces.with_pieces(rows, pieces.default_model())
    assert out.columns[-1] == "piece_ids_" and [len(r["piece_ids_"]) for r in out.orderBy("doc_id").collect()][:2] == [0, 0]
    back = out.select(pieces.decode_column(out["piece_ids_"], pieces.default_model()).alias("t")).collect()
    assert [r["t"] for r in back][2] == "one two"
    assert pieces.with_pieces(documents([]), pieces.default_model()).count() == 0


def test_piece_query_round_trips(spark):
    rows = pieces.op4_piece_encoding(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r["round_trip"] for r in rows) and len(rows) == len(texts)
    model = pieces.pieces(pieces.default_model())
    for r in rows:
        assert len(r["piece_ids"]) == r["n_pieces"] and zlib.crc32(np.array(r["piece_ids"], "<u4").tobytes()) == r["ids_crc32"]
        assert model.decode(r["piece_ids"]) == texts[r["doc_id"]]


def test_warc_headers_of_any_length(spark, folder_of):
    url = "data:image/png;base64," + "".join(random.Random(7).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=400_000))
    rows = [(1, url, "same"), (2, "u", "same"), (3, url, "other")]
    got = warc.op9_warc(spark, folder_of(pages=spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [(1, "response", None), (2, "revisit", 1), (3, "response", None)]


def test_pieces_leave_in_short_batches():
    """Ids of few texts are held at a time, and a worker keeps few enough words for its share of an executor."""
    sizes = [len(b) for b in pieces.slices(iter([pd.Series(range(1201)), pd.Series([], dtype=object), pd.Series([7])]))]
    assert sizes == [500, 500, 201, 1] and pieces.MEMORY <= 150_000


def test_new_stretches_of_many_texts_go_side_by_side(monkeypatch):
    model, plain = pieces.Pieces(pieces.default_model()), pieces.Pieces(pieces.default_model())
    words = ["thingorou", "are.\nAnly", "Équeé", "x", "▁", "漢字", "😀é", "\0", "0000", "aaaaaaaaaaaa", "b" * 64, "c" * 70, "", "tion,", "\n\n\t", "ñç", "􏿿"]
    texts = [None, "", " ", *words, *(f"{a} {b}  {a}{b}" for a in words for b in words)]
    assert model.encode_texts([]) == []
    want = [np.array(plain.best(pieces.MARK + t.replace(" ", pieces.MARK)), "<u4").tobytes() if t else b"" for t in texts]
    assert model.encode_texts(texts) == want and model.encode_texts(texts) == want  # what a worker keeps changes nothing
    model.table.column[[ord("e"), ord("漢")]] = pieces.Table.RARE  # no column: the other way, to the same ids
    model.memory.clear()
    assert model.encode_texts(texts) == want

    def one_by_one(text):
        raise AssertionError(text)

    model = pieces.Pieces(pieces.default_model())
    monkeypatch.setattr(model, "best", one_by_one)
    short = ["thingorou are.\nAnly Équeé 😀é 漢字"]
    assert model.encode_texts(short) == [plain.encode_bytes(short[0])]
