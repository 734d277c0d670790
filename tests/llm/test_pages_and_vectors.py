"""WARC archives, page text, posting lists and the pipeline."""

import gzip
import hashlib
import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewise.llm import mixing, packing, page_diff, postings, simhash, warc

SF = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string"
BIG = "<p>" + "many words " * 200 + "</p>"


# WARC.


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, "small"), (4, "http://a/\n4", "small"),
            (5, "http://a/5", None), (None, "http://a/6", BIG), (7, "http://a/7", "é" * 200_000), (2, "http://a/2", BIG)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit("x"))
    got = warc.round_trip(pages).orderBy("record_id").collect()
    assert len(got) == len(rows)
    for r in got:
        id = r.record_id.removeprefix("urn:page:")
        html = next(h for i, _, h in rows if str(i or "null") == id) or ""
        assert r.payload_sha1 == hashlib.sha1(html.encode()).hexdigest()
        assert r.payload_length == len(html.encode())
        copy = html == BIG and id != "2"
        assert r.record_type == ("revisit" if copy else "response")
        assert r.refers_to == ("urn:page:2" if copy else None)
        assert bytes(r.payload) == (b"" if copy else html.encode())


def test_warc_files_are_plain_gzip_and_filters_skip_payloads(spark, tmp_path):
    warc.register(spark)
    folder = str(tmp_path / "archive")
    pages = spark.createDataFrame([(i, f"http://a/{i}", BIG if i % 2 else str(i)) for i in range(40)], PAGES)
    warc.page_records(pages).repartition(3).write.format("warc").mode("append").save(folder)
    (tmp_path / "archive" / "_left-by-a-lost-task").write_bytes(b"broken")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "archive").glob("part*"))
    assert data.count(b"WARC/1.1\r\n") == 40
    read = spark.read.format("warc").load(folder)
    assert read.filter("record_type = 'revisit'").count() == 19
    assert read.filter("record_type IN ('response') AND target_uri = 'http://a/39'").count() == 1
    assert read.filter("payload_length > 1000").count() == 20
    slim = spark.read.format("warc").schema("record_id string, target_uri string").option("recordTypes", "response").load(folder)
    assert slim.count() == 21 and slim.columns == ["record_id", "target_uri"]
    assert read.filter("target_uri LIKE 'http://a/1%'").count() == 11


def test_parser_reads_foreign_records():
    row = {"record_type": "resource", "record_id": "r", "payload": b"x" * 100_000, "content_type": "text/plain"}
    one, two = warc.record_bytes(row), warc.record_bytes({**row, "record_id": "s", "payload": b""})
    everything = lambda h: True
    for data in (one + two, gzip.compress(one) + gzip.compress(two), gzip.compress(one + two),
                 warc.gzip_member(one) + warc.gzip_member(two)):
        got = list(warc.records(io.BytesIO(data), len(data), everything, True))
        assert [(h["warc-record-id"], len(b)) for h, b in got] == [("<r>", 100_000), ("<s>", 0)]
        got = list(warc.records(io.BytesIO(data), len(data), lambda h: h["warc-record-id"] == "<s>", False))
        assert [b for _, b in got] == [None]
    assert not list(warc.records(io.BytesIO(b""), 0, everything, True))


@pytest.mark.parametrize("kind", ["plain", "gzip", "member", "one member"])
@pytest.mark.parametrize("payload", [True, False])
def test_cut_off_records_are_not_handed_out(kind, payload):
    rnd = np.random.default_rng(2)
    row = {"record_type": "resource", "record_id": "r", "payload": rnd.bytes(100_000), "content_type": "text/plain"}
    one, two = warc.record_bytes(row), warc.record_bytes({**row, "record_id": "s"})
    pack = {"plain": lambda x: x, "gzip": gzip.compress, "member": warc.gzip_member}
    data = gzip.compress(one + two) if kind == "one member" else b"".join(map(pack[kind], (one, two)))
    assert len(list(warc.records(io.BytesIO(data), len(data), lambda h: True, payload))) == 2
    for end in (len(data) - 40_000, len(data) - 99_900, len(data) - len(pack.get(kind, len)(two)) + 30 if kind != "one member" else 150_000):
        got = []
        with pytest.raises(warc.CutOff):
            for headers, body in warc.records(io.BytesIO(data[:end]), end, lambda h: True, payload):
                got.append((headers["warc-record-id"], body and len(body)))
        assert got == [("<r>", 100_000 if payload else None)]


def test_cut_off_files_fail_or_are_read_as_far(spark, tmp_path):
    warc.register(spark)
    row = {"record_type": "resource", "record_id": "r", "payload": b"x" * 5000, "content_type": "text/plain"}
    (tmp_path / "a.warc").write_bytes(warc.record_bytes(row) + warc.record_bytes({**row, "record_id": "s"})[:-1000])
    read = spark.read.format("warc")
    with pytest.raises(Exception, match="ends inside a record"):
        read.load(str(tmp_path)).collect()
    assert [r.record_id for r in read.option("cutOff", "skip").load(str(tmp_path)).collect()] == ["r"]


# Page text.


def kept_lines(html):
    lines, kinds = page_diff.lines_of(html)
    return [x for x, k in zip(lines, kinds) if k != page_diff.FURNITURE]


def test_structure():
    html = """<html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li>menu<li>more</ul></nav><div class="ad box">buy</div><article class=post><h1>A &amp; B</h1>
    <p>one <b>two</b>three<br>four <!-- <p>gone --> &copy; &am<aside>side</aside><p hidden>secret
    <span>x</span></p><form>f</form><section id="comments"><p>nice</p></section></article><footer>end</footer>"""
    lines, kinds = page_diff.lines_of(html)
    assert [x for x, k in zip(lines, kinds) if k == page_diff.ARTICLE] == ["A & B", "one twothree", "four © &am"]
    assert [x for x, k in zip(lines, kinds) if k == page_diff.FURNITURE] == [
        "menu", "more", "buy", "side", "secret x", "f", "nice", "end"]
    assert len(lines) == 11
    assert page_diff.lines_of(None) == ([], []) and page_diff.lines_of("") == ([], [])
    assert kept_lines("plain  text<p>and <nav>unclosed") == ["plain text", "and", "unclosed"]


def test_broken_markup():
    assert kept_lines("a<p>b <!-- <p>gone") == ["a", "b"] and kept_lines("a <!-- gone") == ["a"]
    assert kept_lines("<p title='x>one</p><p>two") == ["one", "two"]
    assert kept_lines('<p title="a > b">one<p title=\'">\'>two') == ["one", "two"]
    assert kept_lines("<div class=ad><div>x</div>y</div>z<script>never closed <p>q") == ["z"]
    assert kept_lines("<x class=ad>kept") == ["kept"] and kept_lines("1 < 2 <b>and</b> 3 > 2") == ["1 < 2 and 3 > 2"]


def test_names_that_only_hold_a_word_hide_nothing():
    html = '<article><div class="social-history"><p>main</p></div><section id="widget-theory">too</section></article>'
    assert kept_lines(html) == ["main", "too"]
    assert kept_lines("<p>Long body text</p><article>teaser</article>") == ["Long body text", "teaser"]


@pytest.mark.parametrize("part", ["<a ", '<a b="', "<a b='\"", "<!", "<!--", "</a", "<nav>", "<div class=ad><div>", "<script>",
                                  "<x class=ad>", "<article>", "<", "<a '\">", "</nav "])
@pytest.mark.parametrize("end", ["", ">", "'>", "</nav>"])
def test_any_markup_takes_linear_time(part, end):
    import time

    start = time.process_time()
    page_diff.lines_of(part * (1_000_000 // len(part)) + end)
    assert time.process_time() - start < 10


@pytest.mark.parametrize("bits", [1 << 28, 8])
def test_common_lines_are_longest(monkeypatch, bits):
    monkeypatch.setattr(page_diff, "TABLE_BITS", bits)
    rnd = np.random.default_rng(1)
    for _ in range(300):
        n, m = rnd.integers(0, 14, 2).tolist()
        a, b = rnd.integers(0, 5, n).tolist(), rnd.integers(0, 5, m).tolist()
        table = np.zeros((n + 1, m + 1), int)
        for i in range(n):
            for j in range(m):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        cut = page_diff.common_lines(a, b)
        assert len(cut) == table[n, m] and cut == sorted(set(cut))
        at = iter(b)
        assert all(a[i] in at for i in cut)  # a subsequence of b


def test_long_pages_are_aligned_in_little_time():
    import time

    start = time.process_time()
    assert len(page_diff.common_lines([1] * 20_000 + [2], [3] + [1] * 20_000)) == 20_000
    assert len(page_diff.common_lines([1, 2] * 10_000, [2, 1, 1] * 7_000)) >= 14_000
    assert time.process_time() - start < 20


@pytest.mark.parametrize("block", [512, 2])
def test_template_lines_go_and_articles_stay(spark, monkeypatch, block):
    monkeypatch.setattr(page_diff, "BLOCK", block)
    page = lambda i: f"<div>Site of things</div><div>story number {i}</div><div>call us</div>"
    rows = [(i, f"http://h/a/{i}", page(i)) for i in range(9)]
    rows += [(20, "http://h/a/1x", "<article>Site of things<p>more</article>"), (21, None, None), (22, "http://[", ""),
             (23, "http://copy/1", page(1)), (24, "http://copy/2", page(1)), (23, "http://copy/1", page(1)),
             (25, "http://long/1", "<p>w" * 20_000 + "<p>own"), (26, "http://long/2", "<p>w" * 19_000 + "<p>another")]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"TEXT": F.lit(1), "cut": F.lit(2), "_found": F.lit(3),
                                                            "page": F.lit(4), "Lines": F.lit(5), "c0": F.lit(6)})
    assert page_diff.main_text(pages).columns == ["page_id", "url", "cut", "_found", "page", "Lines", "c0", "text", "n_chars"]
    assert tuple(page_diff.main_text(pages).first())[2:7] == (2, 3, 4, 5, 6)
    got = [(r.page_id, r.text, r.n_chars) for r in page_diff.main_text(pages).collect()]
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in got}
    for i in range(9):
        assert text[i] == f"story number {i}"
    assert text[20] == "Site of things more" and text[21] == "" and text[22] == ""
    assert text[23] == text[24] == "Site of things story number 1 call us"  # copies are not templates
    assert text[25] == "w " * 1000 + "own" and text[26] == "another"
    assert all(n == len(t) for _, t, n in got)
    assert page_diff.main_text(pages.limit(0)).count() == 0


def test_pairs_and_cuts_equal_a_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    parsed = page_diff.line_table(pages)
    rows = sorted(parsed.drop("texts").collect(), key=lambda r: (r.host, r.path, r.page))
    got = {r.page: r.cut for r in page_diff.template_lines(parsed).collect()}
    removed = 0
    for i, r in enumerate(rows):
        near = [x for x in rows[max(i - 1, 0) : i] + rows[i + 1 : i + 2] if x.host == r.host]
        start = lambda x: len(os.path.commonprefix([x.path, r.path]))  # noqa: B023
        want = 0
        if near:
            pair = max(near, key=lambda x: (start(x), x.page == rows[i - 1].page))
            a, b = ([h for h, k in zip(x.lines, x.kinds) if k != page_diff.ARTICLE] for x in (r, pair))
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for y, u in enumerate(a):
                for z, v in enumerate(b):
                    table[y + 1][z + 1] = table[y][z] + 1 if u == v else max(table[y][z + 1], table[y + 1][z])
            want = table[-1][-1]
        assert len(got.get(r.page, [])) == want
        assert all(r.kinds[k] != page_diff.ARTICLE for k in got.get(r.page, []))
        removed += want
    assert removed > 0  # differencing removes lines of the given pages


# Posting lists.


def nearest(ids, x, query, k):
    norm = np.sqrt((x * x).sum(axis=1))
    score = (x * x[query]).sum(axis=1) / (norm * norm[query])
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[query]][:k]
    return [(int(ids[i]), score[i]) for i in order]


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in postings.search(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    rows = sorted(table.select("vec_id", "embedding").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    hits = total = 0
    for q in np.nonzero(ids % 50 == 0)[0]:
        want = nearest(ids, x, q, 5)
        hits += len({i for i, _ in want} & {i for i, _ in got[ids[q]]})
        total += len(want)
    assert hits >= 0.95 * total


def test_vectors_that_take_no_part_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(postings, "PART_VECTORS", 3)
    monkeypatch.setattr(postings, "PART_QUERIES", 1)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 0.0]), (50, [2.0, 0.0]), (51, [2.0, 0.0]), (50, [2.0, 0.0]), (9, [])]
    rows += [(100 + i, [3.0, 0.0]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(1))
    got = {}
    for r in postings.search(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 50, 100}
    assert got[0] == [(k + 1, i, 1.0) for k, i in enumerate([50, 51, 100, 101, 102])]
    assert [i for _, i, _ in got[50]] == [0, 51, 100, 101, 102]
    assert [i for _, i, _ in got[100]] == [0, 50, 51, 101, 102]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in postings.search(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.0)]
    assert postings.search(few.limit(0), F.lit(True)).count() == 0


def test_graph_search_finds_the_nearest_centroids():
    rnd = np.random.default_rng(3)
    at = rnd.normal(size=(300, 16))
    at /= np.linalg.norm(at, axis=1, keepdims=True)
    x = rnd.normal(size=(50, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, distance = postings.Centroids.of(at).search(x, beam=32)
    best = (x @ at.T).argmax(axis=1)
    assert (ids[:, 0] == best).mean() >= 0.95 and (np.diff(distance, axis=1) >= -1e-12).all()


# The pipeline.


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    long_text = " ".join(f"word{i} of{i % 17}" for i in range(70))
    rows = [(1, long_text, "en", "a", 10), (2, long_text, "en", "a", 10), (2, long_text, "en", "a", 10),
            (3, None, None, None, None), (None, long_text + " x" * 9, "en", None, 5), (4, "short", "en", "b", 5),
            (5, " ".join(f"other{i * 3} text{i}" for i in range(90)) + ' token = "0123456789abcdef0123456789abcdef01234567"', "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = pipeline.quality_rules(spark, docs, SF)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 2, 5]
    first = pipeline.near_duplicates(spark, kept, SF)
    ids = sorted((r.doc_id or 0) for r in first.collect())
    assert 1 in ids and 2 not in ids and 5 in ids
    clean = pipeline.secret_scan(spark, first, SF)
    assert clean.columns == docs.columns and clean.count() == first.count()
    mixed = pipeline.source_mix(spark, clean, SF)
    assert mixed.columns == docs.columns
    packed = pipeline.best_fit_packing(spark, mixed, SF)
    assert packed.agg(F.sum("length")).first()[0] > 0
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_keeps_columns_of_any_name(spark):
    import corpus_pipeline as pipeline

    names = ["failed", "n_words", "Size", "target", "copies", "_key", "_same", "_copy", "FP", "component_id", "_secrets",
             "place", "key", "no_id", "c1", "_part", "source_size", "_own", "label", "a.b"]
    texts = [" ".join(f"w{i} and{i * k}" for i in range(60)) + ' token = "0123456789abcdef0123456789abcdef0123456%d"' % k
             for k in range(1, 5)]
    rows = [(k, t, "en", "s", len(t), *[f"{c}-{k}" for c in names], {"x": k}) for k, t in enumerate(texts)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in names)
    docs = spark.createDataFrame(rows, schema + ", extra map<string, int>")
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema], name
        seen = got.collect()
        assert {r.doc_id for r in seen} == {0, 1, 2, 3}
        for r in seen:
            assert tuple(r)[5:-1] == tuple(f"{c}-{r.doc_id}" for c in names) and r.extra == {"x": r.doc_id}, name
            assert r.n_chars == len(r.text)
    assert simhash.near_duplicates(docs).count() == 4 and "a.b" in mixing.copies(docs, F.lit(3)).columns


def test_pipeline_packs_all_that_the_mix_takes(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        from tracewise.llm.common import staged

        docs = staged(stage(spark, docs, SF), "test")
    got = pipeline.STAGES[-1][1](spark, docs, SF)
    want = packing.pieces(docs, "word_bpe_49k.json")
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
