"""Edge cases of the operators, a row each."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry import jobs
from docquarry.engine import Engine
from docquarry.functions import text as t
from docquarry.functions import vectors
from docquarry.functions.jsonfilter import contains
from docquarry.models import HashingEmbedder, plain_pages
from docquarry.operators import answer, catalog, chunking, feeds, locate, matching
from docquarry.schemas import CHUNKS, DEVICES, PRODUCT_FEED
from docquarry.sources import answers, files, sinks


def one(spark, column, *rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


@pytest.mark.parametrize("n", [0, 1, 896, 897, 1024, 1025, 1792, 1793])
def test_chunk_lengths(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    got = [(r.chunk_index, r.content) for r in chunking.chunks(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("chunk_index").collect()]
    assert got == [(i, text[s : s + 1024]) for i, s in enumerate(range(0, n, 896))]


@settings(max_examples=10, deadline=None)
@given(st.text(alphabet="ab é😀̈\n", max_size=60), st.integers(2, 9), st.integers(0, 8))
def test_chunks_give_back_the_text(spark, text, size, overlap):
    if overlap >= size:
        return
    rows = chunking.chunks(spark.createDataFrame([(1, text)], "id int, text string"), size=size, overlap=overlap).orderBy("chunk_index").collect()
    assert "".join(r.content[: size - overlap] for r in rows) == text
    assert len(rows) == math.ceil(len(text) / (size - overlap))


def test_chunk_arguments(spark):
    with pytest.raises(ValueError):
        chunking.chunks(spark.createDataFrame([("a",)], "text string"), size=10, overlap=10)
    assert chunking.chunks(spark.createDataFrame([(None,)], "text string")).count() == 0


def test_json_containment(spark):
    rows = ["{}", '{"a": 1, "b": [1, 2, {"c": null}], "d": {"e": "x", "f": true}}', '{"a": 1.0}', "[1, 2]", "not json", None, '{"a": "1"}', '{"a": null}']
    expected = {
        "{}": ({}, [True, True, True, True, None, None, True, True]),
        "number": ({"a": 1}, [False, True, True, False, None, None, False, False]),
        "array": ({"b": [2, {"c": None}]}, [False, True, False, False, None, None, False, False]),
        "nested": ({"d": {"f": True}}, [False, True, False, False, None, None, False, False]),
        "null": ({"a": None}, [False, False, False, False, None, None, False, True]),
        "string": ({"a": "1"}, [False, False, False, False, None, None, True, False]),
        "element": (2, [False, False, False, True, None, None, False, False]),
    }
    for wanted, found in expected.values():
        assert one(spark, contains(F.col("x"), wanted), *rows) == found, wanted


def chunk_rows(spark):
    rows = [("a", "A", '{"source": "a"}', [1.0, 0.0]), ("b", "B", '{"source": "b"}', [0.0, 1.0]), ("c", "C", None, [1.0, 0.0]), ("d", "D", "{}", None), ("e", "E", "{}", [0.0, 0.0]), ("f", "F", "{}", [2.0, 0.0]), ("g", "G", "{}", [1.0])]
    return spark.createDataFrame(rows, CHUNKS)


def test_match(spark):
    found = [(r.id, r.similarity) for r in matching.match_documents(chunk_rows(spark), [1.0, 0.0]).collect()]
    assert [i for i, _ in found] == ["a", "f", "b", "e", "d", "g"]  # c has no metadata; nulls come last
    assert found[0][1] == 1.0 and math.isnan(dict(found)["e"]) and dict(found)["d"] is None
    three = [r.id for r in matching.match_documents(chunk_rows(spark), [1.0, 0.0], 3).collect()]
    assert three == ["a", "f", "b"]
    assert [r.id for r in matching.match_documents(chunk_rows(spark), [1.0, 0.0], 5, {"source": "b"}).collect()] == ["b"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<float>")
    assert df.select(vectors.norm(F.col("v"))).first()[0] == 5.0


def test_nearest_in_several_packs(spark, monkeypatch):
    rows = spark.range(30).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 7).cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    whole = sorted(tuple(r) for r in matching.nearest(rows, rows, 3).select("q_id", "vec_id", "rk").collect())
    monkeypatch.setattr(matching, "PACKED", 7)
    assert sorted(tuple(r) for r in matching.nearest(rows, rows, 3).select("q_id", "vec_id", "rk").collect()) == whole


def test_text(spark):
    assert one(spark, t.strip(F.col("x")), "\t a f\x0c\n", "f") == ["a f", "f"]
    assert one(spark, t.search_term(F.col("x")), "\tab\ncd" + "x" * 50, "   ") == ["ab cd" + "x" * 34, ""]
    assert one(spark, t.first_part(F.col("x")), "Name, Inc.", None) == ["Name", ""]
    assert one(spark, t.title(F.col("x")), "a_b.pdf", "x" * 41) == ["a b", "x" * 40 + "..."]
    assert one(spark, t.file_name(F.lit("1"), F.col("x")), "a/b") == ["1_a_b.pdf"]
    assert one(spark, t.natural_id(F.lit("a"), F.col("x")), "b", None)[0] != one(spark, t.natural_id(F.lit("a"), F.col("x")), None)[0]
    assert one(spark, t.megabytes(F.col("x")), 1048576, schema="x long") == ["1.00"]
    assert one(spark, t.percent(F.col("x"), F.lit(8)), 1, schema="x long") == ["12.5"]
    assert one(spark, t.grouped(F.col("x")), 1234567, schema="x long") == ["1,234,567"]
    assert one(spark, t.data_uri(F.encode("x", "utf-8"), F.lit(2)), "hi") == ["data:application/pdf;base64,aGk=#page=2"]
    assert one(spark, t.base_name(F.col("x")), "a/b/c.txt") == ["c.txt"]


def test_upsert(spark):
    first = spark.createDataFrame([("1", "a", 0), ("2", "b", 1), (None, "n", 2), ("1", "c", 3)], "primary_di string, brand_name string, seq long")
    empty = spark.createDataFrame([], DEVICES)
    table = catalog.upsert(empty, first, order="seq").cache()
    assert {(r.primary_di, r.brand_name) for r in table.collect()} == {("1", "c"), ("2", "b"), (None, "n")}
    again = spark.createDataFrame([("2", "z", 0), (None, "m", 1)], "primary_di string, description string, seq long")
    after = catalog.upsert(table, again, order="seq").cache()
    rows = {(r.primary_di, r.brand_name, r.description) for r in after.collect()}
    assert rows == {("1", "c", None), ("2", "b", "z"), (None, "n", None), (None, None, "m")}
    old = {r.primary_di: (r.id, r.created_at) for r in table.collect() if r.primary_di}
    assert all(old[r.primary_di] == (r.id, r.created_at) for r in after.collect() if r.primary_di)


def test_catalog_search(spark):
    rows = spark.createDataFrame([("3", "ACME, Inc.", "b", "x"), ("1", "acme", "b", ""), ("2", "Acme", "b", None), ("4", "other", "b", "y")], "primary_di string, company_name string, brand_name string, catalog_number string")
    assert [r.primary_di for r in catalog.search(rows, "acme").collect()] == ["3"]
    names = spark.createDataFrame([("3_x.pdf",)], "file_name string")
    assert [r.primary_di for r in catalog.skip_existing(rows.where("catalog_number <> ''"), names, t.file_name(F.col("primary_di"), F.col("catalog_number"))).collect()] == ["4"]


def test_delimited(spark, tmp_path):
    path = tmp_path / "device.txt"
    path.write_text('PrimaryDI|brandName|extra\n1|"a ""q"" | b"|x\n2||y\n3|"two\nlines"|z\n4|short\n', encoding="utf-8")
    rows, odd = files.delimited(spark, str(path))
    found = {r.PrimaryDI: r.brandName for r in rows.collect()}
    assert found == {"1": 'a "q" | b', "2": "", "3": "two\nlines", "4": "short"}
    assert [r.PrimaryDI for r in odd.collect()] == ["4"]
    exact, _ = files.delimited(spark, str(path), exact=True)
    assert {r.PrimaryDI: r.extra for r in exact.collect()}["4"] is None
    assert catalog.project(rows).columns == ["primary_di", "brand_name", "company_name", "model_number", "catalog_number", "description"]


def test_last_row_of_a_load_wins(spark, tmp_path):
    """By the place in the file, whatever the values are; line ends in quotes don't shift it; rows without a key are all kept."""
    head, n = "PrimaryDI|brandName|companyName|catalogNumber|x\n", 3000
    body = "".join(f"{i % 1000}|{['zz', 'aa', 'mm'][i // 1000]}|\"two\nlines\"|{i}|\n" for i in range(n))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text(head + body, encoding="utf-8")
    (tmp_path / "in" / "2.txt").write_text(head + "7|later|c|1|\n7|a|c|2|\n", encoding="utf-8")
    table, odd, count = jobs.load_catalog(spark, str(tmp_path / "in"), str(tmp_path / "out"), 1)
    found = {r.primary_di: (r.brand_name, r.catalog_number) for r in table.collect()}
    assert found == {str(i): ("mm", str(2000 + i)) for i in range(1000)} | {"7": ("a", "2")} and count == 1000 and odd.collect() == []
    for exact in (False, True):
        rows, _ = files.delimited(spark, str(tmp_path / "in" / "1.txt"), exact=exact, place="at")
        assert [int(r.catalogNumber) for r in rows.orderBy("at").collect()] == list(range(n))
    assert "at" not in files.delimited(spark, str(tmp_path / "in"), exact=True)[0].columns


def test_device_feed(spark):
    body = '{"search-result": {"device": [{"catalogNumber": "1", "brandName": null}, {"catalogNumber": ""}, {"catalogNumber": "3", "brandName": "b", "deviceDescription": "d"}, {"catalogNumber": "4"}]}}'
    rows = spark.createDataFrame([(body,), ("{}",)], "json string")
    assert [tuple(r) for r in feeds.devices(rows, limit=3).collect()] == [("1", None, "No description"), ("3", "b", "d")]


def test_product_feed(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"totalElements": 2, "content": [{"id": "p", "name": "n", "documents": [{"id": "d", "title": "T", "fileUuid": "u", "documentType": {"name": "Instructions for Use"}}, '
        '{"id": "e", "title": "U", "documentType": {"name": "INSTRUCTIONS FOR USE"}, "language": {"isoCode": "EN"}}, {"id": "f", "title": "V", "language": {"isoCode": "de"}, "documentType": {"name": "instructions for use"}}, '
        '{"id": "g", "title": "W"}]}, {"id": "q"}]}'
    )
    found = answers.products(spark, str(tmp_path))
    assert feeds.total(found).first()[0] == 2
    rows = feeds.product_documents(found.select(F.inline("content")), "https://x").collect()
    assert {(r.name, r.gtin, r.title) for r in rows} == {("n", "N/A", "T"), ("n", "N/A", "U"), ("Unknown Product", "N/A", None)}
    assert {r.title: r.link is not None for r in rows} == {"T": True, "U": False, None: False}
    assert answers.or_empty(spark, lambda: spark.read.parquet(str(tmp_path / "none")), PRODUCT_FEED).count() == 0


def test_web_hits(spark):
    def provider(q):
        if q == "bad":
            raise OSError
        return [f"http://x/{q}/1", f"http://x/{q}/2.PDF", "http://x/pdf/3", "http://x/4.pdf"]

    asked = spark.createDataFrame([("d", 1, "bad"), ("d", 2, "ok"), ("e", 1, "bad")], "query_id string, template_no int, q string")
    rows = answers.hits(asked, provider)
    assert rows.count() == 3
    assert [tuple(r) for r in feeds.first_url(rows, "query_id").collect()] == [("d", "http://x/ok/2.PDF")]
    device = spark.createDataFrame([("A, Inc", " b ", "1")], "c string, b string, n string")
    assert [r.q for r in feeds.templates(device, "c", "b", "n").orderBy("template_no").collect()] == ['A 1 "Instructions for use" filetype:pdf', "A b 1 IFU filetype:pdf", "A 1 manual filetype:pdf"]


def test_locate(spark):
    pages = spark.createDataFrame([("s", 1, "nothing"), ("s", 2, "xx Term F. yy term f."), ("s", 3, "term f."), ("o", 1, "term f.")], "source string, page_no int, page_text string")
    passages = spark.createDataFrame([("1", "s", "\tterm\nF."), ("2", "s", "   "), ("3", "s", "absent")], "id string, source string, content string")
    first = {r.id: (r.found_page, r.ui_page) for r in locate.first_page(passages, pages).collect()}
    assert first == {"1": (2, 2), "2": (None, 1), "3": (None, 1)}
    assert sorted((r.id, r.page_no, len(r.spans)) for r in locate.all_pages(passages, pages).collect()) == [("1", 2, 2), ("1", 3, 1)]
    marked = {r.id: (r.found_page, [(s.begin, s.end) for s in r.spans]) for r in locate.highlighted(passages, pages).collect()}
    assert marked["1"] == (2, [(3, 10), (14, 21)]) and marked["3"] == (None, [])


def test_locate_in_shares(spark, monkeypatch):
    """With the terms of a document in one automaton or in several, broadcast or joined, what is found is what a search of each page finds."""
    import random

    rng = random.Random(5)
    words = ["Ab", "ba", "aab", "É", "x.y", "日本", "\\E", "a"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pages = [(d, n, text(rng.randrange(30))) for d in ("p", "q", None) for n in range(1, 12)] + [("p", 3, "ab AB"), ("p", None, "ab"), ("q", 4, None), ("z", 1, "ab")]
    passages = [(str(i), rng.choice(["p", "q", "r", None]), text(rng.randrange(1, 4))) for i in range(60)] + [("60", "p", None), ("61", "p", " "), ("62", "p", "a a"), ("63", "q", "a")] * 2
    p = spark.createDataFrame(pages, "source string, page_no int, page_text string").repartition(3)
    q = spark.createDataFrame(passages, "id string, source string, content string").withColumn("term", F.lit(1))
    brute = []
    for i, source, content in passages:
        term = (content or "")[:50].strip().lower()
        for s, n, page in pages:
            low, spans, at = (page or "").lower(), [], 0
            while term and source is not None and s == source and (at := low.find(term, at)) >= 0:
                spans.append((at, at + len(term)))
                at += len(term)
            if spans:
                brute.append((i, s, n, spans))
    for limits in ((1000, 16 << 20), (2, 16 << 20), (2, 0)):
        for name, value in zip(("TERMS", "BROADCAST_BYTES"), limits, strict=True):
            monkeypatch.setattr(locate, name, value)
        got = [(r.id, r.source, r.page_no, [(s.begin, s.end) for s in r.spans]) for r in locate.all_pages(q, p).collect()]
        assert sorted(got, key=repr) == sorted(brute, key=repr)
        least = {i: min(n for j, _, n, _ in brute if j == i and n is not None) for i, _, n, _ in brute if n is not None}
        assert {(r.id, r.found_page) for r in locate.first_page(q, p).collect()} == {(i, least.get(i)) for i, _, _ in passages}
    assert locate.first_page(q, p.limit(0)).where("found_page is null").count() == len(passages)
    assert locate.all_pages(q.limit(0), p).count() == 0
    plan = locate.terms_on_pages(locate.asked_terms(q, "source", "content", None, 40, "id"), p)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Contains(lower" not in plan


def test_answer(spark):
    rows = spark.createDataFrame([(2, "b", '{"source": null}'), (1, "a", '{"source": "f"}'), (3, None, "{}")], "rank int, content string, metadata string")
    assert answer.context(rows).first()[0] == "Source [1] (File: f):\na\n\nSource [2] (File: None):\nb\n\nSource [3] (File: Unknown):\nNone"
    assert answer.context(rows.limit(0)).first()[0] is None
    assert answer.or_nothing_found(rows).first()[0] == "found"
    assert answer.prompt("{context}?", "see {query}").count("see {query}") == 1


def test_engine(spark, tmp_path):
    pages = spark.createDataFrame([("a.pdf", 1, "turn the blue valve"), ("a.pdf", 2, "remove the red cap"), ("b.pdf", 1, "charge the battery")], "source string, page_no int, page_text string")
    engine = Engine(spark, embedder=HashingEmbedder(64))
    assert engine.health() == {"status": "ok", "db_connected": False}
    with pytest.raises(RuntimeError):
        engine.search("x")
    engine.ingest(pages, str(tmp_path / "chunks"))
    assert engine.health()["db_connected"]
    found = engine.ask("battery charge")
    assert found["results"][0]["content"] == "charge the battery\n" and found["shown"]["page"] == 1 and "[1]" in found["answer"]
    assert engine.search("valve", where={"source": "none"}) == {"answer": answer.NOTHING_FOUND, "results": []}
    assert engine.locate("a.pdf", "red cap")["found_page"] == 2
    with pytest.raises(FileNotFoundError):
        engine.locate("c.pdf", "x")
    with pytest.raises(ValueError):
        engine.ask("  ")

    class Broken:
        def answer(self, prompt, excerpts):
            raise OSError("down")

    engine.synthesizer = Broken()
    assert "down" in engine.search("valve")["answer"] and engine.search("valve")["results"]


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "A.PDF").write_bytes(b"one\x0ctwo")
    (tmp_path / "bad.pdf").write_bytes(b"\xff\xfe")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.pdf").write_bytes(b"x")
    (tmp_path / "sub" / "id_rsa").write_text("")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("b.bin", "x")
    folder = str(tmp_path)
    docs = files.documents(spark, folder)
    assert sorted(r.file_name for r in docs.select("file_name").collect()) == ["A.PDF", "bad.pdf"]
    assert [(r.source, r.page_no, r.page_text) for r in files.page_texts(docs, plain_pages).orderBy("page_no").collect()] == [("A.PDF", 1, "one"), ("A.PDF", 2, "two")]
    assert [(r.name, r.size_bytes) for r in files.unzipped(files.archives(spark, folder), ".txt").collect()] == [("a.txt", 5)]
    assert [r.path.rsplit("/", 1)[1] for r in files.audit(spark, folder).collect()] == ["id_rsa"]
    assert files.resolve(spark, "A.PDF", str(tmp_path / "none"), folder).endswith("A.PDF")
    for name in ("../A.PDF", "", "x/y"):
        with pytest.raises(ValueError):
            files.resolve(spark, name, folder)
    with pytest.raises(FileNotFoundError):
        files.resolve(spark, "none.pdf", folder)
    out = sinks.files(spark.createDataFrame([("o.bin", bytearray(b"123"))], "file_name string, content binary"), str(tmp_path / "out"))
    assert [tuple(r) for r in out.collect()] == [("o.bin", 3)] and (tmp_path / "out" / "o.bin").read_bytes() == b"123"


def test_streamed_ingest_is_idempotent(spark, tmp_path):
    from docquarry.streaming.ingest import ingest_files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"x" * 2000)
    args = (spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "checkpoint"), plain_pages)
    ingest_files(*args).awaitTermination()
    first = spark.read.parquet(str(tmp_path / "table")).count()
    ingest_files(*args).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == first == 3
    (tmp_path / "in" / "b.PDF").write_bytes(b"y")
    ingest_files(*args).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == first + 1


def test_tables(spark, tmp_path):
    from docquarry import schemas

    schemas.create_tables(spark, str(tmp_path))
    assert spark.table("devices").columns == DEVICES.names
    schemas.refresh(spark, "devices")
    assert schemas.readable(spark.table("chunks"), F.lit(True)).count() == 0
    assert sinks.replace_version(spark.range(3), str(tmp_path / "v"), 1).endswith("version=1")
    assert sinks.json_array(spark.createDataFrame([(2, "b"), (1, "a")], "o int, x string"), "o").first()[0] == '[{"o":1,"x":"a"},{"o":2,"x":"b"}]'


def test_delimited_is_split_between_tasks(spark, tmp_path):
    """Files whose lines are records go to many tasks, one with a line end in a quotation to one; rows, odd rows and order are those of Python's csv module, the headers differ from file to file."""
    import csv
    import io

    bodies = {
        "1.txt": "b|a|c\n" + "".join(f'n{i}|{i}|"x|""{i}"\n' if i % 10 else f"{i}\n" for i in range(4000)), "2.txt": "a|b|c\r\n" + "".join(f'{i}|5" n|c|d\r\n' if i % 7 == 0 else f"{i}||\r\n\r\n" for i in range(5000, 5100)),
        "3.txt": 'a|b|c\n6000|"two\nlines"|c\n6001|x\n',
    }
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body.encode())
    want, odd_rows = [], 0
    for body in bodies.values():
        for r in csv.DictReader(io.StringIO(body, newline=""), delimiter="|"):
            want.append((r["a"], r["b"], r["c"]))
            odd_rows += None in r or None in r.values()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows, odd = files.delimited(spark, str(tmp_path), exact=True, place="at")
        assert [(r.a, r.b, r.c) for r in rows.orderBy("at").collect()] == want and odd.count() == odd_rows
        one, two = tmp_path / "1.txt", tmp_path / "3.txt"
        for exact in (False, True):
            rows, odd = files.delimited(spark, str(one), exact=exact, place="at")
            assert rows.rdd.getNumPartitions() > 4 and len(odd.collect()) == 400
            assert odd.agg(F.count("b")).first()[0] == 400  # of one column, too
            assert [r.a or r.b for r in rows.orderBy("at").collect()] == [str(i) for i in range(4000)]
            assert files.delimited(spark, str(two), exact=exact)[0].where("a = '6000'").first()["b"] == "two\nlines"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
