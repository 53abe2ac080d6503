from __future__ import annotations

import json
import threading
import time
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

from lodestone.engine import Engine
from lodestone.errors import FileError, ParseError, SearchError, ValidationError
from lodestone.page import count, escaped, page, shortened, size
from lodestone.server import answer, serve
from lodestone.sources.generator import products
from lodestone.sources.store import to_merge
from lodestone.streaming.ingest import json_lines, stream_documents

MAPPING = [("some_text", "Text"), ("other_field", "Text")]
DOCS = [
    {"some_text": "these terms are in both", "other_field": "apple"},
    {"some_text": "these terms are in both", "other_field": "banana"},
    {"some_text": "this is new in", "other_field": "ok"},
]


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/engine", compact_at=2)
    e.create_index("i", MAPPING)
    return e


def hits(engine, query, **options):
    return [(r["id"], r["score"]) for r in engine.search("i", query, **options).collect()]


def test_life_of_an_index(spark, engine):
    assert engine.index_docs("i", DOCS[:2]) == {"status": "indexed", "accepted": 2, "rejected": 0}

    def two(e):
        assert [(i, pytest.approx(s, abs=1e-5)) for i, s in hits(e, "these terms are in both")] == [(1, 0.911608), (2, 0.911608)]
        assert hits(e, "banana")[0][1] == pytest.approx(0.693147, abs=1e-5)
        assert hits(e, "banana term") == [] and hits(e, "apple both") == [] and hits(e, "") == [] and hits(e, "-") == []

    two(engine)
    engine.flush()
    two(engine)
    engine.index_docs("i", DOCS[2])

    def three(e):
        found = hits(e, "in")
        assert [i for i, _ in found] == [3, 1, 2]
        assert [s for _, s in found] == [pytest.approx(x, abs=1e-5) for x in (0.141820, 0.129740, 0.129740)]
        assert hits(e, "this is new") == [(3, pytest.approx(3.125125, abs=1e-5))]
        assert hits(e, "bananna", fuzzy=True) == hits(e, "banana")

    three(engine)
    engine.flush()
    three(engine)
    engine.index_docs("i", {"some_text": "zzz", "other_field": "zzz zzz"})
    before = hits(engine, "in")
    engine.flush()  # the third flush merges all segments
    assert len(engine.store.state("i").segments) == 1 and hits(engine, "in") == before
    again = Engine(spark, engine.store.root)
    assert again.index_names() == ["i"] and hits(again, "in") == before
    assert len(again.store.vacuum("i")) > 0 and hits(again, "in") == before
    version = again.store.state("i").version
    again.flush()
    assert again.store.state("i").version == version
    again.index_docs("i", DOCS[0])
    assert again.store.state("i").max_doc_id == 5


def test_rejected_documents_take_no_id(engine):
    with pytest.raises(ParseError, match="not found"):
        engine.index_docs("i", [DOCS[0], {"some_text": "x"}])
    assert engine.store.state("i").max_doc_id == 0
    assert engine.index_docs("i", [{"some_text": "x"}, DOCS[0]], on_error="skip") == {"status": "indexed", "accepted": 1, "rejected": 1}
    assert [r.id for r in engine.search("i", "apple").collect()] == [1]


def test_added_field(spark, engine):
    engine.index_docs("i", DOCS[:1])
    engine.flush()
    assert engine.update_mapping("i", ("new_field", "Bool")) == {"status": "mapping_updated"}
    engine.index_docs("i", DOCS[0] | {"new_field": True})
    found = Engine(spark, engine.store.root).search("i", "apple").collect()
    assert [(r.id, r.doc.new_field) for r in found] == [(1, None), (2, True)]
    with pytest.raises(ParseError):
        engine.index_docs("i", DOCS[0])


def test_errors(engine):
    for call in (lambda: engine.search("no", "x"), lambda: engine.index_docs("no", {}), lambda: engine.update_mapping("no", ("a", "Text")), lambda: engine.layout("no")):
        with pytest.raises(SearchError, match="no index of the name no"):
            call()
    with pytest.raises(ValidationError, match="there is an index i already"):
        engine.create_index("i", MAPPING)
    with pytest.raises(ValidationError):
        engine.create_index("!!!invalid", MAPPING)


def test_field_names_that_differ_in_case(spark, engine):
    fields = [("t", "Text"), ("T", "Keyword", False), ("a-b", "Text", False)]
    with pytest.raises(ValidationError):
        engine.create_index("c", fields)
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        engine.create_index("c", fields)
        engine.index_docs("c", [{"t": "lower", "T": "Upper", "a-b": "dash"}])
        engine.flush()
        for q in ("lower", "upper", "dash"):
            assert [r.doc["T"] for r in engine.search("c", q).collect()] == ["Upper"]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_two_writers_cannot_both_win(engine):
    state = engine.store.state("i")
    engine.store.commit("i", state)
    with pytest.raises(FileError):
        engine.store.commit("i", state)


def test_a_failed_run_leaves_nothing(engine, monkeypatch):
    engine.index_docs("i", DOCS[:2])
    monkeypatch.setattr(engine.store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    for f in (engine.flush, lambda: engine.index_docs("i", DOCS[2])):
        with pytest.raises(RuntimeError):
            f()
    monkeypatch.undo()
    assert [i for i, _ in hits(engine, "in")] == [1, 2]
    engine.flush()
    engine.index_docs("i", DOCS[2])
    assert [i for i, _ in hits(engine, "in")] == [3, 1, 2]


def test_layout(engine):
    engine.index_docs("i", DOCS)
    page = engine.layout("i")
    summary = {r["name"]: r["value"] for r in page["summary"].collect()}
    assert summary["documents"] == summary["log_documents"] == 3 and summary["max_doc_id"] == 3
    assert {(r.field, r.docs, r.total_tokens) for r in page["field_stats"].collect()} == {("some_text", 3, 14), ("other_field", 3, 3), (None, 6, 17)}
    assert page["top_tokens"].first()["token"] == "in" and page["mapping"].count() == 2 and page["log"].count() == 3
    engine.flush()
    page = engine.layout("i")
    assert page["segment_tables"].where("bytes > 0 AND end - start = bytes AND files > 0").count() == 5
    assert [(r.documents, r.max_doc_id, r.bytes > 0) for r in page["segments"].collect()] == [(3, 3, True)]
    assert [(r.block, r.field, r.token) for r in page["term_anchors"].collect()] == [(0, "other_field", "apple")]
    assert [(r.block, r.doc_id) for r in page["doc_anchors"].collect()] == [(0, 1)]


def test_shown_values():
    assert [size(n) for n in (0, 1_023, 1_024, 1_536, 5 << 20, 3 << 40)] == ["0 B", "1023 B", "1.00 KB", "1.50 KB", "5.00 MB", "3072.00 GB"]
    assert (count(1_234_567), count(-1_000), count(7)) == ("1,234,567", "-1,000", "7")
    assert escaped("<a href='x'>&\"") == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"
    assert shortened("x" * 220) == "x" * 220 and shortened("x" * 221) == "x" * 217 + "..."
    assert "&lt;b&gt;" in page("i", {"t": [{"a": "<b>", "bytes": 2_048}], "none": []}) and "2.00 KB" in page("i", {"t": [{"bytes": 2_048}]})


def test_typed_frames_and_generated_products(spark, engine):
    engine.create_index("p", [("title", "Text"), ("category", "Keyword"), ("organic", "Bool"), ("price", "Number")])
    made = products(spark, 500)
    assert made.repartition(7).exceptAll(products(spark, 500)).count() == 0
    assert engine.index_docs("p", made)["accepted"] == 500
    ids = [r.doc_id for r in engine.tables("p").docs.select("doc_id").collect()]
    assert sorted(ids) == list(range(1, 501))
    found = engine.search("p", "bio quark").collect()
    assert found and all("Bio" in r.doc.title and "Quark" in r.doc.title for r in found)


def test_stream_equals_batch(spark, engine, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [json.dumps(d) for d in DOCS * 4] + ["no json"]
    for k in range(3):
        (folder / f"{k}.json").write_text("\n".join(lines[k::3]) + "\n")
    for _ in range(2):
        stream_documents(engine, "i", json_lines(engine, str(folder), 1), str(tmp_path / "cp"), rejects=str(tmp_path / "bad"), flush_every=2).awaitTermination()
    engine.create_index("b", MAPPING)
    engine.index_docs("b", DOCS * 4)
    one, two = engine.tables("i"), engine.tables("b")
    assert one.docs.count() == two.docs.count() == 12
    same = ["field", "token", "tf", "dl"]
    assert one.postings.select(same).exceptAll(two.postings.select(same)).count() == 0
    assert engine.index_docs("i", DOCS[0], stream=("stream", 0))["accepted"] == 0
    bad = spark.read.json(str(tmp_path / "bad" / "stream")).collect()
    assert [(r.text, r.error) for r in bad] == [("no json", "the document is no JSON object")]
    with pytest.raises(ValueError):
        stream_documents(engine, "i", json_lines(engine, str(folder), 1), str(tmp_path / "cp"))


def test_http(engine):
    assert answer(engine, "PUT", "/indexes/h", '{"fields":[{"fieldName":"t","sType":"Text"}]}') == (200, '{"status": "created"}')
    assert answer(engine, "PUT", "/indexes/h", '{"fields":[{"fieldName":"t","sType":"Text"}]}')[0] == 400
    assert answer(engine, "PUT", "/indexes/g", '{"fields":[]}')[0] == 400
    assert answer(engine, "POST", "/indexes/h/documents", '{"t":"Hello World"}') == (200, '{"status": "indexed"}')
    assert answer(engine, "POST", "/indexes/h/documents", '{"t":1}')[0] == 400
    assert answer(engine, "PATCH", "/indexes/h/mapping", '{"fieldName":"u","sType":"Bool","required":false}')[0] == 200
    assert answer(engine, "GET", "/nothing")[0] == 404
    httpd = serve(engine, 0)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{httpd.server_port}"
    with urllib.request.urlopen(f"{base}/indexes/h/search?q=wrold%20hello&fuzzy=false") as r:
        assert json.loads(r.read()) == {"results": []}
    with urllib.request.urlopen(f"{base}/indexes/h/search?q=worl&fuzzy=true") as r:
        (result,) = json.loads(r.read())["results"]
        assert result["id"] == 1 and result["doc"] == {"t": "Hello World"}
    httpd.shutdown()
    status, text = answer(engine, "GET", "/indexes/h/_layout")
    assert status == 200 and "hello" in text and text.startswith("<!doctype html>")
    assert json.loads(answer(engine, "GET", "/indexes/h/_layout?format=json")[1])["top_tokens"][0]["token"] == "hello"


def test_the_subpackage_for_text_is_not_needed():
    root = Path(__file__).resolve().parent.parent / "lodestone"
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not any("lodestone.llm" in p.read_text() for p in others)


def test_sixteen_writers(spark, engine):
    """200 posts from 16 threads over two engines on one folder: all are taken, each id once."""
    engines = [engine, Engine(spark, engine.store.root, compact_at=2)]
    documents = [json.dumps(DOCS[k % 3] | {"other_field": f"n{k}"}) for k in range(200)]

    def post(k):
        if k % 70 == 40:
            engines[k % 2].flush()
        return answer(engines[k % 2], "POST", "/indexes/i/documents", documents[k])

    with ThreadPoolExecutor(16) as pool:
        answers = list(pool.map(post, range(200)))
    assert answers == [(200, '{"status": "indexed"}')] * 200
    docs = Engine(spark, engine.store.root).tables("i").docs.collect()
    assert sorted(r.doc_id for r in docs) == list(range(1, 201)) and {r.doc.other_field for r in docs} == {f"n{k}" for k in range(200)}
    began = time.perf_counter()
    assert answer(engine, "POST", "/indexes/i/documents", documents[0])[0] == 200
    assert time.perf_counter() - began < 0.5
    assert engine.store.state("i").version > 200 and len(engine.store.vacuum("i")) > 200
    assert engine.index_docs("i", DOCS[0])["accepted"] == 1 and len(engine.store._versions("i")) == 2


def test_a_writer_of_a_pruned_version_is_told(spark, engine):
    stale = engine.store.state("i")
    engine.index_docs("i", DOCS[0])
    engine.index_docs("i", DOCS[1])
    engine.store.vacuum("i")
    with pytest.raises(FileError):
        engine.store.commit("i", stale)
    assert engine.store._versions("i") == [engine.store.state("i").version]


def test_writers_while_the_mapping_changes(engine, monkeypatch):
    """A document that was checked under an older mapping is checked again."""
    written = engine._written

    def slow(*args):
        part = written(*args)
        monkeypatch.setattr(engine, "_written", written)
        engine.update_mapping("i", ("new_field", "Bool"))
        return part

    monkeypatch.setattr(engine, "_written", slow)
    with pytest.raises(ParseError, match="new_field"):
        engine.index_docs("i", DOCS[0])
    assert engine.store.state("i").log == ()


def test_documents_are_rewritten_once_a_tier():
    sizes, rewritten, numbers = {}, 0, 0
    for k in range(1_000):
        merged = to_merge(sizes, 1, 5)
        moved = sum(sizes.pop(s) for s in merged)
        rewritten, numbers = rewritten + moved, numbers + 1
        sizes[str(numbers)] = moved + 1
        assert len(sizes) <= 5 * 4
    assert sum(sizes.values()) == 1_000 and rewritten <= 1_000 * 4
    assert to_merge({"a": 1, "b": 1, "c": 1, "d": 1, "e": 1}, 1, 5) == set("abcde")
    assert to_merge({"big": 10**9, "a": 1, "b": 1, "c": 1, "d": 1}, 1, 5) == set()


def test_twenty_flushes(spark, engine):
    for k in range(20):
        engine.index_docs("i", {"some_text": f"word{k} all", "other_field": ""})
        engine.flush()
    found = [i for i, _ in hits(engine, "all")]
    assert found == list(range(1, 21)) and [i for i, _ in hits(engine, "word7")] == [8]
    assert len(engine.store.state("i").segments) <= 6
    stats = engine.tables("i").field_stats.groupBy("field").sum("total_tokens").collect()
    assert {r[0]: r[1] for r in stats} == {"some_text": 40, "other_field": 0}


def test_rejected_documents_are_kept(spark, engine, tmp_path):
    bad = ['{"some_text":"x"}', "no json"]
    frame = spark.createDataFrame([(t,) for t in [*bad, json.dumps(DOCS[0])]], "json string")
    for k, docs in enumerate(([*bad, DOCS[0]], frame)):
        assert engine.index_docs("i", docs, "skip", rejects=f"{tmp_path}/r{k}") == {"status": "indexed", "accepted": 1, "rejected": 2}
        got = {(r.text, r.error) for r in spark.read.json(f"{tmp_path}/r{k}").collect()}
        assert got == {(bad[0], 'key "other_field" not found'), (bad[1], "the document is no JSON object")}
