"""Folders of notes as a data source, chunks by headings, and routes of notes."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, Not, StringStartsWith

from tessera.functions import chunks as C
from tessera.operators import ingest as G
from tessera.sources import notes as N


@pytest.fixture
def folder(tmp_path):
    for name, text in {"a/one.md": "1", "a/two.md": "zwei ü", "b/three.MD": "3" * 50, "b/.hidden.md": "h", "secrets/x.md": "s", ".git/y.md": "g", "b/k.pem": "k", "b/t.txt": "t", "a/.env.md": "e"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_only_wanted_files_are_opened(spark, folder):
    N.register(spark)
    read = lambda **o: spark.read.format("notes").options(**o).load(str(folder))
    rows = {r.path: (r.name, r.length, r.raw) for r in read().collect()}
    assert rows == {"a/one.md": ("one.md", 1, "1"), "a/two.md": ("two.md", 7, "zwei ü"), "b/three.MD": ("three.MD", 50, "3" * 50)}
    assert {r.path for r in read(endings="", hidden="true").collect()} == {*rows, "b/.hidden.md", "b/t.txt"}
    assert read(taskBytes="5").rdd.getNumPartitions() == 3
    for wanted, paths in (("path LIKE 'b/%'", ["b/three.MD"]), ("path = 'a/one.md'", ["a/one.md"]), ("path IN ('a/two.md', 'x')", ["a/two.md"]), ("name LIKE 't%' AND length < 10", ["a/two.md"]), ("path LIKE '%tw%'", ["a/two.md"])):
        assert [r.path for r in read().where(wanted).collect()] == paths, wanted
    assert read().where("path = 'none'").count() == 0
    assert [r.path for r in read().where("path LIKE 'a/%' AND path <> 'a/one.md'").collect()] == ["a/two.md"]
    reader = N.NotesReader({"path": str(folder)})
    left = list(reader.pushFilters([StringStartsWith(("path",), "a/"), Not(EqualTo(("name",), "one.md")), EqualTo(("raw",), "x"), GreaterThan(("length",), 1)]))
    assert [f.attribute for f in left] == [("raw",)] and [f[0] for p in reader.partitions() for f in p.files] == ["a/two.md"]  # the tasks know no other file
    plan = read().where("path LIKE 'b/%' AND raw LIKE '3%'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "StartsWith(path" not in plan.split("BatchScan")[0]


def test_headings():
    for line, found in {"# A b ": (1, "A b"), "### x": (3, "x"), "#x": None, "1.2 Two words": (2, "1.2 Two words"), "1 Ends here.": None, "3 lower": None, "ALL CAPS LINE": (2, "All Caps Line"), "ABC": None, "": None, "1.1.1.1.1.1.1 Deep": (6, "1.1.1.1.1.1.1 Deep")}.items():
        assert C.heading(line) == found, line


def test_chunks():
    words = lambda n, w="w": " ".join([w] * n)
    text = f"{words(3)}\n# One\n{words(250)}\n--- Page 4 ---\nmore\n--- page 6 ---\n## Sub\n{words(5)}\n# Title\n{words(2)}\n# Two\n## Empty\n### Deep\n{words(300)}\n\n{words(900)}\n\n{words(800)}"
    got = C.chunks_of(text, "Title")
    assert [(t, b, r) for t, _, b, r in got] == [
        ("One", "Title > One", "Title, Title > One, pages 4-6"),
        ("Deep (part 1 of 2)", "Title > Two > Empty > Deep > part 1 of 2", "Title, Title > Two > Empty > Deep, part 1 of 2"),
        ("Deep (part 2 of 2)", "Title > Two > Empty > Deep > part 2 of 2", "Title, Title > Two > Empty > Deep, part 2 of 2"),
    ]
    assert got[0][1].startswith("## Title\nw w w\n\nw") and got[1][1].startswith("## Sub\nw w w w w\n\n## Title\nw w\n\nw")
    assert C.chunks_of(None, None) == C.chunks_of(" \n", "x") == [] and C.chunks_of("one two", None) == [("document", "one two", "document", "document")]
    window = C.chunks_of(words(1700), "T", "base")
    assert [len(b.split()) for _, b, _, _ in window] == [800, 800, 300] and window[2][3] == "base, segment 3" and window[0][0] == "T — segment 1"
    assert len(C.chunks_of(words(801), "T")) == 2 and len(C.chunks_of(words(1500), "T")) == 2
    assert C.chunks_of("# Only\n", "T") == [] and C.chunks_of("--- Page 2 ---\nx", "T")[0][1] == "--- Page 2 ---\nx"


def test_chunks_of_tables(spark):
    rows = spark.createDataFrame([(1, "# A\nx y", "mine"), (2, None, "mine"), (3, "", "mine"), (4, "# A\nx y", "mine")], "id long, text string, body string").withColumn("row", F.lit("own"))
    got = C.chunked(rows, F.col("text"), F.concat(F.lit("d"), "id"), least=1).orderBy("id").collect()
    assert [(r.id, r.title, r.body, r.breadcrumb, r.chunk_index, r.total_chunks, r.row) for r in got] == [(i, "A", "x y", f"d{i} > A", 0, 1, "own") for i in (1, 4)]
    assert C.chunked(rows.limit(0), F.col("text"), F.lit("t")).count() == 0


def test_listing_and_reasons(spark, folder):
    N.register(spark)
    listed = spark.read.format("notes").option("content", "false").option("endings", "").option("hidden", "true").load(str(folder))
    got = {r.path: r.reason for r in listed.select("path", G.skip_reason(F.col("path"), F.col("length"), most_bytes=40).alias("reason")).collect()}
    assert got == {"a/one.md": None, "a/two.md": None, "b/three.MD": "too large", "b/.hidden.md": "hidden", "secrets/x.md": "secret store", ".git/y.md": "excluded folder", "b/k.pem": "secret file", "b/t.txt": None, "a/.env.md": "secret file"}
    assert listed.where("raw IS NOT NULL").count() == 0


def test_note_routes(spark):
    notes = {"people/ana-lima.md": ("entity", "person", "Ana Lima"), "people/dealing-with-dana.md": ("knowledge", None, None), "people/people-index.md": ("knowledge", None, None), "2024-01-02.md": ("episode", None, None), "x/McX.md": ("knowledge", None, None), "Pets/x/rex.markdown": ("entity", "pet", "Rex"), "places/a of b.md": ("entity", "place", "A Of B"), "people/me-self.md": ("knowledge", None, None), "people/pic.png": ("knowledge", None, None)}
    frame = spark.createDataFrame([(p, "text") for p in notes] + [("people/no.md", " \n"), ("people/nil.md", None)], "path string, raw string").withColumn("name", F.lit("own"))
    got = {r.path: (r.route, r.kind, r.name) for r in G.note_routes(frame, ["Me Self"]).collect()}
    assert got == notes | {"people/no.md": ("empty", None, None), "people/nil.md": ("empty", None, None)}


def test_documents_replace_their_chunks(spark):
    docs = lambda *rows: spark.createDataFrame(rows, "document string, text string")
    none = spark.createDataFrame([], "document string, chunk_index long, title string, body string, breadcrumb string, source_ref string")
    first = G.documents_taken_in(none, docs(("a", " ".join(["w"] * 900)), ("b", "one"), ("n", None)))
    assert sorted((r.document, r.chunk_index) for r in first.collect()) == [("a", 0), ("a", 1), ("b", 0)]
    again = G.documents_taken_in(first, docs(("a", "short"), ("c", "new")), "replace")
    assert sorted((r.document, r.chunk_index) for r in again.collect()) == [("a", 0), ("b", 0), ("c", 0)]
    with pytest.raises(ValueError):
        G.documents_taken_in(first, docs(("a", "short")))


def test_chunks_are_held_for_few_texts_at_a_time(spark):
    texts = pa.array([None, "a b " * 400_000, "", *["word " * 20_000] * 30])
    parts = list(C._slices((texts, texts)))
    assert [len(p[0]) for p in parts[:2]] == [1, 1] and all(len(p[0]) <= 6 for p in parts) and pa.concat_arrays([p[0] for p in parts]) == texts
    C.chunked(spark.createDataFrame([("a", "t")], "text string, title string"), F.col("text"), F.col("title"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
