"""Records, transcripts and streams on small files."""

from pyspark.sql import functions as F

from tessera.sources import records as R
from tessera.streaming import events as S


def test_records(spark, tmp_path):
    (tmp_path / "a").mkdir()
    files = {"a/one.md": '---\n{"id": "e1", "type": "entity", "links": ["c1", ""], "aliases": ["Al"]}\n---\nbody\n## Claims\n| id | text |\n|---|---|\n| c1 | it holds |\n| ragged |\n', "two.md": "---\n{bad\n---\nx", "three.md": "--- no fence", "four.md": "plain", "five.md": "---\n[1]\n---\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    parsed = R.parse_records(R.scan_folder(spark, str(tmp_path))).cache()
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in parsed.collect()}
    assert errors == {"one.md": None, "two.md": "bad json", "three.md": "no fence", "four.md": None, "five.md": "no object"}
    sides = R.side_tables(parsed)
    assert [tuple(r) for r in sides["links"].collect()] == [("e1", "c1", "related")]
    assert [tuple(r) for r in sides["entity_aliases"].collect()] == [("Al", "e1")]
    assert [r.cells for r in R.claims_table(parsed).collect()] == [{"id": "c1", "text": "it holds"}]
    one = parsed.where("fm.id = 'e1'")
    again = R.parse_records(one.select("path", R.render(F.col("fm"), F.col("body")).alias("raw"))).first()
    assert again.fm.id == "e1" and again.body.startswith("body")


def test_upsert_and_manifest(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, R.upsert(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    manifest = spark.createDataFrame([("p", "1", "t0", "t0", "new"), ("q", "2", "t0", "t0", "new")], "path string, sha256 string, first_seen string, last_seen string, status string")
    seen = spark.createDataFrame([("p", "9", "t1"), ("r", "3", "t1")], "path string, sha256 string, at string")
    assert {r.path: (r.first_seen, r.status) for r in R.merge_manifest(manifest, seen).collect()} == {"p": ("t0", "changed"), "q": ("t0", "missing"), "r": ("t1", "new")}


def test_transcripts(spark):
    raw = "## Conversation — 10:30 [c9]\nUSER: hello\nmore of it\nAGENT: yes\n\n## Conversation — 11:00 [c10]\nUSER: bye"
    files = spark.createDataFrame([("t.md", raw)], "path string, raw string")
    got = [(r.conv_id, r.time, r.speaker, r.text) for r in R.parse_transcripts(files).orderBy("line").collect()]
    assert [(a, b, c, d.strip()) for a, b, c, d in got] == [("c9", "10:30", "USER", "hello\nmore of it"), ("c9", "10:30", "AGENT", "yes"), ("c10", "11:00", "USER", "bye")]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = ['{"ts": "2024-01-01T00:00:00Z", "event_type": "a", "value": 1.0, "k": 1}', '{"ts": "2024-01-01T00:05:00Z", "event_type": "a", "value": 2.0, "k": 1}', '{"ts": "2024-01-01T00:12:00Z", "event_type": "a", "value": 4.0, "k": 2}', '{"ts": "2024-01-01T05:00:00Z", "event_type": "b", "value": 0.0, "k": 3}']
    (folder / "x.json").write_text("\n".join(rows))
    schema = "ts timestamp, event_type string, value double, k int"

    def run(make, name):
        stream = make(S.watch_folder(spark, str(folder), schema))
        q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return spark.sql(f"SELECT * FROM {name}").collect()

    assert sorted(r.k for r in run(lambda s: S.drop_repeats(s, ["k"]), "once")) == [1, 2, 3]
    assert sorted((r.event_type, r.n, r.total) for r in run(S.tumbling_counts, "windows")) == [("a", 1, 4.0), ("a", 2, 3.0)]
    turns = lambda s: S.drop_repeated_turns(s.select(F.lit(1).cast("long").alias("conv_id"), F.lit("u").alias("speaker"), "ts", F.col("event_type").alias("text")))
    assert [r.text for r in sorted(run(turns, "turns"), key=lambda r: r.ts)] == ["a", "b"]
