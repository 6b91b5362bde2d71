"""The index of records: a stream of changes gives the tables of a full build."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import heads as H
from tessera.sources import index as I
from tessera.streaming import events as S

CHANGE = "path string, raw string, removed boolean, seq long"


def record(body="", **head):
    return f"---\n{json.dumps(head)}\n---\n{body}"


FIRST = {
    "entities/people/ana.md": record("Ana's page", id="e.ana", type="entity", canonical_name="Ana Lima", nickname="Al", aliases=["Annie", ""], epoch=2, epoch_started="2024-01", previous_epochs=[{"epoch": 1, "period": "2022-03 to 2023-12", "archived": "archive/a1.md", "summary": "then"}], links=["ep.1"]),
    "entities/people/alf.md": record(id="e.alf", type="entity", canonical_name="Alf", nickname="Al"),
    "entities/archive/old.md": record(id="e.old", type="entity", canonical_name="Old Ana", aliases=["Annie"]),
    "episodes/one.md": record("# Day\n## Claims\n| ID | Claim | Type |\n|---|---|---|\n| c1 | the medication works | reported |\n| ragged |\n| c2 | he came | |\n## More\n| c9 | no | no |\n", id="ep.1", type="episode", links="e.ana", domain_primary="work"),
    "claims/c2.md": record(id="c2", type="claim", claim_text="he came late", supporting_evidence=["ev.1"], contradicting_evidence="ev.2", linked_episodes=[], links=["ep.1"], confidence=0.75, arena_primary="status"),
    "evidence/ev1.md": record("seen", id="ev.1", type="evidence", artifact_ref="a.1", linked_claims=["c2"]),
    "artifacts/a1.md": record(id="a.1", type="artifact", linked_evidence=["ev.1"], scope=" Home "),
    "decisions/d.md": record(id="d.1", type="decision", execution_steps=[{"status": "done"}, {"status": "pending"}]),
    "confirmations/k.md": record(id="k.1", type="confirmation", task_id="d.1", status="open", created="2024-02-01"),
    "drafts/x.md": record(id="x", type="claim"),
    "drafts/x-needs_revision.md": record(id="x2", type="claim", claim_text="maybe"),
    "manifests/m.md": record(id="m", type="report"),
    "broken.md": "---\n{bad\n---\n",
    "typeless.md": record(id="t"),
    "z/twin.md": record(id="c2", type="claim", claim_text="the twin"),
}
SECOND = {
    "episodes/one.md": record("no table now", id="ep.1", type="episode", links=["e.alf", "e.ana"]),
    "entities/people/alf.md": None,
    "z/twin.md": None,
    "claims/c2.md": record("new", id="c2", type="claim", claim_text="he came early", links=["ep.9"]),
    "evidence/ev1.md": "---\nno fence any more",
    "new/n.md": record(id="n.1", type="open_loop", corrects="c2", reviewed_record_id=" d.1 "),
    "never/there.md": None,
}


def files_of(spark, texts):
    return spark.createDataFrame([(p, t) for p, t in texts.items() if t is not None], "path string, raw string").repartition(3)


def rows(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.collect())


def same(index, tables):
    for name, df in tables.items():
        assert rows(index.table(name)) == rows(df), name


def test_tables_of_a_full_build(spark, tmp_path):
    t = I.built(files_of(spark, FIRST))
    files = {r.id: r for r in t["files"].collect()}
    assert set(files) == {"e.ana", "e.alf", "e.old", "ep.1", "c2", "ev.1", "a.1", "d.1", "k.1", "x2"}
    assert files["c2"].path == "z/twin.md" and files["c2"].confidence_score == 0.5 and files["c2"].domain_primary == "cross_arena"
    assert files["d.1"].task_status == "pending" and files["a.1"].scope == "home" and files["ev.1"].source_type == "manual_note" and files["ev.1"].confidence == "medium"
    assert files["ep.1"].links == ["e.ana"] and files["ep.1"].arena == "work" and files["ana" and "e.ana"].content.endswith("Ana's page")
    links = {tuple(r) for r in t["links"].collect()}
    assert links == {("e.ana", "ep.1", "related"), ("ep.1", "e.ana", "related"), ("a.1", "ev.1", "artifact_provenance"), ("ev.1", "c2", "links_claim"), ("a.1", "ev.1", "linked_evidence")}
    claims = {r.id: r for r in t["claims"].collect()}
    assert claims["c1"].sensitivity == "requires_professional_review" and claims["c1"].episode_id == "ep.1" and claims["c2"].claim_text == "the twin" and "c9" not in claims
    assert {tuple(r) for r in t["entity_aliases"].collect()} == {("Ana Lima", None, "e.ana"), ("Annie", None, "e.ana"), ("Alf", None, "e.alf"), ("Al", "nickname", "e.alf")}
    assert sorted(tuple(r)[:3] for r in t["entity_epochs"].collect()) == [("e.alf", 0, ""), ("e.ana", 1, "2022-03"), ("e.ana", 2, "2024-01")]
    assert t["confirmations"].first().task_id == "d.1"
    assert {r.name: r.n for r in I.counts(t).collect()} == {"files": 10, "links": 5, "claims": 3, "entity_aliases": 4, "entity_epochs": 3, "confirmations": 1}
    empty = I.built(files_of(spark, FIRST).limit(0))
    assert all(df.count() == 0 for df in empty.values())


def test_a_stream_of_changes_is_a_full_build(spark, tmp_path):
    """Two runs of a stream with a restart, and a commit that is lost between writing and the end of a batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    index = I.RecordIndex(spark, str(tmp_path / "index"))
    drop = lambda name, changes: (folder / name).write_text("\n".join(json.dumps(c) for c in changes))

    def run():
        stream = S.watch_folder(spark, str(folder), CHANGE, per_trigger=1)
        q = stream.writeStream.foreachBatch(index.sink("folder")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    drop("1.json", [{"path": p, "raw": t, "removed": False, "seq": 1} for p, t in FIRST.items()])
    run()
    same(index, I.built(files_of(spark, FIRST)))
    first = index.commits()[-1]["version"]
    drop("2.json", [{"path": "claims/c2.md", "raw": "stale", "removed": False, "seq": 1}, *({"path": p, "raw": t, "removed": t is None, "seq": 2} for p, t in SECOND.items())])
    index._write(spark.createDataFrame([("half.md", record(id="h", type="claim"), False)], "path string, raw string, removed boolean"), first + 1)  # a writer died before its commit
    run()
    final = FIRST | SECOND
    same(index, I.built(files_of(spark, final)))
    assert rows(index.table("links", first)) == rows(I.built(files_of(spark, FIRST))["links"])  # readers of the old version
    again = [c["version"] for c in index.commits()]
    assert index.apply(spark.createDataFrame([("x/y.md", None, True, 9)], CHANGE), "folder", 1) is None  # a batch that is run again
    assert [c["version"] for c in index.commits()] == again
    index.compact()
    assert len(index.commits()) == 1
    same(index, I.built(files_of(spark, final)))


def test_an_index_does_not_shrink_by_accident(spark, tmp_path):
    index = I.RecordIndex(spark, str(tmp_path / "index"))
    many = {f"claims/{i}.md": record(id=f"c{i}", type="claim") for i in range(12)}
    index.build(files_of(spark, many))
    few = files_of(spark, dict(list(many.items())[:5]))
    for attempt in (lambda: index.build(few), lambda: index.build(few.limit(0)), lambda: index.apply(few.select("path", F.lit(None).cast("string").alias("raw"), F.lit(True).alias("removed")).unionByName(spark.createDataFrame([(f"claims/{i}.md", None, True) for i in range(5, 12)], "path string, raw string, removed boolean")))):
        with pytest.raises(ValueError):
            attempt()
        assert index.table("files").count() == 12
    index.build(few, force=True)
    assert index.table("files").count() == 5


def test_vectors_follow_the_records(spark, tmp_path):
    index = I.RecordIndex(spark, str(tmp_path / "index"))
    index.build(files_of(spark, FIRST))
    embed = lambda c: F.when(F.length(c) > 0, F.array(F.length(c).cast("double")))
    n = index.embed_pending(embed)
    assert n == index.vectors().count() == index.table("files").where("content <> ''").count() and index.embed_pending(embed) == 0
    index.apply(spark.createDataFrame([("evidence/ev1.md", record("seen again", id="ev.1", type="evidence"), False), ("artifacts/a1.md", None, True)], "path string, raw string, removed boolean"))
    assert {r.id for r in index.pending().where("content <> ''").collect()} == {"ev.1"}
    assert index.embed_pending(embed) == 1 and dict(map(tuple, index.vectors().collect()))["ev.1"] == [10.0]


def test_listings_and_fields(spark):
    at = "path string, modified long, length long"
    now, before = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("d", 1, 9)], at), spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 1)], at)
    assert sorted(map(tuple, I.folder_changes(now, before).collect())) == [("b", False), ("c", True), ("d", False)]
    values = [("claim_class", "Opinion", "value_statement"), ("claim_class", "self-report", "self_report"), ("claim_class", None, "interpretation"), ("claim_owner", "Me", "user"), ("claim_owner", "Wren", "external_actor"), ("claim_status", "Under  Review", "disputed"), ("claim_status", "stale", "stale"), ("claim_privacy", "public", "personal"), ("source_type", "transcript-entry", "markdown"), ("source_type", "email", "email"), ("sensitivity", "secret", "sealed"), ("sensitivity", "", "low")]
    for field, value, expected in values:
        assert spark.range(1).select(H.usual(F.lit(value).cast("string"), field)).first()[0] == expected, (field, value)
    states = [("Home", "", "environmental"), ("work", "my cat", "work"), ("x", "the teacher said", "status"), (None, "nothing", None), ("x", "Mom called", "relational")]
    for value, summary, expected in states:
        assert spark.range(1).select(H.state_category(F.lit(value).cast("string"), F.lit(summary))).first()[0] == expected
    odd = spark.createDataFrame([(None,), ("",), ("one",), ('["a", "", null, "b"]',), ("[]",), ("[1, 2]",)], "v string")
    assert [r[0] for r in odd.select(H.listed(F.col("v"))).collect()] == [[], [], ["one"], ["a", "b"], [], ["1", "2"]]


def test_side_tables_read_stored_heads(spark):
    files = spark.createDataFrame([("records/a.md", '---\n{"id": "a", "type": "claim", "summary": "s"}\n---\nbody')], "path string, raw string")
    tables = I.built(files)
    assert "json_tuple" not in tables["claims"]._jdf.queryExecution().analyzed().toString() and [r.id for r in tables["claims"].collect()] == ["a"]
