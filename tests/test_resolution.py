"""References, merge chains, causes, near positions, and the matching of names."""

import random
import re

from pyspark.sql import functions as F

from tessera.operators import matching as M
from tessera.operators import priors as P
from tessera.operators import references as R

RECORD = "id string, path string, type string, names array<string>, claim_text string, merged_into string"


def end_of(merges, i):
    seen, at = set(), i
    while at in merges:
        if at in seen:
            return None
        seen.add(at)
        at = merges[at]
    return at


def test_chains_and_circles(spark):
    rng = random.Random(3)
    merges = {str(i): str(rng.randrange(60)) for i in range(50)} | {f"c{i}": f"c{i + 1}" for i in range(40)} | {"k0": "k1", "k1": "k2", "k2": "k3", "k3": "k1"}
    merges = {a: b for a, b in merges.items() if a != b}
    rows = [*merges.items(), ("x", "x"), ("y", " "), (None, "z"), ("z", None), ("c0", "c1")]
    got = {r.id: r.survivor for r in R.survivors(spark.createDataFrame(rows, "id string, into string")).collect()}
    assert got == {i: end_of(merges, i) for i in merges} and None in got.values() and got["c0"] == "c40"
    assert R.survivors(spark.createDataFrame([], "id string, into string")).count() == 0


def test_references(spark):
    records = spark.createDataFrame([
        ("e.ana", "entities/people/ana.md", "entity", ["Ana Lima", "Al", None], None, None), ("e.alf", "entities/alf.md", "entity", ["Alf", "Al"], None, None),
        ("e.old", "archive/ana-old.md", "entity", ["Oldie"], None, "e.mid"), ("e.mid", "archive/mid.md", "entity", ["Mid"], None, "e.ana"), ("e.lost", "archive/l.md", "entity", [], None, "gone"),
        ("c.1", "claims/one.md", "claim", None, "he never  came home", None), ("c.2", "claims/two.md", "claim", None, "it is so, they say", None), ("c.3", "claims/three.md", "claim", None, "it is so, they say", None),
        ("d.1", "drafts/x.md", "claim", None, None, None), ("ep", "episodes/one.md", "episode", None, None, None), (" ", "claims/none.md", "claim", None, None, None), ("o1", "state/o.md", "state", None, None, "o2"), ("o2", "state/p.md", "state", None, None, "o1"),
    ], RECORD)
    expected = {
        "e.ana": ("id", "e.ana"), " e.ana ": ("id", "e.ana"), "e.old": ("merged", "e.ana"), "e.lost": ("id", "e.lost"), "o1": ("id", "o1"), "drafts/x.md": ("unindexed", None), "transcripts/t.md": ("unindexed", None),
        "entities/alf.md": ("path", "e.alf"), "he never came home": ("claim_text", "c.1"), "it is so, they say": ("prose", None), "Some sentence.": ("prose", None), "- point": ("prose", None), "x" * 201: ("prose", None),
        "some/where/two.md": ("basename", "c.2"), "a/one.md": ("unknown", None), "people/ANA_lima.md": ("alias", "e.ana"), "Al": ("unknown", None), "alf": ("alias", "e.alf"), "Mid": ("unknown", None), "archive/mid.md": ("path", "e.mid"), "nobody": ("unknown", None), "": ("unknown", None), None: ("unknown", None),
    }
    refs = spark.createDataFrame([(x,) for x in expected], "ref string")
    files = spark.createDataFrame([("transcripts/t.md",)], "path string")
    assert {r.ref: (r.kind, r.target) for r in R.resolve(refs, records, files).collect()} == expected
    lists = spark.createDataFrame([("r1", ["e.old", "alf", "nobody", "e.ana", None, "alf"]), ("r2", []), ("r3", None), ("r4", ["nobody"])], "id string, refs array<string>")
    got = {r.id: (r.kept, r.dropped) for r in R.canonical_lists(lists, records, files).collect()}
    assert got == {"r1": (["e.ana", "e.alf"], ["nobody", None]), "r2": ([], []), "r3": ([], []), "r4": ([], ["nobody"])}


def test_causes(spark):
    entities = spark.createDataFrame([("p1", "person", ["Mara Holt", "Mo"]), ("p2", "Person", ["Ben"]), ("o1", "organization", ["The Board"]), ("t1", "concept", ["late"]), ("n", "person", None)], "id string, subtype string, names array<string>")
    assert {tuple(r) for r in P.roster(entities).collect()} == {("p1", "mara holt"), ("p1", "mara"), ("p2", "ben"), ("o1", "the board")}
    far = "x" * 95
    rows = [("a", "Ben was late because of Mara and Ben", "2024-02-01"), ("b", "ben left due to mara holt; Ben stayed due to Mara", "2024-01-01"), ("c", "Mara said Ben was late due to mara", ""), ("d", f"ben {far} due to mara", "2023"), ("e", f"ben due to {far} mara", "2023"), ("f", "Ben had no say. Mara was told to go", None), ("g", "ben didn't choose", "2024"), ("h", "BEN went along with it", "2025"), ("i", "because of", "1"), ("j", None, "1")]
    got = {(r.kind, r.subject, r.agent): (r.support, r["first"], r["last"]) for r in P.causes(spark.createDataFrame(rows, "id string, text string, stamp string"), entities, 1).collect()}
    assert got == {("pairwise", "p2", "p1"): (3, "2024-01-01", "2024-02-01"), ("non_originating", "p2", None): (3, "2024", "2025")}
    assert P.causes(spark.createDataFrame(rows, "id string, text string, stamp string"), entities, 4).count() == 0


def test_positions_and_band_join(spark):
    text = "ab due to x due to due to"
    frame = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    assert frame.select(P.positions_of(F.col("t"), "due to").alias("p")).first().p == [m.start() for m in re.finditer("due to", text)]
    rng = random.Random(5)
    a, b = ([(rng.choice("gh"), rng.randrange(2000), n) for n in range(300)] for _ in range(2))
    make = lambda rows: spark.createDataFrame(rows, "doc string, at long, n long")
    got = sorted((r.a.n, r.b.n) for r in P.near_pairs(make(a), make(b), "doc", "at", 90).collect())
    assert got == sorted((x[2], y[2]) for x in a for y in b if x[0] == y[0] and abs(x[1] - y[1]) <= 90)


ENTITY = "id long, subtype string, names array<string>, nickname string, disambiguation string, summary string"


def test_matching_of_names(spark):
    entities = spark.createDataFrame([
        (1, "person", ["Ana Lima"], "Al", None, None), (2, "person", ["Bea Lima"], None, None, None), (3, "place", ["Harbour House"], None, None, "by Lima street"),
        (4, "project", ["Deck"], None, None, "the deck by harbour"), (5, "project", ["Roof"], None, "harbour", None), (6, "pet", ["Rex"], None, None, None),
    ], ENTITY)
    asked = {
        ("ana lima ", "person"): (1, "full"), ("Ana Lima", "place"): (1, "full"), ("Harbour House dinner (june)", "place"): (3, "base"), ("Ana", "person"): (1, "token"), ("Lima", "person"): (None, None),
        ("Lima Ana Lima", "person"): (None, None), ("Old Bea Lima", "person"): (None, None), ("Bea Stone", "person"): (None, None), ("Ana Bea Lima", "place"): (None, None), ("Old Harbour House", "place"): (3, "words"), ("House", "place"): (3, "token"),
        ("Deck harbour", "project"): (4, "residue"), ("Deck street", "project"): (None, None), ("al", "person"): (1, "residue"), ("Ana-Lima", "pet"): (None, None), ("", "person"): (None, None), (None, "person"): (None, None),
    }
    frame = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(asked)], "proposal long, name string, subtype string")
    got = {(r.name, frame_type): (r.id, r.stage) for r in M.match_entities(frame, entities).collect() for frame_type in [list(asked)[r.proposal][1]]}
    assert got == asked
    assert M.match_entities(frame.limit(0), entities).count() == 0


def test_names_one_edit_apart(spark):
    rng = random.Random(9)
    names = {"".join(rng.choice("abé ") for _ in range(rng.randint(0, 6))) for _ in range(250)}
    plain = {n.strip() for n in names} - {""}
    frame = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")

    def one(a, b):
        a, b = sorted((a, b), key=len)
        return a != b and any(a == b[:i] + b[i + 1 :] or len(a) == len(b) and a[:i] + a[i + 1 :] == b[:i] + b[i + 1 :] for i in range(len(b)))

    assert {tuple(r) for r in M.near_names(frame).collect()} == {(a, b) for a in plain for b in plain if a < b and one(a, b)}
    held = spark.createDataFrame([(1, "Marta Holt"), (2, "Martha Holm"), (3, "rex"), (4, "tim"), (5, "tom")], "id long, name string")
    asked = spark.createDataFrame([(1, "Martha Holt"), (2, "Rax"), (3, "Tam"), (4, "Marta Holt")], "proposal long, name string")
    assert {(r.proposal, r.id) for r in M.misspelt(asked, held).collect()} == {(1, 1), (2, 3)}


def test_references_meet_records_by_sorting(spark):
    """Tables that grow with the records are not sent whole to the driver and each task, however small they look."""
    from tessera.operators import references as R

    records = spark.createDataFrame([("r1", "claims/1/a.md", "claim", ["A"], "it holds that one fits", None), ("r2", "entities/2/b.md", "entity", ["B c"], None, "r1")], "id string, path string, type string, names array<string>, claim_text string, merged_into string")
    lists = spark.createDataFrame([("x", ["r2", None, "b.md", "it holds that one fits", "b-c", "claims/1/a.md", "no"])], "id string, refs array<string>")
    found = R.canonical_lists(lists, records)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    row = found.first()
    assert row.kept == ["r1", "r2"] and row.dropped == [None, "no"]


def test_names_of_one_kind_meet_texts_once(spark):
    names = spark.createDataFrame([(f"e{k}", f"supplier#{i:09}") for i in range(300) for k in (i, i + 300, i + 600)] + [("short", "abc")], "id string, name string")
    texts = [f"by supplier#{i:09} and abc" for i in range(0, 300, 7)] + ["supplier#00000001", ""]
    found = {r.text: [(x.place, x.entity) for x in r.found] for r in P._named(spark.createDataFrame([(t,) for t in texts], "text string"), names).collect()}
    assert found == {t: [*((3, e) for e in sorted(f"e{k}" for k in (i, i + 300, i + 600))[:2]), (t.index("abc"), "short")] for i, t in zip(range(0, 300, 7), texts)}
