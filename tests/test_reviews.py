"""Reviews of claims and patterns, blockers, what is due, and the report on the whole collection."""

from pyspark.sql import functions as F

from tessera.operators import reviews as W

DAY = "2024-06-30"


def test_blockers(spark):
    kind = "id string, status string, pattern_type string, created string, confidence double, links array<string>, supporting_records array<string>, counterexamples array<string>, alternative_explanations array<string>, searched boolean, strength_override boolean, override struct<enabled: boolean, reason: string, approved_by: string>"
    three = ["a", "b", "c"]
    rows = [
        ("good", "confirmed", "habit", "2024-06-01", 0.7, [], three, [], ["x"], True, None, None), ("bare", None, None, None, None, None, None, None, None, None, None, None),
        ("young", "supported", "identity_claim", "2024-06-15", 0.7, [], three, [], ["x"], True, None, None), ("waived", "supported", "habit", "2024-06-29", 0.7, [], ["a"], [], ["x"], True, True, (True, "why", "user")),
        ("badly", "supported", "habit", "2024-06-29", 0.7, [], three, [], ["x"], True, None, (True, " ", "agent")), ("grave", "stale", "habit", "2024-01-01", 0.9, ["bad"], three, [], ["x"], True, None, (False, None, None)), ("day", "skeptic_reviewed", "habit", "soon", 0.6, [], three, ["fine"], ["x"], True, None, None),
    ]
    reviews = spark.createDataFrame([("r1", p, True) for p in ("good", "young", "waived", "badly", "grave")] + [("r1", "day", True), ("r2", "day", False)], "id string, reviewed_record_id string, approved_for_use boolean")
    records = spark.createDataFrame([("bad", "skeptical_review", None, None, "high", False), ("fine", "claim", "disputed", 0.6, None, None), ("a", "claim", "active", 0.1, None, None)], "id string, type string, status string, confidence double, risk string, approved boolean")
    got = {r.id: r.blockers for r in W.pattern_blockers(spark.createDataFrame(rows, kind), reviews, records, DAY).collect()}
    assert got == {
        "good": [], "waived": [], "young": ["age<30d"], "badly": ["age<7d", "integration_override.reason_missing", "integration_override.approved_by!=user"],
        "bare": ["status=candidate", "review.approved=false", "supporting_records<3", "counterexample_search.performed=false", "missing_alternative_explanations", "confidence<0.65", "missing_created_date"],
        "grave": ["status=stale", "status_blocked=stale", "blocked_status=stale", "unresolved_high_severity_contradiction"], "day": ["review.approved=false", "confidence<0.65", "missing_created_date"],
    }


def test_reviews(spark):
    claims = spark.createDataFrame([("a", "he came"), ("b", "they targeted me, always"), ("c", "so it is"), ("d", None)], "id string, text string")
    evidence = spark.createDataFrame([("a", "e1", "Ana said so"), ("a", "e2", "it was noted"), ("c", "e3", "Bo never asked"), ("b", "e4", "nothing")], "claim_id string, id string, summary string")
    got = {r.id: (r.supporting, r.contradicting, r.confidence, r.status, r.action) for r in W.review_claims(claims, evidence).collect()}
    assert got == {"a": (2, 0, 0.8, "confirmed", "approve"), "b": (0, 0, 0.3, "disputed", "hold"), "c": (1, 1, 0.5, "disputed", "revise"), "d": (0, 0, 0.3, "disputed", "hold")}
    assert {(r.claim_id, r.id) for r in W.judged_evidence(evidence).where("stated").collect()} == {("a", "e1"), ("a", "e2"), ("c", "e3")}
    errors = {r.id: r.errors for r in W.review_claims(claims, evidence).collect()}
    assert "mind_reading" in errors["b"] and errors["d"] == ["insufficient_alternative_hypotheses"] and "overgeneralization" in errors["b"]
    long = "stress before deadlines brings late nights"
    patterns = spark.createDataFrame([("p", long, ["1", "2", "3"], ["None found"]), ("q", long, ["1", "2", "3", "4"], []), ("r", long, ["1", "2"], ["once not"]), ("s", "paranoid " + long, ["1", "2", "3", "4"], None), ("t", "he always delays", [], None), ("u", None, None, None)], "id string, hypothesis string, supporting_records array<string>, counterexamples array<string>")
    got = {r.id: (r.confidence, r.status, r.approved, r.approved_for_use) for r in W.review_patterns(patterns).collect()}
    assert got == {"p": (0.72, "skeptic_reviewed", True, True), "q": (0.78, "supported", True, True), "r": (0.39, "disputed", False, False), "s": (0.43, "disputed", False, False), "t": (0.03, "disputed", False, False), "u": (0.03, "disputed", False, False)}


def frames(spark):
    files = spark.createDataFrame([
        ("s1", "state", "state/a.md", "active", "home", "2024-06-01", "", 14, None, "2024-01-01", None), ("s2", "state", "state/b.md", "active", "job", "2024-06-25", "", 14, None, "", None), ("l1", "open_loop", "open_loops/a.md", "active", "call", "2024-06-01", "2024-06-30", None, None, "", None),
        ("l2", "open_loop", "open_loops/b.md", "active", "later", "", "2024-07-01", None, "blocked", "", None), ("l3", "open_loop", "open_loops/c.md", "active", "odd", "", "soon", None, None, "", None), ("d1", "claim", "drafts/a-needs_revision.md", "needs_revision", "draft", "", None, None, None, "", None),
        ("e1", "entity", "entities/a.md", "active", "Ana", "", None, None, None, "", "2023-01-01"), ("e2", "entity", "entities/b.md", "active", "Bo", "", None, None, "expired", "", "2024-01-01"), ("k1", "contradiction_log", "contradictions/a.md", "open", "x", "", None, None, None, "2024-01-01", None),
    ], "id string, type string, path string, status string, summary string, updated string, review_after string, ttl_days int, task_status string, created string, last_confirmed string")
    claims = spark.createDataFrame([("c1", "reported", "it is", "unresolved", "", "2024-01-01"), ("c2", "reported", "no", "disputed", "2025-01-01", "2024-06-01"), ("c3", "reported", "fine", "active", "", ""), ("c4", "reported", "new", "unresolved", "2024-06-30", "2024-06-29")], "id string, claim_type string, claim_text string, status string, review_after string, created string")
    confirmations = spark.createDataFrame([("k", "l2", "pending", None, "2024-07-02"), ("k2", "l2", "closed", "expired", ""), ("k3", "l2", "closed", "expired", "")], "id string, task_id string, status string, resolution string, expires string")
    conversations = spark.createDataFrame([("v1", None, 3, "open", "2024-06-29"), ("v2", "x", 0, None, ""), ("v3", "y", 9, "closed", "")], "id string, thread string, turns int, mode_status string, updated string")
    return files, claims, confirmations, conversations


def test_all_that_is_due(spark):
    backup = spark.createDataFrame([("2024-01-01",), ("2023-01-01",)], "at string")
    got = {(r.category, r.id): (r.summary, r.due) for r in W.review_items(*frames(spark), backup, DAY).collect()}
    assert got == {
        ("state", "s1"): ("home", "2024-06-01"), ("open_loop", "l1"): ("call", "2024-06-30"), ("claim", "c1"): ("reported | it is", "now"), ("claim", "c4"): ("reported | new", "2024-06-30"), ("draft", "d1"): ("draft", "now"), ("conversation", "v1"): ("Active conversation (3 turns)", "2024-06-29"),
        ("backup", "backup"): ("old backup", "2024-01-01"), ("pending confirmation", "k"): ("awaits approval for l2", "2024-07-02"), ("blocked task", "l2"): ("expired 2 times; task_status=blocked: later", ""), ("blocked task", "e2"): ("task_status=expired: Bo", ""),
    }
    none = W.review_items(*(f.limit(0) for f in frames(spark)), backup.limit(0), DAY)
    assert [tuple(r) for r in none.collect()] == [("backup", "backup", "no backup", "now")]
    assert [r.id for r in W.due_now(W.review_items(*frames(spark), backup, DAY), DAY).collect()] == ["backup", "c4", "c1", "v1", "d1", "l1", "s1"]


def test_the_report(spark):
    files, claims, _, _ = frames(spark)
    calls = spark.createDataFrame([(i, f"2024-06-{i:02}", i % 2 == 0) for i in range(1, 15)], "id long, at string, success boolean")
    vectors = spark.createDataFrame([("s1",), ("gone",)], "id string")
    backup = spark.createDataFrame([("2024-06-20",)], "at string")
    rows = W.health_sections(files, claims, calls, {"files": files, "claims": claims}, vectors, backup, DAY).collect()
    got = {(r.section, r.item): r.value for r in rows}
    assert len({r.section for r in rows}) == 11 and len(got) == len(rows)
    assert got[("stale domains", "s1")] == "29" and got[("open loops", "l1")] == "false" and got[("contradictions", "k1")] == "true" and {i for s, i in got if s == "claims"} == {"c1", "c2"} and {i for s, i in got if s == "entity decay"} == {"e1"}
    assert got[("manifest", "total")] == "7" and got[("backup", "days")] == "10" and got[("calls", "total")] == "14" and {i for s, i in got if s == "calls"} == {"total", "13", "11", "9", "7", "5"} and got[("index", "claims")] == "4"
    assert got[("embeddings", "vectors")] == "2" and got[("embeddings", "pending")] == "8" and got[("drafts", "total")] == "1" and got[("drafts", "blocked")] == "1" and F is not None
