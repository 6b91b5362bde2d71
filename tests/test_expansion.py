"""Expansion with budgets against a walk of one search at a time."""

import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.operators import expansion as X
from tessera.operators.rules import RELATION_ORDER

RECORD = "id string, type string, domain string, areas array<string>, blocked string"


def walked(seeds, records, edges, domains, fallback, coupled, budget=5, across=2, hops=2):
    """One search, by a queue."""
    allowed = {(s, t, r) for s, ts, rs in L.EDGE_WHITELIST for t in (ts or {x[0] for x in records.values()}) for r in rs}
    out_edges = defaultdict(set)
    for s, t, r in edges:
        if s in records and t in records and (records[s][0], records[t][0], r) in allowed:
            out_edges[s].add((RELATION_ORDER.get(records[s][0], ["links"]).index(r) if r in RELATION_ORDER.get(records[s][0], ["links"]) else 99, t, r))
    direct = dict(seeds)
    seen, taken, used, out = set(direct), set(), 0, []
    queue = deque((i, 0, [i]) for i, _ in seeds if i in records)
    while queue and len(taken) < budget:
        i, depth, path = queue.popleft()
        if depth >= hops:
            continue
        for _, t, r in sorted(out_edges[i]):
            if len(taken) >= budget:
                break
            (ts, td, _, _), (tt, dd, _, blocked) = records[i], records[t]
            row = lambda kept, reason, score=0.0: out.append((t, depth + 1, i, r, round(score, 3), kept, reason))  # noqa: B023, E731
            if blocked:
                row(False, blocked)
                seen.add(t)
                continue
            a, b = td or fallback, dd or fallback
            if a != b and "cross_arena" not in (a, b):
                spans = [{*records[p][2], records[p][1]} - {""} for p in path if records[p][0] == "pattern"]
                open_ = not td or not dd or td == dd or len(domains) > 1 or any(td in s and dd in s and len(s) > 1 for s in spans) or (td, dd) in coupled
                if not open_ or used >= across:
                    row(False, "max_cross_domain_records" if open_ else "cross_domain_bridging_not_justified")
                    seen.add(t)
                    continue
                used += 1
            if t in taken:
                continue
            row(True, f"{ts}.{r}->{tt}", max(0.1, direct.get(i, 0.0) * 0.85 + L.RELATION_BONUS.get(r, 0.15) - 0.08 * (depth + 1)))
            taken.add(t)
            if t not in seen:
                seen.add(t)
                queue.append((t, depth + 1, [*path, t]))
    return out


def test_against_a_walk(spark):
    rng = random.Random(6)
    types, doms = ["artifact", "evidence", "claim", "pattern", "episode", "entity", "decision", "open_loop"], ["work", "money", "health", "", "cross_arena"]
    records = {f"r{i:03}": (rng.choice(types), rng.choice(doms), [rng.choice(doms[:3])] if rng.random() < 0.5 else [], "quarantined" if rng.random() < 0.1 else None) for i in range(120)}
    relations = sorted({r for _, _, rs in L.EDGE_WHITELIST for r in rs})
    edges = [(f"r{rng.randrange(120):03}", f"r{rng.randrange(125):03}", rng.choice(relations)) for _ in range(6000)]
    coupled = {("work", "money"), ("money", "work")}
    searches = {f"s{k}": (["work", "money"] if k % 4 == 0 else ["work"], rng.choice(doms[:3]), [(f"r{i:03}", rng.randrange(51) / 50) for i in rng.sample(range(125), 1 + k % 4)]) for k in range(60)}
    frame = lambda rows, kind: spark.createDataFrame(rows, kind).repartition(3)
    got = X.expand(
        frame([(s, i, n, v) for s, (_, _, seeds) in searches.items() for n, (i, v) in enumerate(seeds)], "search string, id string, rank int, score double"),
        frame([(i, *r) for i, r in records.items()], RECORD), frame(edges + edges[:50], "source_id string, target_id string, relation string"), frame([(s, d, f) for s, (d, f, _) in searches.items()], "search string, domains array<string>, fallback string"), frame(list(coupled), "a string, b string"),
    ).orderBy("search", "hop", "place").collect()
    found = defaultdict(list)
    for r in got:
        found[r.search].append((r.id, r.hop, r.source, r.relation, round(r.score, 3), r.kept, r.reason))
    expected = {s: walked(seeds, records, edges, d, f, coupled) for s, (d, f, seeds) in searches.items()}
    assert {s: rows for s, rows in expected.items() if rows} == dict(found)
    reasons = {x[-1] for rows in expected.values() for x in rows}
    assert {"quarantined", "max_cross_domain_records", "cross_domain_bridging_not_justified"} < reasons and any(x[1] == 2 and x[5] for rows in expected.values() for x in rows)


def test_empty_and_paths(spark):
    empty = lambda kind: spark.createDataFrame([], kind)
    got = X.expand(empty("search string, id string, rank int, score double"), empty(RECORD), empty("source_id string, target_id string, relation string"), empty("search string, domains array<string>, fallback string"), empty("a string, b string"))
    assert got.count() == 0
    assert spark.range(1).select(X.path_text(F.array(F.lit("a"), F.lit("b")))).first()[0] == "a -> b"


def test_only_edges_that_a_search_can_come_to_are_kept(spark):
    records = spark.createDataFrame([("s", "claim", "work", [], None)] + [(f"t{i:02}", "evidence", "work" if i % 2 else "money", [], None) for i in range(40)], RECORD)
    edges = spark.createDataFrame([("s", f"t{i:02}", r) for i in range(40) for r in ("links", "supporting_evidence")], "source_id string, target_id string, relation string")
    kept = {(r.target_id, r.relation) for r in X._open_edges(edges, records, 3).collect()}
    # Targets of the source's own domain are t01, t03, t05; no search looks behind the third of them.
    assert kept == {(f"t{i:02}", "supporting_evidence") for i in range(6)}
