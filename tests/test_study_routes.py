"""Study routes in the order of their prerequisites."""

from __future__ import annotations

from corpusflow.operators import graph_search as G
from corpusflow.plans import registry

registry.load()


def test_routes_follow_prerequisites(spark):
    notes = [("d", "n1", 5, False, False), ("d", "n2", 5, True, False), ("d", "n3", 5, False, True), ("d", "n4", 5, True, False), ("x", "n1", 7, False, False), ("x", "n2", 1, False, True), ("x", "n3", 1, False, False), ("d", "n2", 5, True, False)]
    edges = [("d", "n4", "n1"), ("d", "n1", "n3"), ("d", "n3", "n2"), ("d", "gone", "n4"), ("x", "n1", "n2"), ("x", "n2", "n1"), ("x", "n3", "n3")]
    df = spark.createDataFrame(notes, "domain string, note_id string, minutes long, practice boolean, self_test boolean"), spark.createDataFrame(edges, "domain string, a string, b string")
    steps = {(r.domain, r.step): r.note_id for r in G.study_routes(*df).collect()}
    assert steps == {("d", 1): "n4", ("d", 2): "n1", ("d", 3): "n3", ("d", 4): "n2", ("x", 1): "n3", ("x", 2): "n1", ("x", 3): "n2"}
    got = {r.domain: (r.steps, r.minutes, r.checkpoint, r.checkpoint_type) for r in G.gr_study_routes(*df).collect()}
    assert got == {"d": (4, 20, 1, "practice"), "x": (3, 9, 3, "auto-eval")}
