"""Replaying a log against a plain loop, with one relation that holds most actions."""

import numpy as np
import pytest

from siltstone.operators import action_log as L
from siltstone.operators import ordered


@pytest.mark.parametrize("pieces", [1, 7])
def test_log_in_pieces_is_the_log_in_order(spark, monkeypatch, pieces):
    monkeypatch.setattr(ordered, "PIECES", pieces)
    rng = np.random.default_rng(8)
    relations = [(1, 2, "None", 0.5, "AIGenerated", "ContentSimilar"), (1, 3, "Confirmed", 0.4, "AIGenerated", "SameProject"), (3, 1, None, 0.3, "User", "SameProject"), (9, 9, "Rejected", 0.1, "AIGenerated", "SameProject")]
    names = [*L.FEEDBACK, "Nonsense"]
    actions = [(1, 2 if rng.random() < 0.8 else 3, int(t), i, names[int(rng.integers(0, 5))], float(rng.normal()), "FilePair" if i % 2 else None) for i, t in enumerate(rng.integers(0, 50, 500))]
    actions += [(3, 1, 5, 900, "Adjusted", 7.0, None), (3, 1, 6, 901, "Rejected", None, "TagPair"), (3, 1, 7, 902, "Adjusted", 0.2, None), (8, 8, 1, 903, "Confirmed", None, None)]
    batches = [(1, 25, 1000, None, True), (3, 30, 1001, ["SameProject"], False), (9, 1, 1002, ["ContentSimilar"], True)]
    rel = spark.createDataFrame(relations, "source long, target long, feedback string, strength double, origin string, kind string")
    act = spark.createDataFrame(actions, "source long, target long, ts long, action_id long, action string, value double, scope string").repartition(4)
    bat = spark.createDataFrame(batches, "file long, ts long, action_id long, kinds array<string>, block boolean")
    every = L.with_batches(act, bat, rel)
    done = L.replay(rel, every)
    out = {(r.source, r.target): (r.feedback, r.strength, r.refused) for r in L.corrected(rel, done).collect()}

    log = list(actions)
    for file, ts, i, kinds, _ in batches:
        log += [(s, t, ts, i, L.BATCH, None, None) for s, t, _, _, origin, kind in relations if origin == "AIGenerated" and file in (s, t) and (kinds is None or kind in kinds)]
    want, rules = {}, {("FileAllAI", 1, None), ("FileAllAI", 9, None)}
    for s, t, feedback, strength, *_ in relations:
        state, refused = feedback or "None", 0
        for _, _, _, _, action, value, scope in sorted((a for a in log if a[:2] == (s, t)), key=lambda a: a[2:4]):
            if action == L.BATCH:
                state = "Rejected"
            elif (state, action) in L.TRANSITIONS:
                state = action
                strength = min(1.0, max(0.0, value)) if action == "Adjusted" else strength
                if action == "Rejected" and scope:
                    rules.add((scope, s % 10 if scope == "TagPair" else s, t if scope == "FilePair" else t % 10))
            else:
                refused += 1
        want[s, t] = (state if any(a[:2] == (s, t) for a in log) else feedback, strength, refused)
    assert out == want
    assert {tuple(r) for r in L.new_rules(done, bat).collect()} == rules
