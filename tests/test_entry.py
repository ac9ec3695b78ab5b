"""The entry's queries where the training-data operators can't be imported."""

import importlib
import sys

import __spark_entry__ as entry


def test_entry_without_training_data(monkeypatch):
    every = set(entry.queries())
    try:
        monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
        bare = importlib.reload(entry)
        assert not [q for q in bare.queries() if q.startswith("op") and q[2].isdigit() or q == "pipeline"]
        assert {"gate_verdict", "minutes_motions"} <= set(bare.queries()) < every or "pipeline" not in every
        assert set(bare.oracle_sql()) <= set(bare.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
    assert set(entry.queries()) == every
