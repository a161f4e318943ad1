"""Selectors, revisions and merges without Spark."""

import json
import random

import pytest

from popspark import model
from popspark.model import Definition, Delta, Lineage, ModelError, Revision, Selector, annotated, apply_revision, merged, selectors_at

DX = Selector("sel-dx", "diagnosis_code", "in", ["E11.0", "E11.1", "E11.9"], "ICD-10-CM")
AGE = Selector("sel-age", "age", "between", [40, 75])


def base():
    return Definition("Test", revision=1, selectors=(DX,), lineage=Lineage(("Warehouse",), ("claims",)), history=(Revision(1, "Create", size=3),))


def test_json_round_trip():
    d = annotated(base(), name="New", add=[AGE], remove=["sel-dx"])
    assert Definition.from_dict(json.loads(json.dumps(d.to_dict()))).selectors[0].values == [40, 75]
    back = Definition.from_dict(json.loads(json.dumps(d.to_dict())))
    assert back.history[-1].deltas[0].body.selector_id == "sel-dx" and back.lineage.source_tables == ("claims",)


def test_lineage_source_as_one_string():
    assert Definition.from_dict({"name": "x", "lineage": {"source_system": "w"}}).lineage.source_system == ("w",)


def test_bad_operator_and_between():
    with pytest.raises(ModelError):
        Selector("a", "f", "like", "x")
    with pytest.raises(ModelError):
        Selector("a", "f", "between", [1])


def test_apply_revision_needs_the_next_number():
    with pytest.raises(ModelError):
        apply_revision(base(), Revision(3))
    d = apply_revision(base(), Revision(2, deltas=(Delta("modify", "sel-dx", field="values", before=DX.values, after=["E10"]),)))
    assert d.selector("sel-dx").values == ["E10"]
    for bad in (Delta("modify", "none", field="values"), Delta("modify", "sel-dx", field="code_system"), Delta("remove", "none"), Delta("add", "sel-dx", body=DX), Delta("add", "new")):
        with pytest.raises(ModelError):
            apply_revision(base(), Revision(2, deltas=(bad,)))


def test_annotate_removes_first_and_ignores_unknown_ids():
    d = annotated(base(), add=[DX], remove=["sel-dx", "none"], description="d")
    assert [x.action for x in d.history[-1].deltas] == ["remove", "add"] and d.revision == 2 and d.description == "d"


def test_every_old_revision_can_be_rebuilt():
    rng, d, seen = random.Random(1), base(), {}
    seen[1] = d.selectors
    for i in range(2, 30):
        ids = [s.selector_id for s in d.selectors]
        deltas = []
        if ids and rng.random() < 0.4:
            gone = d.selector(rng.choice(ids))
            deltas.append(Delta("remove", gone.selector_id, body=gone))
        elif ids and rng.random() < 0.5:
            s = d.selector(rng.choice(ids))
            deltas.append(Delta("modify", s.selector_id, field="label", before=s.label, after=f"l{i}"))
        else:
            deltas.append(Delta("add", f"s{i}", body=Selector(f"s{i}", "x", "eq", i)))
        d = apply_revision(d, Revision(i, deltas=tuple(deltas)))
        seen[i] = d.selectors
    for i, s in seen.items():
        assert set(selectors_at(d, i)) == set(s) if all(not isinstance(x.values, list) for x in s) else {x.selector_id for x in selectors_at(d, i)} == {x.selector_id for x in s}
    with pytest.raises(ModelError):
        selectors_at(d, 0)
    changes = model.diff_revisions(d, 1, 29)
    assert {s.selector_id for s in changes["added"]} == {s.selector_id for s in seen[29]} - {"sel-dx"}


def test_merge_takes_first_selector_and_keeps_both_histories():
    other = Definition("B", revision=4, selectors=(Selector("sel-dx", "other", "eq", 1), AGE), lineage=Lineage(("W2",), ("claims", "rx"), None, "2024-02-01"), primary_keys=("id",), history=(Revision(1), Revision(4)))
    d = merged([("a", base()), ("b", other)], "Union of Test, B", "union", "m", "me", 6)
    assert d.revision == 5 and d.selector("sel-dx") == DX and d.primary_keys == () and d.logic == "AND"
    assert d.lineage.source_tables == ("claims", "rx") and d.lineage.extraction_date == "2024-02-01" and d.lineage.parents == ("a", "b")
    assert [(r.number, r.origin) for r in d.history] == [(1, "a"), (1, "b"), (4, "b"), (5, None)] and d.history[-1].size == 6
    with pytest.raises(ModelError, match="No input files"):
        merged([], "", "union", "", "", 0)
