"""Edits of annotations: what is refused and where, and what many edits at once leave."""

import json

import pytest

from markloom.sources import edits

RECT = "struct<page:int,x:double,y:double,width:double,height:double>"
NOTES = f"id string, result_id string, question_id string, rect {RECT}, extra_rects array<{RECT}>, comment string, correction string, kind string, severity string, anchor_status string, origin string, edited_by_human boolean, updated_at string, slot int"
EDITS = "edit_id int, action string, annotation_id string, result_id string, body string, at string"
BOX = {"page": 1, "x": 0.2, "y": 0.3, "width": 0.1, "height": 0.05}


@pytest.mark.parametrize(
    "action,body,errors",
    [
        ("update", "[1]", ["(root): not a JSON object"]), ("update", None, ["(root): not a JSON object"]), ("update", "{nonsense", ["(root): not a JSON object"]),
        ("update", "{}", ["(root): Provide at least one field to update."]), ("update", '{"id": "y"}', ["(root): Provide at least one field to update."]),
        ("update", '{"kind": "rude"}', ["kind: Expected one of incorrect, missing, spelling, grammar, layout, praise"]), ("update", '{"severity": null}', ["severity: Expected one of minor, major"]),
        ("update", '{"comment": null}', ["comment: Expected text"]), ("update", '{"correction": null}', []), ("update", '{"comment": ""}', []),
        ("update", json.dumps({"rect": BOX | {"x": 1.2, "page": -1}}), ["rect.page: Expected a whole number, 0 or more", "rect.x: Expected a number from 0 to 1"]),
        ("update", json.dumps({"rect": BOX | {"page": 0.5}}), ["rect.page: Expected a whole number, 0 or more"]), ("create", '{"comment": "no box"}', ["rect: Required"]),
        ("create", json.dumps({"rect": {"page": 0, "x": 0, "y": 0, "width": 1}}), ["rect.height: Expected a number from 0 to 1"]), ("create", json.dumps({"rect": BOX}), []),
        ("delete", None, []), ("paint", "{}", ["action: Expected one of create, update, delete"]),
    ],
)
def test_checks(spark, action, body, errors):
    got = edits.checked(spark.createDataFrame([(1, action, "a", "r", body, "t")], EDITS)).first()
    assert list(got.errors) == errors


def test_many_edits_at_once(spark):
    old = (0, 0.1, 0.1, 0.2, 0.2)
    notes = spark.createDataFrame([(i, "r", "q1", old, [old], f"about {i}", "fix", "incorrect", "minor", "fuzzy", "ai", False, "t0", k) for k, i in enumerate("abcd")], NOTES)
    rows = [
        (1, "update", "a", "r", '{"comment": "first", "severity": "major"}', "t1"), (2, "update", "a", "r", '{"comment": "second", "correction": null}', "t2"),
        (3, "update", "b", "r", json.dumps({"rect": BOX}), "t1"), (4, "delete", "c", "r", None, "t2"), (5, "update", "c", "r", '{"comment": "too late"}', "t3"), (6, "update", "c", "r", '{"comment": "in time"}', "t1"),
        (7, "update", "nobody", "r", '{"comment": "x"}', "t1"), (8, "create", "new", "r", json.dumps({"rect": BOX, "comment": "mine", "questionId": "q2"}), "t1"), (9, "update", "new", "r", '{"kind": "praise"}', "t2"),
        (10, "update", "new", "r", '{"kind": "missing"}', "t0"), (11, "create", "a", "r", json.dumps({"rect": BOX}), "t4"), (12, "create", "brief", "r", json.dumps({"rect": BOX}), "t1"), (13, "delete", "brief", "r", None, "t2"), (14, "update", "d", "r", '{"kind": "rude"}', "t1"),
    ]
    after, outcomes = edits.apply_edits(notes, spark.createDataFrame(rows, EDITS))
    got = {r.id: r for r in after.collect()}
    assert after.columns == notes.columns and sorted(got) == ["a", "b", "d", "new"]
    assert (got["a"].comment, got["a"].severity, got["a"].correction, got["a"].updated_at, got["a"].edited_by_human, len(got["a"].extra_rects)) == ("second", "major", None, "t2", True, 1)
    assert tuple(got["b"].rect) == (1, 0.2, 0.3, 0.1, 0.05) and got["b"].extra_rects == [] and got["b"].comment == "about b" and got["b"].slot == 1
    assert tuple(got["d"])[:8] == ("d", "r", "q1", got["d"].rect, got["d"].extra_rects, "about d", "fix", "incorrect") and not got["d"].edited_by_human and got["d"].updated_at == "t0"
    new = got["new"]
    assert (new.result_id, new.question_id, new.comment, new.kind, new.severity, new.anchor_status, new.origin, new.edited_by_human, new.slot) == ("r", "q2", "mine", "praise", "major", "exact", "human", True, None)
    fates = {r.edit_id: r.outcome for r in outcomes.collect()}
    assert fates == {1: "applied", 2: "applied", 3: "applied", 4: "applied", 5: "not_found", 6: "applied", 7: "not_found", 8: "applied", 9: "applied", 10: "not_found", 11: "not_found", 12: "applied", 13: "applied", 14: "invalid"}
    same, none = edits.apply_edits(notes, spark.createDataFrame([], EDITS))
    assert sorted(map(str, same.collect())) == sorted(map(str, notes.collect())) and none.count() == 0
