from __future__ import annotations

import random

from lodestone.operators import review_log

KIND = "request_id long, seq long, kind string, action_no int, choice string, reason string, args map<string,string>, allowed array<string>"


def plain(rows):
    """The log of one request, row by row."""
    status, actions, errors, ignored, last = "none", {}, 0, 0, None
    for _, _, kind, no, choice, reason, args, allowed in sorted(rows, key=lambda r: r[1]):
        if kind == "odd" or status not in ("none", "interrupted") or (status == "none" and kind != "requested") or (kind in ("edited", "decided") and no not in actions):
            ignored += 1
            continue
        if kind == "requested":
            status, actions[no] = "interrupted", {"initial": args or {}, "args": args or {}, "allowed": allowed or [], "decision": None}
        elif kind == "resolved":
            status = "idle"
        elif kind == "edited":
            actions[no] |= {"args": {**actions[no]["args"], **(args or {})}, "decision": None}
        else:
            a = actions[no]
            offered = [d for d in ("edit", "approve", "reject") if d in a["allowed"]]
            error = "Please enter a response." if not offered else "No response selected." if choice not in offered else "Please provide a rejection reason." if choice == "reject" and not (reason or "").strip() else None
            if error:
                errors, last = errors + 1, error
                continue
            a["decision"] = "approve" if choice == "edit" and "approve" in a["allowed"] and a["args"] == a["initial"] else choice
            if all(x["decision"] for x in actions.values()):
                status = "busy"
    done = status == "busy"
    return status, done, ",".join(actions[k]["decision"] for k in sorted(actions)) if done else None, sum(a["args"] != a["initial"] for a in actions.values()), errors, ignored, last


def run(spark, rows):
    got = review_log.folded(spark.createDataFrame(rows, KIND)).collect()
    return {r.request_id: tuple(r)[1:] for r in got}


def test_random_logs_equal_the_plain_fold(spark):
    rng = random.Random(7)
    rows, seq = [], 0
    for request in range(120):
        for _ in range(rng.randint(1, 14)):
            seq += 1
            kind = rng.choice(["requested", "requested", "edited", "decided", "decided", "decided", "resolved" if rng.random() < 0.3 else "odd"])
            rows.append((request, seq, kind, rng.randint(0, 2), rng.choice(["approve", "reject", "edit", None]), rng.choice([None, " \n", " why "]), rng.choice([None, {"a": "1"}, {"a": "2", "b": None}]), rng.choice([None, [], ["approve"], ["reject", "edit", "approve"]])))
    rng.shuffle(rows)
    got = run(spark, rows)
    assert got == {k: plain([r for r in rows if r[0] == k]) for k in range(120)}
    assert {g[0] for g in got.values()} == {"none", "interrupted", "busy", "idle"}


def test_the_last_decision_of_all_actions_goes_on(spark):
    rows = [
        (1, 1, "requested", 0, None, None, {"a": "1"}, ["approve", "edit"]),
        (1, 2, "requested", 1, None, None, {}, ["reject"]),
        (1, 3, "decided", 1, "reject", " no ", None, None),
        (1, 4, "edited", 0, None, None, {"a": "2"}, None),
        (1, 5, "decided", 0, "edit", None, None, None),
        (1, 6, "decided", 0, "approve", None, None, None),
    ]
    assert run(spark, rows) == {1: ("busy", True, "edit,reject", 1, 0, 1, None)}
    assert run(spark, []) == {}
