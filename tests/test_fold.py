"""The state machine: fixed histories, and random ones against a plain fold written apart from it."""

import random

import pytest

from tidefold.operators import fold

H = 3_600_000_000


def frame(spark, rows):
    return spark.createDataFrame([(j, i + 1, us, op, stale) for i, (j, us, op, stale) in enumerate(rows)], "job_id long, lsn long, us long, op string, stale boolean")


def states(spark, rows, **limits):
    commands = frame(spark, rows)
    folded = {r.job_id: r for r in fold.fold(commands, **limits).collect()}
    last = {}
    for r in fold.transitions(commands, **limits).orderBy("lsn").collect():
        last[r.job_id] = r
    for job, r in folded.items():
        t = last[job]
        assert (r.state, r.attempt, r.token, r.cancel_req, r.exp) == (t.state, t.attempt, t.token, t.cancel_req, t.exp)
    return folded


HISTORIES = {
    "happy path": ([("submit", 0), ("lease", 1), ("ok", 2)], "succeeded"),
    "cancel pending": ([("submit", 0), ("cancel", 1), ("lease", 2)], "cancelled"),
    "cancel leased, then done": ([("submit", 0), ("lease", 1), ("cancel", 2), ("hb", 3), ("ok", 4)], "cancelled"),
    "cancel leased, then failed": ([("submit", 0), ("lease", 1), ("cancel", 2), ("fail", 3)], "cancelled"),
    "cancelled and out of attempts": ([("submit", 0), *[x for k in range(3) for x in (("lease", 10 * k + 1), ("fail", 10 * k + 2))][:-1], ("cancel", 30), ("fail", 31)], "dead"),
    "attempts exhausted": ([("submit", 0), *[x for k in range(3) for x in (("lease", 10 * k + 1), ("fail", 10 * k + 2))]], "dead"),
    "lease runs out": ([("submit", 0), ("lease", 1), ("ok", 13 * H)], "pending"),
    "heartbeat keeps it": ([("submit", 0), ("lease", 0), ("hb", 11 * H), ("ok", 22 * H)], "succeeded"),
    "unknown job": ([("lease", 0), ("ok", 1)], "none"),
    "expiry isn't bounded by attempts": ([("submit", 0), *[("lease", 13 * H * k) for k in range(6)]], "leased"),
}


@pytest.mark.parametrize("name", HISTORIES)
def test_histories(spark, name):
    rows, state = HISTORIES[name]
    assert states(spark, [(1, us, op, False) for op, us in rows])[1].state == state


def test_stale_tokens_are_fenced(spark):
    found = states(spark, [(1, 0, "submit", False), (1, 1, "lease", False), (1, 13 * H, "lease", False), (1, 13 * H + 1, "ok", True), (1, 13 * H + 2, "ok", False)])[1]
    assert (found.state, found.token, found.accepted, found.rejected) == ("succeeded", 2, 4, 1)


def plain_fold(rows, attempts=3, ttl=12 * H):
    jobs = {}
    for job, us, op, stale in rows:
        s = jobs.setdefault(job, {"state": "none", "attempt": 0, "token": 0, "exp": 0, "creq": False, "acc": 0, "rej": 0})
        if s["state"] == "leased" and us >= s["exp"]:
            s["state"] = "cancelled" if s["creq"] else "pending"
        good = {"submit": s["state"] == "none", "lease": s["state"] == "pending", "cancel": s["state"] in ("pending", "leased")}.get(op, s["state"] == "leased" and not stale)
        s["acc" if good else "rej"] += 1
        if not good:
            continue
        match op:
            case "submit":
                s["state"] = "pending"
            case "lease":
                s.update(state="leased", attempt=s["attempt"] + 1, token=s["token"] + 1, exp=us + ttl)
            case "hb":
                s["exp"] = us + ttl
            case "ok":
                s["state"] = "cancelled" if s["creq"] else "succeeded"
            case "fail":
                s["state"] = ("cancelled" if s["creq"] else "pending") if s["attempt"] < attempts else "dead"
            case "cancel":
                s.update(creq=True) if s["state"] == "leased" else s.update(state="cancelled")
    return jobs


def test_random_histories_and_recovery_at_any_point(spark):
    rng = random.Random(5)
    rows, us = [], 0
    for _ in range(1500):
        us += rng.randrange(0, 2 * H)
        rows.append((rng.randrange(25), us, rng.choice(("submit", "lease", "lease", "hb", "ok", "fail", "cancel")), rng.random() < 0.2))
    expect = plain_fold(rows)
    found = states(spark, rows)
    assert {k: (r.state, r.attempt, r.token, r.cancel_req, r.accepted, r.rejected) for k, r in found.items()} == {k: (s["state"], s["attempt"], s["token"], s["creq"], s["acc"], s["rej"]) for k, s in expect.items()}
    commands = frame(spark, rows)
    for cut in (0, 1, 700, 1499, 1500):
        again = fold.recover(fold.fold(commands.where(f"lsn <= {cut}")), commands.where(f"lsn > {cut}"))
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, fold.fold(commands).collect()))


def test_rejections_and_empty_log(spark):
    log = fold.transitions(frame(spark, [(1, 0, "ok", False), (1, 1, "submit", False), (1, 2, "submit", False), (1, 3, "hb", False), (1, 4, "cancel", False), (1, 5, "cancel", False)]))
    assert [r.reason for r in log.orderBy("lsn").collect()] == ["not_found", None, "exists", "not_leased", None, "terminal"]
    nothing = frame(spark, [(1, 0, "ok", False)]).where("false")
    assert fold.fold(nothing).count() == fold.transitions(nothing).count() == 0
