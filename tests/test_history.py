"""The edit history against plain stacks, and voxels at any time against replayed ones."""

import random

import pytest

from volspark.operators import history

LOG = "vol_id long, seq long, action string, n long"


def plain(log, steps, most_bytes):
    """{(vol, seq): (target, edits that count)}, number of undos and redos, by lists."""
    out = {}
    for vol in {v for v, *_ in log}:
        undos, redos, on = [], [], set()
        for _, seq, action, n in sorted(x for x in log if x[0] == vol):
            target = None
            if action == "edit":
                undos.append((seq, n * 6))
                redos, target = [], seq
                while len(undos) > 1 and (len(undos) > steps or sum(b for _, b in undos) > most_bytes):
                    undos = undos[1:]
            elif action == "undo" and undos:
                redos.append(undos.pop())
                target = redos[-1][0]
            elif action == "redo" and redos:
                undos.append(redos.pop())
                target = undos[-1][0]
            on = on - {target} if action == "undo" else on | ({target} - {None})
            out[vol, seq] = target, len(undos), len(redos), frozenset(on)
    return out


@pytest.fixture(scope="module")
def log():
    rng = random.Random(4)
    return [(v, s, rng.choice(["edit", "edit", "undo", "undo", "redo"]), rng.randrange(0, 30)) for v in range(6) for s in range(1, 60 if v else 400)]


@pytest.mark.parametrize(("steps", "most"), [(50, 600_000_000), (3, 600_000_000), (50, 200), (1, 1)])
def test_walk_equals_plain_stacks(spark, log, steps, most):
    """Undo and redo with nothing there, cut branches, the bound by count and by bytes, volumes of unlike lengths in any row order."""
    mixed = list(log)
    random.Random(1).shuffle(mixed)
    walked = history.walked(spark.createDataFrame(mixed, LOG).repartition(3), steps, most).cache()
    want = plain(log, steps, most)
    got = {(r["vol_id"], r["seq"]): (r["target"], r["undos"], r["redos"]) for r in walked.collect()}
    assert got == {k: v[:3] for k, v in want.items()}
    spans = history.intervals(walked).collect()
    for (vol, seq), (*_, on) in want.items():
        assert {r["edit"] for r in spans if r["vol_id"] == vol and r["since"] <= seq and (r["until"] is None or r["until"] > seq)} == on


def test_odd_rows(spark):
    """Nulls and unknown actions are left out, a null n is 0, an empty log gives no rows."""
    rows = [(1, 1, "edit", None), (None, 2, "edit", 1), (1, None, "edit", 1), (1, 3, None, 1), (1, 4, "save", 1), (1, 5, "undo", None)]
    got = [tuple(r) for r in history.walked(spark.createDataFrame(rows, LOG)).orderBy("seq").collect()]
    assert got == [(1, 1, "edit", 1, 1, 0), (1, 5, "undo", 1, 0, 1)]
    assert history.walked(spark.createDataFrame([], LOG)).count() == 0


def test_replay_at_any_time(spark):
    """An edit after an undo closes the branch; the map at a time holds the edits that count then."""
    log = spark.createDataFrame([(1, 1, "edit", 1), (1, 2, "edit", 1), (1, 3, "undo", 0), (1, 4, "edit", 1), (1, 5, "redo", 0), (1, 6, "undo", 0), (1, 7, "redo", 0)], LOG)
    edits = spark.createDataFrame([(1, 1, 0, 0, 0, 5), (1, 2, 0, 0, 0, 6), (1, 4, 1, 0, 0, 7)], "vol_id long, seq long, i int, j int, k int, label int")
    lab = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 2, 0, 0, 2)], "vol_id long, i int, j int, k int, label int")
    spans = history.intervals(history.walked(log)).cache()
    at = lambda t: {r["i"]: r["label"] for r in history.replayed(lab, edits, spans, t).collect()}
    assert at(0) == {0: 1, 2: 2} and at(2) == {0: 6, 2: 2} and at(3) == {0: 5, 2: 2}
    assert at(5) == {0: 5, 1: 7, 2: 2} and at(6) == {0: 5, 2: 2} and at(None) == {0: 5, 1: 7, 2: 2}
