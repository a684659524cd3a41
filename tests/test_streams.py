"""Streams: registry entries as state, folders as snapshots."""

import json
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import catalog, order
from quire.sources import files
from quire.streaming import registry as keyed
from quire.streaming.snapshot import Snapshot, changed_folders

START = datetime(2026, 1, 1)
STATUSES = ["update-available", "unchanged", "stale", "skipped", "regenerated"]


def entries(spark, n=5):
    rows = [(f"e{i}", f"/x/e{i}", "personal" if i % 2 else "project", None if i % 3 else START, i % 2 == 0) for i in range(n)]
    return rows, spark.createDataFrame(rows, "name string, skill_path string, scope string, last_check timestamp, update_available boolean")


def put(folder, number, outcomes):
    folder.mkdir(exist_ok=True)
    (folder / f".{number}").write_text("\n".join(json.dumps(dict(zip(("scope", "name", "status", "at"), (*o[:3], o[3] and f"{o[3].isoformat()}Z"), strict=True))) for o in outcomes))
    (folder / f".{number}").rename(folder / f"{number}.json")


def model(rows, arrivals):
    """Outcomes one by one: those not later than the last applied say nothing."""
    state = {(scope, name): [check, flag, None] for name, _, scope, check, flag in rows}
    for batch in arrivals:
        for scope, name, status, at in sorted((o for o in batch if None not in o), key=lambda o: (o[3], o[2])):
            own = state.get((scope, name))
            if own and (own[2] is None or at > own[2]):
                own[2] = at
                if status != "skipped":
                    own[0] = at
                    own[1] = own[1] if status == "stale" else status == "update-available"
    return {k: tuple(v[:2]) for k, v in state.items()}


def test_late_and_repeated_outcomes_over_restarts(spark, tmp_path):
    rng = random.Random(4)
    rows, registry = entries(spark)
    arrivals = []
    for n in range(3):
        batch = [(*rng.choice([("project", "e0"), ("personal", "e1"), ("project", "e2"), ("personal", "none")]), rng.choice(STATUSES), START + timedelta(hours=rng.randrange(-30, 60))) for _ in range(12)]
        arrivals.append(batch + (arrivals[0][:4] if arrivals else [("project", "e4", None, START), ("project", None, "stale", START), ("project", "e4", "stale", None)]))
        put(tmp_path / "in", n, arrivals[-1])
        keyed.follow(keyed.outcome_files(spark, str(tmp_path / "in")), registry, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
        now = {(r.scope, r.name): (r.last_check, r.update_available) for r in keyed.current(registry, f"file://{tmp_path}/out").collect()}
        assert now == model(rows, arrivals)
    # what the batch operator makes of the last outcomes, where all of them are later than the entries and say something
    last = [("project", "e0", "update-available", START + timedelta(days=9)), ("personal", "e1", "regenerated", START + timedelta(days=9))]
    put(tmp_path / "in", 9, last)
    keyed.follow(keyed.outcome_files(spark, str(tmp_path / "in")), registry, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    now = {(r.scope, r.name): r for r in keyed.current(registry, f"file://{tmp_path}/out").collect()}
    batch = catalog.apply_outcomes(registry, spark.createDataFrame([o[:3] for o in last], "scope string, name string, status string"), F.lit(START + timedelta(days=9)))
    for r in batch.collect():
        if (r.scope, r.name) in {o[:2] for o in last}:
            assert (now[r.scope, r.name].last_check, now[r.scope, r.name].update_available) == (r.last_check, r.update_available)


def test_due_entries_are_told_by_timers(spark, tmp_path):
    _, registry = entries(spark)
    future = datetime(2999, 1, 1)
    put(tmp_path / "in", 1, [("project", "e0", "unchanged", START), ("personal", "e1", "unchanged", future)])
    for n in (2, 3):
        keyed.follow(keyed.outcome_files(spark, str(tmp_path / "in")), registry, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
        put(tmp_path / "in", n, [("project", "e2", "skipped", future + timedelta(days=n))])
    keyed.follow(keyed.outcome_files(spark, str(tmp_path / "in")), registry, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    assert {(r.name, r.due) for r in keyed.current(registry, f"file://{tmp_path}/out").collect()} == {("e0", True), ("e1", False), ("e2", False), ("e3", False), ("e4", False)}


def test_telling_outcomes_decide_like_all():
    """At most three outcomes an entry, ties of a moment included, with the same entry after them from any state."""
    rng = random.Random(8)
    for _ in range(300):
        outcomes = [(START + timedelta(hours=rng.randrange(6)), rng.choice(STATUSES)) for _ in range(rng.randint(1, 9))]
        rows = pa.table({"scope": ["a"] * len(outcomes), "name": ["b"] * len(outcomes), "status": [o[1] for o in outcomes], "at": pa.array([o[0] for o in outcomes], pa.timestamp("us", "UTC"))})
        kept = [(r["at"].replace(tzinfo=None), r["status"]) for batch in keyed.telling(iter(rows.to_batches(max_chunksize=2))) for r in batch.to_pylist()]
        assert len(kept) <= 3 and set(kept) <= set(outcomes)
        for last in (None, *(START + timedelta(hours=h) for h in range(-1, 7))):
            entry = ("/x", None, True, last)
            assert keyed.applied(entry, kept) == keyed.applied(entry, outcomes)
    assert list(keyed.telling(iter([]))) == []


def write(root, tree):
    for name, text in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


@pytest.fixture
def source(tmp_path):
    root = tmp_path / "src"
    write(root, {"README.md": "# R", "docs/a.md": "# A\n\ntext", "docs/b/c.md": "c", "docs/b/d.md": "---\ndraft: true\n---\nd", "docs/e.txt": "no", "other/f.md": "f"})
    return root


def test_unchanged_files_are_not_opened(spark, source, tmp_path):
    state = f"file://{tmp_path}/state"
    snapshot = lambda: Snapshot(spark, str(source), state)  # noqa: E731 - a new one each time, as after a restart
    full = lambda: order.fileset_hash(files.scan_local(spark, str(source)), 1, 4000, False).first()["source_hash"]
    assert snapshot().update() == 5
    seen = [(full(), snapshot().root_digest(1, 4000))]
    assert snapshot().update() == 0
    tree = snapshot().tree().collect()
    steps = [
        (lambda: write(source, {"docs/a.md": "# A\n\nother"}), 1),
        (lambda: write(source, {"docs/b/d.md": "---\ndraft: true\n---\nlonger"}), 1),  # still a draft: nothing changes
        (lambda: (source / "docs/b/c.md").unlink(), 0),
        (lambda: write(source, {"docs/b/new.md": "new", "docs/z.mdx": "z"}), 2),
        (lambda: write(source, {"other/f.md": "not part of the doc set"}), 1),
        (lambda: write(source, {"docs/b/d.md": "---\ndraft: false\n---\nd"}), 1),
    ]
    for change, opened in steps:
        change()
        assert snapshot().update() == opened
        seen.append((full(), snapshot().root_digest(1, 4000)))
        for a in seen:
            assert (a[0] == seen[-1][0]) == (a[1] == seen[-1][1])
    assert snapshot().root_digest(1, 500) != seen[-1][1]
    before = spark.createDataFrame(tree)
    assert {r.folder for r in changed_folders(before, snapshot().tree()).collect()} == {"", "b"}
