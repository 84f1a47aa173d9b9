"""Streams that commit in two phases, replace rows, roll shards and end state: crashes and restarts included."""

import random

import pytest

from trajspark.streaming import ledger, streams

ROWS = "occurrence_id long, resume_generation long, value long"


class Crash(Exception):
    pass


def crash_at(phase, batch):
    """Dies once, at the end of a phase of a batch."""
    armed = [True]

    def fault(p, b):
        if armed and (p, b) == (phase, batch):
            armed.clear()
            raise Crash(f"{phase} {batch}")

    return fault


def arrive(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(start):
    """Runs to the end, or to the crash; says which."""
    query = start()
    try:
        query.awaitTermination()
        return "ended"
    except Exception as e:
        assert "Crash" in str(e) or "StreamingQueryException" in type(e).__name__
        return "crashed"


@pytest.mark.parametrize("phase", ["written", "committed"])
@pytest.mark.parametrize("batch", [0, 1, 2])
def test_a_killed_run_counts_every_update_once(spark, tmp_path, phase, batch):
    schema = "update_id long, value long"
    parts = [[(0, 1), (1, 1), (3, 1)], [(2, 1), (5, 1)], [(4, 1), (4, 2), (6, 1)]]
    for p in parts:
        arrive(spark, f"{tmp_path}/in", p, schema)
    book = ledger.Ledger(spark, f"{tmp_path}/book")
    fault = crash_at(phase, batch)
    start = lambda: ledger.run_updates(streams.files(spark, f"{tmp_path}/in", schema, 1), book, {"world": 2}, f"{tmp_path}/check", fault=fault)
    assert run(start) == "crashed"
    # what the dead run left: only committed batches are seen, and the cursor is theirs
    known = [u for p in parts[: batch + (phase == "committed")] for u in p]
    assert sorted(tuple(r)[:2] for r in book.read("updates", schema).collect()) == sorted(known)
    cursors = [2, 4, 7]
    done = batch + (phase == "committed")
    assert (book.last() or {}).get("state", {}).get("next_update", 0) == (cursors[done - 1] if done else 0)
    assert run(start) == "ended"
    assert book.last()["state"]["next_update"] == 7 and sorted(tuple(r)[:2] for r in ledger.released_updates(book, schema).collect()) == sorted(u for p in parts for u in p)
    with pytest.raises(Exception, match="another configuration"):
        arrive(spark, f"{tmp_path}/in", [(7, 1)], schema)
        ledger.run_updates(streams.files(spark, f"{tmp_path}/in", schema, 1), book, {"world": 3}, f"{tmp_path}/check").awaitTermination()


def test_updates_beyond_a_gap_wait(spark, tmp_path):
    schema = "update_id long, value long"
    book = ledger.Ledger(spark, f"{tmp_path}/book")
    assert ledger.released_updates(book, schema).count() == 0 and book.last() is None
    for rows, cursor, released in [([(1, 1), (2, 1)], 0, 0), ([(4, 1), (0, 1)], 3, 3), ([(3, 1)], 5, 5)]:
        arrive(spark, f"{tmp_path}/in", rows, schema)
        ledger.run_updates(streams.files(spark, f"{tmp_path}/in", schema), book, {}, f"{tmp_path}/check").awaitTermination()
        assert book.last()["state"]["next_update"] == cursor and ledger.released_updates(book, schema).count() == released


@pytest.mark.parametrize("phase", ["written", "committed"])
def test_late_generations_replace_rows(spark, tmp_path, phase):
    rng = random.Random(4)
    batches = [[(rng.randrange(6), rng.randrange(4), rng.randrange(1 << 60)) for _ in range(12)] for _ in range(4)]
    batches[3] += batches[3][:2] + batches[0][:1]  # repeated rows
    book = ledger.Ledger(spark, f"{tmp_path}/book")
    fault = crash_at(phase, 2)
    for n, rows in enumerate(batches):
        arrive(spark, f"{tmp_path}/in", rows, ROWS)
        stream = streams.accepted_changes(streams.files(spark, f"{tmp_path}/in", ROWS))
        start = lambda s=stream: ledger.into(s, book, f"{tmp_path}/check", fault=fault)
        if run(start) == "crashed":
            assert n == 2 and run(lambda: ledger.into(streams.accepted_changes(streams.files(spark, f"{tmp_path}/in", ROWS)), book, f"{tmp_path}/check")) == "ended"
        seen = [r for b in batches[: n + 1] for r in b]
        best = {k: max(g for j, g, _ in seen if j == k) for k, _, _ in seen}
        changes = book.read("rows", ledger.schema_of(stream))
        found = [tuple(r) for r in ledger.replaced(changes).select("occurrence_id", "resume_generation", "value").collect()]
        assert sorted(found) == sorted(r for r in seen if r[1] == best[r[0]])
    assert changes.filter("op = 'retract'").count() > 0 and changes.filter("op = 'late'").count() > 0


def plain_shards(steps, size):
    out, first, n = [], None, 0
    for s, c in sorted(steps.items()):
        first, n = s if first is None else first, n + c
        if s - first + 1 >= size:
            out.append((first, s, n, True))
            first, n = None, 0
    return out + ([(first, max(steps), n, False)] if first is not None else [])


def test_shards_roll_at_the_runs_own_length(spark, tmp_path):
    rng = random.Random(2)
    schema = "run long, step long"
    runs = {r: sorted(rng.sample(range(100), 30)) for r in range(3)}
    book = ledger.Ledger(spark, f"{tmp_path}/book")
    for low in range(0, 100, 25):
        rows = [(r, s) for r, steps in runs.items() for s in steps if low <= s < low + 25]
        arrive(spark, f"{tmp_path}/in", rows + rows[:3], schema)
        stream = streams.shard_roll(streams.files(spark, f"{tmp_path}/in", schema), 10)
        assert run(lambda s=stream: ledger.into(s, book, f"{tmp_path}/check")) == "ended"
    counts = {r: {} for r in runs}
    for low in range(0, 100, 25):
        rows = [(r, s) for r, steps in runs.items() for s in steps if low <= s < low + 25]
        for r, s in rows + rows[:3]:
            counts[r][s] = counts[r].get(s, 0) + 1
    found = streams.rolled(book.read("rows", ledger.schema_of(stream))).orderBy("run", "shard").collect()
    expected = [(r, n, *shard) for r in sorted(runs) for n, shard in enumerate(plain_shards(counts[r], 10))]
    assert [tuple(r) for r in found] == expected
    arrive(spark, f"{tmp_path}/in", [(0, 1)], schema)  # a step of a closed shard
    assert run(lambda: ledger.into(streams.shard_roll(streams.files(spark, f"{tmp_path}/in", schema), 10), book, f"{tmp_path}/check")) == "ended"
    assert book.read("rows", ledger.schema_of(stream)).filter("shard = -1").count() == 1


@pytest.mark.parametrize("kind", ["cache", "session", "ensemble"])
def test_idle_state_ends(spark, tmp_path, kind):
    schema = "k string, session string, seq long, n long, op string, frames long, v array<double>, at timestamp"

    def rows(*given):
        return spark.createDataFrame([(k, k, n, n, "cache", 1, [1.0, 0.0], t) for k, n, t in given], "k string, session string, seq long, n long, op string, frames long, v array<double>, t string").selectExpr("* except (t)", "cast(t as timestamp) as at").coalesce(1)

    def machine(stream):
        if kind == "cache":
            return streams.latest_n(stream, "k", "n", "frames", 2, at="at", idle="10 minutes")
        if kind == "session":
            return streams.sessions(stream, at="at", idle="10 minutes")
        return streams.ensemble(stream, "k", "n", "v", 2, 0.0, at="at", idle="10 minutes")

    book, sizes = ledger.Ledger(spark, f"{tmp_path}/book"), []
    for given in [[("a", 1, "2024-01-01 00:00:00"), ("b", 1, "2024-01-01 00:00:00")], [("a", 2, "2024-01-01 00:09:00")], [("a", 3, "2024-01-01 00:18:00")], [("c", 1, "2024-01-01 03:00:00")], [("b", 2, "2024-01-01 03:01:00")]]:
        rows(*given).write.mode("append").parquet(f"{tmp_path}/in")
        out = machine(streams.files(spark, f"{tmp_path}/in", schema))
        mode = "update" if kind == "cache" else "append"
        query = ledger.into(out, book, f"{tmp_path}/check", mode=mode)
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sizes[0] == 2 and max(sizes) <= 3 and sizes[-1] == 2  # only what was seen lately is held
    last = book.read("rows", ledger.schema_of(out)).filter(f"{'session' if kind == 'session' else 'k'} = 'b'").collect()
    if kind == "session":
        assert [r["cursor"] for r in sorted(last, key=lambda r: r["seq"])] == [1, 1]  # it started anew
    if kind == "cache":
        assert max(r["batch"] for r in last) > 0 and [r["n"] for r in last if r["batch"] == max(x["batch"] for x in last)] == [2]


def test_replayed_calls_are_counted_across_frames(spark, tmp_path):
    schema, calls = "session long, seq long", [(s, n) for s in range(3) for n in range(20)]
    random.Random(5).shuffle(calls)
    actions = spark.range(12).selectExpr("id AS step", "id * 0.5 AS action")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a session's calls come in several frames
    try:
        for part in (lambda n: n < 9, lambda n: n >= 9):
            arrive(spark, f"{tmp_path}/in", [c for c in calls if part(c[1])], schema)
            streams.to_parquet(streams.next_action(streams.files(spark, f"{tmp_path}/in", schema), actions), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("session", "seq", "step", "action").collect())
    assert found == [(s, n, n, n * 0.5 if n < 12 else None) for s in range(3) for n in range(20)]


@pytest.mark.parametrize("phase", ["written", "committed"])
def test_changes_by_joins_are_those_of_the_state(spark, tmp_path, phase):
    rng = random.Random(6)
    batches = [[(rng.choice([None, 0, 1, 2, 3, 4]), rng.randrange(4), rng.choice([None, rng.randrange(1 << 60)])) for _ in range(12)] for _ in range(4)]
    batches[3] += batches[3][:2] + batches[0][:1]  # repeated rows
    for rows in batches:
        arrive(spark, f"{tmp_path}/in", rows, ROWS)
    book, fault = ledger.Ledger(spark, f"{tmp_path}/book"), crash_at(phase, 2)
    start = lambda: ledger.run_changes(streams.files(spark, f"{tmp_path}/in", ROWS, 1), book, f"{tmp_path}/check", fault=fault)
    assert run(start) == "crashed" and run(start) == "ended"
    best, expected = {}, []
    for n, rows in enumerate(batches):
        tops = {k: max(g for j, g, _ in rows if j == k) for k, _, _ in rows}
        expected += [("retract", k, best[k], None, n) for k, g in tops.items() if k in best and g > best[k]]
        best |= {k: max(g, best.get(k, g)) for k, g in tops.items()}
        expected += [("add" if g == best[k] else "late", k, g, v, n) for k, g, v in rows]
    changes = book.read("rows", f"op string, {ROWS}")
    assert sorted((tuple(r) for r in changes.collect()), key=repr) == sorted(expected, key=repr)
    found = [tuple(r) for r in ledger.replaced(changes).select("occurrence_id", "resume_generation", "value").collect()]
    assert sorted(found, key=repr) == sorted((r for b in batches for r in b if r[1] == best[r[0]]), key=repr)
