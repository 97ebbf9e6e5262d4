"""Decisions as a stream."""

import itertools
import random

import pytest

from quillmill.operators import store
from quillmill.streaming import decisions

EVENTS = "seq long, suggestion_id long, action string, ts timestamp"


@pytest.fixture
def stated(spark):
    name, value = decisions.STATE_STORE
    spark.conf.set(name, value)
    yield spark
    spark.conf.unset(name)


def at(minute):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def run(spark, tmp_path, name, batches, make):
    """The rows that each batch of events adds, one micro-batch each."""
    folder = tmp_path / name
    folder.mkdir()
    stream = make(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder)))
    out, checkpoint, seen = [], str(tmp_path / f"{name}-c"), []
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.parquet(str(tmp_path / f"{name}-{i}"))
        [part] = (tmp_path / f"{name}-{i}").glob("*.parquet")
        part.rename(folder / f"{i:03}.parquet")
        q = stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        out.append([*seen])
        seen.clear()
    return out


def test_counted(spark, tmp_path):
    batch = [(1, 7, "accept", at(0)), (2, 7, "ignore", at(1)), (3, 8, "accept", at(7))]
    [rows] = run(spark, tmp_path, "counts", [batch], decisions.counted)
    assert sorted((r["action"], r["n"]) for r in rows) == [("accept", 1), ("accept", 1), ("ignore", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_latest_in_any_order(stated, tmp_path, seed):
    """Whatever order decisions come in, over batches and restarts, the last rows are what the store's fold gives."""
    r = random.Random(seed)
    events = [(n, r.randint(1, 4), r.choice(["accept", "ignore", "view"]), at(n % 9)) for n in range(24)]
    r.shuffle(events)
    rows = itertools.chain(*run(stated, tmp_path, "any", [events[:9], events[9:10], events[10:]], decisions.latest))
    last = {}
    for x in rows:
        if x["seq"] >= last.get(x["suggestion_id"], (-1,))[0]:
            last[x["suggestion_id"]] = (x["seq"], x["action"])
    suggestions = stated.createDataFrame([(i, False, False) for i in range(1, 5)], "id long, accepted boolean, ignored boolean")
    folded = {x["id"]: x for x in store.decided(suggestions, stated.createDataFrame(events, EVENTS)).collect()}
    assert {i: (x["accepted"], x["ignored"]) for i, x in folded.items()} == {i: (last.get(i, (0, ""))[1] == "accept", last.get(i, (0, ""))[1] == "ignore") for i in folded}


def test_old_state_goes(stated, tmp_path):
    """Two hours on, the first suggestion's state has gone: an older seq is a first decision again."""
    keep = lambda s: decisions.latest(s, keep="30 minutes", late="1 minute")
    first, second, third, fourth = run(stated, tmp_path, "old", [[(10, 1, "accept", at(0))], [(5, 1, "ignore", at(1))], [(1, 2, "accept", at(120))], [(6, 1, "ignore", at(121)), (0, 2, "ignore", at(121))]], keep)
    assert [tuple(x) for x in first] == [(1, "accept", 10)] and second == []
    assert [tuple(x) for x in third] == [(2, "accept", 1)]
    assert [tuple(x) for x in fourth] == [(1, "ignore", 6)]
