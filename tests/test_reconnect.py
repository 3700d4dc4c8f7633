"""The reconnecting source: fallback to polled pages, and the same rows after a crash."""

import collections
import json

import pytest

from lurewatch.streaming import reconnect

T = 1_704_067_200_000


def message(*names):
    return json.dumps({"message_type": "certificate_update", "data": {"leaf_cert": {"all_domains": list(names)}}})


def put(folder, second, text):
    folder.mkdir(exist_ok=True)
    (folder / f"{T + 1000 * second}-x.json").write_text(text)


def once(spark, tmp_path, messages, polls):
    stream = reconnect.certificates(spark, str(messages), str(polls))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return collections.Counter((r.domain, r.feed) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_fallback_follows_from_names():
    m = [f"{T + 1000 * s}-m" for s in (0, 30, 300)]
    p = [f"{T + 1000 * s}-p" for s in (-5, 0, 20, 89, 90, 299, 300, 350, 361)]
    assert [(reconnect.time_of(x) - T) // 1000 for x in reconnect.fallback(m, p)] == [-5, 90, 299, 361]
    assert reconnect.fallback([], p) == p and reconnect.fallback(m, []) == []
    assert reconnect.between(m, "", m[1]) == m[:2] and reconnect.between(m, m[0], m[2]) == m[1:] and reconnect.between(m, m[2], m[2]) == reconnect.between(m, "", "") == []
    assert reconnect.between(["9-a", "10-a", "100-b"], "9-a", "100-b") == ["10-a", "100-b"]


def test_texts_of_both_feeds():
    text = "\n".join([message("*.a.in", "b.in", ""), "{", json.dumps({"message_type": "heartbeat"}), json.dumps([1]), message("c.in")])
    assert list(reconnect.certified(text)) == ["a.in", "b.in", "c.in"]
    page = json.dumps([{"name_value": "x.in\n*.y.in"}, {"name_value": None}, 5, {}, {"name_value": "z.in"}])
    assert list(reconnect.polled(page)) == ["x.in", "y.in", "z.in"] and list(reconnect.polled(page, 1)) == ["x.in", "y.in"]
    assert list(reconnect.polled("no")) == list(reconnect.polled("{}")) == list(reconnect.polled("")) == []


def test_feeds_take_turns_and_each_name_comes_once(spark, tmp_path):
    messages, polls = tmp_path / "m", tmp_path / "p"
    put(messages, 0, message("sbi-one.xyz", "garden.org"))
    put(polls, 10, json.dumps([{"name_value": "sbi-unseen.xyz"}]))  # while messages come, pages do not count
    assert once(spark, tmp_path, messages, polls) == {("sbi-one.xyz", "messages"): 1}
    assert once(spark, tmp_path, messages, polls) == {("sbi-one.xyz", "messages"): 1}
    put(polls, 100, json.dumps([{"name_value": "sbi-two.xyz\nsbi-one.xyz"}, {"name_value": "*.hdfc-three.top"}]))
    want = {("sbi-one.xyz", "messages"): 1, ("sbi-two.xyz", "polls"): 1, ("hdfc-three.top", "polls"): 1}
    assert once(spark, tmp_path, messages, polls) == want
    put(messages, 130, message("sbi-two.xyz", "pnb-four.in"))
    put(polls, 140, json.dumps([{"name_value": "sbi-unseen.xyz"}]))
    assert once(spark, tmp_path, messages, polls) == {**want, ("pnb-four.in", "messages"): 1}
    (messages / "notes.txt").write_text("x")
    put(messages, 131, "broken")
    assert sum(once(spark, tmp_path, messages, polls).values()) == 4


def test_a_batch_that_failed_is_read_again(spark, tmp_path):
    messages, polls, done = tmp_path / "m", tmp_path / "p", tmp_path / "done"
    done.mkdir()
    for i in range(40):
        put(messages, i, message(f"sbi-{i}.xyz"))
    put(polls, 200, json.dumps([{"name_value": f"sbi-{i}.xyz"} for i in range(20, 60)]))
    seen = []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(str(done / f"batch={number}"))
        seen.append(number)
        if len(seen) == 1:
            raise RuntimeError("killed after the write, before the commit")

    def start():
        return reconnect.certificates(spark, str(messages), str(polls)).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()

    with pytest.raises(Exception):
        start().awaitTermination()
    put(messages, 300, message("sbi-59.xyz", "sbi-99.xyz"))
    start().awaitTermination()
    start().awaitTermination()  # a run that makes up for a lost batch may end with it
    assert seen[:2] == [0, 0]
    got = collections.Counter(r.domain for r in spark.read.parquet(str(done)).collect())
    assert got == {f"sbi-{i}.xyz": 1 for i in [*range(60), 99]}


def test_offsets_stand_for_the_same_files(tmp_path):
    messages, polls = tmp_path / "m", tmp_path / "p"
    reader = reconnect.Reader({"messages": str(messages), "polls": str(polls), "silence": "60"})
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions(reader.initialOffset(), reader.latestOffset()) == []
    put(messages, 0, message("a.in"))
    put(polls, 100, "[]")
    end = reader.latestOffset()
    first = [p.paths for p in reader.partitions(reader.initialOffset(), end)]
    for s in (120, 200):
        put(messages, s, message("b.in"))
        put(polls, s + 90, "[]")
    again = reconnect.Reader({"messages": str(messages), "polls": f"file://{polls}"})
    assert [[(k, x.rsplit("/", 1)[1]) for k, x in p.paths] for p in again.partitions(again.initialOffset(), end)] == [[(k, x.rsplit("/", 1)[1]) for k, x in p] for p in first]
    more = [x for p in again.partitions(end, again.latestOffset()) for x in p.paths]
    assert len(more) == 3 and len(list(again.read(reconnect.Files(more)))) == 2
