import time

from hypothesis import given
from hypothesis import strategies as st

from millrace.plans.chunks import Chunk, assign, fingerprint, heaviest_first, one_to_one, pack, pack_frame, plan, split
from millrace.plans.queue import LeaseQueue, Task


def members(*weights):
    return [Chunk(f"n{i}", {"v": i}, w) for i, w in enumerate(weights)]


def test_pack_next_fit():
    got = pack(members(10, 10, 10, 5), 20)
    assert [c.weight for c in got] == [20, 15] and [c.id for c in got] == ["c0", "c1"]
    assert [len(c.members) for c in pack(members(50, 1, 1), 10)] == [1, 2]
    assert [c.id for c in pack(members(1, 2), 0)] == ["n0", "n1"]
    assert pack([], 5) == []


@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 60))
def test_pack_keeps_order_and_bound(weights, target):
    got = pack(members(*weights), target)
    assert [m.id for c in got for m in c.members] == [f"n{i}" for i in range(len(weights))]
    assert all(len(c.members) == 1 or c.weight <= target for c in got)


def test_pack_frame_equals_pack(spark):
    w = [3.0, 30.0, 5.0, 50.0, 8.0, 80.0, 12.0, 1.0]
    df = spark.createDataFrame(list(enumerate(w)), "ordinal int, w double")
    got = {r.ordinal: r.chunk for r in pack_frame(df, "w", 60).collect()}
    want = {int(m.id[1:]): i for i, c in enumerate(pack(members(*w), 60)) for m in c.members}
    assert got == want


def test_selection_split_order_and_fingerprint(spark):
    m = members(1, 3, 2)
    assert [c.id for c in plan(m, None, None, None)] == ["n0", "n1", "n2"]
    assert [c.id for c in plan(m, 4, lambda up, cfg: [Chunk("x", {}, 1, up)], None)] == ["x"]
    assert [c.id for c in heaviest_first(m)] == ["n1", "n2", "n0"]
    parts = split(Chunk("c0", {"p": 1}, 2, m[:2]))
    assert [c.id for c in parts] == ["c0-m0", "c0-m1"] and parts[0].params == {"p": 1}
    assert fingerprint(m[0].to_json()) != fingerprint(m[1].to_json())
    df = spark.createDataFrame([("n0", 1), ("n2", 2)], "id string, v int")
    assert {(r.id, r._chunk_id) for r in assign(df, "id", pack(m, 4)).collect()} == {("n0", "c0"), ("n2", "c1")}
    assert one_to_one(m)[1].members == [m[1]]


def test_queue_lease_redelivery_and_dead_letters():
    q = LeaseQueue(max_redeliveries=1)
    q.enqueue([Task("s", "s/a")])
    assert q.claim(lease=0.01).attempt == 0 and q.claim() is None
    time.sleep(0.02)
    again = q.claim()
    assert again.attempt == 1 and q.extend("s/a")
    q.fail("s/a")
    assert q.claim() is None and [t.key for t in q.dead] == ["s/a"]
    q.enqueue([Task("s", "s/b")])
    q.ack(q.claim().key)
    assert q.depth() == {"waiting": 0, "leased": 0, "dead": 1} and not q.extend("s/b")
