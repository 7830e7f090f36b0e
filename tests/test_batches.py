"""Packing against plain loops; batches that do not depend on the table's size."""

import random

import pytest

from tallyspark.operators import batches, groups

LINE = "bank_id long, component long, best long, chars long"


def tables(spark, lines, wanted, documents):
    return spark.createDataFrame(lines, LINE), spark.createDataFrame(wanted, "bank_id long, document long"), spark.createDataFrame(documents, "document long, chars long")


def world(seed, n=90, topics=9):
    """Lines of some topics; lines of one topic need the same few documents."""
    rng = random.Random(seed)
    lines, wanted = [], set()
    for i in range(n):
        topic = rng.randrange(topics)
        component = i - i % rng.choice([1, 1, 2])
        lines.append((i, component, 100 + topic, rng.randint(10, 60)))
        wanted |= {(i, 10 * topic + rng.randrange(6)) for _ in range(4)}
    return lines, sorted(wanted), [(d, 50 + d) for d in range(10 * topics)]


def plain_batches(lines, wanted, documents, size, limit):
    """The greedy rule written out: largest unit first, then most shared, fewest new, earliest."""
    cost, docs = dict(documents), {}
    for b, d in wanted:
        docs.setdefault(b, set()).add(d)
    chars = {b: c for b, _, _, c in lines}
    held = lambda ls: set().union(*(docs.get(x, set()) for x in ls))
    fits = lambda ls: len(ls) <= size and sum(chars[x] for x in ls) + sum(cost[d] for d in held(ls)) <= limit
    units, groups = [], {}
    for b, component, _, _ in sorted(lines):
        groups.setdefault(component, []).append(b)
    best = {b: x for b, _, x, _ in lines}
    for group in groups.values():
        parts = [group] if fits(group) else [[b for b in group if best[b] == x] for x in sorted({best[b] for b in group})]
        for part in parts:
            chunk = []
            for b in part:
                if chunk and not fits([*chunk, b]):
                    units.append(chunk)
                    chunk = []
                chunk.append(b)
            units.append(chunk)
    out = []
    left = sorted(units, key=lambda u: (-len(u), u[0]))
    while left:
        now = left.pop(0)
        while True:
            able = [u for u in left if fits(now + u)]
            if not able:
                break
            pick = min(able, key=lambda u: (-len(held(now) & held(u)), len(held(u) - held(now)), u[0]))
            left.remove(pick)
            now = now + pick
        out.append(now)
    return sorted(sorted(b) for b in out)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["batch"], []).append(r["bank_id"])
    return out


@pytest.mark.parametrize("seed,size,limit", [(1, 20, 3000), (2, 5, 1200), (3, 20, 700)])
def test_affine_batches_equal_the_greedy_rule_in_one_segment(spark, monkeypatch, seed, size, limit):
    monkeypatch.setattr(batches, "SEGMENT", 1 << 30)
    own = world(seed)
    got = found(batches.affine_batches(*tables(spark, *own), size=size, limit=limit))
    assert sorted(sorted(b) for b in got.values()) == plain_batches(*own, size, limit)


def test_affine_batches_send_fewer_documents_than_hash_order(spark, monkeypatch):
    monkeypatch.setattr(batches, "SEGMENT", 16)
    lines, wanted, documents = world(4, 600, 30)
    docs = {}
    for b, d in wanted:
        docs.setdefault(b, set()).add(d)
    sent = lambda all_: sum(len(set().union(*(docs[x] for x in b))) for b in all_)
    got = list(found(batches.affine_batches(*tables(spark, lines, wanted, documents))).values())
    assert sorted(x for b in got for x in b) == list(range(600)) and max(map(len, got)) <= 20
    shuffled = random.Random(1).sample(range(600), 600)
    assert sent(got) < 0.7 * sent([shuffled[k : k + 20] for k in range(0, 600, 20)])


def test_batches_do_not_depend_on_the_size_of_the_table(spark, monkeypatch):
    """Twice as many lines of other documents leave most batches as they were."""
    monkeypatch.setattr(batches, "SEGMENT", 8)
    lines, wanted, documents = world(5, 300, 60)
    small = found(batches.affine_batches(*tables(spark, lines, wanted, documents)))
    more = [(b + 1000, c + 1000, x, n) for b, c, x, n in lines], [(b + 1000, d + 1000) for b, d in wanted], [(d + 1000, n) for d, n in documents]
    both = found(batches.affine_batches(*tables(spark, lines + more[0], wanted + more[1], documents + more[2])))
    assert sorted(x for b in both.values() for x in b if x < 1000) == list(range(300))
    again = batches.affine_batches(*(t.repartition(7) for t in tables(spark, lines, wanted, documents)))
    assert found(again).keys() == small.keys()
    assert {k: sorted(v) for k, v in found(again).items()} == {k: sorted(v) for k, v in small.items()}


def test_batches_of_nothing_and_of_a_line_too_large(spark):
    none = tables(spark, [], [], [])
    assert batches.affine_batches(*none).collect() == []
    assert batches.connected_batches(none[0].select("bank_id", "component"), 3).collect() == []
    got = found(batches.affine_batches(*tables(spark, [(1, 1, 5, 999), (2, 1, 5, 1), (3, 3, None, 1)], [(1, 7)], [(7, 10)]), limit=100))
    assert [1] in got.values()


@pytest.mark.parametrize("segment", [2, 1 << 30])
def test_connected_batches_equal_a_loop(spark, monkeypatch, segment):
    monkeypatch.setattr(batches, "SEGMENT", segment)
    rng = random.Random(6)
    lines, at = [], 0
    while at < 200:
        n = rng.choice([1, 1, 2, 3, 9])
        lines += [(at + k, at) for k in range(n)]
        at += n
    df = spark.createDataFrame(lines, "bank_id long, component long")
    marked = {r[0] for r in df.filter(batches.begins(df.component)).select("component").collect()}
    sizes = {}
    for _, c in lines:
        sizes[c] = sizes.get(c, 0) + 1
    want, pending = [], []
    for c in sorted(sizes):
        own = [b for b, x in lines if x == c]
        if sizes[c] > 4:
            want += [own[k : k + 4] for k in range(0, len(own), 4)]
            continue
        if pending and (c in marked or len(pending) + len(own) > 4):
            want.append(pending)
            pending = []
        pending = pending + own
    got = found(batches.connected_batches(df, 4))
    assert sorted(sorted(b) for b in got.values()) == sorted(want + ([pending] if pending else []))


def test_requests_equal_a_loop(spark):
    rng = random.Random(7)
    units = [(d, p, rng.choice([10, 40, 70, 120]), rng.choice([0, 1, 3]), rng.random() < 0.05 or None) for d in range(25) for p in range(rng.randint(1, 30)) for _ in range(rng.randint(1, 2))]
    df = spark.createDataFrame(units, "document long, page int, chars int, images int, blocked boolean")
    got = {(r["document"], r["page"]): r["request"] for r in batches.bounded_requests(df, pages=6, images=8, chars=300, overhead=20).collect()}
    want = {}
    for d in range(25):
        request, open_ = -1, None
        for p in sorted({u[1] for u in units if u[0] == d}):
            own = [u for u in units if u[:2] == (d, p)]
            c, i, bad = sum(u[2] for u in own), sum(u[3] for u in own), any(u[4] for u in own)
            if bad or c + 20 > 300 or i > 8:
                want[d, p], open_ = None, None
                continue
            if open_ is None or open_[0] == 6 or open_[1] + c > 300 or open_[2] + i > 8:
                request, open_ = request + 1, (0, 20, 0)
            open_ = (open_[0] + 1, open_[1] + c, open_[2] + i)
            want[d, p] = request
    assert got == want


def test_components_and_batches_broadcast_nothing_that_grows(spark, monkeypatch):
    plans = []
    kept = groups.checkpointed

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(groups, "checkpointed", noted)
    choices = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, "b", 1), (2, "b", 1), (9, "c", 1)], "bank_id long, item_id string, rank int")
    lines = groups.components(choices.select("bank_id").distinct(), groups.first_owner(choices))
    assert sorted(map(tuple, lines.collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (9, 9)]
    assert len(plans) > 1 and not any("Broadcast" in plan for plan in plans)
    last = batches.connected_batches(lines, 3)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("component" in line for line in last if "BroadcastHashJoin" in line)


def least_reachable(nodes, edges):
    up = {n: n for n in nodes}
    for _ in nodes:
        for u, v in edges:
            up[u] = up[v] = min(up[u], up[v])
    return up


@pytest.mark.parametrize("few", [0, 5, 300_000])
def test_components_write_what_is_left_and_settle_the_last_edges_at_once(spark, monkeypatch, few):
    rng = random.Random(8)
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(200, 200 + k) for k in range(1, 30)] + [(229, 50)]
    loose = [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(35)]
    edges, nodes = chain + star + loose + [(7, 7), (None, 3), (1, 0)], [*range(360), None]
    written = []
    kept = groups.checkpointed

    def noted(df):
        out = kept(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(groups, "checkpointed", noted)
    monkeypatch.setattr(groups, "FEW", few, raising=False)
    got = groups.components(spark.createDataFrame([(n,) for n in nodes], "bank_id long"), spark.createDataFrame(edges, "bank_id long, owner long"))
    assert {r["bank_id"]: r["component"] for r in got.collect()} == {None: None, **least_reachable(range(360), [e for e in edges if None not in e])}
    assert written.count(361) == 1  # only the result has a row for each node
    assert few < 300_000 or len(written) == 2


def test_segments_stream_through_as_many_tasks_as_shuffles_have(spark):
    rows = spark.createDataFrame([(f"s{k % 40}", f"n{k:03d}", k) for k in range(400)], "segment string, unit string, n long")
    seen = batches.each_segment(rows, "n", lambda own: [f"{own[0][0]}:{len(own)}:{at}:{row[2]}" for at, row in enumerate(own)], "batch")
    assert {tuple(r) for r in seen.collect()} == {(f"n{k:03d}", f"s{k % 40}:10:{k // 40}:{k}") for k in range(400)}
    assert seen.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_connected_components_are_fitted_as_they_stream(spark):
    lines = spark.createDataFrame([(k, k - k % 2) for k in range(40)], "bank_id long, component long")
    made = batches.connected_batches(lines, 3)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
    assert sorted(sorted(x) for x in found(made).values()) == [[k, k + 1] for k in range(0, 40, 2)]
