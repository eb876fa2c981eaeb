"""Indices, transactions, versions, locks, the mutation log and its stream."""

import pytest
from pyspark.sql import functions as F

from graphloom.errors import CorruptLog, Deadlock, InvalidOperation, NotFound, TransactionError
from graphloom.model import Graph
from graphloom.operators import index, mutate, mutation_log as L, mvcc
from graphloom.streaming import replay


def test_index(spark):
    g, ids = mutate.add_nodes(Graph(spark), [(("P",), {"age": a}) for a in (25, 30, 35, -1, 256, 1)] + [(("Q",), {"name": "x"}), (("Q",), {"name": "x"}), (("Q",), {"name": "y"})])
    m = index.IndexManager(g)
    m.create_btree_index("ages", property="age")
    m.create_hash_index("names", property="name")
    m.create_hash_index("q", label="Q")
    assert [r.id for r in m.range_property("age", 28, 32).collect()] == [ids[1]]
    assert m.range_property("age", -5, 300).count() == 6 and m.range_property("nosuch", 1, 2).count() == 0
    assert m.lookup_property("name", "x").count() == 2 and m.lookup_property("name", 5).count() == 0 and m.lookup_property("nosuch", 1).count() == 0
    assert m.lookup_label("Q").count() == 3 and m.lookup_label("P").count() == 0
    assert m.stats("names") == {"total_keys": 2, "total_values": 3, "max_values_per_key": 2, "avg_values_per_key": 1.5}
    assert m.index_count() == 3 and m.has_index("q") and [i.name for i in m.list_indices()] == ["ages", "names", "q"]
    with pytest.raises(InvalidOperation):
        m.range_property("name", "a", "b")
    with pytest.raises(InvalidOperation):
        m.create_hash_index("q", label="Q")
    with pytest.raises(InvalidOperation):
        m.create_hash_index("both", label="Q", property="x")
    m.drop_index("q")
    with pytest.raises(NotFound):
        m.drop_index("q")


def test_transactions(spark):
    m = mvcc.TransactionManager()
    a, b = m.begin_transaction(), m.begin_transaction()
    assert m.snapshot(a).sees(a) and not m.snapshot(b).sees(a) and m.snapshot(b).sees(b) and not m.snapshot(a).sees(b)
    m.commit_transaction(a)
    assert m.snapshot(m.begin_transaction()).sees(a) and not m.snapshot(b).sees(a)
    m.abort_transaction(b)
    for f in (m.commit_transaction, m.abort_transaction):
        with pytest.raises(TransactionError):
            f(b)
    with pytest.raises(TransactionError):
        m.snapshot(99)
    s = mvcc.Snapshot(10, frozenset({5, 7}))
    assert [s.sees(x) for x in (3, 5, 15)] == [True, False, False]
    t = mvcc.Transaction(Graph(spark))
    t.apply("CREATE (n:X)")
    assert t.graph.node_count() == 1 and t.rollback().node_count() == 0
    with pytest.raises(TransactionError):
        t.commit()
    t = mvcc.Transaction(Graph(spark))
    t.apply("CREATE (n:X)")
    assert t.commit().node_count() == 1


def test_versions(spark):
    v = spark.createDataFrame([("a", 1, 3, 8, 100, 200), ("a", 2, 8, None, 200, None), ("b", 1, 5, None, 150, None), ("c", 1, 12, None, 90, None)], "entity string, version int, xmin long, xmax long, created_at long, deleted_at long")
    at = lambda ts: {(r.entity, r.version) for r in mvcc.visible_at(v, ts).collect()}
    assert [("a", 1) in at(t) for t in (99, 100, 150, 200)] == [False, True, True, False]
    seen = {(r.entity, r.version) for r in mvcc.visible_to(v, mvcc.Snapshot(10, frozenset({5}))).collect()}
    assert seen == {("a", 2)}
    assert {(r.entity, r.version) for r in mvcc.latest(v).collect()} == {("a", 2), ("b", 1), ("c", 1)}
    gone = mvcc.mark_deleted(v, spark.createDataFrame([("a",)], "e string"), 20, 300)
    assert gone.where("deleted_at = 300 and xmax = 20").count() == 1 and gone.count() == 4
    assert mvcc.collect_garbage(v, 201).count() == 3 and mvcc.collect_garbage(v, 200).count() == 4


def test_locks(spark):
    d = mvcc.DeadlockDetector()
    assert d.request_lock(1, "a") and d.request_lock(2, "b") and d.request_lock(1, "a")
    assert not d.request_lock(1, "b")
    with pytest.raises(Deadlock, match="Deadlock detected"):
        d.request_lock(2, "a")
    assert d.get_deadlocked_txns(1) == [1, 2] and d.stats() == {"locks_held": 2, "waiting_transactions": 1, "wait_edges": 1}
    d.release_lock(2, "b")
    assert d.request_lock(1, "b")
    d.release_all_locks(1)
    assert d.stats()["locks_held"] == 0 and d.request_lock(3, "a")
    cycles = mvcc.wait_cycles(mvcc.wait_edges([(1, 2), (2, 3), (3, 1), (4, 1), (3, 5)], spark))
    assert {r.id for r in cycles.collect()} == {1, 2, 3}
    assert mvcc.wait_cycles(mvcc.wait_edges([(1, 2), (2, 3)], spark)).count() == 0


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    log = L.MutationLog(spark, path, segment_size=4)
    log.append(1, "begin")
    log.append(1, "insert_node", "n1", ["P"], props={"a": 1})
    log.append(1, "insert_node", "n2", ["P"])
    log.append(1, "insert_edge", "e1", src="n1", dst="n2", type="T")
    log.append(1, "update_node", "n1", props={"a": 2})
    log.append(1, "commit")
    log.append(2, "begin")
    log.append(2, "insert_node", "n3", ["P"])
    log.flush()
    nodes, edges = L.replay(log.read())
    assert {(r.entity, tuple(r.labels), r.props) for r in nodes.collect()} == {("n1", ("P",), '{"a": 2}'), ("n2", ("P",), None)}
    assert edges.collect()[0].asDict() == {"entity": "e1", "src": "n1", "dst": "n2", "type": "T", "props": None}
    assert L.replayed_count(log.read()) == 6
    g = L.recover(log.read())
    assert g.cypher("MATCH (a:P)-[r:T]->(b:P) RETURN a.a AS a, id(b) IS NOT NULL AS b").collect() == [(2, True)] and g.node_count() == 2
    assert L.recover(log.read().where("txn_id = 2")).node_count() == 0
    log = L.MutationLog(spark, path)
    assert log.next_lsn == 8
    log.append(3, "delete_node", "n1")
    log.append(3, "commit")
    assert log.checkpoint() == 10
    nodes, edges = L.replay(log.read())
    assert [r.entity for r in nodes.collect()] == ["n2"] and edges.count() == 0
    assert L.replay(log.read(), after=7)[0].count() == 0
    with pytest.raises(ValueError):
        log.append(1, "nonsense")


def test_log_reports_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "log")
    log = L.MutationLog(spark, path, segment_size=2)
    assert log.verified().count() == 0
    for i in range(6):
        log.append(1, "insert_node", f"n{i}", ["P"])
    assert log.verified().count() == 6
    files = {r.lsn: r.f for r in log.read().select("lsn", F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("f")).collect()}
    (tmp_path / "torn").write_bytes(open(files[5], "rb").read())
    open(files[5], "wb").write(b"torn")
    assert log.verified().count() == 4  # the tail
    open(files[5], "wb").write((tmp_path / "torn").read_bytes())
    open(files[2], "wb").write(b"torn")
    with pytest.raises(CorruptLog, match="2 records missing and 0 repeated"):
        log.verified()


def test_stream(spark, tmp_path):
    path, target, state = (str(tmp_path / x) for x in ("log", "now", "state"))
    log = L.MutationLog(spark, path, segment_size=2)
    for i in range(6):
        log.append(1, "insert_node" if i < 4 else "update_node", f"n{i % 4}", ["P"], props={"v": i})
    log.flush()
    replay.maintain(replay.stream(spark, path, 1), target, state).awaitTermination()
    assert {r.entity: r.props for r in replay.current(spark, target).collect()} == {"n0": '{"v": 4}', "n1": '{"v": 5}', "n2": '{"v": 2}', "n3": '{"v": 3}'}
    log.append(1, "delete_node", "n3")
    log.flush()
    replay.maintain(replay.stream(spark, path, 1), target, state).awaitTermination()
    assert {r.entity: r.op for r in replay.current(spark, target).collect()}["n3"] == "delete_node"
    assert replay.current(spark, target + "x") is None
    assert len(replay._complete(spark, target)) == replay.KEPT
