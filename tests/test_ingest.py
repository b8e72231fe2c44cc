"""Stats files as single commits: broken runs, reruns, two writers."""

import pytest
from pyspark.sql import functions as F

from turnlens.session import scratch_dir
from turnlens.sinks.ingest import StatsStore


def _file(spark, uuids, facts, extra=False):
    rows = [(i, t, *(["x"] if extra else [])) for i, t in facts]
    return {"uuid_dictionary": spark.createDataFrame(list(enumerate(uuids, 1)), "id int, uuid_hex string"),
            "GameResult": spark.createDataFrame(rows, "GameId int, Turn int" + ", extra string" * extra),
            "Log": spark.createDataFrame([(i, v, "l") for i, v in facts], "GameId int, v int, kind string")}


@pytest.fixture()
def base(spark):
    return scratch_dir(spark, "stats")


def state(store):
    ids = {r.uuid_hex: r.id for r in store.dictionary().collect()}
    name = {i: u for u, i in ids.items()}
    return ids, {t: sorted((name[r[0]], r[1]) for r in store.table(t).collect()) for t in ("GameResult", "Log")}


class Broken(Exception):
    pass


@pytest.mark.parametrize("step", range(5))
def test_a_run_broken_after_any_write_leaves_nothing_and_is_repeated_whole(spark, base, monkeypatch, step):
    """Steps: dictionary, two fact tables, the commit record cut off, the
    record whole but the report never returned."""
    store = StatsStore(spark, f"{base}/s", f"{base}/q")
    store.ingest("a", _file(spark, ["bb", "aa"], [(1, 10), (2, 20)]), {})
    before = state(store)
    second = _file(spark, ["cc", "bb"], [(1, 30), (2, 40), (9, 50)])
    calls = []

    def write(self, df, path, real=StatsStore.write):
        real(self, df, path)
        calls.append(path)
        if len(calls) == step + 1:
            raise Broken

    def publish(self, record, real=StatsStore.publish):
        if step == 3:       # the file exists, its content does not
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_commits/{record['seq']:012d}.json")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, False).close()
        else:
            real(self, record)
        raise Broken

    with monkeypatch.context() as m:
        if step < 3:
            m.setattr(StatsStore, "write", write)
        else:
            m.setattr(StatsStore, "publish", publish)
        with pytest.raises(Broken):
            store.ingest("b", second, {})
    if step < 4:
        assert state(store) == before
    for _ in range(2):      # the rerun, and once more
        report = sorted((r.table_name, r.status, r.rows) for r in store.ingest("b", second, {}).collect())
        assert report == [("GameResult", "accepted", 2), ("GameResult", "unmatched", 1), ("Log", "accepted", 2),
                          ("Log", "unmatched", 1)]
    ids, tables = state(store)
    assert ids == {"aa": 1, "bb": 2, "cc": 3}
    assert tables["GameResult"] == [("aa", 20), ("bb", 10), ("bb", 40), ("cc", 30)] == tables["Log"]


def test_two_writers_mint_different_ids(spark, base):
    """A second writer publishes between the first one's staging and its
    commit; the first starts over and takes the next ids."""
    one, two = StatsStore(spark, f"{base}/s", f"{base}/q"), StatsStore(spark, f"{base}/s", f"{base}/q")
    real, tried = one.publish, []

    def publish(record):
        tried.append(record["seq"])
        if len(tried) == 1:
            two.ingest("b", _file(spark, ["zz"], [(1, 2)]), {})
        return real(record)

    one.publish = publish
    one.ingest("a", _file(spark, ["aa"], [(1, 1)]), {})
    ids, tables = state(one)
    assert tried == [1, 2] and ids == {"zz": 1, "aa": 2} and tables["Log"] == [("aa", 1), ("zz", 2)]


def test_a_mismatch_quarantines_the_whole_file(spark, base):
    store = StatsStore(spark, f"{base}/s", f"{base}/q")
    store.ingest("a", _file(spark, ["aa"], [(1, 1)]), {})
    before = state(store)
    got = store.ingest("b", _file(spark, ["bb"], [(1, 2)], extra=True), {}).collect()
    assert {r.status for r in got} == {"quarantined"} and state(store) == before
    assert spark.read.parquet(f"{base}/q/b/Log").count() == 1
    # a contract binds tables the store does not have yet
    other = StatsStore(spark, f"{base}/t", f"{base}/q2")
    contract = {"Log": spark.createDataFrame([], "GameId int, v long, kind string").schema}
    assert {r.status for r in other.ingest("c", _file(spark, ["cc"], [(1, 1)]), contract).collect()} == {"quarantined"}


def test_empty_tables_and_null_keys(spark, base):
    store = StatsStore(spark, f"{base}/s", f"{base}/q")
    f = _file(spark, ["aa"], [(1, 1)])
    f["GameResult"] = f["GameResult"].withColumn("GameId", F.lit(None).cast("int"))
    f["Log"] = f["Log"].filter("v > 5")
    got = sorted((r.table_name, r.status, r.rows) for r in store.ingest("a", f, {}).collect())
    assert got == [("GameResult", "accepted", 0), ("GameResult", "unmatched", 1), ("Log", "accepted", 0)]
    assert store.table("Log").count() == 0
