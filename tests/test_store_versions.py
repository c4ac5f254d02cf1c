"""The store's versions: whatever step a rewrite is cut short at, no row is lost and readers see one version."""

import pytest

from marlstone.operators import store as stores
from marlstone.operators.store import ConcurrentRewrite, Store

SHAPE = "run_id string, model_id string"


class Cut(RuntimeError):
    pass


@pytest.fixture
def held(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.append("runs", spark.createDataFrame([("r1", "m"), ("r2", "o")], SHAPE))
    store.append("runs", spark.createDataFrame([("r1", "n")], SHAPE))
    return store


def seen(spark, store):
    return sorted((r["run_id"], r["model_id"]) for r in Store(spark, store.path).rows("runs").collect())


NOW = [("r1", "n"), ("r2", "o")]


@pytest.mark.parametrize("step", ["before the write", "in the write", "before the pointer", "in the pointer"])
def test_a_rewrite_cut_short_at_any_step_changes_nothing(spark, held, monkeypatch, step):
    def cut(*_a, **_k):
        raise Cut

    if step == "before the write":
        monkeypatch.setattr(Store, "_read", cut)
    elif step == "before the pointer":
        monkeypatch.setattr(Store, "_point", cut)
    elif step == "in the pointer":

        def torn(self, name, number, said):
            path, fs = self._hadoop(f"{name}/{stores.POINTERS}/{number:010d}")
            stream = fs.create(path, False)
            stream.write(bytearray(said[0][:5].encode()))
            stream.close()
            raise Cut

        monkeypatch.setattr(Store, "_point", torn)
    with pytest.raises((Cut, Exception)):
        if step == "in the write":
            held._rewrite("runs", lambda rows: rows.selectExpr("*", "raise_error('cut') AS x"))
        else:
            held.compact("runs")
    monkeypatch.undo()
    assert seen(spark, held) == NOW and held.all_rows("runs").count() == 3
    # What comes after goes on from there: another append, another rewrite, then the remains are removed.
    held.append("runs", spark.createDataFrame([("r3", "p")], SHAPE))
    held.compact("runs")
    assert seen(spark, held) == [*NOW, ("r3", "p")] and held.all_rows("runs").count() == 3
    held.vacuum("runs")
    assert seen(spark, held) == [*NOW, ("r3", "p")] and len(held._children("runs")) == 2


def test_rows_appended_while_a_rewrite_runs_still_count(spark, held):
    def slow(rows):
        held.append("runs", spark.createDataFrame([("r9", "late")], SHAPE))
        return held._current("runs", rows).withColumn("written_at", rows["written_at"]) if False else rows

    held._rewrite("runs", slow)
    assert seen(spark, held) == [*NOW, ("r9", "late")]
    held.compact("runs")
    assert seen(spark, held) == [*NOW, ("r9", "late")] and held.all_rows("runs").count() == 3
    held._rewrite("runs", slow)
    assert held.all_rows("runs").count() == 4
    held.vacuum("runs")
    assert held.all_rows("runs").count() == 4 and seen(spark, held) == [*NOW, ("r9", "late")]


def test_the_second_of_two_rewrites_changes_nothing(spark, held):
    def meanwhile(rows):
        Store(spark, held.path).compact("runs")
        return rows.limit(0)

    with pytest.raises(ConcurrentRewrite):
        held._rewrite("runs", meanwhile)
    assert seen(spark, held) == NOW and held.version("runs").number == 1


def test_a_reader_goes_on_reading_the_version_that_it_began_on(spark, held):
    before = held.all_rows("runs")
    held.delete("runs", spark.createDataFrame([("r1",)], "run_id string"))
    assert before.count() == 3 and seen(spark, held) == [("r2", "o")]


def test_deleting_all_rows_and_tables_that_do_not_exist(spark, held, tmp_path):
    held.delete("runs", held.rows("runs").select("run_id"))
    assert seen(spark, held) == [] and held.rows("metric_results").count() == 0
    held.append("runs", spark.createDataFrame([("r5", "q")], SHAPE))
    assert seen(spark, held) == [("r5", "q")]
    empty = Store(spark, str(tmp_path / "none"))
    empty.compact("models")
    assert empty.rows("models").count() == 0


def test_files_of_the_earlier_layout_are_taken_over(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    spark.createDataFrame([("r1", "m", None)], f"{SHAPE}, written_at timestamp").write.parquet(str(tmp_path / "store" / "runs"))
    assert seen(spark, store) == [("r1", "m")]
    store.compact("runs")
    assert seen(spark, store) == [("r1", "m")]
