import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vanflow.sources import slices
from vanflow.sources import stores as st

SCHEMA = "TrxDate date, RouteCode string, Quantity int"
BY = ["TrxDate", "RouteCode"]


def held(spark, path, **kw):
    out = slices.read(spark, path, T.StructType.fromDDL(SCHEMA), **kw)
    return sorted((str(r.TrxDate), r.RouteCode or "", r.Quantity) for r in out.collect())


@pytest.mark.parametrize("step", ["_written", "_switch"])
def test_a_write_that_dies_before_the_switch_leaves_the_old_slices(spark, rows, tmp_path, monkeypatch, step):
    path = str(tmp_path / "store")
    slices.replace(rows([("2024-01-01", "1", 1), ("2024-01-01", "2", 2)], SCHEMA), path, BY)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(slices, step, die)
        with pytest.raises(RuntimeError):
            slices.replace(rows([("2024-01-01", "2", 9)], SCHEMA), path, BY)
    before = [("2024-01-01", "1", 1), ("2024-01-01", "2", 2)]
    assert held(spark, path) == before
    os.makedirs(tmp_path / "store" / "manifest" / "000000000002")  # a manifest without its marker
    assert held(spark, path) == before
    slices.replace(rows([("2024-01-01", "2", 5)], SCHEMA), path, BY)
    assert held(spark, path) == [("2024-01-01", "1", 1), ("2024-01-01", "2", 5)]


def test_codes_keep_their_type_and_odd_characters(spark, rows, tmp_path):
    path = str(tmp_path / "a b+c%20")
    data = [("2024-01-01", "007", 1), ("2024-01-01", "a/b=c d+e%41*", 2), (None, None, 3), ("2024-01-02", "", 4)]
    slices.replace(rows(data, SCHEMA), path, BY)
    out = slices.read(spark, path)
    assert dict(out.dtypes) == {"TrxDate": "date", "RouteCode": "string", "Quantity": "int"}
    got = {r.Quantity: r.RouteCode for r in out.collect()}
    assert got == {1: "007", 2: "a/b=c d+e%41*", 3: None, 4: None}
    slices.replace(rows([(None, None, 6), ("2024-01-01", "a/b=c d+e%41*", 7)], SCHEMA), path, BY)
    assert sorted(r.Quantity for r in slices.read(spark, path).collect()) == [1, 4, 6, 7]
    assert held(spark, path, where=F.col("RouteCode") == "007") == [("2024-01-01", "007", 1)]


def test_empty_frames_and_whole_replacement(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    assert held(spark, path) == []
    with pytest.raises(FileNotFoundError):
        slices.read(spark, path)
    slices.replace(rows([("2024-01-01", "1", 1)], SCHEMA), path, BY)
    slices.replace(rows([], SCHEMA), path, BY)
    assert held(spark, path) == [("2024-01-01", "1", 1)]
    slices.replace(rows([("2024-01-02", "2", 2)], SCHEMA), path, BY, whole=True)
    assert held(spark, path) == [("2024-01-02", "2", 2)]
    slices.replace(rows([], SCHEMA), path, BY, whole=True)
    assert held(spark, path) == []


def test_superseded_folders_go(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    for i in range(6):
        slices.replace(rows([("2024-01-01", "1", i), ("2024-01-01", str(2 + i), i)], SCHEMA), path, BY)
    # RouteCode=1 is there in the newest two versions only; the slices written once all stay.
    kept = [p for p in (tmp_path / "store" / "data").glob("*/*/RouteCode=1")]
    assert len(kept) == 2 and len(held(spark, path)) == 7
    assert len(list((tmp_path / "store" / "manifest").iterdir())) == 2


def test_an_artifact_without_slices_is_replaced_whole(spark, rows, tmp_path):
    base = str(tmp_path / "artifacts")
    for codes in (["1", "2"], ["3"], []):
        st.write_artifact(rows([("2024-01-01", c, 1) for c in codes], SCHEMA), base, "pair_classes")
        assert [r.RouteCode for r in st.read_artifact(spark, base, "pair_classes").orderBy("RouteCode").collect()] == codes
