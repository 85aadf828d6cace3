"""State dicts in parts, and the nested JSON form."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.errors import StateDictError
from ordinate.frame import TensorFrame
from ordinate.sources import state


def made(spark):
    r = np.random.default_rng(1)
    arrays = {"a.weight": r.normal(size=(5, 7)), "a.bias": r.normal(size=(7,)), 'odd "name\\é].weight': r.normal(size=(2, 3, 4)), "z": np.array([1.5])}
    return arrays, state.state_dict(spark, {k: TensorFrame.from_data(spark, v.ravel().tolist(), v.shape) for k, v in arrays.items()})


def equal(got, arrays):
    assert got.keys() == arrays.keys()
    for k, v in arrays.items():
        np.testing.assert_array_equal(np.array(got[k].to_data(), np.float32).reshape(got[k].shape), v.astype(np.float32))


@pytest.mark.parametrize("part,piece", [(4, 7), (1 << 16, 1 << 20)])
def test_round_trips(spark, tmp_path, monkeypatch, part, piece):
    monkeypatch.setattr(state, "PART", part)
    monkeypatch.setattr(state, "PIECE", piece)
    arrays, s = made(spark)
    assert s.count() == (sum(-(-v.size // part) for v in arrays.values()))
    equal(state.tensors(s), arrays)
    for form in ("parquet", "json", "nested"):
        path = f"{tmp_path}/{form}"
        state.save(s, path, form)
        equal(state.tensors(state.load(spark, path, form)), arrays)
        equal(state.tensors(state.load(spark, path, form, "weight")), {k: v for k, v in arrays.items() if "weight" in k})
    documents = [json.loads(p.read_text()) for p in (tmp_path / "nested").iterdir() if p.name.startswith("part-")]
    assert {k for d in documents for k in d["entries"]} == arrays.keys()


def test_documents_of_others(spark, tmp_path, monkeypatch):
    """A checkpoint's document, other orders and spaces, null for NaN, empty tensors and documents."""
    monkeypatch.setattr(state, "PIECE", 11)
    one = {"step": 3, "state": {"entries": {"b": {"data": [1, 2.5, None, -3e-5], "shape": [2, 2]}, "none": {"shape": [0], "data": []}}}, "metadata": {"x": [1, {}]}}
    (tmp_path / "one.json").write_text(json.dumps(one, indent=2))
    rows = {r.name: r for r in state.load(spark, f"{tmp_path}/one.json", "nested").collect()}
    assert rows["b"].data[:2] == [1, 2.5] and np.isnan(rows["b"].data[2]) and rows["b"]["shape"] == [2, 2]
    assert rows["none"].data == [] and rows["none"]["shape"] == [0]
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "x").write_text('{"entries":{}}')
    assert state.load(spark, f"file://{tmp_path}/two", "nested").collect() == []
    for text in ('{"entries":{"a":{"shape":[1],"data":[1', '{"other":1}', '{"entries":{"a":{"shape":[1]}}}'):
        (tmp_path / "bad").write_text(text)
        with pytest.raises(Exception, match="breaks off|no entries|no data"):
            state.load(spark, f"{tmp_path}/bad", "nested").collect()


def test_filters_prune(spark, tmp_path, monkeypatch):
    """What is asked of names goes to the source, which then doesn't parse other tensors: their numbers may be no numbers."""
    (tmp_path / "d").write_text('{"entries":{"a.w":{"shape":[2],"data":[1,2]},"b.x":{"shape":[1],"data":[what]},"c.w":{"shape":[1],"data":[7]}}}')
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = lambda: state.load(spark, f"{tmp_path}/d", "nested")
        assert [r.data for r in read().where("name = 'a.w'").collect()] == [[1, 2]]
        assert sorted(r.name for r in state.filtered(read(), ".w").collect()) == ["a.w", "c.w"]
        assert [r.name for r in read().where(F.col("name").isin("c.w", "q") & F.col("name").startswith("c")).collect()] == ["c.w"]
        with pytest.raises(Exception, match="could not convert"):
            read().collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_loading_and_checkpoints(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "PART", 4)
    arrays, s = made(spark)
    other = s.where("name != 'z'").withColumn("data", F.transform("data", lambda v: v * 2))
    got = state.tensors(state.loaded(s, other, strict=False))
    equal(got, {k: v if k == "z" else np.float32(v) * 2 for k, v in arrays.items()})
    with pytest.raises(StateDictError, match="missing"):
        state.loaded(s, other)
    with pytest.raises(StateDictError, match="shapes"):
        state.loaded(s, s.withColumn("shape", F.array(F.lit(1).cast("bigint"))), strict=False)
    with pytest.raises(StateDictError, match="parts"):
        state.tensors(s.where("part != 1"))
    state.save_checkpoint(other, f"{tmp_path}/c", 9, {"k": 1})
    whole, step, meta = state.restored(f"{tmp_path}/c", s, strict=False)
    some, *_ = state.restored(f"{tmp_path}/c", s, pattern="bias")
    assert (step, meta) == (9, {"k": 1}) and state.value_count(whole).first()[0] == sum(v.size for v in arrays.values())
    equal(state.tensors(some), {k: np.float32(v) * 2 if "bias" in k else v for k, v in arrays.items()})
