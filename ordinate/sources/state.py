"""State dicts: rows of (name, shape, part, data), a stretch of PART values each, in Parquet or JSON; checkpoints add a step and metadata.

The nested form is the JSON document {"entries": {name: {"shape": [...], "data": [...]}}}. It is written as several such documents, a tensor
in one of them, by a task that holds a part at a time, and read by a data source that finds where tensors lie, passes over those that aren't wanted
without looking at their numbers, and gives the others part by part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from ..errors import StateDictError
from ..frame import TensorFrame, unravelled

#: Values of a part, and bytes of a nested document that are read at a time.
PART, PIECE = 1 << 16, 1 << 20
SCHEMA = "name string, shape array<bigint>, part bigint, data array<float>"
_ARROW = pa.schema([("name", pa.string()), ("shape", pa.list_(pa.int64())), ("part", pa.int64()), ("data", pa.list_(pa.float32()))])


def state_dict(spark: SparkSession, tensors: dict[str, TensorFrame]) -> DataFrame:
    """The parts of all tensors, their values row-major as float32, by one grouping of their cells."""
    cells = None
    for name, t in sorted(tensors.items()):
        shape = F.array(*[F.lit(n) for n in t.shape]).cast("array<bigint>")
        own = t.df.select(F.lit(name).alias("name"), shape.alias("shape"), t.linear().alias("_at"), F.col("v").cast("float").alias("_v"))
        cells = own if cells is None else cells.unionByName(own)
    if cells is None:
        return spark.createDataFrame([], SCHEMA)
    rows = cells.groupBy("name", "shape", F.floor(F.col("_at") / PART).cast("bigint").alias("part")).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_c"))
    return rows.select("name", "shape", "part", F.transform("_c", lambda c: c._v).alias("data"))  # a part at most


def tensors(state: DataFrame, names: list[str] | None = None) -> dict[str, TensorFrame]:
    """The tensors of a state dict; names and shapes come to the driver, values do not."""
    kept = state if names is None else state.where(F.col("name").isin(names))
    sizes = kept.groupBy("name").agg(F.min("shape").alias("shape"), F.max("shape").alias("other"), F.sum(F.size("data")).alias("n"), F.count("*").alias("rows"), F.countDistinct("part").alias("parts"), F.max("part").alias("last"))
    out = {}
    for r in sizes.collect():
        shape = tuple(r.shape)
        if int(np.prod(shape, dtype=np.int64)) != r.n or r.shape != r.other or not r.rows == r.parts == r.last + 1:
            raise StateDictError(f"{r.name}: {r.n} values in {r.rows} parts for {list(shape)}")
        cells = state.where(F.col("name") == r.name).select("part", F.posexplode("data").alias("_at", "v"))
        at = F.col("part") * PART + F.col("_at")
        out[r.name] = TensorFrame(cells.select(*unravelled(at, shape), F.col("v").cast("double").alias("v")), shape)
    return out


def filtered(state: DataFrame, pattern: str) -> DataFrame:
    """Entries whose names contain a text."""
    return state.where(F.col("name").contains(pattern))


def loaded(into: DataFrame, state: DataFrame, strict: bool = True) -> DataFrame:
    """into with the data of state. strict: both have the same names. Shapes must agree where both have a name."""
    if strict:
        missing = into.join(state, "name", "left_anti").select("name").distinct().limit(5).collect()
        extra = state.join(into, "name", "left_anti").select("name").distinct().limit(5).collect()
        if missing or extra:
            raise StateDictError(f"missing {[r.name for r in missing]}, unexpected {[r.name for r in extra]}")
    given = state.where("part = 0").select("name", F.col("shape").alias("_shape"))
    wrong = into.where("part = 0").join(given, "name").where(F.col("_shape") != F.col("shape")).limit(5).collect()
    if wrong:
        raise StateDictError(f"shapes differ: {[r.name for r in wrong]}")
    both = into.join(state.select("name", "part", F.col("data").alias("_data")), ["name", "part"], "left")
    return both.select("name", "shape", "part", F.coalesce("_data", "data").alias("data"))


def save(state: DataFrame, path: str, form: str = "parquet") -> None:
    """form: parquet, json (a line a part) or nested."""
    state = state.select("name", "shape", "part", F.col("data").cast("array<float>").alias("data"))
    if form == "nested":
        save_nested(state, path)
    else:
        state.write.mode("overwrite").format(form).save(path)


def load(spark: SparkSession, path: str, form: str = "parquet", pattern: str | None = None) -> DataFrame:
    """The state at path, or what of it has names that contain pattern."""
    if form == "nested":
        spark.dataSource.register(NestedState)
        reader = spark.read.format(NestedState.name()).options(path=path, pushdown=spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
        return (reader if pattern is None else reader.option("contains", pattern)).load()
    state = spark.read.format(form).schema(SCHEMA).load(path)
    return state if pattern is None else filtered(state, pattern)


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts come sorted by (name, part): the lines of one document."""
    name, any_ = None, False
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            own, shape, data = (batch.column(c)[row] for c in ("name", "shape", "data"))
            values = data.values.to_numpy()
            text = ",".join("null" if x != x else repr(x) for x in values.astype(np.float64).tolist())
            if own.as_py() != name:
                name = own.as_py()
                out.append(("]},\n" if any_ else '{"entries":{\n') + f'{json.dumps(name)}:{{"shape":{json.dumps(shape.as_py())},"data":[{text}')
            else:
                out.append(("," if text else "") + text)
            any_ = True
        yield pa.RecordBatch.from_pydict({"value": out})
    yield pa.RecordBatch.from_pydict({"value": ["]}}}" if any_ else '{"entries":{}}']})


def save_nested(state: DataFrame, path: str, files: int | None = None) -> None:
    """Documents of the nested form, one a task, in a folder; NaN is written as null."""
    parts = files or state.sparkSession.sparkContext.defaultParallelism
    ordered = state.repartitionByRange(parts, "name").sortWithinPartitions("name", "part")
    ordered.select("name", "shape", "data").mapInArrow(_rendered, "value string").write.mode("overwrite").text(path)


def _opened(path: str) -> tuple[object, str]:
    from pyarrow import fs

    return (fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)) if path.startswith(("file:", "/")) else fs.FileSystem.from_uri(path)


class NestedState(DataSource):
    """The nested form as (name, shape, part, data). Options: path, a document or a folder of them; contains, a text that names must have;
    pushdown, whether the session hands filters over (spark.sql.python.filterPushdown.enabled)."""

    @classmethod
    def name(cls) -> str:
        return "nested_state"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = _FilteringReader if self.options.get("pushdown") == "true" else _NestedReader
        return kind(self.options["path"], self.options.get("contains", ""))


class _Document(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _NestedReader(DataSourceReader):
    def __init__(self, path: str, contains: str) -> None:
        self.path, self.tests = path, [("contains", contains)]

    def wanted(self, name: str) -> bool:
        said = {"equals": lambda v: name == v, "among": lambda v: name in v, "contains": lambda v: v in name, "starts": name.startswith, "ends": name.endswith}
        return all(said[k](v) for k, v in self.tests)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, at = _opened(self.path)
        if store.get_file_info(at).type == fs.FileType.File:
            return [_Document(self.path)]
        found = store.get_file_info(fs.FileSelector(at, recursive=False))
        return [_Document(f"{self.path.rstrip('/')}/{f.base_name}") for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"]

    def read(self, document: _Document) -> Iterator[pa.RecordBatch]:
        store, at = _opened(document.path)
        with store.open_input_file(at) as file:
            for name, shape, start, end in entries(file):
                if self.wanted(name):
                    yield from _parts(file, name, shape, start, end)


class _FilteringReader(_NestedReader):
    """The same, in sessions that hand filters over to sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes what is said of names."""
        kinds = {EqualTo: "equals", In: "among", StringContains: "contains", StringStartsWith: "starts", StringEndsWith: "ends"}
        for f in filters:
            if type(f) in kinds and f.attribute == ("name",):
                self.tests.append((kinds[type(f)], f.value))
            else:
                yield f


def entries(file) -> Iterator[tuple[str, list[int], int, int]]:
    """(name, shape, start, end) of each tensor of a document: where the numbers of its data lie. Only what stands between them is looked at."""
    size, held, base = file.size(), b"", 0

    def more() -> bool:
        nonlocal held
        data = file.read_at(min(PIECE, size - base - len(held)), base + len(held)) if base + len(held) < size else b""
        held += data
        return bool(data)

    def passed(n: int) -> None:
        nonlocal held, base
        held, base = held[n:], base + n

    def upto(pattern: re.Pattern) -> re.Match:
        while not (m := pattern.match(held)):
            if not more():
                raise StateDictError(f"the document breaks off or is of another form at byte {base}")
        return m

    def skip(to: bytes) -> int:
        """Goes to the next of to, wherever it is; its place."""
        while (k := held.find(to)) < 0:
            passed(len(held))
            if not more():
                raise StateDictError("the document breaks off")
        passed(k)
        return base

    while b'"entries"' not in held:
        if len(held) > PIECE:
            passed(len(held) - 16)
        if not more():
            raise StateDictError("the document has no entries")
    passed(held.index(b'"entries"') + 9)
    passed(upto(re.compile(rb"\s*:\s*\{")).end())
    name, field = re.compile(rb'\s*,?\s*("(?:[^"\\]|\\.)*")\s*:\s*\{'), re.compile(rb'\s*,?\s*"(shape|data)"\s*:\s*\[')
    while not upto(re.compile(rb'\s*(\}|,|")')).group(1) == b"}":
        m = upto(name)
        own = json.loads(m.group(1))
        passed(m.end())
        found: dict[bytes, tuple[int, int]] = {}
        shape: list[int] = []
        while upto(re.compile(rb'\s*(\}|,|")')).group(1) != b"}":
            m = upto(field)
            passed(m.end())
            start = base
            end = skip(b"]")
            found[m.group(1)] = (start, end)
            passed(1)
        passed(upto(re.compile(rb"\s*\}")).end())
        if found.keys() != {b"shape", b"data"}:
            raise StateDictError(f"{own} has no shape or no data")
        text = file.read_at(found[b"shape"][1] - found[b"shape"][0], found[b"shape"][0])
        shape = [int(x) for x in text.split(b",") if x.strip()]
        yield own, shape, *found[b"data"]


def _parts(file, name: str, shape: list[int], start: int, end: int) -> Iterator[pa.RecordBatch]:
    """The numbers between two places, PART at a time."""
    left, values, part = b"", np.zeros(0, np.float32), 0

    def row(v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([shape], pa.list_(pa.int64())), pa.array([part], pa.int64()), pa.array([v], pa.list_(pa.float32()))], schema=_ARROW)

    while start < end or left.strip():
        data = file.read_at(min(PIECE, end - start), start) if start < end else b""
        start += len(data)
        whole, comma, left = (left + data).rpartition(b",") if start < end else (left + data, b"", b"")
        if start < end and not comma:
            continue
        numbers = [float("nan") if x.strip() == b"null" else float(x) for x in whole.split(b",")] if whole.strip() else []
        values = np.concatenate([values, np.array(numbers, np.float32)])
        while len(values) >= PART:
            yield row(values[:PART])
            values, part = values[PART:], part + 1
    if len(values) or not part:
        yield row(values)


def save_checkpoint(state: DataFrame, path: str, step: int, metadata: dict | None = None) -> None:
    """state and a one-row table of step and metadata, side by side."""
    save(state, f"{path}/state")
    row = [(int(step), json.dumps(metadata or {}, sort_keys=True))]
    state.sparkSession.createDataFrame(row, "step bigint, metadata string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, int, dict]:
    meta = spark.read.schema("step bigint, metadata string").json(f"{path}/meta").first()
    return load(spark, f"{path}/state"), meta.step, json.loads(meta.metadata)


def restored(path: str, into: DataFrame, strict: bool = True, pattern: str | None = None) -> tuple[DataFrame, int, dict]:
    """into with the data of a checkpoint, or of its entries whose names contain pattern (then not strict), and its step and metadata."""
    state, step, metadata = load_checkpoint(into.sparkSession, path)
    if pattern is not None:
        state, strict = filtered(state, pattern), False
    return loaded(into, state, strict), step, metadata


def value_count(state: DataFrame) -> DataFrame:
    return state.agg(F.coalesce(F.sum(F.size("data")), F.lit(0)).alias("n_values"))
