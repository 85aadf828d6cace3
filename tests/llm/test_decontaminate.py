import hashlib

from pyspark.sql import functions as F

from ordinate.llm import decontaminate as D

from .helpers import docs, table


def brute(rows, items, size=10):
    """The digest by sliding each window over each document."""
    out = []
    found = [(str(i) if i is not None else "null", D.words(t.encode() if t is not None else None)) for i, t in items]
    for doc_id, text in rows:
        w, hit, names = D.words(text.encode() if text is not None else None), set(), set()
        for name, item in found:
            for s in range(max(1, len(item) - size + 1) if item else 0):
                window = item[s : s + size]
                for at in range(len(w) - len(window) + 1):
                    if w[at : at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        names.add(name)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, rows, items):
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.report(docs(spark, rows), b)
    return sorted([tuple(r)[:6] for r in got.collect()], key=str)


def test_against_brute_force_on_the_fixture(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    assert run(spark, rows, items) == brute(rows, items)


def test_edges(spark):
    passage = "One two, three four FIVE six seven eight nine ten eleven É twelve"
    rows = [
        (1, passage), (1, passage), (2, None), (3, ""), (None, "x " + passage.upper()), (4, "one two three four five"), (5, "short item here"),
        (6, "!!! ..."), (7, "one two three four five six seven eight nine one two three four five six seven eight nine ten"), (8, "word " * 60000 + passage),
    ]
    items = [(10, passage), (9, "short, ITEM"), (9, "four five"), (None, "x one"), (11, None), (12, "???")]
    assert run(spark, rows, items) == brute(rows, items)
    assert run(spark, rows, []) == brute(rows, []) and run(spark, [], items) == []


def test_a_large_test_set_is_searched_in_rounds(spark, sf_dir, monkeypatch):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    monkeypatch.setattr(D, "ROUND_WORDS", sum(len(D.words(t.encode())) for _, t in items) // 3)
    monkeypatch.setattr(D, "STEP", 100)
    assert run(spark, rows, items) == brute(rows, items)


def test_extra_columns_and_removal(spark):
    given = docs(spark, [(1, "a b c d e f g h i j k"), (2, "clean text")]).withColumns({"contaminated": F.lit("x"), "hit_id": F.lit(5)})
    b = spark.createDataFrame([(1, "b c d e f g h i j k")], "item_id bigint, text string")
    kept = D.remove_contaminated(given, b)
    assert kept.columns == given.columns and [r.doc_id for r in kept.collect()] == [2]


def test_phrases_and_proximity(spark):
    given = docs(spark, [(1, "the red quick fox"), (2, "the quick red fox jumps"), (3, None)])
    index = D.build_index(given)
    exact = {(r.doc_id, r.phrase_id, r.position) for r in D.match(index, {"p": "red fox", "q": ""}).collect()}
    near = {(r.doc_id, r.exact) for r in D.match(index, {"p": "red fox"}, slop=1).collect()}
    assert exact == {(2, "p", 2)} and near == {(1, False), (2, True)}


def test_index_is_decoded_and_sent_in_pieces_of_bounded_size(spark, monkeypatch):
    """However much text a task of the index has: a row group is a few MB, and so is a batch that the search gets. Segments change no result."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    text = F.expr("concat_ws(' ', transform(sequence(1, 8000), k -> hex(pmod(xxhash64(id, k), 100000))))")
    given = spark.range(400).select(F.col("id").alias("doc_id"), text.alias("text")).coalesce(1)
    item = " ".join(given.where("doc_id = 7").first().text.split()[100:115])
    tests, tables, write = spark.createDataFrame([("a", item)], "item_id string, text string"), [], D.written
    monkeypatch.setattr(D, "written", lambda *a: tables.append(write(*a)) or tables[-1])
    got = {r.doc_id: r.n_hit for r in D.report(given, tests).collect()}
    assert got == {i: 15 * (i == 7) for i in range(400)}
    [path] = [p for p in tables[0].inputFiles() if p.endswith(".parquet")]
    meta = pq.ParquetFile(path.removeprefix("file://")).metadata
    assert meta.num_rows == sum(meta.row_group(k).num_rows for k in range(meta.num_row_groups))
    assert max(meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)) < 16 << 20

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes])})

    assert max(r.n for r in tables[0].mapInArrow(sizes, "n bigint").collect()) < 32 << 20
