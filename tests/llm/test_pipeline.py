"""The pipeline against a brute-force version of its stages on the fixture."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from ordinate.llm import common, decontaminate, language, lines, mixing  # noqa: E402

from . import test_decontaminate, test_jaccard, test_language, test_lines  # noqa: E402
from .helpers import docs, table  # noqa: E402


def brute(documents, benchmark):
    """Rows are (doc_id, text, lang, source); returns those that reach the last stage."""
    judged = test_language.brute([(r[1], r[2], r[3]) for r in documents])
    rows = [r for r, (code, p) in zip(documents, judged) if code != language.UNDETERMINED and p >= language.MIN_CONFIDENCE]
    cleaned = test_lines.brute([r[:2] for r in rows])
    rows = [(r[0], cleaned[r[0]], *r[2:]) for r in rows if cleaned[r[0]] == r[1] or any(len(lines.normalised(x.encode())) >= lines.MIN_WORDS for x in cleaned[r[0]].split("\n"))]
    groups = dict((i, c) for i, _, c in test_jaccard.brute([r[:2] for r in rows]))
    rows = [r for r in rows if groups[r[0]] == r[0]]
    hit = {r[0]: r[5] for r in test_decontaminate.brute([r[:2] for r in rows], benchmark)}
    return [r for r in rows if not hit[r[0]]]


def test_against_brute_force(spark, sf_dir):
    documents = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").collect()]
    benchmark = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    want = brute(documents, benchmark)
    last = {r.doc_id: (r.text, round(r.probability, 9)) for r in mixing.mixed(docs(spark, want)).collect()}
    got = {r.doc_id: (r.text, round(r.probability, 9)) for r in pipeline.run(spark, sf_dir).collect()}
    assert got == last and 0 < len(got) < len(documents)


def test_stages_keep_columns_and_bear_edges(spark, sf_dir):
    odd = docs(spark, [(None, None, None, None), (1, "", "en", "s"), (1, "", "en", "s"), (2, "plain words that are here", "en", "s"), (3, "word " * 50000, "en", None)])
    for given in (odd, docs(spark, [])):
        d = given
        for k, (_, stage) in enumerate(pipeline.STAGES):
            d = common.written(stage(spark, d, sf_dir), f"test{k}")
            if k < len(pipeline.STAGES) - 1:
                assert d.columns == given.columns
        assert d.count() <= given.count()


def test_columns_of_any_name_stay(spark, sf_dir):
    """Names that operators use for their own columns."""
    from pyspark.sql import functions as F

    names = ["language", "confidence", "accepted", "n_lines", "n_removed", "_lang", "component_id", "contaminated", "node", "topic"]
    given = docs(spark, [(1, "plain words that are here and nowhere else", "en", "s"), (2, "other words of another text, which stays", "en", "s")])
    given = given.withColumns({c: F.lit(f"mine {c}") for c in names})
    for k, (_, stage) in enumerate(pipeline.STAGES):
        got = stage(spark, given, sf_dir).collect()
        mine = names[:-1] if k == len(pipeline.STAGES) - 1 else names
        assert (k == 4 or len(got) == 2) and all(r[c] == f"mine {c}" for r in got for c in mine)


def test_names():
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    assert decontaminate.WINDOW == 10


def test_a_document_goes_only_if_no_line_is_left(spark, sf_dir):
    given = docs(spark, [(1, "one line that repeats"), (2, "one line that repeats\nown"), (3, "one line that repeats\n \n"), (4, "one line that repeats\n※※※\n***")])
    assert sorted(r.doc_id for r in pipeline.dedup_lines(spark, given, sf_dir).collect()) == [1, 2, 4]
