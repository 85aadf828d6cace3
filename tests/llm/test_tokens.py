import random

import numpy as np
import pytest

from ordinate.llm import tokens as T

from .helpers import docs, table


def test_round_trip_on_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    e = T.encoder(T.VOCABULARY)
    want = sorted(len(e.encode_ordinary(r.text or "")) for r in d.collect())
    got = T.document_counts(d).collect()
    assert sorted(r.n_tokens for r in got) == want and len({(r.file, r.doc_no) for r in got}) == len(got)


@pytest.mark.parametrize("block,run,width", [(2, 4, 2), (8, 2, 4), (64, 512, 2), (1000, 1, 4)])
def test_flat_files(spark, tmp_path, monkeypatch, block, run, width):
    """Files with empty documents, documents over many blocks, and tokens after the last separator."""
    monkeypatch.setattr(T, "RUN", run)
    r, want = random.Random(block), {}
    for f in range(5):
        texts = [[r.randint(0, 50) for _ in range(r.choice([0, 0, 1, 3, 50, 300]))] for _ in range(r.choice([0, 1, 20]))]
        last = [r.randint(0, 50) for _ in range(r.choice([0, 7, 300]))]
        np.array(sum([t + [99] for t in texts], []) + last, f"<u{width}").tofile(tmp_path / f"f{f}.bin")
        for k, t in enumerate(texts + ([last] if last else [])):
            want[f"f{f}.bin", k] = len(t)
    got = T.counts(T.read_blocks(spark, f"file://{tmp_path}", block), width, 99)
    assert {(x.file, x.doc_no): x.n_tokens for x in got.collect()} == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a"), (3, "x" * 50000), (4, "line\nline\r\n é中")]
    e = T.encoder(T.VOCABULARY)
    got = sorted([(r.doc_id, r.n_tokens) for r in T.document_counts(docs(spark, rows)).collect()], key=str)
    assert got == sorted([(i, len(e.encode_ordinary(t or ""))) for i, t in rows], key=str)
    assert T.document_counts(docs(spark, [])).count() == 0
