"""Ordinal ids of all documents, by brute force; tests/test_oracle.py holds the query against its SQL."""

import numpy as np

from chunkweave.plans import catalog


def test_all_documents_in_base_36(spark, sf):
    want = {r.doc_id: -(-len((r.text or "").encode()) // 4096) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalog.QUERIES["ordinal_ids"](spark, sf).collect()
    assert len(rows) == len(want) and max(want) >= 36
    assert {r.file_id: (r.blocks, r.short_id) for r in rows} == {i: (n, np.base_repr(i, 36).lower().zfill(8)) for i, n in want.items()}
