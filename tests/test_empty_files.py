"""Files without bytes are stored, synchronised and restored like any other."""

import pytest

from chunkweave.operators import store
from chunkweave.plans import catalog, sync
from chunkweave.sources.files import files_of
from tests.test_plans import PARAMS, contents

TEXTS = [(0, None), (1, ""), (2, "ab" * 900), (3, "cd" * 900), (4, ""), (5, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([(i, t, "s", "en") for i, t in TEXTS], "doc_id long, text string, source string, lang string").write.parquet(f"{path}/documents.parquet")
    return path


def test_upload_and_sync_restore_empty_files(spark, folder):
    documents = files_of(spark.read.parquet(f"{folder}/documents.parquet"))
    a, b = (sync.upload(documents.where(f"file_id % 2 = {k}"), PARAMS, name=f"c{k}").persisted() for k in (0, 1))
    assert contents(sync.restore(a)) == {i: (t or "").encode() for i, t in TEXTS if i % 2 == 0}
    done = sync.synchronise(a, b, PARAMS)
    assert contents(sync.restore(done.target.persisted())) == {i: (t or "").encode() for i, t in TEXTS}
    assert store.wanted_recipes(documents.where("file_id in (0, 2)"), a.recipes, files=a.files).select("file_id").distinct().count() == 1
    with pytest.raises(Exception, match="recipe is not whole of file 2"):
        sync.restore(sync.Cloud(a.recipes.where("pos > 0"), a.meta, a.data, a.files)).collect()


def test_queries_restore_empty_files(spark, folder):
    assert {(r.file_id, r.file_size, r.n_chunks) for r in catalog.restore_check(spark, folder).collect()} == {(i, len(t or ""), -(-len(t or "") // 256)) for i, t in TEXTS}
    assert {r.file_id for r in catalog.sync_e2e(spark, folder).collect()} == {i for i, _ in TEXTS}
