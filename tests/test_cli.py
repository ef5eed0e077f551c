"""The command line, over a folder of files."""

import random

from chunkweave.__main__ import main


def test_upload_sync_restore(spark, tmp_path, capsys):
    r = random.Random(1)
    shared = r.randbytes(40_000)
    for cloud, own in (("a", b"one"), ("b", b"two")):
        (tmp_path / cloud).mkdir()
        (tmp_path / cloud / "f").write_bytes(shared[:20_000] + own + shared[20_000:])
        main(["upload", f"{tmp_path}/{cloud}", f"{tmp_path}/store-{cloud}"], spark)
    main(["sync", f"{tmp_path}/store-a", f"{tmp_path}/store-b", f"{tmp_path}/both"], spark)
    main(["restore", f"{tmp_path}/both", f"{tmp_path}/out"], spark)
    got = {bytes(x.content) for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(tmp_path / c / "f").read_bytes() for c in "ab"}
    main(["stats", f"{tmp_path}/both"], spark)
    main(["synth", f"{tmp_path}/synth", "--bytes", "50000"], spark)
    assert "missing" in capsys.readouterr().out and spark.read.parquet(f"{tmp_path}/synth").count() == 4
