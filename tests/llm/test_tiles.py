"""The tiles of texts as images."""

import hashlib

import numpy as np

from quarrystone.llm import media, registry


def test_feature_holds_every_tile(spark, tmp_path):
    texts = {1: "abc " * 20_000, 2: "short", 3: None}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.feature.split(":") for r in registry.QUERIES["op2_media"](spark, str(tmp_path)).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        raw = (text or "").encode()
        rows = max(1, -(-len(raw) // 64))
        image = np.frombuffer(raw.ljust(rows * 64, b"\0"), "u1").reshape(rows, 64)
        want = hashlib.sha256()
        for r in range(-(-rows // 256)):
            part = image[256 * r : 256 * (r + 1)]
            block = media.npy(part)
            want.update(b"%d 0 %d %s\n" % (r, len(block), media.difference_hash(part).encode()) + block)
        assert got[doc][3] == want.hexdigest()[:16]
