"""The whole pipeline against brute force."""

import random
import re
import zlib

import numpy as np
from test_results import brute_links, plain_distance

import corpus_pipeline
from lakesift.llm import vocabulary


def test_run_is_brute_force(spark, tmp_path):
    r = random.Random(11)
    some = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    item = [f"q{i}" for i in range(12)]
    edited = [*item[:5], "other", *item[6:]]
    long, copied = some(60), " ".join(some(20))
    rows = [(i, f"this {'idiot' if i % 2 else 'garden'} thing number {i} stands here") for i in range(60)]
    rows += [(100, " ".join(long)), (101, " ".join([*long[:-1], "changed"])), (103, copied), (102, copied), (None, "no id: " + " ".join(some(15)))]
    rows += [(None, " ".join(some(9) + item + some(9))), (110, " ".join(some(30))), (110, " ".join(some(8) + item)), (111, " ".join(edited + some(20)))]
    rows += [(112, f"{' '.join(some(9))} password = hunter22 {' '.join(some(9))}"), (113, "you idiot " + " ".join(some(5))), (121, ""), (120, None)]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def close(text):
        words = re.findall("[a-z0-9]+", text.lower())
        return any(plain_distance(words[a:a + 12], item) <= 2 for a in range(max(1, len(words) - 11)))

    kept = sorted(((d, t or "") for d, t in rows if "idiot" not in (t or "")), key=lambda x: (x[0] is None, x[0] or 0))
    classes = brute_links({i: t for i, (_, t) in enumerate(kept)})
    kept = [(d, re.sub("password = [a-z0-9]+", "[SECRET]", t)) for i, (d, t) in enumerate(kept) if classes[i][0] == i and not close(t)]
    assert [d for d, _ in kept if d is None or d >= 100] == [100, 102, 110, 112, 120, None]

    enc = vocabulary.Encoder(vocabulary.default_path())
    ids = [(d, np.array([*enc.model.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")) for d, t in kept]
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in found), key=str) == sorted(((d, 0, 0, len(x), zlib.crc32(x.tobytes())) for d, x in ids), key=str)
    end = 0
    for x in sorted(found, key=lambda x: x["offset"]):
        assert x["offset"] == end and x["sequence_id"] == found[0]["sequence_id"]
        end += x["length"]
    assert end <= 4096
