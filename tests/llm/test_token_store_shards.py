"""Many shards: starts go on from shard to shard, also where ids repeat on their borders."""

import random
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from docloom.llm.token_store import read_token_store, write_token_store


def test_starts_over_many_shards(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(5)
    rows = [(rng.choice([None, rng.randrange(60), rng.randrange(10**6)]), " ".join(rng.choice(["river", "stone", "é", "日本", "42"]) for _ in range(rng.randrange(30)))) for _ in range(600)]
    rows += [(31, f"again {i}") for i in range(80)] + [(None, None), (-5, ""), (7, None)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        manifest = write_token_store(frame, path)
        shards = manifest.collect()
        got = sorted((tuple(r) for r in read_token_store(manifest, frame).collect()), key=lambda r: r[1])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert len(shards) >= 8 and all(s.n_ids > 0 for s in shards)
    assert sum(s.n_ids for s in shards) == start
    assert got == want
