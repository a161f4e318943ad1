"""The stages one after the other on the smallest tables: each works on what the one before kept."""

from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from .conftest import WORD
from .test_jaccard_join import brute

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns or name == "token_ids"
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    ids = {k: Counter(r.doc_id for r in v) for k, v in kept.items()}
    assert ids["quality"] <= ids["documents"] and ids["near_duplicates"] <= ids["quality"]
    assert ids["decontamination"] <= ids["near_duplicates"] and set(ids["mixing"]) <= set(ids["decontamination"])
    assert max(ids["mixing"].values()) <= 3 and ids["token_ids"] == ids["mixing"]
    # One document of each component of all pairs.
    rows = [(r.doc_id, r.text) for r in kept["quality"]]
    least = {eval(x)[2] for x in brute(rows, corpus_pipeline.NEAR) if eval(x)[1]}
    wordless = {i for i, t in rows if not WORD.search(t or "")}
    assert set(ids["near_duplicates"]) == least | wordless
    # The ids of every document of the mix, one after the other.
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in kept["mixing"]}
    at = 0
    for r in sorted(kept["token_ids"], key=lambda r: r.start):
        expect = [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(expect), crc32(np.array(expect, "<u4").tobytes()))
        at += r.n_tokens
