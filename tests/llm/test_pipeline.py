import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm import mixing, quality, queries


def test_pipeline(spark, sf):
    """Each stage against the operator's own decisions on the same input, and the end against the tokenizer library."""
    import base64

    import public_tokenizers as P
    import test_minhash
    import test_secrets
    import tiktoken

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        made[name] = [r.asDict() for r in now.collect()]
        now = spark.createDataFrame(made[name], now.schema)
    names = docs.columns
    assert all(list(r) == names for k in list(made)[:-1] for r in made[k])
    verdict = {r.doc_id: r.kept for r in queries.QUERIES["op9_quality"](spark, sf).collect()}
    assert {r["doc_id"] for r in made["quality"]} == {i for i, k in verdict.items() if k}
    want = test_minhash.brute([(r["doc_id"], r["text"]) for r in made["quality"]], corpus_pipeline.PERCENT)
    assert sorted(r["doc_id"] for r in made["near_duplicates"]) == sorted({c for _, c in want.values()})
    assert len(made["secrets"]) == len(made["near_duplicates"])
    assert all(not test_secrets.base(r["text"]) and r["n_chars"] == len(r["text"]) for r in made["secrets"])
    assert {r["doc_id"] for r in made["mixing"]} <= {r["doc_id"] for r in made["secrets"]}
    assert sum(len(r["text"].split()) for r in made["mixing"]) > len(made["mixing"])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in made["mixing"]}
    assert sorted(r["doc_id"] for r in made["encoding"]) == sorted(r["doc_id"] for r in made["mixing"])
    for r in made["encoding"]:
        assert r["ids"] == library.encode_ordinary(text[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_edge_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, tk long, size int, _key int, _id int, _tk int, `a.b` int, _c0 int"
    rows = [(1, "a b c d e f", None, "s", 11), (1, "a b c d e f", None, "s", 11), (None, None, "en", None, 0), (None, "", "en", None, 0), (None, "x y", None, "t", 3), (None, "p q", None, "t", 3)]
    rows = [(*r, 0, 0, 1, 2, 3, 4, 5) for r in rows]
    spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and all(tuple(r)[5:] == (0, 0, 1, 2, 3, 4, 5) for r in got.collect()), name
    assert corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).count() == 5
    for df in (docs, docs.limit(0)):
        df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert {r.doc_id for r in got} <= {1, None} and (len(got) >= 3) == (df is docs)
