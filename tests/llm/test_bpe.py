import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken

from tidemark.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed=5):
    rng = random.Random(seed)
    bits = ["'s", "'re", "'", "''s", " 'll", "\n've", "don't", " ", "  ", "\n", "\t ", " ", " ", "\x1c", "abc", "É", "漢字", "12", "²", "!", "?!", "😀", "_", "the", " of", "'T", "a" * 40, "\r\n", "é", "٣", "ß", "\x00", "<|endoftext|>"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def test_split_points():
    """Texts laid end to end are split as each is alone, and the parts cover them."""
    texts = [t for t in random_texts(3000) if t and "\x1c" not in t]  # the regex library counts \x1c as white space
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    first = np.cumsum([0, *map(len, texts)])[:-1]
    got = bpe.split_points(points, first)
    want = [a + m.start() for a, t in zip(first, texts) for m in regex.finditer(P.PATTERN, t)]
    assert got.tolist() == want


def test_encode_matches_reference(reference):
    texts = [*random_texts(2000), "", "x" * 5000, "ab" * 3000, "".join(random.Random(1).choice("abcdefghij") for _ in range(4000)), " " * 700, "9" * 900]
    ids, counts = bpe.coder(PATH).encode(pa.array(texts, pa.large_string()))
    at = 0
    for t, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == reference.encode_ordinary(t), repr(t)
        at += n
    assert bpe.coder(PATH).decode(ids).tobytes() == "".join(texts).encode()


def test_vocabulary_of_any_order(tmp_path):
    """Ranks in no order at all, so that merges make pairs of lower rank: long and short rows do what single merges do."""
    rng = random.Random(3)
    for case in range(40):
        tokens = list({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 7))) for _ in range(60)})
        tokens += [bytes([b]) for b in range(256)]
        rng.shuffle(tokens)
        path = tmp_path / f"{case}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
        ranks, own = {t: i for i, t in enumerate(tokens)}, bpe.Coder(str(path))
        pieces = [bytes(rng.choice(b"abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(2, 60) * rng.choice([1, 9]))) for _ in range(30)]
        want = []
        for piece in pieces:
            parts = [bytes([b]) for b in piece]
            while True:
                found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
                if not found:
                    break
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            want.append([ranks[p] for p in parts])
        size = np.array([len(p) for p in pieces])
        ids, length = own.line(own.single[np.frombuffer(b"".join(pieces), np.uint8)], size)
        assert [x.tolist() for x in np.split(ids, np.cumsum(length)[:-1])] == want
        for piece, ids in zip(pieces, want):
            got, n = own.line(own.single[np.frombuffer(piece, np.uint8)], np.array([len(piece)]))
            assert got.tolist() == ids and n.tolist() == [len(ids)]
            got, n = own.matrix(own.single[np.frombuffer(piece, np.uint8)][None, :])
            assert got[got >= 0].tolist() == ids


def test_query(spark, sf, reference):
    from tidemark.llm import queries

    rows = {r.doc_id: r for r in queries.QUERIES["op6_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = reference.encode_ordinary(d.text)
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 3), (None, "", 4), (1, None, 3), (2, "a'b's", None)], "doc_id long, text string, n_tokens int")
    got = bpe.encode(df, PATH).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 0, 4]
    assert bpe.encode(df.limit(0), PATH).count() == 0
