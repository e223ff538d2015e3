import re

import numpy as np
import pyarrow as pa

from tidemark.llm import common, minhash


def batch():
    rng = np.random.default_rng(1)
    words = ["Ab", "c", "é", "Ünder", "x\x1cy", "longer-word"]
    gaps = [" ", "  ", "\n", "\t ", "\r\n", "\x0b"]
    text = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.integers(0, 60))) for _ in range(400)]
    text[7] = text[200] = None
    return pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(text, pa.string())], ["doc_id", "text"])


def test_tokens_are_the_same_in_every_block():
    rows, seen = 0, []
    for block in common.blocks([batch()], limit=1500):
        flat, counts = common.tokens(common.texts(block))
        want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) for t in block.column(1).to_pylist()]
        assert counts.tolist() == list(map(len, want)) and flat.to_pylist() == [w for own in want for w in own]
        rows += block.num_rows
        seen.append(block.num_rows)
    assert rows == 400 and len(seen) > 10


def test_sets_do_not_depend_on_blocks():
    def sets(limit):
        parts = [minhash.shingle_sets(common.texts(b)) for b in common.blocks([batch()], limit=limit)]
        return np.concatenate([s for s, _ in parts]).tolist(), np.concatenate([n for _, n in parts]).tolist()

    assert sets(1 << 20) == sets(700) == sets(1)
