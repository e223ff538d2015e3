import random

from tidemark.llm import graph, minhash, queries
from tidemark.llm.common import Scratch


def brute(rows, percent=85):
    """doc_id -> (n_shingles, component_id) by comparing all pairs."""
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    seen = set()
    for own in index.values():
        for a in own:
            for b in own:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    k = len(sets[a] & sets[b])
                    if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def check(got, rows):
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(queries.QUERIES["op3_near_duplicates"](spark, sf).collect(), [tuple(d) for d in docs])


def test_chains_and_short_texts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 9, 12, 40, 90]))]
        for _ in range(rng.choice([1, 3, 8])):
            rows.append((len(rows), " ".join(base)))
            base = list(base)
            if rng.random() < 0.8:
                base[rng.randrange(len(base))] = rng.choice(words)  # a chain: each differs from the one before
    check(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_group_of_unlike_copies(spark):
    """Copies of one text, many of them just too far from each other, so that bounds have to rule out pairs but no link."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(200):
        own = list(base)
        for at in rng.sample(range(70), rng.randrange(7)):
            own[at] = f"x{rng.randrange(40)}"  # some changes are shared
        rows.append((i, " ".join(own[rng.randrange(3) :])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85, 95):
        want = brute(rows, percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, percent).collect()} == want


def test_edge_rows(spark):
    rows = [(5, None), (4, ""), (3, " \n"), (2, "A b"), (9, "a  B"), (1, "a b c d e f"), (7, "a b c d e f")]
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id long, text string, n_shingles int, fp int")
    check(minhash.near_duplicates(df).collect(), rows)
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    twice = minhash.near_duplicates(df.union(df).union(spark.createDataFrame([(None, "a b", 0, 1)], df.schema))).collect()
    assert len(twice) == 15 and {r.component_id for r in twice if r.doc_id in (2, 9, None)} == {2}


def test_empty_texts_at_the_end_of_a_batch(spark):
    """Copies stay linked where texts without words follow them in the same batch."""
    rows = [(1, "a b c d e f g"), (2, None), (3, "A b c d e f g"), (4, ""), (5, "a b c d e f g"), (6, " \n"), (7, "p q r s t u v w x y z"), (8, "a b c d e f g"), (9, None), (10, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1).sortWithinPartitions("doc_id")
    check(minhash.near_duplicates(df).collect(), rows)
    pieces = [spark.createDataFrame(rows[a:b], "doc_id long, text string").coalesce(1) for a, b in ((0, 2), (2, 4), (4, 6), (6, 10))]
    check(minhash.near_duplicates(pieces[0].union(pieces[1]).union(pieces[2]).union(pieces[3])).collect(), rows)


def test_few_tables(spark, monkeypatch):
    """Each table is several jobs of all partitions, so a group of unlike copies mustn't take dozens of rounds and tables."""
    rng = random.Random(11)
    rows = []
    for i in range(300):
        own = [f"w{k}" for k in range(70)]
        for at in rng.sample(range(70), rng.randrange(4)):
            own[at] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(own)))
    made, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df: made.append(1) or table(self, df))
    check(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    assert len(made) <= 40


def test_rounds_by_centres_find_the_same(spark, monkeypatch):
    """Where the closing round comes late, and components go by stars, the links are the same."""
    rng = random.Random(12)
    rows = []
    for i in range(120):
        own = [f"w{k}" for k in range(60)]
        for at in rng.sample(range(60), rng.randrange(6)):
            own[at] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(minhash, "WHOLE", -1)
    monkeypatch.setattr(minhash, "GROWTH", 2)
    monkeypatch.setattr(minhash, "components", lambda links, scratch: graph.components(links, scratch, few=-1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, percent).collect()} == brute(rows, percent)


def test_components_on_the_driver_and_by_stars(spark):
    rng = random.Random(13)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(-(2**63), 7), (2**63 - 1, 7), (5, 5), (None, 3), (9, None), (0, 1), (1, 0)]
    scratch = Scratch(spark)
    df = scratch.table(spark.createDataFrame(edges, "u long, v long"))
    few, stars = ({tuple(r) for r in graph.components(df, scratch, n).collect()} for n in (len(edges), len(edges) - 1))
    assert few == stars and len(few) == len({node for node, _ in few})
    label = dict(few)
    real = [(u, v) for u, v in edges if None not in (u, v) and u != v]
    assert set(label) == {x for e in real for x in e} and all(label[u] == label[v] <= min(u, v) for u, v in real)
