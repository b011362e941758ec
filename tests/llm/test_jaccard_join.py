import random
import re

import numpy as np
import pytest

from strandmill.llm import jaccard_join as J


def brute(rows):
    """Ids to (set size, least id of the component) by comparing all pairs."""
    sets = []
    for _, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    home = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and 100 * both >= 80 * (len(x) + len(sets[j]) - both) and home[i] != home[j]:
                home = [home[j] if h == home[i] else h for h in home]
    ids = [i for i, _ in rows]
    return sorted((ids[k], len(sets[k]), min(ids[m] for m in range(len(ids)) if home[m] == home[k])) for k in range(len(ids)))


def texts(seed, groups, copies, words, edits):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(r.randint(0, edits)):
                own[r.randrange(words)] = word()
            out.append(" ".join(own))
    r.shuffle(out)
    return list(enumerate(out))


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in J.components(df, ["doc_id"], **options).collect())


@pytest.mark.parametrize("block,rare", [(2048, 16), (8, 16), (8, 1)])
def test_components_equal_brute_force(spark, monkeypatch, block, rare):
    # blocks of 8 classes split the groups; with rare = 1 every shingle is frequent, and partners meet on pairs alone
    monkeypatch.setattr(J, "BLOCK_ROWS", block)
    rows = texts(1, 3, 40, 60, 3)
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One  TWO"), (904, rows[0][1]), (905, " \t\n")]
    assert found(spark, rows, rare=rare) == brute(rows)


def test_groups_that_hubs_leave_open(spark, monkeypatch):
    # many unlinked texts share a passage: neighbours at the threshold, chains, and a large component beside small ones
    monkeypatch.setattr(J, "BLOCK_ROWS", 16)
    rows = texts(2, 4, 30, 40, 6)
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(1000 + i, passage + " " + " ".join(f"w{i}x{r.randrange(9)}" for _ in range(8 + i % 9))) for i in range(60)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [5, 19, 40, 81, 333, 1300])
def test_partners_share_an_entry(n):
    """Any two sets of similarity 0.8 or more meet, whether their shingles are rare, frequent or outside the pool."""
    r = np.random.default_rng(n)
    top = int(J.POOL * 2**64)
    for trial in range(30):
        union = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        apart = len(union) - (4 * len(union) + 4) // 5
        cut = r.permutation(len(union))[:apart]
        k = r.integers(0, apart + 1)
        sets = [np.delete(union, cut[:k]), np.delete(union, cut[k:])]
        # counts of the union's shingles; those of one set alone are held by no other
        count = r.choice([[2, 3], [2, 40], [30, 900]][trial % 3], len(union))
        met = []
        for own, other in (sets, sets[::-1]):
            m, pooled = np.array([len(own)]), int((own < top).sum())
            sent = (own < top) | (np.arange(len(own)) < J._need(m)[0])
            both = sent & np.isin(own, other)
            token = own[both]
            held = count[np.searchsorted(union, token)]
            sig, _ = J.signatures(np.array([1]), m, np.array([pooled]), np.array([0, len(token)]), token, held, J.RARE)
            met.append(set(sig.tolist()))
        assert met[0] & met[1]


def test_keep_one_knows_rows_by_id_and_set(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a, "x"), (7, a + " z", "x"), (7, b, "x"), (None, b + " y", "x"), (None, "c d e f g h", "x"), (None, "C d e  f g h", "x"), (9, None, "x"), (9, "", "x"), (7, b, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    kept = sorted(map(tuple, J.keep_one(df).collect()), key=str)
    assert kept == sorted([(3, a, "x"), (7, b, "x"), (None, "C d e  f g h", "x"), (9, None, "x"), (9, "", "x")], key=str)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.components(df, ["doc_id"]).collect() == []
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x")], "doc_id long, text string, ref string")
    assert [r.doc_id for r in J.keep_one(df).collect()] == [1]
    assert J.keep_one(df).columns == ["doc_id", "text", "ref"]
