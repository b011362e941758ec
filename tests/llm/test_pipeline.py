import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_jaccard_join import brute

SECRET = "Zx81kQpL09vT77"


def fixture(spark, folder):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(40):
        body = [word() for _ in range(r.randint(25, 80))]
        if i == 3:
            body += ["token", "=", f"'{SECRET}'"]
        rows.append([i, " ".join(body), "en", f"s{i % 4}", 1])
    rows += [[100 + i, rows[i][1] + " end", "en", "s1", 1] for i in range(5)]
    rows += [[200, "too short", "en", "s0", 1], [201, "same line again and over\n" * 30, "en", "s0", 1], [202, None, None, None, None]]
    spark.createDataFrame([tuple(x) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rows = fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.durable(stage(spark, docs, str(tmp_path)))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    good = [x for x in rows if x[0] < 200]
    assert {r.doc_id for r in kept["quality"].collect()} == {x[0] for x in good}
    alone = {i for i, _, least in brute([(x[0], x[1]) for x in good]) if i == least}
    assert Counter(r.doc_id for r in kept["near_duplicates"].collect()) == Counter(alone)
    texts = {r.doc_id: r.text for r in kept["secrets"].collect()}
    assert set(texts) == alone and SECRET not in texts[3] and all(texts[x[0]] == x[1] for x in good if x[0] in alone and x[0] != 3)
    words = lambda r: len((r.text or "").split())
    before, after = kept["secrets"].collect(), kept["mixing"].collect()
    assert max(Counter(r.doc_id for r in after).values()) <= 2
    # what is left of a source is less than a document
    assert abs(sum(map(words, after)) - 1.5 * sum(map(words, before))) <= 4 * max(map(words, before))
    pieces = Counter(r.doc_id for r in kept["packing"].collect() if r.piece == 0)
    assert pieces == Counter(r.doc_id for r in after)


def test_stages_take_odd_tables(spark, tmp_path):
    """Empty documents, repeated and null ids, nulls everywhere, columns whose names the operators use."""
    pytest.importorskip("public_tokenizers")
    schema = "doc_id long, text string, lang string, source string, n_chars long, ref string, size string, spans string, fill string"
    r = random.Random(2)
    body = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(40))
    same = body()
    rows = [(1, same), (1, same), (2, same + " end"), (None, body()), (None, None), (3, ""), (4, body()), (4, body())]
    for number, data in enumerate([[], [(i, t, "en", None if i == 4 else "s", 1, "a", "b", "c", "d") for i, t in rows]]):
        folder = f"{tmp_path}/{number}"
        docs = spark.createDataFrame(data, schema)
        docs.write.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.durable(stage(spark, docs, folder))
            assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
            if name == "near_duplicates" and data:
                # one of the three copies; both texts of id 4 and that of a null id
                assert sorted((x.doc_id or 0, len(x.text)) for x in docs.collect()) == sorted([(1, len(same)), (4, 239), (4, 239), (0, 239)])
        assert corpus_pipeline.run(spark, folder).count() == corpus_pipeline.STAGES[-1][1](spark, docs, folder).count()
