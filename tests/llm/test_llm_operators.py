import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import chat_format, mixing, packing, pii, quality_classifier, quality_rules, secret_scan, sharding, vector_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word " * 30_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rows = [
        (1, None, None, None, None), (None, "some text here", "en", "a", 3), (2, "", "en", "b", 0), (3, LONG, "en", "a", 1),
        (4, "tie one", "en", "a", 1), (4, "tie one", "en", "a", 1), (5, "é ñ token = 'abcdef123456' a@b.co", "fr", "b", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_rules_by_hand(odd, none):
    assert quality_rules.score_quality(none.select("doc_id", "text")).count() == 0
    rows = {(r.doc_id, r.n_words): r for r in quality_rules.score_quality(odd, keep=["doc_id"]).collect()}
    assert rows[3, 30_000].n_repeat_words == 30_000 and rows[3, 30_000].base_failed and not rows[3, 30_000].kept
    assert rows[1, 0].word_chars == 0 and rows[5, 6].word_chars == 30 - 5 + 4 - 2 or rows[5, 6].n_words == 6


def test_quality_measures_against_brute_force():
    import pyarrow as pa

    texts = ["a b c d e f g h i\na b c d e f g h i\nx # é", "one\n\none\n two", "", "é é é"]
    from strandmill.llm.arrays import utf8

    found = quality_rules.measure(*utf8(pa.array(texts)), quality_rules.Rules())
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        wins = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        inside = {k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        assert tuple(int(found[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_sharding_laws(odd, none):
    assert sharding.shard_records(none, 4).count() == 0
    rows = sharding.shard_records(odd, 3).collect()
    assert len(rows) == 7 and sum(r["size"] for r in rows) == sum(len((r.text or "").encode()) + 16 for r in odd.collect())
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_sharding_is_even_with_one_hot_text(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    sizes = sharding.shard_records(df, 8).groupBy("shard").agg(F.sum("size").alias("n")).toPandas()["n"]
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 50


def test_shards_are_runs_of_keys(spark):
    """Against a sort on one machine: shards follow each other in key order, slots too, and cuts lie where even ones would."""
    rng = np.random.default_rng(3)
    rows = [(int(i) if i % 50 else None, "same" if i % 3 == 0 else "x" * int(rng.integers(0, 400)), "clash") for i in range(5000)]
    rows += [(7, "twin", "clash")] * 900 + [(8, "y" * 60_000, "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    found = sharding.shard_records(df, 10).toPandas()
    by_crc = {zlib.crc32(t.encode()): h for t, h in hashes.items()}
    found["h"] = found["text_crc32"].map(by_crc)
    placed = found.sort_values(["shard", "slot"])
    keys = list(zip(placed["h"], placed["doc_id"].fillna(-(2.0**63)), strict=True))
    assert keys == sorted(keys) and len(keys) == len(rows)
    ends = placed.groupby("shard")["size"].sum().cumsum().to_numpy()
    even = found["size"].sum() / 10
    assert all((placed.groupby("shard").cumcount() == placed["slot"]).tolist())
    sizes = found["size"].to_numpy()
    # a cut may miss its place by half a range: a record, or a thousandth of a shard
    large = np.array([60_016 if abs(end - (i + 1) * even) > 0.001 * even + sizes[sizes < 1000].max() else 0 for i, end in enumerate(ends)])
    assert (large > 0).sum() <= 1 and (abs(ends - even * np.arange(1, 11)) <= 30_008 + 0.001 * even).all()


def test_written_shards_hold_their_records_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 9} " * (i % 50)) for i in range(400)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "shards"), 5)
    plan = {r.doc_id: (r["shard"], r.slot) for r in sharding.shard_records(df, 5).collect()}
    back = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert {r.doc_id: (r["shard"], r.slot) for r in back} == plan and len(back) == 400
    assert {r.doc_id: r.text for r in back} == {r.doc_id: r.text for r in df.collect()}


def test_packing_round_trip(odd, none):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    assert packing.pack_documents(none, path).count() == 0
    rows = packing.pack_documents(odd, path).collect()
    want = sorted(zlib.crc32(np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for r in odd.collect() if r.text != LONG)
    assert sorted(r.ids_crc32 for r in rows if r.doc_id != 3) == want
    long_ = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 3)
    assert all(n == 2048 for k, _, n in long_ if k) and [s for _, s, _ in long_] == [0, *np.cumsum([n for *_, n in long_])[:-1].tolist()]
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) <= 2048


def test_best_fit_is_near_the_bound():
    sizes = np.random.default_rng(1).integers(1, 1200, 4000)
    bins, offsets, fills = packing.best_fit(sizes, 2048)
    assert fills.max() <= 2048 and len(fills) <= 1.01 * -(-sizes.sum() // 2048) + 1


def test_packing_against_a_naive_packer(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{rng.integers(0, 900)}" for _ in range(int(rng.integers(0, 1500)))) for _ in range(240)] + ["Zürich's «ß» 漢字 <|endoftext|>\n\n  x", None]
    df = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, fill string, piece int").repartition(6)
    rows = packing.pack_documents(df, path).collect()
    want = []
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        head = len(ids) % 2048 or 2048
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins: list[int] = []
    for size in sorted((x[3] for x in want), reverse=True):
        fits = [(2048 - b, k) for k, b in enumerate(bins) if b + size <= 2048]
        if fits:
            bins[min(fits)[1]] += size
        else:
            bins.append(size)
    assert len({r.sequence_id for r in rows}) <= 1.02 * len(bins) + 1


def test_mixing_against_a_naive_solution(spark):
    """Targets by raising a water level, rates by bisection on one machine."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join("w" * int(rng.integers(1, 4)) for _ in range(int(rng.integers(0, 60)))), [None, "a", "b", "c", "d"][int(rng.integers(0, 5)) if i % 3 else 1], "clash") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    found = mixing.mix(df, [5, 2, 1]).toPandas()
    size = {s: 0 for s in ("a", "b", "c", "d", None)}
    for _, t, s, _ in rows:
        size[s] += len(WORD.findall(t))
    weight = dict(zip(size, [5, 2, 1, 5, 2], strict=True))
    total, fixed = 1.5 * sum(size.values()), {}
    while True:
        free = [s for s in size if s not in fixed]
        share = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > 2 * size[s]]
        if not over:
            break
        fixed |= {s: 2 * size[s] for s in over}
    goal = {s: fixed.get(s, weight[s] * share) for s in size}
    for s in size:
        own = found[found["source"].isna() if s is None else found["source"] == s]
        assert abs(own["target"].iloc[0] - goal[s]) < 1e-6 * goal[s]
        n = own["size"].to_numpy(float)
        low, high = -200.0, 200.0
        for _ in range(200):
            tilt = (low + high) / 2
            low, high = (tilt, high) if (np.minimum(2, np.exp(np.minimum(tilt * n / n.max(), 1))) * n).sum() < goal[s] else (low, tilt)
        rate = np.minimum(2, np.exp(np.minimum(tilt * n / n.max(), 1))) if goal[s] < 2 * size[s] else np.full(len(n), 2.0)
        words = n > 0
        assert np.abs(own["rate"].to_numpy()[words] - rate[words]).max() < 2e-3
        copies = own["copies"].to_numpy()
        assert (copies <= 2).all() and (np.abs(copies - rate)[words] < 1 + 1e-2).mean() > 0.99 and abs((copies * n).sum() - goal[s]) <= n.max()


def test_classifier_gradient_and_odd_ratings(spark, none):
    """The fitted model is where a naive likelihood, penalised alike, has no slope; odd ratings are ignored."""
    rng = np.random.default_rng(3)
    n, d = 300, 6
    x = rng.integers(0, 2, (n, d)) * 1.0
    grade = np.clip((x @ np.array([2, -2, 1, 0, 0, 0.5]) + rng.normal(size=n)).round(), 0, 2).astype(int)
    doc, slot = np.nonzero(x)
    model = quality_classifier.OrdinalModel.fit(doc, slot, x[doc, slot], grade, 3, rounds=4000, rate=0.01)

    def loss(w, cut):
        p = 1 / (1 + np.exp(-((x @ w)[:, None] - cut)))
        p = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
        return -np.log(p[np.arange(n), grade] - p[np.arange(n), grade + 1]).mean() + 0.5 * 1e-3 * (w**2).sum()

    w, cut = model.weights[:d].copy(), model.thresholds
    assert (np.diff(cut) > 0).all()
    for i in range(d):
        step = np.zeros(d)
        step[i] = 1e-4
        assert abs(loss(w + step, cut) - loss(w - step, cut)) / 2e-4 < 2e-3
    for j in range(2):
        step = np.zeros(2)
        step[j] = 1e-4
        assert abs(loss(w, cut + step) - loss(w, cut - step)) / 2e-4 < 2e-3
    docs = [(i, None if i == 5 else f"good word{i % 7}" if i % 2 else f"bad word{i % 5}") for i in range(60)] + [(7, "good again"), (None, "lost")]
    rated = [(i, i % 2) for i in range(40)] + [(3, 0), (3, 0), (None, 1), (50, None), (999, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ratings = spark.createDataFrame(rated, "doc_id long, grade int")
    first, again = (quality_classifier.fit(df.repartition(k), ratings.repartition(k), 2) for k in (1, 5))
    assert np.array_equal(first.weights, again.weights) and np.array_equal(first.thresholds, again.thresholds)
    scored = quality_classifier.score(df, first, 2)
    assert scored.count() == len(docs) and scored.where("expected_grade IS NULL").count() == 0


def test_mixing_targets_and_ceiling(spark, odd, none):
    assert mixing.mix(none, [5, 2, 1]).count() == 0
    assert {r.doc_id for r in mixing.mix(odd, [5, 2, 1]).collect()} == {1, 2, 3, 4, 5, None}
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (1 + F.col("id") % 37).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 6).alias("source"))
    first, again = (mixing.mix(df, [5, 2, 1]).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert first.equals(again) and first["copies"].between(0, 2).all()
    by = (first["size"] * first["copies"]).groupby(first["source"]).sum()
    goal = first.groupby("source")["target"].first()
    assert (abs(by - goal) <= 2).all() and abs(goal.sum() - 1.5 * first["size"].sum()) < 1e-6


def test_secret_spans_and_ownership(spark):
    live, copied = "q7Wm2Zx9Lp0aRt", "sample9999key"
    rows = [(i, f"é token = '{copied}' end", "en", f"s{i}", 1) for i in range(4)] + [(9, f"password: {live}! token=abc AKIA{'B' * 16}", "en", "s1", 1), (10, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in secret_scan.scan(df, ["doc_id", "text"]).collect()}
    for r in got.values():
        for s, v in zip(r.spans, r.verdicts, strict=True):
            assert s.value in r.text[s.start : s.end]
            assert v == ("example" if s.value == copied else "live" if s.value == live else "shared")
    assert [s.kind for s in got[9].spans] == ["assign", "access"] and got[10].spans == []
    texts = {r.doc_id: r.text for r in secret_scan.redact_secrets(df).collect()}
    assert live not in texts[9] and copied in texts[0] and texts[10] is None
    assert secret_scan.redact_secrets(df).columns == df.columns


def test_pii_checksums(spark):
    body = "mail a.b@c.org, card 4111 1111 1111 1111, bad 4111 1111 1111 1112, ip 10.0.0.1 and 10.0.0.999, tel +1 (212) 555-0100, IBAN GB82WEST12345698765432, ssn 078-05-1120"
    df = spark.createDataFrame([(1, body), (2, None), (3, "9" * 50_000), (4, "a" * 50_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.detect(df).collect()}
    assert [(s.kind, s.value) for s in rows[1].spans] == [
        ("email", "a.b@c.org"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.1"), ("phone", "+1 (212) 555-0100"), ("iban", "GB82WEST12345698765432"), ("ssn", "078-05-1120"),
    ]
    assert all(body[s.start : s.end] == s.value for s in rows[1].spans) and not rows[2].spans and not rows[3].spans and not rows[4].spans


def test_chat_round_trip_and_rewriting_templates(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\", "<|end|>\n<|turn|>x", "a\\<|text|>", "", "é "]
    assert all(chat_format.unescape(chat_format.escape(t)) == t for t in tricky)
    turns = [("user", t) for t in tricky] + [("assistant", t) for t in tricky]
    done = chat_format.render(turns, chat_format.marked)
    assert chat_format.read_back(done.output) == turns and not done.rewrites
    assert [chat_format.unescape(done.output[a:b]) for a, b in done.texts] == [t for _, t in turns]
    last_only = lambda ts: "".join(f"[{r}:{t}]" for r, t in ts[-1:])
    assert chat_format.render(turns[:3], last_only).rewrites
    df = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, None, None), (None, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r for r in chat_format.digest(chat_format.format_chats(df)).collect()}
    assert rows[1].n_turns == 2 and rows[1].turns_sha256 == hashlib.sha256(b"\n\nassistant\nb\n").hexdigest() and rows[None].loss_chars == 0


def test_vector_search_recall_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 16) for i in range(30)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] * 8), (2004, [1.0]), (None, [0.5] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = vector_search.search(df, df.where("vec_id % 50 = 0"), "vec_id", "embedding", rerank=64, block_rows=128).toPandas()
    good = {i: np.array(np.float32(v), float) for i, v in rows[:430]}
    hits = 0
    asked = [i for i in good if i % 50 == 0]
    for q in asked:
        best = sorted((-round(float(good[q] @ v / np.linalg.norm(good[q]) / np.linalg.norm(v)), 12), i) for i, v in good.items() if i != q)[:5]
        own = found[found["query_id"] == q].sort_values("rank")
        hits += len({i for _, i in best} & set(own["vec_id"]))
    assert hits >= 0.9 * 5 * len(asked)
    tied = found[found["query_id"] == 1000].sort_values("rank")["vec_id"].tolist()
    assert tied == [1001, 1002, 1003, 1004, 1005]
    assert vector_search.search(df.limit(0), df.limit(0), "vec_id", "embedding").count() == 0


def test_vector_recall_at_default_settings(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 64))
    x = np.concatenate([rng.normal(size=(4000, 64)), centres[rng.integers(0, 40, 4000)] + 0.5 * rng.normal(size=(4000, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(x)], "vec_id long, embedding array<float>, score string")
    found = vector_search.search(df, df.where("vec_id % 100 = 0"), "vec_id", "embedding").toPandas()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 8000, 100):
        score = unit @ unit[q]
        score[q] = -2
        own = found[found["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(own["score"], score[own["vec_id"]], atol=1e-12)
        hits += len(set(np.argsort(-score)[:5]) & set(own["vec_id"]))
    assert hits >= 0.95 * 5 * 80


def test_vectors_that_codes_cannot_tell_apart(spark):
    rng = np.random.default_rng(13)
    middles = rng.normal(size=(10, 16))
    # one cone, tight clusters, planes, and copies with ids of which some repeat
    cone, tight = 1 + 0.01 * rng.normal(size=(2000, 16)), middles[rng.integers(0, 10, 2000)] + 1e-3 * rng.normal(size=(2000, 16))
    plane, copies = rng.normal(size=(2000, 2)), middles[rng.integers(0, 4, 2000), :3]
    for kind, x in {"cone": cone, "tight": tight, "plane": plane, "copies": copies}.items():
        x = x.astype(np.float32).astype(float)
        ids = np.arange(len(x)) // (1 if kind != "copies" else 3)
        df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").repartition(3)
        queries = df.where("vec_id % 100 = 0").selectExpr("int(vec_id) vec_id", "embedding")  # ids of another type are the same ids
        found = vector_search.search(df, queries, "vec_id", "embedding", rerank=16, block_rows=700).toPandas()
        want = []
        for q in np.flatnonzero(ids % 100 == 0):
            near = sorted((-s, i) for s, i in zip(vector_search.cosines(np.repeat(x[q : q + 1], len(x), 0), x), ids, strict=True) if i != ids[q])[:5]
            want += [(ids[q], rank, i, -s) for rank, (s, i) in enumerate(near, 1)]
        assert sorted(found.itertuples(index=False, name=None)) == sorted(want), kind


def test_vectors_of_two_lengths_are_searched_apart(spark):
    rows = [(i, [1.0, float(i)]) for i in range(6)] + [(10 + i, [1.0, float(i), 2.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vector_search.search(df, df, "vec_id", "embedding", k=2).collect()
    assert len(found) == 24 and all((r.query_id < 10) == (r.vec_id < 10) for r in found)


def test_classifier_on_held_out_ratings(spark, none):
    bad, junk = ["vile", "awful", "nasty"], ["$$$", "###"]
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(200)]
    rows, grades = [], []
    for i in range(600):
        grade = int(rng.integers(0, 3))
        t = list(rng.choice(words, 40)) + (list(rng.choice(bad, 4)) if grade == 0 else list(rng.choice(junk, 6)) if grade == 1 else [])
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
        grades.append((i, grade))
    docs, ratings = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(grades, "doc_id long, grade int")
    model = quality_classifier.fit(docs, ratings.where("doc_id < 450"), 3)
    scored = quality_classifier.score(docs, model, 3).join(ratings, "doc_id").where("doc_id >= 450").toPandas()
    assert (scored["kept"] == (scored["grade"] == 2)).mean() > 0.9 and (scored["p_ge_1"] >= scored["p_ge_2"]).all()
    assert quality_classifier.fit(docs, ratings.limit(0), 3) is None and quality_classifier.score(none, None, 3).count() == 0


def test_an_owners_own_boilerplate_is_not_live(spark):
    lone, spread = "q7Wm2Zx9Lp0aRt", "w8Vn3Yc6Kq1bSu"
    rows = [(i, f"token = '{spread}'", "en", "s", 1) for i in range(secret_scan.COPIED_REPOS)] + [(100, f"token = '{lone}'", "en", "s", 1), (100, f"token = '{lone}'", "en", "s", 1)]
    found = secret_scan.scan(spark.createDataFrame(rows, DOCS), ["doc_id"]).collect()
    assert {(r.doc_id == 100, r.verdicts[0], r.owners[0], r.repos[0]) for r in found} == {(False, "shared", 1, 8), (True, "live", 1, 1)} and len(found) == 10


def test_pii_context_on_both_sides_and_whole_words(spark):
    cases = ["111-22-3333 (SSN)", "the password 111-22-3333", "essn 111-22-3333", "x" * 50 + " 111-22-3333 " + "y" * 40 + " ssn", "social security: 111-22-3333"]
    cases += ["ship 10.0.0.1 slip", "10.0.0.1 is the server's"]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    rows = {r.doc_id: [(s.kind, s.score) for s in r.spans] for r in pii.detect(df).collect()}
    assert rows == {0: [("ssn", 70)], 1: [], 2: [], 3: [], 4: [("ssn", 70)], 5: [("ip", 60)], 6: [("ip", 90)]}


def test_redaction_leaves_only_examples(spark):
    two, short, flat, copied = "q7Wm2Zx9Lp0aRt", "hunter2", "AKIA" + "B" * 16, "sample9999key"
    bodies = [("a", f"token = '{two}' {flat}"), ("b", f"token = '{two}' and token = '{two}'"), ("a", f"password: {short} then")] + [(s, f"secret={copied}") for s in "abc"]
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, (s, t) in enumerate(bodies)], DOCS)
    texts = {r.doc_id: r.text for r in secret_scan.redact_secrets(df).collect()}
    m = secret_scan.MARK
    assert texts == {0: f"token = '{m}' {m}", 1: f"token = '{m}' and token = '{m}'", 2: f"password: {m} then"} | {i: f"secret={copied}" for i in (3, 4, 5)}


def test_private_keys_are_told_apart_by_their_bodies(spark):
    head, foot = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = lambda c: "\n".join([c * 64] * 3 + [c * 9 + "=="])
    cases = [f"{head}\n{body(c)}\n{foot}" for c in "QRS"]
    cases += [f"{head}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,AB12\n\n{body('T')}\n{foot}", f"{head}\n{body('U')}", f"{head}\\n{'V' * 64}\\n{foot}"]
    rows = [(i, f"é {key}\nend", "en", f"s{i}", 1) for i, key in enumerate(cases)]
    rows += [(20, f"the line {head} opens a key", "en", "s0", 1), (21, head + "\n" + "W" * 200_000, "en", "s0", 1), (22, head * 3_000, "en", "s0", 1), (23, head + "\n" + ("X" * 64 + "\n") * 3_000 + foot, "en", "s0", 1)]
    df = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: r for r in secret_scan.scan(df, ["doc_id"]).collect()}
    for i, key in enumerate(cases):
        keys = [(s.value, v) for s, v in zip(found[i].spans, found[i].verdicts, strict=True) if s.kind == "pem"]
        assert [k for k, _ in keys] == [key] and keys[0][1] != "example"
    assert not found[20].spans and not found[22].spans
    texts = {r.doc_id: r.text for r in secret_scan.redact_secrets(df).collect()}
    m = secret_scan.MARK
    assert all(texts[i] == f"é {m}\nend" for i in range(len(cases))) and texts[21] == texts[23] == m and texts[20] == rows[len(cases)][1]


def test_pii_context_reaches_over_other_numbers(spark):
    body = "SSN 111-22-3333, 222-33-4444, 333-44-5555, 444-55-6666"
    df = spark.createDataFrame([(1, body), (2, "é" * 37 + " ssn 111-22-3333")], "doc_id long, text string")
    rows = {r.doc_id: [s.value for s in r.spans if s.kind == "ssn"] for r in pii.detect(df).collect()}
    # as op8_sql: the word must stand whole in the 40 code points before the number or behind it
    want = [body[i : i + 11] for i in (4, 17, 30, 43) if "ssn" in body[max(i - 40, 0) : i].lower()]
    assert rows == {1: want, 2: ["111-22-3333"]} and len(want) == 3
