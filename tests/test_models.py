"""The trained embedding, outliers in segments, suggestions by bounds, and the index of near words, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textsieve.operators import corrupt, embed, lm, skipgram, suggest
from textsieve.operators.sentences import text_to_sentences
from textsieve.sources.scratch import Scratch

S = "doc_id long, sent_pos int, tokens array<string>"


def inflected(seed, n=300):
    """Sentences over some topics; each topic has its own stems, which take endings."""
    rng = random.Random(seed)
    endings = ["a", "am", "ami", "ov", "om", "e"]
    stems = [["".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(6)] for _ in range(5)]
    out = []
    for i in range(n):
        topic = rng.choice(stems)
        out.append((i, 0, [rng.choice(topic) + rng.choice(endings) for _ in range(rng.randint(6, 12))]))
    return stems, endings, out


@pytest.fixture(scope="module")
def trained(spark):
    stems, endings, rows = inflected(3)
    p = skipgram.SkipGramParams(dim=16, epochs=6, bucket=500, least_blocks=3)
    s = spark.createDataFrame(rows, S)
    return stems, endings, s, p, skipgram.train_skipgram(s, p)


def test_training_lowers_the_loss_and_brings_stems_together(trained):
    stems, endings, _, _, found = trained
    assert all(b < a for a, b in zip(found.losses, found.losses[1:], strict=False)) and found.losses[-1] < 0.9 * found.losses[0]
    v = {r["w"]: np.array(r["vec"]) for r in found.vectors.collect()}
    cos = lambda a, b: float(v[a] @ v[b] / np.sqrt((v[a] @ v[a]) * (v[b] @ v[b])))
    rng = random.Random(1)
    same = [cos(a, b) for topic in stems for stem in topic for a in [stem + endings[0]] for b in [stem + endings[1]] if a in v and b in v]
    other = [cos(a, b) for a, b in (rng.sample(sorted(v), 2) for _ in range(300))]
    topic = [cos(x, y) for t in stems for a, b in [rng.sample(t, 2)] for x in [a + endings[0]] for y in [b + endings[2]] if x in v and y in v]
    assert np.mean(same) > np.mean(topic) > np.mean(other) + 0.2


def test_vectors_do_not_depend_on_partitions(spark, trained):
    _, _, s, p, found = trained
    want = {r["w"]: r["vec"] for r in found.vectors.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = skipgram.train_skipgram(s.repartition(5).orderBy(F.rand(3)), p)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r["w"]: r["vec"] for r in again.vectors.collect()} == want and again.losses == found.losses


def test_words_with_many_contexts_lie_in_several_blocks(spark, trained):
    _, _, s, p, found = trained
    split = skipgram.train_skipgram(s, skipgram.SkipGramParams(**{**p.__dict__, "pairs_per_block": 50}))
    assert split.losses[-1] < split.losses[0] and split.vectors.count() == found.vectors.count()
    empty = skipgram.train_skipgram(s.limit(0), p)
    assert empty.vectors.count() == 0


def test_alias_table_draws_by_weight():
    rng = np.random.default_rng(0)
    weights = rng.random(40) ** 3
    share, other = skipgram.alias_table(weights)
    drawn = rng.integers(0, 40, 400_000)
    drawn = np.where(rng.random(len(drawn)) < share[drawn], drawn, other[drawn])
    assert np.abs(np.bincount(drawn, minlength=40) / len(drawn) - weights / weights.sum()).max() < 3e-3
    assert ((share >= 0) & (share <= 1)).all()


def test_character_grams(spark):
    got = spark.createDataFrame([("ab",), ("слово",)], "w string").select(skipgram.character_grams(F.col("w"))).collect()
    marked = "<слово>"
    assert got[0][0] == ["<ab", "ab>", "<ab>"] and got[1][0] == [marked[i : i + n] for n in range(3, 7) for i in range(len(marked) - n + 1)]


@pytest.mark.parametrize("segment", [3, 7, 4096])
def test_outliers_in_segments(spark, segment):
    rng = random.Random(segment)
    rows = [(g, i, None if rng.random() < 0.1 else [rng.uniform(-1, 1) for _ in range(3)] if rng.random() < 0.9 else [0.0, 0.0, 0.0]) for g in range(4) for i in range(-3, 60) if rng.random() < 0.8]
    got = {(r["g"], r["i"]): r["outlier"] for r in embed.neighbour_outliers(spark.createDataFrame(rows, "g int, i int, v array<double>"), "g", "i", "v", 5, segment).collect()}
    assert len(got) == len(rows)
    for g, i, v in rows:
        near = [y for h, j, y in rows if h == g and j != i and abs(i - j) <= 5 and y is not None]
        m = np.mean(near, axis=0) if near else None
        norm = 0 if v is None or m is None else np.linalg.norm(v) * np.linalg.norm(m)
        want = 1.0 if v is None else 0.0 if m is None else 1 - (np.dot(v, m) / norm if norm > 0 else 0)
        assert got[g, i] == pytest.approx(want, abs=1e-9)


def plain_suggestions(model, candidates, place, current, k):
    uni, bi, tri, st = model
    a, av, n = 0.1, 0.1 * st["v_size"], st["n_total"]
    p = lambda t, b2, b1, u1, u: 0.6 * (t + a) / (b2 + av) + 0.3 * (b1 + a) / (u1 + av) + 0.1 * (u + a) / (n + av)
    l2, l1, r1 = place
    g = lambda d, *x: d.get(x if len(x) > 1 else x[0], 0)
    found = []
    for c in candidates:
        s = np.log(p(g(tri, l2, l1, c), g(bi, l2, l1), g(bi, l1, c), g(uni, l1), g(uni, c))) + np.log(p(g(tri, l1, c, r1), g(bi, l1, c), g(bi, c, r1), g(uni, c), g(uni, r1)))
        found.append((round(float(s), 6), c))
    found.sort(reverse=True)
    return [x for x in found if x[1] != current][:k]


def test_suggestions_equal_a_full_scan(spark, small):
    s = Scratch(spark, "t").write(text_to_sentences(spark.read.parquet(f"{small}/documents.parquet")), "s")
    model = lm.fit(s, keep=Scratch(spark, "t"))
    words = Scratch(spark, "t").write(lm.top_frequent_vocab(model, 3000), "words")
    targets = suggest.replacement_targets(s.withColumn("idx", (F.abs(F.xxhash64("doc_id", "sent_pos")) % F.size("tokens")).cast("int")).where("doc_id % 5 = 0")).select("doc_id", "sent_pos", "idx", "l2", "l1", "r1", "current")
    targets = Scratch(spark, "t").write(targets, "targets")
    got = {}
    for r in suggest.suggest(targets, ["doc_id", "sent_pos"], model, words).collect():
        got.setdefault((r["doc_id"], r["sent_pos"]), []).append((r["rank"], r["score"], r["candidate"]))
    tables = ({r["w"]: r["c"] for r in model.uni.collect()}, {(r["w1"], r["w"]): r["c"] for r in model.bi.collect()}, {(r["w2"], r["w1"], r["w"]): r["c"] for r in model.tri.collect()}, model.stats.first())
    candidates = [r["w"] for r in words.collect()]
    rows = targets.collect()
    assert len(rows) > 100
    for r in rows[::7]:
        want = plain_suggestions(tables, candidates, (r["l2"], r["l1"], r["r1"]), r["current"], 5)
        mine = sorted(got[r["doc_id"], r["sent_pos"]])
        assert [(c, pytest.approx(x, abs=2e-6)) for x, c in want] == [(c, x) for _, x, c in mine] or [round(x, 5) for x, _ in want] == [round(x, 5) for _, x, _ in mine]
    # far fewer rows than places x candidates are scored, and no plan pairs rows without a key
    places = targets.select(*suggest.PLACE).distinct()
    numbered = words.select(F.col("w").alias("candidate"), F.row_number().over(suggest.Window.orderBy("w")).alias("hi"))
    seen = suggest.seen_candidates(places, numbered, model)
    assert seen.count() < 0.2 * 3000 * places.count()
    for plan in (seen, suggest.suggest(targets, ["doc_id", "sent_pos"], model, words)):
        shown = plan._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in shown and "Cartesian" not in shown


def test_places_whose_best_meet_the_bound_are_scored_again(spark):
    """All candidates but one have equal counts, so that the bound can't tell them apart; words decide."""
    rows = [(i, 0, [f"w{i:03}", "x", f"v{i:03}"]) for i in range(200)]
    model = lm.fit(spark.createDataFrame(rows, S))
    words = model.uni.where("w like 'w%'").select("w")
    targets = spark.createDataFrame([(1, "q", "q", "q", None), (2, "q", "q", "q", "w199"), (3, "<s>", "<s>", "x", "w005")], "k int, l2 string, l1 string, r1 string, current string")
    got = suggest.suggest(targets, ["k"], model, words, 3).orderBy("k", "rank").collect()
    assert [r["candidate"] for r in got] == ["w199", "w198", "w197", "w198", "w197", "w196", "w199", "w198", "w197"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [2, 6, 24])
def test_near_words(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choice("abя") for _ in range(rng.randint(1, 7))) for _ in range(150)}
    for _ in range(40):
        w = list("".join(rng.choice("abcd") for _ in range(rng.randint(8, 70))))
        words.add("".join(w))
        for _ in range(3):
            x = list(w)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(x))
                rng.choice((lambda: x.insert(at, "e"), lambda: x.pop(at), lambda: x.__setitem__(at, "f")))()
            words.add("".join(x))
    words.discard("")
    table = spark.createDataFrame([(w,) for w in sorted(words)], "w string")
    targets = table.where("length(w) % 2 = 0").withColumnRenamed("w", "target")
    got = {tuple(r) for r in corrupt.near_pairs(targets, table, 2, most).collect()}
    assert got == {(t, w) for t in words if len(t) % 2 == 0 for w in words if t != w and t[0] == w[0] and edits(t, w) <= 2}
    with pytest.raises(ValueError):
        corrupt.near_pairs(targets, table, 3)


@pytest.mark.parametrize("most", [1, 5, 2000])
def test_only_the_first_candidates_count(spark, most):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(200)})
    vocab = spark.createDataFrame([(w,) for w in words], "w string")
    targets = [*words[::3], "aabz", "zz"]
    got = {r["target"]: r["choice"] for r in corrupt.confusable(spark.createDataFrame([(t,) for t in targets], "target string"), vocab, 4, 2, most).collect()}
    assert set(got) == set(targets)
    for t in targets:
        first = [w for w in words if w != t and w[0] == t[0] and abs(len(w) - len(t)) <= 2][:most]
        near = [w for w in first if edits(t, w) <= 2]
        assert got[t] in near if near else got[t] is None


def test_models_load_as_they_were_saved(spark, tmp_path, trained):
    from textsieve.operators import ml
    from textsieve.plans import experiment
    from textsieve.sources.store import ModelStore

    _, _, s, _, found = trained
    model = lm.fit(s, lm.LmParams(0.2, (0.5, 0.3, 0.2)))
    fixed = ml.TokenClassifier(("ngram_surp", "ft_outlier", "log_freq", "char_len"), (5.0, 0.5, 3.0, 6.0), (2.0, 0.2, 2.0, 2.5), (0.7, 1.1, -0.8, 0.3), -1.5)
    docs = s.limit(20).select("doc_id", F.array_join("tokens", " ").alias("text"))
    first = experiment.save_models(spark, str(tmp_path), model, found.vectors, fixed, {"seed": 7})
    got = experiment.load_models(spark, str(tmp_path))
    assert got[0].params == model.params and got[2] == fixed
    shown = lambda m: sorted((r["doc_id"], r["token_idx"], round(r["lr_score"], 12)) for r in experiment.score_documents(docs, *m).collect())
    assert shown(got) == shown((model, found.vectors, fixed)) and len(shown(got)) > 100
    store = ModelStore(spark, f"{tmp_path}/models")
    # a write that broke off before its commit is not there; the next version gets a name of its own
    (tmp_path / "models" / "v2-broken" / "uni").mkdir(parents=True)
    assert store.versions() == [first]
    small = store.save({"one": spark.range(3)}, {"x": "ж"})
    assert store.versions() == [first, small] and small.startswith("v3-")
    tables, about = store.load()
    assert tables["one"].count() == 3 and about == {"x": "ж"}
    store.load(first)
    for part in (tmp_path / "models" / small / "one").glob("*.parquet"):
        part.unlink()
    with pytest.raises(ValueError):
        store.load(small)
    with pytest.raises(FileNotFoundError):
        store.load("v9-none")
    with pytest.raises(FileNotFoundError):
        ModelStore(spark, str(tmp_path / "nothing")).load()
