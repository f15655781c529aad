import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from textsieve.operators import corrupt, embed, evaluate, features, lm, ml, mlm, suggest
from textsieve.plans import experiment
from textsieve.sources import readers
from textsieve.streaming import scoring

S = "doc_id long, sent_pos int, tokens array<string>"


@pytest.fixture(scope="module")
def tiny(spark):
    s = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["a", "c"])], S)
    return s, lm.fit(s)


def test_suggestions(spark, tiny):
    _, m = tiny
    rows = spark.createDataFrame([(0, ["a", "b"], 0, 1)], "place int, tokens array<string>, gap_idx int, idx int")
    words = spark.createDataFrame([("a",), ("b",), ("c",)], "w string")
    ins = suggest.suggest_insertions(rows, ["place"], m, words, 2).orderBy("rank").collect()
    assert [(r["candidate"], round(r["score"], 6)) for r in ins] == [("c", -3.55271), ("b", -3.55271)]
    rep = suggest.suggest_replacements(rows, ["place"], m, words).orderBy("rank").collect()
    assert [(r["candidate"], round(r["score"], 6)) for r in rep] == [("c", -1.285892), ("a", -4.766278)]
    outside = rows.withColumns({"idx": F.lit(2), "gap_idx": F.lit(1)})
    assert suggest.suggest_replacements(outside, ["place"], m, words).count() == suggest.suggest_insertions(outside, ["place"], m, words).count() == 0


def scored(spark, ys, ss):
    return spark.createDataFrame([("m", float(s), y) for y, s in zip(ys, ss, strict=True)], "method string, score double, label int")


def test_thresholds(spark):
    x = scored(spark, [0, 1, 1], [0.1, 0.4, 0.8])
    assert tuple(evaluate.best_f1_threshold(x, "compat").first())[1:] == (0.1, 1.0)
    assert tuple(evaluate.best_f1_threshold(x, "corrected").first())[1:] == (0.4, 1.0)
    none = scored(spark, [0, 0], [0.1, 0.2])
    assert tuple(evaluate.best_f1_threshold(none).first())[1:] == (0.5, 0.0)
    assert evaluate.average_precision(none).first()[1] == 0.0
    with pytest.raises(ValueError):
        evaluate.best_f1_threshold(x, "other")


def test_average_precision(spark):
    # scores 4 3 3 1, labels 1 0 1 0: precision 1 at recall 1/2, 2/3 at recall 1
    assert evaluate.average_precision(scored(spark, [1, 0, 1, 0], [4, 3, 3, 1])).first()[1] == pytest.approx(0.5 + 0.5 * 2 / 3)
    curve = evaluate.pr_curve(scored(spark, [1, 0, 1, 0], [4, 3, 3, 1])).orderBy("position").collect()
    assert [r["threshold"] for r in curve] == [1.0, 3.0, 4.0, None] and (curve[-1]["precision"], curve[-1]["recall"]) == (1.0, 0.0)


def test_corruption_bookkeeping(spark):
    words = [f"w{i}" for i in range(30)]
    s = spark.createDataFrame([(i, 0, words[i % 20 : i % 20 + 5 + i % 4]) for i in range(200)], S)
    vocab = spark.createDataFrame([(w,) for w in words], "w string")
    out = corrupt.corrupt_corpus(s, vocab, 0.5, 0.5, 2, False, 3).collect()
    assert len(out) == 200
    for r in out:
        if len(r["tokens"]) < 6:
            assert r["tokens"] == r["tokens_corrupted"] and not r["deletions"] and not r["substitutions"]
        again = list(r["tokens_corrupted"])
        for x in r["substitutions"]:
            assert again[x["pos"]] == x["new"] != x["orig"]
            again[x["pos"]] = x["orig"]
        for x in r["deletions"]:
            again.insert(x["pos"], x["token"])
            assert x["left"] == (r["tokens"][x["pos"] - 1] if x["pos"] else None)
        assert again == r["tokens"]
    assert any(r["deletions"] for r in out) and any(r["substitutions"] for r in out)
    assert all(len(r["deletions"]) + len(r["substitutions"]) <= 1 for r in corrupt.corrupt_corpus(s, vocab, 0.9, 0.9, 1, False, 3).collect())


def test_edge_deletions_have_no_label(spark):
    row = [(1, 0, ["a", "b", "c"], ["a", "c"], [], [(0, "x", None, "a"), (1, "b", "a", "c")])]
    c = spark.createDataFrame(row, f"{S}, tokens_corrupted array<string>, substitutions array<struct<pos:int,orig:string,new:string>>, deletions {corrupt.DELETIONS}")
    assert [r["label"] for r in features.gap_labels(c).collect()] == [1]
    assert sorted(str(r["gap_idx"]) for r in features.located_gaps(c).collect()) == ["0", "None"]


def test_cosine_and_outliers(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 0, None), (3, 1, [1.0, 1.0])], "g int, i int, v array<double>")
    got = {(r["g"], r["i"]): r["outlier"] for r in embed.neighbour_outliers(df, "g", "i", "v").collect()}
    assert got == {(1, 0): 1.0, (1, 1): 1.0, (2, 0): 0.0, (3, 0): 1.0, (3, 1): 0.0}


def test_signs_of_all_dimensions_differ(spark):
    words = spark.createDataFrame([(f"word{i}{i * 7}",) for i in range(60)], "w string")
    rows = embed.subword_signs(words, 130).drop("w").collect()
    columns = {tuple(r[d] for r in rows) for d in range(130)}
    assert len(columns) == 130


def test_entry_without_the_corpus_operators(tmp_path):
    """The entry still imports, with the other queries, where the optional folders are gone."""
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{top}/textsieve", tmp_path / "textsieve", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    n, oracles, corpus = map(int, said.stdout.split())
    assert n >= 50 and oracles >= 48 and corpus == 0


def test_classifier(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=300) > 0.8).astype(int)
    rows = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "p double, q double, label int")
    model = ml.train_token_classifier(rows, ("p", "q"))
    z = np.column_stack([np.ones(300), (x - x.mean(0)) / x.std(0)])
    theta = np.array([model.intercept, *model.coefficients])
    w = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (1 - y).sum()))
    assert np.abs(z.T @ (w * (y - 1 / (1 + np.exp(-z @ theta)))) - theta).max() < 1e-6  # the optimum's condition
    assert model.predict(rows).where("lr_score between 0 and 1").count() == 300 and set(model.feature_weights()) == {"p", "q"}
    with pytest.raises(ValueError):
        ml.train_token_classifier(rows.where("label = 0"), ("p", "q"))


def docx(paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    xml = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(["one", " ", "two"]))
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\xff\xd0\xb0")
    assert [r["text"] for r in readers.read_docx_paragraphs(spark, str(tmp_path / "a.docx")).collect()] == ["one", "two"]
    assert readers.read_docx(spark, [str(tmp_path / "a.docx")]).first()["text"] == "one\ntwo"
    assert readers.read_text(spark, str(tmp_path / "a.txt")).first()["text"] == "x\nyа"
    rows = spark.createDataFrame([("1", ["а", "b"]), ("2", [])], readers.SENTENCES)
    readers.write_jsonl(rows, str(tmp_path / "s.jsonl"))
    assert sorted(map(tuple, readers.read_jsonl(spark, str(tmp_path / "s.jsonl")).collect())) == [("1", ["а", "b"]), ("2", [])]
    (tmp_path / "b.jsonl").write_text('{"id": 7, "tokens": ["x"]}\n\n')
    assert [tuple(r) for r in readers.read_jsonl(spark, str(tmp_path / "b.jsonl")).collect()] == [("7", ["x"])]
    readers.write_csv(rows.select("id"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id"]


def test_experiment(spark, tmp_path):
    import random

    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in "lmnr"]
    docs = spark.createDataFrame([(str(i), ". ".join(" ".join(rng.choices(words, k=rng.randint(6, 12))) for _ in range(6))) for i in range(60)], "doc_id string, text string")
    p = experiment.Params(p_delete=0.3, p_substitute=0.4, ft_dim=8, top_vocab_n=50, top_examples=3)
    metrics = experiment.save(experiment.run_experiment(docs, p), str(tmp_path / "out"), p, "toy")
    assert set(metrics["token_metrics"]) == {"ngram_surp", "ft_outlier", "lr_score"} and set(metrics["gap_metrics"]) == {"gap_score"}
    assert metrics["corpus_type"] == "toy" and metrics["corpus"]["sentences"] == 360 and metrics["correction"]["subs_total"] > 0
    report = (tmp_path / "out" / "top_examples.md").read_text()
    assert report.count("\ninsert suggest: ") == 3 and report.count("\nsuggest: ") == 3
    saved = json.loads((tmp_path / "out" / "metrics.json").read_text())
    curve = saved["token_metrics"]["lr_score"]["pr_curve"]
    assert len(curve["precision"]) == len(curve["recall"]) == len(curve["thresholds"]) + 1 and curve["recall"][-1] == 0
    table = spark.read.option("header", True).csv(str(tmp_path / "out" / "pr_curve.csv"))
    assert table.where("method = 'lr_score'").count() == len(curve["precision"]) and "<polyline" in (tmp_path / "out" / "pr_curve.svg").read_text()
    assert "lr_score" in experiment.summarize(saved) and "first 0.000, among 5 0.000, of 0" in experiment.summarize({})
    ids = sorted((r["id"] for r in readers.read_jsonl(spark, str(tmp_path / "out" / "corpus_sentences.jsonl")).collect()), key=lambda x: int(x[1:]))
    assert ids == [f"s{i}" for i in range(360)]
    exact = experiment.run_experiment(docs, experiment.Params(**{**p.__dict__, "exact_split": True})).sentences
    assert exact.where("is_train").count() == 270
    with pytest.raises(FileNotFoundError):
        experiment.modern([])
    with pytest.raises(FileNotFoundError):
        experiment.main(["--input_txt", str(tmp_path / "none.txt")])
    with pytest.raises(ValueError):
        experiment.main([])


class Stub:
    def word_nll(self, tokens):
        return [float(len(t)) for t in tokens], [len(t) / 2 for t in tokens]

    def topk(self, tokens, idx, k):
        return [tokens[idx].upper()][:k]


def test_masked_model_interface(spark):
    s = spark.createDataFrame([(1, ["a", "bbb", "cc"])], "k int, tokens array<string>")
    many = spark.createDataFrame([(f"s{i}", ["a"]) for i in range(12)], "id string, tokens array<string>")
    assert [r["id"] for r in mlm.first_sentences(many, 3).collect()] == ["s0", "s1", "s2"]
    got = mlm.most_surprising(s, Stub, ["k"], words=2).orderBy("rank").collect()
    assert [(r["idx"], r["nll_norm"], r["replacements"]) for r in got] == [(1, 1.5, ["BBB"]), (2, 1.0, ["CC"])]


def test_stream_scores_like_a_table(spark, tmp_path):
    docs = spark.createDataFrame([(i, "one two three four five six seven. one three five seven nine two") for i in range(3)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    from textsieve.operators.sentences import text_to_sentences

    s = text_to_sentences(docs)
    model = lm.fit(s)
    scoring.score_gaps(scoring.read_documents(spark, str(tmp_path / "in")), model, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    want = sorted(map(str, lm.gap_scores(s, model).collect()))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).drop("batch").collect())) == want


def test_bench_times_every_operator_and_the_pipeline():
    import __spark_entry__
    import bench

    assert {n for n in __spark_entry__.queries() if n == "pipeline" or n.startswith("op")} <= set(bench.HEADLINE)
