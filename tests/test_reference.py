"""Hand-computed cases and invariants of the library's own operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import classify as K
from quern.operators import evaluate as E
from quern.operators import iterate as M
from quern.operators import retrieve as R
from quern.operators import select as S
from quern.operators import setops as U
from quern.operators import split as D
from quern.operators import svm as V
from quern.operators import tokens as T
from quern.operators import tree as H
from quern.operators import weight as W
from quern.operators.corpus import Corpus, cooccurrence, dictionary, merge_weighted
from quern.operators.stats import log_evidence, simple_good_turing
from quern.sources import files as I


@pytest.fixture(scope="module")
def corpus(toy):
    return Corpus.of(toy, F.col("label"), F.col("tag"))


def column(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def words(spark, text, **how):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [r.word for r in T.tokens(df, words=T.words_of(F.col("text"), **how)).orderBy("pos").collect()]


def test_lexer(spark):
    assert words(spark, "http://www.ab.example.org:8080 Don't a I x2y café") == ["http", "www", "ab", "example", "org", "don", "caf"]
    assert words(spark, "") == []
    assert words(spark, "K" + "K" + "elvin") == ["elvin"]


def test_html_and_header(spark):
    df = spark.createDataFrame([("<FONT SIZE=+2>S</FONT>unlight &amp; sky",), ("a<b>bold</b> x &eacute;t&eacute; fin",)], "h string")
    got = [[w for w in r.w] for r in df.select(T.words_of(T.strip_html(F.col("h"))).alias("w")).collect()]
    assert got == [["unlight", "sky"], ["bold", "fin"]]
    assert spark.range(1).select(T.skip_header(F.lit("A: b\r\nC: d\r\n\r\nbody\n\nmore")).alias("x")).first().x == "body\n\nmore"


def test_grams(spark):
    df = spark.createDataFrame([(1, k, w) for k, w in enumerate(["aa", "bb", "cc"])], "doc_id long, pos int, word string")
    got = [r.gram for r in T.grams(df, 2).orderBy("pos", F.desc("size")).collect()]
    assert got == ["aa;bb", "aa", "bb;cc", "bb", "cc", "cc"]


def test_is_text(spark):
    df = spark.createDataFrame([("plain text",), ("é" * 10,), ("",), (None,)], "t string")
    assert [r.x for r in df.select(T.is_text(F.col("t")).alias("x")).collect()] == [True, False, False, False]


def test_stem():
    from quern.functions.stem import porter

    pairs = {"caresses": "caress", "ponies": "poni", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "happy": "happi", "relational": "relat", "generalization": "gener", "hopefulness": "hope", "adjustment": "adjust", "probate": "probat", "controll": "control"}
    assert {w: porter(w) for w in pairs} == pairs


def test_naive_bayes(corpus):
    assert column(K.naive_bayes(corpus), "class", "score") == pytest.approx({"pos": 0.8, "neg": 0.2})
    assert column(K.bernoulli(corpus), "class", "score")["pos"] == pytest.approx(0.850642, abs=1e-6)
    seen, unseen = K.smoothed(corpus, "witten_bell")
    assert column(unseen, "class", "p0")["pos"] == pytest.approx(0.375)
    assert seen.where("class = 'pos' and word = 'good'").first().p == pytest.approx(0.25)


@pytest.mark.parametrize("method", ["laplace", "m_estimate", "witten_bell"])
def test_probabilities_sum_to_one(corpus, method):
    seen, unseen = K.smoothed(corpus, method)
    v = corpus.class_words.count()
    sums = seen.groupBy("class").agg(F.sum("p").alias("s"), F.count("*").alias("k")).join(unseen, "class").collect()
    assert all(r.s + (v - r.k) * (r.p0 or 0) == pytest.approx(1) for r in sums)


@pytest.mark.parametrize("name", sorted(set(K.METHODS) - {"tfidf", "tfidf_words", "tfidf_log_occur", "tfidf_log_words", "knn", "kl", "evi"}))
def test_posteriors_sum_to_one(corpus, name):
    assert sum(r.score for r in K.METHODS[name](corpus).collect()) == pytest.approx(1)


def test_kl_scores_sum_to_minus_one(corpus):
    assert sum(r.score for r in K.kl_divergence(corpus).collect()) == pytest.approx(-1)


def test_information_gain(corpus):
    got = column(S.information_gain(corpus), "word", "ig")
    assert got == pytest.approx({"bad": 0.9182958, "film": 0, "good": 0.2516292, "great": 0.2516292}, abs=1e-6)


def test_weights(corpus):
    idf = column(W.idf(corpus.tf, corpus.docs), "word", "idf")
    assert idf["film"] == 0 and idf["good"] == pytest.approx(1.5849625)
    merged = merge_weighted(W.tfidf(corpus.tf, corpus.docs), corpus.docs)
    assert column(merged.where("word = 'film'"), "class", "weight") == {"pos": 2, "neg": 1}
    norms = W.normalise(W.tfidf(corpus.tf, corpus.docs)).groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in norms)


def test_dictionary_and_cooccurrence(spark, corpus, toy):
    wi = column(dictionary(T.tokens(toy)), "word", "wi")
    assert wi == {"good": 0, "film": 1, "great": 2, "bad": 3}
    pairs = {(r.w1, r.w2): r.n for r in cooccurrence(corpus.tf, 1).collect()}
    assert pairs["good", "good"] == 5 and pairs["good", "film"] == 3


def test_quotas(spark):
    rows = [(k, c) for k, c in enumerate("AAAAABBBCC")]
    docs = spark.createDataFrame(rows, "doc_id long, class string").withColumn("tag", F.lit("untagged"))
    assert column(D.quotas(docs, 4), "class", "quota") == {"A": 3, "B": 1, "C": 0}
    tagged = D.tag_by_count(docs, 4, "test")
    assert tagged.where("tag = 'test'").count() == 4 and tagged.count() == 10


def test_specs():
    assert D.parse_spec("5") == D.SplitSpec("count", 5, "all")
    assert D.parse_spec("0.3r") == D.SplitSpec("fraction", 0.3, "remaining")
    assert D.parse_spec("10t").pool == "train" and D.parse_spec("7pc").kind == "per_class"
    assert D.parse_spec("[a,1,b,2]").value == {"a": 1, "b": 2} and D.parse_spec("remaining").kind == "remaining" and D.parse_spec("x/y.txt").kind == "files"


def test_phrases_and_boolean(spark):
    docs = spark.createDataFrame([(1, "aa bb cc"), (2, "bb aa"), (3, "aa bb aa bb")], "doc_id long, text string")
    index = R.postings(docs)
    assert column(R.term_hits(index, ("aa", "bb")), "doc_id", "tf") == {1: 1, 3: 2}
    assert R.term_hits(index, ("aa", "bb")).where("doc_id = 3").first().score == pytest.approx(1)
    assert {r.doc_id for r in R.boolean_query(index, "+aa -cc").collect()} == {2, 3}
    assert R.boolean_query(index, "+aa -aa").count() == 0
    assert {r.doc_id for r in R.boolean_query(index, '+"aa bb"').collect()} <= {r.doc_id for r in R.boolean_query(index, "+aa +bb").collect()}
    assert R.boolean_query(index, "the").count() == 0


def test_set_operations(spark):
    a, b = (spark.createDataFrame(x, "key long, score double") for x in ([(1, 1.0), (2, 2.0)], [(2, 3.0), (3, 4.0)]))
    assert column(U.union(a, b), "key", "score") == {1: 1, 2: 5, 3: 4}
    assert column(U.intersection(a, b), "key", "score") == {2: 5}
    assert column(U.overlay(a, b), "key", "score") == {1: 1, 2: 5}
    assert column(U.difference(a, b), "key", "score") == {1: 1}


def test_evaluation(spark):
    preds = spark.createDataFrame([(0, 1, "A", "A", 0.9), (0, 2, "A", "B", 0.8), (0, 3, "B", "B", 0.7)], "trial int, doc_id long, actual string, predicted string, score double")
    assert E.accuracy(preds).first().accuracy == pytest.approx(200 / 3)
    assert {(r.actual, r.predicted): r.n for r in E.confusion(preds).collect()} == {("A", "A"): 1, ("A", "B"): 1, ("B", "B"): 1}
    two = spark.createDataFrame([(t, k, "A", "A" if t or k else "B", 1.0) for t in (0, 1) for k in (0, 1)], preds.schema)
    got = E.accuracy_summary(two).first()
    assert got["mean"] == pytest.approx(75) and got["stderr"] == pytest.approx(25 / math.sqrt(2))


def test_em_and_maxent(corpus):
    got = column(M.em(corpus, rounds=2), "class", "score")
    assert sum(got.values()) == pytest.approx(1) and got["pos"] > 0.5
    few, many = (column(M.maxent_classify(corpus, M.maxent(corpus, r), "train"), "doc_id", "score") for r in (1, 8))
    scores = M.maxent_classify(corpus, M.maxent(corpus, 8), "train").collect()
    assert {r.doc_id for r in scores if r["class"] == "neg" and r.score > 0.5} == {3}
    assert few and many


def test_good_turing_and_evidence():
    p0, star = simple_good_turing({1: 120, 2: 40, 3: 24, 4: 13, 5: 15, 6: 5, 7: 11, 8: 2}, 7)
    assert p0 == pytest.approx(120 / sum(r * n for r, n in {1: 120, 2: 40, 3: 24, 4: 13, 5: 15, 6: 5, 7: 11, 8: 2}.items()))
    assert 0 < star[1] < 1 and all(star[r] < r for r in star)
    assert log_evidence(np.array([1, 0]), np.array([1.0, 1.0])) == pytest.approx(math.log(0.5))


def test_smo_separates():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(2, 0.5, (20, 2)), rng.normal(-2, 0.5, (20, 2))])
    y = np.array([1] * 20 + [-1] * 20)
    alpha, b = V.smo(x @ x.T, y, 10.0)
    assert ((x @ x.T @ (alpha * y) - b) * y > 0.99).all() and abs((alpha * y).sum()) < 1e-9
    hidden = y.copy()
    hidden[5:20] = hidden[25:] = 0
    assert (V.transduce(x, hidden, 10.0, 1.0) == y).all()


def test_tree(spark):
    leaves = spark.createDataFrame([("a/x",), ("a/y",), ("b/z",)], "path string")
    assert {(r.node, r.parent, r.depth) for r in H.nodes(leaves).collect()} == {("", None, 0), ("a", "", 1), ("b", "", 1), ("a/x", "a", 2), ("a/y", "a", 2), ("b/z", "b", 2)}
    anc = H.ancestors(leaves)
    assert {(r.node, r.level) for r in anc.where("leaf = 'a/x'").collect()} == {("a/x", 0), ("a", 1), ("", 2)}
    tf = spark.createDataFrame([(1, "u", 5), (1, "v", 1), (2, "w", 4)], "doc_id long, word string, n long")
    priors, lambdas, words = H.cluster(tf, ["a/x", "b/z"], rounds=2)
    assert sum(r.prior for r in priors.collect()) == pytest.approx(1)
    assert all(r.s == pytest.approx(1) for r in lambdas.groupBy("leaf").agg(F.sum("lambda").alias("s")).collect())
    assert all(r.s == pytest.approx(1) for r in words.groupBy("node").agg(F.sum("p").alias("s")).collect())


def test_label_search(spark):
    model = {"a": {"u": 0.9, "v": 0.1}, "b": {"w": 0.9, "v": 0.1}}
    tf = spark.createDataFrame([(1, "u", 20), (2, "u", 20), (2, "w", 20)], "doc_id long, word string, n long")
    got = column(H.greedy_labels(tf, model), "doc_id", "classes")
    assert got == {1: "a", 2: "a|b"} and H.exhaustive_labels({"u": 20, "w": 20}, model) == ("a", "b")


def test_generators(spark):
    df = H.multinomial_documents(spark, {"a": 0.5, "b": 0.5}, 20, 50)
    assert all(r.s == 50 for r in df.groupBy("doc_id").agg(F.sum("n").alias("s")).collect())
    again = H.multinomial_documents(spark, {"a": 0.5, "b": 0.5}, 20, 50)
    assert df.exceptAll(again).count() == 0


def test_matrix_round_trip(spark, corpus, tmp_path):
    lines = I.print_matrix(corpus.tf, corpus.docs, "wn").select(F.concat_ws(" ", F.col("doc_id").cast("string"), "class", F.lit(""), "line").alias("value"))
    back = I.read_matrix(lines).select(F.col("name").cast("long").alias("doc_id"), "word", "n")
    assert back.exceptAll(corpus.tf.select("doc_id", "word", "n")).count() == 0
    I.write_archive(str(tmp_path / "a"), {"tf": corpus.tf}, {"method": "knn"})
    tables, model = I.read_archive(spark, str(tmp_path / "a"))
    assert model["method"] == "knn" and tables["tf"].count() == corpus.tf.count()


def test_class_folders(spark, tmp_path):
    for c in ("x", "y"):
        (tmp_path / c / "deep").mkdir(parents=True)
        (tmp_path / c / "a.txt").write_text(f"{c} text")
    got = {r["class"]: r.text for r in I.read_class_folders(spark, str(tmp_path)).collect()}
    assert got == {"x": "x text", "y": "y text"}
    with pytest.raises(PermissionError):
        I.pipe_text(spark.createDataFrame([(1, "a")], "doc_id long, text string"), ["cat"])


def test_stream_scores(spark, corpus, tmp_path):
    from quern.streaming.score import LineServer, NaiveBayesModel

    model = NaiveBayesModel.fit(corpus)
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(9, "good great film"), (10, "bad")], "doc_id long, text string").write.parquet(str(tmp_path / "in" / "p"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in" / "p"))
    run = model.attach(stream, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert column(spark.read.parquet(str(tmp_path / "out")), "doc_id", "class") == {9: "pos", 10: "neg"}
    server = LineServer(spark.createDataFrame([(1, "red fox"), (2, "red hen")], "doc_id long, text string"))
    assert {r.doc_id for r in server.handle("red")} == {1, 2}
    server.handle(";DELETE 1")
    assert {r.doc_id for r in server.handle("red")} == {2}
    server.handle(";INDEX 1 red again")
    assert {r.doc_id for r in server.handle("red")} == {1, 2} and server.handle(";QUIT") is None


def test_entry(spark):
    import os

    import __spark_entry__ as entry

    names = entry.queries()
    assert len(names) > 150 and set(entry.oracle_sql()) <= set(names)
    if os.path.exists("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0


def test_lowest_hashes(spark):
    from hashlib import md5

    from quern.operators.split import lowest, split

    rows = [(k, "ab"[k % 3 == 0]) for k in range(900)] + [(5000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, class string")
    want = {"a": 17, "b": 299, "c": 4}
    got = column(lowest(docs, spark.createDataFrame(list(want.items()), "class string, quota long"), 3).withColumn("x", F.lit(1)), "doc_id", "x")
    order = sorted(rows, key=lambda r: md5(f"{r[0]}:3".encode()).hexdigest())
    assert set(got) == {k for c, n in want.items() for k in [d for d, x in order if x == c][:n]}
    tags = split(docs.withColumn("name", F.lit("")), {"ignore": "[b,3]", "test": "0.5", "train": "40r", "validation": "0.1t", "unlabeled": "remaining"})
    assert column(tags.groupBy("tag").count(), "tag", "count") == {"ignore": 3, "test": 449, "train": 36, "validation": 4, "unlabeled": 409}


def test_stored_and_released(spark):
    from quern.functions.lineage import release, spread, stored

    df = stored(spark.range(10).withColumnRenamed("id", "x"), "test")
    assert df.count() == 10 and spread(spark.range(4, numPartitions=1)).rdd.getNumPartitions() > 1
    assert release(spark) >= 1 and release(spark) == 0
    with pytest.raises(Exception):
        spark.read.schema(df.schema).parquet(df.inputFiles()[0]).count()


def test_log_gamma_and_bags(spark):
    from quern.operators.stats import bag_evidence, log_evidence, log_gamma

    xs = [0.01, 0.5, 1.0, 2.5, 9.0, 333.3, 1e6]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", log_gamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-9, abs=1e-9) for r in got)
    bags = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "z", 9), (2, "c", 2)], "doc_id long, word string, n long")
    alphas = spark.createDataFrame([("k", "a", 0.5), ("k", "b", 2.0), ("k", "c", 1.5)], "class string, word string, alpha double")
    got = column(bag_evidence(bags, alphas), "doc_id", "log_evidence")
    assert got[1] == pytest.approx(log_evidence(np.array([3, 1, 0]), np.array([0.5, 2.0, 1.5]))) and got[2] == pytest.approx(log_evidence(np.array([0, 0, 2]), np.array([0.5, 2.0, 1.5])))


def test_postings_archive(spark, tmp_path):
    from quern.operators.retrieve import postings
    from quern.sources import files as I

    docs = spark.createDataFrame([(1, "red fox and red hen"), (2, "hen")], "doc_id long, text string")
    path = str(tmp_path / "index")
    I.write_postings(path, postings(docs.where("doc_id = 1")))
    I.write_postings(path, postings(docs.where("doc_id = 2")), append=True)
    key = lambda df: sorted((r.word, r.doc_id, r.pos) for r in df.collect())
    assert key(I.read_postings(spark, path)) == key(postings(docs))
    assert key(I.read_postings(spark, path, ("hen", "red"))) == [("hen", 1, 4), ("hen", 2, 0), ("red", 1, 0), ("red", 1, 3)]


def test_pipe_allowed(spark):
    from quern.sources.files import pipe_text

    docs = spark.createDataFrame([(1, "abc"), (2, "")], "doc_id long, text string")
    assert column(pipe_text(docs, ["tr", "a-z", "A-Z"], allowed=True), "doc_id", "text") == {1: "ABC", 2: ""}


def test_label_searches(spark):
    from quern.operators import tree as H

    model = {"x": {"a": 0.9, "b": 0.1}, "y": {"c": 0.9, "d": 0.1}, "z": {"a": 0.5, "c": 0.5}}
    bags = {1: {"a": 9, "b": 1}, 2: {"a": 20, "b": 5, "c": 20, "d": 5}, 3: {"q": 1}}
    tf = spark.createDataFrame([(d, w, n) for d, b in bags.items() for w, n in b.items()], "doc_id long, word string, n long")
    words = spark.createDataFrame([(c, w, p) for c, ps in model.items() for w, p in ps.items()], "class string, word string, p double")
    for how in ("greedy0", "greedy1", "greedy2"):
        got = column(H.search_labels(tf, words, how), "doc_id", "classes")
        assert got[1] == "x" and got[3] == "x"
        if how == "greedy2":  # the others can't give up the label they begin with, z
            assert got[2] == "|".join(H.exhaustive_labels(bags[2], model, 3)) == "x|y"


def test_mixtures_of_label_sets(spark):
    from quern.operators import tree as H

    tf = spark.createDataFrame([(1, "a", 9), (2, "c", 9), (3, "a", 6), (3, "c", 3)], "doc_id long, word string, n long")
    sets = spark.createDataFrame([(1, ["x"]), (2, ["y"]), (3, ["y", "x"])], "doc_id long, classes array<string>")
    weights, words = H.mixture_em(tf, sets, alpha=0.01)
    got = {(r.set_key, r["class"]): r.weight for r in weights.collect()}
    assert got[("x", "x")] == 1 and got[("x|y", "x")] == pytest.approx(2 / 3, abs=0.01) and got[("x|y", "y")] == pytest.approx(1 / 3, abs=0.01)
    assert words.groupBy("class").agg(F.sum("p").alias("p")).where("abs(p - 1) > 1e-9").count() == 0


def test_svm_in_tasks(spark):
    from quern.operators import svm as V

    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(k, "ab"[k % 2], "train" if k < 20 else "test") for k in range(60)], "doc_id long, class string, tag string")
    vectors = spark.createDataFrame([(k, w, float(x)) for k in range(60) for w, x in (("u", 1 - k % 2 + rng.normal() / 9), ("v", k % 2 + rng.normal() / 9))], "doc_id long, word string, weight double")
    got = {r.doc_id: r.label for r in V.transduce_pairwise(vectors, docs, c=10.0).collect()}
    assert len(got) == 40 and all(label == "ab"[k % 2] for k, label in got.items())
    asked = V.active_rounds(vectors, docs, rounds=2, each=3, start=5, c=10.0).collect()
    assert sorted(r["round"] for r in asked) == [0] * 3 + [1] * 3 and len({r.doc_id for r in asked}) == 6
    right = V.vote(vectors, docs, V.train_pairwise(vectors, docs, c=10.0, drop_bound=True)).groupBy("doc_id").agg(F.max_by("class", "score").alias("class"))
    assert all(r["class"] == "ab"[r.doc_id % 2] for r in right.collect())


def test_growing_hierarchy(spark):
    from quern.operators import tree as H

    tf = spark.createDataFrame([(k, w, 5) for k in range(12) for w in (("a", "b") if k % 2 else ("c", "d"))], "doc_id long, word string, n long")
    priors, lambdas, words = H.grow_clusters(tf, decay=0.1, most_rounds=3)
    assert priors.agg(F.sum("prior")).first()[0] == pytest.approx(1) and priors.count() >= 2
    assert lambdas.groupBy("leaf").agg(F.sum("lambda").alias("s")).where("abs(s - 1) > 1e-6").count() == 0
    assert words.groupBy("node").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-6").count() == 0


def test_text_grams(spark):
    df = spark.createDataFrame([(1, "aa bb cc"), (2, "")], "doc_id long, text string")
    assert [r.gram for r in T.text_grams(df, 2).orderBy("pos", F.desc("size")).collect()] == ["aa;bb", "aa", "bb;cc", "bb", "cc", "cc"]


def test_stems_in_the_chain(spark):
    spec = T.PostProcess(stop=True, stem=True, shortest=3, first_n=2)
    docs = spark.createDataFrame([(1, "The motoring ponies hopping during agreed")], "doc_id long, text string")
    assert [r.word for r in spec.tokens(docs, T.raw_words(F.col("text"))).orderBy("pos").collect()] == ["motor", "poni"]


def test_gamma_draws_have_their_mean(spark):
    from quern.functions.portable import uniform
    from quern.operators.corpus import Corpus
    from quern.operators.iterate import perturbed_counts

    docs = spark.createDataFrame([(1, "train", "k")], "doc_id long, tag string, class string")
    tf = spark.createDataFrame([(1, f"w{k}", 7) for k in range(3000)], "doc_id long, word string, n long")
    n = [r.n for r in perturbed_counts(Corpus(docs, tf), "gamma").collect()]
    assert min(n) > 0 and np.mean(n) == pytest.approx(7, abs=0.2) and np.var(n) == pytest.approx(7, abs=0.8)
    u = [r.u for r in spark.range(3000).select(uniform("id", seed=2).alias("u")).collect()]
    assert np.mean(u) == pytest.approx(0.5, abs=0.03) and 0 < min(u) and max(u) < 1
