"""Smoothing, scoring, evaluation, retrieval and set operations as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import classify as K
from quern.operators import evaluate as E
from quern.operators import retrieve as R
from quern.operators import setops as U
from quern.operators import weight as W
from quern.operators.stats import bag_evidence, dirichlet_fit, frequency_of_frequencies, good_turing, kl_words
from quern.operators.tokens import tokens
from quern.plans.catalogue import CLASSES, DOCS, TF, TOK, corpus, query, r6, softmax_sql, table
from quern.plans.text import _IDF, _POST

# Smoothing

_P = {
    "laplace": ("(n + 1) / (word_count + v)", "1 / (word_count + v)"),
    "m_estimate": ("(n + 10 / v) / (word_count + 10)", "(10 / v) / (word_count + 10)"),
    "witten_bell": ("n / (word_count + n_unique)", "n_unique / ((word_count + n_unique) * (v - n_unique))"),
    "document": ("(df + 1) / (n_docs + 2)", "1 / (n_docs + 2)"),
}
for _k, (_name, (_p, _p0)) in enumerate(_P.items()):

    def _m(spark, sf, _name=_name):
        seen, unseen = K.smoothed(corpus(spark, sf), _name, **({"m": 10.0} if _name == "m_estimate" else {}))
        return seen.join(unseen, "class").select("class", "word", F.round("p", 9).alias("p"), F.round("p0", 9).alias("p0"))

    query(f"M{(1, 2, 3, 6)[_k]}_{_name}", f"with {CLASSES} select class, word, round({_p}, 9) as p, round({_p0}, 9) as p0 from ctf join cs using (class), v")(_m)

_ALPHA = "al as (select word, 0.1 + count(*) / 100 as alpha from ctf group by 1)"


def _alphas(c):
    return c.class_tf.groupBy("word").agg((0.1 + F.count("*") / 100).alias("alpha"))


@query("M5_dirichlet", f"with {CLASSES}, {_ALPHA}, sa as (select sum(alpha) as sa from al) select class, word, round((n + alpha) / (word_count + sa), 9) as p from ctf join cs using (class) join al using (word), sa")
def m5(spark, sf):
    c = corpus(spark, sf)
    return K.smoothed(c, "dirichlet", alphas=_alphas(c))[0].withColumn("p", F.round("p", 9))


@query("M4_frequency_of_frequencies", f"with {CLASSES} select class, n::bigint as r, count(*) as words from ctf where n <= 8 group by 1, 2")
def m4(spark, sf):
    return frequency_of_frequencies(corpus(spark, sf), 8)


@query(
    "M4_good_turing",
    f"with {CLASSES}, f as (select class, n as r, count(*) as w from ctf where n <= 100 group by 1, 2), q as (select *, coalesce(lag(r) over p, 0) as q, lead(r) over p as t from f window p as (partition by class order by r)), z as (select class, r, w, 2 * w / (coalesce(t, 2 * r - q) - q) as z from q), "
    "ln_ as (select class, regr_slope(ln(z), ln(r)) as slope, sum(w) filter (r = 1) / sum(r * w) as p0 from z group by 1), g as (select class, slope, p0, r from ln_, range(1, 8) x(r)), x as (select g.class, g.r, p0, (g.r + 1) * exp(slope * ln((g.r + 1) / g.r)) as y, (g.r + 1) * b.w / a.w as x, sqrt(power(g.r + 1, 2) * b.w / power(a.w, 2) * (1 + b.w / a.w)) as sd from g left join f a on a.class = g.class and a.r = g.r left join f b on b.class = g.class and b.r = g.r + 1), "
    "s as (select *, sum(case when x is null or abs(x - y) <= 1.96 * sd then 1 else 0 end) over (partition by class order by r) as smooth from x) select class, r::int as r, round(case when smooth > 0 then y else x end / r, 6) + 0 as discount, round(p0, 6) + 0 as p0 from s",
)
def m4g(spark, sf):
    return good_turing(corpus(spark, sf)).select("class", "r", r6("discount").alias("discount"), r6("p0").alias("p0"))


@query(
    "M7_leave_one_out",
    "with "
    + CLASSES
    + ", tr as (select doc_id, class as own, word, n from tf where tag = 'train'), sz as (select doc_id, own, sum(n) as size from tr group by all), grid as (select t.doc_id, t.own, t.word, t.n, cs.class, cs.word_count, coalesce(c.n, 0) as nwc from tr t cross join cs left join ctf c on c.word = t.word and c.class = cs.class), "
    + "s as (select doc_id, g.class, sum(g.n * ln((nwc - case when g.class = own then g.n else 0 end + 1) / (word_count - case when g.class = own then size else 0 end + v))) as s from grid g join sz using (doc_id, own), v group by 1, 2), l as (select d.doc_id, cs.class, ln(prior) + coalesce(s, 0) as log_score from docs d cross join cs left join s on s.doc_id = d.doc_id and s.class = cs.class where d.tag = 'train') "
    + softmax_sql("select * from l"),
)
def m7(spark, sf):
    return K.leave_one_out(corpus(spark, sf)).withColumn("score", r6("score"))


# Scoring


def _nb(p: str, p0: str, m: str = "k.n", prior: str = "ln(prior)", divisor: str = "1", extra: str = "") -> str:
    return (
        f"with {CLASSES}{extra}, grid as (select k.doc_id, k.word, {m} as m, cs.class, case when c.word is null then {p0} else {p} end as pr from known k cross join cs cross join v left join ctf c on c.word = k.word and c.class = cs.class), "
        f"s as (select doc_id, class, sum(m * ln(pr)) as s, sum(m) as size from grid group by 1, 2), l as (select t.doc_id, cs.class, ({prior} + coalesce(s, 0)) / ({divisor}) as log_score from testdocs t cross join cs left join s on s.doc_id = t.doc_id and s.class = cs.class) " + softmax_sql("select * from l")
    )


_LAP = ("(c.n + 1) / (word_count + v)", "1 / (word_count + v)")
for _name, _sql, _kw in (
    ("C1_naive_bayes", _nb(*_LAP), {}),
    ("C1_binary", _nb(*_LAP, m="1"), {"binary": True}),
    ("C1_uniform_priors", _nb(*_LAP, prior="-ln((select count(*) from cs))"), {"uniform_priors": True}),
    ("C1_anneal", _nb(*_LAP, divisor="(coalesce(size, 0) + 1) / 7"), {"temper": "anneal"}),
    ("C1_cross_entropy", _nb(*_LAP, divisor="coalesce(size, 0) + 1"), {"temper": "entropy"}),
    ("C1_document_then_word", _nb(*_LAP, m="100.0 * k.n / size"), {"event": "document_then_word"}),
    ("C1_witten_bell", _nb("c.n / (word_count + n_unique)", "n_unique / ((word_count + n_unique) * (v - n_unique))"), {"method": "witten_bell"}),
):

    def _c1(spark, sf, _kw=_kw):
        return K.naive_bayes(corpus(spark, sf), **_kw).withColumn("score", r6("score"))

    query(_name, _sql)(_c1)


@query(
    "C1_dirichlet",
    f"with {CLASSES}, {_ALPHA}, sa as (select sum(alpha) as sa from al), grid as (select k.doc_id, k.n as m, cs.class, (coalesce(c.n, 0) + alpha) / (word_count + sa) as pr from known k join al using (word) cross join cs cross join sa left join ctf c on c.word = k.word and c.class = cs.class), s as (select doc_id, class, sum(m * ln(pr)) as s from grid group by 1, 2), l as (select t.doc_id, cs.class, ln(prior) + coalesce(s, 0) as log_score from testdocs t cross join cs left join s on s.doc_id = t.doc_id and s.class = cs.class) "
    + softmax_sql("select * from l"),
)
def c1d(spark, sf):
    c = corpus(spark, sf)
    return K.naive_bayes(c, "dirichlet", alphas=_alphas(c)).withColumn("score", r6("score"))


@query(
    "C1_bernoulli",
    f"with {CLASSES}, full_ as (select cw.word, cs.class, prior, (coalesce(df, 0) + 1) / (n_docs + 2) as p from cw cross join cs left join ctf c on c.word = cw.word and c.class = cs.class), b as (select class, any_value(ln(prior)) + sum(ln(1 - p)) as base from full_ group by 1), s as (select doc_id, class, sum(ln(p / (1 - p))) as s from known join full_ using (word) group by 1, 2), l as (select t.doc_id, b.class, base + coalesce(s, 0) as log_score from testdocs t cross join b left join s on s.doc_id = t.doc_id and s.class = b.class) "
    + softmax_sql("select * from l"),
)
def c1b(spark, sf):
    return K.bernoulli(corpus(spark, sf)).withColumn("score", r6("score"))


@query("C2_nbsimple", _nb(*_LAP))
def c2(spark, sf):
    return K.METHODS["nbsimple"](corpus(spark, sf)).withColumn("score", r6("score"))


@query(
    "C3_nbshrinkage",
    f"with {CLASSES}, sg as (select class, count(*) filter (n = 1) as singles from ctf group by 1), grid as (select k.doc_id, k.n, cs.class, singles / word_count / v + 0.4 * (1 - singles / word_count) * total / alln + 0.6 * (1 - singles / word_count) * coalesce(c.n, 0) / word_count as p from known k join cw using (word) cross join cs join sg using (class) cross join v left join ctf c on c.word = k.word and c.class = cs.class), s as (select doc_id, class, sum(n * ln(p)) as s from grid group by 1, 2), l as (select t.doc_id, cs.class, ln(prior) + coalesce(s, 0) as log_score from testdocs t cross join cs left join s on s.doc_id = t.doc_id and s.class = cs.class) "
    + softmax_sql("select * from l"),
)
def c3(spark, sf):
    return K.shrinkage(corpus(spark, sf)).withColumn("score", r6("score"))


_ROCCHIO = f"with {TF}, {_IDF}, cl as (select class, word, sum(case when weight = 0 then n else weight end) as w from wt where tag = 'train' group by 1, 2), cn as (select class, word, w / sqrt(sum(w * w) over (partition by class)) as w from cl), q as (select doc_id, word, weight, sqrt(sum(weight * weight) over (partition by doc_id)) as size from wt where tag = 'test'), sc as (select doc_id, class, sum(weight / size * w) as score, count(*) as hits from q join cn using (word) where size <> 0 group by 1, 2)"


@query("C4_tfidf", f"{_ROCCHIO} select doc_id, class, round(score, 6) + 0 as score, hits from sc")
def c4(spark, sf):
    return K.rocchio(corpus(spark, sf)).withColumn("score", r6("score"))


@query("C5_prind", f"with {CLASSES}, s as (select doc_id, class, sum(k.n / size * (c.n / word_count) / (total / alln) * prior) as s from known k join ctf c using (word) join cs using (class) join cw using (word), v group by 1, 2), a as (select t.doc_id, cs.class, coalesce(s, 0) as s from testdocs t cross join cs left join s on s.doc_id = t.doc_id and s.class = cs.class) select doc_id, class, round(case when sum(s) over w > 0 then s / sum(s) over w else 1 / count(*) over w end, 6) + 0 as score from a window w as (partition by doc_id)")
def c5(spark, sf):
    return K.prind(corpus(spark, sf)).withColumn("score", r6("score"))


@query("C6_kl", f"with {CLASSES}, s as (select k.doc_id, cs.class, any_value(ln(prior)) / sum(k.n) + sum(k.n / size * ln(((coalesce(c.n, 0) + 1) / (word_count + v)) / (k.n / size))) as s from known k cross join cs cross join v left join ctf c on c.word = k.word and c.class = cs.class group by 1, 2) select doc_id, class, round(s / abs(sum(s) over (partition by doc_id)), 6) + 0 as score from s")
def c6(spark, sf):
    return K.kl_divergence(corpus(spark, sf)).withColumn("score", r6("score"))


@query("C7_evi", f"with {CLASSES}, kk as (select count(*) as kk, sum(word_count) as al from cs), pr as (select class, ln((word_count / al) / (1 - word_count / al)) as pr from cs, kk), s as (select k.doc_id, pr.class, sum(ln((coalesce(c.n, 0) + 1) / (total + kk - coalesce(c.n, 0) - 1)) - pr) as s from known k join cw using (word) cross join pr cross join kk left join ctf c on c.word = k.word and c.class = pr.class group by 1, 2) select t.doc_id, pr.class, round(pr + coalesce(s, 0), 6) + 0 as score from testdocs t cross join pr left join s on s.doc_id = t.doc_id and s.class = pr.class")
def c7(spark, sf):
    return K.evidence(corpus(spark, sf)).withColumn("score", r6("score"))


@query(
    "C8_knn",
    f"with {TF}, nd as (select count(*) as nd from docs where tag = 'train'), d as (select word, count(*) as df from tf where tag = 'train' group by 1), x as (select doc_id, tag, word, (1 + ln(n)) * ln(nd / df) as w from tf join d using (word), nd), y as (select doc_id, tag, word, w / s as w from (select *, sqrt(sum(w * w) over (partition by doc_id)) as s from x) where s <> 0), sim as (select a.doc_id, b.doc_id as other, round(sum(a.w * b.w), 9) as sim from y a join y b using (word) where a.tag = 'test' and b.tag = 'train' group by 1, 2), best as (select * from sim qualify row_number() over (partition by doc_id order by sim desc, other) <= 30) "
    "select best.doc_id, docs.class, round(sum(sim), 6) + 0 as score from best join docs on docs.doc_id = other group by 1, 2",
)
def c8(spark, sf):
    return K.nearest(corpus(spark, sf)).withColumn("score", r6("score"))


@query("C11_kernels", "with e as (select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings), q as (select * from e where vec_id % 100 = 0), dots as (select q.vec_id as a, e.vec_id as b, sum(q.x * e.x) as dot from q join e using (i) group by 1, 2), nn as (select vec_id, sum(x * x) as nn from e group by 1) select a, b, round(dot, 6) + 0 as linear, round((dot + 1) * (dot + 1), 6) + 0 as poly, round(exp(-(x.nn + y.nn - 2 * dot)), 6) + 0 as rbf, round(1 - 2 / (exp(2 * dot) + 1), 6) + 0 as sigmoid from dots join nn x on x.vec_id = a join nn y on y.vec_id = b")
def c11(spark, sf):
    from quern.operators.svm import kernel_matrix

    e = table(spark, sf, "embeddings")
    return kernel_matrix(e.where("vec_id % 100 = 0"), e).select("a", "b", *[r6(k).alias(k) for k in ("linear", "poly", "rbf", "sigmoid")])


@query("C23_dirichlet_fit", f"with {TF}, s as (select doc_id, sum(n) as s from tf group by 1), d as (select count(*) as d from s), p as (select word, n / s as p from tf join s using (doc_id)), m as (select word, sum(p) / d as m, sum(p * p) / d - power(sum(p) / d, 2) as v from p, d group by word, d), c as (select exp(avg(ln(m * (1 - m) / v - 1))) as s from (select *, max(word) over () as last from m) where word <> last and m * (1 - m) / v > 1) select word, round(s * m, 6) + 0 as alpha from m, c")
def c23(spark, sf):
    return dirichlet_fit(corpus(spark, sf).tf).withColumn("alpha", r6("alpha"))


@query(
    "C23_classify_bags",
    f"with {CLASSES}, al as (select class, word, 0.01 + 100.0 * n / word_count as alpha from ctf join cs using (class)), sa as (select class, sum(alpha) as a from al group by 1), ev as (select k.doc_id, al.class, lgamma(any_value(a)) - lgamma(any_value(a) + sum(k.n)) + sum(lgamma(alpha + k.n) - lgamma(alpha)) as e from known k join al using (word) join sa on sa.class = al.class group by 1, 2) select doc_id, class, round(e, 4) + 0 as log_evidence from ev",
)
def c23b(spark, sf):
    c = corpus(spark, sf)
    alphas = c.class_tf.join(F.broadcast(c.class_stats.select("class", "word_count")), "class").select("class", "word", (0.01 + 100.0 * F.col("n") / F.col("word_count")).alias("alpha"))
    return bag_evidence(K._known(c, "test"), alphas).select("doc_id", "class", (F.round("log_evidence", 4) + F.lit(0.0)).alias("log_evidence"))


@query("C24_kl_words", f"with {CLASSES}, p as (select word, (sum(n) filter (class = 'en') + 0.5) as a, (sum(n) filter (class = 'fr') + 0.5) as b from ctf group by 1), q as (select word, coalesce(a, 0.5) as a, coalesce(b, 0.5) as b from p), r as (select a / sum(a) over () as p, b / sum(b) over () as q from q) select round(sum(p * ln(p / q)), 6) as kl, round(sum(0.5 * p * ln(p / ((p + q) / 2))), 6) as half_js from r")
def c24(spark, sf):
    c = corpus(spark, sf)
    part = lambda name: c.class_tf.where(F.col("class") == name).select("word", "n")
    return kl_words(part("en"), part("fr"), c.class_words.select("word"), 0.5).select(F.round("kl", 6).alias("kl"), F.round("half_js", 6).alias("half_js"))


@query("C22_method_registry", "select unnest(['bernoulli', 'crossentropy', 'evi', 'kl', 'knn', 'naivebayes', 'nbshrinkage', 'nbsimple', 'prind', 'tfidf', 'tfidf_log_occur', 'tfidf_log_words', 'tfidf_words']) as method")
def c22(spark, sf):
    return spark.createDataFrame([(m,) for m in K.METHODS], "method string")


# Evaluation

_PRED = f"nb as ({_nb(*_LAP)}), pred as (select doc_id, nb.class as predicted, score, docs.class as actual from nb join docs using (doc_id) qualify row_number() over (partition by doc_id order by score desc, nb.class) = 1)"


def _scores(c):
    return K.naive_bayes(c).withColumn("score", r6("score"))


@query("E7_test_trial", f"with {DOCS}, {_PRED} select doc_id, actual, predicted, score from pred")
def e7(spark, sf):
    c = corpus(spark, sf)
    return E.predictions(_scores(c), c.docs).drop("trial")


TRIALS = 3


def _trial_sql(k: int) -> str:
    """Scores of one trial: the test documents are a share of each class by md5, words of one training document are left out."""
    tags = (
        f"rk as (select doc_id, lang as class, row_number() over (partition by lang order by md5(doc_id::varchar || ':{k}'), doc_id) as k, count(*) over (partition by lang) as size, count(*) over () as alln from documents), "
        "cl as (select class, any_value(size) as size, any_value(alln) as alln from rk group by 1), qb as (select class, size, floor(size * floor(alln * 0.3 + 0.5) / alln) as base, floor(alln * 0.3 + 0.5) as want from cl), "
        "qs as (select *, sum((base < size)::int) over (order by class) as kk, want - sum(base) over () as spare from qb), qt as (select class, base + case when base < size and kk <= spare then 1 else 0 end as quota from qs), "
        "docs as (select doc_id, class, case when k <= quota then 'test' else 'train' end as tag from rk join qt using (class))"
    )
    sql = _nb(*_LAP).replace(DOCS, tags).replace("lower(x)) as ws from docs)", "lower(x)) as ws from docs join documents using (doc_id))")
    return sql.replace(", tf as (select doc_id, class, tag, word, count(*) as n from tok group by all)", ", tf0 as (select doc_id, class, tag, word, count(*) as n from tok group by all), tf as (select * from tf0 where word in (select word from tf0 where tag = 'train' group by 1 having count(*) >= 2))")


_TRIALS = "sc as (" + " union all ".join(f"select {k} as trial, * from ({_trial_sql(k)})" for k in range(TRIALS)) + "), rk as (select *, row_number() over (partition by trial, doc_id order by score desc, class) as rank from sc), pred as (select trial, doc_id, lang as actual, rk.class as predicted, score from rk join documents using (doc_id) where rank = 1)"


def _trials(spark, sf):
    from quern.operators.trials import trials

    c = corpus(spark, sf)
    return c, trials(c, TRIALS)


@query("E7_trials", f"with {_TRIALS} select trial, doc_id, actual, predicted, score from pred")
def e7t(spark, sf):
    from quern.operators.trials import trial_predictions

    c, scored = _trials(spark, sf)
    return trial_predictions(scored, c.docs)


@query("E7_trial_lines", f"with {_TRIALS} select distinct trial, (-1)::bigint as number, '#' || trial as line from sc union all select trial, doc_id, doc_id || ' ' || any_value(lang) || ' ' || string_agg(rk.class || ':' || printf('%.6f', score), ' ' order by rank) from rk join documents using (doc_id) group by 1, 2")
def e7l(spark, sf):
    from quern.operators.trials import trial_lines

    c, scored = _trials(spark, sf)
    return trial_lines(scored, c.docs)


@query("E8_accuracy", f"with {_TRIALS}, t as (select trial, 100 * avg((actual = predicted)::int) as a from pred group by 1) select count(*) as trials, round(avg(a), 6) as mean, round(stddev_pop(a) / sqrt(count(*)), 6) as stderr from t")
def e8(spark, sf):
    from quern.operators.trials import trial_predictions

    c, scored = _trials(spark, sf)
    return E.accuracy_summary(trial_predictions(scored, c.docs)).select("trials", F.round("mean", 6).alias("mean"), F.round("stderr", 6).alias("stderr"))


@query("E8_confusion", f"with {DOCS}, {_PRED} select actual, predicted, count(*) as n from pred group by 1, 2")
def e8c(spark, sf):
    c = corpus(spark, sf)
    return E.confusion(E.predictions(_scores(c), c.docs))


_PR = f"with {DOCS}, {_ROCCHIO[5:]}, st as (select round(round(score, 6) + 0, 9) as score, sum((docs.class = 'fr')::int) as hits, count(*) as n from sc join docs using (doc_id) where sc.class = 'fr' group by 1), cu as (select score, sum(hits) over w as tp, sum(n) over w as seen, sum(hits) over () as pos from st window w as (order by score desc rows unbounded preceding))".replace(f"{DOCS}, {DOCS}", DOCS)


@query("E9_precision_recall", f"{_PR} select score, tp::bigint as tp, seen::bigint as seen, round(tp / seen, 6) as precision, round(tp / pos, 6) as recall from cu")
def e9(spark, sf):
    c = corpus(spark, sf)
    return E.precision_recall(K.rocchio(c).withColumn("score", r6("score")), c.docs, "fr").select("score", "tp", "seen", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("E11_break_even", f"{_PR} select round(max(least(tp / seen, tp / pos)), 6) as break_even from cu")
def e11(spark, sf):
    c = corpus(spark, sf)
    return E.break_even(E.precision_recall(K.rocchio(c).withColumn("score", r6("score")), c.docs, "fr")).withColumn("break_even", F.round("break_even", 6))


_BEST = "best as (select doc_id, sc.class as predicted, round(score, 6) + 0 as score, docs.class as actual from sc join docs using (doc_id) qualify row_number() over (partition by doc_id order by round(score, 6) desc, sc.class) = 1)"


@query("E10_accuracy_coverage", f"{_ROCCHIO}, {_BEST}, st as (select round(score, 9) as score, sum((actual = predicted)::int) as hits, count(*) as n from best group by 1) select score, round(sum(n) over w / sum(n) over (), 6) as coverage, round(sum(hits) over w / sum(n) over w, 6) as accuracy from st window w as (order by score desc rows unbounded preceding)")
def e10(spark, sf):
    c = corpus(spark, sf)
    return E.accuracy_coverage(E.predictions(K.rocchio(c).withColumn("score", r6("score")), c.docs)).select("score", F.round("coverage", 6).alias("coverage"), F.round("accuracy", 6).alias("accuracy"))


@query("E12_rank_histogram", f"{_ROCCHIO}, rk as (select doc_id, sc.class, row_number() over (partition by doc_id order by round(score, 6) desc, sc.class) as rank from sc), h as (select rank, count(*) as n from rk join docs using (doc_id, class) group by 1) select rank, n, round(sum(n) over (order by rank) / sum(n) over (), 6) as share, round(n / rank / sum(n) over (), 6) as inverse from h")
def e12(spark, sf):
    c = corpus(spark, sf)
    return E.rank_histogram(K.rocchio(c).withColumn("score", r6("score")), c.docs).select("rank", "n", F.round("share", 6).alias("share"), F.round("inverse", 6).alias("inverse"))


@query("E13_query_classes", f"with {CLASSES}, b0 as (select item_id, lower(unnest(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) between 2 and 99))) as word from benchmark), b as (select item_id, word, count(*) as n from b0 semi join cw using (word) group by 1, 2), s as (select item_id, cs.class, any_value(ln(prior)) + sum(b.n * ln((coalesce(c.n, 0) + 1) / (word_count + v))) as s from b cross join cs cross join v left join ctf c on c.word = b.word and c.class = cs.class group by 1, 2) select item_id, class from s qualify row_number() over (partition by item_id order by round(s, 6) desc, class) = 1")
def e13(spark, sf):
    from quern.streaming.score import NaiveBayesModel

    model = NaiveBayesModel.fit(corpus(spark, sf))
    return model.best(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("item_id"), "class")


@query("E1_log_odds", f"with {CLASSES}, x as (select class, word, round((n + 1) / (word_count + v) * ln(((n + 1) / (word_count + v)) / ((total - n + 1) / (alln - word_count + v))), 9) as lor from ctf join cs using (class) join cw using (word), v) select class, word, lor from x where lor > 0 qualify row_number() over (partition by class order by lor desc, word) <= 20")
def e1(spark, sf):
    return E.log_odds(corpus(spark, sf), 20)


@query("E2_odds_ratio", f"with {CLASSES}, g as (select cw.word, cs.class, c.n is not null as seen, (coalesce(c.n, 0) + 1) / (word_count + v) as p from cw cross join cs cross join v left join ctf c on c.word = cw.word and c.class = cs.class), o as (select *, round(p / (sum(p) over (partition by word) - p), 6) as odds from g) select class, word, odds from o where seen qualify row_number() over (partition by class order by odds desc, word) <= 20")
def e2(spark, sf):
    return E.odds_ratio(corpus(spark, sf), 20)


@query("E3_word_probabilities", f"with {CLASSES} select class, word, n, round((n + 1) / (word_count + v), 9) as p from ctf join cs using (class), v")
def e3(spark, sf):
    c = corpus(spark, sf)
    return K.smoothed(c)[0].join(c.class_tf.select("class", "word", "n"), ["class", "word"]).select("class", "word", "n", F.round("p", 9).alias("p"))


@query("E5_word_in_classes", f"with {CLASSES} select cs.class, coalesce(c.n, 0) as n, word_count, round(coalesce(c.n, 0) / word_count, 9) as share from cs left join (select * from ctf where word = 'la') c using (class)")
def e5(spark, sf):
    return E.class_word_counts(corpus(spark, sf), "la").withColumn("share", F.round("share", 9))


@query("E6_names_by_tag", f"with {DOCS} select doc_id from docs where tag = 'test'")
def e6(spark, sf):
    return corpus(spark, sf).docs.where("tag = 'test'").select("doc_id")


# Retrieval

_QTF = "q0 as (select item_id, lower(unnest(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) between 2 and 99))) as word from benchmark), qtf as (select item_id, word, count(*) as n from q0 group by 1, 2)"
_RANK = f"with {TF}, {_IDF}, {_QTF}, ix as (select doc_id, word, weight / s as w from (select *, sqrt(sum(weight * weight) over (partition by doc_id)) as s from wt) where s <> 0), qw as (select item_id, word, ln(n + 1) * idf as w from qtf join idf using (word)), qn as (select item_id, word, w / s as w from (select *, sqrt(sum(w * w) over (partition by item_id)) as s from qw) where s <> 0), rk as (select item_id as query_id, doc_id, round(sum(qn.w * ix.w), 9) as score, string_agg(word, ' ' order by word) as words from qn join ix using (word) group by 1, 2), best as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from rk)"


def _asked(spark, sf):
    return tokens(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query("R2_ranked_query", f"{_RANK} select query_id, doc_id, round(score, 6) + 0 as score, words, rank from best where rank <= 10")
def r2(spark, sf):
    c = corpus(spark, sf)
    return R.ranked_query(c.tf, c.docs, _asked(spark, sf), 10).withColumn("score", r6("score"))


@query("R3_rank_of_document", f"{_RANK} select query_id, rank - 1 as rank from best where doc_id = 7")
def r3(spark, sf):
    c = corpus(spark, sf)
    return R.ranked_query(c.tf, c.docs, _asked(spark, sf), 1 << 30).where("doc_id = 7").select("query_id", (F.col("rank") - 1).alias("rank"))


@query("R1_tfidf_index", f"with {TF}, {_IDF} select doc_id, word, round(weight / s, 6) + 0 as weight from (select *, sqrt(sum(weight * weight) over (partition by doc_id)) as s from wt) where s <> 0")
def r1(spark, sf):
    c = corpus(spark, sf)
    return W.normalise(W.tfidf(c.tf, c.docs)).select("doc_id", "word", r6("weight").alias("weight"))


@query("R4_compare", f"with {TF}, nn as (select doc_id, sqrt(sum(n * n)) as s from tf group by 1) select a.doc_id as a, b.doc_id as b, round(sum(a.n * b.n) / any_value(x.s * y.s), 6) + 0 as cosine from tf a join tf b on b.word = a.word and b.doc_id = a.doc_id + 1 join nn x on x.doc_id = a.doc_id join nn y on y.doc_id = b.doc_id group by 1, 2")
def r4(spark, sf):
    c = corpus(spark, sf)
    pairs = c.docs.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return R.compare(c.tf, pairs).withColumn("cosine", r6("cosine"))


@query("R5_idf", f"with {TF}, {_IDF} select word, round(idf, 6) + 0 as idf from idf")
def r5(spark, sf):
    c = corpus(spark, sf)
    return W.idf(c.tf, c.docs).withColumn("idf", r6("idf"))


@query("R6_term_hits", f"with {_POST} select doc_id, count(*) as tf from post where word = 'the' group by 1")
def r6_hits(spark, sf):
    return R.term_hits(R.postings(table(spark, sf)), ("the",)).select("doc_id", "tf")


_PHRASE = "ph as (select a.doc_id, count(*) as tf from post a join post b on b.doc_id = a.doc_id and b.pos = a.pos + 1 where a.word = 'of' and b.word = 'the' group by 1)"


@query("R7_phrase", f"with {_POST}, {_PHRASE} select doc_id, tf from ph")
def r7(spark, sf):
    return R.term_hits(R.postings(table(spark, sf)), ("of", "the")).select("doc_id", "tf")


@query("R8_term_score", f"with {_POST}, {_PHRASE} select doc_id, round(ln(5 + tf) / ln(5 + (select count(*) from ph)), 6) as score from ph")
def r8(spark, sf):
    return R.term_hits(R.postings(table(spark, sf)), ("of", "the")).select("doc_id", F.round("score", 6).alias("score"))


_TERM = "select doc_id, count(*) as tf, ln(5 + count(*)) / ln(5 + (select count(distinct doc_id) from post where word = '{w}')) as s from post where word = '{w}' group by 1"


@query("R9_boolean", f"with {_POST}, a as ({_TERM.format(w='eren')}), b as ({_TERM.format(w='tion')}), x as (select distinct doc_id from post where word = 'les'), sc as (select a.doc_id, round(a.s + coalesce(b.s, 0), 9) as score from a left join b using (doc_id) anti join x using (doc_id)) select doc_id, round(score, 6) as score from sc order by round(score, 9) desc, doc_id limit 100")
def r9(spark, sf):
    return R.boolean_query(R.postings(table(spark, sf)), "+eren tion -les", 100).select("doc_id", F.round("score", 6).alias("score"))


@query("R10_top_k", f"with {_POST}, a as ({_TERM.format(w='eren')}) select doc_id, round(s, 6) as score from a order by round(s, 9) desc, doc_id limit 10")
def r10(spark, sf):
    return R.boolean_query(R.postings(table(spark, sf)), "eren", 10).select("doc_id", F.round("score", 6).alias("score"))


@query("R11_deleted", f"with {_POST} select doc_id, count(*) as tf from post where word = 'eren' and doc_id % 5 <> 0 group by 1")
def r11(spark, sf):
    d = table(spark, sf)
    kept = R.delete_documents(d, d.where("doc_id % 5 = 0")).where("not deleted")
    return R.term_hits(R.postings(kept), ("eren",)).select("doc_id", "tf")


@query("R12_postings_dump", f"with {_POST} select word, string_agg(doc_id || ':' || pos, ' ' order by doc_id, pos) as places from post group by 1")
def r12(spark, sf):
    p = R.postings(table(spark, sf))
    return p.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "pos"))), lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["pos"].cast("string"))), " ").alias("places"))


# Set operations on scored lists

_LISTS = f"with {_POST}, a as (select doc_id as key, count(*)::double as score from post where word = 'eren' group by 1), b as (select doc_id as key, count(*)::double as score from post where word = 'tion' group by 1)"


def _lists(spark, sf):
    p = R.postings(table(spark, sf))
    one = lambda w: R.term_hits(p, (w,), compat_counts=True).select(F.col("doc_id").alias("key"), "score")
    return one("eren"), one("tion")


for _name, _f, _sql in (
    ("U1_union", U.union, "select key, sum(score) as score from (select * from a union all select * from b) group by 1"),
    ("U2_intersection", U.intersection, "select key, a.score + b.score as score from a join b using (key)"),
    ("U3_overlay", U.overlay, "select key, a.score + coalesce(b.score, 0) as score from a left join b using (key)"),
    ("U4_difference", U.difference, "select key, score from a anti join b using (key)"),
    ("U5_append", lambda a, b: U.append(U.remove(a, 7), 7, 2.0), "select key, score from a where key <> 7 union all select 7, 2.0"),
    ("U6_sorted", lambda a, b: U.top(a, 25), "select key, score from a order by score desc, key limit 25"),
):

    def _u(spark, sf, _f=_f):
        return _f(*_lists(spark, sf))

    query(_name, f"{_LISTS} {_sql}")(_u)


@query("U7_vector_sum", f"with {TF} select word, sum(n)::bigint as n from tf group by 1")
def u7(spark, sf):
    tf = corpus(spark, sf).tf
    one = lambda k: tf.where(F.col("doc_id") % 2 == k).groupBy("word").agg(F.sum("n").alias("n"))
    return U.vector_sum(one(0), one(1))


@query("U8_vector_print", f"with {TF} select doc_id, string_agg('(' || word || ', ' || n || ')', ' ' order by word) as line from tf group by 1")
def u8(spark, sf):
    return U.printed(corpus(spark, sf).tf)
