"""Iterative learners, hierarchies, generators and archives as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions.lineage import stored
from quern.functions.portable import normal_sql, uniform_sql
from quern.operators import classify as K
from quern.operators import iterate as M
from quern.operators import svm as V
from quern.operators import tree as T
from quern.operators import weight as W
from quern.operators.corpus import Corpus, vocabulary
from quern.plans.catalogue import CLASSES, DOCS, ORACLE_SQL, TF, corpus, query, r6, softmax_sql, table
from quern.plans.classes import _LAP, _nb
from quern.sources import files as I


def _maxent_sql(rounds: int) -> str:
    parts = [f"with {CLASSES}, x as materialized (select doc_id, class as own, tag, word, n / sum(n) over (partition by doc_id) as x from tf), xr as materialized (select * from x where tag = 'train'), tg as materialized (select own as class, word, sum(x) as k from xr group by 1, 2), w0 as materialized (select class, word, k, 0.0::double as w from tg)"]
    score = "select doc_id, class, e / sum(e) over (partition by doc_id) as p from (select doc_id, class, exp(s - max(s) over (partition by doc_id)) as e from (select d.doc_id, c.class, coalesce(sum(x.x * w.w), 0) as s from (select distinct doc_id from {x}) d cross join (select distinct class from cs) c left join {x} x on x.doc_id = d.doc_id left join w{k} w on w.word = x.word and w.class = c.class group by 1, 2))"
    for k in range(rounds):
        parts.append(f"p{k} as materialized ({score.format(x='xr', k=k)}), e{k} as materialized (select p.class, word, sum(x * p) as e from xr join p{k} p using (doc_id) group by 1, 2), w{k + 1} as materialized (select class, word, k, w + ln(k / e) as w from w{k} join e{k} using (class, word))")
    parts.append(f"xt as materialized (select x.* from x where tag = 'test'), dt as (select doc_id from docs where tag = 'test'), sc as ({score.format(x='xt', k=rounds)})")
    return ", ".join(parts) + " select dt.doc_id, c.class, round(coalesce(sc.p, 1 / (select count(*) from cs)), 6) + 0 as score from dt cross join cs c left join sc on sc.doc_id = dt.doc_id and sc.class = c.class"


@query("C9_maxent", _maxent_sql(5))
def c9(spark, sf):
    c = corpus(spark, sf)
    return M.maxent_classify(c, M.maxent(c, 5)).withColumn("score", r6("score"))


def _vectors(c):
    """TF-IDF vectors of length 1; training and scoring read them, so they are stored."""
    return stored(W.normalise(W.tfidf(c.tf, c.docs)), "vectors")


@query("C10_svm_train")
def c10(spark, sf):
    c = corpus(spark, sf)
    return V.train_pairwise(_vectors(c), c.docs)


@query("C12_svm_vote")
def c12(spark, sf):
    c = corpus(spark, sf)
    w = _vectors(c)
    return V.vote(w, c.docs, V.train_pairwise(w, c.docs)).withColumn("score", r6("score"))


_LABEL = "kn as (select doc_id, c.class, (d.class = c.class)::double as p from docs d, (select distinct class from docs where tag = 'train') c where tag = 'train')"


def _soft(n: str, probs: str, temper: float = 1.0) -> str:
    """CTEs of a soft model and its scores of the test documents."""
    return (
        f"cell{n} as (select p.class, word, sum(n * p) as n from tf join {probs} p using (doc_id) group by 1, 2), sz{n} as (select class, sum(n) as size from cell{n} group by 1), pr{n} as (select class, (1 + s) / (count(*) over () + sum(s) over ()) as prior from (select class, sum(p) as s from {probs} group by 1)), "
        f"lg{n} as (select t.doc_id, z.class, any_value(ln(prior)) + coalesce(sum(t.n * ln((coalesce(c.n, 0) + 1) / (size + vv))), 0) as log_score from (select * from tf where tag = 'test') t cross join sz{n} z cross join vv left join cell{n} c on c.word = t.word and c.class = z.class join pr{n} on pr{n}.class = z.class group by 1, 2), "
        f"gs{n} as (select doc_id, class, e / sum(e) over (partition by doc_id) as p from (select doc_id, class, exp((log_score - max(log_score) over (partition by doc_id)) / {temper}) as e from lg{n}))"
    ).replace(" as (select", " as materialized (select")


def _em_sql(rounds: int, anneal: float = 1.0, even: bool = False) -> str:
    first = "gs0 as materialized (select doc_id, class, 1 / count(*) over (partition by doc_id) as p from (select doc_id from docs where tag = 'test') cross join (select distinct class from docs where tag = 'train'))" if even else _soft("0", "kn")
    parts, temper = [f"with {TF}, {_LABEL}, vv as (select count(distinct word) as vv from tf), {first}"], anneal
    for k in range(1, rounds + 1):
        parts.append(f"pb{k} as materialized (select * from kn union all select * from gs{k - 1}), {_soft(str(k), f'pb{k}', temper)}")
        temper = max(1.0, temper * 0.9)
    return ", ".join(parts) + f" select doc_id, class, round(p, 6) + 0 as score from gs{rounds}"


@query(
    "C14_em_one_round",
    f"with {TF}, {_LABEL}, vv as (select count(distinct word) as vv from tf), {_soft('0', 'kn')}, pb as (select * from kn union all select * from gs0), {_soft('1', 'pb')} select doc_id, class, round(p, 6) + 0 as score from gs1",
)
def c14(spark, sf):
    return M.em(corpus(spark, sf), rounds=1).withColumn("score", r6("score"))


@query("C14_em", _em_sql(5, 2.0))
def c14e(spark, sf):
    return M.em(corpus(spark, sf), rounds=5, anneal=2.0).withColumn("score", r6("score"))


@query("C17_emsimple", _em_sql(3, even=True))
def c17(spark, sf):
    return M.em(corpus(spark, sf), rounds=3, start="even", hard=False).withColumn("score", r6("score"))


@query("C14_perplexity", f"with {TF}, {_LABEL}, vv as (select count(distinct word) as vv from tf), {_soft('0', 'kn')}, m as (select doc_id, max(log_score) + ln(sum(exp(log_score - top))) as l from (select *, max(log_score) over (partition by doc_id) as top from lg0) group by 1), s as (select doc_id, sum(n) as total from tf where tag = 'test' group by 1) select round(exp(-sum(l) / sum(total)), 4) as perplexity from m join s using (doc_id)")
def c14p(spark, sf):
    c = corpus(spark, sf)
    cells, classes = M.soft_model(c.tf, M.hard_labels(c.docs.where("tag = 'train'")))
    return M.perplexity(c.tf, c.docs.where("tag = 'test'"), cells, classes).select(F.round("perplexity", 4).alias("perplexity"))


_KEY = "class || ':' || word"


@query("C15_perturbed_counts", f"with {CLASSES} select class, word, round(greatest(n + {normal_sql(_KEY, 1)} * sqrt(word_count * (n / word_count) * (1 - n / word_count)), 0), 6) + 0 as n from ctf join cs using (class)")
def c15(spark, sf):
    return M.perturbed_counts(corpus(spark, sf)).withColumn("n", r6("n"))


_TRY = "case when power(1 + z{k} / sqrt(9 * d), 3) > 0 and ln(u{k}) < 0.5 * z{k} * z{k} + d - d * power(1 + z{k} / sqrt(9 * d), 3) + d * ln(greatest(power(1 + z{k} / sqrt(9 * d), 3), 1e-300)) then d * power(1 + z{k} / sqrt(9 * d), 3) else {other} end"
_GAMMA = "d"
for _k in (3, 2, 1, 0):
    _GAMMA = _TRY.format(k=_k, other=_GAMMA)


@query("C15_gamma_counts", f"with {CLASSES}, z as (select class, word, n - 1 / 3 as d, " + ", ".join(f"{normal_sql(_KEY, f'1g{k}')} as z{k}, {uniform_sql(_KEY, f'1u{k}')} as u{k}" for k in range(4)) + f" from ctf) select class, word, round({_GAMMA}, 6) + 0 as n from z")
def c15g(spark, sf):
    return M.perturbed_counts(corpus(spark, sf), "gamma").withColumn("n", r6("n"))


@query("C16_word_distribution", f"with {CLASSES}, x as (select class, word, round((n + 1) / (word_count + v), 9) as p from ctf join cs using (class), v) select class, word, p from x qualify row_number() over (partition by class order by p desc, word) <= 15")
def c16(spark, sf):
    from pyspark.sql import Window

    p = K.smoothed(corpus(spark, sf))[0].withColumn("p", F.round("p", 9))
    return p.withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("p"), "word"))).where("k <= 15").drop("k")


@query("C16_log_odds", f"with {TF}, {_LABEL}, vv as (select count(distinct word) as vv from tf), {_soft('0', 'kn')}, al as (select sum(size) as al from sz0), tw as (select word, sum(n) as tw from cell0 group by 1), x as (select c.class, c.word, (c.n + 1) / (size + vv) as p, (tw - c.n + 1) / (al - size + vv) as q from cell0 c join sz0 using (class) join tw using (word), vv, al where c.n > 0), y as (select class, word, round(p * ln(p / q), 9) as lor from x) select class, word, lor from y qualify row_number() over (partition by class order by lor desc, word) <= 10")
def c16o(spark, sf):
    c = corpus(spark, sf)
    return M.soft_log_odds(*M.soft_model(c.tf, M.hard_labels(c.docs.where("tag = 'train'"))), 10)


@query("C18_active_learning")
def c18(spark, sf):
    c = corpus(spark, sf)
    start = Corpus(c.docs.withColumn("tag", F.when(F.col("tag") == "test", "test").when(F.col("doc_id") % 10 < 2, "train").otherwise("pool")), c.tf)
    learned = M.active_learn(start, rounds=2, each=20, pool="pool")
    return learned.docs.groupBy("tag").agg(F.count("*").alias("n"))


_TEMPERED = _nb(*_LAP, divisor="(coalesce(size, 0) + 1) / 7")


def _tempered(spark, sf):
    return K.naive_bayes(corpus(spark, sf), temper="anneal").withColumn("score", r6("score"))


@query("C19_select_uncertain", f"with nb as ({_TEMPERED}) select doc_id from nb group by 1 order by max(score), doc_id limit 30")
def c19u(spark, sf):
    return M.select_uncertain(_tempered(spark, sf), 30)


@query("C19_select_relevant", f"with nb as ({_TEMPERED}) select doc_id from nb group by 1 order by max(score) desc, doc_id limit 30")
def c19r(spark, sf):
    return M.select_relevant(_tempered(spark, sf), 30)


@query("C19_select_longest", f"with {TF} select doc_id from tf where tag = 'test' group by 1 order by sum(n) desc, doc_id limit 30")
def c19l(spark, sf):
    c = corpus(spark, sf)
    return M.select_longest(c.tf, c.docs.where("tag = 'test'"), 30)


@query("C19_select_random", f"with {DOCS} select doc_id from docs where tag = 'test' order by {uniform_sql('doc_id::varchar', 1)}, doc_id limit 30")
def c19x(spark, sf):
    return M.select_random(corpus(spark, sf).docs.where("tag = 'test'"), 30)


@query(
    "C19_committee",
    f"with a as ({_TEMPERED}), b as ({_nb('c.n / (word_count + n_unique)', 'n_unique / ((word_count + n_unique) * (v - n_unique))', divisor='(coalesce(size, 0) + 1) / 7')}), m as (select *, 0 as k from a union all select *, 1 as k from b), d as (select *, avg(score) over (partition by doc_id, class) as mean from m), kl as (select doc_id, sum(case when score > 0 then score * ln(score / mean) else 0 end) / 2 as kl from d group by 1), "
    "v as (select doc_id, class, count(*) / 2 as p from (select * from m qualify row_number() over (partition by doc_id, k order by score desc, class) = 1) group by 1, 2), e as (select doc_id, sum(-p * ln(p)) as vote_entropy from v group by 1) select doc_id, round(kl, 6) + 0 as kl, round(vote_entropy, 6) + 0 as vote_entropy from kl join e using (doc_id)",
)
def c19c(spark, sf):
    c = corpus(spark, sf)
    members = [K.naive_bayes(c, m, temper="anneal").withColumn("score", r6("score")) for m in ("laplace", "witten_bell")]
    return M.committee_disagreement(members).select("doc_id", r6("kl").alias("kl"), r6("vote_entropy").alias("vote_entropy"))


def _voices(spark, sf):
    c = corpus(spark, sf)
    return c, [K.naive_bayes(c, m, temper="anneal").withColumn("score", r6("score")) for m in ("laplace", "witten_bell")]


_TWO = f"a as ({_TEMPERED}), b as ({_nb('c.n / (word_count + n_unique)', 'n_unique / ((word_count + n_unique) * (v - n_unique))', divisor='(coalesce(size, 0) + 1) / 7')}), m as (select *, 0 as k from a union all select *, 1 as k from b), d as (select *, avg(score) over (partition by doc_id, class) as mean from m), kl as (select doc_id, sum(case when score > 0 then score * ln(score / mean) else 0 end) / 2 as kl from d group by 1), vt as (select doc_id, class, count(*) / 2 as p from (select * from m qualify row_number() over (partition by doc_id, k order by score desc, class) = 1) group by 1, 2), ve as (select doc_id, sum(-p * ln(p)) as ve from vt group by 1)"
for _kind, _sql in (
    ("qbc", "select doc_id, kl as s from kl"),
    ("ve", "select doc_id, ve as s from ve"),
    ("wkl", "select doc_id, kl * (1 + doc_id % 3) as s from kl"),
    ("dkl", "select a.doc_id, sum(case when a.score > 0 then a.score * ln(a.score / greatest(b.score, 1e-12)) else 0 end) as s from a join b using (doc_id, class) group by 1"),
    ("skl", "select doc_id, kl / (1 + kl) as s from kl"),
    ("sve", "select doc_id, ve / ln(2) as s from ve"),
):

    def _c19d(spark, sf, _kind=_kind):
        c, voices = _voices(spark, sf)
        scores = M.disagreement(voices, _kind, c.docs.select("doc_id", (1 + F.col("doc_id") % 3).alias("weight"))).withColumn("score", r6("score"))
        return M.stream_select(scores, 5) if _kind.startswith("s") else M.select_disagreed(scores, 30)

    _keep = f"where s > {uniform_sql('doc_id::varchar', 5)}" if _kind.startswith("s") else "order by s desc, doc_id limit 30"
    query(f"C19_select_{_kind}", f"with {_TWO}, sc as ({_sql}), rd as (select doc_id, round(s, 6) + 0 as s from sc) select doc_id from rd {_keep}")(_c19d)


@query("C18_committee")
def c18c(spark, sf):
    return M.committee_disagreement(M.committee(corpus(spark, sf), 3)).select("doc_id", r6("kl").alias("kl"), r6("vote_entropy").alias("vote_entropy"))


@query("C18_remapped_scores", f"with nb as ({_TEMPERED}), o as (select doc_id, score, least(floor(score * 20), 19)::int as step from nb where class = 'fr'), h as (select step, sum((docs.lang = 'fr')::int) as hit, count(*) as n from o join documents docs using (doc_id) group by 1), c as (select step, sum(hit) over w / sum(n) over w as pr from h window w as (order by step desc)), d as (select step, max(pr) over (order by step) as pr from c) select doc_id, round(pr, 6) + 0 as score from o join d using (step)")
def c18r(spark, sf):
    c = corpus(spark, sf)
    return M.remap_scores(_tempered(spark, sf), c.docs, "fr").withColumn("score", r6("score"))


@query("C13_transduction")
def c13t(spark, sf):
    c = corpus(spark, sf)
    return V.transduce_pairwise(W.normalise(W.tfidf(c.tf, c.docs)), c.docs, most=60)


@query("C13_active")
def c13a(spark, sf):
    c = corpus(spark, sf)
    return V.active_rounds(_vectors(c), c.docs, rounds=2, each=20)


@query("C13_without_bound")
def c13b(spark, sf):
    c = corpus(spark, sf)
    return V.train_pairwise(_vectors(c), c.docs, c=10.0, drop_bound=True)


@query("C13_break_even")
def c13e(spark, sf):
    from quern.operators import evaluate as E

    c = corpus(spark, sf)
    w = _vectors(c)
    return E.break_even(E.precision_recall(V.vote(w, c.docs, V.train_pairwise(w, c.docs)).withColumn("score", r6("score")), c.docs, "fr"))


@query("C20_document_entropy", f"with nb as ({_TEMPERED}) select doc_id, round(sum(case when score > 0 then -score * ln(score) else 0 end), 6) + 0 as entropy from nb group by 1")
def c20(spark, sf):
    return M.uncertainty(_tempered(spark, sf)).withColumn("entropy", r6("entropy"))


@query(
    "C20_density",
    f"with {TF}, sh as (select doc_id, word, n, n / sum(n) over (partition by doc_id) as p from tf), w as (select word, sum(p) / (select count(*) from docs) as m, sum(n) / sum(sum(n)) over () as pw from sh group by 1), base as (select sum(m * ln(0.5 * pw)) as base from w), h as (select avg(h) as h from (select sum(p * ln(p)) as h from sh group by doc_id)), x as (select doc_id, sum(m * (ln(0.5 * p + 0.5 * pw) - ln(0.5 * pw))) as extra from sh join w using (word) group by 1) select doc_id, round(exp(-0.1 * (h - base - extra)), 6) as density from x, base, h",
)
def c20d(spark, sf):
    c = corpus(spark, sf)
    return M.density(c, c.docs, beta=0.1).select("doc_id", F.round("density", 6).alias("density"))


# Hierarchies: root > language > source group

_PATH = "lang || '/' || (doc_id % 3)"


def _leaves(spark, sf):
    return table(spark, sf).select("doc_id", F.concat_ws("/", "lang", (F.col("doc_id") % 3).cast("string")).alias("path"))


@query("H1_nodes", f"with recursive l as (select distinct {_PATH} as path from documents), t as (select path as node, case when path like '%/%' then regexp_replace(path, '/[^/]*$', '') else '' end as parent from l union select parent, case when parent like '%/%' then regexp_replace(parent, '/[^/]*$', '') when parent = '' then null else '' end from t where node <> '') select node, parent, (case when node = '' then 0 else length(node) - length(replace(node, '/', '')) + 1 end)::int as depth from t")
def h1(spark, sf):
    return T.nodes(_leaves(spark, sf))


_HTF = TF + f", lf as (select doc_id, {_PATH} as leaf from documents), ltf as (select leaf, word, sum(n)::bigint as n from tf join lf using (doc_id) where tag = 'train' group by 1, 2), anc as (select distinct leaf, leaf as node, 0 as level from lf union all select distinct leaf, regexp_replace(leaf, '/[^/]*$', ''), 1 from lf union all select distinct leaf, '', 2 from lf), nw as (select node, word, sum(n) as n from ltf join anc using (leaf) group by 1, 2), np as (select node, word, n, n / sum(n) over (partition by node) as p from nw)"


def _tree(spark, sf):
    c = corpus(spark, sf)
    leaves = _leaves(spark, sf)
    leaf_tf = c.train.join(leaves, "doc_id").groupBy(F.col("path").alias("leaf"), "word").agg(F.sum("n").alias("n"))
    anc = T.ancestors(leaves)
    return c, T.nodes(leaves), anc, T.node_words(leaf_tf, anc)


@query("H2_node_words", f"with {_HTF} select node, word, n::bigint as n, round(p, 9) as p from np")
def h2(spark, sf):
    return _tree(spark, sf)[3].withColumn("p", F.round("p", 9))


_LAM = {0: 0.5, 1: 0.2, 2: 0.2, -1: 0.1}
_MIX = f"{_HTF}, tv as (select count(*) as tv from np where node = ''), mx as (select leaf, word, sum(p * case level when 0 then 0.5 else 0.2 end) + 0.1 / any_value(tv) as p from np join anc using (node), tv group by 1, 2), fl as (select distinct leaf from anc)"


def _mixture(spark, sf):
    c, tree, anc, words = _tree(spark, sf)
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(x).alias("lambda")) for k, x in _LAM.items()])).alias("s")
    lambdas = anc.select("leaf").distinct().select("leaf", level).select("leaf", "s.level", "s.lambda")
    v = words.where("node = ''").agg(F.count("*").alias("v"))
    p = T.shrunk(words, anc, lambdas, v)
    unseen = anc.select("leaf").distinct().crossJoin(F.broadcast(v)).select("leaf", (0.1 / F.col("v")).alias("p0"))
    return c, p, unseen


@query("H3_perturbed_words", f"with {_HTF} select node, word, round(0.9 * p + 0.1 * {uniform_sql("node || ':' || word", 1)} / tv, 12) as p from np, (select count(*) as tv from np where node = '')")
def h3(spark, sf):
    words = _tree(spark, sf)[3]
    return T.perturbed_words(words, words.where("node = ''").agg(F.count("*").alias("v"))).withColumn("p", F.round("p", 12))


@query("H4_shrinkage", f"with {_MIX} select leaf, word, round(p, 9) as p from mx")
def h4(spark, sf):
    return _mixture(spark, sf)[1].withColumn("p", F.round("p", 9))


_LOGS = f"{_MIX}, ts as (select doc_id, word, n from tf where tag = 'test'), lg as (select doc_id, fl.leaf, sum(n) as total, sum(n * ln(coalesce(mx.p, 0.1 / tv))) as log_prob from ts cross join fl cross join tv left join mx on mx.word = ts.word and mx.leaf = fl.leaf group by 1, 2)"


def _logs(spark, sf):
    c, p, unseen = _mixture(spark, sf)
    tf = c.tf.join(c.docs.where("tag = 'test'").select("doc_id"), "doc_id", "left_semi")
    return T.leaf_log_probs(tf, p, unseen), unseen.select("leaf", F.lit(1 / 12).alias("prior"))


@query("H5_log_likelihood", f"with {_LOGS} select doc_id, leaf, total::bigint as total, round(log_prob, 4) as log_prob from lg")
def h5(spark, sf):
    return _logs(spark, sf)[0].withColumn("log_prob", F.round("log_prob", 4))


_SIB = "tr as (select distinct node, case when node like '%/%' then regexp_replace(node, '/[^/]*$', '') else '' end as parent from anc where node <> '')"
_TOP = " from x qualify row_number() over (partition by node order by ratio desc, word) <= 10"


def _ratio_sql(family: str, ratio: str, where: str = "true") -> str:
    return f"with {_HTF}, {_SIB}, fa as ({family}), k as (select fam, count(*) as k from fa group by 1), m as (select fam, word, sum(p) as s, count(*) as holders from np join fa using (node) group by 1, 2), x as (select np.node, word, round({ratio}, 9) as ratio from np join fa using (node) join m using (fam, word) join k using (fam) where {where}) select node, word, ratio{_TOP}"


_LEAF = "select distinct leaf as node, 'leaf' as fam from anc"
_Q = "((s - p) / (k - 1))"
for _name, _against, _family, _ratio, _where in (
    ("H6_word_ratios", "siblings", "select node, parent as fam from tr", f"case when holders = 1 then 1 else p * ln(p / {_Q}) end", "true"),
    ("H6_leaf_ratios", "leaves", _LEAF, f"case when holders = 1 then 1 else p * ln(p / {_Q}) end", "true"),
    ("H6_leaf_odds", "odds", _LEAF, f"ln(p * (1 - {_Q}) / ({_Q} * (1 - p)))", "holders > 1 and p < 1"),
    ("H6_leaf_means", "mean", _LEAF, "p * k / s", "true"),
):

    def _h6(spark, sf, _against=_against):
        _, tree, _, words = _tree(spark, sf)
        return T.word_ratios(words, tree, 10, _against)

    query(_name, _ratio_sql(_family, _ratio, _where))(_h6)


@query("H6_keywords", f"with w as ({_ratio_sql('select node, parent as fam from tr', f'case when holders = 1 then 1 else p * ln(p / {_Q}) end')}), t as (select * from w qualify row_number() over (partition by node order by ratio desc, word) <= 5) select node, string_agg(word, ' ' order by ratio desc, word) as words from t group by 1")
def h6k(spark, sf):
    _, tree, _, words = _tree(spark, sf)
    return T.keywords(words, tree)


@query("H6_top_words", f"with {_HTF}, x as (select node, word, round(p, 9) as ratio from np) select node, word, ratio as p{_TOP}")
def h6p(spark, sf):
    from pyspark.sql import Window

    words = _tree(spark, sf)[3].select("node", "word", F.round("p", 9).alias("p"))
    return words.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("p"), "word"))).where("k <= 10").drop("k")


@query("H7_children_divergence", f"with {_HTF}, tr as (select distinct node, case when node like '%/%' then regexp_replace(node, '/[^/]*$', '') else '' end as parent from anc where node <> ''), k as (select parent, count(*) as k from tr group by 1), m as (select parent, word, sum(p) as s from np join tr using (node) group by 1, 2) select parent, round(sum(p * ln(p * k / s)) / any_value(k), 6) as kl from np join tr using (node) join m using (parent, word) join k using (parent) group by 1")
def h7(spark, sf):
    _, tree, _, words = _tree(spark, sf)
    return T.children_divergence(words, tree).withColumn("kl", F.round("kl", 6))


@query("H7_weighted_divergence", f"with {_HTF}, {_SIB}, k as (select parent, count(*) as k from tr group by 1), m as (select parent, word, sum(p) as s from np join tr using (node) group by 1, 2), z as (select parent, sum(n) as size from np join tr using (node) group by 1) select parent, round(sum(p * ln(p * k / s)) / any_value(k), 6) as kl, round(any_value(size) * sum(p * ln(p * k / s)) / any_value(k), 3) as weighted from np join tr using (node) join m using (parent, word) join k using (parent) join z using (parent) group by 1")
def h7w(spark, sf):
    _, tree, _, words = _tree(spark, sf)
    return T.weighted_divergence(words, tree).select("parent", F.round("kl", 6).alias("kl"), F.round("weighted", 3).alias("weighted"))


@query("H7_pair_divergence", f"with {_HTF}, {_SIB}, ab as (select x.node as a, y.node as b from tr x join tr y on x.parent = y.parent and x.node < y.node), z as (select node, sum(n) as size from np group by 1), pq as (select a, b, word, max(case when node = a then p else 0 end) as p, max(case when node = b then p else 0 end) as q from ab join np on np.node = a or np.node = b group by 1, 2, 3), s as (select a, b, sum(case when p > 0 then p * ln(2 * p / (p + q)) else 0 end + case when q > 0 then q * ln(2 * q / (p + q)) else 0 end) / 2 as kl from pq group by 1, 2) select a, b, round(kl, 6) as kl, round(kl * (x.size + y.size), 3) as weighted from s join z x on x.node = a join z y on y.node = b")
def h7p(spark, sf):
    _, tree, _, words = _tree(spark, sf)
    return T.pair_divergence(words, tree).select("a", "b", F.round("kl", 6).alias("kl"), F.round("weighted", 3).alias("weighted"))


@query("H5_node_log_likelihood", f"with {_HTF}, tv as (select count(*) as tv from np where node = ''), z as (select node, sum(n) as size from np group by 1), ts as (select doc_id, word, n from tf where tag = 'test') select doc_id, z.node, sum(ts.n)::bigint as total, round(sum(ts.n * ln((coalesce(np.n, 0) + 1) / (size + tv))), 4) as log_prob from ts cross join z cross join tv left join np on np.word = ts.word and np.node = z.node group by 1, 2")
def h5n(spark, sf):
    c, _, _, words = _tree(spark, sf)
    tf = c.tf.join(c.docs.where("tag = 'test'").select("doc_id"), "doc_id", "left_semi")
    return T.node_log_probs(tf, words, words.where("node = ''").agg(F.count("*").alias("v"))).withColumn("log_prob", F.round("log_prob", 4))


@query("H5_leave_one_out", ORACLE_SQL["M7_leave_one_out"].replace("lang as class", f"{_PATH} as class"))
def h5l(spark, sf):
    docs = table(spark, sf)
    return K.leave_one_out(Corpus.of(docs, F.concat_ws("/", "lang", (F.col("doc_id") % 3).cast("string")), keep=True)).withColumn("score", r6("score"))


def _start(spark, sf):
    """tf, ancestors, priors, lambdas, node words, size of the vocabulary, labels of the training documents."""
    c, _, anc, words = _tree(spark, sf)
    leaves = anc.select("leaf").distinct()
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(x).alias("lambda")) for k, x in _LAM.items()])).alias("s")
    lambdas = leaves.select("leaf", level).select("leaf", "s.level", "s.lambda")
    labels = _leaves(spark, sf).join(c.docs.where("tag = 'train'").select("doc_id"), "doc_id").select("doc_id", F.col("path").alias("leaf"))
    return c.tf, anc, leaves.select("leaf", F.lit(1 / 12).alias("prior")), lambdas, words.select("node", "word", "p"), c.tf.select("word").distinct().count(), labels


@query(
    "H8_em_step",
    f"with {_HTF}, va as materialized (select count(distinct word) as va from tf), e as materialized (select leaf, level, word, p * case level when 0 then 0.5 else 0.2 end as part from np join anc using (node)), mxe as materialized (select leaf, word, sum(part) + 0.1 / any_value(va) as p from e, va group by 1, 2), fl as (select distinct leaf from anc), "
    "lge as materialized (select tf.doc_id, fl.leaf, sum(tf.n * ln(coalesce(mxe.p, 0.1 / va))) + ln(1 / 12) as s from tf cross join fl cross join va left join mxe on mxe.word = tf.word and mxe.leaf = fl.leaf group by 1, 2), po as materialized (select doc_id, leaf, e / sum(e) over (partition by doc_id) as r from (select *, exp(s - max(s) over (partition by doc_id)) as e from lge)), tr as (select doc_id, lf.leaf from lf join docs using (doc_id) where tag = 'train'), "
    "ps as materialized (select * from po where doc_id not in (select doc_id from tr) and r > 1e-9 union all select doc_id, leaf, 1.0 from tr), mass as materialized (select leaf, word, sum(n * r) as m from tf join ps using (doc_id) group by 1, 2), sh as materialized (select leaf, level, sum(m * part / p) as m from mass join mxe using (leaf, word) join e using (leaf, word) group by 1, 2), al as (select leaf, sum(m) as al from mass group by 1), "
    "lam as (select * from sh union all select al.leaf, -1, greatest(any_value(al) - sum(sh.m), 0) from al join sh using (leaf) group by 1) select leaf, level::int as level, round((m + 1) / sum(m + 1) over (partition by leaf), 6) + 0 as lambda from lam",
)
def h8(spark, sf):
    tf, anc, priors, lambdas, words, v, labels = _start(spark, sf)
    return T.em_step(tf, anc, priors, lambdas, words, v, labels=labels)[1].select("leaf", "level", r6("lambda").alias("lambda"))


@query("H9_cluster")
def h9(spark, sf):
    # options: cooled by halves, 4 iterations at most; over all words
    return T.grow_clusters(corpus(spark, sf).tf, decay=0.5, most_rounds=4)[0]


@query("H10_em_with_labels")
def h10(spark, sf):
    tf, anc, priors, lambdas, words, v, labels = _start(spark, sf)
    return T.full_em(tf, anc, priors, lambdas, words, v, labels, rounds=3)[1]


@query("H10_lambdas_from_validation")
def h10v(spark, sf):
    tf, anc, priors, lambdas, words, v, labels = _start(spark, sf)
    held = tf.select("doc_id").distinct().join(labels.select("doc_id"), "doc_id", "left_anti").where("doc_id % 2 = 0")
    return T.full_em(tf, anc, priors, lambdas, words, v, labels, rounds=1, incremental=None, validation=held)[1]


@query(
    "H11_lambda_sweep",
    f"with {_HTF}, tv as (select count(*) as tv from np where node = ''), fl as (select distinct leaf from anc), st as (select unnest(range(1, 21)) / 20 as u), ts as (select doc_id, word, n from tf where tag = 'test'), l as (select ts.doc_id, fl.leaf, u, sum(ts.n) as total, ln(1 / 12) + sum(ts.n * ln((1 - u) * coalesce(np.p, 0) + u / tv)) as l from ts cross join fl cross join st cross join tv left join np on np.word = ts.word and np.node = fl.leaf group by 1, 2, 3), "
    "b as (select l.doc_id, u, lf.leaf as own, any_value(total) as total, arg_min(l.leaf, (-round(l, 6), l.leaf)) as best, max(case when l.leaf = lf.leaf then l end) as l from l join lf using (doc_id) group by 1, 2, 3) select round(u, 2) as uniform, round(avg((best = own)::int), 6) as accuracy, round(exp(-sum(l) / sum(total)), 3) as perplexity from b group by 1",
)
def h11s(spark, sf):
    c, _, anc, words = _tree(spark, sf)
    tf = c.tf.join(c.docs.where("tag = 'test'").select("doc_id"), "doc_id", "left_semi")
    leaves = anc.select("leaf").distinct().select("leaf", F.lit(1 / 12).alias("prior"))
    labels = _leaves(spark, sf).select("doc_id", F.col("path").alias("leaf"))
    out = T.lambda_sweep(tf, words, leaves, labels, words.where("node = ''").agg(F.count("*").alias("v")))
    return out.select(F.round("uniform", 2).alias("uniform"), F.round("accuracy", 6).alias("accuracy"), F.round("perplexity", 3).alias("perplexity"))


@query(
    "H12_perplexities",
    f"with {_LOGS}, l as (select doc_id, leaf, total, log_prob, log_prob - ln(12) as l from lg), r as (select *, exp(l - max(l) over (partition by doc_id)) as e from l), p as (select r.doc_id, any_value(total) as total, sum(e * log_prob) / sum(e) as m, max(l) as u, max(case when r.leaf = lf.leaf then l end) as k from r join lf using (doc_id) group by 1) select round(exp(-sum(m) / sum(total)), 4) as members, round(exp(-sum(u) / sum(total)), 4) as unlabelled, round(exp(-sum(k) / sum(total)), 4) as labelled from p",
)
def h12p(spark, sf):
    out = T.perplexities(*_logs(spark, sf), _leaves(spark, sf).select("doc_id", F.col("path").alias("leaf")))
    return out.select(*[F.round(c, 4).alias(c) for c in ("members", "unlabelled", "labelled")])


@query("H11_fienberg", f"with {_HTF}, tv as (select count(*) as tv from np where node = ''), tr as (select distinct node, case when node = '' then null when node like '%/%' then regexp_replace(node, '/[^/]*$', '') else '' end as parent from anc), sz as (select node, sum(n) as size from np group by 1), b as (select np.node, sum(power(coalesce(u.p, 1 / tv) - np.p, 2) / (np.p * (1 - np.p))) as b from np join tr using (node) cross join tv left join np u on u.node = tr.parent and u.word = np.word where np.p < 1 group by 1) select node, round((tv / size) / (tv / size + b), 6) + 0 as own from b join sz using (node), tv")
def h11(spark, sf):
    _, tree, _, words = _tree(spark, sf)
    return T.fienberg(words, tree, words.where("node = ''").agg(F.count("*").alias("v"))).withColumn("own", r6("own"))


@query("H12_perplexity", f"with {_LOGS}, m as (select doc_id, any_value(total) as total, max(log_prob) + ln(sum(exp(log_prob - top))) - ln(12) as l from (select *, max(log_prob) over (partition by doc_id) as top from lg) group by 1) select round(exp(-sum(l) / sum(total)), 4) as perplexity from m")
def h12(spark, sf):
    return T.perplexity(*_logs(spark, sf)).select(F.round("perplexity", 4).alias("perplexity"))


@query("H13_classify", f"with {_LOGS}, s as (select doc_id, leaf, (ln(1 / 12) + log_prob) / greatest(floor((total + 1) / least(9, total)), 1) as s from lg), e as (select doc_id, leaf, exp(s - max(s) over (partition by doc_id)) as e from s) select doc_id, leaf, round(e / sum(e) over (partition by doc_id), 6) + 0 as score from e")
def h13(spark, sf):
    return T.classify(*_logs(spark, sf)).withColumn("score", r6("score"))


@query("H14_softmax", f"with {_LOGS}, l as (select doc_id, leaf as class, log_prob as log_score from lg) " + softmax_sql("select * from l"))
def h14(spark, sf):
    return K.softmax(_logs(spark, sf)[0].select("doc_id", F.col("leaf").alias("class"), F.col("log_prob").alias("log_score"))).withColumn("score", r6("score"))


@query("H15_label_sets", "with s as (select case when lang < source then lang || '|' || source else source || '|' || lang end as set_key, count(*) as n_docs from documents group by 1) select set_key, n_docs, round(n_docs / sum(n_docs) over (), 6) as prior from s")
def h15(spark, sf):
    return T.label_sets(table(spark, sf).select(F.array("lang", "source").alias("classes"))).withColumn("prior", F.round("prior", 6))


@query("H15_mixtures")
def h15m(spark, sf):
    sets = table(spark, sf).select("doc_id", F.array("lang", "source").alias("classes"))
    return T.mixture_em(corpus(spark, sf).tf, sets, rounds=5)[0].withColumn("weight", r6("weight"))


for _how in ("greedy0", "greedy1", "greedy2"):

    def _h16(spark, sf, _how=_how):
        c = corpus(spark, sf)
        return T.search_labels(c.tf, K.smoothed(c)[0], _how)

    query(f"H16_{_how}_labels".replace("greedy1_", "greedy_"))(_h16)


# Generators, archives


@query("S18_generated_documents")
def s18(spark, sf):
    return T.dirichlet_documents(spark, {f"w{k}": 0.5 + k / 10 for k in range(50)}, 500, 100)


@query("S8_archive", f"with {TF} select word, count(*) as df, sum(n) as cf from tf group by 1")
def s8(spark, sf):
    from quern.functions.lineage import cut

    c = corpus(spark, sf)
    cut(spark.range(1))  # makes sure that there is a shared folder
    path = f"{spark.sparkContext.getCheckpointDir()}/archive-{uuid.uuid4().hex}"
    first, rest = (c.tf.where(f"doc_id % 2 = {k}") for k in (0, 1))
    I.write_archive(path, {"tf": first}, {"method": "naivebayes"})
    I.write_archive(path, {"tf": rest}, {"method": "naivebayes"}, append=True)
    return vocabulary(I.read_archive(spark, path)[0]["tf"])


@query("S12_hierarchy_index", f"with {_HTF} select node, count(*) as words, sum(n)::bigint as n from np group by 1")
def s12(spark, sf):
    return _tree(spark, sf)[3].groupBy("node").agg(F.count("*").alias("words"), F.sum("n").alias("n"))


@query("S19_stream_scores", f"with nb as ({_nb(*_LAP)}), b as (select doc_id, class from nb qualify row_number() over (partition by doc_id order by score desc, class) = 1) select class, count(*) as n from b group by 1")
def s19(spark, sf):
    c = corpus(spark, sf)
    return K.ranked(K.naive_bayes(c).withColumn("score", r6("score")), 1).groupBy("class").agg(F.count("*").alias("n"))
