"""The catalogue of queries: each has a name, a Spark plan over a data folder, and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.lineage import spread
from quern.operators.corpus import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a plan (spark, sf_dir) -> DataFrame."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def corpus(spark: SparkSession, sf_dir: str, label: str = "lang", keep: bool = True) -> Corpus:
    """documents as a corpus: a class column, and doc_id % 10 < 7 for training."""
    return Corpus.of(table(spark, sf_dir), F.col(label), keep=keep)


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


# Shared SQL: tok(doc_id, class, tag, pos, word), tf, ctf (class_tf), cs (class_stats), cw (class_words).
DOCS = "docs as (select doc_id, lang as class, case when doc_id % 10 < 7 then 'train' else 'test' end as tag, text from documents)"
TOK = DOCS + ", tok0 as (select doc_id, class, tag, list_transform(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) between 2 and 99), lambda x: lower(x)) as ws from docs), tok as (select doc_id, class, tag, unnest(ws) as word, unnest(range(len(ws))) as pos from tok0)"
TF = TOK + ", tf as (select doc_id, class, tag, word, count(*) as n from tok group by all)"
CLASSES = (
    TF
    + ", ctf as (select class, word, sum(n)::bigint as n, count(*) as df from tf where tag = 'train' group by all)"
    + ", cs as (select d.class, d.n_docs, d.n_docs / sum(d.n_docs) over () as prior, coalesce(w.word_count, 0) as word_count, coalesce(w.n_unique, 0) as n_unique from (select class, count(*) as n_docs from docs where tag = 'train' group by 1) d left join (select class, sum(n) as word_count, count(*) as n_unique from ctf group by 1) w using (class))"
    + ", cw as (select word, sum(n)::bigint as total from ctf group by 1), v as (select count(*) as v, sum(total) as alln from cw)"
    + ", known as (select tf.doc_id, tf.word, tf.n, sum(tf.n) over (partition by doc_id) as size from tf semi join cw using (word) where tag = 'test')"
    + ", testdocs as (select doc_id from docs where tag = 'test')"
)


def softmax_sql(inner: str) -> str:
    """inner: doc_id, class, log_score."""
    return f"select doc_id, class, round(e / sum(e) over (partition by doc_id), 6) + 0 as score from (select doc_id, class, exp(log_score - max(log_score) over (partition by doc_id)) as e from ({inner}))"
