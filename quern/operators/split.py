"""Tagging documents: quotas are exact, members are chosen by a seeded hash order."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.lineage import cut

TAGS = ("train", "test", "unlabeled", "untagged", "validation", "ignore", "pool", "waiting")


def order_key(seed: int):
    """A hash of doc_id and seed that other engines have too."""
    return F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(seed))))


def lowest(pool: DataFrame, want: DataFrame, seed: int) -> DataFrame:
    """The documents of pool (doc_id, class) with the lowest hashes, as many of each class as want (class, quota) says.

    No class is ranked whole: counts by the hash's first 12 bits say which slice holds a class's last document, the slices
    before it are taken, and that slice alone is ranked."""
    rows = pool.select("doc_id", "class", order_key(seed).alias("hash")).withColumn("slice", F.conv(F.substring("hash", 1, 3), 16, 10).cast("int"))
    by = Window.partitionBy("class").orderBy("slice")  # 4096 slices of a class
    counts = rows.groupBy("class", "slice").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(by))
    edges = counts.join(F.broadcast(want), "class").where(F.col("upto") - F.col("n") < F.col("quota")).select("class", "slice", (F.col("quota") - F.col("upto") + F.col("n")).alias("room"), (F.col("upto") <= F.col("quota")).alias("whole"))
    near = rows.join(F.broadcast(edges), ["class", "slice"])
    rank = F.row_number().over(Window.partitionBy("class", "slice").orderBy("hash", "doc_id"))
    last = near.where("not whole").withColumn("k", rank).where(F.col("k") <= F.col("room"))
    return near.where("whole").select("doc_id").unionByName(last.select("doc_id"))


def retag(docs: DataFrame, old: str | None, new: str) -> DataFrame:
    """Changes one tag (None: every tag) into another."""
    return docs.withColumn("tag", F.lit(new) if old is None else F.when(F.col("tag") == old, new).otherwise(F.col("tag")))


def tag_names(docs: DataFrame, names: DataFrame, tag: str, parts: int | None = None) -> DataFrame:
    """Tags the documents whose name, or its last `parts` path components, is listed."""
    last = lambda c: F.array_join(F.slice(F.split(c, "/"), -parts, parts), "/") if parts else c
    listed = names.select(last(F.col("name")).alias("listed")).distinct()
    joined = docs.withColumn("key", last(F.col("name"))).join(listed, F.col("key") == F.col("listed"), "left")
    return joined.withColumn("tag", F.when(F.col("listed").isNotNull(), tag).otherwise(F.col("tag"))).drop("key", "listed")


def quotas(docs: DataFrame, n: int) -> DataFrame:
    """class, quota: n shared in proportion to the classes' sizes, rounded down, then topped up by one in class order, round by round."""
    size = docs.groupBy("class").agg(F.count("*").alias("size"))
    all_ = Window.partitionBy()
    floor = size.withColumn("base", F.floor(F.col("size") * n / F.sum("size").over(all_)))
    spare = F.least(F.lit(n), F.sum("size").over(all_)) - F.sum("base").over(all_)
    # Less than one a class is left over, so one round gives each of the first classes with room one more.
    room = floor.withColumn("room", (F.col("base") < F.col("size")).cast("int")).withColumn("spare", spare)
    rank = F.sum("room").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, 0))  # a row a class
    return room.select("class", (F.col("base") + F.when((F.col("room") == 1) & (rank <= F.col("spare")), 1).otherwise(0)).alias("quota"))


def tag_by_count(docs: DataFrame, n: int, tag: str, seed: int = 1, among: str = "untagged") -> DataFrame:
    """Tags n documents of `among`, classes in proportion."""
    pool = docs.where(F.col("tag") == among)
    return _tagged(docs, lowest(pool, quotas(pool, n), seed), tag)


def _tagged(docs: DataFrame, chosen: DataFrame, tag: str) -> DataFrame:
    return docs.join(chosen.select("doc_id", F.lit(tag).alias("new")), "doc_id", "left").withColumn("tag", F.coalesce("new", "tag")).drop("new")


def tag_by_fraction(docs: DataFrame, share: float, tag: str, seed: int = 1, of_remaining: bool = False) -> DataFrame:
    """Tags a share of all but the ignored documents, or of the untagged ones."""
    base = docs.where("tag = 'untagged'" if of_remaining else "tag != 'ignore'")
    return tag_by_count(docs, int(base.count() * share + 0.5), tag, seed)


def tag_per_class(docs: DataFrame, counts: int | dict[str, int], tag: str, seed: int = 1, among: str = "untagged") -> DataFrame:
    """Tags a number of documents of each class (one number, or one by class)."""
    want = F.lit(counts) if isinstance(counts, int) else F.coalesce(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])[F.col("class")], F.lit(0))
    pool = docs.where(F.col("tag") == among)
    return _tagged(docs, lowest(pool, pool.select("class").distinct().withColumn("quota", want), seed), tag)


@dataclass(frozen=True)
class SplitSpec:
    """How many documents get a tag: kind is count, fraction, per_class, by_class, remaining or files; pool all, remaining or train."""

    kind: str
    value: float | dict[str, int] | str | None = None
    pool: str = "all"


def parse_spec(text: str) -> SplitSpec:
    """``N``, ``0.x``, each with ``r`` (of the remaining) or ``t`` (from train), ``Npc`` (per class), ``[class,N,...]``, ``remaining``, or a file name."""
    pools = {"": "all", "r": "remaining", "t": "train"}
    if text == "remaining":
        return SplitSpec("remaining")
    if m := re.fullmatch(r"(\d+)pc", text):
        return SplitSpec("per_class", int(m[1]))
    if m := re.fullmatch(r"(\d+)([rt]?)", text):
        return SplitSpec("count", int(m[1]), pools[m[2]])
    if m := re.fullmatch(r"(\d*\.\d+)([rt]?)", text):
        return SplitSpec("fraction", float(m[1]), pools[m[2]])
    if text.startswith("[") and text.endswith("]"):
        items = [x.strip() for x in text[1:-1].split(",")]
        return SplitSpec("by_class", {k: int(v) for k, v in zip(items[::2], items[1::2])})
    return SplitSpec("files", text)


def split(docs: DataFrame, specs: dict[str, str], seed: int = 1) -> DataFrame:
    """Tags docs (doc_id, class, name) by specs {tag: spec}: files, then per class, proportional, remaining, from train; in each
    stage ignore, test, train, unlabeled, validation."""
    docs = docs.withColumn("tag", F.lit("untagged"))
    parsed = [(t, parse_spec(specs[t])) for t in ("ignore", "test", "train", "unlabeled", "validation") if t in specs]
    spark = docs.sparkSession
    stages = (lambda s: s.kind == "files", lambda s: s.kind in ("per_class", "by_class"), lambda s: s.kind in ("count", "fraction") and s.pool != "train", lambda s: s.kind == "remaining", lambda s: s.pool == "train")
    for stage in stages:
        for tag, spec in parsed:
            if not stage(spec):
                continue
            docs = cut(docs)  # each step reads its input several times
            if spec.kind == "files":
                docs = tag_names(docs, spark.read.text(spec.value).withColumnRenamed("value", "name"), tag)
            elif spec.kind in ("per_class", "by_class"):
                docs = tag_per_class(docs, spec.value, tag, seed)
            elif spec.kind == "remaining":
                docs = retag(docs, "untagged", tag)
            elif spec.kind == "count":
                docs = tag_by_count(docs, int(spec.value), tag, seed, "train" if spec.pool == "train" else "untagged")
            elif spec.pool == "train":
                docs = tag_by_count(docs, int(docs.where("tag = 'train'").count() * spec.value + 0.5), tag, seed, "train")
            else:
                docs = tag_by_fraction(docs, spec.value, tag, seed, spec.pool == "remaining")
    return docs
