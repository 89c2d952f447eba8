"""Sources and sinks: class folders, line documents, printed matrices, label and word lists, count matrices, archives."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def class_of_path(path: Column) -> Column:
    """The last folder of a file's path."""
    return F.element_at(F.split(path, "/"), -2)


def read_class_folders(spark: SparkSession, root: str, exclude: str | None = None) -> DataFrame:
    """name, class, text of every file under root, whatever its depth; files of the name `exclude` are left out."""
    raw = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).withColumn("name", F.input_file_name())
    if exclude:
        raw = raw.where(F.element_at(F.split("name", "/"), -1) != exclude)
    return raw.select("name", class_of_path(F.col("name")).alias("class"), F.col("value").alias("text"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """name, class, text of lines (value) ``name number text``; % lines are comments; a negative number counts as 0."""
    part = lambda k: F.regexp_extract("value", "^(\\S+) (-?\\d+) ?(.*)$", k)
    rows = lines.where(~F.col("value").startswith("%")).select(part(1).alias("name"), part(2).alias("number"), part(3).alias("text")).where("name != ''")
    return rows.select("name", F.concat(F.lit("class"), F.greatest(F.col("number").cast("int"), F.lit(0)).cast("string")).alias("class"), "text")


def print_matrix(tf: DataFrame, docs: DataFrame, form: str = "wn") -> DataFrame:
    """doc_id, class, line: each document's cells in order of words. form: n (index n), wn (word n), win (word index n), e (n), b
    (word 1), l (the word n times)."""
    rows = tf
    if "i" in form or form == "n":
        rows = tf.join(with_index(tf), "word")
    else:
        rows = tf.withColumn("wi", F.lit(0))
    cell = {
        "n": lambda x: F.concat_ws(" ", x["wi"].cast("string"), x["n"].cast("string")),
        "wn": lambda x: F.concat_ws(" ", x["word"], x["n"].cast("string")),
        "win": lambda x: F.concat_ws(" ", x["word"], x["wi"].cast("string"), x["n"].cast("string")),
        "e": lambda x: x["n"].cast("string"),
        "b": lambda x: F.concat_ws(" ", x["word"], F.lit("1")),
        "l": lambda x: F.repeat(F.concat(x["word"], F.lit(" ")), x["n"].cast("int")),
    }[form]
    joined = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "wi", "n"))), cell), "" if form == "l" else "  ").alias("line"))
    return joined.join(docs.select("doc_id", "class"), "doc_id").select("doc_id", "class", "line")


def with_index(tf: DataFrame) -> DataFrame:
    """word, wi: words numbered from 0 in alphabetical order, by range partitions and their offsets."""
    words = tf.select("word").distinct().repartitionByRange("word").withColumn("part", F.spark_partition_id())
    local = words.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("word")))
    sizes = local.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    return local.join(F.broadcast(before), "part").select("word", (F.col("before") + F.col("k") - 1).alias("wi"))


def print_dense(tf: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, class, line: the counts of every word of the dictionary, in its order; a document with no word has no line."""
    size = tf.select("word").distinct().agg(F.count("*").alias("v"))
    rows = tf.join(with_index(tf), "word").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("wi").cast("int"), "n"))).alias("cells"))
    every = F.transform(F.sequence(F.lit(0), (F.col("v") - 1).cast("int")), lambda k: F.coalesce(F.try_element_at("cells", k), F.lit(0)).cast("string"))
    return rows.crossJoin(F.broadcast(size)).join(docs.select("doc_id", "class"), "doc_id").select("doc_id", "class", F.array_join(every, "  ").alias("line"))


def read_matrix(lines: DataFrame, form: str = "wn", words: DataFrame | None = None) -> DataFrame:
    """name, class, word, n of lines (value) ``name class  cell  cell ...``.

    form: wn (word n), win (word index n), b (word 1), n (index n), w (the words that occur), l (a word as often as it occurs), or a
    (dense: a cell of every word) before e (n) or b (0 or 1). words (word, wi) is needed where words aren't printed."""
    parts = lines.select(F.split(F.trim("value"), "\\s+").alias("f"))
    rows = parts.select(F.col("f")[0].alias("name"), F.col("f")[1].alias("class"), F.slice("f", 3, 1 << 30).alias("c"))
    if form in ("w", "l"):
        cells = rows.select("name", "class", F.explode("c").alias("word")).groupBy("name", "class", "word").agg(F.count("*").alias("n"))
        return cells.withColumn("n", F.lit(1).cast("long")) if form == "w" else cells
    if form.startswith("a"):
        cells = rows.select("name", "class", F.posexplode("c").alias("wi", "n")).select("name", "class", "wi", F.col("n").cast("long").alias("n")).where("n > 0")
        return cells.join(words.select("word", "wi"), "wi").select("name", "class", "word", "n")
    step = {"wn": 2, "win": 3, "b": 2, "n": 2}[form]
    index = F.explode(F.sequence(F.lit(0), F.floor(F.size("c") / step).cast("int") - 1)).alias("k")
    cells = rows.where(F.size("c") >= step).select("name", "class", "c", index).select("name", "class", F.col("c")[F.col("k") * step].alias("word"), F.col("c")[F.col("k") * step + step - 1].cast("long").alias("n"))
    if form == "n":
        return cells.withColumn("wi", F.col("word").cast("long")).drop("word").join(words.select("word", "wi"), "wi").select("name", "class", "word", "n")
    return cells


def document_list(docs: DataFrame) -> DataFrame:
    """number (from 1, in order of names), name, class, length (of the list); numbered by range partitions and their offsets."""
    ranged = docs.select("name", "class").repartitionByRange("name").withColumn("part", F.spark_partition_id())
    local = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("name")))
    sizes = local.groupBy("part").agg(F.count("*").alias("size"))
    whole = Window.partitionBy()
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("size").over(whole).alias("length"))  # a row a partition
    return local.join(F.broadcast(before), "part").select((F.col("before") + F.col("k")).cast("int").alias("number"), "name", "class", "length")


def write_postings(path: str, index: DataFrame, append: bool = False, slices: int = 16) -> None:
    """A positional index (doc_id, pos, word) as an archive: slices of words, in a slice sorted by word, so that a term's postings are
    read from one folder and few row groups."""
    rows = index.withColumn("slice", F.pmod(F.hash("word"), F.lit(slices))).repartition("slice").sortWithinPartitions("slice", "word", "doc_id", "pos")
    rows.write.mode("append" if append else "overwrite").partitionBy("slice").parquet(path)


def read_postings(spark: SparkSession, path: str, words: tuple[str, ...] = (), slices: int = 16) -> DataFrame:
    """doc_id, pos, word of an archive; with words, only their slices are read."""
    index = spark.read.parquet(path)
    if words:
        wanted = spark.createDataFrame([(w,) for w in words], "word string").select(F.pmod(F.hash("word"), F.lit(slices))).distinct().collect()  # a row a word
        index = index.where(F.col("slice").isin(*[r[0] for r in wanted]) & F.col("word").isin(*words))
    return index.select("doc_id", "pos", "word")


def parse_label_lists(lines: DataFrame) -> DataFrame:
    """name, classes of lines (value) ``file class class ...``."""
    f = F.split(F.trim("value"), "\\s+")
    return lines.select(f[0].alias("name"), F.slice(f, 2, 1 << 30).alias("classes"))


def word_list(lines: DataFrame) -> DataFrame:
    """word: the distinct words (lower case) of white-space separated lists (value)."""
    return lines.select(F.explode(F.split(F.lower("value"), "\\s+")).alias("word")).where("word != ''").distinct()


def weighted_words(lines: DataFrame, name: str = "alpha") -> DataFrame:
    """word and a number, of lines ``number word``."""
    f = F.split(F.trim("value"), "\\s+")
    return lines.where("trim(value) != ''").select(f[1].alias("word"), f[0].cast("double").alias(name))


def parse_count_matrix(text: DataFrame) -> DataFrame:
    """bag, dim, n of a text (value): the number of dimensions, then counts row by row."""
    f = text.select(F.split(F.trim("value"), "\\s+").alias("f"))
    d = F.col("f")[0].cast("int")
    rows = f.select(d.alias("d"), F.posexplode(F.slice("f", 2, 1 << 30)).alias("k", "n"))
    return rows.select(F.floor(F.col("k") / F.col("d")).cast("int").alias("bag"), (F.col("k") % F.col("d")).cast("int").alias("dim"), F.col("n").cast("double").alias("n"))


def svmlight(tf: DataFrame, docs: DataFrame, positive: str, value: str = "n") -> DataFrame:
    """doc_id, line ``1|-1 index:value ...`` with words numbered from 1."""
    rows = tf.join(with_index(tf).select("word", (F.col("wi") + 1).alias("wi")), "word")
    cells = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("wi", F.col(value).alias("v")))), lambda x: F.concat_ws(":", x["wi"].cast("string"), x["v"].cast("string"))), " ").alias("cells"))
    return cells.join(docs.select("doc_id", "class"), "doc_id").select("doc_id", F.concat_ws(" ", F.when(F.col("class") == positive, "1").otherwise("-1"), "cells").alias("line"))


def pipe_text(docs: DataFrame, command: list[str], allowed: bool = False) -> DataFrame:
    """doc_id, text with each text sent through a command. Off unless allowed: it runs a program on the executors."""
    if not allowed:
        raise PermissionError("pass allowed=True to run a command for each document")
    import subprocess

    def run(parts):
        for part in parts:
            part["text"] = [subprocess.run(command, input=t or "", capture_output=True, text=True, check=True).stdout for t in part["text"]]
            yield part

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, text string")


FORMAT = 1


def write_archive(path: str, tables: dict[str, DataFrame], model: dict | None = None, append: bool = False) -> None:
    """Tables as Parquet folders beside model.json (written through Spark, so any file system will do)."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("append" if append else "overwrite").parquet(f"{path}/{name}")
    note = json.dumps({"format": FORMAT, "tables": sorted(tables), **(model or {})})
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model.json")


def read_archive(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    model = json.loads(spark.read.text(f"{path}/model.json").first().value)
    if model["format"] != FORMAT:
        raise ValueError(f"format {model['format']} is not {FORMAT}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in model["tables"]}, model
