"""Readers and writers: delimited text, spreadsheets' exports, nested JSON, XML, CSV, and cached tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators.corpus import sentences
from ..schema import RAW_QUESTION


def delimited_fields(value: Column, separator: str = r"\|\|") -> tuple[Column, Column]:
    """(key, value) of a line: of more than two fields, the value is those between the first and the last, joined by a blank."""
    f = F.split(value, separator)
    body = F.when(F.size(f) > 2, F.array_join(F.slice(f, 2, F.greatest(F.size(f) - 2, F.lit(0))), " ")).otherwise(F.get(f, F.lit(1)))
    return f[0], body


def read_delimited(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(question_id, <name>) of a `||` file."""
    key, body = delimited_fields(F.col("value"))
    return spark.read.text(path).select(key.alias("question_id"), body.alias(name))


def read_answers(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(question_id, answer_id, article) of a spreadsheet's CSV export; question numbers lose their fraction, articles their markup."""
    rows = spark.read.csv(path, header=header, multiLine=True, escape='"', schema="question_id string, answer_id string, article string")
    return rows.select(F.col("question_id").cast("double").cast("long").cast("string").alias("question_id"), "answer_id", T.clean_html(F.col("article")).alias("article"))


def assemble(questions: DataFrame, answers: DataFrame, abstractive: DataFrame | None = None, extractive: DataFrame | None = None) -> DataFrame:
    """Questions with their answers (both must be there) and, where given, summaries."""
    out = questions.join(answers, "question_id")
    for name, df in (("multi_abs_summ", abstractive), ("multi_ext_summ", extractive)):
        out = out.join(df, "question_id", "left") if df is not None else out.withColumn(name, F.lit(None).cast("string"))
    return out


#: Files of a named input set.
INPUTS = {
    name: {"questions": f"{name}/questions.txt", "answers": f"{name}/answers.csv", "abstractive": f"{name}/abstractive.txt", "extractive": f"{name}/extractive.txt"}
    for name in ("validation", "test")
}


def load_inputs(spark: SparkSession, name: str, root: str, cache: str | None = None) -> DataFrame:
    """The assembled table of a named input set, from its cached Parquet if there is one."""
    if name not in INPUTS:
        raise ValueError(f"unknown input set {name!r}")
    f = {k: f"{root}/{v}" for k, v in INPUTS[name].items()}
    build = lambda: assemble(read_delimited(spark, f["questions"], "question"), read_answers(spark, f["answers"]), read_delimited(spark, f["abstractive"], "multi_abs_summ"), read_delimited(spark, f["extractive"], "multi_ext_summ"))
    return cached(spark, cache, build) if cache else build()


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at path; built and written first if it isn't there or wasn't finished."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, question, answers map, summaries) of a JSON object keyed by question id."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{RAW_QUESTION.simpleString()}>")).alias("question_id", "q"))
    return raw.select("question_id", "q.*")


def flatten(nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions and answers tables of read_nested; positions are the ids' digits, answers are in the order of their ids."""
    questions = nested.select("question_id", "question", "multi_abs_summ", "multi_ext_summ", T.position_key(F.col("question_id")).alias("ques_pos"))
    answers = nested.select("question_id", F.explode_outer(F.map_entries("answers")).alias("a")).select("question_id", F.col("a.key").alias("answer_id"), "a.value.*")
    return questions, answers.withColumn("ans_pos", T.position_key(F.col("answer_id")))


def tables(nested: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, answers and sentences of read_nested, each with its position."""
    questions, answers = flatten(nested)
    return questions, answers, sentences(answers.withColumnRenamed("ans_pos", "answer_pos"))


def write_nested(rows: DataFrame, path: str) -> None:
    """One JSON line per question, in order of its id."""
    rows.orderBy("question_id").write.mode("overwrite").json(path)


def read_descriptors(spark: SparkSession, path: str, row_tag: str = "DescriptorRecord") -> DataFrame:
    """(node_id, notes, terms, tree_numbers) of a descriptor XML file, by Spark's own XML source."""
    schema = "DescriptorUI string, TreeNumberList struct<TreeNumber: array<string>>, ConceptList struct<Concept: array<struct<ScopeNote: string, TermList: struct<Term: array<struct<String: string>>>>>>"
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    empty = F.array().cast("array<string>")
    concepts = F.coalesce("ConceptList.Concept", F.from_json(F.lit("[]"), "array<struct<ScopeNote: string, TermList: struct<Term: array<struct<String: string>>>>>"))
    notes = F.filter(F.transform(concepts, lambda c: F.trim(c["ScopeNote"])), lambda n: n.isNotNull())
    terms = F.flatten(F.transform(concepts, lambda c: F.coalesce(F.transform(c["TermList"]["Term"], lambda t: t["String"]), empty)))
    return rows.select(F.col("DescriptorUI").alias("node_id"), notes.alias("notes"), F.array_join(notes, " ").alias("define"), F.array_distinct(terms).alias("terms"), F.coalesce("TreeNumberList.TreeNumber", empty).alias("tree_numbers"))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(name, tree_number) of a `name;number` list."""
    part = F.split("value", ";")
    return spark.read.text(path).select(part[0].alias("name"), F.get(part, F.lit(1)).alias("tree_number")).where("tree_number IS NOT NULL")


def split_list(x: Column) -> Column:
    """Distinct parts of a |-separated list, null giving none."""
    return F.array_distinct(F.filter(F.split(F.coalesce(x, F.lit("")), r"\|"), lambda s: s != ""))


def read_class_table(spark: SparkSession, path: str, synonym_columns: tuple[str, ...] = ("Synonyms",), definition: str | None = "Definitions", xref: str | None = None) -> DataFrame:
    """(node_id, terms, define, parents, xrefs) of a class CSV: label and synonym lists, parents and references as lists.

    Ids are the last part of the class IRI, after the source's prefix; a definition of up to five characters is none; a
    repeated id is an error.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    given = [c for c in synonym_columns if c in rows.columns]
    terms = F.array_distinct(F.concat(F.array("Preferred Label"), *[split_list(F.col(c)) for c in given]))
    define = F.when(F.length(definition) > 5, F.col(definition)) if definition and definition in rows.columns else F.lit(None).cast("string")
    parents = F.transform(split_list(F.col("Parents")), lambda p: T.node_ref(p)["id"])
    refs = split_list(F.col(xref)) if xref and xref in rows.columns else F.array().cast("array<string>")
    out = rows.select(T.node_ref(F.col("Class ID"))["id"].alias("node_id"), F.filter(terms, lambda t: t.isNotNull()).alias("terms"), define.alias("define"), parents.alias("parents"), refs.alias("xrefs"), F.array().cast("array<string>").alias("tree_numbers"))
    if out.groupBy("node_id").count().where("count > 1").limit(1).count():
        raise ValueError("repeated class ids")
    return out


def read_chemical_diseases(spark: SparkSession, path: str) -> DataFrame:
    """(chemical_id, disease_ref, evidence, score) of a CSV with a header."""
    rows = spark.read.csv(path, header=True, escape='"')
    return rows.select(F.col("ChemicalID").alias("chemical_id"), F.col("DiseaseID").alias("disease_ref"), F.col("DirectEvidence").alias("evidence"), F.col("InferenceScore").cast("double").alias("score"))


def read_gene_lists(spark: SparkSession, path: str) -> DataFrame:
    """(disease_ref, gene) of a JSON object from disease to genes."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("disease_ref", "genes"))
    return raw.select("disease_ref", F.explode("genes").alias("gene"))


def missing_texts(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct texts that stored(text) lacks, with no null among them."""
    return texts.select("text").where("text IS NOT NULL").distinct().join(stored.select("text"), "text", "left_anti")


def update_embeddings(spark: SparkSession, path: str, texts: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The store at path, with embed(missing texts) appended; embed gives (text, vec)."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        embed(texts.select("text").where("text IS NOT NULL").distinct()).write.mode("overwrite").parquet(path)
    else:
        embed(missing_texts(texts, spark.read.parquet(path))).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_text_ids(store: DataFrame, path: str) -> None:
    """(text, id) of a store's distinct texts; ids are unique and rise with the partitions, they needn't be consecutive."""
    store.select("text").distinct().withColumn("id", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)


def read_gene_table(spark: SparkSession, path: str, columns: tuple[str, ...], gene: str, disease: str) -> DataFrame:
    """(disease, gene) rows, once each, of a CSV whose preamble lines begin with #; columns name its fields.

    Rows that repeat the fields' names, as below some preambles, are passed over.
    """
    rows = spark.read.csv(path, comment="#", escape='"', schema=", ".join(f"`{c}` string" for c in columns))
    return rows.where((F.col(gene) != gene) & F.col(disease).isNotNull()).select(F.col(disease).alias("disease"), F.col(gene).alias("gene")).distinct()


def with_embeddings(rows: DataFrame, store: DataFrame, size: int, text: str = "text") -> DataFrame:
    """rows with vec; zeros where the store has no vector."""
    zeros = F.array_repeat(F.lit(0.0), size)
    return rows.join(store.select(F.col("text").alias("_t"), F.col("vec").cast("array<double>").alias("vec")), F.col(text) == F.col("_t"), "left").drop("_t").withColumn("vec", F.coalesce("vec", zeros))
