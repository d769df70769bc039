"""A small literal lexical graph and ontology for the queries that no table provides data for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: word, synset; synset, token; hypernym pairs (both directions are meant); token, antonym.
WORDS = [("care", "s1"), ("cure", "s2"), ("care", "s3"), ("relief", "s4"), ("aid", "s5")]
MEMBERS = [("s1", "care"), ("s1", "attention"), ("s2", "cure"), ("s2", "remedy"), ("s3", "tending"), ("s3", "first aid"), ("s4", "relief"), ("s4", "Ease"), ("s5", "aid"), ("s5", "help"), ("s6", "act"), ("s7", "deed"), ("s8", "work")]
LINKS = [("s1", "s2"), ("s2", "s3"), ("s3", "s4"), ("s6", "s5"), ("s6", "s7"), ("s6", "s8"), ("s6", "s4")]
ANTONYMS = [("care", "neglect"), ("relief", "strain"), ("help", "hinder"), ("help", "block")]
NOUNS = [(1, "care"), (1, "relief"), (2, "cure"), (2, "aid"), (3, "nothing")]
DELIMITED = ["1||what helps?||x", "2||what||else||y||z", "3||only", "4||a||b", "5"]
TREE = [("N1", "C01"), ("N2", "C01.100"), ("N3", "C01.100.200"), ("N3", "D05.300"), ("N4", "D05"), ("N5", "E01.1")]
CHEMICALS = [("D1", "MESH:N2", 2.0), ("D1", "MESH:N2", 2.0), ("D2", "OMIM:77", None), ("D3", "MESH:N3", 4.0), ("D4", "bad", 1.0)]
XREFS = [("OMIM:77", "N4"), ("OMIM:78", "N1")]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal rows as a plan without Python workers."""
    names = [c.split()[0] for c in schema.split(",")]
    kinds = [c.split()[1] for c in schema.split(",")]
    one = [F.struct(*(F.lit(v).cast(k).alias(n) for n, k, v in zip(names, kinds, r))) for r in rows]
    return spark.range(1).select(F.inline(F.array(*one)))


def values(rows: list[tuple], names: str) -> str:
    """The same rows for DuckDB, as name(columns) AS (VALUES ...)."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"{names} AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"
