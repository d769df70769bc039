"""Rows with everything that an operator must stand: nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, n int, w string, size string, h string, score string, spans string, place string"
SAID = "Alpha beta gamma delta epsilon zeta eta theta iota kappa"
LINES = "first line here\nsecond line there\nthird line now\nfourth line then"
TEXTS = [
    (1, SAID, "en", "a"), (2, SAID, "en", "a"), (2, SAID, "en", "a"), (3, SAID.lower(), "en", "a"), (4, None, "en", "b"), (5, "", None, None),
    (6, " \t\n\x0b\x0c\r ", "de", "b"), (7, "one", "de", "b"), (8, "one two", "de", None), (None, "a text without id", "fr", "a"), (None, None, None, None),
    (9, LINES, "fr", "c"), (10, "x\n\n" + LINES + "\nlast", "fr", "c"), (11, "É ÀB naïve café 中文字符 " + SAID, "fr", "c"), (12, SAID + " lambda mu nu", "en", "c"),
    (13, "a a a a " * 3000, "en", "c"), (14, "word" * 5000, "en", "a"), (15, "12345 !!! ... 678", "es", "a"), (16, "tail\n", "es", "a"),
]


def docs(spark: SparkSession, rows=None) -> DataFrame:
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), *["clash", 7, 3, "w", "s", "h", "sc", "sp", "pl"]) for i, t, lang, src in rows], SCHEMA)


#: Names that operators use inside; none may disturb them, and stages pass them on.
INSIDE = """id own drop _id _own _drop _k _key _mixed _lines copies words n_lines n_removed lines w h h1 h2 k place taken target source_size row term pos start items
window bucket entry depth prefix node component row_id fp fp_0 n group pair root top a.b""".split()


def with_names(docs: DataFrame) -> DataFrame:
    """docs and a column of each such name, numbers and strings by turns."""
    from pyspark.sql import functions as F

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return plain.select("*", *[(F.lit(k) if k % 2 else F.lit(f"v{k}")).alias(c) for k, c in enumerate(INSIDE)])


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
