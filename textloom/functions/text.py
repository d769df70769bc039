"""Text functions as Column to Column: cleaning, normalising, segmenting, tokenising."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

#: English function words, frozen so that results don't depend on an installed resource.
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her "
    "hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were "
    "be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off over under again further then once here there when "
    "where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don don't "
    "should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't "
    "isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
PUNCTUATION = string.punctuation
SPACES = r"[\x09-\x0D\x1C-\x20]+"
SEGMENT = r"[^.?!]+[.?!]*"


def dash_breaks(x: Column) -> Column:
    """A dash before a capital ends a sentence."""
    return F.regexp_replace(F.regexp_replace(x, "[,:.;]? - ([A-Z])", ". $1"), "[,:.;]? \t([A-Z])", ". $1")


def clean_html(x: Column) -> Column:
    """Dash breaks, other than ASCII and zero-led words to blanks, no line breaks, tabs or [digit], tags to blanks."""
    x = F.regexp_replace(F.regexp_replace(dash_breaks(x), r"[^\x00-\x7F]", " "), r"0[0-9A-Za-z_]+", " ")
    x = F.translate(x, "\n\t", "")
    for digit in range(10):
        x = F.replace(x, F.lit(f"[{digit}]"), F.lit(""))
    return F.regexp_replace(x, "<[^>]+>", " ")


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, SPACES, " "))


def drop_punctuation(x: Column) -> Column:
    return F.translate(x, PUNCTUATION, "")


def normalize(x: Column) -> Column:
    return squeeze(drop_punctuation(F.lower(clean_html(x))))


def drop_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(STOPWORDS))


def content_tokens(normalized: Column) -> Column:
    """Tokens in order, repeats included, without stop words and all-digit tokens."""
    return F.filter(F.split(normalized, " "), lambda t: (t != "") & ~t.isin(STOPWORDS) & ~t.rlike("^[0-9]+$"))


def rank_tokens(normalized: Column) -> Column:
    """Tokens for graph ranking: no stop words, none that holds a digit."""
    return F.filter(F.split(normalized, " "), lambda t: (t != "") & ~t.isin(STOPWORDS) & ~t.rlike("[0-9]"))


def word_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"[0-9A-Za-z_]+"), F.lit(0))


def segments(cleaned: Column) -> Column:
    """Trimmed, non-empty sentence segments in order."""
    return F.filter(F.transform(F.regexp_extract_all(cleaned, F.lit(SEGMENT), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def drop_dangling(segs: Column) -> Column:
    """Without the segments that end in ? and are followed by one that doesn't start upper-case; the last one stays."""
    return F.filter(segs, lambda s, i: ~((i < F.size(segs) - 1) & s.endswith("?") & ~F.coalesce(F.get(segs, i + 1), F.lit("")).rlike("^[A-Z]")))


def merge_dangling(segs: Column) -> Column:
    """The evident intent of drop_dangling: such a segment is joined to the next one."""
    joined = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & F.element_at(done, -1).endswith("?") & ~s.rlike("^[A-Z]"),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), s))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return joined


def adjacent_pairs(tokens: Column, least: int = 4) -> Column:
    """Default entity provider: pairs of neighbouring tokens of at least `least` letters each."""
    at = lambda i: F.get(tokens, i)
    steps = F.when(F.size(tokens) > 1, F.sequence(F.lit(0), F.size(tokens) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(steps, lambda i: (F.length(at(i)) >= least) & (F.length(at(i + 1)) >= least)), lambda i: F.concat_ws(" ", at(i), at(i + 1)))


def has_url(x: Column) -> Column:
    return x.rlike(r"http\S+|www.\S+")


def strip_brackets(x: Column) -> Column:
    return F.regexp_replace(x, r"\[.*?\]", "")


def strip_disease(term: Column) -> Column:
    cut = lambda word: squeeze(F.replace(term, F.lit(word), F.lit("")))
    return F.when(term.contains("diseases"), cut("diseases")).when(term.contains("disease"), cut("disease")).otherwise(term)


def node_ref(iri: Column) -> Column:
    """(source, id) of .../SRC_ID."""
    last = F.element_at(F.split(iri, "/"), -1)
    return F.struct(F.split(last, "_")[0].alias("source"), F.get(F.split(last, "_"), F.lit(1)).alias("id"))


def last_segment(iri: Column) -> Column:
    return F.coalesce(F.element_at(F.split(iri, "/"), -1), F.lit("None"))


def position_key(identifier: Column) -> Column:
    """The digits of an id as a number."""
    return F.regexp_replace(identifier, "[^0-9]", "").cast("long")


def tree_category(tree_numbers: Column) -> Column:
    """Distinct leading letters of tree numbers, C where there are none."""
    letters = F.array_sort(F.array_distinct(F.transform(tree_numbers, lambda t: F.substring(t, 1, 1))))
    return F.when(F.coalesce(F.size(tree_numbers), F.lit(0)) == 0, F.array(F.lit("C"))).otherwise(letters)
