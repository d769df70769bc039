"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are taken from all labelled training rows, added up on the executors; the model is a matrix of log
probabilities, one column per language and one row per hash bucket, that goes with the scoring function. A batch's texts
are counted into a sparse matrix, and their scores are its product with the model.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import held_out, quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Hash buckets, and characters hashed at once. The matrix has a row per bucket and a column per language.
BUCKETS, BLOCK = 1 << 15, 1 << 20
#: Entries of the matrix that goes to every executor: with more than 512 languages there are fewer buckets, down to LEAST.
ENTRIES, LEAST = 1 << 24, 1 << 11
#: Entries of a batch's product that are gathered at once.
GATHERED = 1 << 22


def codes(text: str, last: int = 32):
    """Code points of the lower-cased text, with every run of other characters than letters as one space, the one before (last) counting too."""
    import numpy as np

    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = (c >= 0xAA) & (c != 0xAB) & (c != 0xBB) & (c != 0xD7) & (c != 0xF7)
    letter |= (c >= 97) & (c <= 122)
    letter &= ~((c >= 0x2000) & (c <= 0x2BFF)) & ~((c >= 0x3000) & (c <= 0x3004))
    c = np.where(c == 0x3C2, 0x3C3, np.where(letter, c, 32)).astype(np.uint32)  # the final sigma depends on what follows
    space = c == 32
    return c[~(space & np.concatenate([[last == 32], space[:-1]]))]


def ngram_buckets(text: str, buckets: int = BUCKETS):
    """Bucket of every 1-, 2- and 3-gram, repeats included; a generator over blocks, for bounded memory.

    A block begins with the last two codes of the one before, so n-grams are those of the whole text wherever it is cut.
    """
    import numpy as np

    known = np.array([32], np.uint32)  # the codes before the block of which the n-grams are still to come
    for at in range(0, max(1, len(text)), BLOCK):
        own = codes(text[at : at + BLOCK], int(known[-1]))
        if at + BLOCK >= len(text) and (len(own) == 0 and known[-1] != 32 or len(own) and own[-1] != 32):
            own = np.append(own, np.uint32(32))
        c, new = np.concatenate([known, own]), len(known)
        with np.errstate(over="ignore"):
            h1 = c * np.uint32(0x9E3779B1)
            h2 = (h1[:-1] ^ (h1[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[1:] * np.uint32(0xC2B2AE3D)
            h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)
            both = np.concatenate([h1[new:][c[new:] != 32], h2[new - 1 :], h3[max(0, new - 2) :]])
            both ^= both >> np.uint32(16)
            both = both * np.uint32(0x9E3779B1)
        known = c[-2:]
        yield both >> np.uint32(32 - int(buckets - 1).bit_length())


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter by Unicode; stops at the first."""
    return bool(text) and any(map(str.isalpha, text))


def train(docs: DataFrame, buckets: int = BUCKETS, alpha: float = 0.1, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> tuple[list[str], object]:
    """(languages in order, float32 matrix of buckets x languages): log probabilities, the log prior in a last row.

    Learns from all rows with text and language that aren't held out. Every task adds up its rows first, so what is
    shuffled doesn't depend on how many rows a language has. The driver gets two arrays a language, ENTRIES numbers in
    all; with many languages the buckets are halved until that holds, and more than ENTRIES / LEAST of them are an error.
    """
    import numpy as np

    rows = docs.where(~held_out(quoted(doc_id)) & quoted(lang).isNotNull() & quoted(text).isNotNull()).select(quoted(lang).alias("lang"), quoted(text).alias("text"))
    n_languages = rows.select("lang").distinct().limit(ENTRIES // LEAST + 1).count()
    if n_languages > ENTRIES // LEAST:
        raise ValueError(f"more than {ENTRIES // LEAST} languages")
    while buckets > LEAST and buckets * n_languages > ENTRIES:
        buckets //= 2

    def count(batches):
        import pyarrow as pa

        total = {}
        for b in batches:
            for name, t in zip(b.column("lang"), b.column("text")):
                own = total.setdefault(name.as_py(), np.zeros(buckets + 1, np.int64))
                own[buckets] += 1
                for ids in ngram_buckets(t.as_py(), buckets):
                    own[:buckets] += np.bincount(ids, minlength=buckets)
        for name, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])

    summed = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).toArrow().sort_by("lang")
    names = found.column("lang").to_pylist()
    counts = np.zeros((buckets + 1, len(names)))
    for k, (at, n) in enumerate(zip(found.column("bucket"), found.column("n"))):
        counts[at.values.to_numpy(), k] = n.values.to_numpy()
    grams = counts[:buckets] + alpha
    prior = np.log(np.maximum(counts[buckets], 1)) - np.log(max(counts[buckets].sum(), 1))
    return names, np.vstack([np.log(grams) - np.log(grams.sum(axis=0)), prior]).astype(np.float32)


def sparse_counts(texts: list[str], buckets: int):
    """The texts' counts by bucket as a sparse matrix of rows: where each row begins, then the buckets and counts of all."""
    import numpy as np

    at, ids, n = [0], [], []
    for t in texts:
        own = np.zeros(buckets, np.int64)
        blocks = list(ngram_buckets(t, buckets)) if len(t) <= BLOCK else None
        if blocks and len(blocks[0]) < buckets // 4:  # a short text: sorting its own n-grams is cheaper than a row of all buckets
            hit, times = np.unique(blocks[0], return_counts=True)
        else:
            for x in blocks or ngram_buckets(t, buckets):
                own += np.bincount(x, minlength=buckets)
            hit = np.flatnonzero(own)
            times = own[hit]
        ids.append(hit)
        n.append(times)
        at.append(at[-1] + len(hit))
    return np.array(at), np.concatenate([np.empty(0, np.int64), *ids]).astype(np.int64), np.concatenate([np.empty(0, np.int64), *n])


def log_scores(texts: list[str], matrix):
    """Texts x languages: log prior and log probabilities of all n-grams, as the product of sparse counts and the matrix, block by block."""
    import numpy as np

    buckets, out = len(matrix) - 1, np.empty((len(texts), matrix.shape[1]))
    at, ids, n = sparse_counts(texts, buckets)
    step, first = max(1, GATHERED // max(1, matrix.shape[1])), 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + step, "right")) - 1)
        part = matrix[ids[at[first] : at[last]]].astype(np.float64) * n[at[first] : at[last], None]
        # reduceat takes an empty row for one entry, so such rows are set to zero
        empty = at[first:last] == at[first + 1 : last + 1]
        sums = np.add.reduceat(np.vstack([part, np.zeros((1, part.shape[1]))]), at[first:last] - at[first], axis=0)
        sums[empty] = 0
        out[first:last] = sums + matrix[buckets]
        first = last
    return out


def predict(docs: DataFrame, model: tuple[list[str], object], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score (probability of lang_pred) of each row.

    Null texts, texts without a letter and all texts of a model without languages get `und` with score 0. Language,
    source and id are no inputs. Ties go to the first language in order; repeated rows get the same result; an empty table
    gives an empty one, and other columns, whatever their names, aren't read.
    """
    names, matrix = model
    rows = docs.select(quoted(doc_id).alias("doc_id"), held_out(quoted(doc_id)).alias("held_out"), quoted(text).alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            texts = b.column("text").to_pylist()
            told = np.flatnonzero([bool(names) and has_letter(t) for t in texts])
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            if len(told):
                total = log_scores([texts[i] for i in told], matrix)
                best[told] = total.argmax(axis=1)
                score[told] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            found = pa.array([names[k] if k >= 0 else "und" for k in best], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), found, pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
