"""Token counts of whole texts, from a public tokenizer file.

Batch encoding in an Arrow function that returns lengths only, with batches balanced by bytes. Texts are cut at boundaries
where the byte-level pre-tokenizer always starts a new piece (mostly a single space between visible characters), so the count of a text is the
sum over its pieces; the pieces of a batch are encoded once each and remembered between batches, in a bounded memo.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text whose pieces are encoded together, and pieces that the memo holds before its older half goes.
BATCH_BYTES, MEMO = 2 << 20, 300_000


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The tokenizer file's content; executors get it with the function and need no local file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def safe_pieces(text: str) -> list[str]:
    """Pieces of text whose token counts add up to the text's.

    A cut lies before a single space that has a visible character on each side. The pre-tokenizer's pattern gives
    that space to the following piece, whatever the two characters are. Other white space stays inside a piece.
    """
    out: list[str] = []
    for part in text.split(" "):
        if out and part and out[-1] and _visible(out[-1][-1]) and _visible(part[0]):
            out.append(" " + part)
        elif out:
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def _visible(c: str) -> bool:
    """Surely no white space for any of the libraries; in doubt False, and no cut is made."""
    return "!" <= c <= "~" or "¡" <= c <= "ᙿ"


def counter(tokenizer_json: str, batch_bytes: int = BATCH_BYTES, memo: int = MEMO):
    """A function from texts to their numbers of tokens."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    tok.no_truncation()
    tok.no_padding()
    special = [x.content for x in tok.get_added_tokens_decoder().values()]
    encode = lambda texts: map(len, tok.encode_batch_fast(texts, add_special_tokens=False))
    young: dict[str, int | None] = {}  # of a word w: tokens of " " + w, or None where no cut may be made beside it
    old: dict[str, int | None] = {}

    def count(texts: list[str]) -> list[int]:
        nonlocal young, old
        split = [t.split(" ") for t in texts]
        need = set().union(*split) - young.keys()
        if known := need & old.keys():
            young.update((w, old[w]) for w in known)
            need -= known
        new = [w for w in need if w and _visible(w[0]) and _visible(w[-1])]
        young.update(dict.fromkeys(need))
        young.update(zip(new, encode([" " + w for w in new])))
        plain = [i for i, w in enumerate(split) if len(w) == 1 or (w[0] and _visible(w[0][-1]))]
        out: list[int | None] = [None] * len(texts)
        for i, n in zip(plain, encode([split[i][0] for i in plain])):
            try:
                out[i] = n + sum(map(young.__getitem__, split[i][1:]))
            except TypeError:
                pass
        for i, n in enumerate(out):
            if n is None:
                out[i] = sum(encode(safe_pieces(texts[i])))
        if len(young) > memo:
            young, old = {}, young
        return out

    def balanced(texts: Iterable[str]) -> list[int]:
        out: list[int] = []
        some: list[str] = []
        size = 0
        for t in texts:
            n = n_bytes(t)
            if n > batch_bytes:  # a long text is counted on its own, in runs of whole pieces
                out += count(some)
                some, size = [], 0
                out.append(sum(sum(count([run])) for run in _runs(t, batch_bytes, special)))
                continue
            some.append(t)
            size += n
            if size >= batch_bytes:
                out += count(some)
                some, size = [], 0
        return out + count(some)

    return balanced


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


#: Where a cut can't change the tokens: before a single space between visible characters; between an ASCII letter and a
#: digit; after either of these, before other visible ASCII; between an ideograph and an ideographic or full-width stop or comma.
SAFE = re.compile("(?<=[!-~\u00a1-\u167f])(?= [!-~\u00a1-\u167f])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[!-/:-@\\[-`{-~])|(?<=[\u4e00-\u9fff])(?=[\u3001\u3002\uff0c\uff01\uff1f])")


def _runs(text: str, size: int, special: Iterable[str] = ()) -> Iterator[str]:
    """Consecutive runs of about size bytes, cut at safe boundaries and in no special string; a run without any, one word to the tokenizer, is whole."""
    width = max(1, size * len(text) // max(1, n_bytes(text)))
    start, at = 0, width
    while cut := SAFE.search(text, at):
        at = cut.start()
        if any(s in text[max(start, at - len(s) + 1) : at + len(s) - 1] for s in special):
            at += 1
            continue
        yield text[start:at]
        start, at = at, at + width
    yield text[start:]


def token_counts(docs: DataFrame, tokenizer_json: str, limit: int = 512, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row.

    Null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each; an empty table gives an empty one.
    Other columns, whatever their names, aren't read. Special strings inside a text are handled as the tokenizer file
    says. No shuffle: rows are counted where they are read.
    """
    rows = docs.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        count = counter(tokenizer_json)
        for b in batches:
            texts = b.column("text")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(count(x.as_py() for x in texts), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
