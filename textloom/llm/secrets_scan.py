"""Secrets in texts: fixed patterns, and password-like values judged by the cost of guessing them.

The base patterns find assignments, access keys and long hex strings. Beyond those, every value in a credential context
(more key words and characters than the base pattern allows) is cut into words, dates, repeats, keyboard walks and
brute-force spans by a dynamic program that minimises the number of guesses; a value whose cheapest cut is still costly
is reported as kind `guess`, placeholders such as `changeme` or `xxxxxxxx` aren't.
"""

from __future__ import annotations

import json
import math
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a value counts as a secret.
MIN_GUESSES = 8.0
#: Frequent words of passwords and placeholders, most frequent first; a word's guesses are its rank.
WORDS = """password passwd secret token admin example changeme test user login welcome letmein qwerty abc dragon master
monkey shadow sunshine princess football baseball iloveyou trustno superman batman hello freedom whatever default guest
root system server database access public private key value your here none null true false empty string placeholder
sample demo dummy temp foo bar baz pass word my the and for this that is to insert enter replace redacted hidden xxx
api auth bearer client id name email service account prod production dev development staging local host config env
variable required optional http https www com org net""".split()
#: log10 of the ways to begin a further segment, a date, a year, a walk's first key and a walk's turn.
STEP, DATE, YEAR, KEY_STARTS, TURN_WAYS = map(math.log10, (2, 365 * 120, 120, 47, 5))
#: Rows of keys, each set off by half a key from the one above.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")


def frequent_words(tokenizer_json: str | None = None) -> dict[str, int]:
    """Word to rank: WORDS, then the whole words of a byte-level tokenizer's vocabulary (ASCII letters, three or more) in its order.

    Such a vocabulary is built from the most frequent strings on, so its order is close to that of frequency.
    """
    vocabulary = json.loads(tokenizer_json)["model"]["vocab"] if tokenizer_json else {}
    more = (t[1:].lower() for t in sorted(vocabulary, key=vocabulary.get) if t.startswith("Ġ") and t[1:].isascii() and t[1:].isalpha() and len(t) > 3)
    return {w: rank for rank, w in enumerate(dict.fromkeys([*WORDS, *more]), 1)}


def patterns():
    import re

    i = re.IGNORECASE | re.ASCII
    return {
        "hint": re.compile(r"passw|secret|token|api_?key|pwd|passphrase|credential|bearer|auth|private_?key|access_?key", i),
        "assign": re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", i),
        # runs of 20 and 24 characters: the same matches as all runs, the short ones dropped
        "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
        "hex": re.compile(r"[0-9a-f]{24,}"),
        "context": re.compile(r"(?:passw(?:or)?d|passphrase|pwd|secret|token|credentials?|bearer|auth|(?:api|private|access)_?key)[\"']?\x20{0,8}(?:[:=]|\x20is\x20)\x20{0,8}[\"']?([^\s\"']{6,})", i),
        "dates": [
            (re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])", re.ASCII), DATE),
            (re.compile(r"(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d", re.ASCII), DATE),
            (re.compile(r"(?:19|20)\d\d", re.ASCII), YEAR),
        ],
    }


class _Stretch:
    """Segments of any length along a stretch of which the cost is a part known at the start plus log10 of their length.

    A later start is of use only if it is cheaper than all former ones at the first end it can have: what it is short of
    grows with the length. So few starts are kept, and a stretch of any length takes about linear time.
    """

    def __init__(self, least: int, unit: int = 1):
        self.least, self.unit, self.starts = least, unit, []

    def clear(self) -> None:
        self.starts = []

    def add(self, i: int, cost: float) -> None:
        if cost + math.log10(self.least // self.unit) < self.best(i + self.least):
            self.starts.append((i, cost))

    def best(self, j: int) -> float:
        return min((c + math.log10((j - i) // self.unit) for i, c in self.starts if j - i >= self.least), default=math.inf)

    def alive(self) -> float:
        return min((c for _, c in self.starts), default=math.inf)


def _turns(low: str, near: dict) -> tuple[list[int], list[int]]:
    """Of each place: where the keyboard walk that ends there began, and how often walks have turned up to there."""
    began, turns, way = [0] * len(low), [0] * len(low), None
    for k in range(1, len(low)):
        now = near.get((low[k - 1], low[k]))
        began[k] = began[k - 1] if now else k
        turns[k] = turns[k - 1] + bool(now and way and now != way)
        way = now
    return began, turns


def keyboard(rows: tuple[str, ...] = ROWS) -> dict[tuple[str, str], tuple[int, int]]:
    """Pairs of neighbouring keys and the direction from one to the other; a row is set off by half a key."""
    at = {c: (r, k) for r, row in enumerate(rows) for k, c in enumerate(row)}
    step = [(0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)]
    return {(a, b): (r, k) for a, (ra, ka) in at.items() for b, (rb, kb) in at.items() for r, k in step if (rb - ra, kb - ka) == (r, k)}


KEYS = keyboard()
CLASS_SIZES = (10, 26, 33)


def char_cost(c: str) -> float:
    return math.log10(CLASS_SIZES[0] if c.isdigit() else CLASS_SIZES[1] if c.isalpha() else CLASS_SIZES[2])


def word_cost(piece: str, words: dict[str, int]) -> float:
    """log10 of the word's rank, doubled if its case varies; infinite for other strings."""
    low = piece.lower()
    rank = words.get(low)
    return math.inf if rank is None else math.log10(rank + 1) + (0 if piece in (low, low.upper(), low.capitalize()) else STEP)


def guess_cost(value: str, words: dict[str, int], dates, enough: float = math.inf, width: int | None = None) -> float:
    """log10 of the guesses for the cheapest segmentation of value, or a lower bound of it that is `enough` or more.

    A segment is a listed word (its rank; doubled if its case varies), a date (365 * 120) or year (120), a unit of one to three
    characters that repeats (the unit's characters, times the number of repeats), a walk over neighbouring keys or along
    the alphabet of three or more characters (47 starts * length * 5 for each turn), or a span of brute force (the product
    of its characters' classes). Every further segment doubles the guesses. No segment has a greatest length.

    left[i] is the least cost of value[:i]. Words and dates are looked up at every start; repeats and walks of any length
    are held by the few starts that can still be cheapest. Costs only grow, so once everything that may still be extended
    costs enough, the whole value does. width: the length of the longest word, if it is known.
    """
    n, low = len(value), value.lower()
    width = max(map(len, words), default=0) if width is None else width
    began, turns = _turns(low, KEYS)
    repeats = {(u, k): _Stretch(2 * u, u) for u in (1, 2, 3) for k in range(u)}
    walk, rise, fall = _Stretch(3), _Stretch(3), _Stretch(3)
    left, forced = [math.inf] * (n + 1), [math.inf] * (n + 1)  # forced: those that end in a span of brute force
    left[0] = 0.0

    for i in range(n + 1):
        # segments that end here
        if i:
            for u in (1, 2, 3):
                left[i] = min(left[i], repeats[u, i % u].best(i))
            left[i] = min(left[i], walk.best(i) + turns[i - 1] * TURN_WAYS, rise.best(i), fall.best(i), forced[i])
        if i == n:
            break
        if min(left[max(0, i - max(width, 10)) : i + 1] + [s.alive() for s in (*repeats.values(), rise, fall)] + [walk.alive() + (turns[i - 1] if i else 0) * TURN_WAYS]) >= enough:
            return enough
        at = left[i]
        here = at + (STEP if i else 0)
        # stretches that go no further than this place
        if i:
            for u in (1, 2, 3):
                if i >= u and value[i] != value[i - u]:
                    for k in range(u):
                        repeats[u, k].starts = [x for x in repeats[u, k].starts if x[0] > i - u]
            if began[i] == i:
                walk.clear()
            way = ord(low[i]) - ord(low[i - 1]) if low[i - 1].isalnum() and low[i].isalnum() else 0
            if way != 1:
                rise.clear()
            if way != -1:
                fall.clear()
        if at < math.inf:
            forced[i + 1] = min(forced[i + 1], here + char_cost(value[i]))
            for u in (1, 2, 3):
                if i + 2 * u <= n and (unit := value[i : i + u]) == value[i + u : i + 2 * u]:
                    if i < u or value[i - u : i] != unit:  # former starts end before this one's first end
                        repeats[u, i % u].clear()
                    repeats[u, i % u].add(i, here + sum(map(char_cost, unit)))
            if i + 3 <= n:
                if began[i + 2] <= i:
                    turned = turns[i + 1] if i + 1 < n else 0
                    walk.add(i, here + KEY_STARTS - turned * TURN_WAYS)
                ways = {ord(b) - ord(a) for a, b in zip(low[i : i + 2], low[i + 1 : i + 3])}
                if low[i : i + 3].isalnum() and ways == {1}:
                    rise.add(i, here + KEY_STARTS)
                elif low[i : i + 3].isalnum() and ways == {-1}:
                    fall.add(i, here + KEY_STARTS)
            if value[i].isdigit():
                for date, cost in dates:
                    if m := date.match(value, i):
                        left[m.end()] = min(left[m.end()], here + cost)
            for j in range(i + 3, min(n, i + width) + 1):
                if low[i:j] in words:
                    left[j] = min(left[j], here + word_cost(value[i:j], words))
        if i and forced[i] < math.inf:
            forced[i + 1] = min(forced[i + 1], forced[i] + char_cost(value[i]))
    return left[n]


def scanner(min_guesses: float = MIN_GUESSES, words: dict[str, int] | None = None):
    """A function from a text to its spans (start, kind number, end), in order; offsets are code points."""
    p = patterns()
    words = frequent_words() if words is None else words
    width = max(map(len, words), default=0)

    def scan(text: str) -> list[tuple[int, int, int]]:
        out = []
        if p["hint"].search(text):
            out += [(m.start(), 0, m.end()) for m in p["assign"].finditer(text) if len(m[2]) >= 6]
            for m in p["context"].finditer(text):
                if guess_cost(m[1], words, p["dates"], min_guesses, width) >= min_guesses:
                    out.append((m.start(1), 3, m.end(1)))
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in p["access"].finditer(text)]
        out += [(m.start(), 2, m.end()) for m in p["hex"].finditer(text)]
        return sorted(out)

    return scan


def secret_spans(docs: DataFrame, min_guesses: float = MIN_GUESSES, words: dict[str, int] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and spans, an array of (kind, start, end), of each row, clean rows included.

    Null text counts as empty and has no spans. Overlapping spans of different kinds are all reported. Repeated rows
    are scanned each; other columns, whatever their names, aren't read; a value of any length is judged and reported whole.
    """
    rows = docs.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    span = "array<struct<kind:string,start:int,end:int>>"
    words = frequent_words() if words is None else words

    def run(batches):
        import pyarrow as pa

        scan = scanner(min_guesses, words)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t.as_py())] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {span}")


def span_digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, comma-joined) of secret_spans."""
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return spans.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
