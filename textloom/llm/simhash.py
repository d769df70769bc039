"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2 bits share a variant that differs from each in at most 1. So every distinct
fingerprint emits itself and its one-bit variants, rows are grouped by variant, and each group yields a star of links
to its smallest member: as many links as members, and the same components as all pairs. A group is carried as a bit
mask (which bit was flipped tells the member), so the aggregate has a fixed width and no group is ever collected.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import connected_components, discard, if_small, materialize, quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Shingles that are hashed and added up at once; bounds the memory for very long texts.
BLOCK = 1 << 13
#: Bytes whose words are hashed in one sum, and distinct shingles that count as one member where texts are dealt to blocks.
TEXT, SHINGLES = 1 << 16, 1 << 12
#: Members of a group that are compared in one task, and those (on average) that are in all blocks of a larger group.
MEMBERS, PIVOTS = 2048, 16
#: Bits of the numbers of components, twice which fit beside a mask of 32 bits, and the largest components that get one.
LABEL_BITS, LABELS = 15, 1 << 14


def mixed(h):
    """uint64 values mixed bit by bit; one to one."""
    import numpy as np

    m = h * np.uint64(0xBF58476D1CE4E5B9)
    m = (m ^ (m >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return m ^ (m >> np.uint64(31))


def bit_counts(hashes, words: int):
    """How often each of the 64 * words bits is set; hashes: uint64. Word k > 0 is the hash mixed again."""
    import numpy as np

    h = np.repeat(hashes[:, None], words, axis=1)
    if words > 1:
        k = np.arange(1, words, dtype=np.uint64)
        with np.errstate(over="ignore"):
            h[:, 1:] = mixed(h[:, 1:] ^ (k * np.uint64(0x9E3779B97F4A7C15)))
    bits = np.unpackbits(np.ascontiguousarray(h, dtype="<u8").view(np.uint8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte, which is several times faster
    total = bits[whole:].sum(axis=0, dtype=np.int64)
    return total + bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def shingle_hashes(text: bytes, shingle: int):
    """Arrays of at most BLOCK hashes of the text's shingles, repeats included; the one of all words if they are fewer."""
    import numpy as np
    import xxhash

    w = text.lower().split()  # bytes: A-Z alone, and the six ASCII spaces
    h64 = xxhash.xxh64_intdigest
    n = max(1, len(w) - shingle + 1) if w else 0
    for at in range(0, n, BLOCK):
        part = w[at : at + BLOCK + shingle - 1]
        if len(w) < shingle:
            hashes = [h64(b" ".join(w), 42)]
        else:
            hashes = [h64(b" ".join(x), 42) for x in zip(*(part[i:] for i in range(shingle)))]
        yield np.fromiter(hashes, np.uint64, len(hashes))


def majority(blocks, words: int):
    """int64 words of the SimHash of arrays of hashes: a bit is 1 if set in over half of them."""
    import numpy as np

    n, total = 0, np.zeros(64 * words, np.int64)
    for hashes in blocks:
        n, total = n + len(hashes), total + bit_counts(hashes, words)
    return np.packbits((2 * total > n).astype(np.uint8), bitorder="little").view("<i8")


def fingerprint(text: bytes, shingle: int, words: int = 1):
    """int64 words of the SimHash: a bit is 1 if set in over half of the shingles' hashes, repeats included."""
    return majority(shingle_hashes(text, shingle), words)


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp_0 .. fp_<words-1> (long) of each row; null or wordless text has all zeros."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fps = np.array([fingerprint(t.as_py() or b"", shingle, words) for t in texts], np.int64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(fps[:, k]) for k in range(words))], ["doc_id", *(f"fp_{k}" for k in range(words))])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"fp_{k} long" for k in range(words))]))


class Shingler:
    """From texts to the sorted distinct 64-bit hashes of each one's shingles (of all words, if they are fewer), in numpy.

    A word's hash is the sum of its bytes' values times powers of an odd number, mixed: sums over a block are added up
    once, and a word's own part is brought down by the inverse power of its place. A shingle's hash is its words' hashes,
    mixed in order. Separators are the six ASCII spaces; A-Z are lower-cased.
    """

    def __init__(self, shingle: int):
        import numpy as np

        self.shingle = shingle
        with np.errstate(over="ignore"):
            self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            powers = np.full((2, TEXT + 1), [[0x9E3779B97F4A7C15], [pow(0x9E3779B97F4A7C15, -1, 1 << 64)]], np.uint64)
            powers[:, 0] = 1
            self.up, self.down = np.cumprod(powers, axis=1, dtype=np.uint64)
        self.space = np.zeros(256, bool)
        self.space[list(b" \t\n\x0b\x0c\r")] = True
        self.values[self.space] = 0

    def words(self, text: bytes):
        """Hashes of the words and where they start, in order. Cut into blocks between words; a word longer than a block is hashed alone."""
        import numpy as np
        import xxhash

        b, at, hashes, places = np.frombuffer(text.lower(), np.uint8), 0, [], []
        while at < len(b):
            apart = self.space[b[at : at + TEXT]]
            if len(apart) == TEXT and not apart[-1]:
                if not apart.any():
                    rest = np.flatnonzero(self.space[b[at + TEXT :]])
                    end = at + TEXT + int(rest[0]) if len(rest) else len(b)
                    hashes.append(np.array([xxhash.xxh64_intdigest(b[at:end].tobytes())], np.uint64))
                    places.append(np.array([at]))
                    at = end
                    continue
                apart = apart[: int(np.flatnonzero(apart)[-1]) + 1]
            edge = np.flatnonzero(np.diff(apart, prepend=True, append=True))
            starts, ends = edge[::2], edge[1::2]
            with np.errstate(over="ignore"):
                sums = np.zeros(len(apart) + 1, np.uint64)
                np.cumsum(self.values[b[at : at + len(apart)]] * self.up[: len(apart)], out=sums[1:])
                hashes.append(mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)))
            places.append(starts + at)
            at += len(apart)
        return np.concatenate([np.empty(0, np.uint64), *hashes]), np.concatenate([np.empty(0, np.int64), *places])

    def joined(self, own, size: int):
        """Hashes of all runs of that many words."""
        import numpy as np

        n, h = len(own) - size + 1, np.uint64(size)
        with np.errstate(over="ignore"):
            for k in range(size):
                h = mixed((h ^ own[k : k + n]) + np.uint64(0x9E3779B97F4A7C15))
        return h

    def __call__(self, texts: list[bytes]) -> list:
        """The sets of the texts, which are hashed together in runs of about a block."""
        out, run, size = [], [], 0
        for t in texts:
            run.append(t)
            size += len(t)
            if size >= TEXT:
                out += self._sets(run)
                run, size = [], 0
        return out + self._sets(run)

    def _sets(self, texts: list[bytes]) -> list:
        import numpy as np

        own, places = self.words(b"\n".join(texts))
        cuts = np.searchsorted(places, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        every = self.joined(own, self.shingle) if len(own) >= self.shingle else own[:0]
        short = lambda a, b: self.joined(own[a:b], b - a) if b > a else own[:0]
        return [np.unique(every[a : b - self.shingle + 1]) if b - a >= self.shingle else short(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def set_fingerprints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """row_id, node (128-bit hash of the set of distinct shingles), n (their number) and fp (SimHash of them) of docs(row_id, text)."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        distinct = Shingler(shingle)
        for b in batches:
            fps, nodes, sizes = [], [], []
            for own in distinct([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]):
                sizes.append(len(own))
                fps.append(majority((own[i : i + BLOCK] for i in range(0, len(own), BLOCK)), words))
                nodes.append(xxhash.xxh3_128_digest(own.tobytes()))
            values = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("row_id"), *values], ["row_id", "node", "n", "fp"])

    rows = docs.select("row_id", "text")
    return rows.mapInArrow(run, f"row_id {rows.schema['row_id'].dataType.simpleString()}, node binary, n long, fp array<long>")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ball_groups(keys: DataFrame, bits: int = 64) -> DataFrame:
    """(variant, all): the distinct values of keys(key) that differ in at most 1 of their low bits from a variant, if several.

    Each value emits all variants within half the radius (bits + 1 rows of fixed width). Any two values within distance 2
    share a group, any two of a group are within distance 2, and a group has at most bits + 1 values. With a column label
    (see labels; bits up to 32, whose masks leave room for it) groups of which all values have one label are left out.
    """
    label = ["label"] if "label" in keys.columns else []
    # small rows that become many; dealt by other than the bare key, or the exchange would be merged with the one before
    spread = keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("key", F.lit(1)))
    emitted = spread.select("key", *label, F.explode(F.array(*[F.lit(i) for i in range(-1, bits)])).alias("pos"))
    flip = F.expr("if(pos < 0, 0L, shiftleft(1L, pos))")
    told = flip
    if label:  # which bits of a label are set in a value's, and which aren't: values of one label never do both
        all_bits = (1 << LABEL_BITS) - 1
        sides = F.when(F.col("label") == 0, F.lit((1 << 2 * LABEL_BITS) - 1).cast("long")).otherwise(F.col("label").bitwiseOR(F.shiftleft(F.lit(all_bits).cast("long").bitwiseXOR(F.col("label")), LABEL_BITS)))
        told = flip.bitwiseOR(F.shiftleft(sides, 32))
    groups = (
        emitted.select(F.col("key").bitwiseXOR(flip).alias("variant"), flip.alias("flip"), told.alias("told"))
        .groupBy("variant")
        .agg(F.bit_or("told").alias("mask"), F.max(F.when(F.col("flip") == 0, 1).otherwise(0)).alias("own"))
    )
    if label:
        groups = groups.where(f"(shiftright(mask, 32) & shiftright(mask, {32 + LABEL_BITS}) & {all_bits}L) != 0").withColumn("mask", F.expr(f"mask & {(1 << bits) - 1}L"))
    groups = groups.where("bit_count(mask) + own > 1")
    members = F.expr(
        f"concat(if(own = 1, array(variant), cast(array() as array<bigint>)), "
        f"transform(filter(sequence(0, {bits - 1}), i -> shiftright(mask, i) & 1L = 1L), i -> variant ^ shiftleft(1L, i)))"
    )
    return groups.select("variant", members.alias("all"))


def between(links: DataFrame, joined: DataFrame) -> DataFrame:
    """links(u, v) moved to the roots of joined(node, root), without those whose ends are joined by then."""
    joined = if_small(joined)
    for end in ("u", "v"):
        links = links.join(joined.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    return links.where("u <> v").select("u", "v").distinct()


def labels(joined: DataFrame, most: int) -> DataFrame:
    """(node, label): a number from 1 on for the nodes of each of the `most` largest components of joined(node, root).

    All other nodes have none: a label tells that nodes are joined, its absence tells nothing.
    """
    largest = joined.groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "root").limit(most)
    numbers = largest.agg(F.collect_list("root").alias("all")).select(F.posexplode("all").alias("at", "root"))
    return joined.join(F.broadcast(numbers), "root").select("node", (F.col("at") + 1).cast("long").alias("label"))  # at most `most` rows


def ball_links(keys: DataFrame, bits: int = 64) -> DataFrame:
    """(u, v): links between distinct values of keys(key) that differ in 1 or 2 of their low bits.

    Each value of a group is linked to the smallest. The links' components are those of all pairs within distance 2.
    """
    stars = ball_groups(keys, bits).select(F.array_min("all").alias("v"), F.explode("all").alias("u"))
    return stars.where("u <> v").where(hamming(F.col("u"), F.col("v")) <= 2).select("u", "v").distinct()


def first_blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows(group, node, ..) with the column pair: 0, or one block of a group of more than MEMBERS in sizes(group, size).

    A few members of such a group, told by their hash, are in all of its blocks, so a family is joined across blocks by as
    many rows as members.
    """
    large = if_small(sizes.where(F.col("size") > MEMBERS).select("group", F.ceil(F.col("size") / MEMBERS).alias("blocks"), F.ceil(F.col("size") / PIVOTS).alias("every")))
    zero = F.lit(0).cast("long")
    everywhere = F.expr("pmod(xxhash64(node, 2), every)") == 0
    blocks = F.when(F.col("blocks").isNull(), F.array(zero)).when(everywhere, F.sequence(zero, F.col("blocks") - 1)).otherwise(F.array(F.expr("pmod(xxhash64(node, 1), blocks)")))
    return rows.join(large, "group", "left").withColumn("pair", F.explode(blocks)).drop("blocks", "every")


def later_blocks(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows(group, node, weight, ..) with the column pair, for groups whose members aren't all joined by roots(node, root).

    Members of the largest component, in blocks, meet those of all others, in blocks of their own, which meet each other as
    well: any two members not joined meet in some pair. What is outside the largest component is all that is multiplied.
    """
    half = MEMBERS // 2
    known = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per = known.groupBy("group", "root").agg(F.sum("weight").alias("size"))
    told = per.groupBy("group").agg(F.max(F.struct("size", "root")).alias("main"), F.sum("size").alias("total"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    told = told.select("group", F.col("main.root").alias("top"), F.ceil(F.col("main.size") / half).alias("mains"), F.ceil((F.col("total") - F.col("main.size")) / half).alias("rest"))
    own = known.join(told, "group").withColumn("block", F.expr("if(root = top, pmod(xxhash64(node, 1), mains), mains + pmod(xxhash64(node, 1), rest))"))
    met = F.expr("if(root = top, sequence(mains, mains + rest - 1), filter(sequence(0L, mains + rest - 1), o -> o != block))")
    pairs = F.transform(met, lambda o: F.least(o, F.col("block")) * (F.col("mains") + F.col("rest")) + F.greatest(o, F.col("block")))
    return own.withColumn("pair", F.explode(pairs)).drop("root", "top", "mains", "rest", "block")


def group_links(spark: SparkSession, rows: DataFrame, sizes: DataFrame, attach, column: str, linked, name: str) -> DataFrame:
    """Written links (u, v), with the components of all links within the groups of rows(group, node, weight, ..).

    sizes(group, size) has the sums of weights; attach adds the column that linked compares (see links_within). Groups of
    more than MEMBERS meet in blocks first, and those not joined by then as far as their members are apart.
    """
    first = materialize(spark, first_blocks(rows, sizes), "group-members")
    links = materialize(spark, links_within(attach(first), column, linked).distinct(), name)
    large = sizes.where(F.col("size") > MEMBERS).select("group")
    if large.limit(1).count():
        roots = materialize(spark, connected_components(spark, links, f"{name}-joined"), f"{name}-roots")
        later = materialize(spark, later_blocks(rows.join(if_small(large), "group", "left_semi"), roots), "apart-members")
        links = materialize(spark, links.unionByName(links_within(attach(later), column, linked)).distinct(), name)
        discard(spark, roots, later)
    discard(spark, first)
    return links


def links_within(rows: DataFrame, column: str, linked) -> DataFrame:
    """(u, v): links between the members of each (group, pair) of rows(group, pair, node, column), with its components.

    linked(values) gives a function from a member's number and those of others to a mask of the others it is linked to.
    Members are reached breadth first from the smallest not yet reached, so each one meets all that nothing has reached:
    no link that joins two components is missed, and there are fewer links than members.
    """

    def components(nodes, values):
        import numpy as np

        near, left, out = linked(values), np.argsort(nodes, kind="stable"), []
        while len(left) > 1:
            head, left, front = left[0], left[1:], [left[0]]
            while front and len(left):
                hit = near(front.pop(), left)
                front += left[hit].tolist()
                out += [(nodes[x], nodes[head]) for x in left[hit] if nodes[x] != nodes[head]]
                left = left[~hit]
        return out

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def links(table):
            keys = [table.column(c).to_numpy() for c in ("group", "pair")]
            cuts = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1
            nodes, values, found = table.column("node").to_numpy(), table.column(column).combine_chunks(), []
            for a, b in zip([0, *cuts], [*cuts, len(nodes)]):
                if b - a > 1:
                    found += components(nodes[a:b], values.slice(a, b - a))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], table.schema.field("node").type) for k in (0, 1)], ["u", "v"])

        held = []  # batches of which the last group may go on
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            group, pair = b.column("group").to_numpy(zero_copy_only=False), b.column("pair").to_numpy()
            new = (group != last[0]) | (pair != last[1]) if last else np.ones(len(group), bool)
            tail = (group == group[-1]) & (pair == pair[-1])
            last = (group[-1], pair[-1])
            if not new.any():
                held.append(b)
                continue
            at = b.num_rows - int(tail.sum())  # the last group of the batch begins here
            done = [*held, b.slice(0, at)] if at or held else []
            if done:
                yield links(pa.Table.from_batches(done))
            held = [b.slice(at)]
        if held:
            yield links(pa.Table.from_batches(held))

    spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group", "pair")
    kind = rows.schema["node"].dataType.simpleString()
    return spread.sortWithinPartitions("group", "pair").select("group", "pair", "node", column).mapInArrow(run, f"u {kind}, v {kind}")


def within_bits(most: int):
    """For links_within: fingerprints (lists of words) that differ in at most that many bits."""

    def linked(values):
        import numpy as np

        fps = values.flatten().to_numpy().reshape(len(values), -1).view(np.uint64)
        return lambda i, others: np.bitwise_count(fps[others] ^ fps[i]).sum(axis=1, dtype=np.int64) <= most

    return linked


def of_shingles(similarity: float, shingle: int):
    """For links_within: texts whose sets of shingles have at least that Jaccard similarity."""
    near = within_jaccard(similarity)

    def linked(values):
        import numpy as np
        import pyarrow as pa

        distinct = Shingler(shingle)
        return near(pa.array([x.view(np.int64) for x in distinct([t or b"" for t in values.cast(pa.binary()).to_pylist()])], pa.list_(pa.int64())))

    return linked


def within_jaccard(similarity: float):
    """For links_within: sets (lists of distinct hashes) of at least that Jaccard similarity."""

    def linked(values):
        import numpy as np

        starts = values.offsets.to_numpy().astype(np.int64)
        starts = starts - starts[0]
        sizes = np.diff(starts)
        _, tokens = np.unique(values.flatten().to_numpy(), return_inverse=True)
        has = np.zeros(len(tokens) + 1, bool)

        def near(i, others):
            own = tokens[starts[i] : starts[i + 1]]
            could = np.flatnonzero(np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i]) - 1e-9)
            n = sizes[others[could]]
            ends = np.cumsum(n)
            at = np.repeat(starts[others[could]] - (ends - n), n) + np.arange(n.sum())
            has[own] = True
            both = np.concatenate([[0], np.cumsum(has[tokens[at]])])
            has[own] = False
            both = both[ends] - both[ends - n]
            hit = np.zeros(len(others), bool)
            hit[could] = both >= similarity * (n + sizes[i] - both) - 1e-9
            return hit

        return near

    return linked


def simhash_components(spark: SparkSession, docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest reachable doc_id) of each row.

    Fingerprints within 2 bits are linked, equal ones as well; rows without words have fingerprint zero and are linked
    like any other. Repeated rows and ids are kept, null ids too (a component of null ids alone has a null id). Rows
    with equal fingerprints are reduced to one node before anything is emitted; the way back is a join that Spark may
    split on the rows' side.
    """
    fps = materialize(spark, fingerprints(docs, shingle), "fingerprints")
    nodes = fps.groupBy(F.col("fp_0").alias("key")).agg(F.min("doc_id").alias("least_id"))
    roots = connected_components(spark, ball_links(nodes.select("key")), "simhash-components")
    linked = roots.join(nodes, roots.node == nodes.key).select("node", "root", "least_id")
    tops = linked.groupBy("root").agg(F.min("least_id").alias("top_id"))
    of_node = nodes.join(linked.join(tops, "root").select(F.col("node").alias("key"), "top_id"), "key", "left").select("key", F.coalesce("top_id", "least_id").alias("component_id"))
    return fps.join(of_node, fps.fp_0 == of_node.key).select("doc_id", F.lower(F.lpad(F.hex("fp_0"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 10, slices: int = 20) -> DataFrame:
    """row_id and component (smallest row_id reachable) of docs(row_id, text), for shingle sets of the given similarity.

    Each distinct shingle counts once, and rows with equal sets are one node. 64 * words bits of SimHash find candidates;
    the first 32 * slices are cut into slices. Two nodes are candidates if a slice differs in at most 2 bits (ball hashing
    within each slice) and all bits together differ by no more than the similarity allows: a Jaccard similarity j is a
    cosine of 2j/(1+j) or more, and the share of differing bits is its angle over pi; three standard deviations of that
    estimate are added. Every two members of a slice value, and then of a variant whose members aren't all joined by then,
    meet within a task unless links join them already (group_links). The texts of nodes that candidates join meet in the
    same way, once for each component of candidates, and are linked by the exact Jaccard similarity of their sets.

    Null and wordless texts have the empty set and are one node; rows that repeat a row_id get the same component; null
    ids are passed over as the smallest unless a component has no others; an empty table gives an empty one.
    """
    import math

    bits = 64 * words
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most = round(bits * share + 3 * math.sqrt(bits * share * (1 - share)))
    sets = materialize(spark, set_fingerprints(docs, shingle, words), "set-fingerprints")
    whole = materialize(spark, sets.groupBy("node").agg(F.min("row_id").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp")), "distinct-sets")
    parts = [F.expr(f"shiftleft({n}L, 32) | (shiftright(fp[{n // 2}], {32 * (n % 2)}) & 4294967295L)") for n in range(slices)]
    sliced = whole.select("node", F.explode(F.array(*parts)).alias("key"))
    counted = materialize(spark, sliced.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "slice-values")
    fps = whole.select("node", "fp")

    def links(groups: DataFrame, name: str) -> DataFrame:
        """Written candidate links of groups(group, key): all members of the keys of a group meet."""
        meet = if_small(groups)
        sizes = materialize(spark, counted.join(meet, "key").groupBy("group").agg(F.sum("n").alias("size")), "group-sizes")
        members = sliced.join(meet, "key").select("group", "node", F.lit(1).cast("long").alias("weight"))
        found = group_links(spark, members, sizes, lambda rows: rows.join(fps, "node"), "fp", within_bits(most), name)
        discard(spark, sizes)
        return found

    def labelled(joined: DataFrame, slices: list[Column]) -> DataFrame:
        """(key, label): of each value of the slices, the label that all of its nodes have, else 0."""
        own = whole.select("node", "fp").join(labels(joined, LABELS), "node", "left").select(F.coalesce("label", F.lit(0).cast("long")).alias("label"), F.explode(F.array(*slices)).alias("key"))
        return own.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).select("key", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.lit(0).cast("long")).alias("label"))

    # nodes that share a slice value first, then those under one variant: by the leading slices, and by the others where
    # a variant's members aren't joined by then. The variants are told so while they are grouped, so what a family has
    # joined is never written. Components without a label come back under their variants, which adds no link.
    candidates = links(counted.where("n > 1").select(F.col("key").alias("group"), "key"), "same-links")
    lead = max(1, slices // 4)
    for start, end in ((0, lead), (lead, slices)):
        if start == end:
            continue
        joined = materialize(spark, connected_components(spark, candidates, "candidates"), "joined")
        of_key = materialize(spark, labelled(joined, parts[start:end]), "slice-labels")
        near = materialize(spark, ball_groups(of_key, 32).select(F.col("variant").alias("group"), "all"), "slice-groups")
        # any two values meet under just two variants, so a group of two is needed once, and not beside a larger group of both
        both = F.col("all")[0].bitwiseXOR(F.col("all")[1])
        two = near.where("size(all) = 2").select("group", "all", F.col("group").bitwiseXOR(both).alias("other"))
        two = two.where("group < other").join(near.where("size(all) = 2").select(F.col("group").alias("other")), "other", "left_semi")
        groups = near.where("size(all) > 2").unionByName(two.select("group", "all"))
        groups = materialize(spark, groups.select("group", F.explode("all").alias("key")), "open-groups")
        # stars stand for the links found so far, so components aren't found again from all of them nor from links within them
        candidates = joined.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(between(links(groups, "near-links"), joined))
        discard(spark, of_key, near, groups)
    joined = materialize(spark, connected_components(spark, candidates, "candidates").select("node", F.col("root").alias("group")), "candidate-groups")
    discard(spark, counted)
    joined = joined.join(whole.select("node", "row", "n"), "node")
    rows = materialize(spark, joined.select("group", "node", "row", F.greatest(F.lit(1), F.ceil(F.col("n") / SHINGLES)).cast("long").alias("weight")), "candidate-rows")
    sizes = materialize(spark, rows.groupBy("group").agg(F.sum("weight").alias("size")), "candidate-sizes")
    texts = docs.select("row_id", "text").join(if_small(rows.select("row").distinct()), F.col("row_id").eqNullSafe(F.col("row"))).groupBy("row").agg(F.first("text").alias("text"))
    with_text = lambda met: met.join(texts, met.row.eqNullSafe(texts.row)).select("group", "pair", "node", "text")
    roots = connected_components(spark, group_links(spark, rows, sizes, with_text, "text", of_shingles(similarity, shingle), "text-links"), "near-components")
    discard(spark, rows, sizes)
    linked = whole.select("node", "row").join(roots, "node")
    tops = linked.groupBy("root").agg(F.min("row").alias("top"))
    of_node = linked.join(tops, "root").select("node", "top")
    kept = whole.join(of_node, "node", "left").select("node", F.coalesce("top", "row").alias("component"))
    return sets.select("row_id", "node").join(kept, "node").select("row_id", "component")
