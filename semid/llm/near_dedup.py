"""Near-duplicate groups by one-permutation MinHash and star-shaped candidate edges.

1. Each text's set of word shingles is hashed once; the hash's high bits choose one
   of ``bands * rows`` bins, whose least hash is kept. Empty bins borrow from full
   ones by optimal densification, so short texts have whole sketches too.
2. Texts of equal sets become one node. Bands of bins put nodes in buckets.
3. A bucket of any size gives a star: edges from its hub, the node that shares most
   buckets with others, to the rest, fewer than it has nodes. Edges are confirmed on the full sets, and
   confirmed links joined into components. Buckets that still hold several components
   give further turns, of several stars each, while these still link many nodes.
4. Stars can miss two nodes that are alike but not like a hub. What buckets of several
   components still hold is compared whole: all nodes outside a bucket's largest
   component with all of it whose sets may be of a size with theirs, in blocks of bounded
   size. Only pairs that may be alike
   come out of these joins, as told by 1024-bit parity bitmaps: where two sets' bitmaps
   differ in d bits, the sets differ in d shingles or more. So nothing but the bands
   can miss a link; no bucket, pair or turn is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, whole, written

#: Parts of a key that many rows hold.
SALTS = 256
#: Stars of a bucket in the second turn and later.
HUBS = 8
#: Nodes of a bucket on each side of a block.
SIDE = 4096
#: A further turn of stars is worth its while if the last one linked one in so many of the nodes left.
WORTH = 16
#: Longs of a parity bitmap.
LONGS = 16
#: Words remembered by a worker, each of up to ``LONGEST`` bytes.
REMEMBERED, LONGEST = 500_000, 64


@lru_cache(1)
def _word_hashes() -> dict:
    import xxhash

    class Hashes(dict):
        def __missing__(self, word: bytes) -> int:
            out = xxhash.xxh64_intdigest(word)
            if len(word) <= LONGEST:
                if len(self) >= REMEMBERED:
                    self.clear()
                self[word] = out
            return out

    return Hashes()


def _mix(x):
    """A bijection of 64-bit numbers that spreads all bits."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: int):
    """Sorted distinct 64-bit hashes of the text's shingles: words are runs without white space, A-Z in lower case; a text of fewer words is one shingle."""
    import numpy as np

    found = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(_word_hashes().__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


@lru_cache(2)
def _probes(bins: int):
    """For each attempt and bin, the bin to borrow from."""
    import numpy as np

    n = np.arange(64 * bins, dtype=np.uint64).reshape(64, bins)
    return (_mix(n + np.uint64(0x5851F42D4C957F2D)) % np.uint64(bins)).astype(np.int64)


def sketch(hashes, bins: int):
    """One-permutation MinHash with optimal densification: a value for each bin."""
    import numpy as np

    at = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    full, first = np.unique(at, return_index=True)  # hashes are sorted, so the first of a bin is its least
    out, has = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[full], has[full] = hashes[first], True
    empty = np.flatnonzero(~has)
    for probe in _probes(bins):
        if not len(empty):
            return out
        hit = has[probe[empty]]
        out[empty[hit]] = out[probe[empty[hit]]]
        empty = empty[~hit]
    for i in empty:  # so few are full that 64 attempts missed them: the next full bin
        out[i] = out[full[np.searchsorted(full, i) % len(full)]]
    return out


def band_keys(values, bands: int):
    """A 64-bit key for each band of the sketch, different bands having different keys."""
    import numpy as np

    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in values.reshape(bands, -1).T:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def parity_bits(hashes):
    """1024 bits as longs: each tells whether an odd number of the hashes fall on it."""
    import numpy as np

    counts = np.bincount((hashes & np.uint64(64 * LONGS - 1)).astype(np.int64), minlength=64 * LONGS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(id, row, n, set, bands, bits) of ``docs`` (id, text): row names the id and text, set the shingle set; bands and bits are null for empty sets."""
    import pyarrow as pa

    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, keys, bits = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, words)
                sizes.append(len(s))
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(band_keys(sketch(s, bands * rows), bands) if len(s) else None)
                bits.append(parity_bits(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, longs), pa.array(bits, longs)], ["id", "row", "n", "set", "bands", "bits"])

    keyed = docs.select("id", row_key("id", F.col("text")).alias("row"), "text")
    return keyed.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, row binary, n long, set binary, bands array<long>, bits array<long>")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the sorted shingle hashes of ``texts`` (row, text)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words).view("int64") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.select("row", "text").mapInArrow(run, "node binary, shingles array<long>")


def looked_up(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``left`` joined with the few rows that ``right`` has for a ``key``, of which ``left`` may have very many: these are dealt in parts by the column ``by``, and ``right``'s rows are sent once to each part that there is."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).alias("_salt")
    parts = left.select(key, salt).distinct().join(right, key)
    return left.withColumn("_salt", salt).join(parts, [key, "_salt"], how).drop("_salt")


def may_link(percent: int) -> Column:
    """Whether sizes and bitmaps allow ``node`` (n, bits) and ``a`` (n_a, a_bits) to be linked: false only for pairs that surely are not."""
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("a_bits", F.lit(i)))) for i in range(LONGS)])
    sizes = F.col("n") + F.col("n_a")
    return (F.least("n", "n_a") * 100 >= percent * F.greatest("n", "n_a")) & ((100 + percent) * (sizes - differ) >= 2 * percent * sizes)


def unordered(pairs: DataFrame) -> DataFrame:
    """Each pair of (hub, node) once, as a < b, with ``hub``: the one of them that was a hub."""
    return pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"), "hub").groupBy("a", "b").agg(F.min("hub").alias("hub"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b, hub) as (a, b, linked): whether the sets (node, shingles) are alike enough. A hub's set is sent once to each part of its pairs; the other's meets its pairs in a sort-merge join, whose large keys Spark divides."""
    other = F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    with_other = pairs.withColumn("other", other).join(sets.select(F.col("node").alias("other"), F.col("shingles").alias("of_other")), "other")
    both = looked_up(with_other, sets.select(F.col("node").alias("hub"), F.col("shingles").alias("of_hub")), "hub", by="other")
    alike = (100 + percent) * F.size(F.array_intersect("of_hub", "of_other")) >= percent * (F.size("of_hub") + F.size("of_other"))
    return both.select("a", "b", alike.alias("linked"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``links`` (a, b) reaches. Labels spread along links and jump to their labels' labels; each round is a table."""
    links = links.select("a", "b").where("a <> b")
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = looked_up(both, labels.select(F.col("node").alias("b"), "component"), "b", by="a").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        stepped = labels.join(near, "node").select("node", F.least("component", "near").alias("to"), F.col("component").alias("before"))
        jumped = looked_up(stepped, labels.select(F.col("node").alias("to"), F.col("component").alias("then")), "to", by="node").select("node", F.least("to", "then").alias("component"), "before")
        done = written(jumped, "labels")
        labels = done.select("node", "component")
        if done.where("component <> before").isEmpty():
            return labels


def _merged(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    """``labels`` after ``new`` links: components of the graph that has the old components as its nodes."""
    if labels is None:
        return components(new)
    ends = new.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    known = labels.unionByName(ends.select("node", F.col("node").alias("component")))
    of = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
    joined = looked_up(looked_up(new, of("a"), "a", by="b"), of("b"), "b", by="a").select(F.col("a_component").alias("a"), F.col("b_component").alias("b"))
    onto = components(joined).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return written(looked_up(known, onto, "component", by="node", how="left").select("node", F.coalesce("to", "component").alias("component")), "labels")


def _hubs(members: DataFrame, hubs: int) -> DataFrame:
    """(key, hub, n_a, a_component, a_bits): of up to ``hubs`` parts of each bucket the node of the highest degree."""
    part = F.pmod(F.xxhash64("node"), F.lit(hubs)).alias("part")
    chosen = members.groupBy("key", part).agg(F.max(F.struct("degree", "node", "n", "component", "bits")).alias("hub"))
    return chosen.select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("n_a"), F.col("hub.component").alias("a_component"), F.col("hub.bits").alias("a_bits"))


def size_class(n: Column, percent: int) -> Column:
    """Sets that may be linked are in the same class of sizes or in neighbouring ones: a class is a little wider than the largest ratio of linked sets' sizes."""
    return F.floor(F.ln(n) / (max(math.log(100 / percent), 1e-3) * 1.0001)).cast("int")


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, node) of all ``members`` that share a bucket, but not a component, and may be linked.

    Nodes outside a bucket's largest component meet those of the bucket whose sets are in
    their own class of sizes or a neighbouring one, in blocks of about ``SIDE`` by ``SIDE``
    nodes: as many tasks as a class of the bucket needs.
    """
    members = members.select("key", "node", "n", "bits", "component", size_class(F.col("n"), percent).alias("c"))
    held = members.groupBy("key", "component").agg(F.count("*").alias("held"))
    most = held.groupBy("key").agg(F.max(F.struct("held", "component")).alias("most")).select("key", F.col("most.component").alias("most"))
    rows = written(looked_up(members, most, "key", by="node"), "across")
    parts = lambda n: F.ceil(n / SIDE).cast("int")
    sizes = rows.groupBy("key", "c").agg(parts(F.count_if(F.col("component") != F.col("most"))).alias("p"), parts(F.count("*")).alias("q"))
    meet = sizes.where("p > 0").select("key", "c", "p", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("d"))
    meet = meet.join(sizes.select("key", F.col("c").alias("d"), "q"), ["key", "d"])
    one = F.struct(F.col("c").alias("c"), "d", "p", "q")
    of_few, of_all = (meet.groupBy("key", F.col(side).alias("c")).agg(F.collect_list(one).alias("meets")) for side in ("c", "d"))  # three at most
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    def met(nodes: DataFrame, own: DataFrame) -> DataFrame:
        named = nodes.withColumn("class", F.struct("key", "c"))
        keyed = own.select(F.struct("key", "c").alias("class"), "meets")
        return looked_up(named, keyed, "class", by="node").withColumn("m", F.explode("meets")).withColumns({"c": F.col("m.c"), "d": F.col("m.d")}).drop("meets", "class")

    few = met(rows.where(F.col("component") != F.col("most")), of_few).select("key", "node", "n", "bits", "component", "most", "c", "d", part(F.col("m.p")).alias("x"), every(F.col("m.q")).alias("y"))
    whole_side = met(rows, of_all).select("key", F.col("node").alias("hub"), F.col("n").alias("n_a"), F.col("bits").alias("a_bits"), F.col("component").alias("a_component"), "c", "d", part(F.col("m.q")).alias("y"), every(F.col("m.p")).alias("x"))
    once = (F.col("a_component") == F.col("most")) | (F.col("hub") < F.col("node"))
    return few.join(whole_side, ["key", "c", "d", "x", "y"]).where((F.col("component") != F.col("a_component")) & once & may_link(percent)).select("hub", "node")


def _linked(source: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of the ``nodes`` (node, n, bands, bits) whose texts in ``source`` (id, text) are linked with others.

    A node's degree is the sum of its buckets' sizes: the text that a group's copies were
    made from shares more buckets with them than they do with each other, so it is the
    hub that confirms most links at once.
    """
    members = nodes.select("node", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(looked_up(members, sizes, "key", by="node"), "shared")
    degrees = shared.groupBy("node").agg(F.sum("size").alias("degree"))
    asked = written(nodes.join(degrees, "node").select("node", "n", "bits", "degree"), "asked")
    members = written(shared.join(asked, "node").select("key", "node", "n", "bits", "degree", F.col("node").alias("component")), "members")
    keyed = source.select(row_key("id", F.col("text")).alias("row"), "text")
    texts = keyed.join(asked.select(F.col("node").alias("row")), "row", "left_semi").groupBy("row").agg(F.first("text").alias("text"))
    sets = written(shingle_sets(texts, words), "sets")
    tested = labels = None

    def settle(pairs: DataFrame) -> int:
        """Confirms the pairs not yet tested; how many of them are links."""
        nonlocal tested, labels
        pairs = unordered(pairs)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        judged = written(confirm(pairs, sets, percent), "judged")
        new, done = judged.where("linked").select("a", "b"), judged.select("a", "b")
        tested, found = done if tested is None else tested.unionByName(done), new.count()
        if labels is None or found:
            labels = _merged(labels, new)
        return found

    turn = 0
    while True:
        hubs = written(_hubs(members, HUBS if turn else 1), "hubs")
        stars = looked_up(members, hubs, "key", by="node")
        found = settle(stars.where((F.col("component") != F.col("a_component")) & may_link(percent)).select("hub", "node"))
        # The hubs' pairs are settled and the hubs leave; so do buckets within one component.
        left = members.drop("component").join(hubs.select("key", F.col("hub").alias("node")), ["key", "node"], "left_anti")
        left = left.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = left.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
        members = written(looked_up(left, several, "key", by="node"), "members")
        nodes_left = members.select("node").distinct().count()
        if not nodes_left:
            return labels
        if turn and found * WORTH < nodes_left:
            break
        turn += 1
    settle(_across(members, percent))
    return labels


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(id, row, n, least) per row of ``docs``: ``row`` names its id and text, ``least`` the least (id, row) of its component, null ids last."""
    source = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    signed = written(signatures(source, words, bands, rows), "signatures")
    least = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    nodes = written(signed.where("n > 0").groupBy("set").agg(F.min("row").alias("node"), F.min(least).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "nodes")
    labels = _linked(source, nodes, words, percent)
    joined = nodes.select("set", "node", "least").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    leasts = joined.groupBy("component").agg(F.min("least").alias("least"))
    named = looked_up(joined.drop("least"), leasts, "component", by="node").select("set", "least")
    return looked_up(signed.select("id", "row", "n", "set"), named, "set", by="row", how="left").drop("set")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = 40, rows: int = 6) -> DataFrame:
    """Per row of ``docs``: its id, ``n_shingles``, ``component_id`` (the least id it is linked to, over any number of links) and ``kept``.

    Texts are linked when 100 * intersection >= percent * union of their shingle sets.
    Null, empty and blank texts have empty sets, are linked with nothing and stay. Equal
    texts are always linked; repeated rows that hold the least id are all kept. Null ids
    never name a component that has another id, and are kept only where all are null.
    An empty table gives no rows. Columns not named are ignored.
    """
    out = _grouped(docs, id_col, text_col, words, percent, bands, rows)
    component = F.when(F.col("n") > 0, F.col("least.id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = 40, rows: int = 6) -> DataFrame:
    """The rows of ``docs`` that stay: one row of each group, the one of the least id (of texts that share that id, one).

    Rows with null, empty and blank texts are in no group and all stay, repeated ones too.
    """
    grouped = _grouped(docs, id_col, text_col, words, percent, bands, rows)
    kept = grouped.where("n = 0 or row = least.row").groupBy(F.col("row").alias("_near_row")).agg((F.max("n") > 0).alias("_near_set"))
    named = docs.select(row_key(id_col, whole(text_col)).alias("_near_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    # Rows that agree in id and text share their name: of those in a group one stays.
    tie = F.when(F.col("_near_set"), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    return named.join(kept, "_near_row").withColumn("_near_tie", tie).dropDuplicates(["_near_row", "_near_tie"]).select(*[F.col("doc")[c].alias(c) for c in docs.columns])
