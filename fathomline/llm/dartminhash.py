"""Near-duplicates by DartMinHash signatures, banded joining and exact confirmation.

A text is a weighted set: its five-word shingles with their counts. Each (shingle, copy) has a
column of unit width in which darts fall at random heights, one per unit of height on average, all
by hash, so every text sees the same darts. A text takes the darts in its columns up to a height
that gives about k(ln k + 5) of them; each dart belongs to one of k coordinates, and the lowest in
each coordinate is kept. Two texts agree in a coordinate with their weighted Jaccard similarity as
probability, and the work is linear in the text plus k log k. A text that leaves a coordinate empty
is done again with twice the height.

Texts with the same words are one node. The k = 128 coordinates make 32 bands of 4: a pair of
similarity 0.8 meets in a band but for 5 in 100 million cases. Buckets are resolved without
emitting their pairs:

* In each bucket the hub is the member that meets most others over all its buckets, in a group of
  copies the one nearest to what they have in common. Each text is compared with the hub that it
  meets most often; a pair is a link if the exact similarity of the multisets reaches the threshold.
* Buckets whose members are one component by now are done. Texts of the others are joined exactly
  by prefix filtering: with the shingles in the order of their frequency among these texts, two texts
  of similarity t share one within the first (1 - t) n + 1 of each, at places that leave room for
  the overlap. Edits make rare shingles, so texts that are too far from all others have nothing to
  share and cost nothing. Only texts of different components are compared, so no bucket size is
  capped and no link between components is lost. Within that join, bounds that are exact drop
  pairs before any element is fetched: sizes, places, and 256-bit parity sketches, which differ in
  no more bits than the texts differ in elements.

Defined cases: a text of under five words has one shingle, all its words; a text without words (or
null) is a class of its own; repeated rows and ids are fine, each row being in its text's class;
null ids sort first; an empty table gives an empty result. A class's id is its least document id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import words as W
from fathomline.llm.common import materialize, text_key
from fathomline.llm.components import components

SHINGLE, SIMILARITY, K, BANDS = 5, 0.8, 128, 32
#: Cells that are looked at together.
CELLS = 1 << 18
_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate(([1.0], np.arange(1, 25)))))


def whole_texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, word hash) of all words, a text never in two parts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for rows, at, hashes in W.blocks(column):
        if not len(rows):  # white space only: it may lie within a text
            continue
        if held and at[0] == 0:
            yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held = []
        held.append((rows, hashes))
    if held:
        yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def elements(rows: np.ndarray, hashes: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, W.Prefix]:
    """Texts with words; each element's text (as a number in these); the elements; the words' sums.

    An element is a shingle with the number of its copy, so that sets of elements are multisets of shingles.
    """
    texts, first = np.unique(rows, return_index=True)
    count = np.diff(np.append(first, len(rows)))
    sums = W.Prefix(hashes)
    n = np.maximum(count - shingle + 1, 1)
    owner = np.repeat(np.arange(len(texts)), n)
    start = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    h = sums.of(start, start + np.minimum(count, shingle)[owner])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    copy = np.arange(len(h)) - begin[np.cumsum(new) - 1]
    return texts, owner, W.mix(h + copy.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), sums


def _throw(owner: np.ndarray, element: np.ndarray, height: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (texts, k) and which coordinates have a dart, for darts up to each text's height."""
    cells = np.ceil(height[owner]).astype(np.int64)
    which = np.repeat(np.arange(len(owner)), cells)
    cell = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
    seed = W.mix(element[which] ^ (cell.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
    darts = np.searchsorted(_POISSON, (seed >> np.uint64(11)) * 2.0**-53, side="right")
    at = np.repeat(np.arange(len(which)), darts)
    number = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = W.mix(seed[at] + (number + 1).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    rank = cell[at] + (dart >> np.uint64(11)) * 2.0**-53
    text = owner[which[at]]
    low = rank <= height[text]
    dart, rank, text = dart[low], rank[low], text[low]
    name = W.mix(dart ^ np.uint64(0x8EBC6AF09C88C6E3))
    place = text * k + (name % np.uint64(k)).astype(np.int64)
    down = np.argsort(-rank, kind="stable")
    signature, filled = np.zeros(texts * k, np.uint64), np.zeros(texts * k, bool)
    signature[place[down]] = name[down]
    filled[place] = True
    return signature.reshape(texts, k), filled.reshape(texts, k)


def signatures(owner: np.ndarray, element: np.ndarray, texts: int, k: int) -> np.ndarray:
    """The DartMinHash signature of each text; ``owner`` ascends."""
    size = np.bincount(owner, minlength=texts)
    begin = np.concatenate(([0], np.cumsum(size)))
    height = k * (np.log(k) + 5) / np.maximum(size, 1)
    out = np.zeros((texts, k), np.uint64)
    todo = np.arange(texts)
    while len(todo):
        cost = np.cumsum(np.ceil(height[todo]) * size[todo])
        again, lo = [], 0
        while lo < len(todo):
            hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + CELLS, side="right")))
            part = todo[lo:hi]
            n = size[part]
            own = np.repeat(np.arange(len(part)), n)
            pick = begin[part][own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            got, filled = _throw(own, element[pick], height[part], len(part), k)
            out[part] = got
            again.append(part[~filled.all(1)])
            lo = hi
        todo = np.concatenate(again)
        height[todo] *= 2
    return out


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    texts, k = signature.shape
    rows = signature.reshape(texts, bands, k // bands)
    out = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x589965CC75374CC3)
    for i in range(k // bands):
        out = W.mix(out + rows[:, :, i])
    return out


SIGNED = "doc long, key long, f1 long, f2 long, n long, bands array<long>"


def _sign(shingle: int, k: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, hashes in whole_texts(batch.column(2)):
                if not len(rows):
                    continue
                texts, owner, element, sums = elements(rows, hashes, shingle)
                first = np.searchsorted(rows, texts)
                last = np.append(first[1:], len(rows))
                other = W.Prefix(W.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)))
                banded = band_hashes(signatures(owner, element, len(texts), k), bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, banded.size + 1, bands), pa.int32()), pa.array(banded.reshape(-1).view(np.int64)))
                take = pa.array(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(sums.of(first, last).view(np.int64)), pa.array(other.of(first, last).view(np.int64)), pa.array(np.bincount(owner)), lists],
                    ["doc", "key", "f1", "f2", "n", "bands"],
                )

    return run


SKETCH = ["s0", "s1", "s2", "s3"]


def sketches(element: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """For each text 256 bits in four words: bit i says if an odd number of its elements hash to i.

    Each element that one of two texts has alone flips one bit, so where the sketches of two texts
    differ in d bits, at least d elements are in one of them alone.
    """
    place = element >> np.uint64(56)
    bit = np.uint64(1) << (place & np.uint64(63))
    return [np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == w, bit, np.uint64(0)), begins) for w in range(4)]


def _elements(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, hashes in whole_texts(batch.column(1)):
                if not len(rows):
                    continue
                texts, owner, element, _ = elements(rows, hashes, shingle)
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner)))).astype(np.int32)
                parity = [pa.array(x.view(np.int64)) for x in sketches(element, ends[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(texts)), *parity, pa.ListArray.from_arrays(pa.array(ends), pa.array(element.view(np.int64)))], ["node", *SKETCH, "elements"])

    return run


def _judged(pairs: DataFrame, weighed: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    one, two = (weighed.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("elements").alias(f"e{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b")
    inter = F.size(F.array_intersect("ea", "eb")).cast("long")
    return both.where(inter >= similarity * (F.col("na") + F.col("nb") - inter)).select("a", "b")


def _hub_pairs(live: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """Each node with the hub that it meets in most buckets; ``live`` has (bucket, node)."""
    # sums are written as tables: a join of two exchanges splits a bucket that many texts share
    count = materialize(live.groupBy("bucket").agg(F.count("*").alias("c")), "sizes")
    popular = live.join(count, "bucket").groupBy("node").agg(F.sum("c").alias("p"))
    hubs = live.join(popular, "node").groupBy("bucket").agg(F.max(F.struct("p", "node")).alias("h")).select("bucket", F.col("h.p").alias("p"), F.col("h.node").alias("hub"))
    hubs = materialize(hubs, "hubs")
    met = live.join(hubs, "bucket").where("node != hub").groupBy("node", "hub").agg(F.count("*").alias("met"), F.max("p").alias("p"))
    near = met.join(sizes.select("node", "n"), "node").join(sizes.select(F.col("node").alias("hub"), F.col("n").alias("nh")), "hub")
    near = near.where(F.least("n", "nh") >= similarity * F.greatest("n", "nh"))
    return near.groupBy("node").agg(F.max(F.struct("met", "p", "hub")).alias("best")).select(F.col("node").alias("a"), F.col("best.hub").alias("b"))


def _prefix_pairs(rest: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different labels that may reach the threshold; ``rest`` has (node, label, n, elements)."""
    each = rest.select("node", F.explode("elements").alias("e"))
    shared = materialize(each.groupBy("e").agg(F.count("*").alias("f")).where("f > 1"), "shared")
    # a text with too few shared shingles has no partner; those of one text alone come first in its order
    own = each.join(shared, "e").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("s"))
    own = own.join(rest.select("node", "label", "n", *SKETCH), "node").where(F.size("s") >= similarity * F.col("n"))
    alone = F.col("n") - F.size("s")
    reach = (F.col("n") - F.ceil(similarity * F.col("n")) + 1 - alone).cast("int")
    first = own.where(reach >= 1).select("node", "label", "n", *SKETCH, alone.alias("alone"), F.posexplode(F.slice("s", 1, reach)).alias("i", "x"))
    first = materialize(first.select("node", "label", "n", *SKETCH, (F.col("alone") + F.col("i")).alias("at"), F.col("x.e").alias("e")), "prefixes")
    # under each shingle, texts of all labels but the most common one meet all others: the large group never meets itself
    by_label = first.groupBy("e", "label").agg(F.count("*").alias("c"))
    major = by_label.groupBy("e").agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1").select("e", F.col("m.label").alias("major"))
    major = materialize(major, "majors")
    minor = first.join(major, "e").where("label != major").select("e", "node", "label", "n", *SKETCH, "at", "major")
    x, y = minor.alias("x"), first.alias("y")
    room = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))  # of the first shingle that both share, all others lie beyond it
    least = F.ceil(similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-6)
    apart = [F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in SKETCH]
    fits = (F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n")) & (room >= least) & (sum(apart[1:], apart[0]) <= F.col("x.n") + F.col("y.n") - 2 * least)
    once = (F.col("y.label") == F.col("x.major")) | (F.col("x.node") < F.col("y.node"))  # two of the others meet both ways
    met = x.join(y, (F.col("x.e") == F.col("y.e")) & (F.col("x.label") != F.col("y.label")) & once & fits)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, k: int = K, bands: int = BANDS) -> DataFrame:
    """One row per row of ``docs``: doc, key, class_id (least doc of the class), class_key, n_texts, kept.

    ``kept`` is true for the rows whose (doc, key) is the class's own; ``n_texts`` counts the different texts of the class.
    """
    if k % bands:
        raise ValueError("bands must divide k")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    signed = materialize(keyed.mapInArrow(_sign(shingle, k, bands), SIGNED), "signatures")
    nodes = signed.groupBy("f1", "f2").agg(F.min(F.struct("doc", "key", "n", "bands")).alias("r")).select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "r.*")
    nodes = materialize(nodes, "texts")

    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = materialize(buckets.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"), "shared")
    live = materialize(buckets.join(shared, "bucket").select("bucket", "node"), "buckets")
    wanted = live.select("node").distinct().join(nodes.select("node", "doc", "key", "n"), "node")
    # repeated rows give the same elements again
    texts = keyed.join(wanted, (keyed["doc"].eqNullSafe(wanted["doc"])) & (keyed["key"] == wanted["key"])).select("node", "text")
    weighed = texts.mapInArrow(_elements(shingle), f"node long, {', '.join(f'{c} long' for c in SKETCH)}, elements array<long>").dropDuplicates(["node"])
    weighed = materialize(weighed.select("node", *SKETCH, F.size("elements").cast("long").alias("n"), "elements"), "elements")

    links = materialize(_judged(_hub_pairs(live, weighed, similarity), weighed, similarity), "links")
    labels = components(links)
    marked = live.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    mixed = marked.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket")
    mixed = materialize(mixed, "mixed")
    rest = marked.join(mixed, "bucket").select("node", "label").distinct().join(weighed, "node")
    more = _judged(_prefix_pairs(rest, similarity), weighed, similarity)
    labels = components(links.unionByName(more))

    grouped = nodes.select("node", "f1", "f2", F.struct("doc", "key").alias("own"))
    grouped = grouped.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = materialize(grouped.groupBy("label").agg(F.min("own").alias("head"), F.count("*").alias("n_texts")), "heads")
    named = grouped.join(heads, "label").select("f1", "f2", "head", "n_texts")
    with_words = signed.select("doc", "key", "f1", "f2").join(named, ["f1", "f2"]).select("doc", "key", F.col("head.doc").alias("class_id"), F.col("head.key").alias("class_key"), "n_texts")
    without = keyed.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select("doc", "key", F.col("doc").alias("class_id"), F.col("key").alias("class_key"), F.lit(1).cast("long").alias("n_texts"))
    out = with_words.unionByName(without)
    return out.withColumn("kept", F.col("doc").eqNullSafe(F.col("class_id")) & F.col("key").eqNullSafe(F.col("class_key")))
