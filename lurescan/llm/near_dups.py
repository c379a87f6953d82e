"""Near-duplicate classes by BagMinHash signatures of five-word shingles (operator 4).

A document is the multiset of its five-word shingles (of all its words, if it has fewer). Similarity is the
weighted Jaccard index of two multisets, sum of minima over sum of maxima; from ``threshold`` on two
documents are linked, and classes are the connected components of the links.

BagMinHash: the weight axis is cut into dyadic ranges (0,1], (1,2], (2,4], ...; each range of a shingle has
a Poisson process of points (time, level, component) with a rate equal to its length. Splitting a process
into halves by fair coins, again and again, is drawing the level's binary digits, so a shingle of weight w
keeps the points whose level is at most w. A signature component is the earliest kept point; two documents
agree in it with a probability equal to their weighted Jaccard index. Points are drawn in time order, and a
process stops when its time passes the latest component of its document, so most draw one or two points.

Steps, none of which gathers a group in one task or makes all pairs of one:

1. Signatures, in a pass over the texts; texts with equal words become one node.
2. ``bands`` of ``rows`` components; a bucket holds the nodes that agree in a band. At a similarity of 0.8 a
   pair shares no bucket with a chance of 5e-5 (26 bands of 5).
3. Each bucket's members are verified against its leader, on the shingles themselves. Leaders are drawn by
   hash, differently for three families of bands, so large groups get many different stars.
4. Components so far. In buckets that still hold several components, everyone outside the bucket's largest
   is verified against every member of another component. Signatures that agree in less than ``floor`` of
   their components are passed over there (for a pair at 0.8, over five standard deviations down).
5. Components again. Every linked pair that shares a bucket now lies in one class.

Rows without words are classes of their own. Null ids get a null class. Rows that repeat an id and text
repeat the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stable
from .blocks import text_bytes
from .words import gram_names, mix, word_names

_U = np.uint64
#: bytes of text whose shingles are held at once
SLICE_BYTES = 1 << 20
#: pairs verified together in one group, about, and bytes of their texts
VERIFY_PAIRS = 2_000
VERIFY_BYTES = 4 << 20
#: nodes of a bucket on each side of a block of pairs, about
CHUNK = 256


def shingles(table: pa.Table | pa.RecordBatch, text: str, size: int):
    """(document, name, weight) of distinct shingles, and a 128-bit key of each document's words."""
    data, starts = text_bytes(pa.table(table) if isinstance(table, pa.RecordBatch) else table, text)
    name, doc, _, _ = word_names(data, starts)
    gram, first = gram_names(name, doc, size)
    n_words = np.bincount(doc, minlength=len(starts) - 1)
    begins = np.cumsum(n_words) - n_words
    rank = np.arange(len(doc)) - begins[doc] if len(doc) else doc
    keys = []
    for seed in (1, 2):  # sums of place-dependent names: equal words in equal order, equal sum
        term = mix(name ^ mix((rank + 1).astype("uint64") * _U(2 * seed + 1)))
        total = np.r_[_U(0), np.cumsum(term, dtype="uint64")]
        keys.append(mix(total[begins + n_words] - total[begins] + n_words.astype("uint64")).view("int64"))
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    gram = np.concatenate([gram, keys[0][short].view("uint64")])
    where = np.concatenate([doc[first], short])
    order = np.lexsort((gram, where))
    gram, where = gram[order], where[order]
    new = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (where[1:] != where[:-1])]) if len(gram) else order
    weight = np.diff(np.r_[new, len(gram)])
    return where[new], gram[new], weight, keys, n_words


def slices(table: pa.Table | pa.RecordBatch, text: str) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of rows that hold SLICE_BYTES of text at most, or one longer text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(table.column(text)), 0), "int64")
    starts = np.r_[0, np.cumsum(sizes, dtype="int64")]
    at = 0
    while at < table.num_rows:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE_BYTES, side="right")) - 1)
        yield at, to
        at = to


def sliced_shingles(table: pa.Table, text: str, size: int):
    """(edges, name, weight): those of row i lie between its edges. Only a slice's words are held beside them."""
    counts, names, weights = [np.zeros(1, "int64")], [np.zeros(0, "uint64")], [np.zeros(0, "int32")]
    for at, to in slices(table, text):
        doc, name, weight, _, _ = shingles(table.slice(at, to - at), text, size)
        counts.append(np.bincount(doc, minlength=to - at))
        names.append(name)
        weights.append(weight.astype("int32"))
    return np.cumsum(np.concatenate(counts)), np.concatenate(names), np.concatenate(weights)


def signatures(doc: np.ndarray, name: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """BagMinHash: uint32 array (docs, size); rows of documents without shingles are unused."""
    # one process per shingle and dyadic range that begins below its weight
    ranges = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype("int64"), 0) + 1
    owner = np.repeat(np.arange(len(doc)), ranges)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    rate = np.where(k > 0, 2.0 ** (k - 1), 1.0)
    base = np.where(k > 0, rate, 0.0)
    state = mix(mix(name)[owner] ^ k.astype("uint64") * _U(0xA24BAED4963EE407))
    keep = (weight[owner] - base) / rate  # the part of the range that lies below the weight; over 1: all
    place = doc[owner] * size
    time = np.zeros(len(owner))
    best = np.full(docs * size, np.inf)
    while len(state):
        state = mix(state + _U(0xD1B54A32D192ED03))
        time = time - np.log(((state >> _U(11)).astype("float64") + 0.5) * 2.0**-53) / rate
        point = mix(state ^ _U(0x2545F4914F6CDD1D))
        kept = ((point >> _U(32)).astype("float64") + 0.5) * 2.0**-32 < keep
        at = place[kept] + ((point[kept] & _U(0xFFFFFFFF)) * _U(size) >> _U(32)).astype("int64")
        np.minimum.at(best, at, time[kept])
        latest = best.reshape(docs, size).max(axis=1)
        go = time < latest[place // size]
        state, time, rate, keep, place = state[go], time[go], rate[go], keep[go], place[go]
    return (mix(best.view("uint64")) >> _U(32)).astype("uint32").reshape(docs, size)


def signed(docs: DataFrame, id_column: str, text: str, bands: int, rows: int, shingle: int) -> DataFrame:
    """``id, mark, n_words, k1, k2, signature``; mark tells rows that share an id but not a text."""
    size = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch, "text"):
                part = batch.slice(at, to - at)
                doc, name, weight, keys, n_words = shingles(part, "text", shingle)
                out = signatures(doc, name, weight, part.num_rows, size)
                lists = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype="int32") * size, pa.array(out.reshape(-1).view("int32")))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n_words, pa.int64()), pa.array(keys[0]), pa.array(keys[1]), lists], ["id", "mark", "n_words", "k1", "k2", "signature"])

    narrow = docs.select(F.col(id_column).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "id bigint, mark bigint, n_words bigint, k1 bigint, k2 bigint, signature array<int>")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each node's component.

    Each round takes the smallest label among the neighbours and then the label's own label, so the rounds
    grow with the logarithm of a component's diameter. Every round is a written table.
    """
    both = stable(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = nodes.select("node", F.col("node").alias("label"))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "near").alias("next"))
        step = stable(step, "labels")
        jump = step.select(F.col("node").alias("at"), F.col("next").alias("jump"))
        moved = stable(step.join(jump, F.col("next") == F.col("at"), "left").select("node", "label", F.coalesce("jump", "next").alias("next")), "labels")
        if moved.where("next <> label").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", F.col("next").alias("label"))


def similar(name: np.ndarray, weight: np.ndarray, s: slice, t: slice, threshold: float) -> bool:
    """Whether the weighted Jaccard index of two runs of distinct names reaches the threshold."""
    _, p, q = np.intersect1d(name[s], name[t], assume_unique=True, return_indices=True)
    common = int(np.minimum(weight[s][p], weight[t][q]).sum())
    return common >= threshold * (int(weight[s].sum()) + int(weight[t].sum()) - common)


def _bytes(rows: DataFrame, node: str, texts: DataFrame) -> int:
    """Bytes of the texts that a table of nodes will carry."""
    sizes = texts.select(F.col("node").alias("_sized"), "bytes")
    return rows.join(sizes, F.col(node) == F.col("_sized")).agg(F.sum("bytes")).first()[0] or 0


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose texts' weighted Jaccard index reaches the threshold.

    A b that has many pairs is spread: its pairs are dealt into chunks of about 64, and its text goes to
    each chunk once.
    """
    # linked texts are of like length: b's are counted like a's
    groups = max(8, pairs.count() // VERIFY_PAIRS, 2 * _bytes(pairs, "a", texts) // VERIFY_BYTES)
    chunks = pairs.groupBy("b").agg(F.ceil(F.count("*") / 64).alias("chunks"))
    dealt = pairs.join(chunks, "b").withColumn("chunk", F.pmod(F.xxhash64("a"), "chunks"))
    dealt = stable(dealt.select("a", "b", "chunk", F.pmod(F.xxhash64("b", "chunk"), F.lit(groups)).alias("deal")), "pairs")
    left = dealt.join(texts, F.col("a") == F.col("node")).select("deal", "b", "a", "text")
    right = dealt.select("deal", "b").distinct().join(texts, F.col("b") == F.col("node")).select("deal", "b", F.lit(None).cast("bigint").alias("a"), "text")

    def run(table: pa.Table) -> pa.Table:
        edges, name, weight = sliced_shingles(table, "text", shingle)
        a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
        leader = {y: i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x is None}
        out = []
        for i, x in enumerate(a):
            if x is None:
                continue
            j = leader[b[i]]
            s, t = slice(edges[i], edges[i + 1]), slice(edges[j], edges[j + 1])
            if similar(name, weight, s, t, threshold):
                out.append((x, b[i]))
        return pa.table({"a": pa.array([r[0] for r in out], pa.int64()), "b": pa.array([r[1] for r in out], pa.int64())})

    return left.unionByName(right).groupBy("deal").applyInArrow(run, "a bigint, b bigint")


def between(held: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float, shingle: int, rows: int, alike: int) -> DataFrame:
    """Pairs of labels (a, b) that a verified link joins, for all pairs of nodes in a bucket with different
    labels whose signatures agree in at least ``alike`` components.

    A bucket's nodes outside its main label meet all its nodes in blocks of CHUNK by CHUNK, so that a task
    holds few rows, and no row is made for a pair. A pair is looked at in the first band that it shares, and
    not again once its labels are joined in the same task.
    """
    inner, outer = F.ceil(F.col("all") / CHUNK), F.ceil(F.col("others") / CHUNK)
    one = held.where("label <> main").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), inner - 1)).alias("i"), F.pmod(F.xxhash64("node"), outer).alias("j"), F.lit(True).alias("outside"))
    two = held.select("*", F.pmod(F.xxhash64("node"), inner).alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), outer - 1)).alias("j"), F.lit(False).alias("outside"))
    dealt = stable(one.unionByName(two), "blocks-of-pairs")
    groups = max(8, dealt.count() // (4 * VERIFY_PAIRS), _bytes(dealt, "node", texts) // VERIFY_BYTES)
    # signature and text meet once per node, then each block's row meets both
    full = dealt.join(nodes.select("node", "signature").join(texts.select("node", "text"), "node"), "node")
    full = full.select(F.pmod(F.xxhash64("bucket", "band", "i", "j"), F.lit(groups)).alias("deal"), "bucket", "band", "i", "j", "outside", "node", "label", "main", "signature", "text")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        told = {c: table.column(c).to_numpy() for c in ("bucket", "band", "i", "j", "node", "label", "main")}
        outside = np.asarray(table.column("outside").to_pylist(), bool)
        signature = np.stack(table.column("signature").to_numpy())
        order = np.lexsort((told["j"], told["i"], told["band"], told["bucket"]))
        same = np.ones(max(len(order) - 1, 0), bool)
        for c in ("bucket", "band", "i", "j"):
            same &= told[c][order][1:] == told[c][order][:-1]
        found: list[tuple[int, int]] = []
        for group in np.split(order, np.flatnonzero(~same) + 1):
            left, right = group[outside[group]], group[~outside[group]]
            band = int(told["band"][group[0]])
            for x in left.tolist():
                equal = signature[right] == signature[x]
                first = np.ones(len(right), bool)
                for k in range(band):
                    first &= ~equal[:, k * rows : (k + 1) * rows].all(axis=1)
                own = told["label"][right]
                ok = first & (own != told["label"][x]) & ((own == told["main"][right]) | (told["node"][x] < told["node"][right])) & (equal.sum(axis=1) >= alike)
                found += [(x, y) for y in right[ok].tolist()]
        needed = sorted({i for pair in found for i in pair})
        edges, name, weight = sliced_shingles(table.select(["text"]).take(pa.array(needed, pa.int64())), "text", shingle)
        at = {x: i for i, x in enumerate(needed)}
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out = []
        for x, y in found:
            p, q = root(int(told["label"][x])), root(int(told["label"][y]))
            if p != q and similar(name, weight, slice(edges[at[x]], edges[at[x] + 1]), slice(edges[at[y]], edges[at[y] + 1]), threshold):
                parent[max(p, q)] = min(p, q)
                out.append((int(told["label"][x]), int(told["label"][y])))
        return pa.table({"a": pa.array([r[0] for r in out], pa.int64()), "b": pa.array([r[1] for r in out], pa.int64())})

    return stable(full.groupBy("deal").applyInArrow(run, "a bigint, b bigint"), "label-links")


def classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = 0.8, bands: int = 26, rows: int = 5, shingle: int = 5, floor: float = 0.6) -> DataFrame:
    """One row per document: ``id_column, mark, class_id``; class_id is the smallest id of its class.

    ``mark`` is xxhash64 of the text, which with the id names the row.
    """
    table = stable(signed(docs, id_column, text, bands, rows, shingle), "signatures")
    worded = table.where("n_words > 0 AND id IS NOT NULL")
    nodes = worded.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("signature").alias("signature"))
    nodes = stable(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = F.array(*[F.xxhash64(F.lit(i), F.slice("signature", i * rows + 1, rows)) for i in range(bands)])
    seats = nodes.select("node", F.posexplode(keys).alias("band", "bucket"))
    leads = F.min(F.struct(F.xxhash64("node", F.col("band") % 3).alias("h"), "node"))["node"]
    buckets = seats.groupBy("bucket", "band").agg(F.count("*").alias("size"), leads.alias("leader")).where("size > 1")
    seats = stable(seats.join(buckets, ["bucket", "band"]).select("bucket", "band", "size", "node", "leader"), "seats")
    crowd = seats.select("node").distinct()
    wanted = crowd.join(nodes.select("node", "id", "k1", "k2"), "node")
    source = docs.select(F.col(id_column).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    marks = worded.select("id", "k1", "k2", "mark")
    # one text of each node: by id and mark, for ids may repeat
    named = wanted.join(marks, ["id", "k1", "k2"]).groupBy("node").agg(F.min("id").alias("id"), F.min("mark").alias("mark"))
    texts = stable(source.join(named, ["id", "mark"]).select("node", "text", F.octet_length("text").cast("bigint").alias("bytes")).dropDuplicates(["node"]), "texts")

    stars = stable(seats.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "stars")
    links = stable(verified(stars, texts, threshold, shingle), "links")
    labels = components(crowd, links)

    held = stable(seats.where("size > 2").select("bucket", "band", "node").join(labels, "node"), "held")
    shares = held.groupBy("bucket", "band", "label").agg(F.count("*").alias("n"))
    largest = F.max(F.struct("n", "label"))
    open_ = shares.groupBy("bucket", "band").agg(largest["label"].alias("main"), F.sum("n").alias("all"), (F.sum("n") - largest["n"]).alias("others"), F.count("*").alias("labels")).where("labels > 1")
    held = stable(held.join(open_, ["bucket", "band"]).select("bucket", "band", "node", "label", "main", "all", "others"), "open")
    joined = between(held, nodes, texts, threshold, shingle, rows, int(floor * bands * rows))
    merged = components(labels.select(F.col("label").alias("node")).distinct(), joined)
    final = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("class")), "label").select("node", "class")
    final = nodes.select("node", "id", "k1", "k2").join(final, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = final.groupBy("class").agg(F.min("id").alias("class_id"))
    final = stable(final.join(least, "class").select("k1", "k2", "class_id"), "classes")
    out = table.select("id", "mark", "n_words", "k1", "k2").join(final, ["k1", "k2"], "left")
    named = F.when(F.col("id").isNotNull(), F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_column), "mark", named.alias("class_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents whose id is their class's smallest, once each, with their columns. Null ids stay."""
    found = classes(docs, id_column, text, **settings)
    stay = found.where(f"`{id_column}` = class_id").select(F.col(id_column).alias("_stay_id"), F.col("mark").alias("_stay_mark")).distinct()
    marked = docs.withColumn("_row_mark", F.xxhash64(text))
    kept = marked.join(stay, (F.col(id_column).cast("bigint") == F.col("_stay_id")) & (F.col("_row_mark") == F.col("_stay_mark")))
    kept = kept.dropDuplicates([id_column, "_row_mark"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(docs.where(F.col(id_column).isNull()))
