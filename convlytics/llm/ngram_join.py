"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A document's set holds its distinct k-word shingles.  Two documents link when
``den * |A & B| >= num * |A | B|`` with threshold num/den.

1. A fixed-size count sketch of all shingles (every document counts) orders
   shingles rare first; ties fall back on the hash, so the order is total.
2. Each document keeps the first ``n - ceil(t n) + 1`` shingles of that order:
   linked sets share at least one of them.  Equal sets form one class, and
   only classes go on, however many copies they have.
3. Classes that share a prefix shingle meet in a bucket (shingle, length
   band); bands bound the sizes to the length filter's ratio.  In star rounds
   a few members of a bucket, chosen by hash, meet the others, by positional
   filter, suffix filter (overlap bound over hash ranges) and verification on
   whole sets.
   Groups of near copies fall into one component that way without their pairs
   being listed.  What is left, members of one bucket in different components,
   is then compared in full, each pair once, so no link is lost.
4. Components of the links give each document the smallest doc_id reachable.

Defined results: null or empty text and text without words have the empty set,
which links with nothing (n_shingles 0, component_id = doc_id).  A null doc_id
is kept as a row, and its component is the smallest known doc_id it links to.
Repeated rows give repeated result rows.  Only the two named columns are read,
so others may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlytics.llm import counters
from convlytics.llm import textkit as T
from convlytics.llm.components import connected_components
from convlytics.llm.scratch import Scratch

#: counters of the shingle sketch; 4 MB whatever the input
SKETCH_SLOTS = 1 << 20
#: hash ranges of the suffix filter; a count stops at LEVEL, which keeps the bound
RANGES = 128
LEVEL = 127
#: bits of the bitmap of documents to verify; 4 MB whatever the input
BITMAP_BITS = 1 << 25
#: members by which buckets are compared in the star rounds
STARS = (1, 3)
#: members of a verification group; larger ones are split, each part with the first member's set
GROUP = 256


def _project(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set's mixed hashes."""
    pair = np.array([T.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64),
                     T.mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)], np.uint64)
    return tuple(T.signed(pair).tolist())


def signatures(docs: DataFrame, k: int, slots: int = SKETCH_SLOTS) -> DataFrame:
    """Per row of ``docs``: set size and digest; per task also its shingle counters.

    One pass gives both: rows with ``slice`` set carry counters.
    """

    def run(batches):
        total = np.zeros(slots, np.int64)
        for b in batches:
            for c in T.chunks(b.column(1)):
                n, digests = [], []
                for s in T.shingle_sets(c, k):
                    n.append(len(s))
                    digests.append(set_digest(s))
                    np.add.at(total, (s & np.uint64(slots - 1)).astype(np.int64), 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.lo, len(c)), pa.array(n, pa.int64()),
                     pa.array([x for x, _ in digests], pa.int64()), pa.array([x for _, x in digests], pa.int64()),
                     pa.nulls(len(c), pa.int32()), pa.nulls(len(c), pa.binary())],
                    ["doc_id", "n", "d1", "d2", "slice", "counts"])
        for r in counters.slices(total):
            empty = pa.nulls(r.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([empty] * 4 + r.columns, ["doc_id", "n", "d1", "d2", "slice", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, " + counters.SCHEMA)


def prefixes(docs: DataFrame, k: int, num: int, den: int, counts) -> DataFrame:
    """Per row: set size, 128-bit set digest, rare-first prefix, counts by hash range."""
    schema = "doc_id long, n long, d1 long, d2 long, prefix array<long>, profile array<tinyint>"
    shift = np.uint64(64 - (RANGES - 1).bit_length())

    def run(batches):
        order = counts.value
        mask = np.uint64(len(order) - 1)
        for b in batches:
            ids = b.column(0)
            for c in T.chunks(b.column(1)):
                n, d1, d2, pre, prof = [], [], [], [], []
                for s in T.shingle_sets(c, k):
                    m = len(s)
                    n.append(m)
                    for out, half in zip((d1, d2), set_digest(s)):
                        out.append(half)
                    p = m - -(-num * m // den) + 1 if m else 0
                    rare = np.argsort(order[(s & mask).astype(np.int64)], kind="stable")[:p]
                    pre.append(T.signed(s[rare]))
                    prof.append(np.minimum(np.bincount((s >> shift).astype(np.int64), minlength=RANGES), LEVEL))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(c.lo, len(c)), pa.array(n, pa.int64()),
                     pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                     T.list_column(pre), T.list_column(prof, pa.int8())],
                    ["doc_id", "n", "d1", "d2", "prefix", "profile"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _bucket_rows(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(gram, band, cid, n, pos, before) of the prefix shingles that two classes share.

    ``before`` counts the class's shared shingles that come earlier.  Shingles
    common to two classes and earlier than one they share lie in both prefixes,
    so ``before`` bounds their number; a shingle of one class alone cannot be
    one of them.
    """
    rows = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "gram"))
    shared = rows.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram")
    # a class has no more rows than its prefix has shingles
    own = (rows.join(shared, "gram").groupBy("cid", "n")
           .agg(F.array_sort(F.collect_list(F.struct("pos", "gram"))).alias("held"))
           .select("cid", "n", F.posexplode("held").alias("before", "held")))
    return (own.withColumn("band", F.explode(F.array(_band("n", num, den), _band("n", num, den) + 1)))
            .select("held.gram", "band", "cid", "n", "held.pos", "before"))


def _band(n: str, num: int, den: int):
    """Length band: sizes that may link lie in one band or in two that touch."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(den / num)) - F.lit(1e-9)).cast("int")


def _possible(num: int, den: int):
    """Length and positional filter of a bucket's pair (a, b)."""
    lo, hi = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    most = (F.least("a_before", "b_before") + 1
            + F.least(F.col("a_n") - F.col("a_pos") - 1, F.col("b_n") - F.col("b_pos") - 1))
    return (den * lo >= num * hi) & (most * (num + den) >= num * (lo + hi))


def _overlap_enough(num: int, den: int):
    """Suffix filter: what one profile has more than the other, range by range,
    is not in the overlap."""
    def less(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.greatest(p.cast("int") - q.cast("int"), F.lit(0))), F.lit(0),
                           lambda s, d: s + d)

    most = F.least(F.col("a_n") - less("a_profile", "b_profile"), F.col("b_n") - less("b_profile", "a_profile"))
    return most * (num + den) >= num * (F.col("a_n") + F.col("b_n"))


def _star_pairs(rows: DataFrame, num: int, den: int, seeds: range) -> DataFrame:
    """A few members of each mixed bucket with the members of other components.

    Members with few shingles of their own before the bucket's come first, as
    they are near most others; beyond that a hash decides.
    """
    pick = [F.min(F.struct(F.floor(F.col("pos") / 4), F.xxhash64(F.lit(s), "cid"), "cid", "n", "pos", "before", "comp"))
            for s in seeds]
    first = (rows.groupBy("gram", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.array(*pick).alias("p"))
             .where("lo != hi").select("gram", "band", F.explode(F.array_distinct("p")).alias("p"))
             .select("gram", "band", F.col("p.cid").alias("a"), F.col("p.n").alias("a_n"), F.col("p.pos").alias("a_pos"),
                     F.col("p.before").alias("a_before"), F.col("p.comp").alias("a_comp")))
    return (rows.join(first, ["gram", "band"]).where("comp != a_comp")
            .select("a", "a_n", "a_pos", "a_before", F.col("cid").alias("b"), F.col("n").alias("b_n"),
                    F.col("pos").alias("b_pos"), F.col("before").alias("b_before"))
            .where(_possible(num, den)).select("a", "b").distinct())


def _all_pairs(rows: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Every possible pair of members of different components, once."""
    mixed = (rows.groupBy("gram", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .where("lo != hi").select("gram", "band"))
    left = rows.join(mixed, ["gram", "band"]).join(classes.select("cid", "profile").hint("merge"), "cid")
    fields = ("cid", "n", "pos", "before", "comp", "profile")
    right = left.select("gram", "band", *[F.col(c).alias(f"b_{c}") for c in fields])
    left = left.select("gram", "band", *[F.col(c).alias(f"a_{c}") for c in fields])
    return (left.join(right, ["gram", "band"])
            .where((F.col("a_comp") != F.col("b_comp")) & (F.col("a_cid") < F.col("b_cid")))
            .where(F.col("band") == F.greatest(_band("a_n", num, den), _band("b_n", num, den)))  # of two bands, one
            .where(_possible(num, den)).where(_overlap_enough(num, den))
            .select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b")).distinct())


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int,
            scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole sets link, with their overlap.

    The sets are rebuilt from the text of the classes' first documents, for
    the classes in question only.  Pairs meet grouped by a: a's set comes
    first in each group's stream, so a task holds one set at a time.
    """
    # profiles are sorted to the pairs, never held whole by an executor
    profile = classes.select(F.col("cid"), "n", "profile").hint("merge")
    pairs = (pairs.join(profile.select(F.col("cid").alias("a"), F.col("n").alias("a_n"), F.col("profile").alias("a_profile")), "a")
             .join(profile.select(F.col("cid").alias("b"), F.col("n").alias("b_n"), F.col("profile").alias("b_profile")), "b")
             .where(_overlap_enough(num, den))
             .select("a", "b"))
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    pairs, path = scratch.write(pairs.join(many, "a")
                                .select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")))
    if pairs.isEmpty():
        scratch.drop(path)
        return docs.sparkSession.createDataFrame([], "a long, b long, inter long")
    needed = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    reps = classes.join(needed, "cid").select("cid", "rep", "d1", "d2")
    # a bitmap of hashed ids spares tokenising and moving the other documents
    wanted = docs.sparkSession.sparkContext.broadcast(counters.bitmap(reps.select("rep"), BITMAP_BITS))

    def sets(batches):
        bits = wanted.value
        for b in batches:
            b = b.filter(pa.array(counters.marked(bits, b.column(0))))
            for c in T.chunks(b.column(1)):
                own = T.shingle_sets(c, k)
                digests = [set_digest(s) for s in own]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.lo, len(c)), pa.array([x for x, _ in digests], pa.int64()),
                     pa.array([x for _, x in digests], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())],
                    ["rep", "d1", "d2", "grams"])

    # a doc_id may stand on several rows with other texts: the set digest decides
    found = docs.select("doc_id", "text").mapInArrow(sets, "rep long, d1 long, d2 long, grams binary")
    one, gpath = scratch.write(
        found.join(reps, found["rep"].eqNullSafe(reps["rep"]) & (found["d1"] == reps["d1"]) & (found["d2"] == reps["d2"]))
        .select("cid", "grams").dropDuplicates(["cid"]))
    wanted.destroy()  # its only reader is written
    lead = (pairs.select("a", "part").distinct().join(one.withColumnRenamed("cid", "a"), "a")
            .select("a", "part", F.lit(None).cast("long").alias("b"), "grams"))
    rest = pairs.join(one.withColumnRenamed("cid", "b"), "b").select("a", "part", "b", "grams")

    def compare(batches):
        key, base = None, None
        for batch in batches:
            a, b, inter = [], [], []
            grams = batch.column(3)
            for i, (x, y, z) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)))):
                g = np.frombuffer(grams[i].as_buffer(), np.uint64)
                if z is None:
                    key, base = x, g
                    continue
                if x != key:
                    raise RuntimeError("a pair without its first set")
                at = np.searchsorted(base, g)
                same = int((base[np.minimum(at, len(base) - 1)] == g).sum())
                if den * same >= num * (len(base) + len(g) - same):
                    a.append(x), b.append(z), inter.append(same)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, inter)], ["a", "b", "inter"])

    stream = (lead.unionByName(rest).select("a", "b", "part", "grams")
              .repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
              .select("a", "part", "b", "grams"))
    links = scratch.save(stream.mapInArrow(compare, "a long, b long, inter long"))
    scratch.drop(path, gpath)
    return links


def _classes(docs, k, num, den, scratch):
    """Membership of the rows, the classes, and the classes' prefixes (with their path)."""
    spark = docs.sparkSession
    both = scratch.save(signatures(docs, k))
    counts = counters.total(both.where("slice is not null").select("slice", "counts"), SKETCH_SLOTS)
    raw = both.where("slice is null").select("doc_id", "n", "d1", "d2")
    order = spark.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))
    full, path = scratch.write(
        prefixes(docs, k, num, den, order).where("n > 0").groupBy("d1", "d2", "n")
        .agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("profile").alias("profile"),
             F.count("*").alias("copies"))
        .withColumn("cid", F.monotonically_increasing_id()))
    order.destroy()  # its only reader is written
    classes = scratch.save(full.drop("prefix"))
    return raw, classes, full.select("cid", "n", "prefix"), path


def jaccard_pairs(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10,
                  id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links between classes of different sets, each verified once, and membership.

    Returns (pairs, members): pairs (a, b, inter) of class ids with a != b,
    members (doc_id, n_shingles, class_id), class_id null for empty sets.
    """
    scratch, docs = Scratch(docs.sparkSession, "ngram-pairs"), _project(docs, id_col, text_col)
    raw, classes, full, path = _classes(docs, k, num, den, scratch)
    rows = scratch.save(_bucket_rows(full, num, den).withColumn("comp", F.col("cid")))
    scratch.drop(path)
    pairs = _verify(_all_pairs(rows, classes, num, den), classes, docs, k, num, den, scratch)
    members = (raw.join(classes.select("d1", "d2", "n", "cid"), ["d1", "d2", "n"], "left")
               .select("doc_id", F.col("n").alias("n_shingles"), F.col("cid").alias("class_id")))
    return pairs, members


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_size) per row of ``docs``."""
    scratch, docs = Scratch(docs.sparkSession, "ngram-join"), _project(docs, id_col, text_col)
    raw, classes, full, path = _classes(docs, k, num, den, scratch)
    rows, rpath = scratch.write(_bucket_rows(full, num, den))
    scratch.drop(path)
    tried = links = labels = None
    for step, stars in enumerate((*STARS, 0)):
        if labels is None:
            marked = rows.withColumn("comp", F.col("cid"))
        else:
            marked = (rows.join(labels.withColumnRenamed("node", "cid"), "cid", "left")
                      .withColumn("comp", F.coalesce("comp", "cid")))
        pairs = _star_pairs(marked, num, den, range(10 * step, 10 * step + stars)) if stars else _all_pairs(marked, classes, num, den)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs, _ = scratch.write(pairs)
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.union(pairs)
        found = _verify(pairs, classes, docs, k, num, den, scratch).select("a", "b")
        links = found if links is None else links.union(found)
        if not found.isEmpty():
            labels = connected_components(links, scratch)
    scratch.drop(rpath)
    comp = classes.select("cid", "d1", "d2", "n", "rep", "copies")
    if labels is not None:
        comp = comp.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    else:
        comp = comp.withColumn("comp", F.col("cid"))
    least = comp.groupBy("comp").agg(F.min("rep").alias("component_id"))
    final = comp.join(least, "comp").select("d1", "d2", "n", "component_id", "copies")
    return (raw.select("doc_id", "n", "d1", "d2").join(final, ["d1", "d2", "n"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id"),
                    F.coalesce("copies", F.lit(1)).cast("long").alias("class_size")))
