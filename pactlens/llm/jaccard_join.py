"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Documents are sets of ``n``-word shingles. Sets with J >= t differ in size by the factor
1/t at most, so sizes are cut into bands and a pair lies in one band or in two
neighbours. For each band a bound H on the symmetric difference holds, and the universe
of shingle hashes is cut into segments: with more than H segments, two similar sets have
the same subset in one of them. A segment may also index its subset's one-deletion
neighbourhood; it then bears a difference of one and counts twice. ``allocate`` chooses
how many segments there are and how many have neighbourhoods, by the rows they cost
and by what their size costs in false candidates. Spare segments make up for empty ones,
which would be alike in all sets; a set with more empty segments than spare ones indexes
its empty ones too, so that no pair is lost.

Equal sets form a class at once, and a class takes part once. Of the classes that share
a signature, each is verified against the least one, its head, on whole sets. Classes
with one head that are still in different components may be linked too: their
differences from the head are joined by their first elements (_open_pairs), and what
passes is verified on whole sets. Where a member is far from its head, which parities of
its elements tell (_parted, in more classes for larger sets), that difference would be most of both sets: it meets the
head's other members by their parities instead (_stray_pairs). So a group of n near copies costs n verifications and
not n * n, and no link between components is lost. Frequent signatures are pre-aggregated; joins back are split by
Spark where a key is frequent (AQE skew join).

Edges: a null or blank text is the empty set, which links with nothing; a text of fewer
words than ``n`` is one shingle; null ids take no part in a component's least id unless
all of its ids are null; repeated rows are equal sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, drop_work_table, fresh, mix, rolling, small_batches, work_table
from .components import components

_hashes = WordHashes()
C1, C2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Shingles that a segment should hold on average: fewer are shared by chance too often.
LEAST_SEGMENT = 3
#: Passes over the signatures, a power of two, and the columns that hold them.
PASSES = 4
SIGNATURES = [f"sigs_{p}" for p in range(PASSES)]
#: 64-bit words of a set's parities; large sets have more of them besides (parities_of_large).
WORDS = 32
#: Parities that differ between far sets: more than this, and than FAR times what similar sets may differ by.
#: Sets have at least as many elements apart, so far ones are not similar.
NOT_FAR, FAR = 0, 1.0
#: Elements and heads that a row carries, so that pairs which share several are told apart.
FIRSTS = 16


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = _hashes.of(words)
    return np.unique(rolling(h, n) if len(h) >= n else rolling(h, len(h)) + np.uint64(len(h)))


@lru_cache(65536)
def band(size: int, num: int, den: int) -> tuple[int, int, int]:
    """(number, least size, largest size) of the band that holds a size."""
    number, lo = 0, 1
    while True:
        hi = lo * den // num
        if size <= hi:
            return number, lo, hi
        number, lo = number + 1, hi + 1


@lru_cache(4096)
def allocate(lo: int, hi: int, num: int, den: int) -> tuple[int, int, int]:
    """(segments, those with neighbourhoods, spare ones) for the band lo .. hi and the next."""
    total = hi + hi * den // num
    most = total - 2 * -(-num * total // (num + den))
    if most < 1:
        return 0, 0, 0
    best = None
    for m in range(most + 1, most // 2, -1):
        doubled = most + 1 - m
        size = lo / m
        rows = m + doubled * (1 + size)
        cost = rows * (1 + 50 * math.exp(-3 * size / LEAST_SEGMENT))
        if best is None or cost < best[0]:
            best = cost, m, doubled
        if m < most - 64 and size > 4 * LEAST_SEGMENT:
            break
    _, m, doubled = best
    spare = 0
    if not doubled:
        while spare < 2 * m:
            empty = (m + spare) * math.exp(-lo / (m + spare))
            if empty + 3 * math.sqrt(empty) <= spare:
                break
            spare += 1
    return m + spare, doubled, spare


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """All signatures of a set, for its band with the next one and the one before with it."""
    if not len(s):
        return np.zeros(0, np.uint64)
    number, lo, hi = band(len(s), num, den)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s), dtype=np.uint64)))
    out = []
    for k in (number, number - 1):
        if k < 0:
            continue
        if k != number:
            _, lo, hi = band(lo - 1, num, den)
        m, doubled, spare = allocate(lo, hi, num, den)
        if not m:
            continue
        edges = np.searchsorted(s, (np.arange(1, m, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // m)))
        ends = np.concatenate(([0], edges, [len(s)]))
        sums = total[ends[1:]] - total[ends[:-1]]
        label = np.arange(m, dtype=np.uint64) * np.uint64(C1) + np.uint64((k + 1) * C2 % (1 << 64))
        full = mix(mix(sums) + label)
        size = np.diff(ends)
        empty = size == 0
        keep = ~empty if not doubled and empty.sum() <= spare else np.ones(m, bool)
        out.append(full[keep])
        if doubled:
            inside = np.repeat(np.arange(m), size)[: ends[doubled]]
            out.append(mix(mix(sums[inside] - mix(s[: ends[doubled]])) + label[inside]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parities(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's elements falls in each of 64 * WORDS classes. Two
    sets have at least as many elements apart as parities."""
    odd = np.bincount((s % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parities_of_large(s: np.ndarray) -> np.ndarray:
    """As parities(), of a set too large for those to tell: in at least twice as many
    classes as it has elements, the next power of two. Less than that fill up: half of
    their parities differ at most, which similar sets may. Of sets that do well with
    WORDS, nothing."""
    if len(s) <= 32 * WORDS:
        return np.zeros(0, np.int64)
    classes = 1 << (2 * len(s) - 1).bit_length()
    odd = np.bincount((s % np.uint64(classes)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def row_key(id_col: str, text_col: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col).cast("string"))


def _sketches(src: DataFrame, n: int, num: int, den: int, seed: int) -> DataFrame:
    """Size, hashes, parities and signatures of each set; the signatures lie in PASSES columns, by
    their highest bits, so that each pass reads its own alone."""
    bits = PASSES.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                size, h1, h2, odd, sigs, ends = [], [], [], [], [], [0]
                for text in part.column(2):
                    s = shingles(text.as_py(), n)
                    size.append(len(s))
                    a = int(np.sum(mix(s + np.uint64(seed * 2 + 1)), dtype=np.uint64)) if len(s) else 0
                    h1.append(a)
                    h2.append(int(np.sum(mix(s ^ np.uint64(C2)), dtype=np.uint64)) if len(s) else 0)
                    if len(s) and a not in seen:  # one of the copies in a task will do
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(a)
                        odd.append(np.concatenate((parities(s), parities_of_large(s))))
                        sigs.append(signatures(s, num, den))
                        ends.append(ends[-1] + len(sigs[-1]))
                    else:
                        odd.append(None)
                        ends.append(ends[-1])
                flat = np.concatenate(sigs) if sigs else np.zeros(0, np.uint64)
                of_pass = flat >> np.uint64(64 - bits)
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                dealt = []
                for p in range(PASSES):
                    mine = of_pass == p
                    until = np.concatenate(([0], np.cumsum(mine)))[ends]
                    dealt.append(pa.ListArray.from_arrays(pa.array(until.astype(np.int32)), pa.array(flat[mine].view(np.int64))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int64()), signed(h1), signed(h2), pa.array(odd, pa.list_(pa.int64())), *dealt], names=["doc_id", "k", "n_shingles", "h", "h2", "odd", *SIGNATURES])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, k long, n_shingles long, h long, h2 long, odd array<long>, {', '.join(f'{c} array<long>' for c in SIGNATURES)}")


def _candidates(sketches: DataFrame) -> DataFrame:
    """(a, b, among_more) for the least set of each signature and each other one that has
    it; among_more: one of their signatures has more than these two.

    Signatures are most of what is shuffled. They are handled in PASSES passes over
    ranges of their hashes, and a pass frees its shuffle files before the next starts.
    """
    found = []
    for column in SIGNATURES:
        rows = sketches.select("h", F.explode(column).alias("sig"))
        heads = rows.groupBy("sig").agg(F.min("h").alias("a"), F.max("h").alias("z"), F.count(F.lit(1)).alias("m")).where("a < z").select("sig", "a", "m")
        heads = work_table(heads, "heads")
        found.append(work_table(rows.join(heads, "sig").where("a <> h").groupBy("a", F.col("h").alias("b")).agg((F.max("m") > 2).alias("among_more")), "pairs-of-pass"))
        drop_work_table(heads)
    pairs = work_table(reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.max("among_more").alias("among_more")), "pairs")
    for table in found:
        drop_work_table(table)
    return pairs


def _most(total: str, num: int, den: int) -> str:
    """How many elements similar sets of ``total`` elements in all may have apart."""
    return f"({total} - 2 * cast(ceil({num} * {total} / {num + den}) as int))"


def _odd_apart(one: str, other: str) -> str:
    return "(" + " + ".join(f"bit_count({one}[{k}] ^ {other}[{k}])" for k in range(WORDS)) + ")"


def _wide_apart(one: str, other: str) -> str:
    """As _odd_apart, by the words after the first WORDS. Where one has twice as many, its
    halves are put together, which gives its parities in half as many classes; where their
    numbers are further apart, or one has none, nothing is told (0)."""
    words = f"(least(size({one}), size({other})) - {WORDS})"
    both = lambda c: f"({c}[k] ^ if(size({c}) - {WORDS} > {words}, {c}[k + {words}], 0L))"
    told = f"size({one}) > {WORDS} AND size({other}) > {WORDS} AND greatest(size({one}), size({other})) - {WORDS} <= 2 * {words}"
    return f"if({told}, aggregate(sequence({WORDS}, {WORDS} - 1 + greatest({words}, 1)), 0, (n, k) -> n + bit_count({both(one)} ^ {both(other)})), 0)"


def _parted(pairs: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs with ``far``: their parities alone show that they are not similar."""
    side = lambda c: marks.select(F.col("h").alias(c), F.col("size").alias(f"{c}_size"), F.col("odd").alias(f"{c}_odd"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    least = f"greatest({NOT_FAR}, {FAR} * {_most('(a_size + b_size)', num, den)})"
    far = F.expr(f"{_odd_apart('a_odd', 'b_odd')} > {least} OR {_wide_apart('a_odd', 'b_odd')} > {least}")
    return both.select("a", "b", "among_more", far.alias("far"))


def _stray_pairs(pairs: DataFrame, labels: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that may be similar among the classes of one head of which one or both are far
    from it, where their components differ: by sizes and parities."""
    strays = pairs.where("far AND among_more").select("a").distinct()
    met = pairs.where("among_more").join(strays, "a", "left_semi").join(labels.withColumnRenamed("node", "b"), "b", "left")
    members = work_table(met.join(marks.withColumnRenamed("h", "b"), "b").select("a", "b", "far", F.coalesce("label", "b").alias("label"), "size", "odd"), "stray-members")
    side = lambda p: members.select("a", *[F.col(c).alias(f"{p}_{c}") for c in ("b", "far", "label", "size", "odd")])
    s, l = side("s").where("s_far"), side("l")
    meets = [
        "s_label <> l_label",
        "s_b < l_b OR NOT l_far",
        f"least(s_size, l_size) * {den} >= greatest(s_size, l_size) * {num}",
        f"{_odd_apart('s_odd', 'l_odd')} <= {_most('(s_size + l_size)', num, den)}",
        f"{_wide_apart('s_odd', 'l_odd')} <= {_most('(s_size + l_size)', num, den)}",
    ]
    on = s["a"] == l["a"]
    for m in meets:
        on = on & F.expr(f"({m})")
    found = s.join(l, on).select(F.least("s_b", "l_b").alias("a"), F.greatest("s_b", "l_b").alias("b")).distinct()
    found = work_table(found.withColumn("among_more", F.lit(False)), "stray-pairs")
    drop_work_table(members)
    return found


def _compared(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Whole sets of each pair (a, b) of classes compared: (a, b, linked, size of b's
    set, apart: how many elements just one of the two sets has, differ: those elements,
    where b meets others beside a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for b in batches:
            linked, size, far, differ = [], [], [], []
            for x, y, more in zip(b.column(2), b.column(3), b.column(4)):
                raw = x.as_py()
                if raw != last:
                    last, left = raw, shingles(raw, n)
                right = shingles(y.as_py(), n)
                apart = np.setxor1d(left, right, assume_unique=True)
                both = (len(left) + len(right) - len(apart)) // 2
                linked.append(den * both >= num * (both + len(apart)))
                size.append(len(right))
                far.append(len(apart))
                differ.append(apart.view(np.int64) if more.as_py() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_()), pa.array(size, pa.int32()), pa.array(far, pa.int32()), pa.array(differ, pa.list_(pa.int64()))], names=["a", "b", "linked", "size", "apart", "differ"])

    half = pairs.join(texts.select(F.col("h").alias("b"), F.col("raw").alias("raw_b")), "b")
    whole = half.join(texts.select(F.col("h").alias("a"), F.col("raw").alias("raw_a")), "a")
    return whole.select("a", "b", "raw_a", "raw_b", "among_more").mapInArrow(run, "a long, b long, linked boolean, size int, apart int, differ array<long>")


def _open_pairs(compared: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that may be similar among the classes compared with the same head, where
    their components differ. Who meets nobody but the head by any signature stays out:
    all of its pairs are compared. ``compared`` is dropped as soon as it has been read.

    With D_b = b xor head, |D_b xor D_c| = |b xor c|, so a similar pair has
    |D_b ^ D_c| >= need = (|D_b| + |D_c| - most) / 2. In one order of all elements they
    share one of the first |D| - need + 1 of both; where the first shared stands bounds
    how many can follow. The order is by how many members have the element, rarest
    first: what the head alone has of its own stands in every D and so comes last. No
    more than the first most + 1 can be needed, and one that no member of another
    component has meets none. Pairs with need < 1 are both similar to the head.

    A similar pair is found by each head of both and by the element shared first, if by
    any; so it comes from the least such head and that element alone, as far as they are
    among the FIRSTS that a row carries. Beyond those it comes more than once, hence the
    distinct.
    """
    crowd = compared.where("differ IS NOT NULL").select("a", "b", "size", "apart")
    known = crowd.join(labels.withColumnRenamed("node", "b"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    heads = known.groupBy("a").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("a")
    known = work_table(known.join(heads, "a", "left_semi"), "family-known")
    heads_of = known.groupBy("b").agg(F.slice(F.array_sort(F.collect_set("a")), 1, FIRSTS).alias("heads"))
    lesser = F.filter("heads", lambda h: h < F.col("a")).alias("lesser")
    members = work_table(known.join(heads_of, "b").select("a", "b", "label", "size", "apart", lesser), "family-members")
    drop_work_table(known)
    # in passes over ranges of the elements; dealt by both ids, so that a head with many members is spread
    parts = []
    for p in range(PASSES):
        mine = compared.select("a", "b", F.filter("differ", lambda x: F.pmod(x, F.lit(PASSES)) == p).alias("differ"))  # noqa: B023
        elements = mine.where(F.size("differ") > 0).join(members.select("a", "b", "label"), ["a", "b"]).select("a", "b", "label", F.explode("differ").alias("x"))
        counts = elements.groupBy("a", "x").agg(F.count(F.lit(1)).alias("often"), F.min("label").alias("y"), F.max("label").alias("z"))
        shared = work_table(counts.where("y < z").select("a", "x", "often"), "family-shared")
        parts.append(work_table(elements.drop("label").join(shared, ["a", "x"]), "family-met"))
        drop_work_table(shared)
    drop_work_table(compared)
    met = reduce(DataFrame.unionByName, parts)
    rarest = Window.partitionBy("a", "b").orderBy(F.desc("often"), F.desc("x"))
    reach = f"size + cast(floor(size * {den} / {num}) as int)"
    whole = Window.partitionBy("a", "b")
    ranked = met.withColumn("back", F.row_number().over(rarest)).withColumn("have", F.count(F.lit(1)).over(whole))
    firsts = F.collect_list(F.when(F.col("have") - F.col("back") < FIRSTS, F.struct("often", "x"))).over(whole)
    earlier = F.filter(F.col("firsts"), lambda e: e < F.struct("often", "x"))
    ranked = ranked.withColumn("firsts", firsts).withColumn("earlier", F.transform(earlier, lambda e: e["x"]))
    ranked = ranked.join(members, ["a", "b"]).withColumn("pos", F.expr("apart - back"))
    ranked = ranked.where(f"pos <= {reach} - 2 * cast(ceil({num} * ({reach}) / {num + den}) as int)")
    ranked = work_table(ranked.drop("often", "back", "have", "firsts"), "family-prefixes")
    for table in (members, *parts):
        drop_work_table(table)
    members = ranked
    side = lambda p: members.select("a", "x", *[F.col(c).alias(f"{p}_{c}") for c in ("b", "label", "size", "apart", "pos", "earlier", "lesser")])
    total = "(s_size + l_size)"
    most = _most(total, num, den)
    need = f"((s_apart + l_apart - {most} + 1) div 2)"
    meets = [
        "s_label <> l_label",
        "s_apart < l_apart OR s_apart = l_apart AND s_b < l_b",
        f"l_apart - s_apart <= {most}",
        f"least(s_size, l_size) * {den} >= greatest(s_size, l_size) * {num}",
        f"s_pos <= s_apart - {need} AND l_pos <= l_apart - {need}",
        f"least(s_apart - s_pos, l_apart - l_pos) >= {need}",
        "NOT arrays_overlap(s_earlier, l_earlier) AND NOT arrays_overlap(s_lesser, l_lesser)",
    ]
    small, large = side("s"), side("l")
    on = (small["a"] == large["a"]) & (small["x"] == large["x"])
    for m in meets:
        on = on & F.expr(f"({m})")
    found = small.join(large, on).select(F.least("s_b", "l_b").alias("a"), F.greatest("s_b", "l_b").alias("b")).distinct().withColumn("among_more", F.lit(False))
    found = work_table(found, "open-pairs")
    drop_work_table(ranked)
    return found


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between classes as links between their components so far."""
    label = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
    both = links.join(label("a"), "a", "left").join(label("b"), "b", "left")
    return both.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).distinct()


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, n_shingles, component_id, k) for J >= num / den; ``k`` is the hash of id
    and text, which tells rows apart (row_key()).

    ``seed`` salts the classes' 64-bit hashes; two different sets with equal hashes
    (about one chance in a million for five million documents) stop the job.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumns({"k": row_key("doc_id", "text"), "raw": F.col("text").cast("binary")}).select("doc_id", "k", "raw")
    sketches = work_table(_sketches(src, n, num, den, seed), "sketches")
    classes = sketches.where("n_shingles > 0").groupBy("h").agg(F.min("doc_id").alias("least"), F.min("k").alias("k"), F.when(F.min("h2") != F.max("h2"), F.raise_error(F.lit("two sets have one hash: give another seed"))).alias("clash"))
    classes = work_table(classes.where("clash IS NULL").drop("clash"), "classes")
    pairs = _candidates(sketches)
    rows_of = work_table(sketches.drop("odd", *SIGNATURES), "documents")
    ends = lambda of: of.select(F.col("a").alias("h")).union(of.select("b")).distinct()
    marks = sketches.where("odd IS NOT NULL").join(ends(pairs), "h", "left_semi").groupBy("h").agg(F.first("n_shingles").cast("int").alias("size"), F.first("odd").alias("odd"))
    marks = work_table(marks, "marks")
    drop_work_table(sketches)
    parted = work_table(_parted(pairs, marks, num, den), "parted")
    drop_work_table(pairs)
    near = parted.where("NOT far").drop("far")
    texts = work_table(src.join(ends(near).join(classes, "h").select("h", "k"), "k").select("h", "raw"), "texts")
    compared = work_table(_compared(near, texts, n, num, den), "compared")
    labels = components(compared.where("linked").select("a", "b"))
    stray_pairs = _stray_pairs(parted, labels, marks, num, den)
    for table in (parted, marks):
        drop_work_table(table)
    open_pairs = _open_pairs(compared, labels, num, den)
    new = ends(stray_pairs).join(texts.select("h"), "h", "left_anti").join(classes, "h").select("h", "k")
    stray_texts = work_table(src.join(new, "k").select("h", "raw"), "stray-texts")
    open_pairs, texts, old = open_pairs.unionByName(stray_pairs), texts.unionByName(stray_texts), (open_pairs, stray_pairs, texts, stray_texts)
    more = work_table(_compared(open_pairs, texts, n, num, den).where("linked").select("a", "b"), "more-links")
    if more.limit(1).count():
        joined = components(_between(more, labels)).select(F.col("node").alias("label"), F.col("label").alias("further"))
        known = labels.join(ends(more).withColumnRenamed("h", "node"), "node", "full").select("node", F.coalesce("label", "node").alias("label"))
        labels = known.join(joined, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    named = classes.join(labels.withColumnRenamed("node", "h"), "h", "left").select("h", "least", F.coalesce("label", "h").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = named.join(least, "label").select("h", "component_id")
    of_class = work_table(of_class, "class-components")
    for table in (classes, *old, more):
        drop_work_table(table)
    out = rows_of.join(of_class, "h", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "k")


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies, that with the least id, and all
    documents without words; all columns."""
    found = jaccard_components(docs, n, num, den, id_col, text_col)
    grouped = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("k"))).alias("first"))
    key = fresh(docs, "k")
    stay = grouped.select(F.col("first.k").alias(key)).union(found.where("n_shingles = 0").select("k")).distinct()
    kept = docs.withColumn(key, row_key(id_col, text_col)).join(stay, key, "left_semi")
    return kept.dropDuplicates([key]).drop(key)
