"""Packing, source divergence and periodic runs against brute force and SQL."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from pactlens.llm import ann, divergence, entries, packing, period_runs, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank long, task long, runs string"
ODD = [None, "", " \n\t ", "one", "Ünï çödé 漢字 🙂", "the same text again and again " * 30, "the same text again and again " * 30, "x" * 20000, "word " * 5000, "a<|endoftext|>b  <|endoftext|>", "a  b \n\n c   "]


def odd_docs(spark, rows=ODD):
    data = [(i if i != 3 else None, t, ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4], len(t or ""), 1, 2, "r") for i, t in enumerate(rows)]
    return spark.createDataFrame(data + data[-3:-2], DOCS) if rows else spark.createDataFrame([], DOCS)


# --- packing -------------------------------------------------------------------------


def fewest(items, capacity):
    best = [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[k]:
                at = rooms.index(room)
                go(k + 1, rooms[:at] + [room - items[k]] + rooms[at + 1 :])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0]


def whole(counts, plan, capacity):
    at, got = collections.defaultdict(list), collections.Counter()
    for size, low, n, each, first, offset in plan.rows:
        assert low == got[size]
        got[size] += n
        for k in range(n):
            at[first + k // each].append((offset + k % each * size, size))
    assert got == collections.Counter({k: v for k, v in counts.items() if v})
    assert sorted(at) == list(range(plan.sequences))
    for parts in at.values():
        end = 0
        for offset, size in sorted(parts):
            assert offset == end
            end += size
        assert end <= capacity


def test_reduction_keeps_the_optimum():
    rng, at_best = random.Random(1), 0
    for _ in range(600):
        capacity = rng.choice([7, 10, 20, 50])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 8))), reverse=True)
        plan = packing.Plan(collections.Counter(items), capacity)
        whole(collections.Counter(items), plan, capacity)
        left = collections.Counter(items)
        only = packing.Plan({}, capacity)
        only.next = dict.fromkeys(left, 0)
        rest = packing.Counts(left)
        only._reduce(rest)
        best = fewest(items, capacity)
        assert best == only.fixed + fewest(sorted(rest.of and [s for s, n in rest.of.items() for _ in range(n)] or [], reverse=True), capacity)
        at_best += plan.sequences == best
    assert at_best > 590


def test_plan_of_many_pieces():
    for seed, centre in enumerate((5.5, 6.5, 7.5)):
        sizes = np.minimum(np.random.default_rng(seed).lognormal(centre, 1, 50_000).astype(int) + 1, 2048)
        counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
        plan = packing.Plan(counts, 2048)
        whole(counts, plan, 2048)
        least = max(-(-int(sizes.sum()) // 2048), int((sizes > 1024).sum()))
        assert plan.sequences <= 1.01 * least + 1 and len(plan.rows) < 20_000


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, enc = Tokenizer.from_file(path), packing.Encoder(path)
    assert enc.fast is not None and packing.Encoder(P.path("word_bpe_49k.json")).fast is None
    rng = random.Random(1)
    alphabet = "aaab the  e\n\t1234.,!?'s've éß漢字🙂  \x1c\x85ıΣn't<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)] + [t for t in ODD if t] + [" ab 12" * 200_000]
    for t in texts:
        assert enc.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_pack(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = odd_docs(spark)
    out = packing.pack(docs.repartition(3), path, with_ids=True).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        for k, (a, b) in enumerate([(0, first)] + [(x, x + 2048) for x in range(first, len(ids), 2048)]):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(by) == -(-sum(r.length for r in out) // 2048)
    built = packing.sequences(packing.pack(docs, path, with_ids=True))
    assert built.agg(F.sum("n_tokens"), F.max("n_tokens")).first() == (sum(r.length for r in out), 2048)
    assert not packing.pack(odd_docs(spark, []), path).count()


# --- divergence ----------------------------------------------------------------------


@pytest.mark.parametrize("rows", [ODD, [], ["Abc abc ÄB ab-c"] * 40, [f"w{i % 7} x{i % 3}a b{'c' * (i % 5)} {'q' * (i % 11)}" for i in range(300)]])
def test_divergence_equals_sql(spark, rows):
    docs = odd_docs(spark, rows)
    got = divergence.divergence(docs)
    documents = docs.toArrow()  # noqa: F841
    want = duckdb.sql(entries.DIVERGENCE)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == sorted(want.select("lang, source, part, item, value, rank").fetchall())


def test_divergence_flushes_and_ranks(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 5)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 3, "source": ["a", "b", "a"], "text": ["a b c d e f a", "a", "b c a"]})
    n, docs = collections.Counter(), collections.Counter()
    for b in divergence.count_terms(iter([batch, batch])):
        for r in b.to_pylist():
            n[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    assert n["a", "a"] == 6 and docs["a", "a"] == 4 and n["a", "f"] == 2 and n["b", "a"] == 2 and n["a", ""] == 0
    rows = odd_docs(spark, [f"t{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(900)])
    got = divergence.divergence(rows.withColumn("lang", F.lit("en")).withColumn("source", F.when(F.col("doc_id") < 450, "a").otherwise("b")), top=5, least_docs=1)
    assert got.where("part = 'term'").groupBy("source").count().collect() == [("a", 5), ("b", 5)] or got.where("part = 'term' AND rank > 5").count() == 0


# --- periodic runs -------------------------------------------------------------------


def all_runs(w):
    n, out = len(w), []
    for q in range(1, n + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(w[x] == w[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_a_full_search():
    rng, met = random.Random(3), 0
    for _ in range(800):
        k = rng.choice([1, 2, 3, 8])
        w = [rng.randrange(k) for _ in range(rng.choice([0, 5, 6, 8, 20, 60, 120]))]
        if rng.random() < 0.6:
            w = []
            for _ in range(rng.randint(1, 4)):
                block = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
                w += (block * rng.randint(1, 9))[: rng.randint(1, 60)]
        got = period_runs.find_runs(np.array(w, np.int64)) if w else []
        assert got == all_runs(w)
        met += len(got)
    assert met > 500


def test_lag_counts_of_heavy_and_light_words(monkeypatch):
    monkeypatch.setattr(period_runs, "CELLS", 2000)
    monkeypatch.setattr(period_runs, "GATHERED", 100)
    rng = np.random.default_rng(2)
    for n, k in ((1, 1), (50, 3), (400, 5), (700, 90), (900, 900)):
        ids = rng.integers(0, k, n)
        counts = period_runs.lag_counts(ids, n // 2)
        assert [int((ids[q:] == ids[: n - q]).sum()) for q in range(1, n // 2 + 1)] == counts[1:].tolist()
    long = np.zeros(200_000, np.int64)
    assert period_runs.find_runs(long) == [(0, 200_000, 1)]


def test_period_runs_query(spark, tmp_path):
    rng = random.Random(4)
    texts = [*ODD, *[" ".join(rng.choice(["a", "b", "ä", "\x1cc"]) for _ in range(rng.randint(0, 80))) for _ in range(150)], "\x0b x " * 7]
    docs = odd_docs(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, entries.queries()["op13_period_runs"](spark, str(tmp_path)).collect()), key=str)
    want = []
    for r in docs.collect():
        words = (r.text or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        n = len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        short = {w: k for k, w in enumerate(dict.fromkeys(words))}
        runs = all_runs([short[w] for w in words]) if n < 3000 else [(0, n, 1)]
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        row = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((r.doc_id, len(runs), *row, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert got == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 10
    carried = period_runs.period_runs(docs, carry=("runs", "rank", "text"))
    assert carried.columns[:4] == ["doc_id", "runs", "rank", "text"] and carried.count() == len(want)
    assert not period_runs.period_runs(odd_docs(spark, [])).count()


# --- neighbours past several shards --------------------------------------------------


def nearest_by_brute_force(ids, x, asked, k):
    out = set()
    for q in asked:
        s = np.cumsum(x * x[q], axis=1)[:, -1]
        order = [r for r in np.lexsort((ids, -s)) if r != q][:k]
        out.update((int(ids[q]), int(ids[r])) for r in order)
    return out


def test_neighbours_past_shards():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 12)).astype(np.float32).astype(float)
    x[100:400] = x[7]
    x[900:1000] = np.sign(x[900:1000])
    ids = rng.permutation(3000) * 2
    asked = np.arange(0, 3000, 60)
    largest = float(np.sqrt((x**2).sum(axis=1).max())) * (1 + 1e-12)
    shards = [ann.Shard(ids[k::5], x[k::5], largest) for k in range(5)]
    qi, found, score = ann.past_shards(iter(shards), ids[asked], x[asked], 20, 1.0)
    assert set(zip(ids[asked][qi].tolist(), found.tolist())) == nearest_by_brute_force(ids, x, asked, 20)
    assert (np.bincount(qi) == 20).all()


def test_recall_of_relaxed_factors():
    """Exact at factor one; further factors trade recall for fewer visited leaves."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 6000)] + 0.3 * rng.normal(size=(6000, 16))
    ids, asked = np.arange(6000), np.arange(0, 6000, 100)
    largest = float(np.sqrt((x**2).sum(axis=1).max())) * (1 + 1e-12)
    shards = [ann.Shard(ids[k::2], x[k::2], largest) for k in range(2)]
    want = nearest_by_brute_force(ids, x, asked, 20)
    recall = {}
    for factor in (1.0, 1.1, 1.5):
        qi, found, _ = ann.past_shards(iter(shards), ids[asked], x[asked], 20, factor)
        recall[factor] = len(want & set(zip(ids[asked][qi].tolist(), found.tolist()))) / len(want)
    assert recall[1.0] == 1.0 and recall[1.1] >= 0.9, recall
    print(recall)


def test_vectors_are_shuffled_once(spark):
    """Ten blocks of queries: the vectors are in two exchanges (shards, blocks), not in ten."""
    rows = [(i, [float(i % 13), float(i % 7), 1.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.nearest(df, k=3, block_rows=2, shard_rows=50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "array" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    x = np.array([v for _, v in rows])
    got = {(r.query_id, r.vec_id) for r in out.collect()}
    assert got == nearest_by_brute_force(np.arange(400), x, np.arange(0, 400, 20), 3)


# --- factors of substring deduplication ----------------------------------------------


def test_a_copy_is_one_factor(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared = fresh(1000)
    rows = [(1, fresh(60) + shared + fresh(70)), (2, fresh(11) + shared + fresh(9)), (3, fresh(300)), (4, fresh(50) + shared[100:180] + fresh(50) + shared[400:460])]
    factors = lambda rows: {r.doc_id: (r.n_factors, r.n_removed) for r in substring_dedup.dedup_substrings(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()}
    assert factors(rows[:3]) == {1: (1, 1000), 2: (1, 1000), 3: (0, 0)}
    assert factors([rows[0], rows[3]]) == {1: (2, 140), 4: (2, 140)}
    # three places of a passage, of which the index keeps two: what goes is the same
    got = factors(rows)
    assert (got[2], got[3], got[4]) == ((1, 1000), (0, 0), (2, 140)) and got[1][1] == 1000


def longest_matches(words, other, window):
    """Greedy parse against one other text, by brute force: (first word, words)."""
    out, at = [], 0
    while at + window <= len(words):
        best = 0
        for j in range(len(other)):
            n = 0
            while at + n < len(words) and j + n < len(other) and words[at + n] == other[j + n]:
                n += 1
            best = max(best, n)
        if best >= window:
            out.append((at, best))
            at += best - window + 1  # the next factor starts at the next window
        else:
            at += 1
    return out


def test_parse_equals_longest_matches(spark):
    """Two documents with several passages in common: what the index knows is all there is."""
    rng = random.Random(9)
    for trial in range(4):
        fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]  # noqa: B023, E731
        parts = [fresh(rng.randint(36, 260)) for _ in range(4)]
        a = fresh(20) + parts[0] + fresh(9) + parts[1] + parts[2] + fresh(40) + parts[3]
        b = parts[2] + fresh(5) + parts[0] + fresh(50) + parts[3] + fresh(3) + parts[1]
        out = {r.doc_id: r for r in substring_dedup.dedup_substrings(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")).collect()}
        for doc, mine, other in ((1, a, b), (2, b, a)):
            want = longest_matches(mine, other, 35)
            gone = set().union(*(range(s, s + n) for s, n in want))
            assert (out[doc].n_factors, out[doc].n_removed) == (len(want), len(gone)), (trial, doc)


def test_diagonals():
    lo, hi = np.array([0, 5, 9, 9, 20]), np.array([4, 8, 12, 12, 30])
    got = substring_dedup.on_diagonals((lo << 31) + hi, np.array([7, 7, 7, 3, 7]), np.array([10, 10, 10, 2, 10]))
    assert sorted((int(x) >> 31, int(x) & 0x7FFFFFFF) for x in got) == [(0, 12), (9, 12), (20, 30)]
