"""The operators of llm against brute force on small fixtures, with the odd rows that tables can hold."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tracewell.llm import asking, bpe, fixity, lm, minhash, mixing, neighbours, parsing, perplexity, quality_rules, registry, toxicity
from tracewell.llm.common import text_bytes, union_find

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def odd_documents():
    """Null, empty, blank, long, repeated and near-equal texts, null ids, a repeated id, odd characters."""
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta", "eta!", "théta", "iota", "kappa", "<|endoftext|>", "naïve", "日本", "x" * 40]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(60)
    shared = say(20)
    texts = [None, "", " \n\t", "one", "one two three four", base, base, base + " more", base.replace("alpha", "omega", 1), say(30) + " " + shared, shared + " " + say(30), "ab " * 300, "a" * 700, say(4000), "line\nline\nother\n\nline", "\x1c \x85   end"]
    rows = [(i, t, None if i % 5 == 3 else ["en", "de"][i % 2], None if i % 7 == 6 else f"s{i % 3}", len(t) if t else None) for i, t in enumerate(texts)]
    return rows + [(5, base, "en", "s1", 1), (7, "another text of id seven", "en", "s1", 1), (None, base, "en", "s0", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), DOCS)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- 1 ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_equals_the_library(tokenizer):
    rng = random.Random(2)
    pool = "abc  \n\t'stre ré日本 \u0085 \x1c<|endoftext|>١²🙂́ªº_"
    texts = [t for _, t, *_ in odd_documents()] + ["".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(1500)]
    v = bpe.Vocabulary(bpe.default_vocabulary())
    for t, ids in zip(texts, v.encode(texts)):
        want = tokenizer.encode(t or "", add_special_tokens=False)
        assert ids == want.ids
        assert v.decode(ids) == tokenizer.decode(want.ids, skip_special_tokens=False)


def test_bpe_columns(spark, odd, tokenizer):
    for df in (odd, empty(spark)):
        got = bpe.round_trip(df).collect()
        assert len(got) == df.count()
    want = Counter()
    for i, t, *_ in odd_documents():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(odd).collect()) == want
    back = bpe.decode(bpe.encode(odd.withColumn("ids", F.lit(1)))).select("doc_id", "text", "lang").collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "", g) for i, t, g, *_ in odd_documents())


# ---- 2 ----------------------------------------------------------------------------------------------------------


def lm_base(rows):
    words = lambda t: (t or "").encode().lower().split()
    fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 5
    train = Counter()
    n = 0
    for i, t in rows:
        if fold(i) != 1:
            train.update(words(t))
            n += 1
    total, different = sum(train.values()) + n, len(train) + (n > 0)
    value = lambda c: math.log10((c + 0.5) / (total + 0.5 * (different + 1)))
    return [(i, fold(i) == 1, len(w) + 1, sum(x in train for x in w) + (n > 0), total, round(sum(value(train[x]) for x in w) + value(n), 6)) for i, t in rows for w in [words(t)]]


@pytest.mark.parametrize("which", ["odd", "real"])
def test_lm_base(request, which):
    df = request.getfixturevalue(which)
    got = lm.score(df).collect()
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == Counter(lm_base(rows))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_lm_learns(real):
    got = lm.score(real).toPandas()
    per = got.groupby("held_out")[["score", "n_tokens"]].sum()
    bits = -per.score / per.n_tokens / math.log10(2)
    assert bits[False] < 0.7 * bits[True] < 0.7 * 20


def test_lm_without_rows(spark):
    assert lm.score(empty(spark)).count() == 0


def sequence(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


def ppm(sequences, order):
    """The trie by loops over dictionaries: the probability of a byte after a context."""
    nodes = {order: Counter()}
    for s in sequences:
        raw = b"\n" * order + s
        nodes[order].update(raw[i : i + order + 1] for i in range(len(s)))
    for k in range(order - 1, -1, -1):
        nodes[k] = Counter(g[1:] for g in nodes[k + 1])
    symbols = {}
    for k in nodes:
        for g, n in nodes[k].items():
            symbols.setdefault(g[:-1], {})[g[-1]] = n

    def p(context, s):
        below = lambda x: p(context[1:], x) if context else 1 / 256
        met = symbols.get(context)
        if met is None:
            return below(s)
        total = sum(met.values())
        own = (met[s] - lm.DISCOUNT) / total if s in met else 0
        if met.get(s, 0) >= lm.OFTEN:
            return own
        rest = 1 - sum(below(x) for x in met if met[x] >= lm.OFTEN)
        return own + lm.DISCOUNT * len(met) / total * below(s) / max(rest, 1e-9)

    return p


@pytest.mark.parametrize("which", ["odd", "real"])
def test_lm_score_equals_loops(spark, request, monkeypatch, which):
    monkeypatch.setattr(lm, "SHARD_BYTES", 1 << 12)
    monkeypatch.setattr(asking, "PACK", 1 << 9)
    monkeypatch.setattr(lm, "BLOCK", 1 << 14)
    rows = request.getfixturevalue(which).limit(40).collect()
    fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 5
    p = ppm([sequence(r["text"]) for r in rows if fold(r["doc_id"]) != 1], lm.ORDER)
    memory = {}

    def log10(g):
        if g not in memory:
            memory[g] = math.log10(p(g[:-1], g[-1]))
        return memory[g]

    want = []
    for r in rows:
        raw = b"\n" * lm.ORDER + sequence(r["text"])
        want.append((repr(r["doc_id"]), sum(log10(raw[i - lm.ORDER : i + 1]) for i in range(lm.ORDER, len(raw)))))
    docs = spark.createDataFrame(rows, DOCS).withColumn("_text", F.lit("x")).withColumn("g", F.lit(1))
    got = sorted((repr(r["doc_id"]), r["score"]) for r in lm.score(docs).collect())
    assert len(got) == len(want)
    assert all(x[0] == y[0] and abs(x[1] - y[1]) < 1e-9 * (1 + abs(y[1])) for x, y in zip(got, sorted(want)))


def test_ppm_is_a_distribution():
    p = ppm([b"the cat\n", b"then a hen\n", b"the hat\n"], 3)
    for context in (b"\n\n\n", b"the", b"he ", b"xyz"):
        assert abs(sum(p(context, s) for s in range(256)) - 1) < 1e-9


def test_grams_and_index():
    rng = random.Random(13)
    texts = ["".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 9]))) for _ in range(300)]
    for order in (1, 2, 5, 7):
        code, row = asking.grams(*text_bytes(pa.array(texts)), order)
        want = [int.from_bytes((b"\n" * order + t.encode())[k + 1 : k + 1 + order], "big") for t in texts for k in range(len(t))]
        assert code.tolist() == want and row.tolist() == [i for i, t in enumerate(texts) for _ in t]
        all_ = np.unique(np.r_[code, -code - 1])
        places = asking.Places(len(all_))
        at = places(np.r_[code, -code - 1])
        met, of = places.met()
        assert sorted(met) == all_.tolist() and (places.bag.code[at] == np.r_[code, -code - 1]).all() and (places.bag.code[of] == met).all()
    rng = np.random.default_rng(5)
    tally, out = asking.Tally(1 << 13), []
    many = [rng.integers(-(2**62), 2**62, 50_000) for _ in range(3)] + [rng.integers(0, 99, 5000)]
    for x in [*many, many[0]]:
        out += [b for b in tally.add(x)]
    out += [b for b in tally.add(np.array([7, 1000]), 0)] + list(tally.rest())
    got = Counter()
    for b in out:
        for g, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got[g] += c
    want = Counter(np.concatenate([*many, many[0]]).tolist())
    want[1000] += 0
    assert got == want and len(out) > 1


# ---- 3 ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block, lot", [(neighbours.BLOCK, neighbours.QUERIES), (64, 4)])
def test_neighbours(spark, sf_dir, monkeypatch, block, lot):
    for name, value in (("BLOCK", block), ("QUERIES", lot), ("LEAST_BLOCK", min(block, neighbours.LEAST_BLOCK)), ("LEAST_LOT", min(lot, neighbours.LEAST_LOT))):
        monkeypatch.setattr(neighbours, name, value)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = neighbours.op3_collision_counting(spark, sf_dir).collect()
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    ids = np.array(sorted(data))
    all_ = np.stack([data[i] for i in ids])
    hits, by = 0, {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {i for i in data if i % 20 == 0}
    for q, found in by.items():
        score = all_ @ data[q]
        score[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]])
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        assert all(abs(r["score"] - data[q] @ data[r["vec_id"]]) < 1e-12 for r in found)
        hits += len(best & {r["vec_id"] for r in found})
    assert hits >= 0.9 * 20 * len(by)


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [0.5, 0.5]), (8, [1.0, 0.0]), (None, [1.0, 1.0]), (20, [1.0, 1.0]), (40, [3.0, 0.0, 1.0]), (60, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x"))
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 1.0), (0, 2, 8, 1.0), (0, 3, 20, 1.0), (0, 4, 7, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 7, 1.0), (20, 4, 8, 1.0)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


# ---- 4 ----------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark, sf_dir):
    big = "/root/testdata/sf0.01"
    got = toxicity.op4_toxicity(spark, big)
    y = got.join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (y.predicted == y.toxic).mean() > 0.9
    assert y[y.toxic == 0].predicted.mean() < 0.03


def test_toxicity_odd_rows(spark, odd, labels):
    some = spark.createDataFrame([(i, 1, t) for i, t in ((1, 1), (2, None), (5, 0), (9, 1), (9, 0), (None, 1))], LABELS)
    for df, lab in ((odd, some), (empty(spark), some), (odd, some.limit(0))):
        got = toxicity.score(df, lab).collect()
        assert len(got) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)


def test_deobfuscation(spark):
    model = toxicity.character_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    said = toxicity.restore(["1d10t", "id!ot", "stuuupid", "l.o.s.e.r", "tr@sh", "m0r0n!", "hello", "the,", "2024", "été", "stuupid"], model)
    assert said == ["idiot", "idiot", "stupid", "loser", "trash", "moron", "hello", "the", "2024", "été", "stupid"]
    for text in ("you i d i o t there", "you 1 d 1 o t there", "you are s t u p ! d here"):
        runs = [t for t in toxicity.text_tokens(text) if " " in t]
        assert len(runs) == 1 and {"idiot", "stupid"} & set(toxicity.restore(runs, model)[0].split()), toxicity.restore(runs, model)


def test_letters_said_once():
    """The outright scores of letters alone against the lattice."""
    rng = random.Random(14)
    model = np.log(np.random.default_rng(8).dirichlet(np.ones(28), (28, 28))).astype(np.float32)
    tokens = ["aab", "bookkeeper", "ééa", "xx", "committee"] + ["".join(rng.choice("aabé") * rng.choice((1, 1, 2)) for _ in range(5)) for _ in range(40)]
    tokens = [t for t in tokens if len(toxicity.DOUBLES.findall(t)) <= 5]
    assert toxicity.said_once(tokens, model) == toxicity.viterbi(tokens, model)


def test_viterbi_finds_the_likeliest_path():
    """Against all paths of short tokens under a random model."""
    model = np.log(np.random.default_rng(7).dirichlet(np.ones(28), (28, 28))).astype(np.float32)
    tokens = ["1a", "b.b", "aa1", "$3 a", "1 1", "é|b", "q"]

    def paths(token):
        out = [((), 0.0)]
        for code in toxicity.observed(token):
            steps = [((int(x),), float(e)) for x, e in zip(toxicity.SAID[code], toxicity.EMIT[code]) if x >= 0] + [((), float(toxicity.SKIP[code]))]
            out = [(a + x, v + w) for a, v in out for x, w in steps if w > -math.inf]
        return out

    def value(said, v):
        context = (26, 26)
        for x in (*said, 26):
            v += float(model[context[0], context[1], x])
            context = (context[1], x)
        return v

    for t, got in zip(tokens, toxicity.viterbi(tokens, model)):
        best = max((value(*p), p[0]) for p in paths(t))[1]
        assert got == "".join(" " if x == 26 else "é" if x == 27 else chr(97 + x) for x in best)


def test_long_tokens_are_read_in_pieces(monkeypatch):
    """Pieces and spans give what the whole lattice gives; a token of a million characters is read in bounded memory."""
    rng = random.Random(15)
    model = np.log(np.random.default_rng(9).dirichlet(np.ones(28), (28, 28))).astype(np.float32)
    tokens = ["".join(rng.choice("abcde1$0é|.") for _ in range(rng.choice([40, 300, 900]))) for _ in range(30)] + ["1$" * 200, "ab" * 200, "aab1" * 99, "a1" * 150 + "xy"]
    whole = [toxicity.viterbi([t], model)[0] for t in tokens]
    monkeypatch.setattr(toxicity, "SPAN", 37)
    assert [toxicity.viterbi([t], model)[0] for t in tokens] == whole
    monkeypatch.setattr(toxicity, "PIECE", 5)
    assert [toxicity.long_viterbi(t, model) for t in tokens] == whole
    monkeypatch.undo()
    blob = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/".lower(), k=200_000))
    import tracemalloc

    tracemalloc.start()
    said = toxicity.restore([blob], model)[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(said) > 100_000 and most < 300 << 20


# ---- 5 ----------------------------------------------------------------------------------------------------------


def rules(text):
    w = (text or "").encode().split()

    def cover(n):
        c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        on = [False] * len(w)
        for i in range(len(w) - n + 1):
            if c[tuple(w[i : i + n])] > 1:
                on[i : i + n] = [True] * n
        return sum(on)

    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    repeated = cover(5)
    failed = len(w) < 10 or 100 * repeated > 20 * len(w)
    kept = not failed and 100 * cover(10) <= 20 * len(w) and not cover(101)
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), repeated, failed, kept


@pytest.mark.parametrize("which", ["odd", "real"])
def test_quality_rules(request, which):
    df = request.getfixturevalue(which)
    got = quality_rules.repetition(df).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((r["doc_id"], *rules(r["text"])) for r in df.collect())


def test_quality_rules_random():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n#é") for _ in range(rng.randrange(200))) for _ in range(400)]
    m = quality_rules.measure(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert tuple(m[k][i] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == rules(t)[:5]


# ---- 6 ----------------------------------------------------------------------------------------------------------


def near(rows, percent=85):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    ids = [i for i, _ in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and None not in (ids[x], ids[y]) and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(ids[x]), find(ids[y])
                root[max(p, q)] = min(p, q)
    return Counter((i, len(s), find(i) if s and i is not None else i) for i, s in zip(ids, sets))


@pytest.mark.parametrize("large", [minhash.LARGE, 1])
def test_near_duplicates(spark, odd, real, monkeypatch, large):
    monkeypatch.setattr(minhash, "LARGE", large)  # 1: all candidates are compared by leaders and bands
    monkeypatch.setattr(minhash, "FOLLOWERS", 16 if large == 1 else minhash.FOLLOWERS)
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(i, " ".join(w if rng.random() > 0.01 * (i % 6) else "new%d" % rng.randrange(10**6) for w in base)) for i in range(100, 340)]
    group = spark.createDataFrame(rows, "doc_id bigint, text string")
    for df in (odd, real, group, empty(spark)):
        got = minhash.near_duplicates(df).collect()
        want = near([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_with_repeated_ids(spark, odd):
    rng = random.Random(11)
    say = lambda: [f"w{rng.randrange(10**6)}" for _ in range(200)]
    a, b, c, d = say(), say(), say(), say()
    near_to = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near_to(a)), (3, near_to(b))]
    rows += [(10, " ".join(c)), (11, near_to(c)), (11, " ".join(d)), (12, near_to(d)), (13, " ".join(d)), (14, "alone here"), (14, None)]
    for df in (spark.createDataFrame(rows, "doc_id bigint, text string"), odd):
        for n in (1, 5):
            got = minhash.near_duplicates(df.repartition(n)).collect()
            want = near([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
            assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    both = [np.unique(a), np.unique(np.r_[a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])]
    for n in (400, 5):
        sets = [x[:n] for x in both] if n == 5 else both
        sig = minhash.super_minhash(np.concatenate(sets), np.repeat([0, 1], [len(s) for s in sets]), 2, 512)
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.08


def test_union_find():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 200, 120), rng.integers(0, 200, 120)
    root = union_find(a, b, 200)
    for _ in range(200):
        assert (root[a] == root[b]).all()
    assert (root <= np.arange(200)).all() and (root[root] == root).all()


# ---- 7 ----------------------------------------------------------------------------------------------------------


def spans(rows, length):
    first = {}
    for i, t in rows:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            if i is not None:
                first[s] = min(first.get(s, i), i)
    out = Counter()
    for i, t in rows:
        on = [False] * len(t)
        for p in range(len(t) - length + 1):
            if i is not None and first[t[p : p + length]] < i:
                on[p : p + length] = [True] * length
        kept = bytes(b for b, x in zip(t, on) if not x)
        out[(i, len(t), sum(on), sum(x and not y for x, y in zip(on, [False] + on)), kept)] += 1
    return out


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("which", ["odd", "real", "empty", "periodic"])
def test_repeated_spans(spark, request, monkeypatch, which, hot):
    if hot:  # every repeated trigger is dealt window by window
        monkeypatch.setattr(parsing, "MOST_HOT", 0)
    if which == "periodic":
        rng = random.Random(8)
        df = spark.createDataFrame([(i, "".join(rng.choice(["ab", "abc", "xyz" * 9]) for _ in range(rng.randrange(60)))) for i in range(80)], "doc_id bigint, text string")
    else:
        df = empty(spark) if which == "empty" else request.getfixturevalue(which)
    got = parsing.deduplicate(df).collect()
    want = spans([(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()], 50)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want
    assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_whole_texts_after_removal(spark, odd):
    got = parsing.without_repeats(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    clash = odd.select("*", *(F.lit(1).alias(c) for c in ("kept", "spans", "block", "row_key", "n_bytes")))
    assert parsing.without_repeats(clash).columns == clash.columns


def test_cut_characters_do_not_meet():
    assert parsing._cut("é-----ß".encode(), np.array([[1, 8]]), True)[0] == b""
    assert parsing._cut("é-----ß".encode(), np.array([[1, 8]]), False)[0] == b"\xc3\x9f"


def test_sorted_ranks():
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab\0") for _ in range(rng.randrange(20))).encode() for _ in range(500)]
    size = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    order, _, rank = parsing.sorted_ranks(parsing.rows_of(flat, np.cumsum(size) - size, size, 24), size)
    assert [texts[i] for i in order] == sorted(texts)
    assert rank.tolist() == [sorted(set(texts)).index(t) for t in texts]


# ---- 8 ----------------------------------------------------------------------------------------------------------


def test_fixity_finds_what_differs(spark):
    rows = [(i, f"http://x/{i}", None if i % 9 == 0 else f"<p>{i}</p>" * (i % 5)) for i in range(150)] + [(7, "http://x/7", "twice"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    bad = pages.withColumn("html", F.when(F.col("page_id").isin(20, 64, 149), F.translate("html", "p", "q")).otherwise(F.col("html")))
    got = fixity.audit(pages, bad, file_records=50, fanout=4).collect()
    assert len(got) == len(rows)
    assert sorted(r["page_id"] for r in got if not r["intact"]) == [64, 149]  # page 20 is empty and did not change
    assert all(r["intact"] for r in fixity.audit(pages, pages, 50, 4).collect())
    missing = fixity.audit(pages, pages.where("page_id <> 149 or page_id is null"), 50, 4).where("not intact").collect()
    assert [r["page_id"] for r in missing] == [149]
    assert fixity.audit(pages.limit(0), pages.limit(0)).count() == 0


# ---- 9 ----------------------------------------------------------------------------------------------------------


def test_poisson_mix(spark, odd):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"))
    got = mixing.poisson_mix(many, weights={"small": 0.5, "large": 0.5}).groupBy("source").count().collect()
    assert all(abs(r["count"] - 10_000) < 500 for r in got) and len(got) == 2
    counts = mixing.poisson_mix(many.where("source = 'small'"), weights={"small": 1.0}, total=4000).groupBy("doc_id").count().groupBy("count").count().collect()
    seen = {r[0]: r[1] for r in counts}
    assert all(abs(seen[k] - 2000 * math.exp(-2) * 2**k / math.factorial(k)) < 80 for k in (1, 2, 3))
    again = [sorted(map(tuple, mixing.poisson_mix(odd.repartition(n)).select("doc_id", "copy").collect()), key=repr) for n in (1, 3)]
    assert again[0] == again[1]
    assert mixing.poisson_mix(empty(spark)).count() == 0


def exact_poisson(mean, u):
    """The number of k whose cumulative probability is not above u, from logarithms."""
    cdf, k = 0.0, 0
    while True:
        cdf += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        if cdf > u:
            return k
        k += 1


@pytest.mark.parametrize("mean", [1, 100, 800, 5000])
def test_poisson_draws_equal_quantiles(spark, mean):
    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("_source"), F.lit(1.0).alias("rate"))
    got = mixing.poisson_mix(rows, weights={"s": 1.0}, total=60 * mean)
    assert got.columns == [*rows.columns, "copy", "shuffle_key"]
    got = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    parts = max(1, math.ceil(mean / mixing.MEAN))
    u = lambda key: int(hashlib.md5(f"{mixing.SEED}:{key}".encode()).hexdigest()[:13], 16) / 2**52
    for i in range(60):
        keys = [str(i)] + [f"part:{j}:{i}" for j in range(2, parts + 1)]
        assert got.get(i, 0) == sum(exact_poisson(mean / parts, u(k)) for k in keys)


def test_poisson_sql_with_several_parts(spark, monkeypatch):
    """A mean of 141 in parts of at most 20: the rows' own SQL with that bound."""
    monkeypatch.setattr(mixing, "MEAN", 20)
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 2, "rare").otherwise("common").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    sql = mixing.OP9_SQL.replace("rate / 500", "rate / 20")
    want = dict(con.execute(f"SELECT doc_id, count(*) FROM ({sql}) WHERE doc_id < 50 GROUP BY 1").fetchall())
    got = {r["doc_id"]: r["count"] for r in mixing.poisson_mix(df).where("doc_id < 50").groupBy("doc_id").count().collect()}
    assert got == want and got[0] > 100


def test_poisson_mix_with_many_sources(spark, odd, monkeypatch):
    few = sorted(map(tuple, mixing.poisson_mix(odd).drop("shuffle_key").collect()), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mixing.poisson_mix(odd).drop("shuffle_key").collect()), key=repr) == few


@pytest.mark.parametrize("mean, most", [(1000, 10_000), (5000, 10_000), (1000, 0)])
def test_poisson_mix_with_large_means(spark, monkeypatch, mean, most):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    got = [r["count"] for r in mixing.poisson_mix(rows, weights={"s": 1.0}, total=300 * mean).groupBy("doc_id").count().collect()]
    assert len(got) == 300 and abs(np.mean(got) - mean) < 4 * math.sqrt(mean / 300)
    assert abs(np.var(got) / mean - 1) < 4 * math.sqrt(2 / 300)


# ---- 10 ---------------------------------------------------------------------------------------------------------


def kneser_ney(counts):
    """The model by loops over dictionaries: a function of (context and byte)."""
    order = perplexity.ORDER
    orders = {order: dict(counts)}
    for k in range(order - 1, 0, -1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])
    cuts, total, freed = {}, Counter(), Counter()
    for k in orders:
        of = Counter(orders[k].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
        cuts[k] = {i: min(max(i - (i + 1) * y * of[i + 1] / of[i] if of[i] else 0.5, 0.1), i - 0.1) for i in (1, 2, 3)}
        for g, c in orders[k].items():
            total[k, g[:-1]] += c
            freed[k, g[:-1]] += cuts[k][min(c, 3)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        c, t = orders[k].get(g, 0), total[k, g[:-1]]
        return p(g[1:]) if not t else ((c - cuts[k][min(c, 3)] if c else 0) + freed[k, g[:-1]] * p(g[1:])) / t

    return p


def byte_ngrams(text):
    raw = b"\n" * (perplexity.ORDER - 1) + (text or "").encode()
    return [raw[i : i + perplexity.ORDER] for i in range(len(raw) - perplexity.ORDER + 1)]


def test_kneser_ney_is_a_distribution():
    p = kneser_ney(Counter(g for t in ("the cat sat on the mat", "a hat") for g in byte_ngrams(t)))
    for h in (b"the ", b"n th", b"zzzz"):
        assert abs(sum(p(h + bytes([w])) for w in range(256)) - 1) < 1e-9


@pytest.mark.parametrize("which", ["odd", "real"])
def test_classifier_equals_loops(spark, request, labels, monkeypatch, which):
    df = request.getfixturevalue(which).limit(120)
    some = labels if which == "real" else spark.createDataFrame([(i, 1, 0) for i in (0, 3, 4, 5, 8, 12)] + [(5, 1, 0), (6, 0, 0), (None, 1, 0)], LABELS)
    monkeypatch.setattr(perplexity, "LEAST_TRUSTED", 3)
    monkeypatch.setattr(perplexity, "BLOCK", 1 << 14)
    monkeypatch.setattr(perplexity, "SHARD", 1 << 10)
    monkeypatch.setattr(asking, "PACK", 1 << 9)
    docs = df.collect()
    good = {r["doc_id"] for r in some.collect() if r["quality"] == 1} - {None}
    p = kneser_ney(Counter(g for r in docs if r["doc_id"] in good for g in byte_ngrams(r["text"])))
    bits = lambda t: -sum(math.log2(p(g)) for g in byte_ngrams(t))
    value = [2 ** (bits(r["text"]) / len(r["text"].encode())) if (r["text"] or "").encode().split() else None for r in docs]
    by = {}
    for r, v in zip(docs, value):
        if r["doc_id"] in good and v is not None:
            by.setdefault(r["lang"] or "", []).append(v)
            by.setdefault("*", []).append(v)
    most = {k: perplexity.MARGIN * np.percentile(v, 100 * perplexity.QUANTILE) for k, v in by.items() if k == "*" or len(v) >= 3}
    want = sorted((repr(r["doc_id"]), len((r["text"] or "").encode()), v, most.get(r["lang"] or "", most["*"])) for r, v in zip(docs, value) if v is not None)
    got = perplexity.judged(df, some)
    assert got.columns == [*df.columns, "n_symbols", "perplexity", "threshold", "kept"] and got.count() == len(docs)
    found = sorted((repr(r["doc_id"]), r["n_symbols"], r["perplexity"], r["threshold"]) for r in got.where("perplexity is not null").collect())
    assert len(found) == len(want)
    for x, y in zip(found, want):
        assert x[:2] == y[:2] and abs(x[2] / y[2] - 1) < 1e-4 and abs(x[3] / y[3] - 1) < 1e-4
    assert all(r["kept"] == (r["perplexity"] is not None and r["perplexity"] <= r["threshold"]) for r in got.collect())


def test_classifier_keeps_clean_texts(spark):
    d = "/root/testdata/sf0.01"
    got = perplexity.op10_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.98
    assert got[got.quality == 0].kept.mean() < 0.3


def test_classifier_uses_all_trusted_rows(spark):
    say = F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(" of "), F.md5(F.col("id").cast("string")))
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), say.alias("text"), F.when(F.col("id") % 500 == 0, "rare").otherwise("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert perplexity.train(docs, labels).agg(F.sum("c")).first()[0] == docs.agg(F.sum(F.length("text"))).first()[0]
    got = perplexity.judged(docs, labels).toPandas()
    for name, rows in got.groupby("lang"):  # 60 of 30,000 are rare: fewer than 50 of any 20,000
        assert np.allclose(rows.threshold, perplexity.MARGIN * np.percentile(rows.perplexity, 100 * perplexity.QUANTILE), rtol=1e-12), name


def test_quantiles_equal_percentile(spark):
    rng = random.Random(10)
    rows = [(g, rng.choice([2.0, 3.5, rng.lognormvariate(2, 1)])) for g, n in (("a", 1), ("b", 2), ("c", 101), ("d", 5000)) for _ in range(n)] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "of string, v double")
    for q in (0.0, 0.5, 0.99, 1.0):
        want = {r["of"]: (r["n"], r["at"]) for r in df.groupBy("of").agg(F.count("v").alias("n"), F.percentile("v", F.lit(q)).alias("at")).where("n > 0").collect()}
        got = {r["of"]: (r["n"], r["at"]) for r in perplexity.quantiles(df, q).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)


def test_classifier_odd_rows(spark, odd, labels):
    got = perplexity.judged(odd, labels).collect()
    assert len(got) == odd.count()
    assert all(not r["kept"] and r["perplexity"] is None for r in got if not (r["text"] or "").strip(" \n\t"))
    assert perplexity.judged(empty(spark), labels.limit(0)).count() == 0
    assert perplexity.judged(odd, labels.limit(0)).count() == odd.count()


# ---- all --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = registry.queries()[name](spark, sf_dir)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(cursor.fetchall())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = p.quality(spark, docs, sf_dir)
    assert good.columns == list(p.COLUMNS)
    clean = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    assert clean.join(good, "doc_id", "left_anti").count() <= 0.03 * clean.count()
    kept = p.near_duplicates(spark, docs, sf_dir)
    want = near([(r["doc_id"], r["text"]) for r in docs.collect()], 80)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, c in want if i == c}
    # One word of 60 changed is a similarity of 51 / 61, one of 45 of 36 / 46 (below 0.8), one of 50 of 41 / 51.
    said = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    edge = [(2 * i + j, said(i, n).replace("x25", "y") if j else said(i, n), "en", "s", 1) for i, n in enumerate((60, 45, 50)) for j in (0, 1)]
    left = p.near_duplicates(spark, spark.createDataFrame(edge + edge[:1], DOCS), sf_dir)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 2, 3, 4]
    cut = p.repeated_spans(spark, docs, sf_dir)
    exact = {i: k for i, _, _, _, k in spans([(r["doc_id"], r["text"].encode()) for r in docs.collect()], 50)}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {i: k.decode("utf-8", "ignore") for i, k in exact.items()}
    assert p.mix(spark, docs, sf_dir).columns == list(p.COLUMNS)
    out = p.run(spark, sf_dir)
    assert out.count() > 0 and out.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_pipeline_stages_take_odd_rows(spark, odd, sf_dir):
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        for df in (odd, empty(spark)):
            assert stage(spark, df, sf_dir).count() <= 4 * (df.count() + 1), name


def test_doubles_and_turned_codes_come_back():
    """Doubles keep their bits, and a code turned twice is itself."""
    rng = np.random.default_rng(5)
    for values in (np.zeros(0), np.array([0.0, -0.0, -1.5, np.inf, 3, 3]), rng.normal(size=5000), rng.integers(0, 9, 5000) / 7):
        assert asking.unsqueezed_doubles(asking.squeezed_doubles(values)).tobytes() == values.tobytes()
    code = rng.integers(0, 1 << 56, 5000)
    assert (lm.turned(lm.turned(code)) == code).all()
    assert lm.turned(np.array([0x01020304050607])).tolist() == [0x06050403020107]


def test_tallies_of_a_block_equal_a_counter(spark, monkeypatch):
    """A block's different codes and counts, over several sorts, codes of both signs and of all widths; a code that no counted text has is there with none. No table of places is made."""
    rng = np.random.default_rng(7)
    for codes in (rng.integers(-(2**62), 2**62, 5000), rng.integers(-50, 50, 9000), np.array([-(2**62), 2**62 - 1, 0, -1]), np.zeros(0, np.int64)):
        counts = rng.random(len(codes)) < 0.7
        want = Counter(codes[counts].tolist())
        got = [asking.tallied(codes[at::2] << 1 | counts[at::2]) for at in (0, 1)]
        g, c = asking.summed([*got, (np.zeros(0, np.int64),) * 2])
        assert g.tolist() == sorted(set(codes.tolist())) and c.tolist() == [want[x] for x in g.tolist()]
        order, ends = asking.by_shard(codes, 7, asking.shard_of)
        shard = asking.shard_of(codes, 7)
        assert codes[order].tolist() == codes[np.lexsort((codes, shard))].tolist() and ends.tolist() == np.searchsorted(np.sort(shard), range(8)).tolist()

    def none(*_):
        raise AssertionError

    monkeypatch.setattr(asking.Bag, "add", none)
    monkeypatch.setattr(asking, "SORTED", 40)
    batch = pa.table({"_block": pa.array([3] * 9), "t": pa.array([zstandard.compress(t.encode()) for t in ("abc" * i + "xé" for i in range(9))])})
    caught = []

    class Ready:
        def groupBy(self, _):
            return self

        def applyInArrow(self, f, _):
            caught.append(f)

    asking.asked(Ready(), "t", 5, lambda b: (asking.grams(*text_bytes(b.column(0)), 3)[0], None, np.arange(sum(map(len, map(str.encode, b.column(0).to_pylist())))) % 2 > 0))
    monkeypatch.setattr(asking, "chunks", lambda batches, text: (x.slice(i, 1) for x in batches for i in range(x.num_rows)))
    out, want = caught[0](batch), Counter()
    for t in ("abc" * i + "xé" for i in range(9)):
        for i, g in enumerate(asking.grams(*text_bytes(pa.array([t])), 3)[0].tolist()):
            want[g] += i % 2
    got = {g: c for codes, counts in zip(out.column("codes").to_pylist(), out.column("numbers").to_pylist()) for g, c in zip(asking.unsqueezed(codes).tolist(), asking.unsqueezed(counts, np.int32).tolist())}
    assert got == dict(want) and out.column("block").to_pylist() == [3] * out.num_rows


def test_spans_as_rows_take_little_room():
    """The rows of many windows take their own room and little more: places, of eight bytes for one, stand for a part of them at a time."""
    import tracemalloc

    rng = np.random.default_rng(3)
    flat = rng.integers(0, 256, 1 << 20).astype(np.uint8)
    start, size = rng.integers(0, len(flat), 200_000), rng.integers(0, 65, 200_000)
    tracemalloc.start()
    rows = parsing.rows_of(flat, start, size, 64)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 3 * rows.nbytes
    for i in range(0, len(start), 9973):
        assert rows[i].tolist() == (flat[np.minimum(np.arange(start[i], start[i] + 64), len(flat) - 1)] * (np.arange(64) < size[i])).tolist()


def test_steps_of_the_parse_give_memory_back(spark, monkeypatch):
    """Each step on groups ends with a release: a worker that waits for its next task must not hold the last one's memory beside what runs."""
    caught, freed = [], []

    class Groups:
        def groupBy(self, _):
            return self

        def cogroup(self, _):
            return self

        def applyInArrow(self, f, _):
            caught.append(f)

    for step in (lambda: parsing.repeated(Groups(), 9), lambda: parsing.phrases(Groups(), Groups(), 3, 50), lambda: parsing.ordered_spans(Groups(), 50)):
        step()
    monkeypatch.setattr(parsing, "release", lambda: freed.append(1))
    text = "".join(chr(97 + i * i % 23) for i in range(300))
    parsed = pa.table({"shard": pa.array([0], pa.int32()), "n": pa.array([1], pa.int32()), "entries": [parsing.pack(np.zeros(1, np.int32), np.ones(1, np.int32), np.zeros(6, np.uint8))]})
    caught[0](parsed)
    docs = pa.table({"block": pa.array([0, 0], pa.int32()), "doc_id": [1, 2], "row_key": [5, 6], "text": [text + "x", text + "y"]})
    sent = caught[1](docs, pa.table({"n": pa.array([], pa.int32()), "grams": pa.array([], pa.binary())}))
    assert len(freed) == 2
    spans = caught[2](sent.filter(pa.array(sent.column("n").to_numpy() > 0)))
    assert len(freed) == 3 and spans.num_rows >= 0
