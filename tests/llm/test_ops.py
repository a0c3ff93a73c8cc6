"""The numbered operators on small tables, against plain Python. Tables hold nulls, empty and long
texts, repeated rows, ties, and columns whose names the operators use themselves."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarja.llm import chat, jaccard, lines, mixing, pieces, quality, repeats, shards, tokens, topk
from tarja.llm.common import components, shared_folder
from tarja.llm.suffix import repeated

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, start long, words string, id long"


def words(rng, n):
    return [f"w{rng.randrange(400)}x" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [" ".join(words(rng, rng.randrange(20, 120))) for _ in range(12)]
    near = []
    for b in base[:6]:
        w = b.split(" ")
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = "zz"
            near.append(" ".join(v))
    passage = " ".join(words(rng, 70))
    out = [*base, *near, *base[:3], *(f"{a} {passage} {b}" for a, b in zip(base[6:9], base[9:12], strict=True))]
    out += [None, "", "one", "one two three", "ONE two three", "a b\tc\x0bd", " \n\t", "é ñ ü ß 漢字 😀 " * 3, "### $$$ %%% " * 30]
    out += ["x y " * 400, "ab" * 500, "L1 aa\nL2 bb\nL3 cc\nL4 dd", "L0\nL1 aa\nL2 bb\nL3 cc\nL9", "L1 aa\n\nL2 bb\nL3 cc\nL4 dd\nL1 aa\nL2 bb\nL3 cc", " ".join(words(rng, 20000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], "big" if i % 3 else ["s1", None][i % 2], 1, 2, 3, "k", 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


# --- 1


def test_token_counts(spark, docs, texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = f"{shared_folder(spark)}/counts"
    want = {i: (len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in enumerate(texts)}
    for _ in range(2):  # the second time from the cache
        assert by_id(tokens.count_tokens(docs, path, cache), "n_bytes", "n_tokens", "over_limit") == want
        assert tokens.read_cache(spark, cache).count() == len({t or "" for t in texts})
    assert tokens.count_tokens(empty(spark), path, f"{cache}-2").count() == 0
    other = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(other)
    got = by_id(tokens.count_tokens(docs, other, cache), "n_tokens")
    assert got == {i: (len(plain.encode(t or "", add_special_tokens=False).ids),) for i, t in enumerate(texts)}


def test_token_counts_of_odd_rows(spark):
    """Null ids, repeated rows, one id with two texts: each row gives its row."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(None, "a b"), (None, "a b"), (None, None), (1, "a b"), (1, "c <s> d"), (1, "c <s> d"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_tokens"]) for r in tokens.count_tokens(df, path, f"{shared_folder(spark)}/odd").collect())
    assert got == Counter((i, len(model.encode(t or ""))) for i, t in rows)


# --- 2


def brute_repeats(texts, length):
    seen = Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        seen.update(b[a : a + length] for a in range(len(b) - length + 1))
    out = {}
    for i, b in enumerate(data):
        cover = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if seen[b[a : a + length]] > 1:
                cover[a : a + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        spans = sum(1 for k in range(len(b)) if cover[k] and not (k and cover[k - 1]))
        out[i] = (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return out


COLS2 = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("block", [2048, 3, 1])
def test_repeats(spark, docs, texts, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)  # of 1: every key with unlike segments is cut down to windows
    want = brute_repeats(texts, repeats.LENGTH)
    assert sum(v[1] for v in want.values()) > 0
    assert by_id(repeats.repeat_report(docs), *COLS2) == want
    assert repeats.repeat_report(empty(spark)).count() == 0


def test_repeats_of_a_hot_passage(spark, monkeypatch):
    rng = random.Random(12)
    passage = " ".join(words(rng, 90))
    texts = [f"{' '.join(words(rng, 30))} {passage[rng.randrange(3):]} {' '.join(words(rng, 30))}" for _ in range(60)]
    texts += [f"{t[:60]} {passage[:260]} {t[60:]}" for t in texts[:12]] + [passage, "a" * 900, "ab" * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    want = brute_repeats(texts, repeats.LENGTH)
    for block in (2048, 7):
        monkeypatch.setattr(repeats, "BLOCK", block)
        assert by_id(repeats.repeat_report(df), *COLS2) == want


def test_repeats_gives_texts_and_spans(spark):
    part = " ".join(words(random.Random(8), 60))
    df = spark.createDataFrame([(1, f"é {part} x"), (2, f"{part} é"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repeats.remove_repeats(df).collect()}
    size = len(part) + 1  # the space behind it, too
    assert [tuple(s) for s in got[1]["spans"]] == [(3, 3 + size)] and bytes(got[1]["kept"]).decode() == "é x"
    assert [tuple(s) for s in got[2]["spans"]] == [(0, size)] and bytes(got[2]["kept"]).decode() == "é"
    assert got[3]["spans"] == [] and bytes(got[3]["kept"]) == b""


def test_a_repeated_row_is_no_repetition_of_itself(spark):
    text = " ".join(words(random.Random(3), 80))
    removed = lambda rows: sorted(r["n_removed"] for r in repeats.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert removed([(1, text), (1, text), (None, None), (None, None)]) == [0, 0, 0, 0]
    assert removed([(None, text), (None, text)]) == [0, 0]
    assert removed([(1, text), (2, text), (2, text)]) == [len(text)] * 3
    assert removed([(1, text), (None, text)]) == [len(text)] * 2
    assert removed([(1, text), (1, text + " more")]) == [len(text)] * 2


@pytest.mark.parametrize("seed", range(4))
def test_two_stage_sorting(seed):
    rng = random.Random(seed)
    for length in (8, 13, 200):
        part = bytes(rng.choice(b"abc") for _ in range(length + 5))
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 80))) + (part if rng.random() < 0.6 else b"") + b"a" * rng.randrange(40) for _ in range(6)]
        seen = Counter(s[a : a + length] for s in strings for a in range(len(s) - length + 1))
        assert [x.tolist() for x in repeated(strings, length)] == [[a for a in range(len(s) - length + 1) if seen[s[a : a + length]] > 1] for s in strings]


# --- 3


def brute_jaccard(texts):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {i: (len(sets[i]), root[i]) for i in range(len(texts))}


def test_jaccard(spark, docs, texts, monkeypatch):
    want = brute_jaccard(texts)
    assert len({c for _, c in want.values()}) < len(texts) - 5
    assert by_id(jaccard.jaccard_components(docs), "n_shingles", "component_id") == want
    monkeypatch.setattr(jaccard, "BLOCK", 2)  # large clusters and groups in blocks
    assert by_id(jaccard.jaccard_components(docs), "n_shingles", "component_id") == want
    monkeypatch.setattr(jaccard, "BLOCK", 2048)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 3000)  # blocks by their bytes
    assert by_id(jaccard.jaccard_components(docs), "n_shingles", "component_id") == want
    monkeypatch.undo()
    monkeypatch.setattr(jaccard, "MAPPED", 0)  # the texts meet the wanted ids in a join
    assert by_id(jaccard.jaccard_components(docs), "n_shingles", "component_id") == want
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_words_of_one_pattern_are_told_apart(spark):
    """Two words of 2,048 letters that any polynomial modulo 2^64 confuses."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    df = spark.createDataFrame([(1, one), (2, two), (3, two)], "doc_id long, text string")
    assert by_id(jaccard.jaccard_components(df), "component_id") == {1: (1,), 2: (2,), 3: (2,)}


def test_sets_that_share_a_digest_are_told_apart(spark):
    rows = [(5, 1, 0), (5, 2, 1), (6, 3, 2), (-7, -8, 3), (-7, 9, 4)]
    classes = spark.createDataFrame([(a, b, i, i) for a, b, i in rows], "d1 long, d2 long, doc long, th long")
    shared = jaccard._shared_digests(classes)
    assert sorted(shared.view("int64").tolist()) == [-7, 5]
    named = {r["doc"]: r["id"] for r in jaccard._named(classes, shared).collect()}
    d1, d2 = (np.array([r[c] for r in rows], dtype=np.int64).view(np.uint64) for c in (0, 1))
    assert named == dict(enumerate(jaccard.identity(d1, d2, shared).view(np.int64).tolist()))
    assert len(set(named.values())) == 5 and named[2] == 6
    none = jaccard._shared_digests(classes.where("doc = 2"))
    assert not len(none) and jaccard._named(classes.where("doc = 2"), none).first()["id"] == 6


def test_jaccard_by_rows(spark):
    """Null ids, and unlike texts under one id."""
    rng = random.Random(9)
    w, u = (" ".join(words(rng, 40)) for _ in range(2))
    rows = [(1, w), (5, w), (5, u), (7, u + " tail"), (9, u), (9, u), (None, u), (None, None), (4, ""), (None, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.jaccard_components(df).collect()), key=repr)
    assert got == sorted([(1, 36, 1), (5, 36, 1), (5, 36, 5), (7, 37, 5), (9, 36, 5), (9, 36, 5), (None, 36, 5), (None, 0, None), (4, 0, 4), (None, 1, None)], key=repr)
    stay = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(df).collect()), key=repr)
    assert stay == sorted([(1, w), (5, u), (None, None), (4, ""), (None, "alone here")], key=repr)


def test_a_large_group_is_not_multiplied_in_its_task():
    batch = lambda t, d: pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(d, pa.int64()), pa.array([9] * len(t), pa.int64())], ["token", "d1", "n"])
    got = pa.Table.from_batches(jaccard._groups(4)([batch([1, 1, 2, 2, 2], [5, 6, 0, 1, 2]), batch([2] * 7, range(3, 10)), batch([2, 3, 3, 3], [10, 5, 6, 6])])).to_pylist()
    large = [r for r in got if r["large"]]
    assert sorted((r["g"], r["d1"], r["n"]) for r in large) == [(2, k, 9) for k in range(11)]
    few = [(r["g"], r["d1"]) for r in got if not r["large"]]
    assert len({g for g, _ in few}) == 1 and {d for _, d in few} == {5, 6}


def test_jaccard_of_large_groups(spark, monkeypatch):
    rng = random.Random(3)
    shared = words(rng, 60)
    texts = []
    for _ in range(3):  # near copies, and families that share a passage but don't link
        base = shared + words(rng, 60)
        texts += [" ".join(base[:k] + ["other", str(k)] + base[k:]) for k in range(60, 100)]
    texts += [" ".join(shared + words(rng, n)) for n in range(20, 200, 6)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    called = []
    whole = jaccard._large_groups
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "_large_groups", lambda *x: called.append(1) or whole(*x))
    assert by_id(jaccard.jaccard_components(docs), "n_shingles", "component_id") == brute_jaccard(texts)
    assert called


def test_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 101), (101, 102), (7, 7), (None, 3), (200, 200)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), shared_folder(spark), "t").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200}


def test_components_of_long_chains(spark):
    shuffled = list(range(3000))
    random.Random(5).shuffle(shuffled)
    chains = [[0, *range(1200, 0, -1)], [5000 + k for k in shuffled], list(range(9000, 10500))]
    edges = [pair for c in chains for pair in zip(c, c[1:], strict=False)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), shared_folder(spark), "t").collect()}
    assert got == {i: min(c) for c in chains for i in c}


# --- 4


def brute_best(codec, scores, text):
    """The best segmentation by trying every piece that ends at each place, the longer one on ties."""
    longest = max(map(len, scores))
    best, back = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            piece = text[start:end]
            if piece in scores:
                total, ids = best[start] + scores[piece][1], [scores[piece][0]]
            elif end - start == 1:
                total, ids = best[start] + codec.unknown, [codec.byte_ids[b] for b in piece.encode()]
            else:
                continue
            if total > best[end]:
                best[end], back[end] = total, (start, ids)
    out, end = [], len(text)
    while end:
        start, ids = back[end]
        out, end = out + ids[::-1], start
    return out[::-1]


def test_pieces(spark, docs, texts):
    codec = pieces.codec(pieces.model_path())
    model = codec.model
    scores = {codec.pieces[i]: (i, model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    out = {r["doc_id"]: r for r in pieces.encode_pieces(docs, pieces.model_path()).collect()}
    for i, t in enumerate(texts):
        assert out[i]["ids"] == brute_best(codec, scores, model.normalize(t or ""))
        assert out[i]["round_trip"] and out[i]["n_pieces"] == len(out[i]["ids"])
        assert out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = by_id(pieces.decode_pieces(pieces.encode_pieces(docs, pieces.model_path()), pieces.model_path()), "text")
    assert back == {i: (t or "",) for i, t in enumerate(texts)}
    assert pieces.encode_pieces(empty(spark), pieces.model_path()).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, "c")], "doc_id long, text string")
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in pieces.encode_pieces(odd, pieces.model_path()).collect()) == Counter((i, tuple(codec.encode(t or "").tolist())) for i, t in [(None, "a b"), (None, "a b"), (1, None), (1, "c")])


# --- 5


def test_topk(spark, monkeypatch):
    import math

    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)], 0) for i in range(400)]
    rows += [(400 + i, rows[0][1], 1) for i in range(30)]
    rows += [(500, None, 0), (501, [1.0, None], 0), (502, [float("nan")], 0), (503, [float("inf")] * 24, 0), (504, [0.5] * 7, 0), (505, [], 0), (None, [1.0] * 24, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    v = {i: [math.floor(1024 * x) for x in e] for i, e, _ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    want = set()
    for q in (i for i in v if i % 20 == 0):
        best = sorted(((-sum(a * b for a, b in zip(v[q], v[i], strict=False)), i) for i in v if i != q))[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    vectors = topk.integer_vectors(df)
    for block, part in ((512, 1 << 21), (7, 1 << 21), (7, 900)):
        monkeypatch.setattr(topk, "QUERIES", block)
        monkeypatch.setattr(topk, "PART", part)
        got = {tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0")).collect()}
        assert got == want
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    # two vectors under one query id, and numbers beyond 53 and 63 bits, beside ones that stay small
    twice = topk.integer_vectors(spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), *((i, [float(i), -float(i)]) for i in range(1, 30))], "vec_id long, embedding array<double>"))
    best = sorted([(-s, i) for i in range(1, 30) for s in (1024**2 * i, -(1024**2) * i)] + [(0, 0)] * 0)[:10]
    assert [(-r["score"], r["vec_id"]) for r in topk.top_k(twice, twice.where("vec_id = 0")).orderBy("rank").collect()] == best
    sizes = [1.0, 3.0, 1e13, -1e13, 1e16, -1e16, 1e300]
    wide = topk.integer_vectors(spark.createDataFrame([(i, [x, 1.0]) for i, x in enumerate(sizes)] + [(9, [1e308 * 1.7, 1.0])], "vec_id long, embedding array<double>"))
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(wide, wide).collect()}
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert got == {(i, j): cut(int(1024 * x) * int(1024 * y) + 1024**2) for i, x in enumerate(sizes) for j, y in enumerate(sizes) if i != j}
    huge = topk.integer_vectors(spark.createDataFrame([(0, [2.0e6, 1.0]), (1, [3.0e6, 2.0]), (2, [1.0e6, 1.0])], "vec_id long, embedding array<double>"))
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(huge, huge.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 2000000 * 3000000 * 1024**2 + 2 * 1024**2), (2, 2000000 * 1000000 * 1024**2 + 1024**2)]


def test_queries_go_where_they_can_win(spark, monkeypatch):
    """Clustered vectors in many parts: few pairs of part and query are compared, and the result is the same."""
    monkeypatch.setattr(topk, "PART", 32 * 50)
    rng = random.Random(12)
    centres = [[rng.gauss(0, 3) for _ in range(32)] for _ in range(40)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in centres[i % 40]]) for i in range(2000)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).cache()
    shuffled = []
    got = {}
    for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), shuffled=shuffled).collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    v = {r["vec_id"]: r["v"] for r in vectors.collect()}
    assert set(got) == {i for i in v if i % 50 == 0}
    for q, best in got.items():
        assert sorted(best) == sorted((-int(sum(x * y for x, y in zip(v[q], v[i], strict=True))), i) for i in v if i != q)[:10]
    assert shuffled[0] < 0.3 * shuffled[1], shuffled


# --- 6


def brute_mixture(rows, budget=None):
    """(doc_id, source, block, place) as multisets, from the definition: weights by a plain bisection, blocks as sorted lists."""
    import math

    own = [(i, s, max(1, len(WORD.findall(t or ""))), th) for i, t, s, th in rows]
    held = Counter()
    for _, s, n, _ in own:
        held[s] += n
    total = sum(held.values())

    def weights(x):
        power = {s: (n / total) ** x for s, n in held.items()}
        return {s: p / sum(power.values()) for s, p in power.items()}

    def entropy(x):
        return -sum(q * math.log(q) for q in weights(x).values())

    def size(x):
        return budget or max(held[s] / q for s, q in weights(x).items())

    def bisect(holds_low, low=0.0, high=1.0):
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if holds_low(mid) else (low, mid)
        return high

    x = bisect(lambda x: entropy(x) >= mixing.ENTROPY * math.log(len(held))) if len(held) > 1 else 1.0
    repeats = lambda x: max(size(x) * q / held[s] for s, q in weights(x).items())
    if repeats(x) > mixing.REPEATS:
        x = max(x, bisect(lambda x: repeats(x) > mixing.REPEATS))
    out = Counter()
    for s, q in weights(x).items():
        full = math.floor(q * size(x) / held[s] + 1e-6)
        rest = round(max(0.0, q * size(x) - full * held[s]))
        for block in range(full + 1):
            order = sorted((hashlib.md5(f"{mixing.SEED}:{block}:{'' if i is None else i}:{th}".encode()).hexdigest(), i, n) for i, o, n, th in own if o == s)
            before = 0
            for place, (_, i, n) in enumerate(order):
                if block < full or before < rest:
                    out[i, s, block, place] += 1
                before += n
    return out


@pytest.mark.parametrize(("texts_of_range", "budget"), [(1024, None), (2, None), (3, 9000.0), (3, 60000.0)])
def test_mixing(spark, docs, texts, monkeypatch, texts_of_range, budget):
    monkeypatch.setattr(mixing, "RANGE", texts_of_range)
    twice = docs.union(docs.where("doc_id < 5"))
    rows = [tuple(r) for r in twice.select("doc_id", "text", "source", F.xxhash64("text")).collect()]
    got = Counter((r["doc_id"], r["source"], r["block"], r["place"]) for r in mixing.placements(twice, budget).collect())
    assert got == brute_mixture(rows, budget)


def test_mixture_keeps_rows(spark, docs, texts):
    rng = random.Random(3)
    rows = [(1, " ".join(words(rng, 50)), "a", k) for k in range(3)] + [(2, " ".join(words(rng, 700)), "b", 9), (None, None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, block int")
    out = mixing.mixture(df)
    assert out.columns == [*df.columns, "mix_block", "mix_place"]
    seen = Counter()
    for r in out.collect():
        assert (r["doc_id"], r["text"], r["source"], r["block"]) in rows
        seen[r["source"], r["mix_block"]] += 1
    sizes = Counter(r["source"] for r in mixing.placements(df).collect())
    assert sum(seen.values()) == sum(sizes.values())
    assert seen["a", 0] == 3  # a whole block has each of three equal rows once
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixture(empty(spark)).count() == 0 and mixing.placements(empty(spark)).count() == 0


def test_temperature_reaches_its_targets(spark):
    import math

    shares = spark.createDataFrame([("a", 9000), ("b", 900), ("c", 100)], "source string, words long")

    def weights(x):
        p = [(w / 10000) ** x for w in (9000, 900, 100)]
        return [q / sum(p) for q in p]

    x, _ = mixing.temperature(shares, target=0.8, limit=None)
    entropy = -sum(q * math.log(q) for q in weights(x)) / math.log(3)
    assert abs(entropy - 0.8) < 1e-6
    x, budget = mixing.temperature(shares, target=1.0, limit=5.0)
    assert abs(max(budget * q / w for q, w in zip(weights(x), (9000, 900, 100), strict=True)) - 5.0) < 1e-4


# --- 7


def brute_quality(texts):
    """(measures, base_failed, kept) of each text; the algorithm runs over documents, one by one."""
    import math

    rows, votes = [], []
    for t in texts:
        t = t or ""
        w = WORD.findall(t)
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        n, chars, symbols, lines, repeats_ = len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(covered)
        rows.append(((n, chars, symbols, lines, repeats_), n < 20 or 100 * repeats_ > 30 * n))
        good = [n >= 50, 100 * symbols <= chars, 50 * symbols <= n, lines == 0, repeats_ == 0, 3 * n <= chars <= 9 * n]
        bad = [n < 20, 20 * symbols > chars, 4 * symbols > n, lines >= 3, 100 * repeats_ > 20 * n, chars < 3.5 * n or chars > 12 * n]
        votes.append(["bad" if b else "good" if g else "none" for g, b in zip(good, bad, strict=True)])
    prior = {"good": {"none": 0.2, "good": 0.64, "bad": 0.16}, "bad": {"none": 0.2, "good": 0.16, "bad": 0.64}}
    share, chance, post = 0.8, [prior] * 6, []
    for _ in range(quality.ROUNDS):
        post = []
        for v in votes:
            a = share * math.prod(chance[r]["good"][x] for r, x in enumerate(v))
            b = (1 - share) * math.prod(chance[r]["bad"][x] for r, x in enumerate(v))
            post.append(a / (a + b))
        mass = {"good": sum(post), "bad": sum(1 - p for p in post)}
        share = (mass["good"] + 4) / (len(texts) + 5)
        part = {"good": lambda p: p, "bad": lambda p: 1 - p}
        chance = [{c: {x: (sum(part[c](p) for p, v in zip(post, votes, strict=True) if v[r] == x) + 10 * prior[c][x]) / (mass[c] + 10) for x in prior[c]} for c in prior} for r in range(6)]
    return [(m, failed, p, not failed and p >= quality.KEEP) for (m, failed), p in zip(rows, post, strict=True)]


def test_quality(spark, docs, texts):
    want = brute_quality(texts)
    out = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert len(out) == len(texts) and {k for *_, k in want} == {True, False}
    for i, (measured, failed, posterior, kept) in enumerate(want):
        assert tuple(out[i][m] for m in quality.MEASURES) == measured
        assert (out[i]["base_failed"], out[i]["kept"]) == (failed, kept)
        assert abs(out[i]["posterior"] - posterior) < 1e-6
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, w in enumerate(want) if w[3]}
    assert quality.quality(empty(spark)).count() == 0 and quality.keep_good(empty(spark)).count() == 0


def test_quality_of_odd_rows(spark):
    """Null ids and repeated rows each count and pass through."""
    rng = random.Random(1)
    clean = [" ".join(words(rng, 60)) for _ in range(6)]
    rows = [(None, clean[0]), (None, clean[0]), (3, clean[1]), (3, clean[2]), (3, clean[2]), (None, None), (4, "###"), *((k, t) for k, t in enumerate(clean))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, t) for (i, t), w in zip(rows, brute_quality([t for _, t in rows]), strict=True) if w[3])
    assert Counter(tuple(r) for r in quality.keep_good(df).collect()) == want
    assert Counter((r["doc_id"], r["kept"]) for r in quality.quality(df).collect()) == Counter((i, w[3]) for (i, t), w in zip(rows, brute_quality([t for _, t in rows]), strict=True))


def test_estimate_finds_the_better_rules():
    rng = random.Random(2)
    right = [0.95, 0.9, 0.9, 0.6, 0.8, 0.85]
    seen, truth = Counter(), Counter()
    for _ in range(20000):
        good = rng.random() < 0.7
        p = tuple(0 if rng.random() < 0.2 else (1 if good == (rng.random() < a) else 2) for a in right)
        seen[p] += 1
        truth[p] += good
    got = quality.estimate(dict(seen))
    wrong = sum(min(truth[p], n - truth[p]) if (got[p] >= 0.5) == (2 * truth[p] >= n) else max(truth[p], n - truth[p]) for p, n in seen.items())
    best = sum(min(truth[p], n - truth[p]) for p, n in seen.items())
    assert wrong <= best * 1.1 + 20
    assert quality.estimate({}) == {}


# --- 8


def test_lines(spark, docs, texts):
    first, gone = {}, {}
    windows = []
    for i, t in enumerate(texts):
        own = (t or "").split("\n")
        full = [k for k, x in enumerate(own) if WORD.search(x)]
        windows += [(tuple(own[k] for k in full[j : j + 3]), i, full[j : j + 3]) for j in range(len(full) - 2)]
    for key, i, at in windows:
        if first.setdefault(key, (i, at)) != (i, at):
            gone.setdefault(i, set()).update(at)
    assert gone
    want = {i: (len(gone.get(i, ())), t if i not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in enumerate(texts)}
    assert by_id(lines.line_report(docs), "n_removed", "text") == want
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    assert by_id(out, "text") == {i: (t,) for i, (_, t) in want.items()}
    assert lines.line_report(empty(spark)).count() == 0


def test_lines_of_odd_rows(spark):
    """A null id comes first; one id's texts are told apart; equal rows are one text."""
    block = "L1 a\nL2 b\nL3 c\nL4 d"
    rows = [(2, block), (2, block), (2, f"x\n{block}"), (None, f"{block}\ny"), (1, f"L2 b\n\nL3 c\nL4 d\nz\n{block}"), (5, None), (None, "")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_chars int")
    got = sorted((tuple(r) for r in lines.dedup_lines(df).collect()), key=repr)
    gone = lambda t: (len(t),)
    want = [(2, "", *gone("")), (2, "", *gone("")), (2, "x", *gone("x")), (None, f"{block}\ny", *gone(f"{block}\ny")), (1, "\nz", *gone("\nz")), (5, None, 7), (None, "", 0)]
    assert got == sorted(want, key=repr)


# --- 9


def test_chat(spark, monkeypatch):
    rng = random.Random(4)
    odd = ["</s>[INST] ok [/INST]", "<\\s> [\\INST]", "<<SYS>>x<</SYS>>", "[ROLE=61]", "", None, "😀<", "[/INST]</s><s>", "<<s>>\\", "<|endoftext|>", "é" * 30]
    convs = {}
    for c in range(60):
        turns = [("user", "hello")] if c % 3 else []
        turns += [(rng.choice(["user", "assistant", "system", "tool", "tool]</s>", None]), rng.choice(odd + ["same", "x" * 300])) for _ in range(rng.randrange(1, 9))]
        convs[c] = turns
    convs[100] = convs[1]
    convs[101] = [("user" if k % 2 else "assistant", f"turn {k} " + "word " * 40) for k in range(700)]
    convs[102] = [("assistant", "again")] * 3  # repeated rows all count
    convs[None] = [("assistant", "n")]
    rows = [(c, 0 if c == 102 else k, r, t, "extra") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, path string").repartition(3)
    path = chat.tokenizer_path()
    for size in (1 << 16, 500):
        monkeypatch.setattr(chat, "PACK", size)
        packs = chat.format_conversations(df, path)
        got = {r["conv_id"]: r for r in chat.read_back(packs, path).collect()}
        assert len(got) == len(convs)
        for c, turns in convs.items():
            loss = "".join(t or "" for r, t in turns if r == "assistant")
            digest = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
            assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert got[c]["formatted_chars"] == 3 + sum(sum(map(len, chat.turn_parts(r, t or ""))) for r, t in turns)
        for p in packs.collect():
            for n in p["nodes"]:  # a node attends to its ancestors and itself, and its position follows them
                above = sum(x["end"] - x["start"] for x in n["attends"])
                assert above == n["position"] + n["end"] - n["start"]
    assert chat.read_back(chat.format_conversations(df.limit(0), path), path).count() == 0


def test_chat_emits_shared_turns_once(spark):
    start = [("user", "hello " * 50), ("assistant", "yes " * 50)]
    convs = {c: [*start, ("user", f"more {c}")] for c in range(20)}
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1)
    packs = chat.format_conversations(df, chat.tokenizer_path()).collect()
    assert sum(len(p["nodes"]) for p in packs) <= 20 + 2 * len(packs)
    assert sum(len(p["leaves"]) for p in packs) == 20
    for p in packs:
        for n in p["nodes"]:
            assert n["parent"] < 0 or n["position"] == p["nodes"][n["parent"]]["position"] + p["nodes"][n["parent"]]["end"] - p["nodes"][n["parent"]]["start"]


# --- 10


def curve_cells():
    curve = shards.curve()
    assert sorted(curve) == list(range(4096))
    cell = {p: (k >> 8, k >> 4 & 15, k & 15) for k, p in enumerate(curve)}
    assert all(sum(abs(a - b) for a, b in zip(cell[k], cell[k + 1], strict=True)) == 1 for k in range(4095))
    return {c: p for p, c in cell.items()}


@pytest.mark.parametrize("part", [1 << 17, 2])
def test_shards(spark, docs, texts, monkeypatch, part):
    monkeypatch.setattr(shards, "PART", part)
    twice = docs.union(docs.where("doc_id < 5")).union(docs.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    own = [((r["lang"] or "", r["source"] or "", len((r["text"] or "").encode()) + 1), r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in twice.collect()]
    index = curve_cells()
    step = lambda k, v: 16 * sum(o[0][k] < v for o in own) // len(own)
    ordered = sorted((index[tuple(step(k, v) for k, v in enumerate(dims))], hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i, dims[2], crc) for dims, i, crc in own)
    want, slots = Counter(), Counter()
    for rank, (c, _, i, size, crc) in enumerate(ordered):
        s = rank * 16 // len(ordered)
        want[i, size, crc, "rows", s, slots[s], None, c] += 1
        slots[s] += 1
    assert max(slots.values()) - min(slots.values()) <= 1
    assert Counter(tuple(r) for r in shards.assign_shards(twice).collect()) == want
    assert shards.assign_shards(empty(spark)).count() == 0


def test_shard_files_can_be_skipped(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, "x" * int(10 ** rng.uniform(0, 3)), rng.choice(["de", "en", "es", "fr"]), f"site{rng.randrange(40):02}", "shard", f"mine{i}", -i) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, name string, slot string, Size long").repartition(7)
    shards.write_shards(df, str(tmp_path / "s"), files=2)
    out = spark.read.parquet(str(tmp_path / "s"))
    assert Counter(tuple(r) for r in out.select(df.columns).collect()) == Counter(rows)
    places = {r["doc_id"]: (r["size"], r["shard"], r["slot"]) for r in shards.assign_shards(df.drop("slot", "Size")).collect()}
    assert {r["doc_id"]: (r["size_"], r["shard"], r["slot_"]) for r in out.collect()} == places
    out = out.drop("Size").withColumnRenamed("size_", "size")
    files = out.groupBy(F.input_file_name().alias("f")).agg(*(F.min(c).alias(f"{c}_a") for c in shards.DIMENSIONS), *(F.max(c).alias(f"{c}_z") for c in shards.DIMENSIONS)).collect()
    assert len(files) >= 16
    for c, value in (("lang", "es"), ("source", "site07"), ("size", 40)):
        read = sum(f[f"{c}_a"] <= value <= f[f"{c}_z"] for f in files)
        assert read <= 0.6 * len(files)
