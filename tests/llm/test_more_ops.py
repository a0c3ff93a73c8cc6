"""Operators 11 to 13 on small tables, against plain Python. Tables hold nulls, empty and long texts, repeated rows,
ties, and columns whose names the operators use themselves."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tarja.llm import manifest, phrases, simhash
from tarja.llm.common import components, shared_folder

from .test_ops import WORD, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, g long, fp long, words string, path string, n long"


def table(spark, rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    return spark.createDataFrame([(*r, 1, 2, 3, "k", "p", 4) for r in rows], DOCS).repartition(3)


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# --- 11


def brute_print(text):
    w = tokens(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """For each place the smallest place reachable."""
    out = {}
    for i in range(len(prints)):
        if i in out:
            continue
        out[i], todo = i, [i]
        while todo:
            x = todo.pop()
            for y in range(len(prints)):
                if y not in out and (prints[x] ^ prints[y]).bit_count() <= 4:
                    out[y] = i
                    todo.append(y)
    return [out[i] for i in range(len(prints))]


def test_simhash(spark):
    rng = random.Random(3)
    base = [" ".join(words(rng, rng.randrange(60, 200))) for _ in range(8)]
    near = [b.replace(b.split(" ")[k], "zz", 1) for b in base for k in (5, 40)]
    texts = [*base, *near, base[0], base[1].upper(), None, "", " \n\t", "one", "ONE", "one two three", "a b\tc\x0bd", "a b c d", "é É ß 漢字 😀 x", " ".join(words(rng, 70_000))]
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.simhash_components(table(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    prints = [brute_print(t) for t in texts]
    assert got == {i: (p, c) for i, (p, c) in enumerate(zip(prints, brute_components(prints), strict=True))}
    assert len({c for _, c in got.values()}) < len(texts) - 6


def test_simhash_of_odd_rows(spark):
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "A b c d e"), (4, "p q r s t"), (5, "p q r s t"), (None, "alone in the world today"), (7, None), (3, "")]
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.simhash_components(table(spark, [(i, t, None, None, None) for i, t in rows])).collect())
    assert got == Counter([(None, 5), (5, 5), (5, 5), (4, 4), (5, 4), (None, None), (7, 3), (3, 3)])
    assert simhash.simhash_components(table(spark, [])).count() == 0


def families(rng, n):
    found = set()
    centres = [rng.getrandbits(64) for _ in range(3)]
    for k in range(n):
        x = centres[k % 3]
        for b in rng.sample(range(14), rng.randrange(6)):
            x ^= 1 << (b * 4)
        found.add(x)
    return sorted(found | {rng.getrandbits(64) for _ in range(n // 8)} | {0, 2**64 - 1})


@pytest.mark.parametrize("block", [4096, 24])
def test_links_of_families(spark, monkeypatch, block):
    """Large families of near fingerprints; with a small block their keys are cut again and again."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    prints = families(random.Random(9), 400)
    folder = shared_folder(spark)
    path = f"{folder}/classes"
    spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long").write.parquet(path)
    part = components(simhash.near_links(spark.read.parquet(path), folder), folder, "c").collect()
    got = defaultdict(set)
    for r in part:
        got[r["component"]].add(r["id"] % 2**64)
    want = defaultdict(set)
    for p, c in zip(prints, brute_components(prints), strict=True):
        want[c].add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


@pytest.mark.parametrize("n", [10, 10**7, 10**10])
def test_keys_lose_no_pair(n):
    masks = simhash.key_masks(simhash.blocks(n))
    rng = random.Random(n)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)
    assert n * 2.0 ** -min(m.bit_count() for m in masks) < 2 * simhash.USUAL


def test_distances_to_references():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 500, dtype=np.uint64)
    fp[::5] = fp[0] ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64))
    group = np.sort(rng.integers(0, 4, 500))
    a, b = simhash.linked(group, fp)
    assert len(a) > 50
    link = {(x, y) for g in range(4) for x in fp[group == g].tolist() for y in fp[group == g].tolist() if (x ^ y).bit_count() <= 4}
    label = {}
    find = lambda x: x if label.setdefault(x, x) == x else find(label[x])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        label[find(x)] = find(y)
    assert all(find(x) == find(y) for x, y in link)


# --- 12


def brute_phrases(rows, least=30):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    found = defaultdict(list)
    longer = Counter()
    for (lang, p), a in f.items():
        if a >= least:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[lang, p[i : i + m]] = max(longer[lang, p[i : i + m]], a)
    for (lang, p), a in f.items():
        if a >= least and len(p) > 1 and 100 * longer[lang, p] < 80 * a:
            score, _, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, k) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]], score))
    return sorted((lang, i + 1, p.decode(), a, x, y, n[lang], s) for lang, own in found.items() for i, (_, _, p, a, x, y, s) in enumerate(sorted(own)))


def phrase_rows(rng):
    few = [f"w{k}" for k in range(5)] + ["é", "漢", "ﬀ", "😀"]
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(few) + rng.choice(["", "", ",", ".", "\t", "\x0b", " ", "!"]) for _ in range(rng.randrange(90)))) for _ in range(500)]
    rows += [("en", "New York City hall, new  york\tcity; NEW YORK CITY"), ("en", None), ("en", ""), ("xx", "..."), ("yy", "one two"), ("en", ". , ;")] * 11
    rows += [("zz", "a a a a a " * 300), ("", "b c " * 40), ("en", " ".join(f"u{k}" for k in range(30_000)))]
    return rows


def test_phrases(spark):
    rows = phrase_rows(random.Random(2))
    df = table(spark, [(i % 7 or None, t, lang, None, None) for i, (lang, t) in enumerate(rows)])
    got = sorted(tuple(r) for r in phrases.collocations(df).collect())
    want = brute_phrases(rows)
    assert len(want) > 50 and {w[0] for w in want} == {"en", "de", "und", "zz", ""}
    assert got == want
    top = phrases.collocations(df, 5).collect()
    assert sorted(tuple(r) for r in top) == [w for w in want if w[1] <= 5]
    assert phrases.collocations(table(spark, [])).count() == 0


def test_summaries_keep_what_is_frequent():
    """A stream in summaries, merged in any grouping: a key that occurs ``least`` times keeps a counter, and no count is off by more than what was taken."""
    rng = np.random.default_rng(5)
    stream = np.concatenate([np.repeat(np.arange(40), rng.integers(1, 90, 40)), rng.integers(1000, 60_000, 9000)]).astype(np.uint32)
    rng.shuffle(stream)
    true = dict(zip(*(x.tolist() for x in np.unique(stream, return_counts=True)), strict=True))
    parts = [phrases.unpacked(phrases.packed(k, c)) for k, c in (np.unique(s, return_counts=True) for s in np.array_split(stream, 23))]
    for least, margin in ((30, 1), (30, 4), (10, 1)):
        capacity, state, taken = margin * len(stream) // least + 1, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0
        for k in range(0, 23, 5):
            keys, counts, more = phrases.merged([state, *parts[k : k + 5]], capacity)
            state, taken = (keys, counts), taken + more
            assert len(keys) <= capacity
        assert taken <= len(stream) / capacity
        held = dict(zip(state[0].tolist(), state[1].tolist(), strict=True))
        assert all(held.get(k, 0) <= n <= held.get(k, 0) + taken for k, n in true.items())
        assert all(held.get(k, 0) + taken >= least for k, n in true.items() if n >= least)


# --- 13


def sha(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def brute_tree(leaves):
    paths, level, width = [[] for _ in leaves], list(leaves), 1
    while len(level) > 1:
        for i, path in enumerate(paths):
            other = (i // width) ^ 1
            path.append(None if other >= len(level) else (other < i // width, level[other]))
        level, width = [sha(*level[k : k + 2]) for k in range(0, len(level), 2)], 2 * width
    return level[0], paths


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, text, lang, source, n: sha(*map(field, (i, source, lang, n, text)))
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        tried = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
        changed = leaf(i, text, lang, source, None if n is None else n + 1) if tried else None
        groups[lang is not None, (lang or "").encode()].append((i is not None, i or 0, leaf(i, text, lang, source, n), i, changed))
    parts = [(sorted(groups[g]), *brute_tree([x[2] for x in sorted(groups[g])])) for g in sorted(groups)]
    root, above = brute_tree([p[1] for p in parts])
    out = Counter()
    for (own, subroot, paths), higher in zip(parts, above, strict=True):
        for (_, _, h, i, changed), path in zip(own, paths, strict=True):
            folded = changed or h
            for s in path + higher:
                folded = sha(folded) if s is None else sha(s[1], folded) if s[0] else sha(folded, s[1])
            out[i, h, subroot, root, sha(*(s[1] for s in path + higher if s)), folded, folded == root] += 1
    return out


@pytest.mark.parametrize("band", [10, 2])
def test_manifest(spark, monkeypatch, band):
    """With bands of two levels the trees take several."""
    monkeypatch.setattr(manifest, "BAND", band)
    rng = random.Random(4)
    rows = [(rng.randrange(400), f"t é {k}", rng.choice(["en", "en", "en", "de", "Ä"]), rng.choice(["s", None]), rng.choice([k, None])) for k in range(77)]
    rows += [(None, "a", None, None, None), (None, "a", None, None, None), (3, None, "", "s", 5), (3, "x", "fr", "s", 5), (3, "x", "fr", "s", 5), (-4, "", "fr", "", 0), (9, "y" * 200_000, "fr", "s", 1)]
    got = Counter(tuple(r) for r in manifest.proofs(manifest.manifest(table(spark, rows))).collect())
    want = brute_manifest(rows)
    assert got == want
    assert {v for *_, v in want} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 9])
def test_manifest_of_few(spark, monkeypatch, n):
    monkeypatch.setattr(manifest, "BAND", 1)
    rows = [(k, "x", "en", "s", 1) for k in range(n)]
    assert Counter(tuple(r) for r in manifest.proofs(manifest.manifest(table(spark, rows))).collect()) == (brute_manifest(rows) if n else Counter())
