"""The pipeline on a small table against plain Python, stage by stage and whole."""

import random
from collections import Counter

import corpus_pipeline
from tarja.llm import mixing, pieces, quality

from .test_ops import WORD, brute_jaccard, words


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    clean = [" ".join(words(rng, 80)) for _ in range(12)]
    near = [c.replace(c.split(" ")[40], "other") for c in clean[:4]]
    block = "\n".join(" ".join(words(rng, 12)) for _ in range(4))
    blocks = [f"{' '.join(words(rng, 60))}\n{block}\n{' '.join(words(rng, 60))}" for _ in range(3)]
    junk = ["few words", "a b c d e f g h " * 40, None, "", " ".join(w + "&&&###" for w in words(rng, 60))] + [" ".join(w + "%%%" for w in words(rng, 60)) for _ in range(8)]
    texts = [*clean, *near, *clean[:2], *blocks, *junk]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert len(stages) == 5

    kept = {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
    n = len(texts) - len(junk)
    assert set(range(n)) <= kept and not kept & set(range(n, n + 4))
    one = stages[0](spark, docs, str(tmp_path))
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == kept

    two = stages[1](spark, one, str(tmp_path))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in two.collect()}
    first = min(i for i in kept if block in texts[i])
    want = {i: texts[i] if i == first or block not in texts[i] else texts[i].replace(block + "\n", "") for i in kept}
    assert got == {i: (t, len(t)) for i, t in want.items()}

    three = stages[2](spark, two, str(tmp_path))
    ids = sorted(want)
    found = brute_jaccard([want[i] for i in ids])
    stay = {ids[k] for k, (_, c) in found.items() if c == k}
    assert {r["doc_id"] for r in three.collect()} == stay

    four = stages[3](spark, three, str(tmp_path))
    assert four.columns == docs.columns
    often = Counter(r["doc_id"] for r in four.collect())
    assert often == Counter(r["doc_id"] for r in mixing.placements(three).collect())
    assert set(often) == stay

    codec = pieces.codec(pieces.model_path())
    five = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in five) == often
    for r in five:
        assert r["ids"] == codec.encode(want[r["doc_id"]]).tolist() and r["round_trip"]
        assert sum(1 for _ in WORD.finditer(want[r["doc_id"]])) > 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Unlike texts under one id, equal rows, null ids, a very long text, and columns that operators use themselves."""
    rng = random.Random(5)
    w, u, v = (" ".join(words(rng, 80)) for _ in range(3))
    long = " ".join(f"t{k}q" for k in range(30_000))
    rows = [(1, w), (5, w), (5, u), (7, u + " tail"), (9, u), (9, u), (None, v), (None, v), (11, long), (12, None), (None, ""), *((20 + k, " ".join(words(rng, 70))) for k in range(8))]
    full = [(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), 1, 2, 3, "k") for i, t in rows]
    form = "doc_id long, text string, lang string, source string, n_chars long, row_id long, th long, block long, place string"
    spark.createDataFrame(full, form).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [x.split(" ")[0] for x in form.split(", ")]
    stay = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert stay == Counter([(1, w), (5, u), (None, v), (11, long), *rows[11:]])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == {1, 5, None, 11, *range(20, 28)}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "ids" in out.columns
