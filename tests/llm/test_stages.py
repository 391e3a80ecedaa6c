"""Rows that the pipeline's stages have to tell apart, and all stages together against plain Python."""

import hashlib
import random
import re

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_leaks_by_text(make_docs, spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 40").orderBy("item_id").first().text
    docs = make_docs([(None, item), (None, "no leak"), (7, item + " and more"), (7, "another text under the same id"), (8, None)])
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, docs, SF).collect()), key=str)
    assert got == sorted([(None, "no leak"), (7, "another text under the same id"), (8, None)], key=str)


def test_no_words_left(make_docs, spark):
    long = " ".join(f"t{k}" for k in range(60))
    docs = make_docs([(1, long), (2, long + "\n"), (3, long + "\t \r\n"), (4, long + "\nmore"), (5, " \n")])
    got = {r.doc_id: r.text for r in corpus_pipeline.passage_dedup(spark, docs, SF).collect()}
    assert got == {1: long, 4: "\nmore", 5: " \n"}


def test_null_ids_and_clashing_columns(make_docs, spark):
    from pyspark.sql import functions as F

    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 40").orderBy("item_id").first().text
    docs = make_docs([(None, item), (None, "no leak"), (7, "clean"), (7, item)])
    for c in ("_id", "_key", "_spans", "_n", "item_id"):
        docs = docs.withColumn(c, F.lit("kept"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {r["_key"] for r in out.collect()} <= {"kept"}, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert {r.text for r in corpus_pipeline.decontaminate(spark, docs, SF).collect()} == {"no leak", "clean"}


def test_run_against_plain_python(make_docs, spark, tmp_path):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    from pyspark.sql import functions as F
    from quadrille.llm import quality
    from quadrille.llm.common import id_crc

    from .test_near import brute_dedup
    from .test_others import brute_tiles
    from .test_similar import brute_kept

    rng = random.Random(11)
    good, bad = [f"word{k}" for k in range(60)], [f"x{k}!!" for k in range(20)]
    items = [(i, " ".join(rng.choices(good, k=20))) for i in range(5)]
    passage = rng.choices(good, k=70)
    rows = []
    for i in range(120):
        kind = i % 6
        w = rng.choices(bad if kind == 5 else good, k=rng.randrange(20, 120))
        if kind == 1 and rows:
            w = rng.choice(rows)[1].split()
            w[rng.randrange(len(w))] = "edited"
        if kind == 2:
            w = w[:15] + passage[: rng.randrange(45, 71)] + w[15:]
        if kind == 3 and i % 4 == 1:
            w = w[:9] + rng.choice(items)[1].split() + w[9:]
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, rows[7][1]), (204, "long " * 30_000)]
    docs = make_docs(rows).drop("score")
    labels = [(i, int(i % 6 != 5), 0) for i in range(0, 120, 2)] + [(i, 0, 0) for i in range(5, 120, 6)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame(sorted(set(labels)), "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    scores = quality.score(quality.train(docs, labels, F.pmod(id_crc(), F.lit(5)) != 0), [t or "" for _, t in rows])
    left = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    assert 0 < len(left) < len(rows) - 10
    some = [(i, t) for i, t in left if (t or "").split()]
    none = sorted((i, t) for i, t in left if not (t or "").split())[:1]  # the first without words stays
    ids = brute_kept(some) | {i for i, _ in none}
    left = [r for r in left if r[0] in ids]
    gone = {i: (n, k) for i, n, k, _ in brute_dedup(left)}
    first = {}
    for i, t in sorted(left, key=lambda r: r[0]):
        w = (t or "").split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    short = {}
    for i, t in left:
        n, k = gone[i]
        if not k:
            short[i] = t
        elif k < n:
            w = t.split()
            out = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for p in range(s, s + 50)}
            spaced = re.findall(r"\s*\S+", t)
            short[i] = "".join(x for p, x in enumerate(spaced) if p not in out)
    leaks = {i for i, t in short.items() for _, x in items if brute_tiles(x.split(), (t or "").lower().split(), 5) >= 0.8 * 20}
    assert leaks and any(k for _, k in gone.values())
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    want = {(i, len(enc.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in short.items() if i not in leaks}
    assert {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
