"""Token ids, token counts, top-k search, mixing, graded models and the pipeline."""

import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import brute
import corpus_pipeline
from aftershock.llm import byte_bpe, jaccard, mixing, mtree, ordinal, quality, token_ids, toxicity, unigram
from aftershock.llm.vocabulary import tokenizer_path
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
BPE = tokenizer_path("byte_bpe_50k.json")
ODD = [None, "", " ", "  ", "a  b", "foo\n bar", "foo\n\n  bar", " \n x", "m² n", "it's don't 's", " a", "a ", "foo.\nBar ,.!\nx",
       "漢字 かな", "\x00 a\x1c b", "x\r\n y\tz", "<|endoftext|> a", "½ Ⅷ a_b"]


def library_ids(texts, plain=False):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    if plain:
        whole.encode_special_tokens = True
    return [e.ids for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


# --- token ids


def test_codes_give_random_access():
    rng = np.random.default_rng(5)
    for size in (0, 1, 63, 64, 65, 5000):
        ids = rng.choice(np.array([0, 3, 255, 256, 50_256, 70_000, 2**24 + 7, 2**32 - 1], np.uint32), size)
        segment = token_ids.Segment(*token_ids.encode(ids))
        assert len(segment) == size
        assert [segment[i] for i in range(size)] == ids.tolist()
        for a, b in ((0, size), (size // 3, size // 2), (size, size)):
            assert segment.slice(a, b).tolist() == ids[a:b].tolist()


SPECIAL = ["<|endoftext|>", "a<|endoftext|>b", "<|endoftext|>\n 's", "x <|endoftext|><|endoftext|>", "<|endoftext|", "|endoftext|>"]


def same_ids(encoder, texts, plain=False):
    ids, ends = encoder.encode(pa.array(texts, pa.string()), end_id=2)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [i + [2] for i in library_ids(texts, plain)]


@pytest.mark.parametrize("remembered", [400, 40_000, 10_000_000])
def test_encoder_equals_the_library(remembered):
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "a", "B", "é", "ß×÷", "'s", "'", ",", ".", "1", "²", "_", "\t", "　", "\xa0", "漢", "́", "\x1c", "!", "ł", "ж"]
    texts = ODD + SPECIAL + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000)]
    encoder = byte_bpe.Encoder(BPE, remembered=remembered)
    for start in range(0, len(texts), 300):
        same_ids(encoder, texts[start : start + 300])
        assert encoder.memory <= remembered
    for text in ODD + SPECIAL:  # batches of one text, sliced arrays
        same_ids(encoder, [text])
    ids, ends = encoder.encode(pa.array(["skipped", *ODD], pa.string())[1:])
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == library_ids(ODD)
    assert encoder.encode(pa.array([], pa.string()), 2)[0].size == 0


def test_long_texts_are_encoded_in_parts():
    rng = random.Random(9)
    parts = [" ", "  ", "\n", "ab", "Cd", "é", "'s", ",", "12", "漢", " word", " more words"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 120))) for _ in range(300)] + ODD + SPECIAL + ["x" * 500, " ".join(SPECIAL) + "a b " * 50]
    for window in (5, 60):
        same_ids(byte_bpe.Encoder(BPE, window=window), texts)
        ids, ends = byte_bpe.Encoder(BPE, window=window).encode(pa.array(texts, pa.large_string()))
        assert ids.tolist() == [i for found in library_ids(texts) for i in found] and ends[-1] == len(ids)


def test_encoder_takes_special_strings_as_text_on_request():
    same_ids(byte_bpe.Encoder(BPE, encode_special_tokens=True), SPECIAL + ODD, plain=True)


def test_encoder_remembers_no_long_pieces():
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x4E00, 0x4F00)] + list("abcdefghij")
    texts = ["".join(rng.choices(letters, k=20_000)) for _ in range(20)] + ["".join(rng.choices("abcdefghij", k=20_000))]
    encoder = byte_bpe.Encoder(BPE)
    same_ids(encoder, texts + ["some words more"])
    assert encoder.memory < 1000


def test_token_id_files(spark, tmp_path):
    rows = [(50 - i, t) for i, t in enumerate(ODD + SPECIAL)] + [(7, "twice"), (7, "twice"), (None, "no id"), (1, "long " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("segment", F.lit(0))
    got = token_ids.token_ids(df, BPE, str(tmp_path / "ids"), segment_ids=1000).collect()
    want, start = [], 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (doc, _), ids in zip(ordered, library_ids([t for _, t in ordered])):
        packed = np.array(ids + [2], "<u4")
        want.append((doc, start, len(packed), zlib.crc32(packed.tobytes())))
        start += len(packed)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_ids.token_ids(df.limit(0), BPE, str(tmp_path / "none")).count() == 0


# --- token counts


@pytest.mark.parametrize("small", [False, True])
def test_token_counts_equal_the_library(small):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, unknown = unigram.read_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    if small:  # many ties, and no bytes to fall back to
        pieces, unknown = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aab", -3.0), ("▁a", -3.0)], 0
    library = Tokenizer(models.Unigram(pieces, unknown, byte_fallback=not small))
    library.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    rng = random.Random(1)
    parts = ["a", "b", "a", "b", " ", "c", "x"] if small else [" ", "  ", "\n", "a", "é", "the", ".", "▁", "1", "漢", "😀", "ing", "<s>", "<0x41>"]
    texts = [None, "", " ", "▁", " a"] + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(1500)]
    got = unigram.Counter(pieces).counts(pa.array(texts, pa.string())).tolist()
    assert got == [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a")], "doc_id long, text string").withColumn("n_tokens", F.lit(9))
    got = sorted(map(tuple, unigram.token_counts(df, tokenizer_path("piece_bpe_32k.model")).collect()))
    assert got == [(1, 0), (2, 0), (3, 1), (3, 1)]


# --- top-k search


def plain_top(rows, asked, top=10):
    vectors = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            vectors.setdefault(i, []).append([int(np.floor(1024 * np.float64(x))) for x in v])
    out = []
    for q in asked:
        if q in vectors:
            own = min(vectors[q])
            scores = sorted({(-sum(a * b for a, b in zip(own, v)), i, tuple(v)) for i, vs in vectors.items() if i != q for v in vs})
            out += [(q, n + 1, i, -s) for n, (s, i, _) in enumerate(scores[:top])]
    return sorted(out)


def test_top_products_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE_ROWS", 100)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).tolist()) for i in range(600)]
    rows += [(700 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(800, None), (801, []), (802, [None] * 8), (803, [float("nan")] * 8), (804, [float("inf")] * 8), (805, [0.5]), (None, rows[1][1])]
    rows += [rows[5], rows[5], (900, [1e7] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("v", F.lit(1))
    asked = df.where("vec_id % 100 = 0")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.top_products(df, asked).collect())
    assert got == plain_top(rows, range(0, 1000, 100))


def test_top_products_of_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, -0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in mtree.top_products(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 524288), (0, 2, 2, 524288)]
    assert mtree.top_products(df.limit(0), df).count() == 0
    assert mtree.top_products(df, df.limit(0)).count() == 0


def test_bounds_spare_computations():
    rng = np.random.default_rng(7)
    rows = np.floor(1024 * np.repeat(rng.normal(size=(40, 3)), 50, axis=0) + rng.normal(size=(2000, 3))).astype(np.int64)
    largest = float((rows**2).sum(1).max())
    table = pa.table({"id": pa.array(range(2000)), "v": pa.array(rows.tolist(), pa.list_(pa.int64()))})
    tree = mtree._grow(3, largest)(table).to_batches()[0]
    run = mtree.Search(np.arange(0, 2000, 100), rows[::100], largest)
    for t in mtree._trees(tree, 3):
        run.tree(*t)
    assert run.computed < 0.5 * 20 * 2000


# --- mixing


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "b", "é", None]), "w " * rng.randint(0, 60)) for i in range(1500)]
    rows += [(5000, "z", None), (5001, "empty", ""), (7003, "a", "repeated row"), (7003, "a", "repeated row"), (6000, "one", "x " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("target", F.lit(1)).withColumn("__size", F.lit("x"))
    got = mixing.mix(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(3)).collect()))  # reruns agree
    assert sum(r.size for r in got) == sum(len(brute.spaced(t)) for _, _, t in rows)
    size = {s: sum(len(brute.spaced(t)) for _, x, t in rows if x == s) for s in {r[1] for r in rows}}
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, full, left = {}, set(), 1.5 * sum(size.values())
    while True:
        level = left / sum(w for s, w in weight.items() if s not in full)
        above = {s for s in names if s not in full and level * weight[s] >= 2 * size[s]}
        if not above:
            break
        full |= above
        left -= sum(2 * size[s] for s in above)
    target = {s: 2 * size[s] if s in full else level * weight[s] for s in names}
    by_doc = {r[0]: r[1] for r in rows}
    for s in names:
        own = [r for r in got if by_doc[r.doc_id] == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max((r.size for r in own), default=0)
        assert all(r.taken <= 2 * r.size for r in own)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.taken // r.size for r in got if r.size)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_takes_heavy_documents_first(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'s' AS source", "if(id % 2 = 0, 'abcde bcdef', 'a bcdefghijklmnopqrstuvwxyzabcdefghi') AS text")
    mix = mixing.mix(df, share=0.4, weights=(1.0,))
    taken = {r["odd"]: r["n"] for r in mix.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("n")).collect()}
    assert taken[0] > 3 * taken[1]


@pytest.mark.parametrize("shared", ["no id", "one id", "equal rows", "long words"])
def test_mixing_meets_targets_of_rows_alike(spark, monkeypatch, shared):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 100)
    texts = {
        "equal rows": lambda i: "some equal words",
        "long words": lambda i: " ".join([f"{i}" + "x" * 100] * (1 + i % 40)),
    }.get(shared, lambda i: f"w{i} " * (1 + i % 50))
    ids = {"no id": lambda i: None, "one id": lambda i: 7, "equal rows": lambda i: 7}.get(shared, lambda i: i)
    rows = [(ids(i), "hot", texts(i)) for i in range(2000)] + [(9000 + i, "cold", "a b c") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    for weights in ((2.0, 1.0),):
        got = mixing.mix(df, weights=weights, share=1.3).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df, weights=weights, share=1.3).collect()))
        for source_size in {r.source_size for r in got}:
            own = [r for r in got if r.source_size == source_size]
            assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        times = sum(r.taken // r.size for r in got)
        assert mixing.mixed_documents(df, weights=weights, share=1.3).count() == times


def test_ranges_of_keys_stay_small(spark, monkeypatch):
    """Long words put nearly all keys far out; the ranges follow them."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 500)
    df = spark.range(8000).selectExpr("id AS doc_id", "'s' AS source", "repeat(concat(id, repeat('x', 100), ' '), 3) AS text")
    sums = []
    real = mixing.staged
    monkeypatch.setattr(mixing, "staged", lambda d, name: sums.append(real(d, name)) or sums[-1] if name == "ranges" else real(d, name))
    mixing.mix(df).collect()
    largest = sums[0].groupBy("__range").count().agg(F.max("count")).first()[0]
    assert largest < 1500


# --- memories


LONG_WORDS = ["".join(random.Random(i).choices([chr(c) for c in range(0x4E00, 0x4F00)], k=20_000)) for i in range(12)]


def test_long_words_are_not_remembered():
    counts = unigram.Counter([("▁a", -1.0), ("a", -2.0), ("<unk>", 0.0)])
    assert counts.counts(pa.array(["a a", *LONG_WORDS])).tolist()[0] == 2
    assert counts.memory.held < 1000
    scorer = ordinal.Scorer(ordinal.unfitted(), quality.TEXT)
    for text in LONG_WORDS:
        scorer.score(text.encode())
    assert scorer.memory.held < 1000


@pytest.mark.parametrize("most", [0, 3000, 10**8])
def test_results_do_not_depend_on_what_is_remembered(most):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(40)) for _ in range(60)]
    pieces = [("▁a", -1.0), ("a", -2.0), ("b", -2.5), ("ab", -2.2), ("▁", -3.0), ("cab", -3.1), ("<unk>", 0.0)]
    counter, plain = unigram.Counter(pieces, remembered=most), unigram.Counter(pieces)
    model = ordinal.Model(np.random.default_rng(1).normal(size=ordinal.DIMENSIONS).astype(np.float32), np.zeros(1))
    scorer, other = ordinal.Scorer(model, quality.TEXT, most), ordinal.Scorer(model, quality.TEXT)
    for i in range(0, 60, 10):
        assert counter.counts(pa.array(texts[i : i + 10])).tolist() == plain.counts(pa.array(texts[i : i + 10])).tolist()
        for text in texts[i : i + 10]:
            assert scorer.score(text.encode()) == other.score(text.encode())
        assert counter.memory.held <= most + 300


def test_counts_and_quality_of_empty_tables_and_long_texts(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "word " * 100_000), (2, "漢字" * 10_000)], "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    got = {r.doc_id: r.n_tokens for r in unigram.token_counts(df, path).collect()}
    assert got[1] >= 100_000 and got[2] >= 10_000
    assert unigram.token_counts(df.limit(0), path).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = quality.train(df, labels)
    assert quality.quality(df, model).count() == 2
    assert quality.quality(df.limit(0), model).count() == 0


# --- graded models


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 4, 800)
    texts = [(b"bad " * g + b"fine word other thing " * 5 + b"x%d " % rng.integers(40)) for g in grades]
    model = ordinal.fit(*ordinal.sparse(texts, toxicity.TEXT), grades)
    # repeats in a row count once for toxicity, so use the quality text for counts
    model = ordinal.fit(*ordinal.sparse(texts, quality.TEXT), grades)
    scorer = ordinal.Scorer(model, quality.TEXT)
    tails = ordinal.tails(model, [scorer.score(t) for t in texts])
    assert (np.diff(model.thresholds) > 0).all() and (np.diff(tails, axis=1) <= 1e-12).all()
    assert np.corrcoef(tails.sum(axis=1), grades)[0, 1] > 0.8


def plain_loss(rows, columns, values, grades, weight, first, gaps):
    """The penalised likelihood as the module states it, one row at a time."""
    thresholds = [first + sum(math.exp(x) for x in gaps[:k]) for k in range(len(gaps) + 1)]
    share = [list(grades).count(g) for g in range(len(gaps) + 2)]
    total = 0.5 * ordinal.PENALTY * sum(w * w for w in weight.values())
    for i, g in enumerate(grades):
        score = sum(v * weight[int(c)] for r, c, v in zip(rows, columns, values) if r == i)
        upto = [0.0, *[1 / (1 + math.exp(score - t)) for t in thresholds], 1.0]
        total -= math.log(upto[g + 1] - upto[g]) / share[g] / sum(x > 0 for x in share)
    return total


@pytest.mark.parametrize("levels", [2, 4])
def test_ordinal_regression_finds_the_best_of_a_plain_likelihood(levels):
    rng = random.Random(levels)
    texts = [" ".join(rng.choices(["bad", "good", "so", "fine", "word"], k=rng.randint(1, 7))).encode() for _ in range(24)]
    grades = np.array([i % levels for i in range(24)])
    features = ordinal.sparse(texts, quality.TEXT)
    model = ordinal.fit(*features, grades, steps=20_000)
    weight = {int(c): float(model.weights[c]) for c in features[1]}
    first, gaps = float(model.thresholds[0]), np.log(np.diff(model.thresholds)).tolist()
    least = plain_loss(*features, grades, weight, first, gaps)
    assert least < plain_loss(*features, grades, dict.fromkeys(weight, 0.0), 0.0, [0.0] * len(gaps))
    for step in (-0.05, 0.05):
        around = [plain_loss(*features, grades, weight | {c: w + step}, first, gaps) for c, w in weight.items()]
        around += [plain_loss(*features, grades, weight, first + step, gaps)]
        around += [plain_loss(*features, grades, weight, first, [*gaps[:k], gaps[k] + step, *gaps[k + 1 :]]) for k in range(len(gaps))]
        assert min(around) > least - 1e-5


@pytest.mark.parametrize("module,column,flag", [(toxicity, "toxic", "rejected"), (quality, "quality", "kept")])
def test_models_on_held_out_rows(spark, module, column, flag):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = module.train(docs, labels.where("doc_id % 4 <> 0"))
    grade = toxicity.severity if module is toxicity else quality.quality
    out = grade(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    right = sum(r[flag] == bool(r[column]) for r in out) / len(out)
    assert len(out) > 50 and right > 0.88


def test_models_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "you idiot clown"), (4, "you idiot clown"), (None, "nice day")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tail", F.lit(1)).withColumn("grade", F.lit(1))
    labels = spark.createDataFrame([(4, 1), (1, 0), (2, 0), (9, 1), (None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.severity(docs, model).count() == 6
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() <= 6
    nothing = toxicity.train(docs, labels.limit(0))
    assert not nothing.weights.any()
    assert toxicity.severity(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("given", [[], [(77, 1)], [(1, 1), (2, 1)], [(1, 0), (2, 0)]])
def test_unfitted_model_rejects_nothing(spark, given):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "nice day"), (3, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(given, "doc_id long, toxic int"))
    assert toxicity.without_toxic(docs, model).count() == 3
    assert {(r.p_toxic, r.rejected) for r in toxicity.severity(docs, model).collect()} == {(0.0, False)}
    assert all(r.kept for r in quality.quality(docs, model).collect())


def test_too_many_grades_are_an_error(spark):
    labels = spark.range(70).selectExpr("id AS doc_id", "cast(id AS int) AS toxic")
    with pytest.raises(ValueError):
        toxicity.train(spark.range(70).selectExpr("id AS doc_id", "'a' AS text"), labels)


# --- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    texts = {r.doc_id: r.text for r in docs.collect()}
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        before = sorted(r.doc_id for r in docs.select("doc_id").collect())
        after = sorted(r.doc_id for r in out.select("doc_id").collect())
        assert after, name
        if number + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        if name == "near copies":
            found = brute.similar([(d, texts[d]) for d in before], corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
            assert after == sorted({c for _, c in found.values()})
        elif name == "benchmark decontamination":
            hit = brute.decontaminated([texts[d] for d in before], bench)
            assert after == [d for d, h in zip(before, hit) if not h[4]] and len(after) < len(before)
        elif name == "mixing":
            times = {r.doc_id: r.taken // max(r.size, 1) for r in mixing.mix(docs).collect()}
            assert after == sorted(d for d in before for _ in range(times[d]))
        elif name == "token ids":
            counts = {d: len(i) + 1 for d, i in zip(set(before), library_ids([texts[d] for d in set(before)]))}
            assert all(r.n_tokens == counts[r.doc_id] for r in out.collect()) and after == before
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.run(spark, SF).count() == len(after)


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == 0
    assert os.path.exists(BPE) and jaccard.SLICES_FROM > 80
