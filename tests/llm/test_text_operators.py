"""Decontamination, Jaccard join, personal data and chat formatting against plain versions and odd input."""

import hashlib
import itertools
import random

import numpy as np
import pytest

import brute
from aftershock.llm import chat, decontaminate, jaccard, pii
from pyspark.sql import functions as F

WORDS = "the of and to in a is that it was for on are with as at be this have from".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


# --- decontamination


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 14, 40]))) for i in range(12)] + [(3, prose(rng, 12)), (None, "x y"), (90, None), (91, " .,")]
    texts = [None, "", "...", "É é", prose(rng, 30_000)]
    for _ in range(60):
        piece = rng.choice(items[:12])[1].split()
        a = rng.randint(0, len(piece) - 1)
        texts.append(f"{prose(rng, 5)}, {' '.join(piece[a : a + 15]).upper()}. {prose(rng, 6)} {items[rng.randint(0, 11)][1]}")
    texts.append(texts[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("hits", F.lit(1)).withColumn("row", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.decontaminated(texts, items)
    for block_bytes in (10**6, 700):  # one automaton, and several blocks
        got = decontaminate.report(docs, bench, block_bytes=block_bytes).orderBy("doc_id").collect()
        assert [tuple(r)[1:6] for r in got] == want


def test_decontamination_of_empty_tables_and_removal(spark):
    docs = spark.createDataFrame([(1, "one two three four", "k"), (2, "a B, c! d", None)], "doc_id long, text string, hits string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.report(docs, none).collect()] == [0, 0]
    assert decontaminate.report(docs.limit(0), none).count() == 0
    bench = spark.createDataFrame([(7, "b c")], "item_id long, text string")
    cut = {r.doc_id: r for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut[1].text == "one two three four" and cut[1].hits == "k"
    assert cut[2].text == "a ! d"
    assert [r.doc_id for r in decontaminate.remove_spans(docs, bench, max_coverage=0.0).collect()] == [1]
    assert [r.doc_id for r in decontaminate.remove_spans(docs, bench, max_coverage=0.4).collect()] == [1]
    assert decontaminate.remove_spans(docs, bench, max_span=2).where("doc_id = 2").first().text == "a B, c! d"


# --- Jaccard join


def near_copies(seed):
    rng = random.Random(seed)
    texts = [None, "", "  ", "a", "a b", "A B", "a b c", prose(rng, 4000)]
    base = [prose(rng, rng.choice([11, 12, 25, 80, 200])) for _ in range(25)]
    common = prose(rng, 40)
    for text in base:
        words = text.split()
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            texts.append(" ".join(copy))
    texts += [f"{common} {prose(rng, 50)}" for _ in range(20)]
    chain = prose(rng, 120).split()
    for i in range(30):
        chain[4 * i] = f"new{i}"
        texts.append(" ".join(chain))
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (1, 60)])
def test_similar_documents_equal_brute_force(spark, words, percent):
    docs = near_copies(words)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("sigs", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(df, words, percent).collect()}
    assert got == brute.similar(docs, words, percent)


def test_blocks_of_a_large_group_meet(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    docs = near_copies(9)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect()}
    assert got == brute.similar(docs)


def test_similar_documents_of_odd_rows(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (2, "A b c D"), (2, "A b c D"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(jaccard.similar_documents(df).collect(), key=str)
    assert [(r.doc_id, r.component_id) for r in got if r.doc_id is not None] == [(2, 2), (2, 2), (5, 2), (9, 9)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert sorted(str(r.doc_id) for r in jaccard.keep_one_of_each_group(df).collect()) == ["2", "9", "None"]
    assert jaccard.similar_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [90, 80])
def test_texts_that_share_a_doc_id_keep_all_their_links(spark, percent):
    rng = random.Random(11)
    base = [prose(rng, 120) for _ in range(4)]
    near = [t + " end" for t in base]
    # 1 and 9 are near the texts of 5, and so is 3; 7 has the very text of 2 and one near 8's
    rows = [(5, base[0]), (5, base[1]), (5, base[1]), (5, base[0].upper()), (1, near[0]), (9, near[1])]
    rows += [(7, base[2]), (2, base[2]), (7, base[3]), (8, near[3]), (20, prose(rng, 120)), (20, prose(rng, 120))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for _ in range(2):
        got = {r.doc_id: r.component_id for r in jaccard.similar_documents(df.repartition(3), 3, percent).collect()}
        assert got == {1: 1, 5: 1, 9: 1, 2: 2, 7: 2, 8: 2, 20: 20}
    assert sorted(r.doc_id for r in jaccard.keep_one_of_each_group(df, 3, percent).collect()) == [1, 2, 20]


def test_slices_and_first_hashes_lose_no_pair():
    rng = np.random.default_rng(1)
    for percent in (80, 90, 95):
        key = jaccard.signatures if percent >= jaccard.SLICES_FROM else jaccard.first_hashes
        for size in (10, 11, 19, 40, 333, 2000):
            for _ in range(30):
                a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
                drop, add = rng.integers(0, size // 8 + 2, 2)
                b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**63, add).astype(np.uint64))))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
                    assert np.intersect1d(key(a, percent), key(b, percent)).size


# --- personal data


def test_patterns_equal_plain_regular_expressions():
    rng = random.Random(3)
    parts = ["@", "a", "b.c", ".", "..", "-", "+1", "12", "255", "256", "1.2.3.4", " ", "(", ")", "4539578763621486", "0", "é", "٣", "x@y.z"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 16)))
        assert sorted(pii.pattern_spans(text)) == brute.personal(text), text


def test_long_digits_take_linear_time():
    assert pii.pattern_spans("1" * 300_000 + "@" * 1000) == []


def test_field_learns_its_table_and_adds_spans():
    field = pii.train()
    for words, labels in pii.labelled_runs():
        assert field.decode([words]) == [labels]
    text = "Ring (017) 555-7713, or mail a.b@c.org; version 4.0."
    ((base, every),) = pii.all_spans([text], field)
    assert pii.written(base) == "email:29:38"
    assert pii.written(every) == "email:29:38,phone:5:19"
    assert set(base) <= set(every)


def test_field_finds_all_kinds_by_context_in_forms_beside_its_table():
    field = pii.train()
    told = {  # none of these values or sentences is in the table
        "please call 444 0199": "phone:12:20",
        "his phone is 0221 4440 197": "phone:13:26",
        "the items 444 0199 were late": "",
        "we counted 444 0199 cells": "",
        "her card was 4111 2222 3333 4449 ok": "card:13:32",
        "visa card 3799 123456 78909": "card:10:27",
        "invoice 4111222233334449 due": "",
        "IP 2a02:8108:9:1f::2": "ip:3:20",
        "ip address 10[.]9[.]8[.]7": "ip:11:25",
        "mac aa:1b:22:3c:44:5f": "",
        "at 11:22:33 it": "",
        "write to olga@intranet today": "email:9:22",
    }
    for text, want in told.items():
        assert not any(w in line for line in pii.LABELLED for w in text.split() if len(w) > 9 and any(map(str.isdigit, w)))
        ((base, every),) = pii.all_spans([text], field)
        assert base == [] and pii.written(every) == want, text


# frames and values that are not in the table
HELD_OUT = {
    0: (["write to {} today", "mail {}", "my email is {}", "contact {} please", "send to {} now"],
        ["olga@intranet", "max.m@server1", "tina(at)shop.example", "pia[at]mail.example"]),
    1: (["the server {} is slow", "ping {} now", "connected from ip {}", "host {} went down", "client ip {}"],
        ["2a02:8108:9:1f::2", "fe80::2aa:ff:fe9a:4ca2", "10[.]9[.]8[.]7", "172.16.4.x"]),
    2: (["please bill card {}", "my visa is {}", "paid by mastercard {} yesterday", "card no. {}", "amex card {} on file"],
        ["4111 2222 3333 4449", "4111-2222-3333-4449", "4111222233334449", "3799 123456 78909", "**** **** **** 4449"]),
    3: (["reach us under {}", "the hotline is {} daily", "please phone {} tomorrow", "her mobile number: {}", "my cell is {}", "ring {} tonight"],
        ["444 0199", "0221 4440 197", "646-555-0123", "(030) 555-0177", "5550188", "0171/5550188"]),
}
HELD_OUT_NUMBERS = (
    ["my ssn is {}", "paragraph {} applies", "order {}", "sold {} pieces", "isbn {}", "version {} came out", "lot number {}", "the score was {}",
     "claim {} was filed", "the population of {} grew", "my student id is {}", "zip {}", "invoice number {}"],
    ["123-45-6789", "555-0143", "212-555-0199", "4155552671", "978-0-306-40615-7", "444 0199", "4111222233334449", "12:44:10", "1,555,019"],
)


def test_field_on_held_out_sentences():
    field = pii.trained()
    assert pii.trained() is field  # trained once
    found, asked, wrong = 0, 0, []
    for kind, (frames, values) in HELD_OUT.items():
        for frame, value in itertools.product(frames, values):
            text = frame.format(value)
            assert text not in "\n".join(pii.LABELLED)
            ((_, every),) = pii.all_spans([text], field)
            at = text.index(value)
            found, asked = found + ((kind, at, at + len(value)) in set(map(tuple, every))), asked + 1
    for frame, value in itertools.product(*HELD_OUT_NUMBERS):
        ((base, every),) = pii.all_spans([frame.format(value)], field)
        wrong += [frame.format(value)] * bool(set(every) - set(base))
    assert found / asked > 0.9
    assert len(wrong) <= 3


def test_table_labels_every_kind():
    labels = {n for _, path in pii.labelled_runs() for n in path}
    assert {1 + 2 * k for k in range(len(pii.KINDS))} <= labels


def test_personal_data_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "é x@y.z 10.0.0.1"), (3, "é x@y.z 10.0.0.1"), (None, "+49 30 1234567")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(3))
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in pii.personal_data(df).collect()}
    assert got == {(1, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, ""), (3, 1, 1, 0, 0, "email:2:7,ip:8:16"), (None, 0, 0, 0, 1, "phone:0:14")}
    assert pii.personal_data(df.limit(0)).count() == 0


# --- chat formatting


def test_chat_round_trip(spark):
    rng = random.Random(8)
    marks = ["<|im_start|>", "<|im_end|>", "<|im_part|>", "<\\|", "<", "|", "\\", "\n", "assistant\n", "é", "x", "%0A", "$1"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 7)):
            text = rng.choice([None, "", "".join(rng.choices(marks, k=rng.randint(1, 12)))])
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", None, "we\nird%|<|"]), text))
    rows.append((None, 0, "user", "no id"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    formatted = chat.format_conversations(df)
    for r in formatted.collect():
        assert sum(x.control_chars + x.text_chars for x in r.loss_runs) + len(chat.END) == len(r.formatted)
    read = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_conversations(formatted).collect()}
    want = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn, role or "", text or ""))
    assert read == {c: [t[1:] for t in sorted(v)] for c, v in want.items()}
    for r in chat.digests(formatted).collect():
        turns = [t[1:] for t in sorted(want[r.conv_id])]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(learned)
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_digests_follow_the_mask(spark):
    rows = [(1, 0, "user", "a<|b"), (1, 1, "assistant", "\ufeffé<|im_end|>"), (1, 2, "assistant", ""), (1, 3, "user", "x"), (1, 4, "assistant", "😀z")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [x.learned for x in formatted.first().loss_runs] == [False, True, True, False, True]

    def learned(mask):
        flipped = F.transform("loss_runs", lambda x: x.withField("learned", mask(x)))
        return chat.digests(formatted.withColumn("loss_runs", flipped)).first()

    for mask, want in (
        (lambda x: x["learned"], "\ufeffé<|im_end|>😀z"),
        (lambda x: ~x["learned"], "a<|bx"),
        (lambda x: F.lit(False), ""),
    ):
        r = learned(mask)
        assert (r.loss_chars, r.loss_sha256) == (len(want), hashlib.sha256(want.encode()).hexdigest())


def test_chat_merges_adjacent_turns_and_uses_no_python(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    text = formatted.first().formatted
    assert text == "<|im_start|>user\na<|im_part|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    plan = chat.digests(formatted)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
