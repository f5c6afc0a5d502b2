"""Encoding, leak search and abuse scores."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statelog.llm import abuse, leaks, tokenize
from statelog.llm.queries import BYTE_BPE_PIECES, TOKENIZERS
from statelog.llm.wording import tokens

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
needs_ranks = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary files")


def plain_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        at = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
        if parts[at] + parts[at + 1] not in ranks:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


TOY = {bytes([b]): i for i, b in enumerate(b"abc")} | {p: i + 3 for i, p in enumerate([b"ab", b"ba", b"aa", b"abab", b"aab", b"cab", b"abc", b"aaaa"])}


@given(st.text("abc", max_size=40))
@settings(max_examples=400, deadline=None)
def test_merges_in_order_of_rank(text):
    piece = text.encode()
    assert tokenize.merge_piece(piece, TOY) == ([TOY[piece]] if piece in TOY else plain_merge(piece, TOY))


@needs_ranks
def test_same_ids_as_the_public_library():
    import tiktoken

    ranks = tokenize.read_ranks(RANKS)
    ours = tokenize.Encoder(ranks, BYTE_BPE_PIECES)
    theirs = tiktoken.Encoding("own", pat_str=BYTE_BPE_PIECES, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", " ", "\n\n  x", "<|endoftext|> don't", "naïve Ünïcode 日本語 🧪🧪", "a" * 3000, "ab" * 5000 + "!" * 700]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x20, 0x2FFF), 32, 10])) for _ in range(rng.randrange(80))) for _ in range(500)]
    for t in texts:
        assert ours.encode(t) == theirs.encode_ordinary(t)
        assert theirs.decode(ours.encode(t)) == t


@needs_ranks
def test_encoding_of_a_table(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "hello world", "x")], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in tokenize.encode_texts(df, RANKS, BYTE_BPE_PIECES).collect()}
    assert got == {1: [31373, 995], 2: [], 3: [], 4: [31373, 995]}
    assert tokenize.encode_texts(df.where("false"), RANKS, BYTE_BPE_PIECES).collect() == []


ITEM = "The glazier divides the brass candles of Tolquaa behind the folded marsh while 34 frozen wagons wait inside a crooked orchard before dawn"
WORDS = ITEM.split()


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (ITEM, True),
        (" ".join(WORDS[3:15]), True),
        (" ".join(WORDS[3:14]), False),
        (ITEM.upper().replace(" ", "\n* "), True),
        (" ".join(f"[[Page|{w}]]" for w in WORDS), True),
        (" ".join(f"[[{w}]]" for w in WORDS), True),
        (ITEM.replace("brass", "brass<!-- check this -->").replace("marsh", "ma­rs​h"), True),
        (ITEM.replace("candles", "'''cand'''les").replace("of", "<i>of</i>"), True),
        ("{{quote|1=" + ITEM + "}}", True),
        (ITEM.replace("behind", "<ref>Boel, p. 3</ref> behind").replace("while", "{{sfn|Zan|12}} while"), True),
        ("See <ref name='a'>" + ITEM + "</ref> there", True),
        ("{|\n| style=\"width:3em\" | " + " ".join(WORDS[:8]) + "\n|-\n| " + " || ".join(WORDS[8:]) + "\n|}", True),
        (ITEM.replace("candles", "cändlés").replace(" ", "&nbsp;"), True),
        (" ".join(w if i % 8 else f"indeed {w}" for i, w in enumerate(WORDS)), False),
        ("<!-- " + ITEM + " -->", False),
        (" ".join(reversed(WORDS)), False),
        ("", False),
        (None, False),
    ],
)
def test_leaks(text, found):
    finder = leaks.LeakFinder([(7, ITEM), (8, "too short"), (9, None)])
    assert set(finder.leaks(text)) == ({7} if found else set())


def test_leak_tables(spark):
    docs = spark.createDataFrame([(1, f"Before. {ITEM}. After it", "en"), (2, "nothing", "en"), (3, None, None), (1, ITEM, "en")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(5, ITEM, "a"), (6, ITEM, "b"), (None, ITEM, "c"), (7, None, "d")], "item_id bigint, text string, answer string")
    for block in (1, 100):
        got = leaks.find_leaks(docs, items, block=block)
        assert sorted((r.doc_id, r.item_id, r.words) for r in got.collect()) == sorted([(1, 5, len(WORDS)), (1, 6, len(WORDS))] * 2)
    assert [r.doc_id for r in leaks.without_leaks(docs, got).orderBy("doc_id").collect()] == [2, 3]
    for block in (1, 100):
        clean = {r.doc_id: r.text for r in leaks.remove_spans(docs.where("text is null or text <> '" + ITEM + "'"), items, block=block).collect()}
        assert clean == {1: f"before {leaks.GAP} after it", 2: "nothing", 3: None}
    assert leaks.find_leaks(docs.where("false"), items).collect() == [] and leaks.find_leaks(docs, items.where("false")).collect() == []


@pytest.mark.parametrize(
    "text",
    [
        f"Before. {ITEM}. After it",
        "Before. " + " ".join(w if i % 9 else f"{{{{note|x{i}}}}} {w}" for i, w in enumerate(WORDS)) + ". After it",
        "Before. " + " ".join(f"{{{{lang|en|{w}}}}}" if i % 5 == 2 else w for i, w in enumerate(WORDS)) + ". After it",
        f"Before. <ref>See {ITEM}</ref> After it<ref>plain note</ref>",
        f"Before. {{{{quote|1={ITEM}}}}} {ITEM} After it",
        f"Before. {' '.join(WORDS[:12])} and {ITEM} After it",
    ],
)
def test_cleaned_pages_show_nothing_and_keep_the_rest(text):
    finder = leaks.LeakFinder([(7, ITEM)])
    assert set(finder.leaks(text)) == {7}
    clean = finder.without_spans(text)
    assert finder.leaks(clean) == {} and finder.without_spans(clean) == clean
    words = clean.split()
    assert words[0] == "before" and {"after", "it"} <= set(words) and ("plain note" in clean) == ("plain note" in text)
    assert len(set(words) & {w.lower() for w in WORDS}) <= 2
    harmless = "A page <ref>with a note</ref> and {{a|template}}"
    assert finder.without_spans(harmless) == harmless and finder.without_spans(None) is None


def test_disguised_words():
    assert tokens("f.u.c.k s h i t 5uck5 shiiiiit c_h_i_l_d nаughty ‮b​ad 1907") == ["fuck", "shit", "sucks", "shit", "child", "naughty", "bad", "#"]
    assert tokens("[[Page|fool]] '''id'''iot <!-- x -->") == ["fool", "idiot", "x"]
    assert tokens("村の橋") == ["村", "の", "橋"] and tokens(None) == [] and tokens("") == []


GROUPS = ["muslims", "germans", "women", "turks", "immigrants", "jews"]


def labelled(n=500, seed=6):
    rng = random.Random(seed)
    fill = "the old mill stands near river and its records mention a small council that kept the garden open for many years".split()
    bad = ["the {} are vermin nothing more", "all {} should be driven out of here", "you utter dipshit go away", "what a load of shit by a moron"]
    good = ["the {} built the bridge in spring", "a pamphlet called the {} vermin and historians cite it", "the census lists {} of the valley", "pigs and rats were kept there"]
    out = []
    for i in range(n):
        y = i % 3 == 0
        s = rng.choice(bad if y else good).format(rng.choice(GROUPS[:4]))
        words = [rng.choice(fill) for _ in range(rng.randrange(30, 90))]
        at = rng.randrange(len(words))
        vote = float(y) if rng.random() < 0.95 else float(not y)
        out.append((" ".join([*words[:at], s, *words[at:]]), vote, i))
    return out


def test_classifier_on_held_out_texts():
    train, test = labelled(), labelled(200, 9)
    model = abuse.fit(train)
    scores = model.scores([t for t, _, _ in test])
    right = sum((s >= abuse.THRESHOLD) == (i % 3 == 0) for i, s in enumerate(scores))
    assert right >= 190


def test_identity_terms_hardly_move_scores():
    model = abuse.fit(labelled())
    neutral = model.scores([f"the {g} built the bridge in spring" for g in GROUPS])
    assert max(neutral) < abuse.THRESHOLD and max(neutral) - min(neutral) < 0.15


def test_scores_of_odd_texts(spark):
    assert len(set(abuse.fit([]).scores(["a word", "another"]))) == 1  # without labels no text stands out
    model = abuse.fit([*labelled(), *[(f"you fucking dipshit cunt you whore, page {i} of {i % 7}", 1.0, 1000 + i) for i in range(40)]])
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, " \n.", None), (4, "you fucking dipshit cunt", "b"), (5, "x " * 200_000 + "you fucking dipshit cunt", "b")], "doc_id bigint, text string, score string")
    got = {r.doc_id: r.score for r in abuse.score_texts(df, model).collect()}
    assert got[1] == got[2] == got[3] == 0 and got[4] > abuse.THRESHOLD and got[5] > abuse.THRESHOLD
    assert abuse.score_texts(df.where("false"), model).collect() == []
    labels = spark.createDataFrame([(1, "r1", 1), (4, "r1", 1), (4, "r2", 0), (5, "r1", None), (None, "r1", 1), (99, "r1", 1)], "doc_id bigint, rater string, abusive int")
    texts = abuse.labelled_texts(df.withColumn("page_id", F.lit(None).cast("bigint")), labels)
    assert texts == [("you fucking dipshit cunt", 0.5, None)]
    many = spark.createDataFrame([(i, "r", i % 2) for i in range(1, 6)], "doc_id bigint, rater string, abusive int")
    bounded = [abuse.labelled_texts(df.withColumn("page_id", F.lit(None).cast("bigint")), many, chars=c) for c in (1, 30, 10**6)]
    assert len(bounded[2]) == 4 and len(bounded[0]) <= len(bounded[1]) < 4
    assert abuse.fit(texts).scores(["x"]).shape == (1,)
