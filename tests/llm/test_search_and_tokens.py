"""Alignment of tokenizers, ranked lexical search and language identification against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deskgraph.llm import alignment, language, lexical
from deskgraph.llm.common import table
from deskgraph.llm.queries import QUERIES, tokenizer_path
from tests.conftest import SMALL

BYTE_FILE, PIECE_FILE = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")

ODD_TEXTS = [
    None, "", " ", "  ", "a ", "a  ", " a", "\n", "\nfoo\n\n  bar \n", "a\n", " b\n c", "<s> <0x0A> <|endoftext|> x </s>", "a\r\nb;\r",
    "x▁y", "①ﬁ日本語 テ", "a\xa0b  \xa0 c", "tab\tx\t y", "it's we'll 'S", "\x00\x1c a \x1f", "é" * 50, "q" * 3000,
    "\U0001f600 \U0001f468‍\U0001f469", "̀a ‍ b", "x\x0b\x0cy \x0b z", " \n \n x", "1234 5 ١٢", "naïve façade - Straße!", "a  b\tc\nd",
]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    letters = {}  # the byte-level alphabet, by its published rule
    spare = 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            letters[chr(byte)] = byte
        else:
            letters[chr(256 + spare)] = byte
            spare += 1
    a_bytes = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, a_bytes, b_bytes


def plain_alignment(text, tokenizers):
    """Ids of both sides, groups and links of one text, over all pairs of tokens."""
    a, b, a_bytes, b_bytes = tokenizers
    if not text:
        return [], [], [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    body = (" " + text).encode()
    if b"".join(map(a_bytes, ids_a)) != body or b"".join(map(b_bytes, ids_b)) != body:
        return [], [], [], []

    def ranges(ids, name):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(name(i))))
            at = out[-1][1]
        return out

    spans_a, spans_b = ranges(ids_a, a_bytes), ranges(ids_b, b_bytes)
    common = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
    groups, low = [], 0
    for high in common:
        side = lambda ids, spans, low=low, high=high: ",".join(str(i) for i, s in zip(ids, spans, strict=True) if low <= s[0] and s[1] <= high)
        groups.append(f"{side(ids_a, spans_a)}|{side(ids_b, spans_b)}")
        low = high
    links = [(x, y) for x, s in zip(ids_a, spans_a, strict=True) for y, t in zip(ids_b, spans_b, strict=True) if s[0] < t[1] and t[0] < s[1]]
    return ids_a, ids_b, groups, links


def plain_scores(texts, tokenizers):
    made = [plain_alignment(t, tokenizers) for t in texts]
    count = Counter(pair for m in made for pair in set(m[3]))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for ids_a, ids_b, groups, links in made:
        told = ";".join(groups)
        out.append((
            len(ids_a), len(ids_b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(told.encode()).hexdigest() if told else "",
        ))
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


@pytest.mark.parametrize("held_pairs", [0, 4_000_000])
def test_alignment_of_odd_texts(spark, tokenizers, held_pairs):
    texts = [*ODD_TEXTS, ODD_TEXTS[11], ODD_TEXTS[11]]
    ids = [*range(len(ODD_TEXTS) - 2), None, None, 3, 3]  # repeated and missing ids are rows of their own
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, links string").repartition(3)
    got = alignment.scored_links(docs, BYTE_FILE, PIECE_FILE, held_pairs=held_pairs).collect()
    assert Counter((r["doc_id"], *(r[f] for f in FIELDS)) for r in got) == Counter((i, *s) for i, s in zip(ids, plain_scores(texts, tokenizers), strict=True))


def test_alignment_query_against_plain(spark, tokenizers):
    rows = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op11_token_alignment"](spark, SMALL).collect()}
    for row, want in zip(rows, plain_scores([r["text"] for r in rows], tokenizers), strict=True):
        assert tuple(got[row["doc_id"]][f] for f in (*FIELDS[:-1], "groups_sha256")) == want


def test_alignment_groups_are_the_full_text(spark, tokenizers):
    docs = spark.createDataFrame([(1, "Haanth naïve\nreoush")], "doc_id long, text string")
    row = alignment.alignments(docs, BYTE_FILE, PIECE_FILE).first()
    _, _, groups, links = plain_alignment("Haanth naïve\nreoush", tokenizers)
    assert row["groups"] == ";".join(groups)
    assert Counter(dict(zip(zip(row["links"]["a"], row["links"]["b"], strict=True), row["links"]["times"], strict=True))) == Counter(links)


def test_alignment_of_an_empty_table(spark):
    assert alignment.scored_links(spark.createDataFrame([], "doc_id long, text string"), BYTE_FILE, PIECE_FILE).collect() == []


def test_alignment_keeps_frequent_chunks_when_memory_is_full(tokenizers):
    run = alignment.aligner(BYTE_FILE, PIECE_FILE, cached=8)
    texts = [f"the word{i} and other{i} things" for i in range(40)]
    for low in range(0, 40, 4):
        groups, totals, _ = run(texts[low : low + 4])
        for text, told, sizes in zip(texts[low : low + 4], groups, totals, strict=True):
            ids_a, ids_b, want, links = plain_alignment(text, tokenizers)
            assert told == ";".join(want) and sizes.tolist() == [len(ids_a), len(ids_b), len(want), len(links)]


@given(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.data())
@settings(max_examples=60, deadline=None)
def test_align_and_linked_against_all_pairs(sizes_a, data):
    total = sum(sizes_a)
    cuts = sorted(data.draw(st.sets(st.integers(1, total))) | {total})
    ends_a, ends_b = np.cumsum(sizes_a).tolist(), cuts
    spans = lambda ends: list(zip([0, *ends], ends, strict=False))
    ends = alignment.align(ends_a, ends_b)
    assert [(ends_a[i - 1], ends_b[j - 1]) for i, j in ends] == [(e, e) for e in sorted(set(ends_a) & set(ends_b))]
    found = [p for low, high in zip([(0, 0), *ends], ends, strict=False) for p in alignment.linked(ends_a, ends_b, low, high)]
    want = [(i, j) for i, s in enumerate(spans(ends_a)) for j, t in enumerate(spans(ends_b)) if s[0] < t[1] and t[0] < s[1]]
    assert sorted(found) == want and len(found) == len(set(found))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranks(docs, items, k):
    bags = [(i, plain_words(t)) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            if not bag:
                continue
            m, tf = 25 + 75 * len(bag) * n_docs // length, Counter(bag)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
                for t in plain_words(text) if t in tf
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored)[:k], 1)]
    return out


def ranked(spark, docs, items, k=10, **settings):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("terms", lexical.F.lit("x")).repartition(3)
    asked = spark.createDataFrame(items, "item_id string, text string").withColumn("score", lexical.F.lit(1))
    return Counter(tuple(r) for r in lexical.rank_documents(frame, asked, k).collect())


def test_lexical_search_against_plain(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Äpfel", "äpfel", "x2", "É"]
    share = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=share / share.sum()))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(400)]
    docs += [(i, docs[7][1]) for i in range(1000, 1030)]  # ties
    docs += [(9, "w1 w2"), (9, "w1 w2"), (None, "w1 w2"), (None, None), (2000, ""), (2001, "..."), (2002, "w59 " * 20_000), (-5, "W1 w2")]
    items = [(f"i{i}", text(8)) for i in range(30)] + [("a", None), ("b", ""), ("c", "unheard of"), ("d", "w59 W59 w3"), ("d", "w59"), (None, "äpfel x2"), ("e", "w1 w2")]
    assert ranked(spark, docs, items) == Counter(plain_ranks(docs, items, 10))


def test_lexical_search_in_blocks_and_small_shards(spark, monkeypatch):
    docs = [(i, f"a{i % 7} b{i % 3} c{i % 11} " * (1 + i % 5)) for i in range(120)]
    items = [(str(i), f"a{i % 7} c{i % 11} c{i % 11}") for i in range(25)]
    monkeypatch.setattr(lexical, "SHARD_DOCS", 16)
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    n_docs, length = lexical.corpus_size(frame)
    shards = lexical.index(frame, n_docs, length)
    assert shards.count() >= 8
    got = lexical.search(shards, lexical.query_terms(asked), n_docs, k=4, block_terms=10).drop("query_row").collect()
    assert Counter(map(tuple, got)) == Counter(plain_ranks(docs, items, 4))


def test_lexical_search_of_empty_tables(spark):
    assert not ranked(spark, [], [("a", "b")]) and not ranked(spark, [(1, "b")], []) and not ranked(spark, [(1, None)], [("a", "b")])


def test_lexical_search_visits_few_strata():
    """A document far better than the rest ends the search before most strata are scored."""
    docs = [["rare"] * 5] + [["common"] * (1 + i) + ["filler"] * (200 - i) for i in range(150)]
    held = {"rare": 0, "common": 1, "filler": 2}
    sizes = np.array([len(d) for d in docs])
    made = lexical.build(np.arange(len(docs)), np.zeros(len(docs), np.uint8), sizes, np.array([held[t] for d in docs for t in d]), 3, len(docs), sizes.sum())
    shard = lexical.Shard({n: lexical.packed(made[n], t) for n, t in lexical.INDEX.items()} | {"terms": lexical.packed(b"rare common filler")}, {b"rare"})
    scored = []
    shard.score = lambda segment, factor, best, real=shard.score: scored.append(len(segment)) or real(segment, factor, best)
    best = shard.search([(b"rare", 1000)], np.array([[0, 1, 0]]))
    assert best[0, 2] == 0 and sum(scored) == 1


def test_language_grams_against_plain():
    words = ["ab", "ä", "straße", "ab"]
    hashes, owners = language.grams(words)
    plain = [set() for _ in words]
    for k, word in enumerate(words):
        marked = f"\n{word}\n"
        plain[k] = {marked[i : i + n] for n in language.SIZES for i in range(len(marked) - n + 1)} - {"\n"}
        assert len(set(hashes[owners == k].tolist())) == len(plain[k])
    assert len(set(hashes.tolist())) == len(set().union(*plain))
    assert sorted(hashes[owners == 0].tolist()) == sorted(hashes[owners == 3].tolist())


def test_language_filter_holds_every_gram_and_counts_chances():
    rng = np.random.default_rng(2)
    members = [rng.integers(0, 1 << 63, 20_000).astype(np.uint64) for _ in range(70)]  # two words of bits
    bits = np.zeros((2, language.POSITIONS), np.int64)
    for k in (0, 5, 69):
        for turn in range(language.HASHES):
            bits[k // language.WORD_BITS, language.positions(members[k], turn)] |= np.int64(1) << (k % language.WORD_BITS)
    known = language.Filter([str(k) for k in range(70)], bits)
    hits = known.hits(members[5], np.zeros(20_000, np.int64), 1)[0]
    chances = known.chances()
    assert hits[5] == 20_000 and hits[[1, 2, 68]].sum() == 0
    assert abs(hits[69] - 20_000 * chances[69]) <= 5 * math.sqrt(20_000 * chances[69]) + 3


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").select("doc_id", "lang").collect()}
    got = QUERIES["op13_language_id"](spark, sf).collect()
    assert len(got) == len(truth)
    out = [r for r in got if r["held_out"]]
    assert 0.2 < len(out) / len(got) < 0.3 and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) >= 0.99 * len(out)


def test_language_never_sees_held_out_rows_or_labels(spark):
    import zlib

    docs = [(i, "aaa bbb", "x") if zlib.crc32(str(i).encode()) % 4 != 2 else (i, "ccc ddd", "z") for i in range(60)]
    docs += [(1000 + i, "eee fff", "y") for i in range(40) if zlib.crc32(str(1000 + i).encode()) % 4 != 2]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language.train(frame)
    assert set(model.labels) == {"x", "y"}
    got = {r["doc_id"]: r for r in language.identify(frame.drop("lang"), model).collect()}
    assert all(got[i]["lang_pred"] == label for i, _, label in docs if label != "z")


def test_language_edges(spark):
    base = [(i, t, lang) for i in range(40) for t, lang in (("the cat and the dog", "en"), ("der Hund und die Katze", "de"))]
    edges = [(None, "the dog", None), (None, "the dog", None), (1001, None, "en"), (1002, "", "de"), (1003, "123 !? ²", "en"), (1004, "日本", None), (1005, "der Hund " * 200_000, None), (1006, "q" * 300_000, None)]
    frame = spark.createDataFrame([(i, t, la, 1) for i, t, la in base + edges], "doc_id long, text string, lang string, score int")
    model = language.train(frame)
    rows = language.identify(frame.drop("lang"), model).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "lang_pred", "score"}
    named = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows if r["doc_id"] is None or r["doc_id"] > 1000}
    assert named[None][0] == "en" and named[1005][0] == "de" and [r["lang_pred"] for r in rows].count("en") >= 40
    assert named[1001] == named[1002] == named[1003] == ("und", 0.0)
    assert named[1004] == (model.labels[0], 0.0) and named[1006][0] in model.labels
    nothing = language.train(frame.where("false"))
    assert {r["lang_pred"] for r in language.identify(frame.drop("lang"), nothing).collect()} == {"und"}
    assert language.identify(frame.where("false"), model).count() == 0
