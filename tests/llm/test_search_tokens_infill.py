"""Operators 11 to 13 against plain versions of what they compute."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gatewise.llm import bpe, infill, lexical

TEXTS = [None, "", " ", "\n\t ", "one", "  one two", "one two  ", "Ünï çödé the THE The", "a<P>b c", "a <M>", "x < P > y <S", "the cat sat on the mat", "the cat sat on the mat", "mat the sat cat on the",
         "Ab1 ab1 AB1 zz", "日本語 テキスト 🙂 🙂🙂", "word " * 3000, "w" * 5000, "\x1c\x1d x y z \r\n", "it's we'll THEY'RE 12345 67 --- ...!!", "a  b   c    d\n\n\ne"]


def documents(spark, texts=TEXTS):
    rows = [(i if i % 7 else None, t, "clash", 1.0) for i, t in enumerate(texts)] + [(3, "the cat", "clash", 2.0), (3, "the cat", "clash", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, place string, bag double")


def brute_ranks(docs, items, k):
    find = lambda t: re.findall(lexical.TERM, (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    bags = [(d, find(t)) for d, t in docs]
    bags = [(d, len(w), Counter(w)) for d, w in bags if w]
    if not bags:
        return []
    total, df = sum(n for _, n, _ in bags), Counter(w for _, _, c in bags for w in c)
    terms, out = {}, []
    for item, text in items:
        terms.setdefault(item, set()).update(find(text))
    for item, words in terms.items():
        found = []
        for d, n, c in bags:
            m = 50 + 50 * n * len(bags) // total
            score = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in words if w in c)
            if score > 0:
                found.append((-score, math.inf if d is None else d, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: x[:2])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [(500_000, 2_000_000), (500_000, 0), (0, 0)])
def test_ranks_equal_brute_force_on_all_paths(spark, monkeypatch, limits):
    monkeypatch.setattr(lexical, "VOCABULARY_LIMIT", limits[0])
    monkeypatch.setattr(lexical, "POSTING_LIMIT", limits[1])
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["the", "cat"]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(150)] + ["the cat w1"] * 40
    docs = documents(spark, texts).repartition(5)
    items = [(1, "The CAT the"), (2, "w1 w2 w3"), (2, "w4"), (3, None), (4, "nowhere"), (None, "mat 日本語"), (5, "")]
    got = lexical.rank_documents(docs, spark.createDataFrame(items, "item_id long, text string"), 7)
    assert got.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_ranks([(r["doc_id"], r["text"]) for r in docs.collect()], items, 7)


def test_copies_are_scored_once(spark):
    docs = spark.createDataFrame([(i, "the cat and filler%d" % i) for i in range(100)], "doc_id long, text string")
    got = lexical.rank_documents(docs, spark.createDataFrame([(1, "cat")], "item_id long, text string"), 50).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == list(range(50)) and len({r["score"] for r in got}) == 1


def test_search_without_rows(spark):
    docs, items = documents(spark), spark.createDataFrame([(1, "cat")], "item_id long, text string")
    assert lexical.rank_documents(docs.limit(0), items).count() == 0
    assert lexical.rank_documents(docs, items.limit(0)).count() == 0
    assert lexical.rank_documents(documents(spark, ["", " "]).where("text = ''"), items).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return path, public_tokenizers.PATTERN, ranks, plain, bpe.Transducer(ranks)


def test_encoding_equals_the_library(spark, vocabulary):
    path, pattern, _, plain, _ = vocabulary
    docs = documents(spark)
    coded = bpe.decode_texts(bpe.encode_texts(docs, path, pattern), path).collect()
    assert len(coded) == docs.count()
    want = Counter((r["doc_id"], tuple(plain.encode_ordinary(r["text"] or "")), r["text"] or "") for r in docs.collect())
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in coded) == want
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = bpe.round_trip_digests(docs, path, pattern)
    assert Counter(map(tuple, digests.collect())) == Counter((d, len(ids), sha(",".join(map(str, ids))), sha(t)) for d, ids, t in want.elements())
    assert bpe.decode_texts(bpe.encode_texts(docs.limit(0), path, pattern), path).count() == 0


def test_transducer_equals_plain_merging(vocabulary):
    _, _, ranks, _, machine = vocabulary
    rng, tokens = random.Random(3), list(ranks)
    for _ in range(3000):
        letters = rng.choice([b"ab", b"aeinst", b" ", b"-=", "é日".encode(), bytes(range(256))])
        piece = bytes(rng.choice(letters) for _ in range(rng.randint(1, 40))) if rng.random() < 0.5 else b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 4)))
        assert [ranks[t] for t in bpe.merge(piece, ranks)] == list(machine.encode(piece))


def test_transducer_forgets_within_a_piece(vocabulary, monkeypatch):
    _, _, ranks, _, machine = vocabulary
    monkeypatch.setattr(bpe, "MAX_STATES", 40)
    rng = random.Random(4)
    for _ in range(20):
        piece = bytes(rng.choice(b"aeinstrl") for _ in range(300))
        assert [ranks[t] for t in bpe.merge(piece, ranks)] == list(machine.encode(piece))
        assert len(machine.states) <= 82


def test_tokens_come_with_bounded_delay(vocabulary):
    """A long piece is given out while it is read: what waits is never longer than two of the longest tokens."""
    _, _, ranks, _, machine = vocabulary
    machine.forget()
    machine.encode(b"abcdefghijklmnopqrstuvwxyz" * 400)
    longest = max(map(len, ranks))
    sizes = {rank: len(token) for token, rank in ranks.items()}
    assert max(sum(sizes[t] for t in waiting) for state in machine.states for _, waiting in state) <= 2 * longest


def test_whole_pieces_that_no_merges_reach():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"cd": 258, b"abcd": 259}  # bc comes first and joins nothing
    machine = bpe.Transducer(ranks)
    stuck = (ord("a"), 256, ord("d"))
    assert machine.encode(b"abcd") == (259,) and machine.encode(b"abcdx") == (*stuck, ord("x")) and machine.encode(b"xabcd") == (ord("x"), *stuck)


def test_decoding_is_streamed(vocabulary):
    _, _, ranks, plain, _ = vocabulary
    stream = bpe.TextStream({rank: token for token, rank in ranks.items()})
    rng = random.Random(9)
    for text in ["日本語🙂é", "plain", "🙂" * 50]:
        ids = plain.encode_ordinary(text)
        assert "".join(stream.feed([i]) for i in ids) + stream.finish() == text
    for _ in range(300):  # any bytes: what is not UTF-8 becomes U+FFFD, as in Python
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC3, 0xE0, 0xA0, 0xED, 0xF0, 0x90, 0xF4, 0xFF]) for _ in range(rng.randint(0, 12)))
        assert stream.feed([ranks[bytes([b])] for b in data]) + stream.finish() == data.decode("utf-8", "replace")


def brute_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    name = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(name[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return (doc_id, n, form, len(pre), len(mid), sha(out), sha(text))


@pytest.mark.parametrize("size", [1, 2, 5, 64, infill.FRAME])
def test_infill_equals_brute_force(spark, monkeypatch, size):
    rows = [(i, TEXTS[i % len(TEXTS)] if size > 2 or len(TEXTS[i % len(TEXTS)] or "") < 100 else "short one", "clash") for i in range(120)] + [(None, "a b c", "x"), (5, "one two", "x"), (5, "one two", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, data string")
    got = infill.fill_in_middle(infill.pack_texts(docs, size)).drop("data", "ends", "units", "chars")
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_infill(d, t) for d, t, _ in rows)
    assert {r["form"] for r in got.select("form").collect()} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(infill.pack_texts(docs.limit(0))).count() == 0


def test_frames_are_read_alone():
    text = ("ab é日 \n" * 40000).encode()
    frames = infill.pack([text[:7], text[7:100_001], text[100_001:]], 1000)
    assert len(frames.data) == -(-len(text) // 1000) and b"".join(infill.read(frames, 0, len(text))) == text
    assert b"".join(infill.read(frames, 990, 2010)) == text[990:2010] and len(list(infill.read(frames, 990, 2010))) == 3
    broken = frames._replace(data=[d if i in (4, 5) else b"" for i, d in enumerate(frames.data)])  # other frames are not touched
    assert b"".join(infill.read(broken, 4500, 5500)) == text[4500:5500]
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text.decode())
    for k in (0, 1, 2, 331, 332, 40000, len(units)):
        head = "".join(units[:k])
        assert infill.seek(frames, k) == (len(head.encode()), len(head))
    assert infill.find(infill.pack([b"x" * 998 + b"<P>" + b"y"], 1000), b"<P>") == 998
    assert infill.find(frames, b"<P>") == -1


def test_output_frames_hold_the_output(spark):
    docs = spark.createDataFrame([(i, f"one two three {i} " * 30) for i in range(40)], "doc_id long, text string")
    for r in infill.fill_in_middle(infill.pack_texts(docs, 50)).collect():
        output = infill.Frames(r["data"], r["ends"], r["units"], r["chars"])
        assert hashlib.sha256(b"".join(infill.read(output, 0, output.ends[-1]))).hexdigest() == r["output_sha256"]
