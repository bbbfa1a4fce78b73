"""The ten operators on small tables with awkward rows, against brute force where there is one."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import canonical
from gatewise.llm import decontaminate, embeddings, hmm, language, licenses, lines, mixing, ngram_join, toxicity, urls
from gatewise.llm.common import components, remainder
from gatewise.sources.standins import BASE_TABLES

FOLDER = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LONG = " ".join(WORDS * 9000)  # over a megabyte
# extra columns carry names that the operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, cid long, `_gone` int, learn int, shape string, size int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 1, 2, 3, 4, "x", 5) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    base = " ".join(WORDS)
    rows = [(1, base, "a"), (1, base, "a"), (2, base + " end", "b"), (3, None, None), (4, "", "a"), (5, " \t\n ", None), (None, base, "c"), (6, LONG, "a"), (7, LONG + " tail", "b"), (8, "one", "a"), (9, "ONE", "b"), (10, "x y z", None)]
    return docs(spark, rows)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 180)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 180)}}


def test_ngram_join_on_awkward_rows(awkward):
    got = sorted(map(tuple, ngram_join.ngram_components(awkward).collect()), key=str)
    by_id = {r[0]: r for r in got}
    assert len(got) == 12
    assert by_id[1][1:] == (20, 1) and by_id[2][1:] == (21, 1) and by_id[None][1:] == (20, None)
    assert by_id[3][1:] == (0, 3) and by_id[4][1:] == (0, 4) and by_id[5][1:] == (0, 5)
    assert by_id[6][1:] == (24, 1) and by_id[7][2] == 1  # the long text repeats the words, so it holds 20 of 24 shingles
    assert by_id[8][1:] == (1, 8) and by_id[9][1:] == (1, 8) and by_id[10][1:] == (1, 10)


def test_ngram_join_ties_one_id_with_two_texts(spark):
    a, b = " ".join(WORDS), " ".join(reversed(WORDS))
    got = dict(ngram_join.ngram_components(docs(spark, [(5, a, ""), (5, b, ""), (7, a + " z", ""), (3, b + " z", ""), (9, "other words are in this one", "")])).select("doc_id", "component_id").collect())
    assert got == {5: 3, 7: 3, 3: 3, 9: 9}


def test_ngram_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)  # many blocks
    rng = np.random.default_rng(2)
    texts = []
    for _ in range(12):
        base = list(rng.choice(WORDS, rng.integers(6, 90)))
        for _ in range(12):
            t = base.copy()
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(len(t))] = str(rng.choice(WORDS))
            texts.append(" ".join(t))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    comp = list(range(len(sets)))
    for _ in sets:
        for i in range(len(sets)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs(spark, [(k, t, "") for k, t in enumerate(texts)])).collect()}
    assert got == {k: (len(s), c) for k, (s, c) in enumerate(zip(sets, comp))}


def test_lines_keep_the_first_and_all_rows(spark, awkward):
    rows = [(k, f"own line {k}\n  shared line \n\ntail {k}", f"s{k}") for k in range(1, 6)] + [(6, "shared line", "s6"), (7, None, "s7"), (None, "shared line", "s8"), (8, "pair", "s1"), (9, "pair", "s2")]
    got = {r["doc_id"]: (r["text"], r["_n_lines"], r["_n_removed"]) for r in lines.dedup_lines(docs(spark, rows)).drop("n_chars").collect()}
    assert got[1] == ("own line 1\n  shared line \n\ntail 1", 4, 0) and got[2] == ("own line 2\n\ntail 2", 4, 1)
    assert got[6] == ("", 1, 1) and got[7] == (None, 0, 0) and got[None] == ("shared line", 1, 0) and got[9] == ("pair", 1, 0)
    assert lines.dedup_lines(awkward).count() == 12


def test_pipeline_takes_out_passages_of_two_sites(spark):
    import corpus_pipeline
    passage, inside = " ".join(WORDS * 3), " ".join(WORDS[::-1] * 3)
    rows = [(1, f"own 1\n{passage}", "a"), (2, f"own 2\n{passage}", "b"), (3, f"own 3\n{inside}", "a"), (4, f"own 4\n{inside}", "a"), (5, passage, None), (None, passage, "c")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_boilerplate_lines(spark, docs(spark, rows), FOLDER).collect()}
    assert got == {1: f"own 1\n{passage}", 2: "own 2", 3: f"own 3\n{inside}", 4: f"own 4\n{inside}", 5: "", None: passage}
    two, one = docs(spark, [(1, "x", ""), (2, "x", "a")]), docs(spark, [(1, "x", ""), (2, "x", None)])  # NULL and empty are one site
    assert lines.boilerplate(two, 2).count() == 1 and lines.boilerplate(one, 2).count() == 0


def test_sketches_agree_with_exact_counts_far_from_the_threshold(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("line "), (F.col("id") % 3).cast("string")).alias("text"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    assert lines.boilerplate(df, 1000).count() == 3 and lines.boilerplate(df, 1334).count() == 1 and lines.boilerplate(df, 1335).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10, None: 30}, {"a": 1, "b": 500, "c": 2}, {"a": 0}, {}])
def test_mix_meets_capped_targets(spark, sizes):
    rows = [(f"{s}", k, s) for s, n in sizes.items() for k in range(n)]
    df = docs(spark, [(i, " ".join(WORDS[: 1 + i % 5]), s) for i, (_, _, s) in enumerate(rows)] + [(10_000 + k, None, s) for k, s in enumerate(sizes)])
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) + len(sizes) and sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(7)).collect()))
    total = sum(r["size"] for r in got)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert all(r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5
    assert not total or abs(sum({r["source"]: r["target"] for r in got}.values()) - total) < 1e-6


def test_licence_places(spark):
    rows = [(1, "CC-BY and cc by; All  Rights\nReserved.", ""), (2, None, ""), (3, "", ""), (4, "général public license general PUBLIC license", ""), (5, "Licensed under the Apache License, Version 2.0.", ""), (None, "rights reserved all", ""), (6, "cc by " * 5000, "")]
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got[1] == (8, 3, 0, 5, "cc-by,reserved", "cc-by,reserved", 1.0)
    assert got[2] == got[3] == (0, 0, None, None, "", "", 0.0)
    assert got[4][:5] == (6, 1, 3, 3, "gpl") and got[5][4:6] == ("", "apache-2.0") and got[None][1] == 0
    assert got[6][:4] == (10_000, 5000, 0, 9998)


def test_url_rules_and_templates(spark):
    rows = [(1, "http://A.example.NET/en/1?x"), (2, "http://example.net/de/1"), (3, "https://b.example.com/de/9#t"), (4, "http://org/fr/"), (5, None), (6, "no scheme"), (7, "http://x.net"), (8, "http://c.example.com/en/2"), (None, "http://sub.org/fr/a")]
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("shape", F.lit(1))).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[2] == ("example.net", "/de/1", "net/", "block")
    assert got[3] == ("b.example.com", "/de/9", "example.com/de/", "block") and got[4] == ("org", "/fr/", "org/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7] == ("x.net", "", None, "allow")
    assert got[8][2:] == (None, "allow") and got[None][2] == "org/fr/"


def test_a_template_of_bad_urls_is_rejected(spark):
    rules = (("block", "h.com", "/bad/a"), ("allow", "h.com", "/good/"))
    rows = [(k, f"http://h.com/bad/a{k}-{k}-x-y") for k in range(60)] + [(100 + k, f"http://h.com/good/{k}") for k in range(60)] + [(300, "http://h.com/bad/b7-8-x-y"), (301, "http://h.com/other/1")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[300] == "block" and got[301] == "allow" and got[100] == "allow"


def test_unlabelled_branches_get_evidence_from_like_and_upper_nodes(spark):
    rules = (("block", "h.com", "/bad/"), ("allow", "h.com", "/good/"), ("block", "k.com", "/x/a"), ("allow", "k.com", "/y/"))
    rows = [(k, f"http://h.com/{a}/{b}/{k}{'.html' * (k % 3 == 0)}") for a, b, n in (("bad", "p", 90), ("twin", "q", 90), ("good", "info", 90)) for k in range(n)]
    rows = [(k, u) for k, (_, u) in enumerate(rows)]
    rows = [(k, u.replace("/p/", f"/p{'ab'[k % 2]}/").replace("/q/", f"/q{'ab'[k % 2]}/")) for k, u in rows]  # alike only once the level below has merged
    rows += [(1000 + k, f"http://k.com/x/a{'abcd'[k % 4]}/{k}") for k in range(200)] + [(2000, "http://k.com/x/other"), (2001, "http://k.com/y/other"), (2002, "http://k.com/z")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert all(got[k] == (None, "block") for k in range(90, 180)) and all(got[k][1] == "allow" for k in range(180, 270))
    assert got[2000] == (None, "block") and got[2001][1] == "allow"
    torn = [(k, f"http://h.com/{('bad', 'good', 'both')[k % 3]}/{k}") for k in range(180)]  # like a bad branch and a good one
    assert {r["verdict"] for r in urls.judge_urls(spark.createDataFrame(torn, "page_id long, url string"), rules).where("page_id % 3 = 2").collect()} == {"allow"}


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((25, 16))
    x = [c + rng.standard_normal(16) * s for c in centres for s in rng.uniform(0, 0.35, 8)] + [centres[0], centres[0] * 3]
    rows = [(k, [float(v) for v in np.float32(v)], k % 2) for k, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0] * 16, None), (905, [], 1), (906, [1.0, 2.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = np.array([np.float32(v) for v in x], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    for _ in x:
        comp = np.minimum(comp, np.where(link, comp, 10**6).min(axis=1))
    assert {k: got[k] for k in range(len(x))} == {k: (int(link[k].sum()), int(comp[k]), bool(comp[k] == k)) for k in range(len(x))}
    assert all(got[k] == (0, k, True) for k in range(900, 907))


def test_leaks_within_the_edit_budget(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew strong coffee at dawn beside the old stone bridge near town"
    typo = item.replace("wizards", "wizzards").replace("stone", "stne").upper()
    broken = "".join(c if k % 5 else "#" for k, c in enumerate(item))
    rows = [(1, f"pre text {item} post", ""), (2, f"x {typo}", ""), (3, broken, ""), (4, None, ""), (5, "", ""), (6, LONG + " " + item, ""), (7, item[:20], ""), (None, item, "")]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short"), (4, "")], "item_id long, text string")
    got = decontaminate.find_leaks(docs(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 1), (6, 1), (None, 1)}
    assert [r["edits"] for r in got if r["doc_id"] == 1] == [0]
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs(spark, rows), bench).collect()} == {3, 4, 5, 7}
    assert decontaminate.drop_contaminated(docs(spark, rows), bench.limit(0)).count() == 8


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(5)
    for _ in range(60):
        window = bytes(rng.integers(97, 100, 30).tolist())
        region = bytearray(window)
        for _ in range(rng.integers(0, 4)):
            region[rng.integers(len(region))] = 98
        data = bytes(rng.integers(97, 100, 20).tolist()) + bytes(region) + bytes(rng.integers(97, 100, 20).tolist())
        row = [0] * (len(data) + 1)
        for c in window:
            new = [row[0] + 1]
            for j, d in enumerate(data):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
            row = new
        assert decontaminate.align(window, data, 0, len(data), 4)[0] == min(row)


def test_language_of_awkward_texts(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)] + [(50, None, "en"), (51, "", None), (52, "123 !!", "de"), (None, "und der hund", "de"), (53, LONG, None), (54, "THE DOG", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("gram", F.lit(1))
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify_languages(df, F.col("doc_id") < 50).collect()}
    assert got[50] == got[51] == got[52] == "und" and got[None] == "de" and got[54] == "en" and got[53] in ("en", "de") and len(got) == 16
    assert {r["lang_pred"] for r in language.identify_languages(df, F.lit(False)).collect()} == {"und"}


def test_hmm_base_and_likelihood(spark, awkward):
    got = hmm.score_texts(awkward, remainder(F.col("doc_id"), 7) != 2, vocabulary=10, broadcast_words=15).collect()
    texts = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b"\n"]) for r in awkward.collect()]
    counts = Counter(w for i, t in texts if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 4)) for i, t in texts)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert hmm.score_texts(awkward.limit(0), F.lit(True)).count() == 0 and all(r["n_known"] == 0 for r in hmm.score_texts(awkward, F.lit(False)).collect())


def test_hmm_learns_emissions_of_every_word_whatever_is_broadcast(spark):
    rng = np.random.default_rng(8)
    topics = [[f"{t}{k}" for k in range(40)] for t in "ab"]
    texts = [(i, " ".join(rng.choice(topics[i % 2], 30)), "") for i in range(60)]
    df = docs(spark, texts)
    kinds = [(1, 1), (7, 3), (1000, 1000)]
    got = [{r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in hmm.score_texts(df, F.col("doc_id") < 50, vocabulary=v, broadcast_words=b, states=2).collect()} for v, b in kinds]
    for other in got[1:]:
        assert all(np.allclose(other[i], got[0][i], rtol=1e-4) for i in got[0])
    single = hmm.score_texts(df, F.col("doc_id") < 50, vocabulary=1, broadcast_words=1, states=1).collect()
    assert all(math.isclose(r["score"], r["base_score"], rel_tol=1e-6) for r in single)
    assert sum(got[0][i][2] - got[0][i][1] for i in range(50, 60)) > 5  # no word is among the leading ones, yet the states know its topic


def test_hmm_keeps_no_row_per_text_and_word(spark, monkeypatch):
    rows, stage = [], hmm.staged
    monkeypatch.setattr(hmm, "staged", lambda df: (out := stage(df), rows.append(out.count()))[0])
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    held = lambda: {f.getName() for f in map(env.blockManager().diskBlockManager().getAllFiles().apply, range(env.blockManager().diskBlockManager().getAllFiles().size()))}
    rng = np.random.default_rng(9)
    df, was, setting = docs(spark, [(i, " ".join(f"w{k}" for k in rng.choice(80, 30)), "") for i in range(200)]), held(), spark.conf.get(hmm.CLEANUP)
    scored = hmm.score_texts(df, F.col("doc_id") < 150, vocabulary=1, broadcast_words=1, states=2)
    assert max(rows) <= 200  # some 5,000 pairs of a text and a word, all of words that are not broadcast
    assert not {name for name in held() - was if name.startswith("shuffle")} and spark.conf.get(hmm.CLEANUP) == setting
    assert scored.count() == 200


def test_hmm_blocks_and_shards_change_no_score(spark, awkward, monkeypatch):
    rng = np.random.default_rng(10)
    odd = [(None, "aa bb", ""), (900, None, ""), (901, "", ""), (902, "new" + chr(0x1C) + "er words" + chr(0xA0) + "here \x0b\x0c\r\n", ""), (903, "AA \u00c4\u00c4 \u00e4\u00e4", "")]
    df = docs(spark, [(i, " ".join(f"{'ab'[i % 2]}{k}" for k in rng.choice(60, 40)), "") for i in range(80)] + odd + odd[:2]).union(awkward)

    def scores():
        return sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), r["score"]) for r in hmm.score_texts(df, F.coalesce(F.col("doc_id") % 3 > 0, F.lit(True)), vocabulary=4, broadcast_words=4).collect())
    want = scores()
    assert len(want) == 99 and sum(r[2] < r[1] for r in want) > 0
    for name, value in (("BLOCK", 700), ("SHARD", 11), ("PIECE", 3)):
        monkeypatch.setattr(hmm, name, value)
    got = scores()
    assert [r[:4] for r in got] == [r[:4] for r in want] and np.allclose([r[4] for r in got], [r[4] for r in want], rtol=1e-6)


def test_hmm_hands_over_small_batches_and_shards(spark, monkeypatch):
    rng = np.random.default_rng(12)
    df = docs(spark, [(i, " ".join(f"w{k}" for k in rng.choice(90, 40)), "") for i in range(120)]).repartition(3)
    was = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")

    def scores():
        kept, stage = [], hmm.staged
        with monkeypatch.context() as m:
            m.setattr(hmm, "staged", lambda frame: (out := stage(frame), kept.append((spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), out.select("sizes").collect() if "sizes" in out.columns else [])))[0])
            got = sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6), r["score"]) for r in hmm.score_texts(df, F.col("doc_id") < 100, vocabulary=1, broadcast_words=1, states=2).collect())
        return got, kept
    want, _ = scores()
    for name, value in (("BLOCK", 900), ("MENTIONS", 400), ("BATCH_BYTES", 600)):
        monkeypatch.setattr(hmm, name, value, raising=False)
    got, kept = scores()
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-6)
    asked = [sum(r["sizes"]) for r in kept[2][1]]
    assert len(asked) > 5 and max(asked) < sum(asked) / 3  # few different words, yet no shard has what all blocks ask
    assert {size for size, _ in kept} == {"600"} and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == was


def test_hmm_batches_follow_bytes_not_rows(monkeypatch):
    def rows(texts):
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    texts = ["a" * n for n in (300, 400, 0, 20, 3000, 100, 700, 100, 100)]
    for came in ([rows(texts)], [rows([t]) for t in texts], [rows(texts[:4]), rows([]), rows([None]), rows(texts[4:])]):
        out = [b.column(0).to_pylist() for b in hmm._slices(iter(came), 0, 1100)]
        assert [t for b in out for t in b if t is not None] == texts and all(len(b) == 1 or sum(len(t or "") + hmm.ROW for t in b) <= 1100 for b in out) and len(out) == 4
    assert max(b.num_rows for b in hmm._slices(iter([rows([""] * 500)]), 0, 640)) == 10  # texts without words fill a block too
    index, states = np.arange(60, dtype=np.int32), 2
    shard = hmm._shard(5, np.arange(122, dtype=np.float32).tobytes(), list(range(20)), [3] * 20, hmm._packed(index), np.arange(61, dtype=np.int64).tobytes())
    monkeypatch.setattr(hmm, "BATCH_BYTES", 100)
    sent = list(hmm._send(states, True)(iter([shard])))
    assert max(sum(map(len, b.column("counts").to_pylist())) for b in sent) <= 100 and [k for b in sent for k in b.column("block").to_pylist()] == list(range(20))
    assert np.frombuffer(b"".join(c for b in sent for c in b.column("counts").to_pylist()), np.float32).tolist() == list(range(120))


def test_hmm_words_are_cut_at_six_bytes_only():
    text = "".join(f"A{chr(c)}z" for c in [*range(1, 0x300), 0x1680, 0x2003, 0x2028, 0x3000, 0x1F600])
    words, sizes = hmm._words(pa.array([text, None, "", " x "]))
    want = text.encode().lower().split() + [b"x"]
    assert words.cast(pa.binary()).to_pylist() == want and sizes.tolist() == [len(want) - 1, 0, 0, 1]
    numbers = np.random.default_rng(11).integers(0, 1 << 20, 1000).astype(np.int32)
    assert (hmm._unpacked(hmm._packed(numbers), len(numbers)) == numbers).all() and len(hmm._unpacked(hmm._packed(numbers[:0]), 0)) == 0


def test_hmm_recursions_equal_all_paths():
    rng = np.random.default_rng(6)
    start, move, emit = rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 5, 3)
    seqs = [rng.integers(0, 5, n).astype(np.int32) for n in (4, 1, 6)]

    def total(s):
        a = start * emit[:, s[0]]
        for c in s[1:]:
            a = (a @ move) * emit[:, c]
        return a.sum()
    assert np.allclose(hmm.forward(seqs, start, move, emit), [math.log(total(s)) for s in seqs])
    starts, moves, emissions = hmm.expected_counts(seqs, start, move, emit)
    assert math.isclose(starts.sum(), 3) and math.isclose(moves.sum(), 3 + 0 + 5) and math.isclose(emissions.sum(), 11)
    eps = 1e-6  # the counts are the gradient of the log likelihood
    bumped = emit.copy()
    bumped[1, 2] *= 1 + eps
    assert math.isclose((sum(hmm.forward(seqs, start, move, bumped)) - sum(hmm.forward(seqs, start, move, emit))) / eps, emissions[1, 2], rel_tol=1e-3, abs_tol=1e-6)


def test_toxicity_without_and_with_labels(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r[toxicity.SCORE_COLUMN] for r in toxicity.score_toxicity(awkward, none, F.lit(True)).collect()} == {0.0}
    rows = [(k, " ".join(WORDS) + (" idiot scum" if k % 4 == 0 else ""), "") for k in range(200)] + [(500, "you ID10T, sc.um idiot!!", ""), (501, None, ""), (502, "", ""), (None, "fine words", "")]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r[toxicity.SCORE_COLUMN] for r in toxicity.score_toxicity(docs(spark, rows), labels, F.lit(True)).collect()}
    assert len(got) == 204 and got[0] > 0.9 and got[1] < 0.1 and got[500] > 0.5 and all(0 <= s <= 1 for s in got.values())


def test_queries_equal_duckdb(spark):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    for name in ("op2_line_dedup", "op5_mix_sources"):
        got, want = entry.queries()[name](spark, FOLDER).toPandas(), con.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id", "left").collect()}
    langs = [r for r in entry.queries()["op7_language_id"](spark, folder).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in langs]) > 0.95
    toxic = [(r["predicted"], truth[r["doc_id"]]["toxic"]) for r in entry.queries()["op8_toxicity"](spark, folder).collect() if r["held_out"] and truth[r["doc_id"]]["toxic"] is not None]
    assert np.mean([p == y for p, y in toxic]) > 0.9


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = frame.columns, frame.count()
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.staged(stage(spark, frame, FOLDER))
        assert name == "mixing" or frame.columns == columns
        assert 0 < frame.count() <= seen
        seen = frame.count()
    assert {"doc_id", "copies", "taken"} <= set(frame.columns)


def test_pipeline_keeps_unlike_texts_of_one_id(spark):
    import corpus_pipeline
    base = " ".join(WORDS)
    rows = [(5, "short text", "a"), (5, "the longer text of this id", "b"), (5, "the longer text of this ie", "a"), (6, base, "b"), (None, "no id", "a"), (None, "no id either", "a"),
            (4, base + " end", "c"), (9, "short text", "b"), (None, "no id", "b")]
    stay = [0, 1, 2, 4, 5, 6]
    for parts in (1, 7):
        kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs(spark, rows).repartition(parts), FOLDER)
        assert kept.columns == docs(spark, rows).columns
        assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted((str(rows[k][0]), rows[k][1]) for k in stay)
    mixed = corpus_pipeline.mix(spark, kept, FOLDER)
    want = Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in mixing.mix_sources(kept).where("copies > 0").collect())
    assert Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in mixed.collect()) == want and want
    assert all(len(r["text"].split()) == r["size"] and r["taken"] == r["copies"] * r["size"] for r in mixed.collect())
    assert set(kept.columns) <= set(mixed.columns)


def test_clashing_columns_and_empty_tables(spark, awkward):
    """Columns named like the operators' own stay as they are, and tables without rows give none."""
    import corpus_pipeline
    rows = [(k, " ".join(WORDS) + (" idiot scum" if k % 3 == 0 else "") + f"\nline {k % 2}", "ab"[k % 2]) for k in range(30)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(30)] + [(0, 0)], "doc_id long, toxic int")
    frame = docs(spark, rows + rows[:3])
    extra = ["_n_removed", "_n_lines", "_toxicity_features", "t_features", "_t_f", "_row", "learn", "label"]
    frame = frame.select(*[c for c in frame.columns if c not in extra], *(F.lit(i).alias(c) for i, c in enumerate(extra)))
    cleaned = corpus_pipeline.drop_boilerplate_lines(spark, frame, FOLDER)
    assert cleaned.columns == frame.columns and {r["_n_removed"] for r in cleaned.collect()} == {0}
    scored = toxicity.score_toxicity(frame, labels, F.lit(True))
    assert scored.columns == [*frame.columns, toxicity.SCORE_COLUMN] and scored.count() == 33
    assert toxicity.score_toxicity(scored, labels, F.lit(True)).columns == scored.columns  # an own column gives way
    assert corpus_pipeline.keep_one_of_near_duplicates(spark, frame, FOLDER).columns == frame.columns
    none = frame.limit(0)
    for got in (toxicity.score_toxicity(none, labels, F.lit(True)), lines.dedup_lines(none, counts=("x", "y")), ngram_join.ngram_components(none), ngram_join.keep_first_of_groups(none),
                language.identify_languages(none, F.lit(True)), licenses.scan_licenses(none), hmm.score_texts(none, F.lit(True))):
        assert got.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet").limit(0)
    assert urls.judge_urls(pages).count() == 0 and embeddings.near_duplicates(vectors).count() == 0


def test_rare_toxic_labels_are_learned(spark):
    """Two in a hundred labels are toxic: the sample keeps all of them, and calibration has them in every fold."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(rng.choice(WORDS, 15)) + (" idiot scum" if k % 50 == 0 else ""), "") for k in range(1500)]
    labels = spark.createDataFrame([(k, int(k % 50 == 0)) for k in range(1500)], "doc_id long, toxic int")
    got = {r["doc_id"]: r[toxicity.SCORE_COLUMN] for r in toxicity.score_toxicity(docs(spark, rows), labels, F.lit(True), fit_rows=200).collect()}
    assert all(got[k] > 0.5 for k in range(0, 1500, 50)) and np.mean([got[k] < 0.3 for k in range(1500) if k % 50]) > 0.99


def test_ranks_of_sources_need_no_python_on_executors(spark):
    from gatewise.llm import mixing
    sizes = spark.createDataFrame([("b", 2), (None, 1), ("a", 3), ("", 4)], "source string, source_size long")
    out = mixing.ranked_sources(sizes)
    assert {r["source"]: r["rank"] for r in out.collect()} == {"": 0, "a": 1, "b": 2, None: 3}
    assert mixing.ranked_sources(sizes.limit(0)).count() == 0
    assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()
