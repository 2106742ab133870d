"""The training-data operators against brute force on small fixtures, with nulls, ties, repeats, empty tables and clashing columns."""

import random
import string
import struct
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelore.llm import attention_lm as lm
from voxelore.llm import audio, exact_dedup, html_text, licenses, line_dedup, mixing, packing, simhash, toxicity
from voxelore.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, digest string"


def docs(spark, texts, first=0):
    rows = [(first + k, t, random.choice(["en", "fr", None]), f"src{k % 5}" if k % 7 else None, 0, "x", "y", "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (4, "a B"), (None, "a b"), (None, None), (7, long), (8, long.upper()), (9, "É a\n\n \x0b"), (10, "é a\n\n \x0b")]
    return spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in rows], SCHEMA)


def lowered(t):
    return (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


# 6


def groups(rows):
    want = {}
    for i, t in rows:
        want.setdefault(lowered(t), []).append(i)
    return sorted(((i, max((x for x in want[lowered(t)] if x is not None), default=None), len(want[lowered(t)]), sha256(lowered(t).encode()).hexdigest()) for i, t in rows), key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1)])
def test_exact_groups(spark, digest):
    random.seed(1)
    words = ["alpha", "Beta", "GAMMA", "É"]
    d = odd(spark).unionByName(docs(spark, [" ".join(random.choices(words, k=random.randint(0, 3))) for _ in range(150)], 100))
    rows = [(r.doc_id, r.text) for r in d.collect()]
    got = exact_dedup.exact_groups(d, digest=digest, micro_batches=3).collect()
    want = groups(rows)
    assert sorted(repr((r.id, r.keep_id, r.group_size)) for r in got) == sorted(repr(w[:3]) for w in want)
    assert all(r.kept == (r.id == r.keep_id) for r in got)
    if digest is exact_dedup.sha256:
        assert sorted(r.digest for r in got) == sorted(w[3] for w in want)


def test_exact_kept_rows_keep_one_of_repeated_rows(spark):
    got = exact_dedup.kept_rows(odd(spark))
    assert got.columns == odd(spark).columns
    assert sorted(repr(r.doc_id) for r in got.collect()) == sorted(map(repr, [2, 4, 8, 9, 10]))


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(odd(spark).where("false")).count() == 0


# 8


def line_brute(rows, min_chars=20, min_docs=3):
    blanks = " \t\n\x0b\x0c\r"
    key = lambda line: lowered(line.strip(blanks))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and max(y for y in holders[key(x)] if y is not None) != i)]
        out.append((i, len(lines), len(lines) - len(stay), sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(spark, batches):
    random.seed(2)
    pool = ["short", "", "A common line of twenty chars", " a COMMON line of twenty chars\r", "another line with enough characters É", "x" * 19, "y" * 20]
    d = odd(spark).unionByName(docs(spark, ["\n".join(random.choices(pool, k=random.randint(1, 6))) for _ in range(60)], 100))
    got = line_dedup.dedup_lines(d, batches=batches).select("doc_id", "n_lines", "n_dropped", exact_dedup.sha256(F.col("kept_text"))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == line_brute([(r.doc_id, r.text) for r in d.collect()])
    assert line_dedup.dedup_lines(d.where("false")).count() == 0


# 9


def fp_brute(text, words=4):
    w = lowered(text).encode().split()
    if not w:
        return 0
    s = [b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark):
    random.seed(3)
    base = [" ".join(random.choices(string.ascii_lowercase, k=40)) for _ in range(12)]
    texts = [None, "", " ", "one", "ONE", *base]
    for b in base:
        w = b.split()
        texts += [" ".join([*w, random.choice("xyz")]) for _ in range(6)]
    d = docs(spark, texts)
    got = {r.id: r for r in simhash.near_groups(d).collect()}
    fps = [fp_brute(t) for t in texts]
    assert [got[k].fp % 2**64 for k in range(len(texts))] == fps
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert [got[k].component_id for k in range(len(texts))] == [find(k) for k in range(len(texts))]
    assert simhash.near_groups(d.where("false")).count() == 0
    assert {r.doc_id for r in simhash.one_of_each(d).collect()} == {find(k) for k in range(len(texts))}


@pytest.mark.parametrize("limit", [1 << 21, 3000])
def test_ball_hashing_finds_just_the_pairs_within_the_radius(limit, monkeypatch):
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", limit)
    rng = np.random.default_rng(5)
    fps = [0, 2**64 - 1]
    for _ in range(12):
        x = int(rng.integers(0, 2**63))
        fps += [x] + [x ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in range(1, 7)]
    fps = np.unique(np.array(fps, np.uint64))
    masks, links = simhash._masks(10, 2), []
    prefixes = {}
    for f in fps:
        for m in masks:
            prefixes.setdefault(int(f >> np.uint64(54)) ^ int(m), []).append((f, 2 - int(m).bit_count()))
    for rows in prefixes.values():
        simhash._meet(np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), 54, links)
    met = {tuple(sorted(map(int, p))) for u, v in links for p in zip(u, v)}
    assert all((a ^ b).bit_count() <= 4 for a, b in met)
    want = [(int(a), int(b)) for a in fps for b in fps if a < b and (int(a) ^ int(b)).bit_count() <= 4]
    nodes, roots = simhash._forest(*(np.array(x, np.uint64) for x in zip(*sorted(met))))
    root = dict(zip(map(int, nodes), map(int, roots)))
    assert want and all(root[a] == root[b] for a, b in want)


def test_components_of_a_chain_a_star_and_a_cycle(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200, 202: 200}


# 4


def library_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0　'sdlé1.,<|>"), st.characters(codec="utf-8")), max_size=60))
def test_ids_are_those_of_the_library(text):
    text = text.replace("<|", "<|endoftext|>")
    assert np.frombuffer(packing.ids_of(packing.vocabulary_path())(text), "<u4").tolist() == library_ids(text)


def test_packing_is_gapless_and_whole(spark):
    random.seed(6)
    texts = [" ".join(random.choices(["lorem", "ipsum", "dolor"], k=random.choice([0, 3, 50, 400, 1022, 1023, 1024, 3000]))) for _ in range(60)]
    d = odd(spark).unionByName(docs(spark, texts, 100))
    got = packing.pack(d, packer_pieces=20).collect()
    seqs, by_doc = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for k, t in enumerate(texts):
        ids = np.array(library_ids(t) + [2], "<u4")
        parts = sorted(by_doc[100 + k])
        assert [p[0] for p in parts] == list(range(-(-len(ids) // 1024))) and sum(p[2] for p in parts) == len(ids)
        assert all(p[3] == zlib.crc32(ids[p[1] : p[1] + p[2]].tobytes()) and (p[2] == 1024 or p[0] == 0) for p in parts)
    assert len(by_doc[None]) == 2 and packing.pack(d.where("false")).count() == 0
    assert len(seqs) <= 1.1 * sum(r.length for r in got) / 1024 + 3


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    b = packing.BestFit(10, 2)
    assert [b.put(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    c = packing.BestFit(10, 2)
    assert [c.put(n)[0] for n in (6, 7, 8, 4)] == [0, 1, 2, 0]  # 8 closes bin 1, the fullest


# 1


def test_toxicity_learns_words_and_pairs(spark):
    random.seed(7)
    plain = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(900):
        w, bad = random.choices(plain, k=12), k % 3 == 0
        if bad:
            w[4:6] = ["nitwit", "folk"] if k % 2 else ["scoundrel", "x"]
        elif k % 2:
            w[4] = "nitwit" if k % 5 else "folk"
        rows.append((k, " ".join(w), int(bad)))
    d = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").unionByName(spark.createDataFrame([(None, None), (5000, "")], "doc_id long, text string"))
    lab = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(d, toxicity.train(d, lab)).collect()}
    held = [(k, y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == y for k, y in held]) > 0.97
    assert 0 <= got[None] == got[5000] <= 1
    none = toxicity.train(d, lab.where("false"))
    assert {r.score for r in toxicity.score(d, none).collect()} < {0.0, 1e-26} | {r.score for r in toxicity.score(d, none).collect()} and toxicity.clean_rows(d, none).count() == d.count()
    assert toxicity.clean_rows(odd(spark), none).columns == odd(spark).columns


# 5


def test_audio_round_trip(spark):
    d = odd(spark).unionByName(docs(spark, ["abc", "abc", "d" * 192, "e" * 193], 100))
    got = audio.audio_features(d).collect()
    texts = Counter((r.doc_id, r.text) for r in d.collect())
    for r in got:
        payload = audio.from_wav(r.media)
        text = next(t for i, t in texts if i == r.doc_id and (t or "").encode() == payload[: r.n_bytes])
        assert len(payload) % 192 == 0 and payload[r.n_bytes :] == b" " * (len(payload) - r.n_bytes) and len(payload) >= 192
        assert r.payload_sha256 == sha256(payload).hexdigest() and r.media_sha256 == sha256(r.media).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:]), text
        tensor = pa.ipc.open_stream(r.log_mel_ipc).read_all()
        assert tensor.schema.field("log_mel").type.shape == [audio.PATCH, audio.MELS] and tensor["end_s"][-1].as_py() > 0
    assert len({r.feature for r in got if r.doc_id in (100, 101)}) == 1
    assert audio.audio_features(d.where("false")).count() == 0


def test_resampling_keeps_a_tone():
    x = np.sin(2 * np.pi * 440 * np.arange(24_000) / 24_000).astype(np.float32)
    y = audio.resample(x)
    assert len(y) == 16_000
    spectrum = np.abs(np.fft.rfft(y))
    assert spectrum.argmax() == 440 and spectrum[440] / 8000 == pytest.approx(1, abs=0.05)


def test_hysteresis_segments():
    e = np.array([0, 0, 9, 5, 5, 0, 5, 9, 0], float) - 4
    spans = audio.segments(np.where(e > 3, 20, np.where(e > 0, e.mean(), -20)))
    assert len(spans) == 2 and struct.calcsize("f") == 4


# 3


@pytest.mark.parametrize(
    "markup, text",
    [
        (None, ""), ("", ""), ("a &lt;b&gt; <b>c</b>", "a <b> c"), ("<p>a<p>b", "a\n\nb"), ("<ul><li>x<li>y</ul>", "- x\n- y"), ("<ol start=3><li>x<li>y", "3. x\n4. y"),
        ("<ul><li>a<ul><li>b</ul></ul>", "- a\n  - b"), ("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>", "aa  b\nc   dd"), ("<script>x</script><style>p{}</style>y<template>z</template>", "y"),
        ("<p hidden>a</p><p style='display:none'>b</p><p>c", "c"), ("<div style='visibility:hidden'>a<i style='visibility:visible'>b</i></div>", "b"), ("<style>.x{display:none}</style><p class='y x'>a</p>b", "b"),
        ("a<br>b", "a\nb"), ("<pre>a  b\n c</pre>", "a  b\n c"), ("<!-- x -->a<!doctype html>b", "ab"), ("</p></div>a</table>", "a"), ("a < b", "a < b"), ("<div>" * 5000 + "deep", "deep"),
        ("<title>t</title><h1>H</h1>x", "H\n\nx"), ("<details><summary>s</summary>no</details>", "s"), ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ],
)
def test_html(markup, text):
    assert html_text.visible_text(markup) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abpliutdrh =\"'&;!-\n", max_size=80))
def test_html_never_fails(markup):
    html_text.visible_text(markup)


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (None, None, None)], "page_id long, url string, html string")
    assert {(r.page_id, r.text) for r in html_text.page_texts(pages).collect()} == {(1, "a"), (None, "")}
    assert html_text.page_texts(pages.where("false")).count() == 0


# 2


def test_mixing_fills_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 100), ("b", "x", 1000)], "l1 string, l2 string, tokens long")
    got = {(r.l1, r.l2): r.budget for r in mixing.budgets(leaves, ["l1", "l2"], 120.0, {}, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 50, ("b", "x"): 60}  # y makes up for x, b is left alone
    got = {(r.l1, r.l2): r.budget for r in mixing.budgets(leaves, ["l1", "l2"], 400.0, {"l1": {"b": 0.0}}, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 0}
    got = {(r.l1, r.l2): r.budget for r in mixing.budgets(leaves, ["l1", "l2"], 400.0, {}, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 290}  # a as a whole is short, so b takes the rest


def test_mixing_rows(spark):
    random.seed(8)
    d = odd(spark).unionByName(docs(spark, [" ".join(["w"] * random.randint(0, 30)) for _ in range(200)], 100))
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    got = mixing.select_mix(d, levels).collect()
    for key in {(r.lang, r.source) for r in got}:
        own = [r for r in got if (r.lang, r.source) == key]
        assert sum(r.n_tokens for r in own) <= own[0].budget
    rows = mixing.mixed_rows(d, levels)
    assert rows.columns == d.columns and rows.count() >= len(got) - 4
    assert mixing.select_mix(d.where("false"), levels).count() == 0 and mixing.mixed_rows(d.where("false"), levels).count() == 0


# 10


def test_licences(spark):
    texts = ["Some words here.\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "The license plate of the red car was lost in the snow.", None, "", "\n\n"]
    d = odd(spark).unionByName(docs(spark, texts, 100))
    got = {(r.doc_id, r.paragraph): r for r in licenses.scan(d, licenses.train(spark, d)).collect()}
    assert {k: r.family for k, r in got.items() if r.confirmed} == {(100, 1): "MIT", (101, 0): "CC-BY-NC", (102, 0): "GPL"}


# 7


def test_lm_base_scores_and_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT_WORDS", 5)
    random.seed(9)
    texts = [" ".join(random.choices(["the", "of", "Grove", "lamp", "é", "x1"] + [f"rare{k}"], k=random.randint(0, 30))) for k in range(120)]
    d = odd(spark).unionByName(docs(spark, texts, 100))
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in d.collect()]
    train = Counter(w for i, ws in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10 for w in ws)
    n, v = sum(train.values()), len(train)
    want = sorted(((i, len(ws), sum(w in train for w in ws), n, round(sum(np.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in rows), key=repr)
    got = lm.lm_scores(d).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    assert all(r.score < 0 for r in got)
