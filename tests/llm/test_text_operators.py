"""Encoding, licences, SimHash, toxicity, counts and shards against brute force and awkward rows."""

from __future__ import annotations

import random
import re
import textwrap

import numpy as np
import pytest
import xxhash

from corpusloom.llm import bytepair, counting, licences, shards, simhash, subwords, toxicity

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


# -- op2 ---------------------------------------------------------------------------------------------


def test_rate_zero_is_the_library(texts):
    import sentencepiece

    pieces = subwords.Pieces.of(subwords.public_path(subwords.MODEL))
    model = sentencepiece.SentencePieceProcessor(model_file=subwords.public_path(subwords.MODEL))
    odd = ["", " ", "   a  b ", "▁x▁", "a▁▁b", "\n\n\t a", "ab" * 100 + " é", "<s></s> <0x41>", "\u0000 x"]
    rows = odd + [t[1][:4000] for t in texts if t[1]]
    got = subwords.Encoder(pieces, 0.0).encode(rows, np.arange(len(rows)).astype(np.uint64))
    assert [g.tolist() for g in got] == model.encode(rows)


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0])
def test_arrays_and_heap_agree(rate):
    pieces, draw = subwords.Pieces.of(subwords.public_path(subwords.MODEL)), random.Random(1)
    words = ["▁" + "".join(draw.choice("aeinrstléß日") for _ in range(draw.randint(1, 30))) for _ in range(200)]
    keys = np.array([draw.getrandbits(64) for _ in words], np.uint64)
    sizes = np.array([len(w) for w in words])
    flat, long = subwords.segment(pieces, pieces.symbols("".join(words)), sizes, keys, rate)
    one = [subwords.agenda(pieces, pieces.symbols(w).tolist(), int(k), rate) for w, k in zip(words, keys, strict=True)]
    assert flat.tolist() == [s for w in one for s in w]
    assert long.tolist() == [len(w) for w in one]


def test_encoding_is_lossless_seeded_and_whole(docs, nothing, texts):
    from pyspark.sql import functions as F

    coded = subwords.encoded(docs, rate=0.3, seed=4)
    back = coded.select("doc_id", subwords.decoder()("ids").alias("t")).collect()
    want = sorted((str(r[0]), (r[1] or "").replace("▁", " ")) for r in texts)
    assert sorted((str(r.doc_id), r.t) for r in back) == want
    ids = lambda s: {(r.doc_id, tuple(r.ids)) for r in subwords.encoded(docs, rate=0.3, seed=s).collect()}
    assert ids(4) == {(r.doc_id, tuple(r.ids)) for r in coded.collect()} != ids(5)
    rows = subwords.digest(docs)
    assert rows.where(~F.col("lossless")).count() == 0 and rows.count() == len(texts)
    assert subwords.digest(nothing).count() == 0


def test_every_use_of_a_word_draws_for_itself():
    pieces = subwords.Pieces.of(subwords.public_path(subwords.MODEL))
    encoder, word = subwords.Encoder(pieces, 0.5), "internationalisation"
    text = " ".join([word] * 5000)
    found = encoder.encode([text, text, "x " + text], np.array([1, 2, 3], np.uint64))
    names = [pieces.text[i] for i in found[0].tolist()]
    uses = " ".join(names).replace(" ▁", "\n").split("\n")
    assert len(uses) == 5000 and len(set(uses)) > 500
    assert found[0].tolist() != found[1].tolist()
    # The same by one heap per use, keyed by document and place.
    keys = subwords.mix64(np.uint64(3) + np.arange(5001).astype(np.uint64) * subwords._GOLD)
    words = ["▁x"] + ["▁" + word] * 5000
    want = [i for w, k in zip(words, keys.tolist(), strict=True) for i in subwords.agenda(pieces, pieces.symbols(w).tolist(), k, 0.5)]
    assert found[2].tolist() == want


def test_copies_next_to_each_other_are_encoded_apart(spark):
    rows = [(1, "several words that can be cut in many ways " * 20)] * 3 + [(2, "one more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ids = lambda **k: {tuple(r.ids) for r in subwords.encoded(docs, **k).collect() if r.doc_id == 1}
    assert len(ids()) == 1 and len(ids(copies=True)) == 3


# -- op3 ---------------------------------------------------------------------------------------------


def test_padded_licence_sentences_are_found(spark):
    box = "/" + "*" * 3000 + "\n" + "*" * 500 + " Licensed under the MIT License. " + "*" * 3000 + "\n" + "*" * 3000 + "/"
    rows = [(1, "Licensed under" + " " * 12_000 + "the MIT License."), (2, box), (3, "x" * 20_000 + " license")]
    out = {r.doc_id: list(r.licences) for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: ["MIT"], 2: ["MIT"], 3: []}



def test_licences(spark, docs, nothing, texts):
    s = licences.SENTENCES
    mit = "Copyright 2020 X\n\n" + "\n".join(textwrap.fill(s[k], 60) for k in ("MitGrant", "MitNotice", "MitAsIs", "MitLiability"))
    apache = "\n".join(" * " + x for x in textwrap.wrap(f"{s['ApacheRef']} {s['ApacheFile']}", 50))
    rows = [
        (1, mit, "MIT", ""),
        (2, apache, "Apache-2.0", ""),
        (3, "a b\nLicensed under CC BY-NC 4.0.\nz. All rights reserved. Released under the MIT licence.", "CC-BY-NC-4.0,MIT", "AllRights"),
        (4, "# SPDX-License-Identifier: MIT\nx", "MIT", ""),
        (5, "The word license alone is nothing.", "", ""),
        (6, "word " * 30_000 + "\nReleased under the MIT License.", "MIT", ""),
    ]
    found = licences.scanned(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    got = sorted((r.doc_id, ",".join(r.licences), ",".join(r.unmatched)) for r in found)
    assert got == [(r[0], r[2], r[3]) for r in rows]
    assert licences.scanned(docs).count() == len(texts) and licences.scanned(nothing).count() == 0
    assert all(any(w in sentence for w in licences.KEYWORDS) for sentence in licences.known_sentences())


# -- op4 ---------------------------------------------------------------------------------------------


def slow_fingerprint(text: str | None) -> int:
    words = SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values: list[int], radius: int) -> list[int]:
    label = list(range(len(values)))
    for _ in values:
        new = [min(label[j] for j in range(len(values)) if (values[i] ^ values[j]).bit_count() <= radius) for i in range(len(values))]
        if new == label:
            break
        label = new
    return label


def test_simhash_components(docs, nothing, texts):
    want_f = [slow_fingerprint(r[1]) for r in texts]
    label = slow_components(want_f, 4)
    lowest = {c: min((r[0] for r, x in zip(texts, label, strict=True) if x == c and r[0] is not None), default=None) for c in label}
    want = sorted((str(r[0]), f"{f:016x}", str(lowest[c])) for r, f, c in zip(texts, want_f, label, strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    names = [r.doc_id for r in kept.collect()]
    assert sorted(n for n in names if n is not None) == sorted({c for c in lowest.values() if c is not None})


@pytest.mark.parametrize("tile", [16, 4096])
def test_bk_links_match_all_pairs(spark, tile):
    draw = random.Random(5)
    values = {draw.getrandbits(64) for _ in range(300)}
    for v in list(values)[:40]:
        for _ in range(4):
            v ^= 1 << draw.randrange(64) ^ 1 << draw.randrange(64)
            values.add(v & (1 << 64) - 1)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, tile)
    from corpusloom.llm.components import connected

    got = {r.node: r.component for r in connected(edges).collect()}
    label = slow_components(values, 4)
    groups = lambda name: sorted(sorted(i for i in range(len(values)) if name(i) == c) for c in {name(i) for i in range(len(values))})
    assert groups(lambda i: got.get(signed[i], signed[i])) == groups(lambda i: label[i])


@pytest.mark.parametrize("count", [100, 10_000_000, 10**13])
def test_shard_keys_hold_every_link(count):
    draw, masks = random.Random(2), simhash._masks(4, count)
    for _ in range(200):
        v = draw.getrandbits(64)
        w = v
        for b in draw.sample(range(64), 4):
            w ^= 1 << b
        assert any(v & m == w & m for m in masks)


# -- op5 ---------------------------------------------------------------------------------------------


def test_toxicity_separates_held_out_rows(spark, nothing):
    draw = random.Random(9)
    clean = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    bad = ["vilewort", "vileroot", "grimword"]

    def text(toxic: int) -> str:
        words = [draw.choice(clean) for _ in range(draw.randint(20, 200))]
        for _ in range(draw.randint(1, 9) if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(bad) + draw.choice(["", ",", "x"]))
        return " ".join(words)

    rows = [(i, text(int(i % 5 == 0)), int(i % 5 == 0)) for i in range(1200)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "x"), (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    got = {r.doc_id: r for r in toxicity.graded_documents(docs, model).collect()}
    held = [r for r in rows if r[0] % 2 == 0]
    assert np.mean([got[r[0]].rejected == bool(r[2]) for r in held]) > 0.99
    assert not got[5000].rejected and not got[5001].rejected and not got[None].rejected
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got.values())
    empty = toxicity.train(nothing, labels)
    assert empty.thresholds == [] and toxicity.graded_documents(docs, empty).where("severity <> 0 OR rejected").count() == 0


def test_thresholds_share_weights():
    draw = np.random.default_rng(0)
    x = draw.integers(0, 6, 3000)
    grades = (x >= 2).astype(int) + (x >= 4)
    rows = np.flatnonzero(x)
    weights, thresholds = toxicity.fit(rows, np.zeros(len(rows), int), x[rows], grades, 1)
    score = weights[0] * np.log1p(x)
    assert np.mean((score[:, None] > thresholds[None, :]).sum(1) == grades) > 0.99


# -- op9 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 4096, 4097])
def test_slots_are_a_keyed_permutation(n):
    one = shards.slots(np.arange(n), n, 5)
    assert sorted(one.tolist()) == list(range(n))
    assert n < 17 or one.tolist() != shards.slots(np.arange(n), n, 6).tolist()


def test_shards_round_trip_and_resume(docs, nothing, texts, tmp_path):
    layout = shards.Layout(length=64, records=50)
    rows = sorted(shards.ordered(docs, layout=layout).collect(), key=lambda r: r.shard)
    assert [r.first_slot for r in rows] == [50 * i for i in range(len(rows))]
    assert all(len(r.data) == r.records * r.stride and (r.records == 50 or r is rows[-1]) for r in rows)
    read = [x for r in rows for x in shards.read(bytes(r.data), layout)]
    words = bytepair.vocabulary(bytepair.public_path(bytepair.RANKS))
    want = sorted((str(r[0]), i, p) for r in texts for i, p in enumerate(_cut([*words.plain_ids(r[1] or ""), words.size], 64)))
    assert sorted((str(d), part, ids.tolist()) for d, part, ids in read) == want
    resumed = shards.read(bytes(rows[1].data), layout, start=20, count=5)
    assert [(d, p, i.tolist()) for d, p, i in resumed] == [(d, p, i.tolist()) for d, p, i in read[70:75]]
    again = sorted(shards.ordered(docs, layout=layout).collect(), key=lambda r: r.shard)
    assert [r.crc for r in again] == [r.crc for r in rows]
    files = shards.write_files(shards.ordered(docs, layout=layout), f"file://{tmp_path}/out").collect()
    assert all(open(r.path, "rb").read() == bytes(rows[r.shard].data) for r in files) and len(files) == len(rows)
    assert shards.ordered(nothing).count() == 0


def _cut(ids: list[int], n: int) -> list[list[int]]:
    return [ids[i : i + n] for i in range(0, len(ids), n)]


# -- op10 --------------------------------------------------------------------------------------------


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    path = bytepair.public_path(bytepair.MERGES_JSON)
    library, own = Tokenizer.from_file(path), bytepair.vocabulary(path)
    for c in [*range(1, 0x3000), *range(0x1F300, 0x1F700)]:
        text = f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1 {chr(c)}\n<|endoftext|>{chr(c)}'s  "
        assert own.ids(text) == library.encode(text, add_special_tokens=False).ids, hex(c)


@pytest.mark.parametrize("size,overlap", [(counting.CHUNK, counting.OVERLAP), (300, 24), (40, 4)])
def test_counts_with_any_chunks(docs, nothing, texts, size, overlap):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bytepair.public_path(bytepair.MERGES_JSON))
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = sorted((str(r[0]), len((r[1] or "").encode()), n(r[1]), n(r[1]) > 512) for r in texts)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in counting.counted(docs, size=size, overlap=overlap).collect())
    assert got == want
    assert counting.counted(nothing).count() == 0
