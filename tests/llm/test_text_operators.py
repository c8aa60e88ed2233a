"""Operators on texts against plain Python, with nulls, empty, long and repeated rows."""

import random
import re
from array import array
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from carelake.llm import (
    components, decontamination, licenses, linededup, pieces, secrets, sharding, shingles, simhash, toxicity,
)
from carelake.llm.common import words_of

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string"


def docs_of(spark, texts, ids=None):
    """Documents with two further columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", None, None if t is None else len(t), 7, "x") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOC).repartition(3)


def words(rng, n, size=40):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


# --- sharding -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_byte_shards(spark, shards):
    rng = random.Random(1)
    rows = [(i // 3, rng.randrange(1, 900), None) for i in range(500)] + [(9, 50, "same")] * 200 + [(None, 77, "no id")]
    got = sharding.byte_shards(spark.createDataFrame(rows, "doc_id long, size long, shard_of string").repartition(5),
                               "size", ["doc_id", "size"], shards).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.shard_of or "") for r in got) == \
        sorted((i is not None, i or 0, s, t or "") for i, s, t in rows)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    target = sum(r[1] for r in rows) / shards
    ordered = []
    for s in sorted(by_shard):
        own = sorted(by_shard[s], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - target) <= 900
        ordered += [(r.doc_id is not None, r.doc_id or 0) for r in own]
    assert ordered == sorted(ordered)


def test_byte_shards_empty_and_refused(spark):
    none = spark.createDataFrame([], "doc_id long, size long")
    assert sharding.byte_shards(none, "size", ["doc_id"], 4).collect() == []
    zero = sharding.byte_shards(spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, size long"), "size", ["doc_id"], 4)
    assert [r.shard for r in zero.collect()] == [0, 0]
    with pytest.raises(ValueError):
        sharding.byte_shards(none.withColumn("slot", F.lit(1)), "size", ["doc_id"], 4)
    with pytest.raises(ValueError):
        sharding.byte_shards(none, "size", ["doc_id"], 0)


# --- SimHash --------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, width):
    found = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i:i + width]) for i in range(len(found) - width + 1)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("large", [1, 256])
def test_near_duplicates(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE_BUCKET", large)
    rng = random.Random(2)
    texts = [None, "", " \t ", "One", "ONE", "one two", "É é x y"]
    for _ in range(12):
        base = words(rng, 120, 400)
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
    texts.append(" ".join(words(rng, 30000)))
    docs = docs_of(spark, texts).unionByName(docs_of(spark, [texts[9]], [9]))
    got = simhash.near_duplicates(docs, 3, 3).collect()
    prints = {i: brute_fingerprint(t, 3) for i, t in enumerate(texts)}
    roots = brute_components(sorted(set(prints.values())), 3)
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], i), i)
    want = sorted((i, p, least[roots[p]]) for i, p in prints.items()) + [(9, prints[9], least[roots[prints[9]]])]
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == sorted(want)
    kept = simhash.keep_one(docs, 3, 3)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


@pytest.mark.parametrize("large", [1, 64])
def test_groups_hold_every_pair_of_four_fifths(spark, monkeypatch, large):
    monkeypatch.setattr(shingles, "LARGE_BUCKET", large)
    rng = random.Random(12)
    texts = [None, "", " \t ", "One", "ONE", "one two", "a b c d e", "A b c d e"]
    for _ in range(15):
        base = words(rng, 120, 400)
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own))

    def brute(text):
        w = (text or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    sets, root = [brute(t) for t in texts], list(range(len(texts)))
    far = 0
    for a, b in combinations(range(len(texts)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            far += (brute_fingerprint(texts[a], 5) ^ brute_fingerprint(texts[b], 5)).bit_count() > 6
            root = [root[a] if r == root[b] else r for r in root]
    assert far
    want = sorted((i, min(j for j, s in enumerate(root) if s == r)) for i, r in enumerate(root))
    docs = docs_of(spark, texts)
    assert sorted(map(tuple, shingles.groups(docs).collect())) == want
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want})


def test_every_pair_within_the_radius_meets():
    rng = random.Random(3)
    for radius in (1, 2, 3, 6):
        for _ in range(400):
            gap = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
            for turn in (0, 1):
                assert any(gap & m % (1 << 64) == 0 for m in simhash.masks(radius, turn))


def test_simhash_without_rows_or_ids(spark):
    none = docs_of(spark, [])
    assert simhash.near_duplicates(none).collect() == [] and simhash.keep_one(none).collect() == []
    nameless = docs_of(spark, ["a b c d", "a b c d", "q"], [None, 4, None])
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(nameless).collect())
    assert got == [(-1, -1), (-1, 4), (4, 4)]
    assert simhash.keep_one(nameless).count() == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 300), (400, 100), (7, None)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 400: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- decontamination ------------------------------------------------------------------------------------------------


def brute_words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(text, items, size):
    own, hit, found = brute_words(text), set(), set()
    for item, item_text in items:
        need = brute_words(item_text)
        n = min(size, len(need))
        for at in range(len(need) - n + 1 if n else 0):
            for i in range(len(own) - n + 1):
                if own[i:i + n] == need[at:at + n]:
                    hit.update(range(i, i + n))
                    found.add(item)
    return len(own), len(hit), found


def test_contamination(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 300)
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, rng.choice([2, 4, 6, 9]), 30))) for i in range(12)]
    items += [(12, None), (13, ""), (14, "Ünï w1"), (3, "w1 w1 w1 w1 w1"), (None, "only here twice")]
    texts = [" ".join(words(rng, rng.randrange(60), 30)) for _ in range(60)]
    texts += [None, "", "ünÏ W1!", "ünï w1", items[0][1], f"x {items[1][1].upper()}, y", "w1 " * 700, "only here twice"]
    docs = docs_of(spark, texts).unionByName(docs_of(spark, [texts[5]], [5]))
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.item_ids), r.contaminated) for r in
                 decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), 4).collect())
    want = []
    for i, text in [*enumerate(texts), (5, texts[5])]:
        n, hit, found = brute_contamination(text, items, 4)
        want.append((i, n, hit, len(found), tuple(sorted(str(x) for x in found if x is not None)), hit > 0))
    assert got == sorted(want)
    kept = decontamination.without_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), 4)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[5])


@pytest.mark.parametrize("block", [1, 1 << 17])
def test_proximity_matches(spark, block):
    wins = decontamination.windows(spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string"), 4)
    docs = docs_of(spark, ["alpha beta gamma delta", "alpha beta x gamma delta", "alpha x x x beta gamma delta", "delta alpha"])
    index = decontamination.build_index(docs, wins)
    places = index.select("block", F.posexplode("doc_ids").alias("doc_no", "doc_id"))
    for slop, want in ((0, [(0, 0, 4)]), (1, [(0, 0, 4), (1, 0, 5)])):
        found = decontamination.search(index, wins, slop, block).join(places, ["block", "doc_no"])
        assert sorted((r.doc_id, r.start, r.stop) for r in found.collect()) == want


def test_proximity_at_the_beginning_of_a_document(spark):
    wins = decontamination.windows(spark.createDataFrame([(1, "a b")], "item_id long, text string"), 2)
    index = decontamination.build_index(docs_of(spark, ["x x b", "a b"]).coalesce(1), wins)
    assert index.count() == 1
    got = decontamination.search(index, wins, 2).collect()
    assert [(r.doc_no, r.start, r.stop) for r in got] == [(1, 0, 2)]


def test_contamination_empty_tables(spark):
    items, none = spark.createDataFrame([(1, "a b c")], "item_id long, text string"), docs_of(spark, [])
    assert decontamination.contamination(none, items).collect() == []
    got = decontamination.contamination(docs_of(spark, ["a b c"]), items.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(3, 0, False)]


def test_words_are_those_of_the_pattern():
    for text in ("Ab-c\x00d Ünï x 0_9 ÀB", "", "  ", "日本 x"):
        assert [w.decode() for w in words_of(text.encode())] == brute_words(text)


# --- SentencePiece --------------------------------------------------------------------------------------------------

SMALL = {"pieces": {"a": (0, -2.0), "aa": (1, -2.5), "ab": (2, -1.0), "ba": (3, -1.0), "bab": (4, -1.4), "b": (5, -3.0),
                    "▁": (6, -1.0), "▁a": (7, -1.1)}, "bytes": list(range(10, 266))}


def brute_pieces(encoder, text):
    best, back = [0.0] + [float("-inf")] * len(text), [0] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for at in range(max(0, end - encoder.longest), end):
            known = encoder.pieces.get(text[at:end])
            value = best[at] + (known[1] if known else encoder.unknown) if known or at == end - 1 else None
            if value is not None and value > best[end]:
                best[end], back[end] = value, at
    cut = [len(text)]
    while cut[-1]:
        cut.append(back[cut[-1]])
    return [i for a, b in zip(cut[::-1], cut[-2::-1]) for i in encoder._ids_of(text[a:b])]


@pytest.mark.parametrize("alphabet", ["ab", "abc ", "aaaa", "ab▁ é", "日a b\n"])
def test_streaming_search_is_the_best_path(alphabet):
    rng = random.Random(5)
    encoder, decoder = pieces.Encoder(SMALL, remembered=20), pieces.Decoder(SMALL)
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(70)))
        ids = list(encoder.encode(text))
        assert decoder.decode(ids) == text
        assert list(encoder.search(text)) == brute_pieces(encoder, text)
        if text and "▁" not in text:
            assert ids == brute_pieces(encoder, "▁" + text.replace(" ", "▁"))


@pytest.mark.parametrize("alphabet", ["ab", "abc ", "ab▁ é", "日a b\n"])
@pytest.mark.parametrize("remembered", [3, 1000])
def test_segments_searched_together_are_the_best_paths(alphabet, remembered):
    rng = random.Random(6)
    encoder, alone = pieces.Encoder(SMALL, remembered), pieces.Encoder(SMALL)
    for _ in range(40):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(20)]
        encoder.learn(texts)
        assert [encoder.encode(t) for t in texts] == [alone.encode(t) for t in texts]
        assert all(list(array("i", ids)) == brute_pieces(encoder, s) for s, ids in encoder.known.items())


def test_ids_go_out_before_the_text_ends():
    encoder, read = pieces.Encoder(SMALL), []

    class Text(str):
        def __getitem__(self, at):
            read.append(at.stop)
            return str.__getitem__(self, at)
    next(iter(encoder.search(Text("abc" * 5000))))
    assert max(read) < 50


def test_encode_texts_round_trip(spark):
    vocabulary = pieces.load_pieces()
    texts = [None, "", " ", "a  b", "▁x ▁", "Ünï \n日本語\t\x00", "word " * 20000, "x" * 30000, "x" * 30000]
    docs = docs_of(spark, texts, [None, *range(1, len(texts))])
    rows = pieces.encode_texts(docs, vocabulary)
    got = rows.collect()
    assert all(r.exact for r in got) and all(len(r.ids) == r.n_ids for r in got)
    back = sorted(r.text for r in pieces.decode_ids(rows, vocabulary).collect())
    assert back == sorted(t or "" for t in texts)
    assert pieces.encode_texts(docs_of(spark, []), vocabulary).collect() == []


# --- secrets --------------------------------------------------------------------------------------------------------

HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def brute_base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) > 5]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(found)]


def sample(rng, n):
    texts = []
    for i in range(n):
        own = words(rng, 60, 500)
        if i % 2:
            own[30:30] = ["token", "=", '"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"']
        texts.append(" ".join([*own, "4785380592391141", "10.0.0.1"]))
    return texts


def test_field_finds_held_out_secrets_and_keeps_base_spans(spark):
    rng = random.Random(6)
    field = secrets.train(sample(rng, 60))
    found = missed = 0
    for text in sample(rng, 60):
        tokens, tags = secrets._tagged(text)
        got = {i for a, b in field.decode(tokens, text.lower()) for i in range(a, b)}
        want = set(np.flatnonzero(tags != secrets.OUTSIDE).tolist())
        found, missed = found + len(got & want), missed + len(want - got)
        assert not got - want
    assert found > 20 * (missed + 1)
    texts = [None, "", f'é token = "{HEX}" x', "TOKEN: abcde", "token = secret = abcdefgh", f"AKIA{'A1' * 9} {HEX}0", "a " * 30000,
             "ſecret=abcdefgh paſſwd=1234567", "f" * 90000, f'w1 w2 token is "K3vQ9mZx7RbT2wLp{"K3vQ9mZx" * 3}" w3 w4']
    docs = docs_of(spark, [*texts, texts[2]], [*range(len(texts)), 2])
    got = secrets.find_secrets(docs, field).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        spans = [tuple(s) for s in r.spans]
        assert [s for s in spans if s[0] != "field"] == brute_base(texts[r.doc_id] or "")
        assert spans == sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0])))
    assert any(s.kind == "field" for r in got if r.doc_id == 9 for s in r.spans)
    assert secrets.find_secrets(docs_of(spark, []), field).collect() == []


def test_pruned_decoding_is_viterbi():
    rng = np.random.default_rng(7)
    for _ in range(300):
        steps, n = rng.normal(size=(3, 3)), int(rng.integers(1, 12))
        scores = rng.normal(size=(n, 3)) * 4 + [0, 0, 3]
        field = secrets.Field({}, steps, frozenset())
        field.scores = lambda tokens, low: scores  # noqa: B023
        whole = secrets.viterbi(scores, steps, False, False)
        want = []
        for i, tag in enumerate(whole):
            if tag == secrets.BEGIN or tag == secrets.INSIDE and (i == 0 or whole[i - 1] == secrets.OUTSIDE):
                want.append((i, i + 1))
            elif tag == secrets.INSIDE:
                want[-1] = (want[-1][0], i + 1)
        assert field.decode(["x"] * n, "") == want


def test_untrained_field_finds_nothing():
    assert secrets.train([]).decode(["a", HEX, "="], "") == []
    assert secrets.sample_texts.__doc__


# --- licenses -------------------------------------------------------------------------------------------------------


def brute_labels(text):
    found = brute_words(text)
    spaced = "".join(f" {w} " for w in found)
    hits = [(r["rule"], r["label"], r["priority"], m.start(), m.end()) for r in licenses.rules()
            for m in re.finditer(r["pattern"], spaced)]
    outer = [h for h in hits if not any(g[2] > h[2] and g[3] >= h[3] and g[4] <= h[4] for g in hits)]
    kept = [h for h in outer if not any(
        g[2] >= h[2] and g[3] <= h[3] and g[4] >= h[4] and (g[2] > h[2] or (g[3], -g[4]) != (h[3], -h[4]) or g[0] < h[0])
        for g in outer if g is not h)]
    places = [i for i in range(len(found)) for p in licenses.PHRASES if found[i:i + len(p.split())] == p.split()]
    base = {label for p, label in licenses.PHRASES.items() if f" {'  '.join(p.split())} " in spaced}
    return (len(found), len(places), min(places, default=None), max(places, default=None), sorted(base),
            sorted(base | {h[1] for h in kept}))


def test_license_labels(spark):
    assert len(licenses.rules()) >= 200
    texts = [None, "", "...", "cc by", "CC-BY cc by cc by", "Licensed under CC BY-NC 4.0.", "xcc by", "cc byé",
             "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: MIT", "released under the MIT License",
             "This is licensed under the GNU General Public License, version 3. All rights reserved.",
             "see https://www.apache.org/licenses/LICENSE-2.0 for more", "general public license " * 4000,
             "GNU Lesser General Public License v2.1", "all rights all rights reserved reserved", "mit von mit"]
    docs = docs_of(spark, [*texts, texts[5]], [*range(len(texts)), 5])
    got = licenses.license_labels(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        if r.doc_id != 13:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute_labels(texts[r.doc_id])
        assert 0 <= r.score <= 1
    long = next(r for r in got if r.doc_id == 13)
    assert (long.n_words, long.n_base, long.first_word, long.last_word) == (12000, 4000, 0, 11997)
    assert licenses.license_labels(docs_of(spark, [])).collect() == []


def test_rules_need_their_words():
    """A rule's prefilter words stand in everything that its expression can match: tried on the texts above."""
    for r in licenses.rules():
        assert r["keys"] and re.compile(r["pattern"])
        for key in r["keys"]:
            assert re.search(rf"\b{key}\b", r["pattern"].replace("[sc]", "s")) or key in r["pattern"]


# --- lines ----------------------------------------------------------------------------------------------------------


def changed(rng, line, edits):
    out = list(line)
    for _ in range(edits):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0 and at < len(out):
            out[at] = rng.choice("xyzé")
        elif kind == 1 and at < len(out):
            del out[at]
        else:
            out.insert(at, rng.choice("xyzé"))
    return "".join(out)


def test_edit_distance():
    rng = random.Random(8)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(25)))
        b = changed(rng, a, rng.randrange(5))
        for most in (0, 1, 2, 3):
            assert linededup.edit_distance(a, b, most) == min(linededup._plain_distance(a, b), most + 1)


def test_distances_side_by_side_are_those_of_single_pairs():
    chance, one, other, most = random.Random(11), [], [], []
    for _ in range(600):
        letters = chance.choice(["ab", "abcdefgh ", "a\u00e9\u6f22\U0001d4b3 z"])
        a = b = "".join(chance.choices(letters, k=chance.choice([0, 1, 3, 12, 63, 64, 65, 130, 400])))
        limit = chance.choice([0, 1, 2, 5, 13, 31, 32, 40])
        for _ in range(chance.randrange(2 * limit + 3)):
            at = chance.randrange(len(b) + 1)
            b = b[:at] + chance.choice(["", *letters]) + b[at + chance.randrange(2):]
        one.append(a), other.append(b), most.append(limit)
    want = [linededup.edit_distance(a, b, t) for a, b, t in zip(one, other, most)]
    assert linededup.edit_distances(one, other, most).tolist() == want
    assert linededup.edit_distances([], [], []).tolist() == []


def test_keys_of_many_long_lines_keep_grams_that_the_edits_cannot_all_touch():
    chance = random.Random(12)
    lines = ["a" * 500, "ab" * 70, "abc" * 900] + [
        " ".join(chance.choices(["the", "of", "tion", "her", "zq", "\u6f22\u5b57"], k=chance.choice([60, 90, 300]))) for _ in range(300)]
    counts, keys, places = linededup.long_keys_of(lines, linededup.EDITS)
    assert len(keys) == len(places) == counts.sum()
    ends = counts.cumsum()
    for line, start, end in zip(lines, ends - counts, ends):
        grams, limit = linededup._grams(line).tolist(), max(keys[start:end].tolist())
        held = {}
        for at, gram in enumerate(grams):
            if gram <= limit:
                held.setdefault(gram, []).append(at)
        assert dict(zip(keys[start:end].tolist(), places[start:end].tolist())) == {
            k: v[0] if len(v) == 1 else -1 for k, v in held.items()}
        free, apart = 0, 0
        for at in sorted(p for found in held.values() for p in found):
            if at >= free:
                free, apart = at + linededup.GRAM, apart + 1
        assert apart > linededup.allowed(len(line))
    assert [len(v) for v in linededup.long_keys_of([], linededup.EDITS)] == [0, 0, 0]



def test_pairs_of_long_lines_are_told_in_waves_not_column_by_column(monkeypatch):
    chance = random.Random(16)
    base = "".join(chance.choices("abcdefgh ", k=60_000)) + "\u00e9"
    lines = [changed(chance, base, n) for n in (0, 3, 9, 40)] + ["", base[:7], "x" * 60_000]
    pairs = [(a, b, t) for a, b in combinations(lines, 2) for t in (0, 9, 60)]
    one, other, most = zip(*pairs)
    want = [linededup.edit_distance(*pair) for pair in pairs]
    words, read = linededup._words, []
    monkeypatch.setattr(linededup, "_words", lambda some, margin: read.append(some) or words(some, margin))
    for chars in (linededup.LANE_CHARS, 100_000):
        monkeypatch.setattr(linededup, "LANE_CHARS", chars)
        assert linededup.edit_distances(one, other, most).tolist() == want
    assert read and all(len(set(some)) == len(some) for some in read)  # a line of many pairs is laid out once


def test_equal_lines_of_a_batch_are_keyed_once(spark):
    docs = docs_of(spark, ["one line of text\nother line", "one line of text", None, "one line of text"], [3, 2, 1, None])
    rows = linededup.distinct_lines(docs.coalesce(1), linededup.EDITS).collect()
    assert sorted((r.n, r["first"].doc_id, r["first"].line_no) for r in rows if r.n > 1) == [(3, None, 0)]
    assert len(rows) == 2


def brute_lines(texts):
    """Places of lines that go, as (document, line), and links per line text."""
    first, order = {}, []
    for i, text in sorted(texts.items()):
        for n, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                first.setdefault(line, (i, n))
                order.append((i, n, line))
    links = defaultdict(set)
    for a, b in combinations(first, 2):
        most = linededup.allowed(min(len(a), len(b)))
        if not most or abs(len(a) - len(b)) > most:
            continue
        if (linededup._plain_distance(a, b) if len(a) < 1000 else linededup.edit_distance(a, b, most)) <= most:
            links[a].add(b)
            links[b].add(a)
    near = {line: any(first[other] < first[line] for other in links[line]) for line in first}
    return order, first, near, links


@pytest.mark.parametrize("large", [1, 64])
def test_near_lines(spark, monkeypatch, large):
    monkeypatch.setattr(linededup, "LARGE_BUCKET", large)
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(5, 60))) for _ in range(25)] + ["", "  ", "short"]
    texts = {i: "\n".join(changed(rng, rng.choice(pool), rng.randrange(4)) if rng.random() < 0.6 else rng.choice(pool)
                          for _ in range(rng.randrange(1, 8))) for i in range(50)}
    texts |= {50: None, 51: "", 52: texts[3], 53: "y" * 40000, 54: "y" * 40001}
    docs = docs_of(spark, list(texts.values()), list(texts)).unionByName(docs_of(spark, [texts[4]], [4]))
    order, first, near, links = brute_lines(texts)
    got = {r.doc_id: r for r in linededup.line_summary(docs).collect()}
    kept = {r.doc_id: r for r in linededup.without_repeated_lines(docs).collect()}
    assert linededup.without_repeated_lines(docs).count() == len(texts) + 1
    for i, text in texts.items():
        own = [(n, line) for d, n, line in order if d == i]
        r = got[i]
        assert r.n_lines == (2 if i == 4 else 1) * len(own) or r.n_lines == len(own)
        if i != 4:
            repeated = [n for n, line in own if first[line] != (i, n)]
            only_near = [n for n, line in own if first[line] == (i, n) and near[line]]
            assert (r.n_repeated, r.n_near) == (len(repeated), len(only_near)), i
            assert r.n_links == sum(len(links[line]) for _, line in own)
            left = [x for n, x in enumerate((text or "").split("\n")) if n not in repeated + only_near]
            assert (kept[i].text or "") == "\n".join(left)
            assert kept[i].n_chars == (None if text is None else len("\n".join(left)))
    assert linededup.line_summary(docs_of(spark, [])).collect() == []


# --- toxicity -------------------------------------------------------------------------------------------------------


def test_near_lines_of_any_length(spark):
    rng = random.Random(13)
    texts = []
    for size in (100, 118, 120, 122, 160, 400, 600, 900):
        base = "".join(rng.choice("abcdefgh ") for _ in range(size)) + "."
        texts += [base] + [changed(rng, base, n) for n in (2, 3, size // 40, size // 40 + 1, size // 30) for _ in range(3)]
    texts += ["y" * 4000, "y" * 4090, "y" * 4300]
    order, first, near, links = brute_lines(dict(enumerate(texts)))
    got = {r.doc_id: (r.n_near, r.n_links) for r in linededup.line_summary(docs_of(spark, texts)).collect()}
    assert got == {i: (int(first[t] == (i, 0) and near[t]), len(links[t])) for i, t in enumerate(texts)}
    assert any(linededup._plain_distance(texts[-19], t) > 10 for t in links[texts[-19]])


@pytest.mark.parametrize("tile,chars", [(4, 1 << 22), (64, 4000)])
def test_near_copies_of_a_long_line_are_counted_without_a_row_per_pair(spark, monkeypatch, tile, chars):
    for name, value in (("LARGE_GROUP", 4), ("TILE", tile), ("TILE_CHARS", chars)):
        monkeypatch.setattr(linededup, name, value)
    rng, texts = random.Random(14), []
    passage = "".join(rng.choice("abcdefgh ") for _ in range(60))
    for size, copies in ((130, 12), (400, 45), (410, 25), (1200, 6)):
        base = "".join(rng.choice("abcdefgh ") for _ in range(size)) + "."
        texts += [base] + [changed(rng, base, rng.randrange(size // 25)) for _ in range(copies)]
    texts += ["".join(rng.choice("abcdefgh ") for _ in range(n)) + passage + "z" * n for n in range(40, 60, 4)]
    rng.shuffle(texts)
    docs = docs_of(spark, texts + texts[:9], [None, *range(1, len(texts) + 9)])
    first, links = {}, defaultdict(set)
    for i, text in enumerate(texts):
        first.setdefault(text, i)
    for a, b in combinations(first, 2):
        if linededup.edit_distance(a, b, most := linededup.allowed(min(len(a), len(b)))) <= most:
            links[a].add(b)
            links[b].add(a)
    got = {r.doc_id or 0: r for r in linededup.line_summary(docs).collect()}
    for i, text in enumerate(texts):
        near = first[text] == i and any(first[other] < i for other in links[text])
        assert (got[i].n_repeated, got[i].n_near, got[i].n_links) == (int(first[text] != i), int(near), len(links[text])), i
    lines, found = linededup.line_links(docs)
    pairs = sum(map(len, links.values()))
    assert found.agg({"links": "sum"}).first()[0] == pairs and (tile < 64 or 2 * found.count() < pairs)


def test_no_link_is_ruled_out_by_counts_of_characters():
    rng = random.Random(15)
    one = ["".join(rng.choice("ab\u00e9\U0001d4b3 ") for _ in range(rng.randrange(60))) for _ in range(400)]
    most = np.array([rng.randrange(6) for _ in one])
    other = [changed(rng, a, int(n)) for a, n in zip(one, most)]
    row = np.arange(len(one))
    counts = linededup._pair_counts(one + other)
    assert linededup._may_link(counts, row, row + len(one), most).all()
    assert not linededup._may_link(linededup._pair_counts(["ab" * 40, "cd" * 40]), row[:1], row[1:2], most[:1]).any()



def test_thresholds_are_ordered_and_weights_shared():
    rng = np.random.default_rng(10)
    grades = rng.integers(0, 3, 400)
    rows, columns = [], []
    for i, g in enumerate(grades):
        for c in {0: [0], 1: [1], 2: [1, 2]}[g]:
            rows.append(i)
            columns.append(c)
    w, t = toxicity.fit(np.array(rows), np.array(columns), grades, np.ones(400), 3, steps=800)
    assert t[0] < t[1] and w[0] < w[1] and w[2] > 0
    model = toxicity.Model({"a": w[0], "b": w[1], "c": w[2]}, t)
    past = model.past(np.array([w[0], w[1], w[1] + w[2]]))
    assert (past[:, 0] > past[:, 1]).all() and (past > 0.5).sum(axis=1).tolist() == [0, 1, 2]


def test_toxicity_held_out(spark):
    rng = random.Random(11)
    bad = ["idiot", "scum", "trash", "moron"]
    texts, marks = [], []
    for i in range(400):
        own, toxic = words(rng, 50, 300), i % 4 == 0
        if toxic:
            for _ in range(4):
                own[rng.randrange(50)] = rng.choice(bad)
        texts.append(" ".join(own))
        marks.append((i, 0 if toxic and i % 8 == 0 else 1, int(toxic)))
    more = [None, "", " ".join(["idiot", "scum", "trash", *words(rng, 20000, 300)]), texts[0]]
    docs = docs_of(spark, [*texts, *more])
    labels = spark.createDataFrame([*marks[:200], marks[0], (1, None, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    assert not [i for i, _, t in marks if not t and got[i].grade]
    assert sum(got[i].grade > 0 for i, _, t in marks if t) >= 90
    assert all(0 <= r.severity <= 2 for r in got.values())
    assert [got[i].grade > 0 for i in range(400, 404)] == [False, False, True, True]
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i].p_toxic <= 0.5)
    nothing = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.severity(docs, nothing).where("grade > 0").count() == 0
    assert toxicity.severity(docs_of(spark, []), model).collect() == []


def test_the_shape_of_a_token_is_that_of_the_whole():
    assert secrets._shape("a" * 500 + "=" + "X9" * 3) == "many " + "".join(sorted("a=X9".replace("X", "A").replace("9", "0")))
    assert secrets._shape("a" * 90 + "0") == "a0" and secrets._shape("a" * 90) == "a"
    token = "x" * 200_000 + '":"' + "7" * 100_000
    shape = next(f for f in secrets.features(token, frozenset()) if f.startswith("shape"))
    assert set(shape.removeprefix("shape many ")) == set('a":0')  # the digits stand far behind


@pytest.mark.parametrize(("name", "stage"), [
    ("__rows", simhash.keep_one), ("__first", simhash.keep_one), ("__ID", linededup.without_repeated_lines),
    ("__lines", linededup.without_repeated_lines), ("__key", linededup.without_repeated_lines)])
def test_clashing_names_are_refused(spark, name, stage):
    docs = docs_of(spark, ["some text", "other text"]).withColumn(name, F.lit(1))
    with pytest.raises(ValueError, match="taken"):
        stage(docs)


def test_blocks_of_windows_are_written_one_by_one(spark):
    texts = [" ".join(f"w{i}" for i in range(n, n + 30)) for n in range(0, 200, 10)]
    docs, items = docs_of(spark, texts), spark.createDataFrame([(1, texts[3]), (2, texts[9])], "item_id long, text string")
    wins = decontamination.windows(items, 10)
    index = decontamination.build_index(docs, wins)
    whole, cut = (sorted(tuple(r) for r in decontamination.search(index, wins, 0, n).collect()) for n in (1 << 17, 5))
    assert whole == cut and len(whole) > 60
