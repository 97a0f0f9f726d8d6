"""The ten operators against brute force, exact round trips and held-out accuracy."""
from __future__ import annotations

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseweave.llm import (arrow_text, fingerprints, language_id, license_scan, near_dedup, packing, quality_classifier, quality_rules,
                           subwords, toxicity, warc)

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"
GAP = re.compile(r"[\x20\x09-\x0D]+")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, m string"
ODD = [None, "", " \n\t ", "one", "one two three four", "a b c d e f g h", "a b c d e f g h", "x" * 5000, "ab " * 3000, "äöü 日本語 \U0001F600 ok.\nNext line!",
       "same line\nsame line\n\nsame line", "!!! ### $$$"]


def odd_documents(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, "r", "m") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id here", None, None, None, None, None), (None, None, None, None, None, None, None)], DOCS)


def words(t):
    return [w for w in GAP.split(t or "") if w]


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Random texts with exact and near copies of one another."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts = [prose(rng, rng.randint(3, 200), vocabulary) for _ in range(120)]
    for base in texts[:12]:
        for _ in range(6):
            w = base.split()
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    return [(i, t) for i, t in enumerate(texts)]


# shared helpers

def test_words_and_shingles_do_not_cross_rows():
    texts = pa.array(["a b c d e f", None, "a b", "", "a b c d e f"], pa.large_string())
    (_, _, buf, at), = arrow_text.chunks(texts)
    start, end, row = arrow_text.words(buf, at)
    h = arrow_text.word_hashes(buf, start, end)
    assert row.tolist() == [0] * 6 + [2] * 2 + [4] * 6
    assert (h[:6] == h[8:]).all() and len(set(h[:6].tolist())) == 6
    s, of = arrow_text.shingles(h, row, 5)
    assert of.tolist() == [0, 0, 2, 4, 4] and s[0] == s[3] and s[1] == s[4] and len(set(s.tolist())) == 3


def test_chunks_hold_every_row_once():
    texts = pa.array(["x" * n for n in (0, 10, 500, 3, 0, 900, 1)], pa.string())
    got = [(a, b, len(buf)) for a, b, buf, _ in arrow_text.chunks(texts, 100)]
    assert [a for a, _, _ in got] == [0, *[b for _, b, _ in got[:-1]]] and got[-1][1] == 7 and sum(n for *_, n in got) == 1414


# 1 license scan

def test_license_scan_matches_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["of", "the", "work", "license", "public", "version", "software", "any", "person", "blue"]
    texts = []
    for i in range(60):
        t = prose(rng, rng.randint(0, 120), vocabulary)
        name = rng.choice(list(license_scan.TEMPLATES))
        notice = license_scan.TEMPLATES[name].split()
        if i % 3:
            if i % 2 and len(notice) > 40:
                notice[rng.randrange(len(notice))] = "changed"
            t = f"{t}\n{' '.join(notice)}\n{prose(rng, 5, vocabulary)}"
        texts.append((i, t))
    clean = lambda t: [w for w in re.sub(r"[\W_]+", " ", (t or "").lower()).split(" ") if w]
    want = set()
    for i, t in texts:
        w = clean(t)
        for name, body in license_scan.TEMPLATES.items():
            b = clean(body)
            k = min(5, len(b))
            shingles = {tuple(b[j:j + k]) for j in range(len(b) - k + 1)}
            half = 2 ** math.ceil(math.log2(len(shingles)))
            s = [tuple(w[j:j + k]) for j in range(len(w) - k + 1)]
            best = max((len(shingles & set(s[j:j + 2 * half])) / len(shingles) for j in range(0, len(s), half)), default=0)
            if best >= 0.8:
                want.add((i, name, round(best, 9)))
    got = license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"], round(r["containment"], 9)) for r in got} == want and len(want) > 20


def test_related_licenses_get_their_own_name(spark):
    T = license_scan.TEMPLATES
    families = ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"]
    cases = [(f"before it {T[f'{k} header']} after it", f"{k} header") for k in families]
    cases += [(f"x y {T[f'{k} text']} z", f"{k} text") for k in ("BSD-2-Clause", "BSD-3-Clause", "MIT")]
    cases += [(T["GPL-2 full text"], "GPL-2 full text"), (T["GPL-3 full text"], "GPL-3 full text")]
    cases += [("Licensed under the BSD 3-Clause License.", "BSD-3-Clause line"), ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0 line"),
              ("Licensed under the Mozilla Public License, version 2.0", "MPL-2.0 line"), (T["MIT line"], "MIT line"),
              ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0 line"),
              ("Released under the GNU Lesser General Public License v2.1", "LGPL-2.1 line")]
    cases += [(f"{T['GPL-2.0 header']} {T['GPL-3.0 header']}", "GPL-2.0 header+GPL-3.0 header"),
              (T["GPL-3.0 header"].replace("version 3", "version 4"), "")]
    got = collections.defaultdict(set)
    for r in license_scan.notices(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect():
        got[r["doc_id"]].add(r["license"].split(":")[0])
    assert {i: "+".join(sorted(got[i] - {"all-rights-reserved"})) for i in range(len(cases))} == {i: name for i, (_, name) in enumerate(cases)}


# 2 quality

def test_quality_separates_junk(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        t = prose(rng, rng.randint(20, 200), vocabulary).capitalize() + "."
        if i % 4 == 0:
            t = [t.upper().replace(" ", "!! "), t.replace(" ", "### "), " | ".join(t.split()), (t[:20] + " ") * 40][i // 4 % 4]
        rows.append((i, t))
        labels.append((i, int(i % 4 != 0), 0))
    measured = quality_classifier.measure(spark.createDataFrame(rows, "doc_id long, text string"))
    model = quality_classifier.fit(measured, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("doc_id") % 3 != 1)
    score = {r["doc_id"]: r["score"] for r in quality_classifier.with_score(measured, model).collect()}
    held = [i for i in range(400) if i % 3 == 1]
    assert sum((score[i] >= 0.5) == (i % 4 != 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in score.values())


def test_quality_scores_are_calibrated(spark):
    """Two overlapping groups, half of each label: half of the documents a score over 0.5 and both classes recalled alike."""
    rng = np.random.default_rng(3)
    y = np.arange(3000) % 2
    x = rng.normal(size=(3000, len(quality_classifier.NAMES))) + 0.35 * y[:, None]
    measured = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, x array<double>")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    model = quality_classifier.fit(measured, labels, F.col("doc_id") % 3 != 1)
    held = np.arange(3000) % 3 == 1
    score = model.score(x[held])
    good, poor = (score[y[held] == 1] >= 0.5).mean(), (score[y[held] == 0] < 0.5).mean()
    assert good > 0.6 and poor > 0.6 and abs(score.mean() - 0.5) < 0.05


# 3 WARC

def test_warc_round_trip(spark):
    rng = random.Random(3)
    long = prose(rng, 60, ["alpha", "beta", "gamma", "delta"])
    rows = [(i, f"http://x/{i}", f"<html>{prose(rng, 50, ['a', 'bb', 'ccc'])}</html>") for i in range(60)]
    rows += [(70, "u", long), (65, None, long), (99, "u\r\nX: y", long), (99, "u", long), (71, "u", "short"), (72, "u", "short"), (73, "u", None), (None, "u", long)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    of = collections.defaultdict(list)
    for r in got:
        of[r["page_id"]].append(r)
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        for r in of[i]:
            assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
            again = html == long and i != 65
            assert (r["record_type"], r["refers_to"]) == (("revisit", 65) if again else ("response", None))
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archive_starts_with_its_dictionary(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "u", prose(rng, 200, ["header", "footer", "nav", "<div class=x>", "</div>"])) for i in range(300)]
    records = warc.classify(spark.createDataFrame(rows, "page_id long, url string, html string")).coalesce(1)
    manifest = warc.write(records, str(tmp_path / "out")).collect()
    assert sum(r["records"] for r in manifest) == 300
    raw = open(manifest[0]["file"], "rb").read()
    assert int.from_bytes(raw[:4], "little") == 0x184D2A5D
    known = raw[8:8 + int.from_bytes(raw[4:8], "little")]
    import zstandard
    rest = raw[8 + len(known):]
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known)).decompressobj()
    assert codec.decompress(rest).startswith(b"WARC/1.1\r\nWARC-Type: response") and codec.unused_data


# 4 toxicity

def test_toxicity_finds_altered_insults(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(500)]
    bad = ["wretchling", "gobbermuck", "snivelpot", "dunderclod"]
    rows, labels = [], []
    for i in range(500):
        t = [prose(rng, 12, vocabulary) for _ in range(4)]
        if i % 5 == 0:
            t[rng.randrange(4)] += " " + rng.choice(bad) + " " + rng.choice(bad)
        rows.append((i, ". ".join(t)))
        labels.append((i, 1, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("doc_id % 3 != 1"))
    score = {r["doc_id"]: r["score"] for r in toxicity.with_score(docs, model).collect()}
    held = [i for i in range(500) if i % 3 == 1]
    assert sum((score[i] >= 0.7) == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    value = lambda w: float(model.word_values([w])[0])
    assert min(value("gobb-ermuck"), value("gobberrmuck"), value("snivelxpot")) > 3 * max(value(w) for w in vocabulary[:20])
    assert ["wretchling"] == [w for w in toxicity.sentences("w r e t c h l i n g")[0] if len(w) > 1]


@pytest.mark.parametrize("insults", [20, 200])
def test_many_rare_insults_are_learned(insults):
    """800 toxic documents; with 200 insults each is in four of them."""
    rng = random.Random(1)
    syllables = ["ba", "ko", "ri", "mun", "ta", "sel", "vo", "dri", "pa", "nel", "gu", "fi", "lor", "zet", "hem", "qua"]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(600)]
    roots = ["grub", "snot", "muck", "wret", "vile", "scum", "dreg", "pox", "fang", "husk", "blot", "crud", "yob", "zil", "jix", "kwe"]
    bad = [rng.choice(roots) + rng.choice(roots) + rng.choice("aeiou") + rng.choice("xyzkg") for _ in range(insults)]
    train, texts, want = [], [], []
    for i in range(1600):
        s = [[rng.choice(vocabulary) for _ in range(rng.randint(6, 14))] for _ in range(rng.randint(2, 6))]
        if i < 800:
            line = rng.choice(s)
            line[rng.randrange(len(line))] = bad[i % insults]
        train.append((s, int(i < 800)))
    for i in range(400):
        s = [[rng.choice(vocabulary) for _ in range(10)] for _ in range(4)]
        if i < 200:
            w = bad[i % insults]
            k = rng.randrange(1, len(w))
            s[1][3] = w[:k] + rng.choice("-*.x") + w[k:] if i % 2 else w
        texts.append(". ".join(" ".join(x) for x in s) + ".")
        want.append(i < 200)
    model = toxicity.fit(train)
    found = model.score(model.decide(texts, {})) >= 0.7
    want = np.array(want)
    assert found[want].mean() >= 0.85 and found[~want].mean() <= 0.02


def test_level_of_telling_words_is_above_chance():
    rng = np.random.default_rng(0)
    noise, mirror = rng.normal(size=5000), rng.normal(size=5000)
    level = toxicity.surest_level(np.concatenate((noise, np.full(60, 6.0))), mirror)
    assert (noise >= level).sum() <= 20 and level <= 6.0
    assert toxicity.surest_level(np.full(3, -np.inf), mirror) == np.inf


def test_words_that_differ_in_their_edges_meet_the_landmarks_once(monkeypatch):
    met = []
    kernel = toxicity.kernel
    monkeypatch.setattr(toxicity, "kernel", lambda words, table: met.extend(words) or kernel(words, table))
    table = toxicity.Landmarks.of(toxicity.dense(["idiot", "banana"]))
    model = toxicity.Machine(table, np.array([1.0, -0.5], np.float32), 0.0, 1.0, 0.0, ["idiot", "banana"])
    long = "xyz" * 12
    values = model.word_values(["idiot,", "idiot", "(idiot)", long, "banana", "\U0001d11e", ""])
    assert sorted(met) == sorted({"idiot", "banana", "\U0001d11e", "", *toxicity._pieces(long)})
    assert values[0] == values[1] == values[2] and abs(values[4] + 0.5) < 0.1 and values[6] == 0


def test_sentences_and_marks_are_found_as_described():
    rng = random.Random(3)
    ends, inner = re.compile(r"[.!?]+(?:\s+|$)|\n+"), re.compile(r"\w[^\w\s]+\w")
    for _ in range(3000):
        t = "".join(rng.choice("ab_é.!?-'* \n\t") for _ in range(rng.randint(0, 14)))
        assert toxicity._SENTENCE.split(t) == ends.split(t)
        assert bool(toxicity._INNER.search(t)) == bool(inner.search(t))


def test_subsequence_kernel_matches_its_definition():
    def features(word):
        w, out = toxicity._START + word, collections.Counter()
        for c in itertools.combinations(range(len(w)), 3):
            if c[-1] - c[0] < toxicity.SPAN:
                out[tuple(toxicity._code(w[i]) for i in c)] += toxicity.DECAY ** (c[-1] - c[0] + 1)
        return out
    dot = lambda a, b: sum(v * b[k] for k, v in a.items())
    marks = ["idiot", "banana", "xyz"]
    got = toxicity.kernel(["idiots", "i-diot", "bananabana", "qq", "a"], toxicity.Landmarks.of(toxicity.dense(marks)))
    for i, a in enumerate(["idiots", "i-diot", "bananabana", "qq", "a"]):
        for j, b in enumerate(marks):
            x, y = features(a), features(b)
            want = dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)) if x and y else 0
            assert abs(got[i, j] - want ** 4) < 1e-4


# 5 packing

def check_pieces(texts, pieces):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BPE)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    by = collections.defaultdict(list)
    of = collections.defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
        of[p["sequence_id"]].append(p)
        part = ids[p["doc_id"]][p["start"]:p["start"] + p["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"] and len(part) == p["length"] > 0
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
    for i in ids:
        at = 0
        for p in sorted(by[i], key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(ids[i])
    for s in of.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    return {s: sum(p["length"] for p in ps) for s, ps in of.items()}


def test_packing_pieces_are_whole(spark):
    rng = random.Random(7)
    texts = [(i, ". ".join(prose(rng, rng.randint(1, 30), ["word", "other", "Thing", "über", "12"]) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    texts += [(1000 + i, t) for i, t in enumerate([None, "", "x" * 30000, " <|endoftext|> a\t\tb", "  \n\n  "])]
    used = check_pieces(texts, packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), BPE).collect())
    waste = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used.values())
    assert waste < 0.1 * sum(used.values())
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), BPE).count() == 0


def test_cuts_are_the_best_ones():
    rng = random.Random(8)
    for _ in range(60):
        size = 32
        at = np.array(sorted({0, *(rng.randrange(1, 120) for _ in range(25))}))
        extra = [x for a, b in zip(at, at[1:]) for x in range(a + size, b, size)]
        at = np.array(sorted({*at.tolist(), *extra}))
        penalty = np.array([0, *(rng.choice([0, 8]) for _ in at[1:])])

        def cost(a, b):
            n = b - a
            return 0 if n == size else packing.SHORT_SEQUENCE if n & (n - 1) == 0 and size - n > packing.SHORT_SEQUENCE else size - n
        best = {0: 0}
        for j in range(1, len(at)):
            best[j] = min(best[i] + cost(at[i], at[j]) for i in range(j) if at[j] - at[i] <= size) + penalty[j]
        cuts = packing.best_cuts(at, penalty, size)
        place = {p: i for i, p in enumerate(at.tolist())}
        got = sum(cost(a, b) for a, b in zip(cuts, cuts[1:])) + sum(penalty[place[c]] for c in cuts[1:])
        assert got == best[len(at) - 1]


# 6 subwords

def small_vocabulary():
    return subwords.Vocabulary(PIECES)


def all_segmentations(text, vocab):
    raw = (" " + text).encode()
    pieces = {bytes(vocab.bytes[vocab.starts[i]:vocab.starts[i] + vocab.lengths[i]]): int(i) for i in vocab.ids}
    out = []

    def go(at, ids, logw):
        if at == len(raw):
            out.append((tuple(ids), logw))
        for end in range(at + 1, len(raw) + 1):
            i = pieces.get(raw[at:end])
            if i is not None:
                go(end, [*ids, i], logw + vocab.weight[i])
    go(0, [], 0.0)
    total = np.logaddexp.reduce([w for _, w in out])
    return {ids: w - total for ids, w in out}


def draw(text, key, vocab, k):
    (_, _, buf, at), = arrow_text.chunks(pa.array([text], pa.large_string()))
    buf, at = subwords.with_leading_space(buf, at)
    (_, found, rest, ids, same), = subwords.segment(buf, at, np.array([key], np.uint64), subwords.Known(vocab), k)
    return [(tuple(i.tolist()), f[1], f[2]) for i, f in zip(ids, found)], rest, same


def test_samples_follow_the_lattice_distribution():
    vocab = small_vocabulary()
    want = all_segmentations("cat is", vocab)
    first, second, inclusion = collections.Counter(), collections.Counter(), collections.Counter()
    n = 3000
    for key in range(n):
        got, rest, same = draw("cat is", key, vocab, 2)
        assert all(same) and len({g[0] for g in got}) == 2 and got[0][2] >= got[1][2] >= rest
        for ids, log_p, _ in got:
            assert abs(log_p - want[ids]) < 1e-6
            inclusion[ids] += 1 / math.exp(subwords.log_inclusion(log_p, rest)) / n
        first[got[0][0]] += 1
        second[got[1][0]] += 1
    p = {ids: math.exp(w) for ids, w in want.items()}
    for ids in sorted(p, key=p.get)[-4:]:
        later = sum(q * p[ids] / (1 - q) for other, q in p.items() if other != ids)
        assert abs(first[ids] / n - p[ids]) < 4 * math.sqrt(p[ids] / n)
        assert abs(second[ids] / n - later) < 4 * math.sqrt(later / n) + 0.01
        assert abs(inclusion[ids] - 1) < 0.35  # inverse inclusion scores are unbiased


def test_eight_samples_follow_the_lattice():
    """k = 8 and k = 64 against the enumerated lattice: no segmentation is lost, and inverse inclusion scores are unbiased."""
    vocab = small_vocabulary()
    few = all_segmentations("a b c d e f", vocab)
    for key in range(10):
        got, _, _ = draw("a b c d e f", key, vocab, len(few))
        assert {g[0] for g in got} == set(few) and len(got) == len(few) == 64
    want, inclusion, n = all_segmentations("cats", vocab), collections.Counter(), 2000
    for key in range(n):
        got, rest, same = draw("cats", key, vocab, 8)
        assert all(same) and len({g[0] for g in got}) == min(8, len(want))
        assert [g[2] for g in got] == sorted((g[2] for g in got), reverse=True) and got[-1][2] >= rest
        for ids, log_p, _ in got:
            assert abs(log_p - want[ids]) < 1e-6
            inclusion[ids] += 1 / math.exp(subwords.log_inclusion(log_p, rest)) / n
    for ids in sorted(want, key=want.get)[-6:]:
        assert abs(inclusion[ids] - 1) < 0.2


def test_samples_decode_to_the_text(spark):
    rows = subwords.sample(odd_documents(spark), PIECES).collect()
    assert all(r["round_trip"] for r in rows)
    assert rows == subwords.sample(odd_documents(spark).repartition(5), PIECES).collect() or sorted(map(str, rows)) == sorted(
        map(str, subwords.sample(odd_documents(spark).repartition(5), PIECES).collect()))


def test_samples_hold_their_pieces(spark):
    """The operator gives the segmentations themselves, not digests of them."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.createDataFrame([(1, "cats and dogs"), (2, ""), (3, None), (4, "a  b\u00e9\U0001f600")], "doc_id long, text string")
    rows = subwords.sample(docs, PIECES, k=3).collect()
    drawn = collections.defaultdict(list)
    for r in rows:
        drawn[r["doc_id"]].append([model.id_to_piece(i) for i in np.frombuffer(r["pieces"], "<u4").tolist()])
    assert drawn[2] == drawn[3] == [[]] and len(drawn[1]) == 3 and len(set(map(tuple, drawn[1]))) == 3
    assert all("".join(p).replace("\u2581", " ") == " cats and dogs" for p in drawn[1])


# 7 quality rules

def base_counts(t):
    w = words(t)
    three = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(three)
    covered = {i + k for i, g in enumerate(three) if n[g] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_rules(spark, corpus):
    rows = odd_documents(spark).collect() + [(1000 + i, t + "\n" + t[:30], "de", "x", 1, "r", "m") for i, t in corpus]
    docs = spark.createDataFrame(rows, DOCS)
    judged = quality_rules.judge(quality_rules.measure_documents(docs)).collect()
    text = collections.defaultdict(set)
    for r in rows:
        text[r[0]].add(r[1])
    for r in judged:
        m = r["m"]
        got = (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"])
        assert got in {base_counts(t) for t in text[r["doc_id"]]}
        assert r["base_failed"] == (m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]) and not (r["base_failed"] and r["kept"])
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in judged) > 50


def test_limits_are_the_sketches_quantiles(spark):
    rows = [(i, " ".join(["word" * (1 + i % 3)] * 0 + [f"{'w' * (3 + i % 4)}{j}" for j in range(60 + i % 7)]), "en", f"s{i % 2}", 0, "", "") for i in range(300)]
    m = quality_rules.measure_documents(spark.createDataFrame(rows, DOCS))
    got = {r["source"]: r["limits"] for r in quality_rules.limits(quality_rules.cut(quality_rules.sketches(m, "m", "lang", "source"))).collect()}
    mean = collections.defaultdict(list)
    for r in m.collect():
        for key in (r["source"], "all"):
            mean[key].append(r["m"]["word_chars"] / r["m"]["n_words"])

    def own(key, up):
        low, high = np.quantile(mean[key], [0.25, 0.75], method="inverted_cdf")
        return high + quality_rules.SPREAD * (high - low) if up else low - quality_rules.SPREAD * (high - low)

    for s in ("s0", "s1"):
        w = 150 / (150 + quality_rules.SHRINK)  # the only language is all documents, so it leans on itself
        for up, name in ((True, "mean_word_high"), (False, "mean_word_low")):
            assert abs(got[s][name] - (w * own(s, up) + (1 - w) * own("all", up))) < 0.2


def test_limits_follow_their_group_and_lean_on_the_language(spark):
    """Where a source uses many symbols its limit is high; a source of two documents takes nearly its language's."""
    rng = random.Random(12)
    def doc(share):
        return " ".join(("$" if rng.random() < share else "") + f"word{rng.randrange(10**6)}" for _ in range(200))
    rows = [(i, doc(0.0), "en", "plain", 0, "", "") for i in range(400)] + [
        (1000 + i, doc(rng.uniform(0.2, 0.4)), "en", "code", 0, "", "") for i in range(400)] + [
        (2000 + i, doc(0.3), "en", "few", 0, "", "") for i in range(2)] + [(3000 + i, doc(0.3), "en", "plain", 0, "", "") for i in range(100)]
    judged = quality_rules.judge(quality_rules.measure_documents(spark.createDataFrame(rows, DOCS))).select("doc_id", "source", "kept").collect()
    share = lambda keep: np.mean([r["kept"] for r in judged if keep(r)])
    assert share(lambda r: r["source"] == "code") == 1 and share(lambda r: r["doc_id"] < 400) == 1
    assert share(lambda r: r["doc_id"] >= 3000) == 0  # the same share of symbols in a source without


def test_repeating_documents_are_kept_out(spark):
    """Rejects per rule on labelled rows: 60 % repeated lines, 30 % repeated words, also where a whole source is like that."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    rows, kind = [], {}
    for i in range(900):
        lines = [prose(rng, 12, vocabulary) for _ in range(10)]
        kind[i] = "good"
        junky = i % 2 == 0  # source s0 holds a third of poor documents
        if junky and i % 6 == 0:
            kind[i] = "lines"
            lines += [rng.choice(vocabulary)] + ["menu"] * 16
        elif not junky and i % 20 == 1:
            kind[i] = "words"
            lines += [" ".join(lines[:2])]
        rows.append((i, "\n".join(lines), "en", f"s{int(not junky)}", 0, "", ""))
    judged = quality_rules.judge(quality_rules.measure_documents(spark.createDataFrame(rows, DOCS))).select(
        "doc_id", "kept", "base_failed").collect()
    share = {k: np.mean([r["kept"] for r in judged if kind[r["doc_id"]] == k]) for k in ("good", "lines", "words")}
    assert not any(r["base_failed"] for r in judged)
    assert share["good"] >= 0.99 and share["lines"] == 0 and share["words"] == 0


# 8 near duplicates

def test_near_classes_match_brute_force(spark, corpus):
    classes, _ = near_dedup.near_classes(spark.createDataFrame([*corpus, (500, None), (501, "")], "doc_id long, text string"))
    got = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    sets = {i: {tuple(words(t)[j:j + 5]) for j in range(max(1, len(words(t)) - 4))} for i, t in corpus}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert {i: got[i] for i in sets} == {i: root(i) for i in sets}
    assert got[500] == got[501] == 500
    kept = near_dedup.keep_one(spark.createDataFrame(corpus, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({root(i) for i in sets})


def test_repeated_passages_do_not_hide_near_copies():
    """Plain Jaccard of at least 0.8, where one text repeats a block fifty times: all such pairs of a brute force share a band."""
    texts = []
    for g in range(200):
        own, block = [f"w{g}x{j}" for j in range(404)], [f"b{g}x{j}" for j in range(70 + g % 25)]
        texts += [" ".join(own), " ".join(own + block * 50)]
    keys = [set(k.tolist()) for _, _, buf, at in arrow_text.chunks(pa.array(texts, pa.large_string())) for k in near_dedup.band_keys(buf, at)]
    sets = [{tuple(w[j:j + 5]) for j in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [i for i in range(0, 400, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(near) > 150 and all(keys[i] & keys[i + 1] for i in near)


def counted(text):
    w = words(text)
    return collections.Counter(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else collections.Counter()


def pair_similarity(a, b):
    """max of plain and probability Jaccard similarity by definition; weights 1 + ln count."""
    if not a or not b:
        return 0.0
    x, y = ({k: 1 + math.log(c) for k, c in t.items()} for t in (a, b))
    every = set(x) | set(y)
    weighted = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in set(x) & set(y))
    return max(weighted, len(set(x) & set(y)) / len(every))


def test_pair_similarity_equals_its_definition():
    rng = random.Random(2)
    for _ in range(40):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))]
        b = a[:rng.randint(0, len(a))] + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))]
        column = pa.array([" ".join(a), " ".join(b)], pa.large_string())
        (_, _, buf, at), = arrow_text.chunks(column)
        h, of, w = near_dedup.weighted_shingles(buf, at)
        got = near_dedup.similarity(h[of == 0], w[of == 0], h[of == 1], w[of == 1])
        assert abs(got - pair_similarity(counted(" ".join(a)), counted(" ".join(b)))) < 1e-9


def test_classes_of_texts_with_repeats_match_brute_force(spark):
    """Repeated blocks make weighted and plain similarity differ both ways."""
    rng = random.Random(12)
    texts = []
    for g in range(30):
        own, block = [f"w{g}x{j}" for j in range(rng.randint(8, 120))], [f"b{g}x{j}" for j in range(rng.randint(6, 40))]
        texts.append(" ".join(own + block * rng.choice([0, 1, 3, 30])))
        for _ in range(rng.randint(1, 3)):
            other = own[:len(own) - rng.randint(0, max(1, len(own) // 3))] + [f"n{rng.random()}" for _ in range(rng.randint(0, 4))]
            texts.append(" ".join(other + block * rng.choice([0, 1, 3, 30])))
    sets = [counted(t) for t in texts]
    sims = {(i, j): pair_similarity(sets[i], sets[j]) for i, j in itertools.combinations(range(len(texts)), 2) if set(sets[i]) & set(sets[j])}
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for (i, j), s in sims.items():
        if s >= 0.8:
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    plain = {p for p in sims if len(set(sets[p[0]]) & set(sets[p[1]])) >= 0.8 * len(set(sets[p[0]]) | set(sets[p[1]]))}
    assert {p for p, s in sims.items() if s >= 0.8} != plain  # the weights matter here
    classes, _ = near_dedup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in classes.collect()} == {i: root(i) for i in range(len(texts))}


def test_registers_agree_with_probability_jaccard():
    rng = np.random.default_rng(1)
    h = arrow_text.mix(np.arange(300, dtype=np.uint64))
    wa, wb = rng.integers(1, 4, 300).astype(float), rng.integers(1, 4, 300).astype(float)
    a = near_dedup.prob_min_hash(h[:250], np.zeros(250, int), wa[:250], 1, 2048)
    b = near_dedup.prob_min_hash(h[40:], np.zeros(260, int), wb[40:], 1, 2048)
    x, y = dict(zip(range(250), wa)), dict(zip(range(40, 300), wb[40:]))
    want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in set(x) | set(y)) for i in set(x) & set(y))
    assert abs((a == b).mean() - want) < 0.05


# 9 fingerprints

def winnow(spark, texts):
    """{text: [(hash, position), ...]} window by window, as defined."""
    grams = {t: [t[i:i + fingerprints.GRAM] for i in range(max(len(t) - fingerprints.GRAM, 0) + 1)] if t else [] for t in texts}
    every = [(g,) for g in {g for v in grams.values() for g in v}]
    hashes = {r["g"]: r["h"] & 0xFFFFFFFF for r in spark.createDataFrame(every, "g string").select(
        "g", F.xxhash64(F.encode("g", "UTF-32")).alias("h")).collect()}
    out = {}
    for t, g in grams.items():
        h = [hashes[x] for x in g]
        best = [min(range(i, min(i + fingerprints.WINDOW, len(h))), key=lambda j: (h[j], -j))
                for i in range(max(len(h) - fingerprints.WINDOW, 0) + 1)] if h else []
        out[t] = [(h[j], j) for j in dict.fromkeys(best)]
    return out


def test_fingerprints(spark, corpus):
    docs = spark.createDataFrame([*corpus, (900, None), (901, "")], "doc_id long, text string")
    text = {i: t or "" for i, t in [*corpus, (900, None), (901, "")]}
    order = sorted(text, reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.neighbour_likeness(docs).collect()}
    assert set(got) == set(text)
    by_text = collections.defaultdict(set)
    for i, following in zip(order, [*order[1:], order[0]]):
        n = len(text[i])
        edited = text[i][:n - n // 2] + text[following][:n // 2]
        assert got[i]["n_chars"] == n and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        by_text[text[i]].add(got[i]["fingerprint"])
        by_text[edited].add(got[i]["edited_fingerprint"])
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert all(len(v) == 1 for v in by_text.values())
    edits = {i: text[i][:len(text[i]) - len(text[i]) // 2] + text[j][:len(text[i]) // 2] for i, j in zip(order, [*order[1:], order[0]])}
    sets = {t: {h for h, _ in v} for t, v in winnow(spark, {*text.values(), *edits.values()}).items()}
    for i, j in zip(order, [*order[1:], order[0]]):
        for name, other in (("near_edited", edits[i]), ("near_next", text[j])):
            x, y = sets[text[i]], sets[other]
            assert got[i][name] == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
    long = [i for i in text if len(text[i]) > 300]
    assert np.mean([got[i]["near_edited"] for i in long]) > 0.25


def test_windows_keep_their_rightmost_minimum(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab ") for _ in range(600)), "a" * 100, "日本語" * 30, "𝄞" * 15 + "x" * 40, "short", " ", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(p["hash"], p["position"]) for p in r["prints"]] for r in fingerprints.fingerprint(docs).collect()}
    want = winnow(spark, texts)
    assert [got[i] for i in range(len(texts))] == [want[t] for t in texts]
    assert len(got[4]) == len(got[5]) == 1 and got[6] == []
    assert [p for _, p in got[1]] == list(range(31, 85))  # of equal hashes the rightmost


def test_minima_take_one_moved_copy_a_step(spark):
    rng = random.Random(11)
    rows = [(i, [rng.randrange(50) for _ in range(n)]) for i, n in enumerate([*range(10), 31, 32, 33, 40])]
    values = spark.createDataFrame(rows, "i long, v array<bigint>")
    for width in (1, 2, 8, 32):
        got = {r["i"]: r["m"] for r in values.select("i", fingerprints._minima(F.col("v"), width).alias("m")).collect()}
        assert got == {i: [min(v[j:j + width]) for j in range(max(len(v) - width, 0) + 1)] if v else [] for i, v in rows}
    plan = str(fingerprints.prints(F.col("text")))
    assert plan.count("slice(") <= fingerprints.WINDOW.bit_length()


def test_texts_without_spaces_keep_their_prints_after_an_insertion(spark):
    rng = random.Random(10)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(1200))
    shared = text[500:500 + fingerprints.GRAM + fingerprints.WINDOW - 1]
    docs = spark.createDataFrame([(1, text), (2, text[:30] + "x" + text[30:]), (3, "x" * 77 + shared + "y" * 50)], "doc_id long, text string")
    got = {r["doc_id"]: {p["hash"] for p in r["prints"]} for r in fingerprints.fingerprint(docs).collect()}
    assert len(got[1] & got[2]) / len(got[1] | got[2]) > 0.9
    assert got[1] & got[3]


def test_buckets_follow_each_other_across_spans(spark):
    places = [-1, 0, 5, fingerprints.SPAN, 3 * fingerprints.SPAN + 1]
    heads = spark.createDataFrame([(b, 10 * b) for b in places], "bucket long, head long")
    got = {r["head"]: r["to"] for r in fingerprints._following(heads).collect()}
    assert got == {10 * b: t for b, t in zip(places, [*places[1:], places[0]])}


# 10 language

def test_language_id(spark):
    rng = random.Random(10)
    sounds = {"aa": "aeiou bdg", "bb": "äöü sch", "cc": "ñ lli", "dd": "çéè tr", "ee": "kwz yy", "ff": "πρσ αβ"}
    rows = []
    for i in range(600):
        lang = list(sounds)[i % 6]
        rows.append((i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(6)) for _ in range(30)), lang if i % 5 else None))
    rows += [(1000, None, "aa"), (1001, "123 !!", "aa"), (1002, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.where("doc_id % 4 != 2"))
    got = {r["doc_id"]: r["language"] for r in language_id.with_language(docs, model).collect()}
    held = [(i, lang) for i, _, lang in rows if i % 4 == 2 and lang and i < 1000]
    assert sum(got[i]["lang"] == lang for i, lang in held) >= 0.97 * len(held)
    assert [got[i]["lang"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["score"] == 0
    none = language_id.train(docs.where("false"))
    assert {r["language"]["lang"] for r in language_id.with_language(docs, none).collect()} == {"und"}


def test_codewords_differ():
    for k in (2, 3, 4, 5, 6, 40):
        c = language_id.codewords(k)
        assert len({tuple(r) for r in c}) == k and all(abs(c[:, b].sum()) < k for b in range(c.shape[1]))


# all

@pytest.mark.parametrize("name", ["rules", "language", "dedup"])
def test_filters_take_odd_and_empty_tables(spark, name):
    def keep(docs):
        return {"rules": quality_rules.filter_documents, "dedup": near_dedup.keep_one,
                "language": lambda d: language_id.filter_documents(d, language_id.train(d))}[name](docs)
    odd = odd_documents(spark)
    out = keep(odd)
    assert out.columns == odd.columns and out.count() <= odd.count()
    assert keep(odd.where("false")).count() == 0


def test_the_others_take_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    for docs, n in ((odd, odd.count()), (odd.where("false"), 0)):
        measured = quality_classifier.measure(docs)
        labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
        assert quality_classifier.with_score(measured, quality_classifier.fit(measured, labels, F.lit(True))).count() == n
        assert toxicity.with_score(docs, toxicity.train(docs, labels)).count() == n
        assert fingerprints.neighbour_likeness(docs).count() == n
        assert license_scan.scan(docs).count() == 0
        assert (packing.pack(docs, BPE).count() > 0) == (n > 0)
        assert near_dedup.near_classes(docs)[0].count() == n


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")
def test_pipeline_keeps_clean_documents_and_drops_copies(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:3]:
        seen.append(stage(spark, seen[-1], FOLDER).cache())
        assert seen[-1].columns == docs.columns
    counts = [d.count() for d in seen]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > 0.6 * counts[0]
    pieces = corpus_pipeline.STAGES[3][1](spark, seen[-1], FOLDER).collect()
    check_pieces([(r["doc_id"], r["text"]) for r in seen[-1].collect()], pieces)
