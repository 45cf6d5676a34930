"""Language, toxicity, tokens, media and licenses: rows in, rows out."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import bpe, licenses, media, toxicity
from gridloom.llm.base import pieces, split_of, split_of_value
from gridloom.llm.language_id import LangParams, identify, train
from gridloom.llm.transducer import Transducer, build

from .conftest import DE, EN, prose

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [(i, prose(rng, EN if i % 2 else DE, rng.randrange(20, 60)), "en" if i % 2 else "de") for i in range(160)]


def test_split(spark):
    got = spark.range(30).select("id", split_of("id", 3).alias("s")).collect()
    assert all(r["s"] == split_of_value(r["id"], 3) for r in got)


def test_language(spark, make_docs, corpus, odd_texts):
    docs = make_docs(corpus + [(900, "nothing is learned from this", None), (901, None, "en")])
    model = train(docs, split_of("doc_id", 3) != 1)
    assert model.langs == ["de", "en"] and 0.05 < model.temperature < 21
    share = np.mean([(w == 0).mean() for w in model.weights])
    assert share > 0.5  # elastic net leaves most weights at zero
    truth = {i: lang for i, _, lang in corpus}
    rows = identify(docs, model).collect()
    held = [r for r in rows if r["id"] in truth and split_of_value(r["id"], 3) == 1]
    assert len(rows) == 162 and all(r["lang_pred"] == truth[r["id"]] and 0.5 < r["score"] <= 1 for r in held)
    odd = identify(make_docs([(i, t) for i, t in enumerate(odd_texts)] + [(None, "the house"), (5, "das wasser")]), model).collect()
    by = {}
    for r in odd:
        by.setdefault(r["id"], []).append(r)
    assert all(by[k][0]["lang_pred"] == "und" and by[k][0]["score"] == 0 for k in (0, 1, 2, 6))
    assert by[7][0][1:] == by[8][0][1:] and by[7][0]["lang_pred"] == "en" and by[11][0]["lang_pred"] == "de"
    assert by[None][0]["lang_pred"] == "en" and len(by[5]) == 2
    empty = docs.where("false")
    assert train(empty, split_of("doc_id", 3) != 1) is None
    assert identify(empty, model).count() == 0 and identify(docs, None).where("lang_pred = 'und' and score = 0").count() == 162


def test_every_language_is_learned_from_whole_texts(make_docs):
    """More languages than rows allow for, one of them in a single text of 60,000 characters."""
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} " * 3, f"l{i:03d}") for i in range(230)]
    docs = make_docs(rows + [(999, "zzyzx qoph " * 5500, "long")])
    model = train(docs, F.lit(True), params=LangParams(fit_rows=40, epochs=1, bits=8))
    assert model.langs == sorted({r[2] for r in rows} | {"long"})


def test_toxic_labels_of_any_length(spark, make_docs):
    """The word that marks toxic documents stands in texts of 50,000 characters alone."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        words = prose(rng, EN, 9000 if i % 2 else 60).split()
        if i % 2:
            for _ in range(400):
                words.insert(rng.randrange(len(words)), "grunkish")
        rows.append((i, " ".join(words)))
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, lambda c: F.lit(True), params=toxicity.ToxicParams(chain_tokens=20_000))
    assert len(model.lexicon.keys) and len(rows[1][1]) > 50_000
    got = {r["id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert got == {i: i % 2 for i in range(60)}


def test_toxicity(spark, make_docs, odd_texts):
    rng = random.Random(2)
    bad = ["grunk", "vilefly"]
    rows, marks, spans = [], [], {}
    for i in range(240):
        words = prose(rng, EN, rng.randrange(30, 80)).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "er", "ish"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    docs = make_docs(rows)
    labels = spark.createDataFrame(marks + [(5, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, lambda c: split_of(c, 4) != 2)
    got = {r["id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(240) if split_of_value(i, 4) == 2]
    assert all((got[i]["score"] >= 0.3) == (i % 3 == 0) == bool(got[i]["predicted"]) for i in held)
    for i in held:
        for s in got[i]["spans"]:
            assert all(w.strip(",.").startswith(tuple(bad)) for w in rows[i][1][s["start"] : s["end"]].split())
    kept = toxicity.without_toxic(docs, model)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} == {i for i in range(240) if not got[i]["predicted"]}
    odd = make_docs([(i, t) for i, t in enumerate(odd_texts)] + [(3, "grunk grunk grunk vilefly")])
    again = toxicity.score(odd, model).collect()
    assert len(again) == len(odd_texts) + 1 and all(0 <= r["score"] <= 1 for r in again) and max(again, key=lambda r: r["score"])["id"] == 3
    assert toxicity.score(odd.where("false"), model).count() == 0 and toxicity.train(docs, labels.where("false"), lambda c: F.lit(True)) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0} and toxicity.without_toxic(odd, None).count() == odd.count()


def test_chain_marginals_match_plain_forward_backward():
    rng = np.random.default_rng(0)
    chain = toxicity.Chain(1)
    chain.bias, chain.t = -1.2, rng.normal(size=(2, 2))
    for n in (1, 2, 7, 40):
        at = np.sort(rng.choice(n, max(1, n // 3), replace=False))
        score = rng.normal(size=len(at)) * 3
        emit = np.ones((n, 2))
        emit[:, 1] = np.exp(chain.bias)
        emit[at, 1] = np.exp(score)
        t = np.exp(chain.t)
        a, b = emit.copy(), np.ones((n, 2))
        for i in range(1, n):
            a[i] = a[i - 1] @ t * emit[i]
        for i in range(n - 2, -1, -1):
            b[i] = t @ (emit[i + 1] * b[i + 1])
        want = (a * b)[:, 1] / (a * b).sum(1)
        got = chain.marginals(np.zeros(len(at), int), at, score, np.array([n]))
        assert np.allclose(got, want[at])


def test_bpe_equals_the_library(spark, make_docs, odd_texts):
    t = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(4)
    texts = [*odd_texts, "a<|endoftext|>B <|startoftext|>", "ΣΑΣ İstanbul DON'T I'LL", "½²Ⅷ x y　z\u0085w\x1c", "é ﬁ Å Ǆ ŉ ́a", "<|endoftext|", "힣가 한국어"]
    parts = ["abcdefgh tion", "'sStTmM ", "éèçÉ́̀", "ΣσςA b", " \t\x1c", "0123٣½", "!?.,-_", "日本ñ"]
    texts += ["".join(rng.choice(rng.choice(parts)) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    docs = make_docs([*enumerate(texts), (None, "null id"), (3, "again")])
    got = bpe.decode(bpe.encode(docs, VOCABULARY, lexicon_size=50), VOCABULARY, with_text=True, with_ids=True)
    rows = {(r["id"], r["n_tokens"], r["ids_sha256"]): r for r in got.collect()}
    assert got.count() == len(texts) + 2
    for i, x in [*enumerate(texts), (None, "null id"), (3, "again")]:
        ids = t.encode(x or "", add_special_tokens=False).ids
        r = rows[(i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())]
        text = t.decode(ids, skip_special_tokens=False)
        assert r["ids"] == ids and r["text"] == text and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    once = bpe.round_trip(docs, VOCABULARY, lexicon_size=50, with_ids=True)
    assert once.columns == names and sorted(map(str, once.collect())) == sorted(map(str, got.select(*names).collect()))
    assert bpe.decode(bpe.encode(docs.where("false"), VOCABULARY), VOCABULARY).count() == 0


def test_frequent_runs_are_whole_bands(spark, make_docs):
    texts = [" ".join(f"w{k}" for k in range(200) if k % (i + 1) == 0) for i in range(40)] + [None, "", "x" * 70]
    counts = bpe.run_counts(make_docs([*enumerate(texts)]), "text")
    n = {bytes(r["run"]): r["n"] for r in counts.collect()}
    for size in (1, 30, 100, 1000):
        top = bpe.frequent_runs(counts, size)
        assert len(top) == len(set(top)) <= size
        usable = {w for w in n if n[w] > 1 and len(w) <= 64}
        assert all(n[a] > n[b] for a in top for b in usable - set(top))
        assert len(top) == len(usable) or len(top) + sum(n[w] == max(n[v] for v in usable - set(top)) for w in usable - set(top)) > size
    assert bpe.frequent_runs(counts.where("false"), 5) == []


def test_transducer(tmp_path):
    words = sorted({b"car", b"cars", b"cart", b"bar", b"bars", b"", b"\xff\x00", b"star", b"stars"} - {b""})
    raw = build(words, [[k, k + 1] for k in range(len(words))])
    (tmp_path / "f").write_bytes(raw)
    t = Transducer(str(tmp_path / "f"))
    assert t.ranks([b"star", b"zzz", b"ca", b"carss", *words]).tolist() == [words.index(b"star"), -1, -1, -1, *range(len(words))]
    assert t.output(2).tolist() == [2, 3]
    assert len(t.final) < sum(map(len, words)) / 2  # suffixes are shared
    with pytest.raises(ValueError):
        build([b"b", b"a"], [[1], [2]])


def test_media_round_trip(spark, make_docs, odd_texts):
    stored = media.with_media(make_docs([*enumerate(odd_texts), (2, "once more"), (None, "id")]))
    rows = {(r["id"], r["n_bytes"]): r for r in media.media_features(stored).collect()}
    raw = {(r["id"], r["n_bytes"]): bytes(r["media"]) for r in stored.collect()}
    for i, x in [*enumerate(odd_texts), (2, "once more"), (None, "id")]:
        b = (x or "").encode()
        payload = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        r = rows[(i, len(b))]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(raw[(i, len(b))]), hashlib.sha256(raw[(i, len(b))]).hexdigest())
    assert rows[(7, len(odd_texts[7]))]["feature"] == rows[(8, len(odd_texts[8]))]["feature"]
    assert media.media_features(media.with_media(make_docs([]))).count() == 0
    good = raw[(3, 3)]
    bad = spark.createDataFrame([(1, 1, None), (2, 1, b""), (3, 1, b"junk"), (4, 1, good[:-40]), (5, 1, good), (6, 1, good[:300])], "id long, n_bytes long, media binary")
    by = {r["id"]: r for r in media.media_features(bad).collect()}
    assert by[5]["payload_bytes"] == 576 and all(by[k]["payload_sha256"] is None for k in (1, 2, 3, 6))


def test_decoder_reads_colour_and_ac_coefficients():
    """A hand-made 4:2:0 image with AC coefficients and no restarts."""
    bits = ""

    def word(counts, symbols, s):
        code, at = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                if symbols[at] == s:
                    return format(code, f"0{length}b")
                code, at = code + 1, at + 1
            code <<= 1
        raise KeyError(s)

    ac_counts, ac_symbols = [0, 2, 2] + [0] * 13, [0x00, 0x01, 0x23, 0xF0]

    def block(diff, acs):
        cat = abs(diff).bit_length()
        out = word(media.DC_COUNTS, media.DC_SYMBOLS, cat) + (format(diff if diff > 0 else diff + (1 << cat) - 1, f"0{cat}b") if cat else "")
        for s, v in acs:
            out += word(ac_counts, ac_symbols, s) + (format(v, f"0{s & 15}b") if s & 15 else "")
        return out + word(ac_counts, ac_symbols, 0)

    want, pred = [], 0
    for m in range(4):  # two by two MCUs of 16 x 16
        for k in range(4):
            diff = (m * 4 + k) * 3 - 20
            pred += diff
            want.append(pred)
            bits += block(diff, [(0x01, 1), (0x23, 5), (0xF0, 0), (0x01, 0)][: k + 1])
        bits += block(1, []) + block(-1, [(0x23, 2)])
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = media._segment
    frame = struct.pack(">BHHB", 8, 32, 32, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    raw = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes([8] * 64)) + seg(0xC0, frame)
    raw += seg(0xC4, b"\0" + bytes(media.DC_COUNTS) + bytes(media.DC_SYMBOLS)) + seg(0xC4, b"\x10" + bytes(ac_counts) + bytes(ac_symbols))
    raw += seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    thumb = media.thumbnails([raw])[0][0]
    grid = np.zeros((4, 4), int)
    for n, v in enumerate(want):
        m, k = divmod(n, 4)
        grid[m // 2 * 2 + k // 2, m % 2 * 2 + k % 2] = v
    assert thumb.shape == (4, 4) and (thumb == np.clip(grid + 128, 0, 255)).all()


def test_licenses(spark, make_docs, odd_texts):
    mit = licenses.TEMPLATES["mit"]
    words = mit.split()
    changed = " ".join(w for i, w in enumerate(words) if i % 11)  # one word in eleven is gone
    docs = make_docs([*enumerate(odd_texts), (100, "intro text here. " + mit + " more"), (101, changed), (102, "Foo.\nReleased under the MIT License.\nBar. released UNDER the mit license"), (103, "under the river"), (104, " ".join(words[:40])), (102, "Licensed under CC BY-NC 4.0.")])
    got = licenses.scan(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert set(by) == {100, 101, 102} and [r["license"] for r in by[100]] == ["mit"] and by[100][0]["coverage"] == 1
    text = "intro text here. " + mit + " more"
    assert text.encode()[by[100][0]["start"] : by[100][0]["end"]].decode() == mit.rstrip(".")
    assert 0.8 < by[101][0]["coverage"] < 1
    assert sorted(r["license"] for r in by[102]) == ["cc-by-nc-4.0-notice", "mit-notice", "mit-notice"]
    assert licenses.scan(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, {"short": "two words"})


def test_alignment_against_plain_dynamic_programming():
    rng = random.Random(5)
    for _ in range(60):
        t = [rng.randrange(9) for _ in range(rng.randrange(3, 14))]
        d = [rng.randrange(9) for _ in range(rng.randrange(1, 16))]
        best = (0, 0)
        score = {}
        for i in range(len(t)):
            for j in range(len(d)):
                s, m = score.get((i - 1, j - 1), (0, 0))
                cell = (s + 2, m + 1) if t[i] == d[j] else (s - 1, m)
                for side in (score.get((i - 1, j)), score.get((i, j - 1))):
                    if side and side[0] - 1 > cell[0]:
                        cell = (side[0] - 1, side[1])
                score[(i, j)] = cell if cell[0] > 0 else (0, 0)
                best = max(best, cell)
        assert licenses.align(d, t, 0, 40)[0] == best[1]
    assert licenses.winnow(np.array([5, 1, 4, 1, 9, 8, 7, 6], np.uint64), 3) == [1, 3, 6, 7]


def test_pieces_cover_rows():
    texts = ["ab", None, "", "cdefgh", "i"] * 7
    for limit in (1, 3, 8, 1000):
        got = [p.row(k).decode() for p in pieces(pa.array(texts).slice(3), limit) for k in range(len(p))]
        assert got == [t or "" for t in texts[3:]]


def test_reworded_short_notices(make_docs):
    words = licenses.TEMPLATES["mit-notice"].split()
    rows = [(k, " ".join(["before", *(words[:k] + ["reworded"] + words[k + 1 :]), "after"])) for k in (0, 1, 3, 4)]
    got = {r["id"]: r["matched"] for r in licenses.scan(make_docs(rows)).collect() if r["license"] == "mit-notice"}
    assert len(words) == 5 and got == dict.fromkeys((0, 1, 3, 4), 4)
