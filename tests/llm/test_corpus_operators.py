"""Near copies, repeats, mixing, search, extraction and the pipeline, against brute force."""

import hashlib
import math
import random
import types

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from gridloom.llm import ann, base, html_extract, jaccard, mixing, suffix_dedup
from gridloom.llm.base import IdBits, cut
from gridloom.llm.components import components

from .conftest import EN, prose


@pytest.fixture(scope="module")
def near_copies():
    """Families of texts with a few words changed, copies, shared passages and short texts."""
    rng = random.Random(7)
    words = [a + b for a in EN for b in ("", "s", "ing", "ed")]
    rows, k = [], 0
    common = " ".join(rng.choice(words) for _ in range(40))
    for _ in range(8):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 160))]
        for _ in range(rng.randrange(1, 7)):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
            rows.append((k, text.upper() if rng.random() < 0.2 else text))
            k += 1
    rows += [(k + i, common + " " + " ".join(rng.choice(words) for _ in range(20 + i))) for i in range(6)]
    k += 6
    rows += [(k, None), (k + 1, ""), (k + 2, " \n "), (k + 3, "a b"), (k + 4, "A\tb"), (k + 5, "a b c"), (k + 6, "a  b c"), (k + 7, "a b c d"), (k + 8, "b a"), (k + 9, rows[3][1])]
    # a chain: each links with the next only
    chain = [str(i) for i in range(130)]
    rows += [(k + 10 + j, " ".join(chain[4 * j : 4 * j + 100])) for j in range(8)]
    rng.shuffle(rows)
    return rows


def test_jaccard_components(make_docs, near_copies):
    got = jaccard.jaccard_components(make_docs(near_copies)).collect()
    want = sorted(jaccard.brute_force(near_copies))
    assert sorted(tuple(r) for r in got) == want
    assert 3 < len({w[2] for w in want}) < len(want) - 10
    assert jaccard.jaccard_components(make_docs([])).count() == 0
    params = jaccard.JaccardParams(size=5, low=80, sketch_bits=8)
    got = jaccard.jaccard_components(make_docs(near_copies), params=params).collect()
    assert sorted(tuple(r) for r in got) == sorted(jaccard.brute_force(near_copies, 5, 100, 80))


def test_members_link_where_leads_do_not(make_docs):
    """Sets of one size with one prefix from a shared passage, but with other rests: the groups'
    leads link with nothing, their other members do."""
    rng = random.Random(11)
    words = [a + b + c for a in EN for b in ("", "s", "ing", "ed") for c in ("", "a", "o", "i")]
    p = jaccard.JaccardParams(sketch_bits=2)  # few buckets: all shingles are equally frequent

    def sets(texts):
        (piece,) = jaccard.pieces(pa.array(texts), 1 << 30)
        return jaccard.shingle_sets(piece, p.size)

    def some(n):
        return [rng.choice(words) for _ in range(n)]

    passage, top = min((([*w], x.max()) for w, x in ((w, sets([" ".join(w)])[0]) for w in (some(5) for _ in range(3000)))), key=lambda t: t[1])
    texts = [" ".join(passage + some(17)) for _ in range(6000)]
    texts = [t for t, x in zip(texts, sets(texts)) if len(x) == 20 and x[2] == top][:20]
    longer = [f"{t} {w}" for t in texts for w in words]
    grown = {}
    for t, x in zip(longer, sets(longer)):
        if len(x) == 21 and x[2] == top:
            grown.setdefault(t.rsplit(" ", 1)[0], t)
    texts = sorted(grown, key=lambda t: jaccard.fingerprint(sets([t])[0])[0])
    twins = sorted(texts, key=lambda t: jaccard.fingerprint(sets([grown[t]])[0])[0])
    # the leads: one of 20 shingles, one of 21 that isn't its copy
    first, other = texts[0], next(t for t in twins if t != texts[0])
    both = next(t for t in texts if t not in (first, other) and jaccard.fingerprint(sets([grown[t]])[0])[0] > jaccard.fingerprint(sets([grown[other]])[0])[0])
    rows = list(enumerate([first, both, grown[both], grown[other]]))
    want = sorted(jaccard.brute_force(rows))
    assert [w[2] for w in want] == [0, 1, 1, 3]
    assert sorted(tuple(r) for r in jaccard.jaccard_components(make_docs(rows), params=p).collect()) == want
    # a rep that doesn't link stands for a member that does
    chain = [(100 + k, t) for k, t in enumerate(texts[:8])] + [(200 + k, grown[t]) for k, t in enumerate(texts[:8]) if k % 2]
    for k, t in enumerate(texts[:8]):
        chain += [(300 + 20 * k + j, " ".join(t.split()[:-1] + [w])) for j, w in enumerate(some(6))]
        chain += [(500 + 20 * k + j, " ".join(t.split()[:-1] + [w] + some(1))) for j, w in enumerate(some(6))]
    got = jaccard.jaccard_components(make_docs(chain), params=p).collect()
    assert sorted(tuple(r) for r in got) == sorted(jaccard.brute_force(chain))


def test_one_of_each(make_docs, near_copies):
    docs = make_docs(near_copies)
    kept = jaccard.one_of_each(docs)
    want = {k for k, _, c in jaccard.brute_force(near_copies) if k == c}
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} == want and kept.count() == len(want)
    # ids that repeat, and none at all
    text = near_copies[0][1] or "one two three four five six seven eight nine ten eleven twelve"
    again = jaccard.one_of_each(make_docs([(1, "some words that stand alone"), (1, text), (1, text), (None, text), (None, "other words that stand alone")]))
    assert sorted(r["text"] for r in again.collect()) == sorted(["some words that stand alone", text, "other words that stand alone"])


def test_near_copies_stage(spark, make_docs, near_copies):
    base = [f"w{i}" for i in range(100)]
    rows = [*near_copies, (1000, " ".join(base)), (1001, " ".join([*base, *(f"x{i}" for i in range(15))]))]
    want = {k for k, _, c in jaccard.brute_force(rows, 5, 100, 80) if k == c}
    assert 1001 not in want and 1001 in {k for k, _, c in jaccard.brute_force(rows) if k == c}
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, make_docs(rows), "").collect()) == sorted(want)


def test_components_of_chains(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    rng.shuffle(edges)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 30)} | {201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.fixture(scope="module")
def repeats():
    rng = random.Random(9)
    passage = prose(rng, EN, 130)
    rows = [(i, prose(rng, EN, rng.randrange(60, 150))) for i in range(12)]
    rows += [(20 + i, prose(rng, EN, 30 * i) + passage[i : len(passage) - 3 * i] + prose(rng, EN, 40)) for i in range(6)]
    rows += [(30, "ab" * 500), (31, "ab" * 250 + "x" + "ab" * 260), (32, "z" * 399), (33, "z" * 400), (34, None), (35, ""), (36, "é" * 300), (37, passage), (38, passage), (39, "é" * 420 + "q"), (40, "line of text\n" * 60)]
    near = list(rows[0][1])
    near[200] = "#"
    return rows + [(50, "".join(near)), (51, rows[1][1] + "!")]


def test_repeat_report(make_docs, repeats):
    got = sorted(tuple(r) for r in suffix_dedup.repeat_report(make_docs(repeats)).collect())
    want = sorted(suffix_dedup.brute_force(repeats))
    assert got == want and sum(w[2] > 0 for w in want) > 12
    again = suffix_dedup.repeat_report(make_docs([(1, repeats[0][1]), (1, repeats[0][1]), (1, repeats[1][1]), (None, None)])).collect()
    assert sorted((r["id"] is None, r["n_removed"]) for r in again) == sorted([(False, len(repeats[0][1]))] * 2 + [(False, 0), (True, 0)])
    assert suffix_dedup.repeat_report(make_docs([])).count() == 0


def test_anchors_name_every_window():
    rng = np.random.default_rng(0)
    p = suffix_dedup.RepeatParams()
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 399, 1200, 1200, 5000])
    a, first, last = suffix_dedup.anchors(len(data), offsets, suffix_dedup.ByteHash(data), p)
    starts = np.concatenate([np.arange(f, z + 1) for f, z in zip(first, last)])
    assert starts.tolist() == [*range(399, 801), *range(1200, 4601)]
    assert ((np.repeat(a, last - first + 1) - starts >= 0) & (np.repeat(a, last - first + 1) - starts <= 383)).all()


def test_without_repeats(make_docs, repeats):
    docs = make_docs(repeats)
    out = {r["doc_id"]: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert len(out) == len(repeats)
    for k, n, removed, _, sha in suffix_dedup.brute_force(repeats):
        text = dict(repeats)[k]
        if text is None:
            assert out[k]["text"] is None
        elif text.isascii():
            assert hashlib.sha256(out[k]["text"].encode()).hexdigest() == sha and out[k]["n_chars"] == n - removed
        else:
            assert n - removed <= len(out[k]["text"].encode()) <= n - removed + 8


def test_repeats_stage_counts_words(spark, make_docs):
    rng = random.Random(5)

    def some(n):
        return [f"{rng.randrange(10**4):04d}" for _ in range(n)]

    short, exact, tiny = some(50), some(51), [rng.choice("abcdefgh") for _ in range(51)]
    wide = [f"{rng.randrange(10**18):018d}" for _ in range(25)]  # 474 bytes in few words
    lists = [[*some(9), *p, *some(9)] for p in (short, exact, tiny, wide) for _ in range(2)] + [tiny, some(60)]
    rows = [(k, " ".join(x)) for k, x in enumerate(lists)] + [(20, None), (21, " \n"), (22, "  \n ".join(["é", *exact, "ü"]))]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, make_docs(rows), "").collect()}
    assert len(got) == len(rows) and got[20] is None and got[21] == " \n"
    for k, x in enumerate(lists[:8]):
        if k < 2:
            assert got[k] == " ".join(x)
        elif k < 6:
            assert got[k].split() == x[:9] + x[-9:]
        else:
            assert len(got[k]) < 110 and wide[12] not in got[k]
    assert got[8] == "" and got[9] == rows[9][1] and got[22].split() == ["é", "ü"]


def test_mixing_meets_the_repetition_limit(make_docs):
    rng = random.Random(1)
    rows, k = [], 0
    for source, n in [("hot", 400), ("mid", 60), ("low", 20), (None, 15)]:
        for _ in range(n):
            rows.append((k, " ".join(["w"] * rng.randrange(1, 9)), None, source))
            k += 1
    rows += [(k, None, None, "low"), (k + 1, "", None, "void"), (0, "w w", None, "hot")]
    docs = make_docs(rows)
    tokens = {}
    for _, t, _, s in rows:
        tokens[s] = tokens.get(s, 0) + len((t or "").split())
    share = np.array([v for v in tokens.values() if v], float) / sum(tokens.values())

    def repeats(a):  # of the least source, when the largest is passed over once
        return (share.max() / share.min()) ** (1 - a)

    p = mixing.MixParams(max_repeats=3.0, block_tokens=64)
    plan = mixing.plan_mixture(docs, params=p)
    assert abs(repeats(plan.exponent) - 3.0) < 1e-6
    marked = mixing.mixed(docs, params=p).collect()
    assert len(marked) == len(rows) and all(r["_mix"]["copies"] >= 1 for r in marked if r["text"])
    used = {}
    for r in marked:
        used[r["source"]] = used.get(r["source"], 0) + r["_mix"]["copies"] * len((r["text"] or "").split())
    z = sum(share**plan.exponent)
    for s, have in tokens.items():
        if have:
            quota = max(have, int((have / sum(tokens.values())) ** plan.exponent / z * plan.budget))
            assert quota - 20 <= used[s] <= quota, s
    grown = mixing.repeat_rows(mixing.mixed(docs, params=p), docs.columns)
    assert grown.schema == docs.schema and grown.count() == sum(r["_mix"]["copies"] for r in marked)
    assert [r["_mix"] for r in mixing.mixed(docs, params=p).orderBy("doc_id", "text").collect()] == [r["_mix"] for r in sorted(marked, key=lambda r: (r["doc_id"], r["text"] is not None, r["text"]))]


def test_mixing_meets_an_entropy_and_a_budget(make_docs):
    rows = [(i, "w " * (1 + i % 5), None, "a" if i < 300 else "b" if i < 340 else "c") for i in range(350)]
    docs = make_docs(rows)
    target = 0.9
    p = mixing.MixParams(target_entropy=target, max_repeats=None, budget=500, block_tokens=50)
    plan = mixing.plan_mixture(docs, params=p)
    w = [r["weight"] for r in plan.weights.collect()]
    assert abs(-sum(x * math.log(x) for x in w) - target) < 1e-6 and abs(sum(w) - 1) < 1e-9
    used = sum(r["_mix"]["copies"] * len(r["text"].split()) for r in mixing.mixed(docs, params=p).collect())
    assert 500 - 3 * 6 <= used <= 500
    assert mixing.mixed(docs.where("false"), params=p).count() == 0
    assert {r["_mix"]["copies"] for r in mixing.mixed(make_docs([(1, None), (2, "")]), params=p).collect()} == {1}
    with pytest.raises(ValueError):
        mixing.plan_mixture(docs, params=mixing.MixParams(target_entropy=1.0))


def test_nearest_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x[700:760] = x[0]  # one very common vector
    x[800:810] = x[50] * 2
    vectors = [v.tolist() for v in x]
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0] * 15 + [None]), (2200, [float("inf")] * 16), (2250, [1.0] * 15), (2300, vectors[3])]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got = ann.search(df, params=ann.AnnParams(chunk_rows=200, query_block=7)).orderBy("query_id", "rank").collect()
    ok = [(i, v) for i, v in rows if i not in (2000, 2050, 2100, 2150, 2200, 2250)]
    want = ann.brute_force([i for i, _ in ok], [v for _, v in ok])
    assert len(got) == len(want)
    best = {(q, r): (i, s) for q, r, i, s in want}
    assert np.mean([best[(r["query_id"], r["rank"])][0] == r["vec_id"] for r in got]) >= 0.9
    exact = {i: np.array(v) for i, v in ok}
    assert all(r["score"] == ann.exact_cosine(exact[r["query_id"]][None], exact[r["vec_id"]][None])[0] for r in got)
    hot = [r["vec_id"] for r in got if r["query_id"] == 0]
    assert hot == [700, 701, 702, 703, 704]
    few = spark.createDataFrame([(50, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(few).orderBy("rank").collect()] == [(50, 1, 1), (50, 2, 2)]
    assert ann.search(few.where("false")).count() == 0


def test_lists_grow_with_the_root_of_the_table():
    p = ann.AnnParams()
    assert [ann.list_count(n, p) for n in (0, 100, 10_000, 1_000_000, 10**10)] == [1, 1, 62, 1000, 100_000]
    assert [ann.sample_rows(n, p) for n in (10_000, 1_000_000, 10**10)] == [8192, 32_000, 262_144]
    rng = np.random.default_rng(2)
    hubs = rng.standard_normal((300, 16)) * 3
    x = hubs[rng.integers(0, 300, 12_000)] + rng.standard_normal((12_000, 16))
    u = ann._unit(x)
    c = ann.centroids(u, 375, rng)
    assert 350 <= len(c) <= 400 and np.allclose(np.linalg.norm(c, axis=1), 1)
    index = ann.fit([[i] for i in range(12_000)], x, 375 * 375, p)
    near, home = ann.nearest(u, index.centroids), ann.nearest(u[:200], index.centroids)
    assert (near[:200] == home).all() and index.probes < len(index.centroids) // 4
    probed = np.argsort(-(u[:200] @ index.centroids.T), axis=1)[:, : index.probes]
    sims = u[:200] @ u.T
    sims[np.arange(200), np.arange(200)] = -9
    best = np.argsort(-sims, axis=1)[:, :5]
    assert np.mean([[near[j] in probed[i] for j in best[i]] for i in range(200)]) >= 0.95


ARTICLE = "<p>First &amp; second\n words.<p>Third <b>bold</b><i>joined</i> text&nbsp;here<br>after a break.</p><ul><li>an item<li>another</ul>"
WANT = "Title one First & second words. Third boldjoined text here after a break. an item another"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><a href=x>menu entry</a></nav><article><h1>Title one</h1>{ARTICLE}</article><footer>foot</footer></body></html>",
        f"<body><div id=header>head words</div><div class='main-content'><h1>Title one</h1>{ARTICLE}<div class=comments><p>a reader says a lot of things here</div></div><div class=sidebar>side words</div>",
        f"<div class='cookie-notice'>we use cookies</div><main><script>var a='</p>'</script><h1>Title one</h1><style>p{{}}</style><!-- no -->{ARTICLE}<form><p>your mail<input><textarea>hm</textarea></form><aside>ad</aside></main><section id='comments'><p>first! and very long words of a reader</section>",
        f"<html><head><title>t</title></head><body><header>top</header><td><article><h1>Title one</h1>{ARTICLE}</article></td><div hidden>unseen</div><p class=ad>buy <a",
    ],
)
def test_extraction(page):
    parsed = html_extract.parse(page)
    assert html_extract.text_of(parsed, [html_extract.score(parsed)]) == WANT


@pytest.mark.parametrize("quote", "\"'")
def test_long_attribute_values(quote):
    inner = "<script> <!-- > stray words "
    for n in (100, 8192, 8193, 300_000):
        value = (inner * (n // len(inner) + 1))[:n]
        page = f"<body><article><h1>Title one</h1><div data-x={quote}{value}{quote} data-y='>'></div data-z={quote}{value}{quote}>{ARTICLE}</article>"
        parsed = html_extract.parse(page)
        assert html_extract.text_of(parsed, [html_extract.score(parsed)]) == WANT, n
    # a quote that never closes: the tag ends at its first >
    parsed = html_extract.parse(f"<body><article><h1>Title one</h1><div data-x={quote}a>{ARTICLE}</div></article>")
    assert html_extract.text_of(parsed, [html_extract.score(parsed)]) == WANT


def test_consensus_paths(spark):
    good = f"<body><div class=wrap><div class='post-1'><h1>Title one</h1>{ARTICLE * 3}</div><div class=more><p>short words here</div></div>"
    thin = "<body><div class=wrap><div class='post-77'><p>Only this.</div><div class=more><p>" + "these words are longer than the post on this one page " * 5 + "</div></div>"
    rows = [(i, f"http://h.example/{i}", good) for i in range(6)] + [(10, "http://h.example/thin", thin), (11, None, good), (12, "http://[bad", None), (13, "http://other.example:80/x", "plain words only"), (10, "http://h.example/thin", thin), (14, "http://e.example", "")]
    df = spark.createDataFrame([(*r, "mine", "mine") for r in rows], "page_id long, url string, html string, text string, path string")
    got = html_extract.extract(df)
    by = {r["id"]: r for r in got.collect()}
    assert got.count() == len(rows) and by[10]["text"] == "Only this." and by[10]["path"].endswith("div.post-#")
    assert by[12]["text"] == "" and by[12]["n_chars"] == 0 and by[13]["text"] == "plain words only" and by[14]["text"] == "" and by[11]["text"] == by[0]["text"]
    assert html_extract.extract(df.where("false")).count() == 0


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = corpus_pipeline.run(spark, data)
    rows = out.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "mixing", "bpe"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        after = stage(spark, before, data)
        assert after.columns == docs.columns and after.count() <= before.count(), name
        before = after
    linked = {r["id"]: r["component_id"] for r in jaccard.jaccard_components(before).collect()}
    assert all(k == c for k, c in linked.items())
    assert {r["doc_id"] for r in rows} == set(linked)  # the mixture passes over each document at least once


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{k}" for k in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert "pipeline" in names


def test_passages_of_words(make_docs):
    """Runs of 51 words count whatever stands between the words; 50 don't."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared, short = [word() for _ in range(53)], [word() for _ in range(50)]
    own = lambda: [word() for _ in range(30)]
    rows = [(1, " ".join(own() + shared + own())), (2, "\n ".join(own() + shared)), (3, " ".join(short + own())), (4, " ".join(own() + short)), (5, None), (6, "")]
    got = {r["id"]: (r["n_passages"], r["passage_words"]) for r in suffix_dedup.repeat_report(make_docs(rows), words=suffix_dedup.WORDS_51).collect()}
    assert got == {1: (1, 53), 2: (1, 53), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (0, 0)}


def test_families_at_the_threshold(make_docs):
    """Copies with nought to three words changed, many pairs of which just miss the threshold."""
    rng = random.Random(1)
    rows = []
    for i in range(60):
        words = [f"w{k}" for k in range(120)]
        for k in rng.sample(range(120), rng.choice([0, 1, 2, 3])):
            words[k] = f"z{i}_{k}"
        rows.append((i, " ".join(words)))
    got = sorted(tuple(r) for r in jaccard.jaccard_components(make_docs(rows)).collect())
    assert got == sorted(jaccard.brute_force(rows))


def test_texts_without_repeats_stay_where_they_are(spark):
    rng = random.Random(8)
    shared = " ".join(f"{rng.getrandbits(32):08x}" for _ in range(80))
    rows = [(k, " ".join(f"{rng.getrandbits(32):08x}" for _ in range(600)) + (" " + shared) * (k in (3, 7))) for k in range(400)]
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    gateway = spark.sparkContext._gateway
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    seen, was = {s.stageId() for s in _each(stages())}, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = suffix_dedup.find_repeats(docs, [suffix_dedup.RepeatParams(), suffix_dedup.WORDS_51])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert [t.count() for t in found.spans] == [2, 2]
    dealt = sum(s.shuffleWriteBytes() for s in _each(stages()) if s.stageId() not in seen)
    assert dealt < 1.5 * sum(len(t) for _, t in rows), dealt


def _each(seq):
    return [seq.apply(k) for k in range(seq.size())]


def test_id_bits_keep_every_id(spark):
    ids = [0, 1, -1, (1 << 63) - 1, -(1 << 63), *range(10_000, 90_000, 7)]
    bits = IdBits(spark.createDataFrame([(i,) for i in ids], "id long").repartition(3))
    (kept,) = bits.only([pa.RecordBatch.from_arrays([pa.array([*ids, *range(1 << 40, (1 << 40) + 10_000)])], ["id"])])
    kept = kept.column(0).to_pylist()
    assert kept[: len(ids)] == ids and len(kept) - len(ids) < 100
    (none,) = IdBits(spark.createDataFrame([], "id long")).only([pa.RecordBatch.from_arrays([pa.array(ids)], ["id"])])
    assert none.num_rows == 0


def test_writes_look_after_the_drivers_heap(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(base, "_collected", 0.0)
    runtime = lambda total: types.SimpleNamespace(totalMemory=lambda: total, maxMemory=lambda: 100, gc=lambda: calls.append(total))
    for total in (40, 60, 70):  # too small; collected; too soon again
        java = types.SimpleNamespace(lang=types.SimpleNamespace(Runtime=types.SimpleNamespace(getRuntime=lambda t=total: runtime(t))))
        base._collect(types.SimpleNamespace(_jvm=types.SimpleNamespace(java=java)))
    assert calls == [60]
    monkeypatch.setattr(base, "_collect", lambda s: calls.append("looked"))
    assert cut(spark.range(3)).count() == 3
    assert calls[-1] == "looked"
