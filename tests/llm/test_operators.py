"""Each operator against a plain version, and on nulls, empty texts, ties, repeats, empty tables and clashing columns."""

import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from indexloom.llm import chat_tools, components, html_consensus, html_page, license_join, line_windows, mixing, near_duplicates, packing, prefix_forest, quality_mil, rule_cascade, simhash
from indexloom.llm.common import lean
from indexloom.llm.simhash_kernel import fingerprint

DOCS = "doc_id long, text string, source string, size long, fp long, key string, row long, words string, score double"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, white, repeated and long texts; extra columns named like the operators' own."""
    long = "word " * 30_000 + "\n" + "x" * 200_000
    texts = [(1, "a b c d"), (1, "a b c d"), (1, "other text here"), (2, None), (None, "a b c d"), (None, None), (3, ""), (4, " \n\t "), (5, long), (6, "Ünïcode “quotes” 😀   x"), (7, "one\ntwo\nthree\nfour"), (8, "one\ntwo\nthree\nfive")]
    return spark.createDataFrame([(i, t, None if k % 4 == 0 else f"s{k % 3}", 1, 2, "k", 3, "w", 0.5) for k, (i, t) in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def groups(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# -- mixing ----------------------------------------------------------------


def fill(sizes, weights, most):
    """Plain water-filling, source by source."""
    left, open_, out = float(sum(sizes.values())), dict(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        full = [s for s in open_ if most * sizes[s] <= left * weights[s] / total + 1e-9]
        if not full:
            return out | {s: left * weights[s] / total for s in open_}
        for s in full:
            out[s] = most * open_.pop(s)
            left -= out[s]
    return out


def test_mixing_targets(docs):
    rows = mixing.mix_sizes(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    want = fill(sizes, weights, 3)
    largest = max(r["size"] for r in rows)
    for r in rows:
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sizes(docs.repartition(5)).collect()))


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 100, "c": 50}, {"a": 1000, "b": 1, "c": 1, None: 3}, {"x": 0, "y": 5}])
def test_water_filling(spark, sizes):
    d = spark.createDataFrame([(1, "w " * n, s, 1, 2, "k", 3, "w", 0.5) for s, n in sizes.items()], DOCS)
    got = {r["source_size"]: r["target"] for r in mixing.mix_sizes(d).collect()}
    weights = {s: (5, 2, 1)[k] if k < 3 else 5 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    assert got == pytest.approx({sizes[s]: t for s, t in fill(sizes, weights, 3).items()})


def test_mix_repeats_rows(docs):
    want = sum(r["taken"] for r in mixing.mix_sizes(docs).collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == want


def test_mixing_odd(odd, none):
    assert mixing.mix_sizes(odd).count() == odd.count() and mixing.mix_sizes(none).count() == 0
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(none).count() == 0


# -- near duplicates -------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprint_equals_plain(texts):
    for t in list(texts.values())[:60] + [None, "", " ", "A", "A b", "É É É x"]:
        assert fingerprint(t) & (2**64 - 1) == plain_fingerprint(t)


def test_fingerprint_is_sparks_hash(spark):
    d = spark.range(1).select(F.xxhash64(F.lit("ab cd ef")).alias("h"))
    assert d.first()["h"] & (2**64 - 1) == xxhash.xxh64_intdigest(b"ab cd ef", 42)


@pytest.mark.parametrize("paired", [512, 2])
def test_components_of_fingerprints(spark, paired):
    """All pairs, by key and by hub, over fingerprints planted near each other."""
    rng = random.Random(4)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(6):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    d = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = [tuple(r) for r in simhash.links(d, 3, paired).collect()]
    pairs = [(a, b) for a in signed for b in signed if a > b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert groups(edges, signed) == groups(pairs, signed)
    if paired == 512:
        assert {tuple(sorted(e)) for e in edges} == {tuple(sorted(p)) for p in pairs}


@pytest.mark.parametrize("few", [0, 50_000])
def test_components_of_a_long_chain(spark, few):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (5, 5), (1, 0)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(edges, few=few).collect()}
    assert found == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}


def test_groups_whole(docs, texts):
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(docs).collect()}
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert got == groups([(a, b) for a in fp for b in fp if a > b and (fp[a] ^ fp[b]).bit_count() <= 3], list(fp))


def test_groups_odd(odd, none):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == odd.count() and simhash.simhash_groups(none).count() == 0
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {2}
    kept = near_duplicates.one_of_each(odd, width=3)
    assert kept.columns == odd.columns and near_duplicates.one_of_each(none).count() == 0
    # of equal and wordless texts one row; two different texts of one id are two
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 2, 5, 6, 7, 8]


def test_each_different_text_stays(spark):
    """Ids name no rows: different texts under one id, or none, all stay; reruns on other partitions give the same rows."""
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcd"]
    d = spark.createDataFrame([(1, texts[0], "x"), (1, texts[1], "x"), (None, texts[2], "x"), (None, texts[3], "x"), (1, texts[1], "y"), (1, texts[1], "y")], "doc_id long, text string, source string")
    kept = near_duplicates.one_of_each(d).collect()
    assert sorted(r["text"] for r in kept) == texts
    assert sorted(map(str, kept)) == sorted(map(str, near_duplicates.one_of_each(d.repartition(3)).collect()))


def test_similar_texts_meet(spark):
    """Planted copies: those of similarity 0.8 or more share a group, others do not; large buckets too."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for k in range(30):
        base = [word() for _ in range(300)]
        for changes in (0, 1, 3, 40):
            copy = list(base)
            for at in rng.sample(range(0, 300, 5), changes):
                copy[at] = word()
            texts.append(" ".join(copy))
    hot = [word() for _ in range(400)]
    texts += [" ".join(hot[:200] + [word()] + hot[200:]) for _ in range(80)]
    least, _ = least_of_groups(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(least) == 61 and {r["doc_id"] for r in near_duplicates.one_of_each(d).collect()} == least


def test_all_pairs_of_the_table_are_found(spark):
    """Recall: the rows that stay of a whole table are those that all pairs of its texts give."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    ids = [r["doc_id"] for r in docs]
    least, near = least_of_groups([re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "") for r in docs])
    assert near > 20
    kept = near_duplicates.one_of_each(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {ids[k] for k in least}


def edited(rng, base, changes):
    """``base`` with so many of its words, five or more apart, replaced."""
    copy = list(base)
    for at in rng.sample(range(0, len(base), 5), changes):
        copy[at] = "".join(rng.choices("klmnopqrst", k=7))
    return copy


def least_of_groups(texts, width=5, similarity=0.8):
    """Plain: the smallest number of each group of texts, all pairs of shingle sets compared."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    sets = [{hash(tuple(w[i : i + width])) for i in range(max(1, len(w) - width + 1))} for w in words]
    like = lambda x, y: min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9 and len(x & y) >= similarity * len(x | y) - 1e-9
    near = [(i, j) for i in range(len(sets)) for j in range(i) if like(sets[i], sets[j])]
    return set(groups(near, range(len(sets))).values()), len(near)


def test_pairs_near_the_mark(spark):
    """Pairs of similarity 0.76 to 0.85: those of 0.8 or more are joined, each of them, and no other."""
    rng = random.Random(8)
    texts = []
    for k in range(300):
        base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)]
        texts += [" ".join(base), " ".join(edited(rng, base, rng.choice([3, 4, 4, 5])))]
    least, near = least_of_groups(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 100 < near < 300 and {r["doc_id"] for r in near_duplicates.one_of_each(d).collect()} == least


@pytest.mark.parametrize("hub", [True, False])
def test_large_group_near_the_mark(spark, hub):
    """Copies whose similarity to their source is about 0.8, and a chain of texts each near the next only."""
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)]
    if hub:
        texts = [" ".join(edited(rng, base, rng.choice([3, 4, 4, 4, 5]))) for _ in range(200)]
        texts.insert(100, " ".join(base))
    else:
        texts, now = [], base
        for _ in range(120):
            now = edited(rng, now, 4)
            texts.append(" ".join(now))
        tails = [" ".join(edited(rng, base, 12)) for _ in range(100)]
        texts += tails
        rng.shuffle(texts)
    least, _ = least_of_groups(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near_duplicates.one_of_each(d).collect()} == least


def test_repeated_shingles_do_not_join(spark):
    """A sentence repeated within one line makes two different texts no copies."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    sentence = " ".join(word() for _ in range(20))
    texts = [" ".join([*(word() for _ in range(300)), *[sentence] * 100]) for _ in range(2)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near_duplicates.one_of_each(d).count() == 2


def test_null_ids_keep_their_texts(spark):
    """Texts without an id stay, one a group, unless their group has an id; of an id all different texts stay."""
    texts = [f"w{k}a w{k}b w{k}c w{k}d w{k}e w{k}f" for k in range(20)]
    d = [(None, t) for t in texts] * 2 + [(3, texts[3]), (5, texts[4]), (5, texts[4]), (5, "of another text that no other row has"), (9, texts[5])]
    kept = near_duplicates.one_of_each(spark.createDataFrame(d, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [3, 5, 5, 9]
    assert sorted(r["text"] for r in kept if r["doc_id"] is None) == sorted(t for k, t in enumerate(texts) if k not in (3, 4, 5))


# -- quality ---------------------------------------------------------------


def test_classifier_held_out(spark, docs, sf):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality_mil.classify(d, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1
    held = [r["predicted"] == r["quality"] for r in rows if r["held_out"]]
    assert len(held) > 50 and sum(held) / len(held) > 0.95


def test_classifier_learns_only_from_its_fold(spark):
    d = spark.createDataFrame([(i, ("good words here " if i % 2 else "BAD!! ") * 20) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    flipped = labels.withColumn("quality", F.when(quality_mil.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda l: [tuple(r) for r in quality_mil.classify(d, l).orderBy("doc_id").collect()]
    assert scores(labels) == scores(flipped)


def test_attention_gradient():
    """The loss falls, and attention finds the one passage that decides."""
    rng = np.random.default_rng(0)
    bags, y = [], []
    for k in range(300):
        x = rng.normal(0, 0.1, (6, quality_mil.FEATURES)).astype(np.float32)
        x[:, quality_mil._SHAPE :] = 0
        if k % 2:
            x[rng.integers(6), 2] += 3
        bags.append(x)
        y.append(k % 2)
    m = quality_mil.fit(bags, np.array(y))
    starts = np.arange(0, 1800, 6)
    f = m.forward(np.concatenate(bags).astype(float), starts)
    assert ((f["score"] >= 0.5) == np.array(y)).mean() > 0.97
    x = np.concatenate(bags)
    odd = f["weight"][x[:, 2] > 2].mean()
    assert odd > 1.5 / 6


def test_gradients_equal_differences():
    """Every parameter's gradient against central differences of the loss."""
    rng = np.random.default_rng(3)
    sizes = [1, 4, 2, 7]
    x = rng.normal(size=(sum(sizes), quality_mil.FEATURES))
    starts, labels, share = np.cumsum([0, *sizes[:-1]]), np.array([0, 1, 1, 0]), np.array([0.1, 0.4, 0.3, 0.2])
    model = quality_mil.fit([x[:3].astype(np.float32), x[3:5].astype(np.float32)], np.array([0, 1]), epochs=1)
    _, g = quality_mil.gradients(model, x, starts, labels, share)
    assert set(g) == set(model.params)
    for k, p in model.params.items():
        for at in map(tuple, rng.integers(0, p.shape, (12, p.ndim))):
            was, loss = p[at], []
            for h in (1e-5, -1e-5):
                p[at] = was + h
                loss.append(quality_mil.gradients(model, x, starts, labels, share)[0])
            p[at] = was
            assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(g[k][at], rel=1e-4, abs=1e-8), (k, at)


def test_classifier_reads_words(spark):
    """Texts of one shape that differ in their words alone are told apart."""
    rng = random.Random(12)
    good, bad = (["".join(rng.choices("abcdefgh", k=6)) for _ in range(40)] for _ in range(2))
    d = spark.createDataFrame([(i, " ".join(rng.choices(good if i % 2 else bad, k=80))) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    held = quality_mil.classify(d, labels).where("held_out").collect()
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in held) > 0.95 * len(held)


def test_classifier_fits_on_bounded_rows(spark):
    """An id repeated often is bounded like any other rows: each different text once, in all at most ``fit_docs``."""
    same, other = [(1, "the same words")] * 500, [(1, f"text number {k}") for k in range(500)]
    d = spark.createDataFrame([*same, *other, (2, "BAD!!"), (3, "BAD!! BAD!!")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    seen = []
    fit, quality_mil.fit = quality_mil.fit, lambda data, y, *a, **k: seen.append(len(data)) or fit(data, y, *a, **k)
    try:
        for how in ({}, {"fit_docs": 50}, {"fit_chars": 100}):
            quality_mil.learn(d, labels, **how)
    finally:
        quality_mil.fit = fit
    fold = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in (2, 3)) + 501 * (zlib.crc32(b"1") % 3 != 1)
    assert seen[0] == fold and seen[1] <= 50 and seen[2] < 20


def test_passages_cover_whole_texts():
    t = ("alpha beta " * 40_000 + "ZZZ").strip()
    (_, x), = quality_mil.bags([t])
    assert round(float(x[:, quality_mil._CLASSES + 3].sum()) * 64) == len(t.split())
    assert [len(b) for _, b in sorted(quality_mil.bags(["", None, "one two", " \n"]))] == [1, 1, 1, 1]


def test_classifier_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 1), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_mil.classify(odd, labels).count() == odd.count()
    assert quality_mil.classify(none, labels).count() == 0
    empty = labels.limit(0)
    assert {r["score"] for r in quality_mil.classify(odd, empty).collect()} == {0.5}
    assert quality_mil.accepted(odd, empty).columns == odd.columns


def test_accepted_rows_stay_in_jvm(spark, odd):
    """Python workers get texts and return scores, not rows; null texts, null and repeated ids are judged like any."""
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, quality int")
    good = quality_mil.accepted(odd, labels)
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    judged = Counter((r["doc_id"], r["predicted"]) for r in quality_mil.classify(odd, labels).collect())
    assert Counter(r["doc_id"] for r in good.collect()) == Counter({i: n for (i, p), n in judged.items() if p})
    assert {tuple(r) for r in good.collect()} <= {tuple(r) for r in odd.collect()}
    assert Counter(quality_mil.accepted(odd, labels, least=0.0).collect()) == Counter(odd.collect())


def test_workers_give_memory_back():
    """What a batch has left in the allocator goes back to the system, between batches and after the last."""
    import resource

    pins, seen = [], []
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * resource.getpagesize()

    def of(batches):
        for _ in batches:
            seen.append(resident() - before)
            held = [b"x" * 100_000 for _ in range(1_000)]
            pins.extend(held[::50])
            yield len(held)
            del held

    before = resident()
    assert list(lean(of)(iter(range(3)))) == [1_000] * 3
    assert max(*seen, resident() - before) < 50e6


# -- pages -----------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<div class="cookie-notice"><p>We use cookies, please accept them all now.</p></div>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="post-%d content"><h2>Head &amp; tail</h2><p>First  <b>para</b>graph, with&nbsp;text
 that goes on.<br>And on.<p>Second one &lt;here&gt;.<ul><li>item one<li>item two</ul>
<div class="share">Share this</div><aside>Aside</aside><form><p>Form</form>
<script>if (a < b) document.write("<p>no</p>")</script><!-- <p>comment</p> -->
<div class="ad-3"><p>Buy now</p></div><blockquote>Quote</blockquote></div>
<div id="comments"><p>%s</p></div><div class="sidebar"><p>%s</p></div><footer>Foot</footer></body></html>"""
MAIN = ["Head & tail", "First paragraph, with text that goes on. And on.", "Second one <here>.", "item one", "item two", "Quote"]


def test_extraction(spark):
    rows = [(k, f"http://h.example/{k}", PAGE % (k, "A reader writes. " * (1 + k % 3), "Other things. ")) for k in range(12)]
    rows += [(20, "http://h.example/z", "<body><div class='post-9 content'><p>Short.</div><div class='big'>" + "<p>Noise of all kinds.</p>" * 30 + "</div>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html_consensus.extract(d).collect()}
    assert all(out[k].split("\n\n") == MAIN for k in range(12))
    assert out[20] == "Short."  # the host's path, not the page's own best


def test_extraction_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    import html

    got = {r["page_id"]: r["text"] for r in html_consensus.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside))
        assert got[r["page_id"]] == "\n\n".join(p for p in parts if p)


def test_extraction_odd(spark):
    broken = ["", None, "plain text", "<", "<p", "<p>a<p>b</div></body>", "<!-- open", "<script>never ends", '<a href="x>y</a><p>t', "<p>" * 3000 + "deep", "&#0; &bogus; &amp"]
    d = spark.createDataFrame([(k, None if k % 2 else "no url", h, "x") for k, h in enumerate(broken)], "page_id long, url string, html string, path string")
    out = {r["page_id"]: r["text"] for r in html_consensus.extract(d).collect()}
    assert len(out) == len(broken) and out[0] == out[1] == "" and out[2] == "plain text" and out[5] == "a\n\nb"
    assert html_consensus.extract(d.limit(0)).count() == 0
    assert html_page.blocks(html_page.parse("x<br>y"), [0]) == ["x y"]


WORDS = "<h1>The title</h1><p>First paragraph of an article that goes on.</p><p>Second.</p>"


@pytest.mark.parametrize("page", [
    "<body><form id='f' action='x'>%s</form></body>", "<body><div id='page-with-sidebar'>%s<div class='sidebar'>Beside it</div></div></body>",
    "<body><form><div class='layout banner-top'><nav>Menu</nav>%s</div></form><footer>Foot</footer></body>", "<head><title>T</title><p></p>%s",
    "<body><div class='sidebar'>%s</div></body>", "<form><input type=text><label>Name</label><p>Sign in please</p></form><article>%s</article>",
    "<div class='cookie-notice'>We set many cookies, and this says so at some length, longer than all else on this page, so that it holds most of the text of it by far.</div><article>%s</article>",
])
def test_wrappers_of_the_article_stay(spark, page):
    """What holds the article is not taken out for its name or for being a form; what stands beside it is."""
    d = spark.createDataFrame([(1, "http://h/1", page % WORDS)], "page_id long, url string, html string")
    assert html_consensus.extract(d).first()["text"] == "The title\n\nFirst paragraph of an article that goes on.\n\nSecond."


def test_broken_pages_are_linear():
    """Pages of hundreds of kilobytes of unclosed tags, quotes and ends take a few seconds in all and little memory."""
    import time
    import tracemalloc

    broken = ["<div class=abc>" * 20_000 + "x", "<div class=ad-%d>" * 20_000 + "x", "<a " * 20_000, "<a x='" * 8_000, "<a x='" * 8_000 + ">", "<a x='>'" * 20_000, "<div>" * 20_000 + "</x>" * 20_000, "<script>" + "</script " * 20_000, "<!--" * 20_000]
    began = time.process_time()
    for h in broken:
        html_page.blocks(page := html_page.parse(h), [html_page.best(page)])
    assert time.process_time() - began < 10
    tracemalloc.start()
    html_page.parse(broken[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


# -- lines -----------------------------------------------------------------


def plain_lines(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        out[i] = [k for k in range(len(lines)) if k in gone]
    return out


def test_lines_equal_plain(docs, texts):
    got = {r["doc_id"]: r["removed"] for r in line_windows.dedup_lines(docs).collect()}
    assert got == plain_lines(texts.items())


def test_lines_odd(odd, none):
    out = line_windows.dedup_lines(odd)
    rows = out.collect()
    assert len(rows) == odd.count() and line_windows.dedup_lines(none).count() == 0
    assert {r["kept_text"] for r in rows if r["text"] is None} == {None}
    same = [r for r in rows if r["doc_id"] == 1 and r["text"] == "a b c d"]
    assert all(r["kept_text"] == "a b c d" for r in same)
    kept = {r["doc_id"]: r["kept_text"] for r in rows}
    assert kept[7] == "one\ntwo\nthree\nfour" and kept[8] == "five"
    assert [c for c in out.columns if c not in ("kept_text", "removed")] == odd.columns


def test_lines_overlaps_merge(spark):
    d = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\na\na\na")], "doc_id long, text string")
    got = {r["doc_id"]: (r["removed"], r["kept_text"]) for r in line_windows.dedup_lines(d).collect()}
    assert got == {1: ([], "a\nb\nc\nd"), 2: ([1, 2, 3, 4], "x\ny"), 3: ([1, 2, 3], "a")}


def test_lines_of_a_very_long_text(spark):
    """A text of a million lines, two in five of them again."""
    texts = {1: "\n".join(f"line {k % 600_000}" for k in range(1_000_000)), 2: "x\n" * 100_000}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["removed"] for r in line_windows.dedup_lines(d).collect()}
    # windows over the joint are new, so the first and second repeat line go with the window they start
    assert got[1] == list(range(600_000, 1_000_000)) and got[2] == list(range(1, 100_000))


# -- chat ------------------------------------------------------------------


def call(i, name, **arguments):
    return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": arguments}) + "</tool_call>"


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


TOOLS = {"f": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}}, "required": ["n"], "additionalProperties": False}}


def test_linking(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "tool", result("a", {"z": 1, "b": 2})), (1, 2, "assistant", "let me see " + call("a", "f", n=1) + call("b", "f", n=0)), (1, 3, "assistant", "done"), (1, 4, "tool", result("q", "?")),
        (2, 0, "assistant", call("x", "g")), (2, 1, "tool", result("x", "1")), (2, 2, "assistant", call("x", "f", n="s")), (2, 3, "tool", result("x", "2")), (2, 4, "assistant", "<tool_call>not json</tool_call>"),
    ]
    out = {r["conv_id"]: r for r in chat_tools.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOLS).collect()}
    one = json.loads(out[1]["json"])["messages"]
    assert [m["role"] for m in one] == ["user", "assistant", "tool", "assistant", "tool"]  # the result moves behind its call
    assert one[1]["content"] == "let me see" and one[1]["tool_calls"][1]["errors"] == ["$.n: below minimum"] and one[4]["orphan"]
    assert (out[1]["n_calls"], out[1]["n_linked"], out[1]["n_orphans"], out[1]["n_invalid"]) == (2, 1, 1, 1)
    assert (out[2]["n_calls"], out[2]["n_linked"], out[2]["n_invalid"]) == (2, 2, 2)  # repeated ids pair in order
    assert json.loads(out[2]["json"])["messages"][4]["content"].startswith("<tool_call>")
    assert out[1]["json"] == chat_tools.canonical(json.loads(out[1]["json"]))


def test_call_waits_for_what_it_refers_to():
    c = lambda i, a, r: {"id": i, "name": "f", "arguments": json.dumps(a), "result": r}
    turns = [{"calls": [c("a", {}, 3)]}, {"calls": [c("b", {"x": [{"$ref": "a"}]}, 2)]}, {"calls": []}, {"calls": []}]
    assert chat_tools.order(turns) == ([0, 3, 1, 2], False)
    turns[0]["calls"][0]["arguments"] = json.dumps({"$ref": "b"})
    assert chat_tools.order(turns) == ([0, 1, 2, 3], True)


def plain_chat(rows, schemas):
    """One conversation in plain Python: pairs by id in order, the earliest turn that waits for nothing first, arguments checked by hand."""
    turns = []
    for _, turn, role, text in rows:
        found = re.findall(r"<tool_call>(.*?)</tool_call>", text) if role == "assistant" else []
        answers = json.loads(text) if role == "tool" else None
        content = re.sub(r"<tool_call>.*?</tool_call>", "", text).strip() if found else answers["content"] if answers else text
        turns.append({"turn": turn, "role": role, "content": content, "calls": [json.loads(c) for c in found], "of": answers and answers["tool_call_id"]})
    turns.sort(key=lambda t: (t["turn"], t["role"], t["content"]))
    asked, given = defaultdict(list), defaultdict(list)
    for i, t in enumerate(turns):
        for k, c in enumerate(t["calls"]):
            asked[c["id"]].append((i, k))
        if t["of"] is not None:
            given[t["of"]].append(i)
    answer = {a: g for key in asked for a, g in zip(asked[key], given[key])}
    results = set(answer.values())
    line = [i for i in range(len(turns)) if i not in results]
    last = {c["id"]: answer[i, k] for i, t in enumerate(turns) for k, c in enumerate(t["calls"]) if (i, k) in answer}
    before = defaultdict(set)
    for a, b in zip(line, line[1:]):
        before[b].add(a)
    for (i, _), g in answer.items():
        before[g].add(i)
        if i in line and line.index(i) + 1 < len(line):
            before[line[line.index(i) + 1]].add(g)
    for i, t in enumerate(turns):
        for c in t["calls"]:
            ref = c["arguments"].get("after", {}).get("$ref")
            if ref in last:
                before[i].add(last[ref])
    order, left = [], list(range(len(turns)))
    while left:
        free = [i for i in left if not before[i] & set(left)]
        if not free:
            order = list(range(len(turns)))
            break
        order.append(free[0])
        left.remove(free[0])
    messages = []
    for i in order:
        t = turns[i]
        m = {"role": t["role"], "content": t["content"]}
        if t["calls"]:
            m["tool_calls"] = []
            for c in t["calls"]:
                n, wrong = c["arguments"].get("n"), []
                if c["name"] not in schemas:
                    wrong = [f"{c['name']}: unknown tool"]
                elif n is None:
                    wrong = ["$.n: missing"]
                elif isinstance(n, str):
                    wrong = ["$.n: not integer"]
                elif n < 1:
                    wrong = ["$.n: below minimum"]
                m["tool_calls"].append({"id": c["id"], "name": c["name"], "arguments": c["arguments"]} | ({"errors": wrong} if wrong else {}))
        if t["of"] is not None:
            m |= {"tool_call_id": t["of"]} | ({} if i in results else {"orphan": True})
        messages.append(m)
    return json.dumps({"messages": messages}, sort_keys=True, separators=(",", ":"), ensure_ascii=False), len(results)


def test_linking_equals_plain(spark):
    """Generated conversations: results out of order, ids repeated, unanswered and orphaned, references that may form circles, bad arguments."""
    rng, rows = random.Random(13), []
    for conv in range(120):
        turns = rng.sample(range(100), rng.randint(3, 14))
        for turn in turns:
            kind = rng.random()
            if kind < 0.25:
                rows.append((conv, turn, "user", f"question {turn}"))
            elif kind < 0.65:
                calls = []
                for _ in range(rng.randint(1, 3)):
                    arguments = {"n": rng.choice([1, 5, 0, "x"])} if rng.random() < 0.9 else {}
                    if rng.random() < 0.4:
                        arguments["after"] = {"$ref": rng.choice("abcd")}
                    calls.append(call(rng.choice("abcd"), rng.choice("ffg"), **arguments))
                rows.append((conv, turn, "assistant", f"text {turn} " + "".join(calls)))
            else:
                rows.append((conv, turn, "tool", result(rng.choice("abcde"), f"answer {turn}")))
    tools = {"f": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}}, "required": ["n"]}}
    mixed = rng.sample(rows, len(rows))
    got = {r["conv_id"]: r for r in chat_tools.linked(spark.createDataFrame(mixed, "conv_id long, turn long, role string, text string").repartition(5), tools).collect()}
    circles = 0
    for conv in range(120):
        want, linked = plain_chat([r for r in rows if r[0] == conv], tools)
        assert (got[conv]["json"], got[conv]["n_linked"]) == (want, linked), conv
        circles += got[conv]["circular"]
    assert 0 < circles < 60 and sum(r["n_orphans"] for r in got.values()) > 20


def test_chat_odd(spark):
    d = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "x"), (1, 1, "user", "same"), (1, 1, "user", "same"), (2, None, "tool", "{}"), (3, 0, "assistant", "y" * 300_000)], "conv_id long, turn long, role string, text string")
    out = chat_tools.linked(d.withColumn("id", F.lit(1)).withColumn("conv", F.lit("c"))).collect()
    assert len(out) == 5 and sum(r["n_messages"] for r in out) == 6
    assert chat_tools.linked(d.limit(0)).count() == 0


# -- licenses --------------------------------------------------------------


def plain_scan(text, notices, containment):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    w = tokens(text or "")
    base = [(i, label) for p, label in license_join.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    score, labels = 0.0, {label for _, label in base}
    lines = [(False, x) for x in (text or "").split("\n")]
    for long, block in lines + [(True, x) for x in re.split(r"\n[\x20\x09-\x0D]*\n", text or "") if "\n" in x]:
        has = set(tokens(block))
        for label, words in notices:
            part = len(has & set(words.split())) / len(set(words.split()))
            if part >= containment - 1e-9 and (not long or len(has) <= 4 * len(set(words.split()))):
                labels.add(label)
                score = max(score, part)
    at = [i for i, _ in base]
    return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), max(score, 0.5 if base else 0.0)


def test_scan_equals_plain(spark):
    rng = random.Random(1)
    words = sorted({w for _, n in license_join.NOTICES for w in n.split()})
    texts = [n for _, n in license_join.NOTICES] + ["MIT License mit  license", "the General, public-LICENSE v3 and Apache\nLicense", "ＭＩＴ license K", "mit license" * 2, None, ""]
    for _, n in license_join.NOTICES:
        part = n.split()
        texts += ["\n".join([" ".join(rng.sample(words, 4)), " ".join(rng.sample(part, max(1, len(part) - k)) + rng.sample(words, 2))]) for k in range(4)]
        wrapped = "\n".join(" ".join(part[i : i + 5]) for i in range(0, len(part), 5))
        texts += [wrapped, f"Intro here.\n \n{wrapped.upper()}\n\t\nand more", wrapped + "\n" + " ".join(f"w{i}" for i in range(200))]
    d = spark.createDataFrame([(k, t, None, 1, 2, "k", 3, "w", 0.5) for k, t in enumerate(texts)], DOCS)
    for r in license_join.scan(d).collect():
        assert tuple(r)[1:] == plain_scan(texts[r["doc_id"]], license_join.NOTICES, license_join.CONTAINMENT), texts[r["doc_id"]]


def test_scan_odd(odd, none):
    assert license_join.scan(odd).count() == odd.count() and license_join.scan(none).count() == 0


# -- rules -----------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_plain(spark, docs, texts):
    more = ["a " * 9, "a " * 8, "a b c d e f g h " * 2, "1 2 3 4 5 6 7 8 9 x 1 2 3 4 5 6 7 8 9", None, "", "x\n\nx\n \n x\n"]
    d = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    want = texts | {10_000 + k: t for k, t in enumerate(more)}
    for r in rule_cascade.measured(d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect():
        assert tuple(r)[1:] == plain_measures(want[r["doc_id"]])


def test_cascade_keeps_what_no_rule_rejects(docs):
    judged = rule_cascade.judged(docs)
    assert rule_cascade.survivors(docs).count() == judged.where("kept").count()
    assert judged.where("base_failed AND kept").count() == 0
    assert sorted(r.name for r in rule_cascade.ordered(docs)) == sorted(r.name for r in rule_cascade.RULES)


def test_rules_run_on_what_is_left(spark, docs):
    """Fewer rows reach each rule; a rule is not evaluated on a row that one before it has rejected."""
    n = len(rule_cascade.RULES)
    reached = Counter(r["n_rules"] for r in rule_cascade.judged(docs).collect())
    at = [sum(v for k, v in reached.items() if k >= i) for i in range(1, n + 1)]
    assert at[0] == docs.count() > at[2] and at == sorted(at, reverse=True)
    costly = rule_cascade.Rule("costly", "coalesce(if(n_words < 50, raise_error('evaluated'), NULL), n_words < 0)")
    short = rule_cascade.Rule("short", "n_words < 50")
    rows = rule_cascade.judged(docs, (short, costly), (), order=[short, costly]).collect()
    assert {r["n_rules"] for r in rows if r["n_words"] < 50} == {1} and {r["n_rules"] for r in rows if r["n_words"] >= 50} == {2}
    with pytest.raises(Exception, match="evaluated"):
        rule_cascade.judged(docs, (short, costly), (), order=[costly, short]).count()


def test_rules_order_by_gain(docs):
    """Of two rules of one cost the one that rejects more comes first; rerunning gives the same order."""
    few, many = rule_cascade.Rule("few", "n_words < 2"), rule_cascade.Rule("many", "n_words < 200")
    assert [r.name for r in rule_cascade.ordered(docs, (few, many))] == ["many", "few"]


def test_rules_odd(odd, none):
    rows = rule_cascade.judged(odd).collect()
    assert len(rows) == odd.count() and rule_cascade.judged(none).count() == 0
    assert sum(r["n_words"] == 0 for r in rows) == 4 and all(r["base_failed"] for r in rows if r["n_words"] == 0)
    assert rule_cascade.survivors(odd).columns == odd.columns


# -- neighbours ------------------------------------------------------------


def brute(ids, x, queries, k):
    out = {}
    for q, v in queries:
        d = {}
        for i, row in zip(ids, x):
            if i != q:
                d[i] = min(d.get(i, np.inf), float(np.sqrt(((row - v) ** 2).sum())))
        out[q] = sorted(d.items(), key=lambda t: (t[1], t[0]))[:k]
    return out


def test_neighbours_recall(spark, sf):
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = d.orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    want = brute([r["vec_id"] for r in rows], x, [(r["vec_id"], x[k]) for k, r in enumerate(rows) if r["vec_id"] % 100 == 0], 10)
    got = defaultdict(list)
    for r in prefix_forest.search(d, d.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(s == pytest.approx(dict(brute([i], x[[int(np.flatnonzero([r["vec_id"] == i for r in rows])[0])]], [(q, x[[r["vec_id"] for r in rows].index(q)])], 1)[q])[i], abs=1e-14) for q, v in list(got.items())[:2] for i, s in v)


def test_neighbours_beyond_one_block(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20_000, 8)).round(2)
    x[5_000:9_000] = x[0]  # a hot vector
    d = spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    x = x.astype(np.float32).astype(float)
    got = defaultdict(dict)
    for r in prefix_forest.search(d, d.where("vec_id % 1000 = 0")).collect():
        got[r["query_id"]][r["rank"]] = r["vec_id"]
    hits = 0
    for q, found in got.items():
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        dist[q] = np.inf
        hits += len(set(found.values()) & set(np.lexsort((np.arange(len(x)), dist))[:10].tolist()))
    assert len(got) == 20 and hits >= 0.9 * 200
    assert list(got[5000][k] for k in (1, 2)) == [0, 5001]


def test_neighbours_of_isolated_vectors(spark):
    """Clusters of close vectors and a few vectors alone: each query gets its ten, the lone ones too."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 32))
    x = np.concatenate([np.repeat(centres, 50, axis=0) + rng.normal(0, 1e-4, (1000, 32)), rng.normal(size=(4, 32)) * 3])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = Counter(r["query_id"] for r in prefix_forest.search(d, d.where("vec_id % 10 = 0 OR vec_id >= 1000")).collect())
    assert found == dict.fromkeys([*range(0, 1000, 10), *range(1000, 1004)], 10)


def test_neighbours_blocks_are_not_broadcast(spark):
    """Small tables of query blocks, which the planner broadcast times all index blocks: each pair once, without a broadcast."""
    cells = [(k, *[bytes([k])] * 4) for k in range(5)]
    index = spark.createDataFrame(cells, "block int, ids binary, vectors binary, strings binary, places binary")
    met = prefix_forest._met(index.drop("block").limit(3), index)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["ids"][0], r["r_ids"][0]) for r in met.collect()) == [(q, k) for q in range(3) for k in range(5)]


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.1]), (9, [])]
    d = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<double>, score double, rank int")
    got = [tuple(r) for r in prefix_forest.search(d, d.where("vec_id = 0 OR vec_id > 1")).orderBy("query_id", "rank").collect()]
    assert [(q, n, i) for q, n, i, _ in got] == [(0, 1, 1), (0, 2, 8), (8, 1, 1), (8, 2, 0)]
    assert got[0][3] == pytest.approx(0.1) and got[2][3] == 0
    assert prefix_forest.search(d.limit(0), d).count() == 0 and prefix_forest.search(d, d.limit(0)).count() == 0


# -- packing ---------------------------------------------------------------


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    more = {10_000: "a<|endoftext|>b", 10_001: "<|endoftext|>", 10_002: "x <|endoftext| > y", 10_003: "It's 12,5 %  Ünï\r\n\tcode 😀 " * 50, 10_004: None}
    docs = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(list(more.items()), "doc_id long, text string"))
    texts = texts | more
    rows = packing.pack(docs, with_ids=True, group_docs=50).collect()
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] > 0
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in texts.items():
        ids = [x for r in sorted(by_doc[i], key=lambda r: r["start"]) for x in r["ids"]]
        assert ids == tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert {r["doc_tokens"] for r in by_doc[i]} == {len(ids)}
    for held in by_seq.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert 1024 * len(by_seq) - total < 0.05 * total


def test_first_fit_decreasing():
    rng = random.Random(2)
    for n in (0, 1, 7, 200):
        sizes = [rng.randint(1, 10) for _ in range(n)]
        bins, offsets = packing.first_fit_decreasing(sizes, 10)
        room, want = [], {}
        for i in sorted(range(n), key=lambda k: -sizes[k]):
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            room += [10] * (b == len(room))
            want[i] = (b, 10 - room[b])
            room[b] -= sizes[i]
        assert {i: (bins[i], offsets[i]) for i in range(n)} == want


def test_packing_odd(odd, none):
    rows = packing.pack(odd).collect()
    assert sum(r["start"] == 0 for r in rows) == odd.count() and packing.pack(none).count() == 0
    assert sum(r["length"] for r in rows if r["start"] == 0 and r["doc_tokens"] == 1) == 3  # null, null, empty: the end id alone
    e = packing.encoder(packing.default_vocabulary())
    assert len(e(" " * 400_000)) > 1 and e("a<|endoftext|>b").tolist() == [64, 50256, 65, 0]


def test_packing_spreads_repeated_rows(spark):
    """One row very often: its copies fall into all groups, not into one."""
    d = spark.createDataFrame([(1, "the same few words")] * 4_000, "doc_id long, text string")
    rows = packing.pack(d, group_docs=100).collect()
    groups_of = Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(rows) == 4_000 and len(groups_of) == 40 and max(groups_of.values()) < 200


def test_packing_by_another_vocabulary(spark):
    """A file that does not split texts by bytes is read by ``tokenizers`` itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Some Words, it's 12.", "<|startoftext|> é x", ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in packing.pack(d, vocabulary=path, with_ids=True).collect()}
    slow = Tokenizer.from_file(path)
    assert got == {k: slow.encode(t, add_special_tokens=False).ids + [0] for k, t in enumerate(texts)}
    assert packing.encoder(path).fast is None and packing.encoder(packing.default_vocabulary()).fast is not None
