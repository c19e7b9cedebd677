"""Packing, byte deduplication, extraction, similarity join, neighbours and archives."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, extract, graph, jaccard, packing, suffix_dedup, warc

tokenizer = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def documents(spark, texts, ids=None):
    rows = [(i, t, "x", 1) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, block string, piece int")


# packing


def test_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    own, library = packing.WordTokenizer(tokenizer), Tokenizer.from_file(tokenizer)
    rng = random.Random(3)
    chars = [chr(c) for c in range(1, 0x250)] + ["'s", "'LL", " ", "\n", "İ", "Σ", "<|endoftext|>", "е", "语", "𝒳"]
    for _ in range(2000):
        t = "".join(rng.choices(chars, k=rng.randint(0, 16)))
        assert own(t) == np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_PIECES", 40)
    rng = random.Random(5)
    texts = [None, "", "a b", "a b", *["word " * rng.randint(1, 300) for _ in range(150)], "z " * 9000]
    rows = packing.pack_documents(spark, documents(spark, texts), tokenizer, capacity=512).collect()
    own = packing.WordTokenizer(tokenizer)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = own(t or "") + np.array([1], dtype="<u4").tobytes()
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["length"] for r in pieces[:-1]] == [512] * (len(pieces) - 1)
        assert [r["ids_crc32"] for r in pieces] == [zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in pieces]
        assert sum(r["length"] for r in pieces) == len(ids) // 4
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
    lengths = np.array([r["length"] for r in rows])
    assert len(by_sequence) <= packing.lower_bound(lengths, 512) + 1


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark, documents(spark, []), tokenizer).count() == 0


def test_bounds_and_best_fit():
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3
    assert packing.lower_bound(np.array([34, 34, 34, 34]), 100) == 2
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = np.sort(rng.integers(1, 101, rng.integers(1, 60)))[::-1]
        bins, offsets, room = packing.best_fit_decreasing(x, 100)
        assert packing.lower_bound(x, 100) <= len(room) and (room >= 0).all()
        assert ((100 - room) == np.bincount(bins, weights=x, minlength=len(room))).all() and (offsets + x <= 100).all()


# removal of repeated bytes


def removed(texts, ids, n=50):
    first = {}
    for i, t in sorted(zip(ids, texts), key=lambda x: x[0]):
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            first.setdefault(b[k : k + n], i)
    out = []
    for i, t in zip(ids, texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < i:
                gone[k : k + n] = b"\1" * n
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("limits", [(12 << 20, 500_000, 64, 2048), (3000, 60, 2, 3)])
def test_repeats_equal_brute_force(spark, monkeypatch, limits):
    for name, value in zip(("BLOCK_BYTES", "BUCKET_ANCHORS", "LOCAL_HOT", "HOT"), limits):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randint(1, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    common, passages = line(20), [line(30) for _ in range(4)]
    texts = [None, "", "short", "short", "a" * 400, "a" * 120, "ab" * 100]
    for _ in range(60):
        texts.append(f"{line(10)} {common} {line(8)} {rng.choice(passages)[rng.randint(0, 40):]} {line(5)}")
    texts += texts[10:20] + [texts[30][:150], texts[31][20:]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = suffix_dedup.remove_repeats(spark, documents(spark, texts, ids)).collect()
    assert sorted(map(tuple, got)) == removed(texts, ids)


def test_repeats_in_groups_of_buckets(spark, monkeypatch):
    """A block sends a row to every group of buckets, not to every bucket."""
    for name, value in (("BLOCK_BYTES", 3000), ("BUCKET_ANCHORS", 20), ("LOCAL_HOT", 3), ("HOT", 3), ("LEAST_GROUPS", 5)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(8)
    common, texts = "".join(rng.choices("abcdefgh ", k=200)), []
    for _ in range(60):
        texts.append("".join(rng.choices("abcdefgh ", k=300)) + common[rng.randint(0, 90) :] + "".join(rng.choices("abc ", k=90)))
    dealt = suffix_dedup.deal(sum(map(len, texts)))
    assert dealt.buckets > 60 and dealt.each > 10
    rows = suffix_dedup._census(50, dealt, (1234567, 7654321))(pd.DataFrame({"block": 0, "doc_id": range(60), "text": [t.encode() for t in texts]}))
    assert len(rows) <= 7
    got = suffix_dedup.remove_repeats(spark, documents(spark, texts)).collect()
    assert sorted(map(tuple, got)) == removed(texts, list(range(60)))


def test_repeats_edges(spark):
    docs = documents(spark, ["x" * 60, "x" * 60, "y" * 60 + "x" * 60], [1, 1, None])
    got = sorted(((r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(spark, docs).collect()), key=str)
    assert got == [(1, 0), (1, 0), (None, 60)]
    ids = [(1 << 63) - 1, None, (1 << 63) - 1]
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in suffix_dedup.remove_repeats(spark, documents(spark, ["x" * 60, "x" * 60, "z"], ids)).collect())
    assert got == [(str(ids[0]), 0), (str(ids[0]), 0), ("None", 0)]
    assert suffix_dedup.remove_repeats(spark, docs.where("false")).count() == 0


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_names_of_texts_that_collide_modulo_a_power_of_two():
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((a + b).encode(), dtype=np.uint8)
    for points in ((3, 5), (1234567, 7654321)):
        x, y = suffix_dedup.Names(data, points)(np.array([0, 2048]), np.array([2048, 2048]))
        assert x != y


def test_leftmost_minimum_over_the_edge_of_places():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, 140_000).astype(np.uint64) << np.uint64(40)
    low = suffix_dedup.leftmost_min(x, 35)
    for i in [*range(65_480, 65_560), *range(131_030, 131_100), 7, 99_000]:
        assert int(low[i]) == int(x[i : i + 35].min()) | (i + int(x[i : i + 35].argmin())) & 0xFFFF


def test_anchor_that_all_blocks_share(spark, monkeypatch):
    """Only the smallest document of a segment sends its bytes, whatever blocks hold it."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 400)
    rng = random.Random(9)
    common = "the one line that every text of this corpus has in it, word for word. "
    texts = [("".join(rng.choices("abcdefgh ", k=90)) + common + "".join(rng.choices("abcdefgh ", k=60))) for _ in range(60)]
    got = suffix_dedup.remove_repeats(spark, documents(spark, texts)).collect()
    assert sorted(map(tuple, got)) == removed(texts, list(range(60)))


def test_prefix_classes():
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.integers(1, 3, 3000), [0]]).astype(np.uint8)
    order, number = suffix_dedup.prefix_classes(data, 8)
    raw = data.tobytes()
    classes = {}
    for p, c in zip(order.tolist(), number.tolist()):
        if p + 8 < len(raw):
            assert classes.setdefault(raw[p : p + 8], c) == c
    assert len(set(classes.values())) == len(classes)


# extraction


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<div class="cookie-notice"><p>We use cookies to make this site better for you. Accept?</p></div>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<article><h1>A &amp; B</h1><p>First   paragraph,<br>with <b>bold</b> words &#233;.<p>Second one is a longer paragraph of text, too.</p>
<script>var x = "</p>";</script><div class="ad">Buy this great thing today, it is cheap.</div><form><p>Sign up for more, please.</p></form></article>
<section id="comments"><p>Great article, I liked it a lot. Thank you.</p></section>
<aside><p>Other stories that you may like to read.</p></aside><footer>&copy; me</footer></body></html>"""


def test_extraction(spark):
    want = "A & B First paragraph, with bold words é. Second one is a longer paragraph of text, too."
    broken = "<html><body><article><p>Cut off in the middle of a long sentence, <b>as it"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<nav>only</nav>"), (None, "u", broken), (1, "u", PAGE), (5, "u", "<p>" + "word, " * 30_000 + "end.</p>" + "<" * 2000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("other"))
    got = {r["page_id"]: r for r in extract.extract_pages(spark, pages).collect()}
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want)
    assert got[2]["text"] == got[3]["text"] == got[4]["text"] == ""
    assert got[None]["text"] == "Cut off in the middle of a long sentence, as it"
    assert got[5]["n_chars"] > 150_000
    assert extract.extract_pages(spark, pages).count() == len(rows)
    assert extract.extract_pages(spark, pages.where("false")).count() == 0


SMOOTH = """<html><body><div><a href="/x">Start</a></div><div><p>A long paragraph stands here, with words enough to be one of an article.</p>
<p>Yes</p><p>Another long paragraph follows it, and it says as much as the one before it did.</p></div><div><a href="/y">More</a></div></body></html>"""


def test_cut_mends_labels():
    blocks = extract.blocks_of(SMOOTH)
    scores = [extract.score_of(b) for b in blocks]
    want = [False, True, True, True, False]
    assert [s > 0 for s in scores] == [False, True, False, True, False]
    assert extract.minimum_cut(scores, extract.edges_of(blocks)) == want
    # what a page declares to be of another kind is left to itself
    ad = SMOOTH.replace("<p>Yes</p>", '<div class="ad"><p>Buy this cheap thing now.</p></div>')
    assert [x for _, x in extract.labelled(ad)] == [False, True, False, True, False]


def test_fitted_weights(spark):
    # in this corpus articles are lists of short items, and boilerplate is in sentences
    nav = "<nav><p>A long and proper sentence that only tells how to use this site at all.</p></nav>"
    html = [f"<body>{nav}<article><ul><li>item {k}</li><li>thing {k}</li></ul></article></body>" for k in range(40)]
    pages = spark.createDataFrame([(k, "u", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    weights = extract.fit_weights(spark, pages)
    assert weights[6] > extract.PRIOR[6] and weights[5] < extract.PRIOR[5]
    held = extract.blocks_of("<body><div><ul><li>item a</li></ul></div></body>")[0]
    assert extract.score_of(held, weights) > 0 > extract.score_of(held)
    assert extract.fit_weights(spark, pages.where("false")) == extract.PRIOR
    plain = pages.selectExpr("page_id", "url", "'<p>no declared part</p>' as html")
    assert extract.fit_weights(spark, plain) == extract.PRIOR


def test_climb_is_the_distance_in_the_dom():
    rng = random.Random(8)
    for _ in range(50):
        page, path, paths, number = [], (0,), [], 0
        for _ in range(40):
            if rng.random() < 0.5 or len(path) == 1:
                number += 1
                path += (number,)
                page.append("<div>")
            else:
                path = path[:-1]
                page.append("</div>")
            if rng.random() < 0.4:
                page.append(f"t{number}")
                paths.append(path)
        blocks, common = extract.blocks_of("".join(page)), lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert [b.climb for b in blocks[1:]] == [len(a) + len(b) - 2 * common(a, b) for a, b in zip(paths, paths[1:])]
    deep = extract.main_text("<div>" * 50_000 + "<p>" + "Deep words of a long sentence stand here, and more of them. " * 3)
    assert deep.startswith("Deep words")


def test_minimum_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 8)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda side: sum(max(s, 0) if not x else max(-s, 0) for s, x in zip(scores, side)) + sum(w for i, j, w in edges if side[i] != side[j])  # noqa: E731, B023
        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(extract.minimum_cut(scores, edges)) == pytest.approx(best, abs=1e-6)


# similarity join


def components_by_force(texts, ids, words, num):
    sets = {}
    for i, t in zip(ids, texts):
        w = [x for x in (t or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= num * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(rng, n_bases=6, copies=25):
    texts = []
    for k in range(n_bases):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(rng.choice([12, 30, 90, 250]))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                t[rng.randrange(len(t))] = f"v{rng.randint(0, 9999)}"
            texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize(("words", "num", "limits"), [(3, 90, None), (5, 80, None), (3, 90, (2000, 1500, 4)), (2, 80, (2000, 1500, 4))])
def test_join_equals_brute_force(spark, monkeypatch, words, num, limits):
    if limits:
        for name, value in zip(("LEAF_BYTES", "BLOCK_BYTES", "LEAF"), limits):
            monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(words * num)
    texts = [None, "", " ", "one", "ONE", "one two", "one two three", "One\ttwo\nthree", "x " * 20_000, *near_copies(rng)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_documents(spark, documents(spark, texts, ids), words, num).collect()}
    assert got == components_by_force(texts, ids, words, num)


def test_words_that_collide_modulo_a_power_of_two(spark):
    a = thue_morse(2048)
    docs = documents(spark, [a, a.translate(str.maketrans("ab", "ba")), a])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join_documents(spark, docs, 3, 90).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_windows_replicate_and_exclude(spark):
    """Rings deal the documents of a region: those beyond a window are kept apart, and
    linked ones are never."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[: 200 - cut] + [f"x{cut}_{k}_{i}" for i in range(cut)]) for cut in range(0, 150, 3) for k in range(2)]
    rng.shuffle(texts)
    shingler = jaccard.Shingler(3, (3, 5))
    sets = [shingler.sets([t])[0] for t in texts]
    rows = spark.createDataFrame([(i, len(s), s.tobytes()) for i, s in enumerate(sets)], "id bigint, n int, hashes binary")
    members = jaccard.regions_of(spark, rows, 90, 100)
    measured = jaccard._measured(spark, members, members.select("region", F.col("region").alias("id")).distinct(), rows, 90, 100)
    dealt = jaccard.rings(measured, 0.1)
    held = {}
    for r in dealt.collect():
        held.setdefault(r["id"], set()).add(r["region"])
    assert sum(len(x) > 1 for x in held.values())  # replicated
    together = apart = 0
    for a in held:
        for b in held:
            if a < b:
                both = len(np.intersect1d(sets[a], sets[b]))
                meet = bool(held[a] & held[b])
                together, apart = together + meet, apart + (not meet)
                assert meet or 100 * both < 90 * (len(sets[a]) + len(sets[b]) - both)
    assert apart > together / 2  # excluded


def test_region_within_a_task_uses_its_windows():
    rng = np.random.default_rng(3)
    centres = [np.unique(rng.integers(0, 1 << 60, 120).astype(np.uint64)) for _ in range(3)]
    shared = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([c[: 120 - k % 30], shared, rng.integers(0, 1 << 60, 12 + k % 9).astype(np.uint64)])) for c in centres for k in range(60)]
    region = jaccard.Region(sets, 80, 100)
    region.parts = lambda: [np.arange(len(sets))]  # else rare shingles have parted the centres before
    root = region.join()
    assert region.excluded > 0 and region.compared < len(sets) ** 2
    plain = jaccard.Region(sets, 80, 100)
    for k in range(len(sets) - 1):
        plain.compare(k, np.arange(k + 1, len(sets)))
    assert root == [plain.find(k) for k in range(len(sets))]


def test_sets_of_small_regions_are_shuffled_twice(spark, tmp_path):
    """By document and by region: no further round sends them, though no pivot connects all."""
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(200):
        shared, halves = rng.integers(0, 1 << 63, 270), rng.integers(0, 1 << 63, (2, 40))
        sets += [np.unique(np.concatenate([shared, half, rng.integers(0, 1 << 63, 5)]).astype(np.uint64)) for half in halves for _ in range(2)]
    spark.createDataFrame([(i, len(s), s.tobytes()) for i, s in enumerate(sets)], "id bigint, n int, hashes binary").write.parquet(f"{tmp_path}/sets")
    store, threshold = spark.sparkContext._jsc.sc().statusStore(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def written() -> dict[tuple, int]:
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = store.stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    try:
        found = {r["node"]: r["label"] for r in jaccard.join_sets(spark, spark.read.parquet(f"{tmp_path}/sets"), 90, 100).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found == {i: i - i % 2 for i in range(len(sets))}
    sent = sum(v for k, v in written().items() if k not in before)
    assert 0 < sent < 3 * sum(s.nbytes for s in sets)


def test_rings_within_a_task_lose_no_link():
    rng = random.Random(11)
    words = rng.sample(range(1 << 60), 600)
    sets = [np.unique(np.array(words[cut : cut + 200 + rng.randint(0, 9)], dtype=np.uint64)) for cut in range(0, 300, 3)]
    for pivot in (0, 50, 99):
        region, plain = jaccard.Region(sets, 90, 100), jaccard.Region(sets, 90, 100)
        region.ringed(pivot, [np.arange(len(sets))])
        assert region.excluded > 0
        for k in range(len(sets) - 1):
            plain.compare(k, np.arange(k + 1, len(sets)))
        assert jaccard.Region(sets, 90, 100).join(pivot) == [plain.find(k) for k in range(len(sets))]


def test_join_edges(spark):
    docs = documents(spark, ["a b c d"] * 2 + ["a b c d", "e f g h"], [5, 5, None, 7])
    got = sorted((tuple(r) for r in jaccard.join_documents(spark, docs, 3, 90).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, None), (7, 2, 7)], key=str)
    assert jaccard.join_documents(spark, docs.where("false"), 3, 90).count() == 0
    kept = jaccard.without_near_copies(spark, documents(spark, ["a b c d e f"] * 3 + [None]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(40)]
    got = {r["node"]: r["label"] for r in graph.components(spark, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in root}


def test_small_graphs_and_large_ones_have_the_same_components(spark, monkeypatch):
    rng = random.Random(10)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(230)] + [(1000 + k, 999 + (7 * k) % 60) for k in range(60)]
    rows = spark.createDataFrame(edges, "a bigint, b bigint")
    small = sorted(map(tuple, graph.components(spark, rows).collect()))
    monkeypatch.setattr(graph, "EDGE_BYTES", 1 << 40)
    assert small == sorted(map(tuple, graph.components(spark, rows).collect()))


def test_census_sends_packed_shingles():
    """A row for a task, not for a shingle; what more than one run has is credited."""
    rng = random.Random(12)
    shared = " ".join(str(rng.randint(0, 1 << 40)) for _ in range(60))
    texts = [f"{shared} " + " ".join(str(rng.randint(0, 1 << 40)) for _ in range(50)) for _ in range(40)]
    run = jaccard._census(3, (1234567, 7654321), 80, 100, 4)
    sent = pd.concat([x for a in (0, 20) for x in run([pd.DataFrame({"id": range(a, a + 20), "text": texts[a : a + 20]})])])
    assert len(sent) <= 2 * (4 + 2)
    rows = pd.concat([x for _, part in sent.groupby("part") for x in jaccard._credit([part])])
    shingler = jaccard.Shingler(3, (1234567, 7654321))
    looked = [jaccard._sampled(s, 80, 100) for s in shingler.sets(texts)]
    assert dict(rows[rows["n"] == -1][["a", "b"]].to_numpy().tolist()) == {i: len(s) for i, s in enumerate(looked)}
    assert rows[rows["n"] == 1].groupby("a")["b"].sum().to_dict() == {i: sum(sum(x in s for s in looked) > 1 for x in part) for i, part in enumerate(looked)}
    assert dict(rows[rows["n"] >= 2][["a", "n"]].to_numpy().tolist()) == {i: 2 + len(s) for i, s in enumerate(shingler.sets(texts))}


def test_region_that_a_cell_keeps_does_not_shrink(spark):
    """Else a round for every few documents that leave it."""
    rows = [(1, i, p, 0.1 if (i < 1090) == (p == 1) else 0.9, False) for i in range(1000, 1100) for p in (1, 2)]
    measured = spark.createDataFrame(rows, "region bigint, id bigint, pivot bigint, distance double, linked boolean")
    assert {(r["region"], r["shrinks"]) for r in jaccard.cells(measured, 0.2).collect()} == {(1, False)}
    even = measured.withColumn("distance", F.when(F.col("id") % 2 + 1 == F.col("pivot"), 0.1).otherwise(0.9))
    assert len({r["region"] for r in jaccard.cells(even, 0.2).where("shrinks").collect()}) == 2


def test_pivots_in_lots_meet_all_members(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 90, 60).astype(np.uint64)) for _ in range(30)]
    rows = spark.createDataFrame([(i, len(s), s.tobytes()) for i, s in enumerate(sets)], "id bigint, n int, hashes binary")
    members, pivots = rows.selectExpr("7L as region", "id"), rows.where("id % 3 = 0").selectExpr("7L as region", "id")
    monkeypatch.setattr(jaccard, "PIVOT_BYTES", 1500)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 4000)
    got = {(r["id"], r["pivot"]): r["distance"] for r in jaccard._measured(spark, members, pivots, rows, 80, 100).collect()}
    assert got.keys() == {(i, p) for i in range(30) for p in range(0, 30, 3)}
    for (i, p), d in got.items():
        both = len(np.intersect1d(sets[i], sets[p]))
        assert abs(d - (1 - both / (len(sets[i]) + len(sets[p]) - both))) < 1e-9


# neighbours


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    bad = [(9000, None), (9001, []), (9002, [0.0] * 64), (9003, [float("nan")] + [1.0] * 63), (9004, [None] + [1.0] * 63), (9005, [1.0, 2.0]), (None, [1.0] * 64)]
    data = rows.select("vec_id", "embedding").unionAll(spark.createDataFrame(bad, "vec_id bigint, embedding array<float>"))
    index = ann.build_index(spark, data)
    got = ann.nearest(spark, index, index.where("vec_id % 50 = 0"), 5).collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in rows.collect()}
    ids = np.array(sorted(vectors))
    m = np.stack([vectors[i] for i in ids.tolist()])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hits = total = 0
    for q in [i for i in ids.tolist() if i % 50 == 0]:
        s = m @ m[list(ids).index(q)]
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -np.round(s, 12)))[:5]].tolist()
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        for r in mine:
            assert r["score"] == pytest.approx(s[list(ids).index(r["vec_id"])], abs=1e-12)
        hits += len({r["vec_id"] for r in mine} & set(best))
        total += 5
    assert hits >= 0.9 * total


def test_neighbour_ties(spark):
    rows = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(100, 0, -1)] + [(50, [1.0, 2.0, 3.0])], "vec_id bigint, embedding array<double>")
    index = ann.build_index(spark, rows)
    got = ann.nearest(spark, index, index.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(q, v) for q in (50, 100) for v in (1, 2, 3, 4, 5)]
    few = ann.build_index(spark, rows.where("vec_id in (50, 51)"))
    assert [r["vec_id"] for r in ann.nearest(spark, few, few.where("vec_id = 50"), 5).collect()] == [51]
    assert ann.nearest(spark, index.where("false"), index.where("false"), 5).count() == 0


# archives


def test_archive_round_trip(spark):
    magic = "\x1f\u008b\x08" * 3
    rows = [(1, "http://a/", "x" * 1000), (2, None, "x" * 1000), (3, "http://a/\r\nb%0D", "x" * 1000), (4, "u", "y" * 999), (5, "u", "y" * 999), (6, "u", None), (7, "u", "é" * 600 + magic), (8, "u", "é" * 600 + magic), (None, "u", "z" * 1200), (9, "u", "WARC/1.1\r\n\r\n" + "q" * 300_000), (4, "u", "y" * 999)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("path", F.lit(1))
    want = []
    largest = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            largest[b] = max(i, largest.get(b, i))
    for i, u, h in rows:
        b = (h or "").encode()
        again = largest.get(b, i) if i is not None else None
        want.append((i, u, "response" if again == i else "revisit", len(b), hashlib.sha1(b).hexdigest(), None if again == i else again))
    folder = warc.new_path(spark, "test")
    manifest = warc.write_archives(spark, warc.mark_revisits(pages), folder)
    for split in (64, 700, 1 << 22):
        got = warc.read_archives(spark, manifest, split=split).collect()
        key = lambda r: str((r[0], r[1]))
        assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
        assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")
    assert warc.round_trip(spark, pages.where("false")).count() == 0


def test_warc_reads_records_with_long_headers():
    import base64
    import io
    import random

    url = "data:text/html;base64," + base64.b64encode(random.Random(3).randbytes(3 << 20)).decode()
    data = warc._member(warc._record(1, url, "<p>x</p>", None)) + warc._member(warc._record(2, None, "<p>y</p>", None))
    got = [warc.parse(x) for x in warc.members(io.BytesIO(data), len(data), 0, len(data))]
    assert [(x[0], x[1]) for x in got] == [(1, url), (2, None)]
