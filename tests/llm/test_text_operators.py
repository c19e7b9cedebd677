"""Secrets, licences, decontamination and language identification."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, licenses, secrets

DOCS = "doc_id bigint, text string, lang string, source string, id string"


def documents(spark, texts, lang="en"):
    """Documents with a column whose name the operators use, too."""
    return spark.createDataFrame([(i, t, lang, "s", "x") for i, t in enumerate(texts)], DOCS)


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


TRICKY = [None, "", " ", "É Ñ\n\n", "x" * 70_000, "the same text", "the same text"]


def test_secrets_equal_brute_force(spark):
    key = "AKIA" + "A1" * 8
    texts = [*TRICKY, f"é {key} password = 'abcdef' hex {'ab01' * 6}", "PassWord:abc token=short1 " + "f" * 24, "password = token = abcdefgh", "toKen=abcdef.g, secret: abc", "ſecret=abcdef " + key[:19], f"😀 api_key=\"{'z' * 9}\""]
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan_documents(spark, documents(spark, texts))).collect()}
    patterns = {"assign": r"""((?:[pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD]))|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    for i, t in enumerate(texts):
        spans = []
        for rank, (kind, p) in enumerate(patterns.items()):
            for m in re.finditer(p, t or ""):
                if len(m[2 if kind == "assign" else 0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                    spans.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
        spans = [s for *_, s in sorted(spans)]
        want = [sum(s.startswith(k) for s in spans) for k in patterns]
        assert [got[i][f"n_{k}"] for k in patterns] == want
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_secret_ledger_scans_a_pair_once(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    docs = documents(spark, ["password=abcdef", "clean", "password=abcdef"])
    first = secrets.scan_documents(spark, docs, ledger=ledger, rules=secrets.RULES[:2])
    assert sorted(len(r["spans"]) for r in first.collect()) == [0, 1, 1]
    n = spark.read.parquet(ledger).count()
    assert n == 2
    secrets.scan_documents(spark, docs, ledger=ledger, rules=secrets.RULES[:2]).collect()
    assert spark.read.parquet(ledger).count() == n
    more = documents(spark, ["password=abcdef", "new " + "ab01" * 6])
    out = secrets.scan_documents(spark, more, ledger=ledger, rules=secrets.RULES[:3])
    assert sorted(len(r["spans"]) for r in out.collect()) == [1, 1]
    assert spark.read.parquet(ledger).where(F.array_contains("scanned", "hex@1")).count() == 2


def test_redaction(spark):
    docs = documents(spark, ["é password=abcdef end", None, "clean"]).withColumn("n_chars", F.length("text").cast("long"))
    out = {r["doc_id"]: r for r in secrets.redacted(spark, docs).collect()}
    assert out[0]["text"] == "é [SECRET] end" and out[0]["n_chars"] == 14
    assert out[1]["text"] is None and out[2]["text"] == "clean"


def test_licenses_equal_brute_force(spark):
    texts = [*TRICKY, "Released under the MIT License.\nMIT  license", "GNU General\nPublic License; apache-license", "CC-BY cc by", "permission is granted", "All rights reserved", " mit license "]
    got = {r["doc_id"]: r for r in licenses.digest(licenses.find_licenses(spark, documents(spark, texts))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w, places = words(t), []
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            places += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
        places.sort()
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
    assert got[11]["labels"] == "all-rights-reserved" and 0 < got[11]["score"] <= 1
    assert got[7]["labels"] == "mit"


def test_license_matches_are_all_above_the_threshold(spark):
    templates = (("a", "one two three four five six seven eight nine ten"), ("b", "one two"))
    texts = ["one two three four five six seven eight nine", "ten nine eight seven six five four three", "one\ntwo", "two one zero"]
    got = {r["id"]: [(m["label"], m["share"]) for m in r["matches"]] for r in licenses.find_licenses(spark, documents(spark, texts), templates=templates, threshold=0.9).collect()}
    assert got == {0: [("a", 0.9), ("b", 1.0)], 1: [], 2: [], 3: [("b", 1.0)]}


def test_long_licenses_equal_brute_force(spark):
    rng = random.Random(6)
    common = [f"c{k}" for k in range(12)]
    template = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else f"t{rng.randint(0, 80)}" for _ in range(n))
    templates = tuple((f"l{k}", template(n)) for k, n in enumerate((12, 40, 90, 150)))
    noise = lambda: " ".join(rng.choice([*common, "x", "y"]) for _ in range(rng.randint(0, 60)))
    texts = ["", noise()]
    for _ in range(60):
        w = rng.choice(templates)[1].split()
        for _ in range(rng.randint(0, len(w) // 2)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["x"], [w[at], "y"], [rng.choice(w)]])
        texts.append(f"{noise()} {' '.join(w)} {noise()}")
    got = {r["id"]: {m["label"]: round(m["share"], 9) for m in r["matches"]} for r in licenses.find_licenses(spark, documents(spark, texts), templates=templates, threshold=0.9).collect()}
    hits = 0
    for i, text in enumerate(texts):
        w, want = text.split(), {}
        for label, t in templates:
            s, span = set(t.split()), licenses._span(t)
            best = max((len(s & set(w[k : k + span])) for k in range(len(w))), default=0)
            if best >= licenses._need(len(s), 0.9):
                want[label] = round(best / len(s), 9)
        assert got[i] == want
        hits += len(want)
    assert 20 < hits < 60


def test_whole_license_texts(spark):
    long = [(x, t) for x, t in licenses.TEMPLATES if len(t.split()) > 30]
    edited = [" ".join(w for k, w in enumerate(t.split()) if k % 60 != 59) for _, t in long]
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.digest(licenses.find_licenses(spark, documents(spark, edited))).collect()}
    assert all(label in got[k] for k, (label, _) in enumerate(long))
    assert got[[x for x, _ in long].index("isc")] == ["isc"]


def test_licenses_wrapped_over_lines(spark):
    texts = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files",
        "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that",
        "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
        "gpl": "This program is free software: you can redistribute it and/or modify\n\nit under the terms of the GNU General Public License as published by",
        "agpl": "you can redistribute it and/or modify it under the terms of the GNU\nAffero General Public License, licensed under the GNU Affero General\nPublic License, version 3",
        "all-rights-reserved": "x " * 300 + "All rights\nreserved",
        "cc-by-sa": "licensed under CC\nBY-SA 3.0",
        "apache-2.0": "Licensed under the Apache\nSoftware License, Version 2",
    }
    other = ["Released under the X license", "all rights are with them", "this source code form is subject to the terms of the X public license", "all " + "x " * 20 + "rights reserved"]
    got = {r["id"]: [m["label"] for m in r["matches"]] for r in licenses.find_licenses(spark, documents(spark, [*texts.values(), *other])).collect()}
    assert [got[k] for k in range(len(got))] == [[x] for x in texts] + [[]] * len(other)


def decontaminated(text, items, n=13):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        k = min(n, len(b))
        grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k and item is not None else ()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("bytes_", [decontaminate.BROADCAST_BYTES, 400])
def test_decontamination_equals_brute_force(spark, monkeypatch, bytes_):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bytes_)
    long = " ".join(f"w{k}" for k in range(20))
    items = [(1, long), (2, "short item"), (10, "SHORT item"), (3, None), (4, "..."), (None, "the same"), (5, long)]
    texts = [*TRICKY, f"a {long.upper()} b", " ".join(f"w{k}" for k in range(12)), "A short-item here", "short " * 5 + "item " * 200, long + " x" * 400]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.judge(spark, documents(spark, texts), bench)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, hits, found, bad = decontaminated(t, items)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hits, len(found), bad), t
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_decontamination_removes(spark):
    bench = spark.createDataFrame([(1, "short item")], "item_id bigint, text string")
    docs = documents(spark, ["A Short-item! here", "clean text", None])
    assert sorted(r["doc_id"] for r in decontaminate.clean_documents(spark, docs, bench).collect()) == [1, 2]
    assert {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(spark, docs, bench).collect()} == {0: "A here", 1: "clean text", 2: None}
    none = decontaminate.digest(decontaminate.judge(spark, docs, bench.where("false")))
    assert none.count() == 3 and none.where("contaminated").count() == 0
    again = docs.unionAll(docs)
    assert decontaminate.digest(decontaminate.judge(spark, again, bench)).count() == 6


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = langid.train(spark, train, "doc_id", "lang", "text", 300)
    none = F.lit(None).cast("string")
    rows = test.select(F.col("doc_id").alias("id"), "text", none.alias("declared"), none.alias("suffix"), none.alias("host"), none.alias("domain"))
    got = langid.identify(spark, rows, model).join(test.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("truth")), "id")
    assert got.where("lang = truth").count() >= 0.98 * test.count()


def test_language_edges(spark):
    docs = documents(spark, [None, "", "123 456", *["the house is on the hill"] * 20]).unionAll(documents(spark, ["la maison est sur la colline"] * 20, "fr").withColumn("doc_id", F.col("doc_id") + 100))
    out = langid.identify_documents(spark, docs, sample_rows=100)
    assert out.count() == docs.count()
    assert out.where("lang = 'und'").count() == 3
    assert langid.accepted_documents(spark, docs, sample_rows=100).count() == 40
    assert langid.identify_documents(spark, docs.where("false")).count() == 0
    pages = spark.createDataFrame([(1, "https://a.example.fr/x", '<html lang="en-GB"><p>the house</p>'), (2, None, None)], "page_id bigint, url string, html string")
    model = langid.train(spark, docs, "doc_id", "lang", "text", 100)
    got = {r["page_id"]: r["lang"] for r in langid.identify_pages(spark, pages, model).collect()}
    assert got == {1: "en", 2: "und"}


def test_language_with_few_labels_and_without_any(spark):
    docs = documents(spark, [f"the house number {k} is on the hill" for k in range(2000)])
    rare = documents(spark, ["la maison est sur la colline", "une petite maison rouge"], "fr").withColumn("doc_id", F.col("doc_id") + 10_000)
    strange = documents(spark, ["это дом на холме, и он очень большой"], None).withColumn("doc_id", F.lit(20_000).cast("bigint"))
    docs = docs.unionAll(rare).unionAll(strange)
    assert langid.train(spark, docs, "doc_id", "lang", "text", 400).languages == ("en", "fr")
    got = {r["doc_id"]: (r["lang"], r["accepted"]) for r in langid.identify_documents(spark, docs, sample_rows=400).where("doc_id >= 10000").collect()}
    assert got == {10_000: ("fr", True), 10_001: ("fr", True), 20_000: ("und", False)}
    assert langid.identify_documents(spark, docs, sample_rows=400).where("lang = 'en' and accepted").count() == 2000


def test_language_query_covers_both_tables(spark):
    from tessera.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    pages, out = spark.read.parquet(f"{sf}/pages.parquet"), QUERIES["op10_language"](spark, sf)
    assert out.where("origin = 'documents' and page_id is null").count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    got = out.where("origin = 'pages'").select("page_id", "lang", "declared", "accepted").join(pages, "page_id")
    assert out.where("origin = 'pages' and doc_id is null").count() == got.count() == pages.count()
    assert got.where("declared is not null and accepted and lang = declared").count() >= 0.95 * pages.count()


def test_rejected_rows_take_no_others_along(spark):
    texts = ["the house is on the hill", "the hill is by the house"] * 10
    docs = spark.createDataFrame([(None, t, "en", "s", "x") for t in (*texts, "", "123")] + [(1, None, "en", "s", "x"), (1, texts[0], "en", "s", "x")], DOCS)
    assert sorted(r["text"] for r in langid.accepted_documents(spark, docs, sample_rows=100).collect()) == sorted([*texts, texts[0]])


def test_benchmark_items_without_an_id_hit(spark, tmp_path):
    import corpus_pipeline
    import duckdb

    from tessera.llm.queries import QUERIES

    documents(spark, ["The nameless item", "short item, nameless item", "clean", None]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "nameless item"), (1, "nameless item"), (None, "the"), (2, "short item")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES["op7_decontaminate"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(decontaminate.ORACLE).fetchall())
    kept = corpus_pipeline.benchmark(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_ledger_knows_rule_versions(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    docs = documents(spark, ["password=abcdef " + "ab01" * 6, "clean", None, "password=abcdef " + "ab01" * 6])
    base = tuple(r for r in secrets.RULES if r.kind in secrets.BASE_KINDS)
    secrets.scan_documents(spark, docs, rules=base, ledger=ledger)
    out = secrets.scan_documents(spark, docs, ledger=ledger)
    assert sorted(len(r["spans"]) for r in out.collect()) == [0, 0, 2, 2]
    held = [tuple(r["scanned"]) for r in spark.read.parquet(ledger).collect()]
    # each of the three blobs once with the base rules, then once with the added ones alone
    assert sorted(map(len, held)) == [3, 3, 3, 4, 4, 4] and not any("hex@1" in x for x in held if len(x) == 4)
    newer = (base[0]._replace(version="2", least=7), *base[1:])
    spans = [s for r in secrets.scan_documents(spark, docs, rules=newer, ledger=ledger).collect() for s in r["spans"]]
    assert {s["kind"] for s in spans} == {"hex"}  # what version 1 of the rule found is no finding of version 2


def test_no_texts_move_where_few_rows_need_none(spark, monkeypatch):
    from tessera.llm import common

    docs = documents(spark, ["password=abcdef", "x", "x", None])
    want = sorted(map(str, secrets.scan_documents(spark, docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(map(str, secrets.scan_documents(spark, docs).collect())) == want


def test_stages_with_clashing_names_and_odd_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 34", None, None, 5)], real.schema)
    extra = ["_id", "_o_id", "version", "blob", "spans", "_key", "id", "region"]
    docs = real.unionAll(real.limit(2)).unionAll(odd)
    for c in extra:
        docs = docs.withColumn(c, F.lit(c))
    docs = corpus_pipeline.materialize(spark, docs, "odd")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(spark, stage(spark, docs, sf), name)
        assert docs.columns == [*real.columns, *extra]
        assert docs.where("doc_id >= 1000000").isEmpty() and 0 < docs.count() <= n
        assert stage(spark, docs.where("false"), sf).isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_long_texts_are_scored_piece_by_piece(monkeypatch):
    table = langid._table()
    text = "the quick brown fox é " * 300
    whole = langid.counted(text, table)
    monkeypatch.setattr(langid, "CHUNK", 64)
    for a, b in zip(whole, langid.counted(text, table)):
        assert (a == b).all()
