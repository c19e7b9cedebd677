"""Language identification by Bayesian fusion of evidence.

log posterior = text likelihood + declared language + address suffix + host prior

The text likelihood is a naive Bayes model of byte trigrams, trained here on a
bounded sample of each label's rows and tempered to ``FULL_WEIGHT`` trigrams, since
neighbouring trigrams are not independent. Labels are counted over all rows, and
each gets an equal share of ``sample_rows``, about, but ``LEAST_ROWS`` or all that
it has at least, so that every labelled language has a model. Host priors are counts
of text-only labels over all rows, by grouped aggregation: a host is smoothed
towards its domain, a domain towards the whole corpus, and a row's own vote is
left out. Rows that no language explains with ``LEAST_CONFIDENCE``, and texts that
every model explains worse than chance does, are rejected.

Defined cases: a null or empty text has no text evidence (other evidence and
priors decide, but it is rejected as it has no letters); null declared languages,
addresses and hosts are no evidence; repeated rows each get a row; with an empty
table, or without any label, the result is empty or every row is "und".
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import apart, broadcasts, materialize, small_batches

BUCKETS = 1 << 14
SAMPLE_ROWS = 4000
#: So many rows of each language are drawn at least, or all that it has.
LEAST_ROWS = 200
FULL_WEIGHT = 60
#: Parts of the labelled rows; a row is scored by a model that has seen no row of its part, so its own label does not count twice.
FOLDS = 2
#: Bytes of a text that are taken at a time.
CHUNK = 1 << 20
#: How often a declaration, or an address suffix, names the true language.
DECLARED_TRUST, SUFFIX_TRUST = 0.9, 0.7
#: Pseudo-counts that pull a host to its domain, and a domain to the corpus.
HOST_WEIGHT, DOMAIN_WEIGHT = 20.0, 50.0
LEAST_CONFIDENCE = 0.5
SALTS = 32

#: Languages that an address ending suggests.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "ch": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl"}


class Model(NamedTuple):
    languages: tuple[str, ...]
    log_p: np.ndarray  # FOLDS + 1 x BUCKETS x languages: without the rows of each fold, and by all


def fold(*cols: Column) -> Column:
    """The fold of a row, by its hash: the model without it scores it."""
    return F.pmod(F.xxhash64(*cols, F.lit(13)), F.lit(FOLDS)).cast("int")


def _table() -> np.ndarray:
    """Bytes in lower case; digits as one, other ASCII signs as space."""
    t = np.arange(256, dtype=np.uint32)
    for c in range(128):
        x = chr(c)
        t[c] = ord(x.lower()) if x.isalpha() else ord("0") if x.isdigit() else 32
    return t


def trigrams(framed: bytes, table: np.ndarray) -> np.ndarray:
    """The bucket of every byte trigram."""
    a = table[np.frombuffer(framed, dtype=np.uint8)]
    x = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35)
    return (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18)


def counted(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of the text, framed by spaces, and how often each
    comes; of a long text piece by piece."""
    raw = b" " + text.encode("utf-8", "replace") + b" "
    if len(raw) <= CHUNK:
        return np.unique(trigrams(raw, table), return_counts=True)
    n = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(raw) - 2, CHUNK):
        n += np.bincount(trigrams(raw[at : at + CHUNK + 2], table), minlength=BUCKETS)
    return np.flatnonzero(n), n[n > 0]


def train(spark: SparkSession, labelled: DataFrame, id_col: str, label_col: str, text_col: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model from about ``sample_rows`` labelled rows, as many of each label as
    can be, picked by their hash."""
    small_batches(spark)
    known = labelled.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(7)).alias("h"), fold(F.col(id_col), F.col(text_col)).alias("fold"))
    known = known.where(F.col("label").isNotNull() & (F.length("text") > 0))
    counts = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("first")).collect()  # as many rows as there are languages
    if not counts:
        return Model((), np.zeros((FOLDS + 1, BUCKETS, 0)))
    each = max(LEAST_ROWS, sample_rows // len(counts))
    # A label's first hash comes along in any case, so that none goes without a row.
    most = lambda r: max(r["first"], -(1 << 63) + (((1 << 64) - 1) * min(each, r["n"])) // r["n"])
    bounds = spark.createDataFrame([(r["label"], most(r)) for r in counts], "label string, most bigint")
    sample = known.join(F.broadcast(bounds), "label").where(F.col("h") <= F.col("most")).select("label", "text", "fold").repartition(8)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, found = _table(), {}
        for batch in batches:
            for label, text, part in zip(batch["label"], batch["text"], batch["fold"]):
                if isinstance(text, str) and text:
                    at, n = counted(text, table)
                    c = found.setdefault((label, part), np.zeros(BUCKETS, dtype="<i8"))
                    c[at] += n
        yield pd.DataFrame({"label": [x for x, _ in found], "fold": [x for _, x in found], "counts": [c.tobytes() for c in found.values()]})

    sums: dict[str, np.ndarray] = {}
    for r in sample.mapInPandas(count, "label string, fold int, counts binary").collect():  # 8 rows a language and fold at most
        sums.setdefault(r["label"], np.zeros((FOLDS, BUCKETS)))[r["fold"]] += np.frombuffer(r["counts"], dtype="<i8")
    languages = tuple(sorted(sums))
    by_fold = np.stack([sums[x] for x in languages], axis=2)
    every = by_fold.sum(axis=0)
    parts = [every - part for part in by_fold] + [every]
    # a language with rows of one fold alone has no other model
    c = np.stack([np.where(p.sum(axis=0) > 0, p, every) for p in parts]) + 0.5
    return Model(languages, np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32))


def text_scores(text: str | None, model: Model, table: np.ndarray, part: int = FOLDS) -> np.ndarray:
    """The tempered log likelihood of the whole text, by language."""
    if not text:
        return np.zeros(len(model.languages))
    at, n = counted(text, table)
    return n @ model.log_p[part][at].astype(np.float64) / n.sum() * min(FULL_WEIGHT, n.sum())


def score_rows(spark: SparkSession, rows: DataFrame, model: Model) -> DataFrame:
    """(id, declared, suffix, host, domain) of ``rows`` with ll, the text's score
    by language, vote, the best of them, letters, whether there are any, and
    explained, whether a model does so no worse than chance (all trigrams alike)."""
    small_batches(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _table()
        for batch in batches:
            texts = [x if isinstance(x, str) else "" for x in batch["text"]]
            scores = [text_scores(x, model, table, part) for x, part in zip(texts, batch["fold"])]
            out = batch.drop(columns=["text", "fold"])
            out["ll"] = scores
            out["vote"] = [int(s.argmax()) if len(s) and x else -1 for s, x in zip(scores, texts)]
            out["letters"] = [any(map(str.isalpha, x)) for x in texts]
            # len(bytes) trigrams, as the text is framed by spaces
            out["explained"] = [bool(len(s)) and bool(s.max() >= -math.log(BUCKETS) * min(FULL_WEIGHT, len(x.encode("utf-8", "replace")))) for s, x in zip(scores, texts)]
            yield out

    return rows.mapInPandas(run, "id string, declared string, suffix string, host string, domain string, ll array<double>, vote int, letters boolean, explained boolean")


def _counts(scored: DataFrame, by: str | None, n: int) -> DataFrame:
    counts = F.array(*[F.count_if(F.col("vote") == k) for k in range(n)])
    if by is None:
        return scored.agg(counts.alias("all_counts"))
    return scored.where(F.col(by).isNotNull()).groupBy(F.col(by).alias(f"{by}_key")).agg(counts.alias(f"{by}_counts"))


def _join(rows: DataFrame, counts: DataFrame, by: str, n: int) -> DataFrame:
    """Counts of the row's group; a table that is no small one is joined with
    salted keys, so that no group's rows meet in one task."""
    if broadcasts(counts.count(), 200 + 8 * n):
        return rows.join(F.broadcast(counts), F.col(by) == F.col(f"{by}_key"), "left").drop(f"{by}_key")
    salted = counts.withColumn("salt_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, (F.col(by) == F.col(f"{by}_key")) & (F.col("salt") == F.col("salt_key")), "left").drop(f"{by}_key", "salt", "salt_key")


def identify(spark: SparkSession, rows: DataFrame, model: Model) -> DataFrame:
    """(id, lang, confidence, declared, accepted) of each row of (id, text,
    declared, suffix, host, domain), and of fold where rows may have trained the
    model; missing evidence is null."""
    n = len(model.languages)
    keyed = rows.select(F.col("id").cast("string").alias("id"), "declared", "suffix", "host", "domain", "text", F.col("fold") if "fold" in rows.columns else F.lit(FOLDS).alias("fold"))
    if not n:
        return keyed.select("id", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), "declared", F.lit(False).alias("accepted"))
    scored = materialize(spark, score_rows(spark, keyed, model), "langid")
    corpus = scored.agg(*[F.count_if(F.col("vote") == k).alias(str(k)) for k in range(n)]).first()
    total = sum(corpus)
    counts = {by: materialize(spark, _counts(scored, by, n), f"langid-{by}") for by in ("host", "domain")}
    joined = scored
    for by in ("domain", "host"):
        joined = _join(joined, counts[by], by, n)

    own = lambda k: F.when(F.col("vote") == k, F.lit(1)).otherwise(F.lit(0))
    any_own = F.when(F.col("vote") >= 0, F.lit(1)).otherwise(F.lit(0))

    def smoothed(by: str, k: int, above: Column, weight: float) -> Column:
        c = F.coalesce(F.col(f"{by}_counts")[k] - own(k), F.lit(0))
        all_c = F.coalesce(F.aggregate(f"{by}_counts", F.lit(0).cast("long"), lambda a, x: a + x) - any_own, F.lit(0))
        return (c + weight * above) / (all_c + weight)

    def trust(col: str, k: int, p: float) -> Column:
        known = F.col(col).isin(list(model.languages))
        hit = F.when(F.col(col) == model.languages[k], F.lit(math.log(p))).otherwise(F.lit(math.log((1 - p) / max(1, n - 1))))
        return F.when(known, hit).otherwise(F.lit(0.0)) if n > 1 else F.lit(0.0)

    scores = []
    for k in range(n):
        prior = smoothed("host", k, smoothed("domain", k, F.lit((corpus[k] + 1.0) / (total + n)), DOMAIN_WEIGHT), HOST_WEIGHT)
        scores.append(F.col("ll")[k] + trust("declared", k, DECLARED_TRUST) + trust("suffix", k, SUFFIX_TRUST) + F.log(prior))
    fused = joined.withColumn("scores", F.array(*scores))
    best = F.array_max("scores")
    confidence = 1.0 / F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    lang = F.element_at(F.array(*[F.lit(x) for x in model.languages]), F.array_position("scores", best).cast("int"))
    out = fused.select("id", lang.alias("lang"), confidence.alias("confidence"), "declared", "letters", "explained")
    accepted = F.col("letters") & F.col("explained") & (F.col("confidence") >= LEAST_CONFIDENCE)
    return out.select("id", F.when(accepted, F.col("lang")).otherwise(F.lit("und")).alias("lang"), "confidence", "declared", accepted.alias("accepted"))


def address_evidence(url: Column) -> dict[str, Column]:
    """host, domain and suffix of an address: the ending of the host, or else a
    path that starts with a two-letter segment."""
    host = F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit(""))
    ending = F.element_at(F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair]), F.regexp_extract(host, r"\.([a-z]+)$", 1))
    path = F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/]+/([a-z]{2})(?:[/?#-]|$)", 1), F.lit(""))
    return {"host": host, "domain": F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), "suffix": F.coalesce(path, ending)}


def markup_language(html: Column) -> Column:
    """The language that the html element declares, in its primary part."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)), F.lit(""))


def identify_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source", sample_rows: int = SAMPLE_ROWS, model: Model | None = None) -> DataFrame:
    """Documents whose declared language labels the training sample, too, if there
    is no ``model`` yet; the source takes the place of the host."""
    model = model or train(spark, docs, id_col, declared_col, text_col, sample_rows)
    none = F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lower(F.substring(F.col(declared_col), 1, 2)).alias("declared"), none.alias("suffix"), F.col(host_col).cast("string").alias("host"), none.alias("domain"), fold(F.col(id_col), F.col(text_col)).alias("fold"))
    kind = docs.schema[id_col].dataType.simpleString()
    return identify(spark, rows, model).selectExpr(f"cast(id as {kind}) as {id_col}", "lang", "confidence", "declared", "accepted")


def identify_pages(spark: SparkSession, pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Web pages: the text without tags, the markup's language and the address."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html_col, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    where = address_evidence(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), text.alias("text"), markup_language(F.col(html_col)).alias("declared"), *[where[c].alias(c) for c in ("suffix", "host", "domain")])
    kind = pages.schema[id_col].dataType.simpleString()
    return identify(spark, rows, model).selectExpr(f"cast(id as {kind}) as {id_col}", "lang", "confidence", "declared", "accepted")


def identify_corpus(spark: SparkSession, docs: DataFrame, pages: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every row of both tables, by the model of the labelled documents. ``origin``
    names the table; the id of the other one is null."""
    model = train(spark, docs, "doc_id", "lang", "text", sample_rows)
    found = identify_documents(spark, docs, model=model).withColumn("origin", F.lit("documents"))
    return found.unionByName(identify_pages(spark, pages, model).withColumn("origin", F.lit("pages")), allowMissingColumns=True).select("origin", "doc_id", "page_id", "lang", "confidence", "declared", "accepted")


def accepted_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rejected ones. A decision holds for the rows of one id
    and the same evidence, so that no other row with that id, or without any, goes."""
    model = train(spark, docs, id_col, declared_col, text_col, sample_rows)
    evidence = [x for c in (text_col, declared_col, host_col) for x in (F.col(c), F.col(c).isNull())]
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.xxhash64(F.col(id_col).isNull(), *evidence).cast("string"))
    # the fold is that of the row's own id, by which the model was trained
    none = F.lit(None).cast("string")
    rows = docs.select(key.alias("id"), F.col(text_col).alias("text"), F.lower(F.substring(F.col(declared_col), 1, 2)).alias("declared"), none.alias("suffix"), F.col(host_col).cast("string").alias("host"), none.alias("domain"), fold(F.col(id_col), F.col(text_col)).alias("fold"))
    rejected, of = apart(docs, identify(spark, rows, model).where(~F.col("accepted")).select("id").distinct())
    return docs.join(rejected, key == of("id"), "left_anti")
