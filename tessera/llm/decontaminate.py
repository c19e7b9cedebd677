"""Benchmark decontamination with DataFrame functions only.

The n-grams of the benchmark are a hash set of bounded size that is broadcast;
every token window of the training texts is looked up in it, hits are verified
word by word, and spans or whole documents go. A set beyond ``BROADCAST_BYTES``
is cut by hash into blocks within that bound, one pass over the texts for each.

Defined cases: null and wordless texts have no words, hits or items; a wordless
benchmark item has no window; items without an id count for nothing, but with
``unnamed``, as in the query and the pipeline, their windows hit as any other, and
they count as one item that is missing from the digest of ids; repeated
benchmark rows count once; repeated documents each get their result; an empty
table on either side gives no hits; other columns are kept or ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import apart, ascii_lower

#: What stands between words: all of ASCII but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing, with what follows a word.
PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
BROADCAST_BYTES = 64 << 20
#: Stands for a document where others have the hash of a window.
OWN = -1


def words(text: Column) -> Column:
    # split() costs a third of regexp_extract_all()
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def gram_hash(hashes: Column, at: Column, n: int) -> Column:
    """Hash of the ``n`` words from place ``at``, counted from 0."""
    return F.xxhash64(*[F.get(hashes, at + k) for k in range(n)])


def bench_windows(bench: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text", unnamed: bool = False) -> DataFrame:
    """(len, gram, items): the distinct windows with the ids that hold them; with
    ``unnamed`` also those of items without an id, as a null."""
    items = bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where((F.size("w") > 0) & (F.lit(unnamed) | F.col("item").isNotNull()))
    items = items.withColumn("len", F.least(F.size("w"), F.lit(n)))
    windows = items.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    windows = windows.select("item", "len", F.expr("slice(w, i, len)").alias("gram"))
    none = F.when(F.count_if(F.col("item").isNull()) > 0, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    return windows.groupBy("len", "gram").agg(F.concat(F.array_sort(F.collect_set("item")), none).alias("items"))


def _probe(docs: DataFrame, lengths: list[int], id_col: str, text_col: str) -> DataFrame:
    """(id, version, w, len, pos, h): every window of every text; pos from 1."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), words(F.col(text_col)).alias("w")).withColumn("hw", word_hashes(F.col("w")))
    places = lambda n: F.sequence(F.lit(0), F.size("w") - n)
    # The outer generators keep the optimizer from inferring a filter that would extract the words anew. The window's
    # hash is computed after them, in generated code and by single look-ups: slice() in a lambda copies the whole array.
    # Place -1 stands for the document itself, which so comes through without a second pass.
    if len(lengths) == 1:
        own = F.array(F.lit(-1))
        at = F.explode_outer(F.when(F.size("w") >= lengths[0], F.concat(own, places(lengths[0]))).otherwise(own))
        rows = rows.select("id", "version", "w", "hw", F.lit(lengths[0]).alias("len"), at.alias("at"))
    else:
        none = F.array(F.struct(F.lit(0).alias("len"), F.lit(-1).alias("at")))

        def each(n: int) -> Column:
            own = F.transform(places(n), lambda i: F.struct(F.lit(n).alias("len"), i.alias("at")))
            return F.when(F.size("w") >= n, own).otherwise(F.array().cast("array<struct<len:int,at:int>>"))

        rows = rows.withColumn("at", F.flatten(F.array(none, *map(each, lengths)))).select("id", "version", "w", "hw", F.inline_outer("at"))
    h = F.when(F.col("at") == -1, F.lit(OWN))
    for n in lengths[:-1]:
        h = h.when(F.col("len") == n, gram_hash(F.col("hw"), F.col("at"), n))
    h = h.otherwise(gram_hash(F.col("hw"), F.col("at"), lengths[-1]))
    return rows.select("id", "version", "w", "len", "at", h.alias("h"))


def find_hits(spark: SparkSession, docs: DataFrame, bench: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", unnamed: bool = False) -> DataFrame:
    """(id, version, n_words, copies, spans, items) of each distinct row of
    ``docs``; version: hash of its text; copies: rows like it. ``spans``: (pos,
    len) of the hit windows in order of place, from 1; ``items``: the ids of the
    benchmark items that own them, sorted."""
    windows = bench_windows(bench, n, item_col, unnamed=unnamed)
    sized = windows.groupBy("len").agg(F.sum(F.length(F.array_join("gram", " ")) + F.length(F.array_join("items", ",")) + 16 * F.col("len") + 64).alias("bytes")).collect()  # n rows at most
    lengths = sorted(r["len"] for r in sized) or [n]
    hashed = word_hashes(F.col("gram"))
    h = F.when(F.lit(False), F.lit(OWN))
    for k in lengths:
        h = h.when(F.col("len") == k, gram_hash(hashed, F.lit(0), k))
    windows = windows.select(h.alias("b_h"), "gram", "items")
    blocks = max(1, math.ceil(sum(r["bytes"] for r in sized) / BROADCAST_BYTES))
    own = spark.range(1).select(F.lit(OWN).alias("b_h"), F.array().cast("array<string>").alias("gram"), F.lit(None).cast("array<string>").alias("items"))
    parts = []
    for k in range(blocks):
        block = windows.where(F.pmod("b_h", F.lit(blocks)) == k) if blocks > 1 else windows
        block = F.broadcast(block if k else block.unionAll(own))
        # Written as two bounds, the comparison of the words is no join key: only windows with an equal hash get there.
        gram = F.expr("slice(w, at + 1, len)")
        same = ((F.col("at") == -1) & F.col("items").isNull()) | ((F.col("at") >= 0) & (gram >= F.col("gram")) & (gram <= F.col("gram")))
        parts.append(_probe(docs, lengths, id_col, text_col).join(block, (F.col("h") == F.col("b_h")) & same).select("id", "version", F.when(F.col("at") == -1, F.size("w")).alias("n_words"), (F.col("at") + 1).alias("pos"), "len", "items"))
    hits = reduce(DataFrame.unionAll, parts)
    return hits.groupBy("id", "version").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count("n_words").alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("pos") > 0, F.struct("pos", "len")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def covered(spans: Column) -> Column:
    """Number of places inside any of the (pos, len) spans, sorted by pos."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        stop = x["pos"] + x["len"]
        return F.struct(F.greatest(acc["end"], stop).alias("end"), (acc["n"] + F.greatest(F.lit(0), stop - F.greatest(acc["end"], x["pos"]))).alias("n"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def judge(spark: SparkSession, docs: DataFrame, bench: DataFrame, share: int = 20, **options) -> DataFrame:
    """The rows of ``find_hits`` with n_hit and contaminated: there are hit words,
    and they are at least one in ``share``."""
    hits = find_hits(spark, docs, bench, **options).withColumn("n_hit", covered(F.col("spans")))
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def _with(docs: DataFrame, judged: DataFrame, id_col: str, text_col: str, how: str) -> tuple[DataFrame, Callable[[str], Column]]:
    other, of = apart(docs, judged)
    return docs.join(other, F.col(id_col).eqNullSafe(of("id")) & (F.xxhash64(F.col(text_col)) == of("version")), how), of


def clean_documents(spark: SparkSession, docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated ones."""
    judged = judge(spark, docs, bench, id_col=id_col, text_col=text_col, **options).where("contaminated").select("id", "version")
    return _with(docs, judged, id_col, text_col, "left_anti")[0]


def remove_spans(spark: SparkSession, docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every hit word, and what follows it up to the next word,
    removed from the text; no document goes."""
    judged = judge(spark, docs, bench, id_col=id_col, text_col=text_col, **options).where("n_hit > 0").select("id", "version", "spans")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(PIECE), F.lit(0))
    head = F.regexp_extract(F.col(text_col), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    both, of = _with(docs, judged, id_col, text_col, "left")
    hit = lambda i: F.exists(of("spans"), lambda s: (i + 1 >= s["pos"]) & (i + 1 < s["pos"] + s["len"]))
    kept = F.concat(head, F.array_join(F.filter(pieces, lambda p, i: ~hit(i)), ""))
    return both.withColumn(text_col, F.when(of("spans").isNotNull(), kept).otherwise(F.col(text_col))).select(*[F.col(c) for c in docs.columns])


def digest(judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each row judged, repeated ones included."""
    rows = judged.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, CAST(least(len(w), 13) AS BIGINT) AS l, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, l, array_to_string(w[i : i + l - 1], ' ') AS s FROM bi),
ls AS (SELECT DISTINCT l FROM bw),
dp AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, ls WHERE len(w) >= l),
dw AS (SELECT doc_id, l, p, array_to_string(w[p : p + l - 1], ' ') AS s FROM dp),
hits AS (SELECT doc_id, p, dw.l AS l, item FROM dw JOIN bw ON dw.s = bw.s AND dw.l = bw.l),
places AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
coalesce(places.n, 0) > 0 AND 20 * coalesce(places.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
