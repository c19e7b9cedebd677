"""Secret scanning over an incremental ledger of content-addressed blobs.

Every version of a text is named by the SHA-256 of its content. A (blob, rule
version) pair is scanned once; findings are joined back to every path (row) that
holds the blob. Only narrow columns are grouped by blob, so a blob that a third
of all rows share costs one row per map task. Texts do not move where the rows that
need no scan, or another one than most, are few enough to be named to every task.

Defined cases: a null text is the empty text; a null id is an id like any other;
repeated rows each get their result; empty tables give empty results; other
columns of the input are ignored and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import apart, broadcasts, materialize, small_batches


class Rule(NamedTuple):
    """``needs``: strings of which the lower-cased text must hold one; ``least``:
    characters that ``group`` must have, else the match is dropped."""

    kind: str
    version: str
    pattern: str
    needs: tuple[str, ...] = ()
    group: int = 0
    least: int = 0
    flags: int = 0


BASE_KINDS = ("assign", "access", "hex")

#: The order of the rules is the order of kinds that start at one place.
RULES = (
    Rule("assign", "1", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("password", "passwd", "secret", "token", "apikey", "api_key"), 2, 6, re.IGNORECASE | re.ASCII),
    Rule("access", "1", r"AKIA[A-Z0-9]+", ("akia",), 0, 20),
    Rule("hex", "1", r"[0-9a-f]{24,}"),
    Rule("github", "1", r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", "1", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("jwt", "1", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
    Rule("pem", "1", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", ("private key-----",)),
)

SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint,version:string>>"


def find_spans(text: str, rules: tuple[Rule, ...] = RULES, compiled: list | None = None) -> list[tuple[int, int, str, int]]:
    """(start, rank of the kind, kind, end) of every match, in order."""
    compiled = compiled or [re.compile(r.pattern, r.flags) for r in rules]
    lower, out = text.lower(), []
    for rank, (rule, found) in enumerate(zip(rules, compiled)):
        if rule.needs and not any(x in lower for x in rule.needs):
            continue
        for m in found.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((m.start(), rank, rule.kind, m.end()))
    out.sort()
    return out


def _tag(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def _scan(rules: tuple[Rule, ...]):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = {r.kind: re.compile(r.pattern, r.flags) for r in rules}
        known = {r.kind: (i, r.version) for i, r in enumerate(rules)}
        for batch in batches:
            rows = []
            for blob, text, pending in zip(batch["blob"], batch["text"], batch["pending"]):
                wanted = set(pending)
                todo = tuple(r for r in rules if _tag(r) in wanted)
                spans = find_spans(text, todo, [compiled[r.kind] for r in todo])
                rows.append((blob, list(pending), [(s, known[k][0], k, e, known[k][1]) for s, _, k, e in spans]))
            yield pd.DataFrame(rows, columns=["blob", "scanned", "spans"])

    return scan


def _pending(spark: SparkSession, paths: DataFrame, rules: tuple[Rule, ...], ledger: str | None) -> DataFrame:
    """(id, blob, pending) of every path: the rule versions that its text is to be
    scanned for. Of paths with one blob only that with the smallest id has any."""
    tags = F.array(*[F.lit(_tag(r)) for r in rules])
    none = F.array().cast("array<string>")
    reps = paths.groupBy("blob").agg(F.min("id").alias("rep"))
    if ledger and _exists(spark, ledger):
        done = spark.read.parquet(ledger).select("blob", F.explode("scanned").alias("tag")).where(F.col("tag").isin([_tag(r) for r in rules])).groupBy("blob").agg(F.collect_set("tag").alias("done"))
        reps = reps.join(done, "blob", "left").select("blob", "rep", F.array_except(tags, F.coalesce("done", none)).alias("todo"))
    else:
        reps = reps.withColumn("todo", tags)
    found = paths.join(reps, "blob").select("id", "blob", F.when(F.col("id").eqNullSafe(F.col("rep")), F.col("todo")).otherwise(none).alias("pending"))
    return materialize(spark, found.dropDuplicates(["id", "blob"]), "secrets-pending")


def scan_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """One row (id, blob, spans) per row of ``docs``.

    ``ledger``: a path that holds rows (blob, scanned rule versions, spans). Pairs of
    a blob and a rule version that it holds are not scanned again; new ones are
    appended. Spans of other versions than those of ``rules`` stay there and out of
    the result. Without it every pair counts as unseen.
    """
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    paths = texts.select("id", "blob")
    pending = _pending(spark, paths, rules, ledger)
    sets = pending.groupBy("pending").count().collect()  # as many rows as there are sets of rules to do, few
    total = sum(r["count"] for r in sets)
    main = max((r for r in sets if r["pending"]), key=lambda r: r["count"], default=None)
    if main is None:
        unseen = None
    elif broadcasts(total - main["count"], 160):
        # most texts are scanned for the same rules: only the others are named to them, and no text moves
        usual = F.array(*[F.lit(x) for x in main["pending"]])
        others = pending.where(F.col("pending") != usual).select(F.col("id").alias("o_id"), F.col("blob").alias("o_blob"), F.col("pending").alias("own"))
        unseen = texts.join(F.broadcast(others), F.col("id").eqNullSafe(F.col("o_id")) & (F.col("blob") == F.col("o_blob")), "left").select("blob", "text", F.coalesce("own", usual).alias("pending")).where(F.size("pending") > 0)
    else:
        todo = pending.where(F.size("pending") > 0).select(F.col("id").alias("t_id"), F.col("blob").alias("t_blob"), "pending")
        unseen = texts.join(todo.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("t_id")) & (F.col("blob") == F.col("t_blob"))).select("blob", "text", "pending")
    scanned = unseen.mapInPandas(_scan(rules), f"blob binary, scanned array<string>, spans {SPANS}").dropDuplicates(["blob"]) if unseen else None
    if ledger:
        if scanned:
            materialize(spark, scanned, "secrets").write.mode("append").parquet(ledger)
        known = spark.read.parquet(ledger) if _exists(spark, ledger) else None
    else:
        known = scanned
    if known is None:  # nothing was ever scanned
        return paths.select(F.col("id").alias(id_col), "blob", F.array().cast(SPANS).alias("spans"))
    tag = lambda x: F.concat(x["kind"], F.lit("@"), x["version"])
    current = F.filter("spans", lambda x: tag(x).isin([_tag(r) for r in rules]))
    found = known.select("blob", current.alias("spans")).where(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return paths.join(found, "blob", "left").select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the base spans and the list of all spans."""
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(id_col, *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _merged(spans: Column) -> Column:
    """Overlapping spans, sorted by start, joined to (start, end) pairs."""
    kind = "array<struct<start:bigint,end:bigint>>"
    last = lambda acc: F.try_element_at(acc, F.lit(-1))

    def add(acc: Column, x: Column) -> Column:
        own = F.struct(x["start"].alias("start"), x["end"].alias("end"))
        joined = F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))
        overlaps = F.coalesce(last(acc)["end"] > x["start"], F.lit(False))
        return F.when(overlaps, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(own))).cast(kind)

    return F.aggregate(spans, F.array().cast(kind), add)


def redacted(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", mark: str = "[SECRET]", ledger: str | None = None) -> DataFrame:
    """``docs`` with each maximal run of spans in ``text`` replaced by ``mark`` and
    ``n_chars`` renewed where that changed a text; no row goes."""
    dirty = scan_documents(spark, docs, id_col, ledger=ledger).where(F.size("spans") > 0).dropDuplicates([id_col, "blob"]).select(F.col(id_col).alias("id"), "blob", _merged(F.col("spans")).alias("runs"))
    dirty, of = apart(docs, dirty)
    own = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    both = docs.join(dirty.hint("shuffle_hash"), F.col(id_col).eqNullSafe(of("id")) & (own == of("blob")), "left")
    text = F.aggregate(F.reverse(of("runs")), F.col("text"), lambda t, x: F.overlay(t, F.lit(mark), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))
    clean = of("runs").isNull()
    both = both.withColumn("text", F.when(clean, F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(clean, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return both.select(*[F.col(c) for c in docs.columns])
