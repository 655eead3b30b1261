"""Secret scans through an incremental ledger of blobs.

A text is named by its SHA-256. The ledger holds which (blob, rule, version) triples were scanned and
what was found in them, so a run scans each new blob once for each rule version it has not met, on
whichever path it stands, and joins the findings back to all paths. Changing a rule is raising its
version: only that rule is run again.

A null text is an empty blob. A path's findings are in code points, with exclusive ends. Rows that are
repeated get a result each. All steps are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.durable import new_folder, written_once
from ..sources.claim_ledger import read_if_there
from .tables import text_of

REDACTED = "[REDACTED]"


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if group `group` has `least` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


# The three kinds, in the order in which spans at one place are listed.
RULES = (
    Rule(
        "assign",
        1,
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", 1, r"(AKIA[A-Z0-9]+)", 1, 20),
    Rule("hex", 1, r"([0-9a-f]+)", 1, 24),
)


def _can_match(rule: Rule, text: Column) -> Column:
    """False only for texts without a match that counts: a cheap look before the matches are listed."""
    if rule.group == 1:
        return text.rlike(rule.pattern[:-2] + f"{{{_needed(rule)},}})")
    return text.rlike(rule.pattern)


def _needed(rule: Rule) -> int:
    """Repeats of the last class that a match of the least length needs."""
    fixed = rule.pattern[1 : rule.pattern.index("[")]
    return rule.least - len(fixed)


def _matches(blobs: DataFrame, rule: Rule) -> DataFrame:
    """(blob, kind, at, start, end) of each match that counts, from rows (blob, text)."""
    pattern = F.lit(rule.pattern)
    if rule.group == 1:
        # A run of one class: short runs can be left out of the matching itself.
        pattern = F.lit(rule.pattern[:-2] + f"{{{_needed(rule)},}})")
    pieces = F.arrays_zip(
        F.split(F.col("text"), pattern, -1).alias("gap"),
        F.regexp_extract_all("text", pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all("text", pattern, F.lit(rule.group)).alias("value"),
    )
    hits = blobs.where(_can_match(rule, F.col("text"))).select("blob", F.posexplode(pieces).alias("at", "p"))
    rows = hits.select("blob", "at", F.length("p.gap").alias("gap"), F.coalesce(F.length("p.match"), F.lit(0)).alias("n"), F.length("p.value").alias("value"))
    before = W.partitionBy("blob").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap") + F.col("n")).over(before).cast("long")
    return (
        rows.withColumn("end", end)
        .where(F.col("value") >= rule.least)
        .select("blob", F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), (F.col("end") - F.col("n")).alias("start"), "end")
    )


SCANNED = "blob string, kind string, version int"
FOUND = SCANNED + ", start long, end long"


class Ledger:
    """Two tables in a folder: what was scanned, and what was found. Findings are written first; a new folder is an empty ledger."""

    def __init__(self, spark, folder: str | None = None):
        self.spark = spark
        self.folder = folder or new_folder(spark, "secret-ledger")

    def _read(self, name: str, schema: str) -> DataFrame:
        return read_if_there(self.spark, f"{self.folder}/{name}", schema)

    @property
    def scanned(self) -> DataFrame:
        return self._read("scanned", SCANNED)

    @property
    def found(self) -> DataFrame:
        """A batch that died after its findings is scanned again, so equal findings count once."""
        return self._read("found", FOUND).distinct()

    def add(self, found: DataFrame, scanned: DataFrame) -> None:
        found.write.mode("append").parquet(f"{self.folder}/found")
        scanned.write.mode("append").parquet(f"{self.folder}/scanned")


def blob_of(text: Column) -> Column:
    return F.sha2(text, 256)


def scan_new(docs: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES, key: str = "doc_id") -> int:
    """Scan what the ledger does not hold of the texts of docs; gives the number of (blob, rule) pairs scanned."""
    paths = docs.select(F.col(key).alias("path"), text_of().alias("text")).withColumn("blob", blob_of(F.col("text")))
    # One row of each blob stands for it; only names move until then.
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
    asked = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    wanted = blobs.select("blob", "path", F.inline(asked))
    unseen = written_once(wanted.join(ledger.scanned, ["blob", "kind", "version"], "left_anti"), "unseen-pairs")
    todo = unseen.groupBy("blob", "path").agg(F.collect_set("kind").alias("kinds"))
    mine = F.col("p.blob").eqNullSafe(F.col("u.blob")) & F.col("p.path").eqNullSafe(F.col("u.path"))
    # Of the new blobs only those in which an asked rule can match go on. As a choice by what is asked
    # this is not moved in front of the join, where it would look at texts that are known.
    hit = F.lit(False)
    for rule in rules:
        hit = hit | F.when(F.array_contains("kinds", rule.kind), _can_match(rule, F.col("text"))).otherwise(F.lit(False))
    texts = paths.alias("p").join(todo.alias("u"), mine).where(hit).select("p.blob", "text", "kinds")
    texts = written_once(texts.dropDuplicates(["blob"]), "unseen-blobs")
    found = None
    for rule in rules:
        one = _matches(texts.where(F.array_contains("kinds", rule.kind)), rule)
        found = one if found is None else found.unionByName(one)
    ledger.add(found, unseen.select("blob", "kind", "version"))
    return unseen.count()


def _order(kind: Column, rules: Sequence[Rule]) -> Column:
    place = F.lit(len(rules))
    for k, rule in enumerate(rules):
        place = F.when(kind == rule.kind, k).otherwise(place)
    return place


def by_blob(ledger: Ledger, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, found): the findings of the rules' present versions, by start and then kind."""
    current = F.lit(False)
    for rule in rules:
        current = current | ((F.col("kind") == rule.kind) & (F.col("version") == rule.version))
    span = F.struct("start", _order(F.col("kind"), rules).alias("place"), "kind", "end")
    return ledger.found.where(current).groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("found"))


def with_findings(docs: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES, carry: Sequence[str] | None = None) -> DataFrame:
    """(row, found): each row of docs as a struct of the carried columns, by default all, and its findings or an empty list.

    Every path of a blob has the blob's findings. Texts are moved only if they are carried.

    The findings are a table of their own, so that the join splits a blob with very many paths.
    """
    findings = written_once(by_blob(ledger, rules), "findings-by-blob")
    row = F.struct("*") if carry is None else F.struct(*carry)
    named = docs.select(row.alias("row"), blob_of(text_of()).alias("blob"))
    none = F.array().cast(findings.schema["found"].dataType)
    # Findings grow with the texts, so at no size is their table sent to all tasks.
    return named.join(findings.hint("merge"), "blob", "left").select("row", F.coalesce("found", none).alias("found"))


def without_secrets(docs: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of docs with what was found in their texts replaced; n_chars, if there is one, follows."""
    clean = F.when(F.col("row.text").isNotNull(), redacted(F.col("row.text"), F.col("found")))
    kept = with_findings(docs, ledger, rules).select("row", clean.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col("text")}
    return kept.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def listed(found: Column, kinds: Sequence[str] | None = None) -> Column:
    """kind:start:end of findings, comma-joined."""
    some = found if kinds is None else F.filter(found, lambda f: f["kind"].isin(list(kinds)))
    return F.array_join(F.transform(some, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long")


def redacted(text: Column, found: Column) -> Column:
    """The text with each stretch that findings cover, overlaps taken together, replaced by a mark."""

    def merge(done: Column, f: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], f["end"]).alias("end"))
        apart = (F.size(done) == 0) | (f["start"] > F.try_element_at(done, F.lit(-1))["end"])
        return F.when(apart, F.concat(done, F.array(F.struct(f["start"], f["end"])))).otherwise(
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))
        )

    runs = F.aggregate(found, F.array().cast("array<struct<start: bigint, end: bigint>>"), merge)

    def put(done: Column, run: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, (run["start"] - done["at"]).cast("int"))
        return F.struct(F.concat(done["kept"], gap, F.lit(REDACTED)).alias("kept"), run["end"].cast("int").alias("at"))

    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    whole = F.aggregate(runs, start, put, lambda done: F.concat(done["kept"], F.substring(text, done["at"] + 1, F.length(text))))
    return F.when(F.size(found) == 0, text).otherwise(whole)
