"""Raw findings in either casing, bare or in an envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


# A date with a time of day, in full; parts of one would be filled up from today.
ISO_MOMENT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def read_findings(spark: SparkSession, path: str, *, whole_files: bool = True, every: bool = True) -> DataFrame:
    """(raw VARIANT) per finding from JSON files, one document per file or per line."""
    return unwrap(spark.read.text(path, wholetext=whole_files), "value", every=every)


def unwrap(documents: DataFrame, column: str, *, every: bool = True) -> DataFrame:
    """Adds `raw`: the event's `detail`, each of `Findings`, or the document itself.

    With every=False, for a finding asked for by hand, a response gives its first finding only.
    """
    document = F.try_parse_json(F.col(column))
    inner = F.try_variant_get(document, "$.detail", "variant")
    if every:
        listed = F.try_variant_get(document, "$.Findings", "array<variant>")
        return documents.withColumn("raw", F.explode(F.coalesce(F.when(inner.isNotNull(), F.array(inner)), listed, F.array(document))))
    first = F.try_variant_get(document, "$.Findings[0]", "variant")
    return documents.withColumn("raw", F.coalesce(inner, first, document))


def _either(value: Column, name: str) -> Column:
    """VARIANT under the PascalCase or else the camelCase name; a null that is present counts."""
    camel = name[0].lower() + name[1:]
    return F.coalesce(F.try_variant_get(value, f"$.{name}", "variant"), F.try_variant_get(value, f"$.{camel}", "variant"))


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def finding_id(raw: Column) -> Column:
    """First non-empty of Id and id."""
    both = [F.nullif(F.try_variant_get(raw, path, "string"), F.lit("")) for path in ("$.Id", "$.id")]
    return F.coalesce(*both)


def center_time(raw: Column, run_ts: Column) -> Column:
    """Last-seen, updated, first-seen or created time, whichever is first there; the run's time if it will not parse."""
    service = _either(raw, "Service")
    values = [_either(service, "EventLastSeen"), _either(raw, "UpdatedAt"), _either(service, "EventFirstSeen"), _either(raw, "CreatedAt")]
    # A number is no time, so only what is text counts.
    texts = [F.when(F.schema_of_variant(v) == "STRING", _as(v, "string")) for v in values]
    chosen = F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])
    whole = F.when(chosen.rlike(ISO_MOMENT), F.try_to_timestamp(chosen))
    return F.coalesce(whole, run_ts)


def parse_findings(
    raw: DataFrame,
    *,
    run_ts: Column,
    detector_id: str | None = None,
    ingest_time: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The findings table from rows with a `raw` VARIANT; `keep` names columns to carry along."""
    value = F.col("raw")
    resource = _either(value, "Resource")
    access = _either(resource, "AccessKeyDetails")
    instance = _either(resource, "InstanceDetails")
    own_detector = _as(_either(_either(value, "Service"), "DetectorId"), "string")
    return raw.select(
        *keep,
        finding_id(value).alias("finding_id"),
        _as(_either(value, "Type"), "string").alias("type"),
        _as(_either(value, "Severity"), "double").alias("severity"),
        _as(_either(value, "Title"), "string").alias("title"),
        _as(_either(value, "Region"), "string").alias("region"),
        _as(_either(resource, "ResourceType"), "string").alias("resource_type"),
        _as(_either(access, "AccessKeyId"), "string").alias("access_key_id"),
        _as(_either(access, "PrincipalId"), "string").alias("principal_id"),
        _as(_either(access, "UserType"), "string").alias("user_type"),
        _as(_either(access, "UserName"), "string").alias("user_name"),
        _as(_either(instance, "InstanceId"), "string").alias("instance_id"),
        center_time(value, run_ts).alias("center_time"),
        (F.lit(detector_id) if detector_id else own_detector).alias("detector_id"),
        (run_ts if ingest_time is None else ingest_time).alias("ingest_time"),
    )


def parse_labeled(files: DataFrame, *, run_ts: Column, detector_id: str | None = None) -> DataFrame:
    """Labelled findings by name, from rows (path, document): name is the file's stem."""
    labels = files.select(
        F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("name"), F.try_parse_json("document").alias("_d")
    ).select(
        "name",
        F.try_variant_get("_d", "$.expected_severity", "string").alias("expected_severity"),
        F.try_variant_get("_d", "$.finding", "variant").alias("raw"),
    )
    return parse_findings(labels, run_ts=run_ts, detector_id=detector_id, keep=("name", "expected_severity")).orderBy("name")


def read_labeled(spark: SparkSession, directory: str, *, run_ts: Column, detector_id: str | None = None) -> DataFrame:
    """Labelled findings of all JSON files in a folder."""
    files = spark.read.text(directory, wholetext=True, pathGlobFilter="*.json")
    documents = files.select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("document"))
    return parse_labeled(documents, run_ts=run_ts, detector_id=detector_id)
