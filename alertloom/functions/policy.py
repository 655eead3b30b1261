"""Blast-radius bands of managed policy names and inline policy documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Managed policy names and the bands they stand for.
CRITICAL_NAMES = ("AdministratorAccess",)
HIGH_NAMES = (
    "IAMFullAccess",
    "PowerUserAccess",
    "SecretsManagerReadWrite",
    "AdministratorAccess-Amplify",
)
HIGH_SUFFIX = "FullAccess"
HIGH_FRAGMENTS = ("SecretsManager", "KeyManagementService")
MEDIUM_NAMES = ("SecurityAudit", "ViewOnlyAccess")
MEDIUM_SUFFIX = "ReadOnlyAccess"


def managed_policy_number(name: Column) -> Column:
    """Band 1..4 of an attached policy's name."""
    broad = name.isin(*HIGH_NAMES) | name.endswith(HIGH_SUFFIX)
    for fragment in HIGH_FRAGMENTS:
        broad = broad | name.contains(fragment)
    return (
        F.when(name.isin(*CRITICAL_NAMES), 4)
        .when(broad, 3)
        .when(name.endswith(MEDIUM_SUFFIX) | name.isin(*MEDIUM_NAMES), 2)
        .otherwise(1)
    )


def decode_document(document: Column) -> Column:
    """VARIANT of a policy document that may be URL-encoded; null where it is not JSON.

    url_decode would turn '+' into a space, so it is protected first. Text with malformed
    escapes is parsed as it stands.
    """
    decoded = F.try_url_decode(F.replace(document, F.lit("+"), F.lit("%2B")))
    return F.try_parse_json(F.coalesce(decoded, document))


def one_or_many(value: Column, path: str) -> Column:
    """ARRAY<STRING> of a field that holds a string or a list of strings; absent gives empty."""
    many = F.try_variant_get(value, path, "array<string>")
    one = F.try_variant_get(value, path, "string")
    listed = F.coalesce(many, F.when(one.isNotNull(), F.array(one)))
    return F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda x: x.isNotNull())


def statements(document: Column) -> Column:
    """ARRAY<VARIANT> of the document's statements, a single object counting as one."""
    many = F.try_variant_get(document, "$.Statement", "array<variant>")
    one = F.try_variant_get(document, "$.Statement", "variant")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)))


def statement_number(statement: Column) -> Column:
    """Band of one statement; statements other than Allow add nothing."""
    actions = one_or_many(statement, "$.Action")
    resources = one_or_many(statement, "$.Resource")
    everywhere = F.array_contains(resources, "*")

    def broad(action: Column) -> Column:
        lowered = F.lower(action)
        return (
            (action.endswith(":*") & everywhere)
            | lowered.contains("secretsmanager")
            | lowered.contains("iam:")
        )

    allow = F.try_variant_get(statement, "$.Effect", "string").eqNullSafe("Allow")
    return (
        F.when(~allow, 1)
        .when(F.array_contains(actions, "*") & everywhere, 4)
        .when(F.exists(actions, broad), 3)
        .otherwise(1)
    )


def document_number(document: Column) -> Column:
    """Band 1..4 of an inline policy document given as text."""
    numbers = F.transform(statements(decode_document(document)), statement_number)
    return F.coalesce(F.array_max(numbers), F.lit(1))
