"""The technique dimension: every id a brief may cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Technique id, name, description and tactic, in reference-list order.
TECHNIQUES = (
    ("T1078", "Valid Accounts", "Use of legitimate credentials to access and blend in.", "Initial Access"),
    ("T1078.004", "Valid Accounts: Cloud Accounts", "Use of valid cloud (IAM/SSO) credentials from an unexpected source.", "Initial Access"),
    ("T1190", "Exploit Public-Facing Application", "Exploiting a public-facing app/service to gain access.", "Initial Access"),
    ("T1199", "Trusted Relationship", "Abusing a trusted third party / cross-account relationship.", "Initial Access"),
    ("T1059", "Command and Scripting Interpreter", "Running commands or scripts on a host or service.", "Execution"),
    ("T1651", "Cloud Administration Command", "Running commands on instances via cloud APIs (e.g. SSM RunCommand).", "Execution"),
    ("T1098", "Account Manipulation", "Modifying accounts to maintain or elevate access.", "Persistence"),
    ("T1098.001", "Account Manipulation: Additional Cloud Credentials", "Adding access keys / credentials to an existing principal.", "Persistence"),
    ("T1098.003", "Account Manipulation: Additional Cloud Roles", "Attaching additional roles/policies to gain permissions.", "Persistence"),
    ("T1136", "Create Account", "Creating a new account for persistence.", "Persistence"),
    ("T1136.003", "Create Account: Cloud Account", "Creating a new cloud (IAM) user/account for persistence.", "Persistence"),
    ("T1525", "Implant Internal Image", "Implanting a malicious machine image for persistence.", "Persistence"),
    ("T1548", "Abuse Elevation Control Mechanism", "Bypassing or abusing elevation controls to gain privileges.", "Privilege Escalation"),
    ("T1484", "Domain or Tenant Policy Modification", "Altering org/tenant policy (SCPs, IAM policy) to weaken controls.", "Privilege Escalation"),
    ("T1562", "Impair Defenses", "Weakening or disabling security defenses.", "Defense Evasion"),
    ("T1562.001", "Impair Defenses: Disable or Modify Tools", "Disabling or modifying security tools/agents.", "Defense Evasion"),
    ("T1562.008", "Impair Defenses: Disable or Modify Cloud Logs", "Disabling or tampering with cloud logging (CloudTrail/GuardDuty).", "Defense Evasion"),
    ("T1578", "Modify Cloud Compute Infrastructure", "Manipulating cloud compute infrastructure via control-plane APIs.", "Defense Evasion"),
    ("T1578.001", "Modify Cloud Compute Infrastructure: Create Snapshot", "Creating a snapshot to copy/exfiltrate a volume.", "Defense Evasion"),
    ("T1578.002", "Modify Cloud Compute Infrastructure: Create Cloud Instance", "Spinning up instances (often for mining or staging).", "Defense Evasion"),
    ("T1578.003", "Modify Cloud Compute Infrastructure: Delete Cloud Instance", "Deleting instances to destroy or hide activity.", "Defense Evasion"),
    ("T1535", "Unused/Unsupported Cloud Regions", "Operating in unused regions to evade monitoring.", "Defense Evasion"),
    ("T1070", "Indicator Removal", "Removing or altering indicators of the intrusion.", "Defense Evasion"),
    ("T1070.008", "Indicator Removal: Clear Mailbox Data", "Clearing mailbox/data artifacts to hide activity.", "Defense Evasion"),
    ("T1552", "Unsecured Credentials", "Harvesting credentials left unsecured in the environment.", "Credential Access"),
    ("T1552.005", "Unsecured Credentials: Cloud Instance Metadata API", "Stealing instance credentials via the metadata API (IMDS).", "Credential Access"),
    ("T1555", "Credentials from Password Stores", "Extracting credentials from stores/secret managers.", "Credential Access"),
    ("T1528", "Steal Application Access Token", "Stealing an application or cloud access token.", "Credential Access"),
    ("T1110", "Brute Force", "Guessing or spraying credentials at scale.", "Credential Access"),
    ("T1110.001", "Brute Force: Password Guessing", "Guessing passwords for a known account.", "Credential Access"),
    ("T1110.003", "Brute Force: Password Spraying", "Spraying a few passwords across many accounts.", "Credential Access"),
    ("T1580", "Cloud Infrastructure Discovery", "Enumerating cloud infrastructure (instances, volumes, networks).", "Discovery"),
    ("T1538", "Cloud Service Dashboard", "Browsing the cloud console/dashboard for recon.", "Discovery"),
    ("T1526", "Cloud Service Discovery", "Enumerating which cloud services exist/are enabled.", "Discovery"),
    ("T1087", "Account Discovery", "Enumerating accounts/users in the environment.", "Discovery"),
    ("T1087.004", "Account Discovery: Cloud Account", "Enumerating cloud (IAM) users, roles, and policies.", "Discovery"),
    ("T1069", "Permission Groups Discovery", "Discovering permission groups and their members.", "Discovery"),
    ("T1069.003", "Permission Groups Discovery: Cloud Groups", "Enumerating cloud groups and role memberships.", "Discovery"),
    ("T1518", "Software Discovery", "Discovering installed software/services.", "Discovery"),
    ("T1046", "Network Service Discovery", "Scanning for reachable network services.", "Discovery"),
    ("T1021", "Remote Services", "Moving laterally via remote services.", "Lateral Movement"),
    ("T1550", "Use Alternate Authentication Material", "Authenticating with stolen tokens/keys instead of passwords.", "Lateral Movement"),
    ("T1550.001", "Use Alternate Authentication Material: Application Access Token", "Reusing a stolen application access token to authenticate.", "Lateral Movement"),
    ("T1530", "Data from Cloud Storage", "Reading data directly from cloud storage (e.g. S3).", "Collection"),
    ("T1213", "Data from Information Repositories", "Pulling data from information repositories/wikis.", "Collection"),
    ("T1537", "Transfer Data to Cloud Account", "Exfiltrating by transferring to an attacker cloud account.", "Exfiltration"),
    ("T1567", "Exfiltration Over Web Service", "Exfiltrating over a legitimate web service.", "Exfiltration"),
    ("T1048", "Exfiltration Over Alternative Protocol", "Exfiltrating over an alternate/unmonitored protocol.", "Exfiltration"),
    ("T1485", "Data Destruction", "Destroying data to cause impact.", "Impact"),
    ("T1486", "Data Encrypted for Impact", "Encrypting data for extortion (ransomware).", "Impact"),
    ("T1496", "Resource Hijacking", "Hijacking resources for the attacker's gain (e.g. crypto mining).", "Impact"),
    ("T1531", "Account Access Removal", "Removing access to lock out legitimate users.", "Impact"),
    ("T1490", "Inhibit System Recovery", "Inhibiting recovery (deleting snapshots/backups).", "Impact"),
)

TECHNIQUE_IDS = tuple(row[0] for row in TECHNIQUES)


def techniques(spark: SparkSession) -> DataFrame:
    """(position, technique_id, name, description, tactic); 53 rows, so always safe to broadcast."""
    rows = ", ".join(
        "({}, {})".format(position, ", ".join('"' + value.replace('"', '\\"') + '"' for value in row))
        for position, row in enumerate(TECHNIQUES)
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(position, technique_id, name, description, tactic)")


def is_known(technique_id: Column) -> Column:
    """Exact membership in the allowlist; false for null."""
    return F.coalesce(technique_id.isin(list(TECHNIQUE_IDS)), F.lit(False))


def reference_line(technique_id: Column, name: Column, description: Column) -> Column:
    head = F.concat(F.lit("- "), technique_id, F.lit(" "), name)
    described = F.coalesce(description, F.lit("")) != ""
    return F.when(described, F.concat(head, F.lit(" — "), description)).otherwise(head)


def reference_text(dimension: DataFrame) -> DataFrame:
    """One row holding the whole reference list in declared order."""
    line = F.struct("position", reference_line(F.col("technique_id"), F.col("name"), F.col("description")).alias("line"))
    ordered = F.array_sort(F.collect_list(line))
    return dimension.agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("reference"))
