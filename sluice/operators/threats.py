"""Threats: checks of a program, an app's manifest and layouts, or its flows, by the threat's id.

Each gives (repo, source_id, sample, file): a row for each occurrence; a threat without occurrences gives a row with nulls where
it holds. A threat holds only in repositories that have data elements.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import graph, policy
from sluice.operators.graph import Program
from sluice.operators.predicates import full_match
from sluice.operators.sources import sensitive_types
from sluice.operators.tagging import Rule


@dataclass(frozen=True)
class Scan:
    """What the threats read: the program, XML elements (repo, file, element, path, attributes), flows and the rules."""

    program: Program
    elements: DataFrame | None = None
    flows: DataFrame | None = None
    sql_columns: DataFrame | None = None
    sources: Sequence[Rule] = ()
    config: dict[str, str] = field(default_factory=dict)
    policy: policy.Policy | None = None


def data_repos(s: Scan) -> DataFrame:
    """Repositories with a data element."""
    return s.program.tags.where("name = 'catLevelOne' and value = 'sources'").select("repo").distinct()


def android_repos(s: Scan) -> DataFrame:
    """Repositories with a manifest."""
    return s.elements.where("file like '%AndroidManifest.xml'").select("repo").distinct()


def attribute(name: str):
    """An attribute by its local name, whatever its prefix; null without."""
    values = F.map_filter("attributes", lambda k, _: F.element_at(F.split(k, ":"), -1) == name)
    return F.try_element_at(F.map_values(values), F.lit(1))


def _shape(rows: DataFrame, source, sample) -> DataFrame:
    return rows.select("repo", source.cast("string").alias("source_id"), sample.cast("string").alias("sample"), "file")


def _absent(repos: DataFrame, present: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return repos.join(present.select("repo").distinct(), "repo", "left_anti").select("repo", none.alias("source_id"), none.alias("sample"), none.alias("file"))


def _sensitive_id(rules: Sequence[Rule]):
    own = F.regexp_replace(attribute("id"), r"^@\+id/", "")
    test = F.lit(False)
    for r in rules:
        test |= full_match(own, r.pattern)
    return test


# Input types.
KEYBOARD_TYPES = ("numberPassword", "phone", "textEmailAddress", "textPassword", "textPersonName", "textPostalAddress", "textWebEmailAddress", "textWebPassword")
PASSWORD_TYPES = ("numberPassword", "textPassword", "textWebPassword")


def _has_type(names: Sequence[str]):
    return F.coalesce(F.arrays_overlap(F.split(attribute("inputType"), r"\|"), F.array(*map(F.lit, names))), F.lit(False))


def keyboard_cache(s: Scan) -> DataFrame:
    """Text fields right under a layout's root that are sensitive by type or id and let the keyboard learn."""
    fields = s.elements.where("element = 'EditText' and size(split(path, '/')) = 3")
    own = fields.where((_has_type(KEYBOARD_TYPES) | _sensitive_id(s.sources)) & ~_has_type(("textNoSuggestions",)))
    return _shape(own.where(attribute("id").isNotNull()), F.lit(None), attribute("id"))


def data_backup(s: Scan) -> DataFrame:
    own = s.elements.where("element = 'application'").where(attribute("allowBackup") == "true").join(data_repos(s), "repo", "left_semi")
    return _shape(own, F.lit(None), F.lit('android:allowBackup="true"'))


def background_screenshot(s: Scan, flag_call: str = ".*(add|set)Flags.*", flag: str = "WindowManager.LayoutParams.FLAG_SECURE") -> DataFrame:
    """Repositories that never set the secure flag."""
    calls = s.program.calls().where(full_match(F.col("method_full_name"), flag_call))
    safe = s.program.arguments(calls).where(F.col("arg_code").contains(flag))
    return _absent(data_repos(s), safe)


def ipc_sharing(s: Scan) -> DataFrame:
    """Exported content providers without a permission to read or write, of their own or of a path; and permissions that guard little, where one is exported."""
    e = s.elements.join(data_repos(s), "repo", "left_semi")
    sdk = e.where("element = 'uses-sdk'").groupBy("repo", "file").agg(F.max(attribute("targetSdkVersion").try_cast("int")).alias("sdk"))
    inner = e.where("element in ('intent-filter', 'path-permission')").withColumn("provider", F.regexp_extract("path", r"^(.*provider\[\d+\])", 1)).where("provider <> ''")
    set_ = lambda name: F.coalesce(attribute(name) != "", F.lit(False))
    has = set_("permission") | set_("readPermission") | set_("writePermission")
    facts = inner.groupBy("repo", "file", "provider").agg(F.bool_or(F.col("element") == "intent-filter").alias("filtered"), F.bool_or((F.col("element") == "path-permission") & has).alias("guarded"))
    own = e.where("element = 'provider'").withColumn("provider", F.col("path")).join(facts, ["repo", "file", "provider"], "left").join(sdk, ["repo", "file"], "left")
    stated = attribute("exported")
    exported = F.when(stated == "true", True).when(stated == "false", False).otherwise(~F.coalesce(F.col("sdk") >= 17, F.lit(False))) | F.coalesce("filtered", F.lit(False))
    open_ = own.where(exported)
    bare = open_.where(~has & ~F.coalesce("guarded", F.lit(False)))
    near = open_.select("repo").distinct()
    permission = e.where("element = 'permission'").join(near, "repo", "left_semi")
    weak = permission.where(F.coalesce(attribute("protectionLevel"), F.lit("normal")) != "signature")
    level = F.concat(F.lit('protectionLevel="'), F.coalesce(attribute("protectionLevel"), F.lit("normal")), F.lit('"'))
    none = e.where("element = 'manifest'").join(near, "repo", "left_semi").join(permission.select("repo").distinct(), "repo", "left_anti")
    return _shape(bare, F.lit(None), F.coalesce(attribute("name"), F.lit("provider"))).unionByName(_shape(weak, F.lit(None), level)).unionByName(_shape(none, F.lit(None), F.lit('protectionLevel="normal"')))


# Sources whose input must be masked.
MASKED = (
    "Data.Sensitive.AccountData.AccountID",
    "Data.Sensitive.AccountData.AccountPassword",
    "Data.Sensitive.BackgroundCheckDetails.CompensationHistory",
    "Data.Sensitive.BackgroundCheckDetails.CreditHistory",
    "Data.Sensitive.FinancialData.BankAccountDetails",
    "Data.Sensitive.FinancialData.CardNumber",
    "Data.Sensitive.FinancialData.VPAAddress",
    "Data.Sensitive.FinancialData.RetirementAccountInformation",
    "Data.Sensitive.FinancialData.PayrollInformation",
    "Data.Sensitive.FinancialData.Salary",
    "Data.Sensitive.HealthData.HealthInsuranceNumber",
    "Data.Sensitive.HealthData.DisabilityorSpecificCondition",
    "Data.Sensitive.HealthData.IllnessorMedicalCondition",
    "Data.Sensitive.NationalIdentificationNumbers.Passport",
    "Data.Sensitive.NationalIdentificationNumbers.DrivingLicense",
    "Data.Sensitive.NationalIdentificationNumbers.SocialSecurityNumber",
    "Data.Sensitive.NationalIdentificationNumbers.PANNumber",
    "Data.Sensitive.NationalIdentificationNumbers.AadharNumber",
    "Data.Sensitive.PersonalIdentification.EmployeeCode",
    "Data.Sensitive.VehicleData.VehicleRegistrationNumber",
    "Data.Sensitive.VehicleData.LicensePlate",
)


def unmasked_input(s: Scan) -> DataFrame:
    """Text fields of a masked source's name without a password type."""
    own = s.elements.where("element = 'EditText'").where(_sensitive_id([r for r in s.sources if r.id in MASKED]) & ~_has_type(PASSWORD_TYPES) & (F.coalesce(attribute("password"), F.lit("")) != "true"))
    return _shape(own, F.lit(None), F.concat(F.lit('id="'), attribute("id"), F.lit('"')))


def external_storage(s: Scan) -> DataFrame:
    """Permissions to write external storage, and calls in world-readable or -writable mode."""
    e = s.elements.join(data_repos(s), "repo", "left_semi").where("element = 'uses-permission'")
    own = e.where(attribute("name").isin("android.permission.WRITE_EXTERNAL_STORAGE", "android.permission.MANAGE_EXTERNAL_STORAGE"))
    args = s.program.arguments(s.program.calls()).where(F.col("arg_code").rlike("(MODE_WORLD_READABLE|MODE_WORLD_WRITABLE)")).select("repo", "id").distinct()
    calls = s.program.calls().where(~F.col("method_full_name").contains("<operator>")).join(args, ["repo", "id"], "left_semi").join(e.select("repo").distinct(), "repo", "left_semi")
    return _shape(own, F.lit(None), attribute("name")).unionByName(_shape(calls, F.lit(None), F.col("code")))


def cookie_consent(s: Scan) -> DataFrame:
    """The policy's sources in repositories that use no consent module and no standard call for it."""
    pattern = s.config.get("cookieConsentMgmtModulePattern", "(ngx-cookieconsent).*")
    calls = s.program.calls()
    there = calls.where(full_match(F.col("method_full_name"), pattern) | (F.col("name") == "__tcfapi") | full_match(F.col("method_full_name"), ".*pbjs.*setConfig"))
    tags = s.program.tags.where("name = 'id'").select("repo", F.col("node_id").alias("id"), F.col("value").alias("source_id"))
    own = s.program.nodes.join(tags, ["repo", "id"]).where(policy._ids(F.col("source_id"), s.policy.sources if s.policy else ("**",)))
    first = own.groupBy("repo", "source_id").agg(F.min_by(F.struct("code", "file"), "id").alias("n")).select("repo", "source_id", F.col("n.code").alias("sample"), F.col("n.file").alias("file"))
    return first.join(there.select("repo").distinct(), "repo", "left_anti").join(data_repos(s), "repo", "left_semi")


def _first_by_name(s: Scan, rows: DataFrame) -> DataFrame:
    first = rows.groupBy("repo", "name").agg(F.min_by(F.struct("code", "file"), "id").alias("n"))
    return first.join(data_repos(s), "repo", "left_semi").select("repo", F.col("name").alias("source_id"), F.col("n.code").alias("sample"), F.col("n.file").alias("file"))


def hard_coded_parameter(s: Scan) -> DataFrame:
    return _first_by_name(s, s.program.of("PARAMETER").where(full_match(F.col("code"), ".*=.*") & (F.col("code") != F.col("name"))))


def object_parameter(s: Scan) -> DataFrame:
    return _first_by_name(s, s.program.tagged(s.program.of("PARAMETER"), "catLevelOne", "DerivedSources"))


def _entity(s: Scan) -> DataFrame:
    own = policy.entity_columns(sensitive_types(s.program, s.sources), graph.table_of_classes(s.program))
    return own.join(data_repos(s), "repo", "left_semi")


def _rows(found: DataFrame, source: str, sample: str) -> DataFrame:
    return found.select(F.col("repo"), F.col(source).alias("source_id"), F.col(sample).alias("sample"), F.lit(None).cast("string").alias("file"))


def classes_in_several_tables(s: Scan) -> DataFrame:
    return _rows(policy.in_several_tables(_entity(s)), "source_id", "tables")


def columns_in_several_tables(s: Scan) -> DataFrame:
    return _rows(policy.in_several_tables(s.sql_columns), "source_id", "tables")


def _mixed(columns: DataFrame, config: dict[str, str], name: str) -> DataFrame:
    return _rows(policy.mixed_values(columns, config or {"": ""}, name), "table_name", name)


def mixed_classes(s: Scan) -> DataFrame:
    return _mixed(_entity(s), policy.categories_of(s.config), "categories")


def mixed_columns(s: Scan) -> DataFrame:
    return _mixed(s.sql_columns, policy.categories_of(s.config), "categories")


def retention_of_classes(s: Scan) -> DataFrame:
    return _mixed(_entity(s), s.config, "days")


def retention_of_columns(s: Scan) -> DataFrame:
    return _mixed(s.sql_columns, s.config, "days")


MOST_LOGGERS = 5


def central_logger(s: Scan) -> DataFrame:
    """Log sinks that are not the configured logger, a row for each full name, the first five of a repository: the limit is the report's."""
    pattern = s.config.get("customLoggerModulePattern", ".*(?:error|severe|fatal|warn|debug|trace|info|log|exception)")
    ids = s.program.tags.where((F.col("name") == "id") & full_match(F.col("value"), "Leakages.Log.*")).select("repo", F.col("node_id").alias("id")).distinct()
    calls = s.program.of("CALL").join(ids, ["repo", "id"], "left_semi").where(~full_match(F.col("method_full_name"), pattern)).join(data_repos(s), "repo", "left_semi")
    each = calls.groupBy("repo", "method_full_name").agg(F.min_by(F.struct("id", "code", "file"), "id").alias("n"))
    first = each.groupBy("repo").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col("n.id").alias("id"), "method_full_name", "n"))), 1, MOST_LOGGERS).alias("all"))
    return first.select("repo", F.explode("all").alias("x")).select("repo", F.concat_ws("::", "x.method_full_name", F.coalesce("x.n.file", F.lit("Unknown"))).alias("source_id"), F.col("x.n.code").alias("sample"), F.col("x.n.file").alias("file"))


def leaking_flows(s: Scan) -> DataFrame:
    """The flows that the threat's own definition forbids."""
    found = policy.flow_violations(s.flows, [s.policy], repo=True)
    return found.select("repo", "source_id", F.col("sink_id").alias("sample"), F.lit(None).cast("string").alias("file"))


Check = Callable[[Scan], DataFrame]


def _both(one: Check, two: Check) -> Check:
    """A threat over classes and over SQL columns: the rows of either."""
    return lambda s: one(s).unionByName(two(s)) if s.sql_columns is not None else one(s)


# Threats by their id without its first segment; those of apps only where there is a manifest.
ANDROID: dict[str, Check] = {
    "Collection.isKeyboardCacheUsed": keyboard_cache,
    "Storage.isAppDataBackupAllowed": data_backup,
    "Configuration.Mobile.isBackgroundScreenshotEnabled": background_screenshot,
    "Sharing.isIpcDataSharingAllowed": ipc_sharing,
    "Collection.isInputMasked": unmasked_input,
    "Storage.isDataStoredOnExternalStorage": external_storage,
}
PROCESSING: dict[str, Check] = {
    "CookieConsent.IsCookieConsentMgmtModuleImplemented": cookie_consent,
    "Sharing.IsParameterHardcoded": hard_coded_parameter,
    "Sharing.IsObjectsWithPIIsPassedAsParameter": object_parameter,
    "Storage.IsSamePIIShouldNotBePresentInMultipleTables": _both(classes_in_several_tables, columns_in_several_tables),
    "Storage.IsPIIHavingDifferentRetentionPeriod": _both(retention_of_classes, retention_of_columns),
    "Storage.IsDifferentKindOfPIIStoredInDifferentTables": _both(mixed_classes, mixed_columns),
    "Leakage.CentralisedPrivacyLoggerMustbeUsed": central_logger,
}
ANDROID_FLOW: dict[str, Check] = {"Sharing.isDataExposedToThirdPartiesViaNotification": leaking_flows}
FLOW: dict[str, Check] = {"Leakage.isDataLeakingToLog": leaking_flows}


def violations(scan: Scan, threats: Sequence, kind: str = "processing") -> DataFrame | None:
    """policy_id, repo, source_id, sample, file of all threats of the catalogue that are known by id; those unknown are passed over."""
    apps = ANDROID_FLOW if kind == "dataflow" else ANDROID
    out = None
    for t in threats:
        key = t.id.split(".", 1)[-1]
        check = (FLOW if kind == "dataflow" else PROCESSING).get(key)
        if check is None and (scan.elements is None or key not in apps):
            continue
        s = replace(scan, config=t.config, policy=policy.from_verdict(t))
        found = check(s) if check else apps[key](s).join(android_repos(scan), "repo", "left_semi")
        rows = found.select(F.lit(t.id).alias("policy_id"), "repo", "source_id", "sample", "file")
        out = rows if out is None else out.unionByName(rows)
    return out
