"""Explicit schemas of the tables, as DDL text; nothing is inferred from files."""


def ddl(**cols: str) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in cols.items())


# Label columns of an advisory.
CVSS_COLUMNS = [
    "cvss2_vector", "cvss2_accessvect", "cvss2_accesscomp", "cvss2_auth",
    "cvss2_conf", "cvss2_integrity", "cvss2_avail",
]

COMMITS = ddl(id="string", commit="string", date="string", cwe="string")
ADVISORIES = ddl(
    id="string", **{c: "string" for c in CVSS_COLUMNS}, cvss2_basescore="double", cvss2_severity="string"
)
COMMIT_MAP = ddl(
    commit="string", date="timestamp", **{c: "string" for c in CVSS_COLUMNS},
    cvss2_basescore="double", cvss2_severity="string", set="string", partition="int", time_partition="int",
)
CHANGES = ddl(commit="string", prev_data="string", cur_data="string")
CONTEXTS = ddl(commit="string", prev_data="string", cur_data="string", prev_context="string", cur_context="string")
FILES = ddl(commit="string", prev_file="string", cur_file="string")
SEQUENCES = ddl(commit="string", prev_features="array<int>", cur_features="array<int>")
RESULTS = ddl(
    problem="string", partition="string", feature_type="string", feature_scope="string", token="string",
    classifier="string", parameters="string", resampling="string",
    accuracy="double", precision="double", recall="double", gmean="double", auc="double", f1="double", mcc="double",
    train_time="double", pred_time="double",
)
VOCABULARY = ddl(token="string", id="int", doc_freq="bigint", term_freq="bigint")
LOG_LINES = ddl(file="string", line_no="bigint", line="string")
