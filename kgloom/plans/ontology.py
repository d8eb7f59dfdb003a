"""Ontology rules as constant relations: small, fixed, so always broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VERSION = "2.1"
#: Fixed values of the ontology.
CLASSES = ("Person", "Education", "Experience", "Activity", "Work", "Credential", "Skill", "Organization", "Channel")
PROPERTIES = {
    "Person": (("name", "string"), ("role", "string"), ("interests", "string")),
    "Education": (("major", "string"), ("degree", "string"), ("start", "date"), ("end", "date"), ("isCurrent", "boolean")),
    "Experience": (("role", "string"), ("department", "string"), ("kind", "string"), ("start", "date"), ("end", "date"), ("isCurrent", "boolean")),
    "Activity": (("name", "string"), ("role", "string"), ("kind", "string"), ("start", "date"), ("end", "date"), ("isCurrent", "boolean")),
    "Work": (("title", "string"), ("kind", "string"), ("role", "string"), ("start", "date"), ("end", "date"), ("url", "uri")),
    "Credential": (("title", "string"), ("kind", "string"), ("issuerName", "string"), ("date", "date"), ("grade", "string")),
    "Skill": (("name", "string"), ("kind", "string"), ("category", "string")),
    "Organization": (("name", "string"), ("type", "string"), ("homepage", "uri")),
    "Channel": (("kind", "string"), ("value", "string"), ("value", "uri"), ("scope", "string")),
}
VALUES = {
    ("Person", "role"): ("Student", "Professor", "Professional"),
    ("Experience", "kind"): ("fulltime", "contract", "intern", "research"),
    ("Activity", "kind"): ("club", "volunteer", "program", "talk"),
    ("Work", "kind"): ("project", "publication", "opensource"),
    ("Credential", "kind"): ("award", "certification"),
    ("Skill", "kind"): ("tool", "method", "model", "domain", "other"),
    ("Organization", "type"): ("company", "university", "club", "institution", "github_org"),
    ("Channel", "kind"): ("email", "phone", "github"),
    ("Channel", "scope"): ("personal", "work"),
}
MULTI_VALUED = (("Education", "major"), ("Work", "url"), ("Person", "interests"), ("Skill", "category"))
PAIRS = {
    "hasEducation": (("Person", "Education"),),
    "hasExperience": (("Person", "Experience"),),
    "participatedIn": (("Person", "Activity"), ("Person", "Work")),
    "holds": (("Person", "Credential"),),
    "hasSkill": (("Person", "Skill"),),
    "hasChannel": (("Person", "Channel"),),
    "atOrganization": (("Education", "Organization"), ("Experience", "Organization"), ("Activity", "Organization"), ("Work", "Organization")),
    "usesSkill": (("Work", "Skill"), ("Experience", "Skill")),
    "partOf": (("Work", "Experience"),),
}
#: Properties that can identify an entity.
IDENTITY = {"Work": ("title",), "Credential": ("title",), "Skill": ("name",), "Organization": ("name",), "Activity": ("name",)}
#: Categories of skills, in the order in which they are shown.
CATEGORIES = (
    "language", "web_markup_styling", "frontend", "ui_component", "backend", "mobile", "desktop", "state_management", "server_state_data_fetching",
    "api_communication", "database", "orm_data_access", "cache_search", "messaging_event_streaming", "auth_security", "architecture_design",
    "build_package_tool", "dev_automation_tool", "ci_cd", "container_infra_automation", "cloud_deployment", "storage_cdn", "os_server", "network",
    "testing_quality", "monitoring_observability", "data_collection_processing", "data_pipeline", "data_warehouse_lakehouse", "data_analysis_bi",
    "data_visualization", "statistics_experiment", "machine_learning", "nlp_computer_vision", "generative_ai_llm", "vector_search",
    "knowledge_graph_ontology", "mlops_model_serving", "design_prototyping", "docs_collaboration", "game_realtime_graphics", "embedded_iot", "other",
)
CONTENT = ("Education", "Experience", "Activity", "Work", "Credential", "Skill")
CONTEXT = ("Organization", "Channel", "Skill")


def properties(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, *p) for c, ps in PROPERTIES.items() for p in ps], "class_type string, predicate string, value_type string")


def values(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, p, v) for (c, p), vs in VALUES.items() for v in vs], "class_type string, predicate string, allowed string")


def pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, *p) for r, ps in PAIRS.items() for p in ps], "predicate string, subject_class string, object_class string")


def sql_rows(rows) -> str:
    """VALUES rows for an oracle."""
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
