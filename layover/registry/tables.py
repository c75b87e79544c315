"""Queries about reading, writing and describing tables."""

import uuid

from pyspark.sql import functions as F

from layover.operators import audit as au
from layover.operators import mutate
from layover.registry import decisions as _decisions  # noqa: F401  (shared oracle parts)
from layover.registry import query
from layover.registry.decisions import routed
from layover.session import new_path
from layover.sources import profiles, seeds, tables
from layover.sources.schemas import SCHEMAS
from layover.sources.testviews import AS_OF

DECLARED = {
    "flight_operational_events": "flight_events",
    "unstructured_chat_signals": "chat",
    "historical_uplift_experiments": "uplift",
    "concierge_inventory_lookup": "inventory",
    "irop_execution_results": "exec",
    "passenger_profiles": "profile",
}


def declared(t):
    return {name: getattr(t, view) for name, view in DECLARED.items()}


def _schema_sql() -> str:
    rows = []
    for table, view in DECLARED.items():
        for i, field in enumerate(SCHEMAS[table].fields, start=1):
            rows.append(
                f"SELECT '{table}' AS table_name, {i} AS ordinal, '{field.name}' AS column_name, "
                f"'{field.dataType.simpleString()}' AS declared_type, true AS as_declared, "
                f"count({field.name}) AS filled_values FROM v_{view}"
            )
    return " UNION ALL ".join(rows)


query("table_schemas", _schema_sql())(
    lambda t: tables.schema_report(declared(t)).join(tables.fill_report(declared(t)), ["table_name", "column_name"])
)

query(
    "table_row_counts",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS \"rows\" FROM v_{v}" for n, v in DECLARED.items()),
)(lambda t: tables.row_counts(declared(t)))

# --- seeding -------------------------------------------------------------------------------

query(
    "seed_action_shelf",
    """SELECT s.*, (SELECT count(*) FROM v_uplift u WHERE u.action_id = s.action_id) AS experiments FROM d_shelf s""",
)(
    lambda t: seeds.action_shelf(t.spark)
    .join(t.uplift.groupBy("action_id").agg(F.count(F.lit(1)).alias("n")), "action_id", "left")
    .withColumn("experiments", F.coalesce("n", F.lit(0)))
    .drop("n")
)
query(
    "seed_uplift",
    f"SELECT * FROM v_uplift UNION ALL SELECT * FROM ({seeds.values_sql('historical_uplift_experiments')})",
)(lambda t: mutate.append_rows(t.uplift, seeds.seed(t.spark, "historical_uplift_experiments")))

# --- appending and creating ----------------------------------------------------------------


@query("audit_append", "SELECT * FROM v_exec UNION ALL SELECT * FROM d_push_audit")
def audit_append(t):
    path = new_path(t.spark, "audit")
    tables.append(t.exec, path)
    tables.append(au.to_audit(routed(t), as_of=AS_OF), path)
    return tables.read_table(t.spark, path, "irop_execution_results")


@query(
    "chat_append",
    """SELECT * FROM v_chat UNION ALL SELECT 'SIG-2024-01-31-000000-CUST-' || conv_id || '-' || turn, 'PNR-' || conv_id, 'CUST-' || conv_id,
 TIMESTAMP '2024-01-31 00:00:00', 'CALM', text FROM v_turns WHERE role = 'assistant'""",
)
def chat_append(t):
    from layover.plans.desk import to_chat

    said = t.turns.filter("role = 'assistant'").select(
        F.concat(F.lit("PNR-"), "conv_id").alias("pnr"),
        F.concat(F.lit("CUST-"), "conv_id").alias("customer_id"),
        F.col("text").alias("message_text"),
        F.col("turn").cast("string").alias("turn"),
    )
    path = new_path(t.spark, "chat")
    tables.append(t.chat, path)
    tables.append(to_chat(said, row_key="turn", as_of=AS_OF), path)
    return tables.read_table(t.spark, path, "unstructured_chat_signals")


def _table_name(label: str) -> str:
    return f"layover_{label}_{uuid.uuid4().hex}"


@query("ctas_roundtrip", "SELECT * FROM v_chat")
def ctas_roundtrip(t):
    return tables.create_from(t.chat, _table_name("ctas"), new_path(t.spark, "ctas"))


@query("insert_select", "SELECT * FROM v_uplift UNION ALL SELECT * FROM v_uplift WHERE gesture_applied")
def insert_select(t):
    name, path = _table_name("uplift"), new_path(t.spark, "uplift")
    tables.create_table(t.spark, "historical_uplift_experiments", path, name)
    tables.insert_into(t.uplift, name)
    tables.insert_into(t.uplift.filter("gesture_applied"), name)
    return t.spark.table(name)


@query("table_layout", "SELECT * FROM (VALUES ('Provider', 'parquet'), ('Type', 'EXTERNAL')) AS t(col_name, data_type)")
def table_layout(t):
    name, path = _table_name("layout"), new_path(t.spark, "layout")
    tables.create_from(t.exec, name, path)
    found = tables.layout(t.spark, name)
    return found.filter(F.col("col_name").isin("Provider", "Type")).select("col_name", "data_type")


_FIELDS = {f.name: f.name for f in SCHEMAS["irop_execution_results"].fields}
_FIELDS["executed_at"] = "strftime(executed_at, '%Y-%m-%dT%H:%M:%S.%f')"
query(
    "rows_as_json",
    f"""SELECT CAST(json_object({", ".join(f"'{name}', {value}" for name, value in _FIELDS.items())}) AS VARCHAR) AS "row" FROM v_exec""",
)(lambda t: tables.rows_as_json(t.exec))
query("data_files", "SELECT 'lineitem.parquet' AS file_name, count(*) AS \"rows\" FROM lineitem")(
    lambda t: tables.data_files(t.base("lineitem")).select(
        F.substring_index("file_path", "/", -1).alias("file_name"), "rows"
    )
)

# --- profiles outside Spark ----------------------------------------------------------------


def profile_folder(t):
    path = new_path(t.spark, "profiles")
    profiles.write_profiles(t.profile, path)
    return profiles.read_folder(t.spark, path)


query("external_profiles", "SELECT * FROM v_profile")(profile_folder)
query("external_profile_lookup", "SELECT * FROM v_profile WHERE customer_id = 'CUST-42'")(
    lambda t: profile_folder(t).filter("customer_id = 'CUST-42'")
)
