"""The ``attempts`` table: recorded analyst-model calls per message (P11/P12 input).

Model calls happen outside Spark; their outcomes arrive as rows
``(msg_id, model, model_rank, attempt, http_code, error, content, request_id,
response_model, usage)``. For the driver's data the table is derived from the ``messages`` view by
arithmetic on ``msg_id`` (one scenario per ``msg_id % 16``): clean JSON, 429
then success, server error then fenced JSON, every route failing, broken JSON,
a JSON array instead of an object, missing content, oversized lists, a list
around an object, data after an object, calls without an answer, strings that
look like lists or objects. Like the message view it is written as SQL both Spark and DuckDB run, joined to a fixed
scenario table (32 rows, broadcast).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C

# (scenario, model_rank, attempt, http_code, error, content kind)
SCENARIO_STEPS = [
    (1, 1, 0, 200, None, "clean"),
    (2, 1, 0, 429, "rate limited", None),
    (2, 1, 1, 200, None, "prose"),
    (3, 1, 0, 500, "upstream error", None),
    (3, 2, 0, 200, None, "fenced"),
    (4, 1, 0, 429, "rate limited", None),
    (4, 1, 1, 429, "rate limited", None),
    (4, 2, 0, 500, "upstream error", None),
    (4, 3, 0, 503, "service unavailable", None),
    (4, 4, 0, 400, "bad request", None),
    (4, 5, 0, 500, "upstream error", None),
    (5, 1, 0, 200, None, "broken"),
    (5, 2, 0, 200, None, "scalars"),
    (6, 1, 0, 200, None, "array"),
    (6, 2, 0, 200, None, "empty"),
    (7, 1, 0, 404, "not found", None),
    (7, 2, 0, 200, None, "many"),
    (8, 1, 0, 500, "limit 429 reached", None),
    (8, 1, 1, 200, None, "clean"),
    (9, 1, 0, 200, None, "listed"),
    (9, 2, 0, 200, None, "extra"),
    (9, 3, 0, 200, None, "clean"),
    (10, 1, 0, None, "timed out", None),
    (10, 2, 0, None, None, None),
    (10, 3, 0, 500, "upstream error", None),
    (11, 1, 0, 200, None, "lookalikes"),
    (12, 1, 0, 200, None, "extra"),
    (13, 1, 0, None, "timed out", None),
    (13, 2, 0, 200, None, "fenced"),
    (14, 1, 0, 429, "rate limited", None),
    (14, 2, 0, 200, None, "clean"),
    (15, 1, 0, 200, None, "listed"),
]
N_SCENARIOS = 16

_ID = "CAST(msg_id AS STRING)"
CONTENT_SQL = {
    "clean": ("'{\"executive_summary\": \"Case ' || " + _ID + " || ' looks like phishing.\", "
              "\"user_explanation\": \"The link imitates a known brand.\", \"recommended_priority\": \"urgent\", "
              "\"evidence\": [{\"signal\": \"Lookalike domain\", \"why_it_matters\": \"It imitates a brand.\", "
              "\"severity\": \"high\"}], \"questions\": [\"Did you click?\"], "
              "\"next_actions\": [\"Delete the message.\"], \"confidence_note\": \"Model output.\"}'"),
    "prose": ("'Here is the analysis: {\"executive_summary\": \"Prose wrapped ' || " + _ID +
              " || '\", \"evidence\": [{\"signal\": \"Urgency\", \"severity\": \"medium\"}], "
              "\"questions\": \"Did you reply?\"} Thanks.'"),
    "fenced": ("'```json {\"executive_summary\": \"Fenced ' || " + _ID + " || '\", "
               "\"recommended_priority\": \"caution\", \"evidence\": [\"Plain scalar signal\", "
               "{\"signal\": \"Odd severity\", \"why_it_matters\": \"\", \"severity\": \"critical\"}], "
               "\"next_actions\": [\"  Report it  \", \"\", \"Block sender\"]} ```'"),
    "broken": "'{\"executive_summary\": \"broken ' || " + _ID,
    "scalars": ("'{\"executive_summary\": \"Scalars ' || " + _ID + " || '\", "
                "\"evidence\": [\"one\", \"two\", \"  \"], \"questions\": [\"a\", \" \", \"b\", \"c\", \"d\"]}'"),
    "array": "'[1, 2]'",
    "listed": "'[{\"executive_summary\": \"Listed ' || " + _ID + " || '\"}]'",
    "extra": "'{\"executive_summary\": \"First ' || " + _ID + " || '\"}{\"executive_summary\": \"Second\"}'",
    "lookalikes": ("'{\"executive_summary\": \"Lookalikes ' || " + _ID + " || '\", "
                   "\"evidence\": [\"{not an object\", \"[1, 2]\", {\"signal\": \"Real object\"}], "
                   "\"questions\": \"[1, 2]\", \"next_actions\": 3}'"),
    "empty": "NULL",
    "many": ("'{\"executive_summary\": \"Many ' || " + _ID + " || '\", \"evidence\": [{\"signal\": \"s1\"}, "
             "{\"signal\": \"s2\"}, {\"signal\": \"s3\"}, {\"signal\": \"s4\"}, {\"signal\": \"s5\"}, "
             "{\"signal\": \"s6\"}, {\"signal\": \"s7\"}], \"next_actions\": [\"x1\", \"x2\", \"x3\", \"x4\", \"x5\"]}'"),
}


def attempt_columns() -> list[tuple[str, str]]:
    """(name, SQL) over ``messages m JOIN steps s ON s.scenario = m.msg_id % 16``."""
    model = "CASE model_rank " + " ".join(
        f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(C.MODEL_ROUTES)) + " END"
    content = "CASE kind " + " ".join(
        f"WHEN '{k}' THEN {v}" for k, v in CONTENT_SQL.items()) + " ELSE NULL END"
    return [("msg_id", "msg_id"), ("model", model), ("model_rank", "model_rank"),
            ("attempt", "attempt"), ("http_code", "http_code"), ("error", "error"),
            ("content", content), ("request_id", "'req-' || " + _ID),
            ("response_model", "CASE kind WHEN 'many' THEN 'answering-model' END"),
            ("usage", "CASE kind WHEN 'clean' THEN '{\"total_tokens\": 120}' END")]


def steps_values_sql() -> str:
    def lit(v):
        return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v))
    rows = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in SCENARIO_STEPS)
    return f"(VALUES {rows}) AS s(scenario, model_rank, attempt, http_code, error, kind)"


def attempts_from(messages: DataFrame) -> DataFrame:
    spark = messages.sparkSession
    steps = spark.createDataFrame(
        SCENARIO_STEPS, "scenario int, model_rank int, attempt int, http_code int, error string, kind string")
    keyed = messages.select("msg_id").withColumn("scenario", (F.col("msg_id") % N_SCENARIOS).cast("int"))
    # the scenario table is 32 fixed rows: broadcasting it is bounded by construction
    joined = keyed.join(F.broadcast(steps), "scenario")
    return joined.selectExpr(*[f"{expr} AS {name}" for name, expr in attempt_columns()])


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .messages import messages
    return attempts_from(messages(spark, sf_dir))
