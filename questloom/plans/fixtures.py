"""Derived tables. The SQL text runs unchanged on Spark SQL and DuckDB."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questloom.functions.groups import number_in_key

if TYPE_CHECKING:
    from questloom.plans.registry import Tables

NARRATIVES = """
SELECT c_custkey AS doc_id,
  '# File ' || c_name || chr(10) || chr(10) ||
  'The client ' || CAST(c_custkey AS STRING) || ' holds a balance of ' || CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) || ' units since ' || CAST(1950 + c_custkey % 50 AS STRING) || '.' || chr(10) || chr(10) ||
  CASE WHEN c_custkey % 3 = 0 THEN 'For client ' || CAST(c_custkey AS STRING) || ' the balance was later corrected to ' || CAST(CAST(c_acctbal + 10 AS DECIMAL(12,2)) AS STRING) || '.' ELSE 'No change was made for client ' || CAST(c_custkey AS STRING) || '.' END || chr(10) || chr(10) ||
  'The client registered under identifier ' || CAST(c_custkey AS STRING) || ' is classified under nation ' || CAST(c_nationkey AS STRING) || '.' || chr(10) || chr(10) ||
  'A normal balance is between ' || CAST(100 + c_nationkey AS STRING) || ' and ' || CAST(5000 + c_nationkey AS STRING) || '.' AS text
FROM customer
"""

JSON_WRAPPED = """
SELECT o_custkey AS id,
  '{"table":"orders","records":[{"id":' || CAST(o_orderkey AS STRING) || ',"status":"' || o_orderstatus || '"},{"id":' || CAST(o_orderkey + 1 AS STRING) || ',"status":null}]}' AS v
FROM orders
"""

_STEP_COLUMNS = """
  CASE event_type WHEN 'view' THEN 'search_doc' WHEN 'click' THEN 'execute_data_sql' WHEN 'purchase' THEN 'execute_python' WHEN 'signup' THEN 'profile_context' ELSE 'read_doc' END AS action,
  event_type || ':' || CAST(CAST(FLOOR(value) AS INT) % 3 AS STRING) AS action_key,
  event_type <> 'error' AS ok,
  CAST(FLOOR(value) AS INT) % 5 AS rows_returned
"""

TRACE_STEPS = f"""
SELECT user_id AS task_id,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step_index, ts, {_STEP_COLUMNS}
FROM events
"""

_NUMBERED_STEPS = f"""
SELECT user_id AS task_id, step_index, ts, {_STEP_COLUMNS} FROM numbered_events
"""

TASK_SIGNALS = """
SELECT DISTINCT user_id AS task_id,
  CASE event_type WHEN 'view' THEN 'denominator_risk' WHEN 'click' THEN 'threshold_grounding_risk' WHEN 'purchase' THEN 'output_shape_semantic_risk' WHEN 'signup' THEN 'no_grounded_answer' ELSE 'budget_exhaustion' END AS code,
  CASE WHEN event_type IN ('signup','error') THEN 'error' WHEN value > 100 THEN 'warning' ELSE 'info' END AS severity
FROM events
"""

ANSWER_CELLS = """
SELECT c_nationkey AS task_id, 'gold' AS side, c_custkey AS row_idx, 0 AS col_idx, c_name AS v FROM customer
UNION ALL SELECT c_nationkey, 'gold', c_custkey, 1, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) FROM customer
UNION ALL SELECT c_nationkey, 'pred', c_custkey, 0, CAST(CAST(c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS DECIMAL(12,2)) AS STRING) FROM customer WHERE c_nationkey % 7 <> 0
UNION ALL SELECT c_nationkey, 'pred', c_custkey, 1, ' ' || c_name || ' ' FROM customer WHERE c_nationkey % 7 <> 0
UNION ALL SELECT c_nationkey, 'pred', c_custkey, 2, c_mktsegment FROM customer WHERE c_nationkey % 7 <> 0 AND c_nationkey % 4 = 0
"""

MESSY_CELLS = """
SELECT c_nationkey AS task_id, c_custkey AS row_idx,
  CASE c_custkey % 6 WHEN 0 THEN ' N/A ' WHEN 1 THEN CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) || '7' WHEN 2 THEN CAST(c_nationkey AS STRING) || ' %' WHEN 3 THEN CAST(c_nationkey AS STRING) || ' - ' || CAST(c_custkey % 5 AS STRING) WHEN 4 THEN '3/14/2024' ELSE c_name END AS v
FROM customer
"""

QUESTION_TEXTS = """
  CASE key % 8
    WHEN 0 THEN 'How many customers have a normal balance level in ' || name || '?'
    WHEN 1 THEN 'What is the average monthly price of BUILDING customers for the year 1997?'
    WHEN 2 THEN 'What percentage of orders were placed by customers from ' || name || '?'
    WHEN 3 THEN 'List the top 5 customers by total amount.'
    WHEN 4 THEN 'List their id, name and balance for ' || name || '.'
    WHEN 5 THEN 'Which supplier ranked second in ' || name || '?'
    WHEN 6 THEN 'According to the document, what is the total cost and status of "Order 7"?'
    ELSE 'Among the parts with size between 10 to 20, what is the highest retail price?' END AS question,
  CASE key % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'extreme' END AS difficulty
"""

QUESTIONS = f"""
SELECT key AS task_id, {QUESTION_TEXTS}
FROM (SELECT n_nationkey AS key, n_name AS name FROM nation)
"""

# One question per customer: the same wordings on a table that grows with the data.
CUSTOMER_QUESTIONS = f"""
SELECT key AS task_id, {QUESTION_TEXTS}
FROM (SELECT c_custkey AS key, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""

# name -> (SQL, inputs)
DERIVED: dict[str, tuple[str, tuple[str, ...]]] = {
    "narratives": (NARRATIVES, ("customer",)),
    "json_wrapped": (JSON_WRAPPED, ("orders",)),
    "trace_steps": (TRACE_STEPS, ("events",)),
    "task_signals": (TASK_SIGNALS, ("events",)),
    "answer_cells": (ANSWER_CELLS, ("customer",)),
    "messy_cells": (MESSY_CELLS, ("customer",)),
    "questions": (QUESTIONS, ("nation",)),
    "customer_questions": (CUSTOMER_QUESTIONS, ("customer", "nation")),
}

#: Inputs whose short rows become texts that take long to read. Their files are far smaller
#: than that work, so the rows are dealt over tasks before the texts are made.
DEALT: dict[str, tuple[str, ...]] = {
    "narratives": ("customer",), "json_wrapped": ("orders",), "customer_questions": ("customer",), "messy_cells": ("customer",),
}


def build(tables: Tables, name: str) -> DataFrame:
    if name == "trace_steps":
        numbered = number_in_key(tables.events, "user_id", "ts", "event_id", "step_index")
        numbered.createOrReplaceTempView("numbered_events")
        return tables.spark.sql(_NUMBERED_STEPS)
    text, inputs = DERIVED[name]
    return tables.sql(text, *inputs, dealt=DEALT.get(name, ()))


def define(name: str, text: str, inputs: tuple[str, ...], dealt: tuple[str, ...] = ()) -> None:
    """Add a derived table; ``inputs`` may name other derived tables, ``dealt`` as in ``DEALT``."""
    DERIVED[name] = (text, inputs)
    if dealt:
        DEALT[name] = dealt


def _closure(names: tuple[str, ...] | list[str]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        if name in DERIVED and name not in out:
            for parent in DERIVED[name][1]:
                visit(parent)
            out.append(name)

    for name in names:
        visit(name)
    return out


def with_derived(text: str, names: tuple[str, ...] | list[str]) -> str:
    """Put the derived tables in front of an oracle query as CTEs."""
    text = text.strip()
    parts = [f"{name} AS ({DERIVED[name][0].strip()})" for name in _closure(names)]
    if not parts:
        return text
    head, body = "WITH ", text
    upper = text[:20].upper()
    if upper.startswith("WITH RECURSIVE "):
        head, body = "WITH RECURSIVE ", text[15:].strip()
    elif upper.startswith("WITH "):
        body = text[5:].strip()
    else:
        return head + ",\n".join(parts) + "\n" + text
    return head + ",\n".join(parts) + ",\n" + body


__all__ = ["DERIVED", "build", "define", "with_derived", "F"]
