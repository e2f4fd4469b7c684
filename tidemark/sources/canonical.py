"""Canonical tables derived from the star schema, documents and logs.

``SQL`` holds the same definitions for the oracle.  Missing values and
sentinels are injected by fixed arithmetic on keys so that every NULL path is
exercised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.sources.readers import table

REFERENCE_DAY = "2000-01-01"


def _days(column: str):
    return F.datediff(F.col(column).cast("date"), F.lit(REFERENCE_DAY).cast("date"))


def _months(column: str):
    return F.floor(_days(column) / 30).cast("int")


def _article_id(key: str):
    """Ten digits at least; a number needs no text clean-up."""
    text = F.col(key).cast("string")
    return F.when(F.col(key) < 10**10, F.lpad(text, 10, "0")).otherwise(text)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").join(
        table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).select(
        F.col("o_custkey").cast("string").alias("customer_id"),
        _article_id("l_partkey").alias("article_id"),
        F.col("o_orderdate").cast("date").alias("t_dat"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("sales_channel_id"),
    )


def articles(spark: SparkSession, folder: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, folder, "part").select(
        _article_id("p_partkey").alias("article_id"),
        F.col("p_type").alias("product_type_name"),
        F.get(words, F.lit(1)).alias("product_group_name"),
        F.get(words, F.lit(0)).alias("colour_group_name"),
        F.col("p_brand").alias("department_name"),
        F.concat(F.lit("S"), F.floor(F.col("p_size") / 10).cast("string")).alias("section_name"),
        F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit("G"), (F.col("p_size") % 5).cast("string"))).alias(
            "garment_group_name"
        ),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.when(F.col("c_custkey") % 10 != 0, (18 + F.col("c_custkey") % 60).cast("int")).alias("age"),
    )


def application(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("SK_ID_CURR"),
        (F.col("c_acctbal") < 0).cast("int").alias("TARGET"),
        F.when(key % 8 != 0, F.col("c_mktsegment")).alias("SEGMENT"),
        F.col("c_nationkey").alias("NATION"),
        F.when(key % 7 == 0, S.UNKNOWN_DAY).otherwise(-((key * 13) % 9000)).cast("int").alias("DAYS_EMPLOYED"),
    )


def bureau(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        key.alias("SK_ID_BUREAU"),
        F.col("o_custkey").alias("SK_ID_CURR"),
        _days("o_orderdate").alias("DAYS_CREDIT"),
        F.when(status == "O", "Active").when(status == "F", "Closed").otherwise("Sold").alias("CREDIT_ACTIVE"),
        F.when(F.col("o_orderpriority") == "1-URGENT", key % 30).otherwise(0).cast("int").alias("CREDIT_DAY_OVERDUE"),
        F.when(key % 50 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("AMT_CREDIT_SUM"),
        F.when(key % 9 != 0, 0.3 * F.col("o_totalprice")).alias("AMT_CREDIT_SUM_DEBT"),
    )


def _bureau_month() -> dict[str, Column]:
    codes = F.array(*[F.lit(c) for c in "012345CX"])
    return {
        "SK_ID_BUREAU": F.col("l_orderkey"),
        "MONTHS_BALANCE": _months("l_shipdate"),
        "STATUS": F.get(codes, (F.col("l_partkey") % 8).cast("int")),
    }


def _named(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return rows.select(*[value.alias(name) for name, value in columns.items()])


def bureau_balance(spark: SparkSession, folder: str) -> DataFrame:
    return _named(table(spark, folder, "lineitem"), _bureau_month())


def previous_application(spark: SparkSession, folder: str) -> DataFrame:
    key, total, status = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        key.alias("SK_ID_PREV"),
        F.col("o_custkey").alias("SK_ID_CURR"),
        _days("o_orderdate").alias("DAYS_DECISION"),
        F.when(status == "O", "Approved").when(status == "F", "Refused").otherwise("Canceled").alias(
            "NAME_CONTRACT_STATUS"
        ),
        F.when(key % 40 == 0, 0.0).otherwise(total).alias("AMT_APPLICATION"),
        (0.9 * total).alias("AMT_CREDIT"),
        F.when(key % 3 != 0, 0.1 * total).alias("AMT_DOWN_PAYMENT"),
        F.when(key % 3 != 0, (key % 10) / 100.0).alias("RATE_DOWN_PAYMENT"),
        F.when(key % 5 == 0, S.UNKNOWN_DAY).otherwise(_days("o_orderdate") + 30).cast("int").alias("DAYS_LAST_DUE"),
    )


def _installment() -> dict[str, Column]:
    return {
        "SK_ID_CURR": F.col("o_custkey"),
        "SK_ID_PREV": F.col("l_orderkey"),
        "DAYS_INSTALMENT": _days("o_orderdate"),
        "DAYS_ENTRY_PAYMENT": F.when(F.col("l_partkey") % 17 != 0, _days("l_shipdate")),
        "AMT_INSTALMENT": F.col("l_extendedprice"),
        "AMT_PAYMENT": F.col("l_extendedprice") * (1 - F.col("l_discount")),
    }


def installments_payments(spark: SparkSession, folder: str) -> DataFrame:
    return _named(lines(spark, folder), _installment())


def _pos_cash() -> dict[str, Column]:
    return {
        "SK_ID_CURR": F.col("o_custkey"),
        "SK_ID_PREV": F.col("l_orderkey"),
        "MONTHS_BALANCE": _months("l_shipdate"),
        "SK_DPD": (F.col("l_partkey") % 5).cast("int"),
        "NAME_CONTRACT_STATUS": F.when(F.col("l_linestatus") == "O", "Active").otherwise("Completed"),
        "CNT_INSTALMENT_FUTURE": F.col("l_quantity"),
    }


def pos_cash_balance(spark: SparkSession, folder: str) -> DataFrame:
    return _named(lines(spark, folder), _pos_cash())


def _card() -> dict[str, Column]:
    return {
        "SK_ID_CURR": F.col("o_custkey"),
        "MONTHS_BALANCE": _months("l_shipdate"),
        "AMT_BALANCE": F.col("l_extendedprice"),
        "AMT_CREDIT_LIMIT_ACTUAL": F.when(F.col("l_partkey") % 13 == 0, 0.0).otherwise(F.col("l_quantity") * 1000),
        "AMT_PAYMENT_CURRENT": F.col("l_extendedprice") * F.col("l_tax"),
        "AMT_DRAWINGS_CURRENT": F.when(F.col("l_partkey") % 6 != 0, F.col("l_extendedprice") * F.col("l_discount")),
        "SK_DPD": (F.col("l_partkey") % 5).cast("int"),
    }


def credit_card_balance(spark: SparkSession, folder: str) -> DataFrame:
    return _named(lines(spark, folder), _card())


def histories(spark: SparkSession, folder: str) -> DataFrame:
    """Instalments, POS and card balances are views of the same lines: the columns of all three, from one join."""
    return _named(lines(spark, folder), _installment() | _pos_cash() | _card())


def credit_months(spark: SparkSession, folder: str) -> DataFrame:
    """``bureau_balance`` with the contract status of the POS rows, which are the same lines."""
    status = {"NAME_CONTRACT_STATUS": _pos_cash()["NAME_CONTRACT_STATUS"]}
    return _named(table(spark, folder, "lineitem"), _bureau_month() | status)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled rows with a tied, label-correlated score in [0, 1]."""
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id"), "doc_id")
    noise = F.pmod(F.col("doc_id") * 7919, F.lit(997)) / 1000.0
    return rows.select(
        F.col("doc_id").alias("id"),
        F.col("toxic").cast("int").alias("target"),
        (F.floor((noise * 0.75 + F.col("toxic") * 0.2 + 0.02) * 250 + 0.3) / 250.0).alias("p"),
    )


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Non-blank lines of each document, in order, trimmed."""
    raw = table(spark, folder, "documents").select(
        F.col("doc_id").alias("material_id"), F.posexplode(F.split("text", "\n")).alias("_line", "_text")
    )
    return raw.select(
        "material_id", F.col("_line").cast("bigint").alias("pos"), S.trimmed("_text").alias("text"),
        F.concat(F.lit("paragraph "), (F.col("_line") + 1).cast("string")).alias("source"),
    ).where(F.length("text") > 0)


def dialogue(spark: SparkSession, folder: str) -> DataFrame:
    """Chat lines ``role: text`` in turn order; system prompts are not lines."""
    return (
        table(spark, folder, "conversations").where(F.col("role") != "system")
        .select(
            F.col("conv_id").alias("chat_id"), "turn", "role",
            F.concat("role", F.lit(": "), "text").alias("line"),
        )
    )


SQL = {
    "lines": "SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "transactions": """SELECT CAST(o_custkey AS VARCHAR) AS customer_id,
        lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS article_id, CAST(o_orderdate AS DATE) AS t_dat,
        l_extendedprice AS price, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS sales_channel_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "articles": """SELECT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS article_id, p_type AS product_type_name,
        string_split(p_name, ' ')[2] AS product_group_name, string_split(p_name, ' ')[1] AS colour_group_name,
        p_brand AS department_name, 'S' || CAST(p_size // 10 AS VARCHAR) AS section_name,
        CASE WHEN p_partkey % 11 <> 0 THEN 'G' || CAST(p_size % 5 AS VARCHAR) END AS garment_group_name
        FROM part""",
    "customers": """SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
        CASE WHEN c_custkey % 10 <> 0 THEN CAST(18 + c_custkey % 60 AS INTEGER) END AS age FROM customer""",
    "application": """SELECT c_custkey AS SK_ID_CURR, CAST(c_acctbal < 0 AS INTEGER) AS TARGET,
        CASE WHEN c_custkey % 8 <> 0 THEN c_mktsegment END AS SEGMENT, c_nationkey AS NATION,
        CAST(CASE WHEN c_custkey % 7 = 0 THEN 365243 ELSE -((c_custkey * 13) % 9000) END AS INTEGER)
        AS DAYS_EMPLOYED FROM customer""",
    "bureau": """SELECT o_orderkey AS SK_ID_BUREAU, o_custkey AS SK_ID_CURR,
        CAST(o_orderdate AS DATE) - DATE '2000-01-01' AS DAYS_CREDIT,
        CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Closed' ELSE 'Sold' END AS CREDIT_ACTIVE,
        CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey % 30 ELSE 0 END AS CREDIT_DAY_OVERDUE,
        CASE WHEN o_orderkey % 50 = 0 THEN 0.0 ELSE o_totalprice END AS AMT_CREDIT_SUM,
        CASE WHEN o_orderkey % 9 <> 0 THEN CAST(0.3 AS DOUBLE) * o_totalprice END AS AMT_CREDIT_SUM_DEBT
        FROM orders""",
    "bureau_balance": """SELECT l_orderkey AS SK_ID_BUREAU,
        CAST(floor((CAST(l_shipdate AS DATE) - DATE '2000-01-01') / 30.0) AS INTEGER) AS MONTHS_BALANCE,
        substr('012345CX', CAST(l_partkey % 8 AS INTEGER) + 1, 1) AS STATUS FROM lineitem""",
    "previous_application": """SELECT o_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR,
        CAST(o_orderdate AS DATE) - DATE '2000-01-01' AS DAYS_DECISION,
        CASE o_orderstatus WHEN 'O' THEN 'Approved' WHEN 'F' THEN 'Refused' ELSE 'Canceled' END
        AS NAME_CONTRACT_STATUS,
        CASE WHEN o_orderkey % 40 = 0 THEN 0.0 ELSE o_totalprice END AS AMT_APPLICATION,
        CAST(0.9 AS DOUBLE) * o_totalprice AS AMT_CREDIT,
        CASE WHEN o_orderkey % 3 <> 0 THEN CAST(0.1 AS DOUBLE) * o_totalprice END AS AMT_DOWN_PAYMENT,
        CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 10 AS DOUBLE) / 100 END AS RATE_DOWN_PAYMENT,
        CAST(CASE WHEN o_orderkey % 5 = 0 THEN 365243
        ELSE CAST(o_orderdate AS DATE) - DATE '2000-01-01' + 30 END AS INTEGER) AS DAYS_LAST_DUE FROM orders""",
    "installments_payments": """SELECT o_custkey AS SK_ID_CURR, l_orderkey AS SK_ID_PREV,
        CAST(o_orderdate AS DATE) - DATE '2000-01-01' AS DAYS_INSTALMENT,
        CASE WHEN l_partkey % 17 <> 0 THEN CAST(l_shipdate AS DATE) - DATE '2000-01-01' END AS DAYS_ENTRY_PAYMENT,
        l_extendedprice AS AMT_INSTALMENT, l_extendedprice * (1 - l_discount) AS AMT_PAYMENT
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "pos_cash_balance": """SELECT o_custkey AS SK_ID_CURR, l_orderkey AS SK_ID_PREV,
        CAST(floor((CAST(l_shipdate AS DATE) - DATE '2000-01-01') / 30.0) AS INTEGER) AS MONTHS_BALANCE,
        CAST(l_partkey % 5 AS INTEGER) AS SK_DPD,
        CASE WHEN l_linestatus = 'O' THEN 'Active' ELSE 'Completed' END AS NAME_CONTRACT_STATUS,
        l_quantity AS CNT_INSTALMENT_FUTURE FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "credit_card_balance": """SELECT o_custkey AS SK_ID_CURR,
        CAST(floor((CAST(l_shipdate AS DATE) - DATE '2000-01-01') / 30.0) AS INTEGER) AS MONTHS_BALANCE,
        l_extendedprice AS AMT_BALANCE,
        CASE WHEN l_partkey % 13 = 0 THEN 0.0 ELSE l_quantity * 1000 END AS AMT_CREDIT_LIMIT_ACTUAL,
        l_extendedprice * l_tax AS AMT_PAYMENT_CURRENT,
        CASE WHEN l_partkey % 6 <> 0 THEN l_extendedprice * l_discount END AS AMT_DRAWINGS_CURRENT,
        CAST(l_partkey % 5 AS INTEGER) AS SK_DPD FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "scored": """SELECT doc_id AS id, CAST(toxic AS INTEGER) AS target,
        floor(((CAST((doc_id * 7919) % 997 AS DOUBLE) / 1000) * CAST(0.75 AS DOUBLE)
        + toxic * CAST(0.2 AS DOUBLE) + CAST(0.02 AS DOUBLE)) * 250 + CAST(0.3 AS DOUBLE)) / 250 AS p
        FROM labels JOIN documents USING (doc_id)""",
    "segments": rf"""SELECT * FROM (SELECT material_id, CAST(i - 1 AS BIGINT) AS pos,
        regexp_replace(parts[i], '^{S.SPACE}+|{S.SPACE}+$', '', 'g') AS text,
        'paragraph ' || CAST(i AS VARCHAR) AS source
        FROM (SELECT material_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id AS material_id, string_split(text, chr(10)) AS parts FROM documents)))
        WHERE length(text) > 0""",
    "dialogue": """SELECT conv_id AS chat_id, turn, role, role || ': ' || text AS line
        FROM conversations WHERE role <> 'system'""",
}
