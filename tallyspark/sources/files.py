"""Files as tables: inventories, statement masters, JSON documents and usage logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
#: The columns of a statement master, in the order of the contract.
MASTER_COLUMNS = [
    "transaction_id", "source", "source_sha256", "bank", "statement_kind", "validation_note", "opening_balance_origin", "header_balance",
    "page", "sequence", "account", "currency", "year_supplied", "date", "transaction_datetime", "direction", "money_in", "money_out",
    "balance", "balance_origin", "transaction_type", "counterparty", "counterparty_role", "counterparty_raw", "details_raw", "particular",
    "narration", "opening_balance", "closing_balance", "total_money_in", "total_money_out", "balance_checks", "matching_status",
]
_KINDS = {"page": T.IntegerType(), "sequence": T.IntegerType(), "year_supplied": T.IntegerType(), "date": T.DateType(), "transaction_datetime": T.TimestampType()}
_KINDS |= dict.fromkeys([c for c in MASTER_COLUMNS if c.startswith(("money_", "total_money_")) or c in ("balance", "header_balance", "opening_balance", "closing_balance")], MONEY)
MASTER = T.StructType([T.StructField(c, _KINDS.get(c, T.StringType())) for c in MASTER_COLUMNS])
#: What older masters without these columns mean.
MASTER_DEFAULTS = {"bank": "ambank", "statement_kind": "statement", "validation_note": "", "opening_balance_origin": "printed"}
USAGE = "at timestamp, event_id string, id string, run_id string, stage string, model string, status string, usage struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,reasoning_output_tokens:bigint>"


def supporting_files(spark: SparkSession, root: str, excluded: list[str] | None = None) -> DataFrame:
    """Rows (path, bytes, modified, sha256) of every file below root but the excluded folders and files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.upper(F.sha2("content", 256)).alias("sha256"))
    for name in excluded or []:
        rows = rows.filter(~F.contains("path", F.lit(f"/{name}/")) & ~F.endswith("path", F.lit(f"/{name}")))
    return rows


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """A statement master: quoted narrations may hold line breaks; columns that older files lack get their defaults."""
    raw = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8").csv(path)
    first = raw.columns[0]
    raw = raw.withColumnRenamed(first, first.lstrip("﻿"))
    cols = []
    for f in MASTER.fields:
        value = F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(MASTER_DEFAULTS.get(f.name))
        cols.append(value.try_cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def write_master(rows: DataFrame, header: DataFrame, path: str) -> None:
    """Rows with the header of their statement on each, in the order of the contract.

    Rows and headers (one row a statement) meet by source_sha256; rows without that column belong to the one header there is.
    """
    whole = rows
    if header.columns and "source_sha256" in rows.columns:
        whole = rows.join(header.dropDuplicates(["source_sha256"]), "source_sha256", "left")
    elif header.columns:
        if len(header.take(2)) > 1:
            raise ValueError("several statements: rows need their source_sha256")
        whole = rows.crossJoin(F.broadcast(header))  # one row
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in whole.columns else F.lit(MASTER_DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name) for f in MASTER.fields]
    whole.select(*cols).sortWithinPartitions("source_sha256", "sequence").write.mode("errorifexists").options(header=True, quoteAll=True, escape='"').csv(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage events of a JSON-lines log; lines that can't be read are left out."""
    rows = spark.read.schema(USAGE + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter(F.col("_bad").isNull() & F.col("id").isNotNull()).drop("_bad")


def reported_usage(lines: DataFrame) -> DataFrame:
    """Per file the usage of its last complete turn: from (path, line_no, value) JSON lines."""
    parsed = lines.withColumn("e", F.from_json("value", "type string, usage struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,reasoning_output_tokens:bigint>"))
    u = F.col("e.usage")
    valid = (F.col("e.type") == "turn.completed") & F.least(*[F.coalesce(u[c], F.lit(-1)) for c in ("input_tokens", "cached_input_tokens", "output_tokens")]).between(0, 1 << 62)
    return parsed.filter(valid).groupBy("path").agg(F.max_by("e.usage", "line_no").alias("usage"))


def changed_files(current: DataFrame, imported: DataFrame) -> DataFrame:
    """Files whose path, size or time isn't in the table of imports."""
    return current.join(imported.select("path", "bytes", "modified"), ["path", "bytes", "modified"], "left_anti")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A CSV report in which no text is read as a formula."""
    from ..functions.money import formula_escape

    safe = [formula_escape(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in rows.dtypes]
    rows.select(*safe).write.mode("errorifexists").options(header=True, quoteAll=True, escape='"').csv(path)


def evidence_columns(paths: DataFrame, key: str, most: int) -> DataFrame:
    """Evidence paths of each key as columns evidence_1 to evidence_<most>; `rest` counts what a wider sheet would show."""
    listed = paths.groupBy(key).agg(F.sort_array(F.collect_set("path")).alias("p"))
    cols = [F.try_element_at("p", F.lit(k)).alias(f"evidence_{k}") for k in range(1, most + 1)]
    return listed.select(key, *cols, F.greatest(F.size("p") - most, F.lit(0)).alias("rest"))
