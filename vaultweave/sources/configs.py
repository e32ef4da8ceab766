"""Small configuration files and source texts: hub policies, registry overrides, Python statements."""

from __future__ import annotations

import ast
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultweave.session import exists
from vaultweave.sources.vault import read_texts

STATEMENT = "path string, line int, kind string, text string"


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A YAML mapping from any file system; an absent or empty file is an empty one."""
    import yaml

    if not exists(spark, path):
        return {}
    found = yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def hub_policy(spark: SparkSession, policy: dict) -> DataFrame:
    """(name, hub_class, headings): what is asked of each hub; ``hubs`` maps names to a class or to ``{class, required_headings}``."""
    base = policy.get("required_headings", [])
    rows = []
    for name, entry in (policy.get("hubs") or {}).items():
        entry = {"class": entry} if isinstance(entry, str) else entry or {}
        rows.append((str(name).strip().lower(), entry.get("class"), [str(h) for h in entry.get("required_headings", base)]))
    return spark.createDataFrame(rows, "name string, hub_class string, headings array<string>")


def registry_overrides(spark: SparkSession, raw: dict) -> tuple[DataFrame, dict[str, list[str]]]:
    """(name, role, hub_class) of the concepts overridden, and the orders of sections."""
    rows = [(str(k).strip().lower(), (v or {}).get("role"), (v or {}).get("hub_class")) for k, v in (raw.get("concept_overrides") or {}).items()]
    orders = {str(k): [str(x) for x in v or []] for k, v in (raw.get("section_orders") or {}).items()}
    return spark.createDataFrame(rows, "name string, role string, hub_class string"), orders


def read_files(spark: SparkSession, root: str, pattern: str = "*", ignored: Sequence[str] = ()) -> DataFrame:
    """(path, is_page) of the files below ``root``, those that match a shell pattern of ``ignored`` left out."""
    from vaultweave.operators.typing import _matches

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    base = root.rstrip("/").removeprefix("file://") + "/"
    named = files.select(F.substring_index(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), base, -1).alias("path"))
    kept = named.where(~F.col("path").rlike(r"(^|/)\.") & ~_matches(F.col("path"), ignored))
    return kept.withColumn("is_page", F.col("path").endswith(".md"))


def read_statements(spark: SparkSession, root: str) -> DataFrame:
    """(path, line, kind, text) of the strings, calls and imports of the Python files below ``root``, tests and caches left out; a file that does not parse gives one row of kind ``error``."""
    texts = read_texts(spark, root, "*.py").where(~F.col("path").rlike(r"(^|/)(tests?|__pycache__)/"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.path, batch.text):
                try:
                    tree = ast.parse(text or "")
                except SyntaxError as error:
                    rows.append((path, error.lineno or 0, "error", str(error.msg)))
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, ast.Constant) and isinstance(node.value, str):
                        rows.append((path, node.lineno, "string", node.value))
                    elif isinstance(node, ast.Call):
                        rows.append((path, node.lineno, "call", ast.unparse(node.func)))
                    elif isinstance(node, (ast.Import, ast.ImportFrom)):
                        module = getattr(node, "module", None)
                        rows += [(path, node.lineno, "import", f"{module}.{a.name}" if module else a.name) for a in node.names]
            yield pd.DataFrame(rows, columns=["path", "line", "kind", "text"])

    return texts.mapInPandas(run, STATEMENT)


def prescriptive_strings(statements: DataFrame) -> DataFrame:
    """Strings of the sources that tell someone what to do."""
    from vaultweave.functions.signals import prescriptive

    return statements.where((F.col("kind") == "string") & prescriptive(F.col("text")))


def calls_without(statements: DataFrame, calls: Sequence[str], beside: Sequence[str]) -> DataFrame:
    """(path, n): files that make any of ``calls`` but none of ``beside`` (writes without a log, force without a gate)."""
    last = F.substring_index("text", ".", -1)
    made = statements.where(F.col("kind") == "call").groupBy("path").agg(F.count_if(last.isin(list(calls))).alias("n"), F.count_if(last.isin(list(beside))).alias("_beside"))
    return made.where("n > 0 and _beside = 0").select("path", "n")


def vault_state(notes: DataFrame) -> DataFrame:
    """(notes, concepts, links, digest): the counts of a vault and one hash over its paths and contents, whatever their order."""
    row = F.sha2(F.concat_ws("\u0000", "path", F.coalesce("content", F.lit(""))), 256)
    parts = [F.sum(F.conv(F.substr(row, F.lit(1 + 12 * i), F.lit(12)), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return notes.agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.col("kind") == "concept").alias("concepts"), F.coalesce(F.sum(F.size("links")), F.lit(0)).alias("links"), F.sha2(F.concat_ws("-", *[p.cast("string") for p in parts]), 256).alias("digest"))
