"""Vault folders as frames: markdown notes with front matter, links and kinds."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultweave.functions.markdown import links, structural_dependencies, title

# Top folder to kind of note.
KIND_OF = {"concepts": "concept", "diagnostics": "diagnostic", "domains": "domain", "projections": "projection", "papers": "paper", "invariants": "invariant", "meta": "meta"}
#: Front matter keys that mean the same, the first present counts.
SAME_KEYS = {
    "tags": ("tags", "tag"), "aliases": ("aliases", "alias"), "created": ("created", "date"), "modified": ("modified", "lastmod", "updated", "last-modified"),
    "published": ("published", "publishDate", "date"), "image": ("socialImage", "image", "cover"), "cssclasses": ("cssclasses", "cssclass"),
}


def read_texts(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path, text) of the files below ``root`` that match, hidden parts of the relative path left out."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    base = root.rstrip("/").removeprefix("file://") + "/"
    return files.select(F.substring_index(full, base, -1).alias("path"), F.col("value").alias("text")).where(~F.col("path").rlike(r"(^|/)\."))


def _strings(value) -> list[str]:
    if value is None:
        return []
    values = value.split(",") if isinstance(value, str) else value if isinstance(value, list) else [value]
    return [str(v).strip() for v in values if v is not None and str(v).strip()]


def _parse(blocks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    import yaml

    for block in blocks:
        rows = []
        for text in block:
            try:
                raw = yaml.safe_load(text) if text else {}
                bad = None if isinstance(raw, dict) else "no mapping"
            except yaml.YAMLError as error:
                raw, bad = {}, str(error).split("\n")[0]
            raw = raw if isinstance(raw, dict) else {}
            first = lambda k: next((raw[x] for x in SAME_KEYS.get(k, (k,)) if raw.get(x) is not None), None)  # noqa: B023, E731
            rows.append({
                "fields": json.dumps(raw, default=str, ensure_ascii=False), "role": raw.get("role"), "layer": raw.get("layer"), "canonical": bool(raw.get("canonical", False)),
                "aliases": _strings(first("aliases")), "tags": _strings(first("tags")), "depends_on": _strings(first("depends_on")), "error": bad,
            })
        yield pd.DataFrame(rows, columns=["fields", "role", "layer", "canonical", "aliases", "tags", "depends_on", "error"])


_FRONT = "struct<fields:string,role:string,layer:string,canonical:boolean,aliases:array<string>,tags:array<string>,depends_on:array<string>,error:string>"


def with_front_matter(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with ``front`` (parsed YAML, see the fields) and ``content`` (the text below the fences).

    A block that is no YAML mapping gives ``front.error`` and empty fields; no
    row is dropped.  A text without fences has an empty block.
    """
    block = F.coalesce(F.regexp_extract(F.col(text), r"(?s)^---\r?\n(.*?)\r?\n---", 1), F.lit(""))
    body = F.regexp_replace(F.col(text), r"(?s)^---\r?\n.*?\r?\n---[ \t]*(\r?\n|$)", "")
    return texts.withColumn("front", F.pandas_udf(_parse, _FRONT)(block)).withColumn("content", body)


def load_vault(spark: SparkSession, root: str) -> DataFrame:
    """Notes of a vault: (note_id, path, name, title, kind, role, layer, canonical, aliases, tags, links, deps, front, content, error).

    The kind is that of the first folder, ``meta`` for any other; the role is the
    declared one, else the kind; the layer of a concept defaults to ``unknown``.
    Names are compared in lower case.
    """
    parsed = with_front_matter(read_texts(spark, root))
    kinds = F.create_map(*[F.lit(x) for kv in KIND_OF.items() for x in kv])
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1))
    kind = F.coalesce(F.try_element_at(kinds, F.coalesce(top, F.lit(""))), F.lit("meta"))
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    declared = F.flatten(F.transform("front.depends_on", links))
    deps = F.when(kind == "concept", F.array_union(structural_dependencies(F.col("content")), F.array_distinct(declared))).otherwise(F.array_distinct(declared))
    return parsed.select(
        F.regexp_replace("path", r"\.md$", "").alias("note_id"), "path", name.alias("name"), title(F.col("content"), name).alias("title"), kind.alias("kind"),
        F.coalesce("front.role", F.when(kind != "meta", kind)).alias("role"), F.coalesce("front.layer", F.when(kind == "concept", F.lit("unknown"))).alias("layer"),
        "front.canonical", "front.aliases", "front.tags", links(F.col("content")).alias("links"), deps.alias("deps"), F.col("front.fields").alias("front"), "content", "front.error",
    )


def publishable(notes: DataFrame, explicit: bool = False) -> DataFrame:
    """Notes that are no drafts; with ``explicit`` only those marked to be published."""
    flag = lambda k: F.lower(F.coalesce(F.get_json_object("front", f"$.{k}"), F.lit("false"))) == "true"
    out = notes.where(~flag("draft"))
    return out.where(flag("publish")) if explicit else out
