"""Note types as data: a registry of locations and field constraints, and validation by it.

Notes are rows of (note_id, path, front), ``front`` the fields of the front
matter as JSON (null or ``{}`` where there is none).  The registry is small and
becomes part of the plan, so any number of notes is validated without a shuffle.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING = "note_id string, path string, type_id string, field string, message string"


@dataclass(frozen=True)
class NoteType:
    """One type: where its notes lie and what their front matter must hold."""

    id: str
    description: str = ""
    allowed: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    constraints: dict[str, dict[str, Any]] = field(default_factory=dict)
    needs_front: bool = True


def load_types(text: str) -> tuple[NoteType, ...]:
    """The types of a TOML registry, in its order; raises without ``types``."""
    raw = tomllib.loads(text)
    if "types" not in raw:
        raise ValueError("a registry needs types")
    default = raw.get("defaults", {}).get("requires_frontmatter", True)
    out = []
    for t in raw["types"]:
        place, meta = t.get("locations", {}), t.get("metadata", {})
        out.append(
            NoteType(
                t.get("type_id", "unknown"), t.get("description", ""), tuple(place.get("allowed_patterns", ())), tuple(place.get("forbidden_patterns", ())), tuple(place.get("allowed_extensions", ())),
                tuple(meta.get("required", ())), tuple(meta.get("optional", ())), dict(meta.get("constraints", {})), t.get("governance", {}).get("requires_frontmatter", default),
            )
        )
    return tuple(out)


def glob_pattern(glob: str) -> str:
    """The regular expression of a shell pattern; ``*`` goes across folders."""
    out = ""
    i = 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inside = glob[i + 1 : end].replace("\\", r"\\")
            out += f"[{'^' + inside[1:] if inside[0] == '!' else inside}]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return rf"(?s)\A(?:{out})\z"


def _matches(path: Column, globs: Sequence[str]) -> Column:
    return reduce(Column.__or__, [path.rlike(glob_pattern(g)) for g in globs]) if globs else F.lit(False)


def type_of(path: Column, types: Sequence[NoteType]) -> Column:
    """The first type whose allowed patterns a relative path matches and whose forbidden ones it does not; null if none."""
    return F.coalesce(*[F.when(~_matches(path, t.forbidden) & _matches(path, t.allowed), F.lit(t.id)) for t in types], F.lit(None).cast("string"))


def _json_kind(value: Column) -> Column:
    """Which kind of JSON value a raw text is."""
    return (
        F.when(value.isin("true", "false"), "bool").when(value.rlike(r"^-?\d+$"), "int").when(value.rlike(r"^-?\d*\.?\d+([eE][+-]?\d+)?$"), "float")
        .when(value.startswith("["), "list").when(value.startswith("{"), "dict").when(value == "null", "NoneType").otherwise("str")
    )


def _field_errors(raw: Column, name: str, rule: dict[str, Any]) -> list[Column]:
    """Messages (null where all is well) for one field; ``raw`` is its value as JSON."""
    kind = _json_kind(raw)
    text = F.when(kind == "str", F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string").v).otherwise(raw)
    say = lambda what: F.format_string(f"field '{name}' must be {what}, got '%s'", text)
    typed = lambda wanted, *kinds: F.when(~kind.isin(*kinds), F.format_string(f"field '{name}' must be {wanted}, got %s", kind))
    sort = rule.get("type")
    if sort == "literal":
        return [F.when(raw != json.dumps(rule.get("value"), ensure_ascii=False), say(f"'{rule.get('value')}'"))]
    if sort == "enum":
        return [F.when(~raw.isin([json.dumps(v, ensure_ascii=False) for v in rule.get("values", [])]), say("one of " + ", ".join(map(str, rule.get("values", [])))))]
    if sort in ("boolean", "string", "integer"):
        return [typed(sort, *{"boolean": ["bool"], "string": ["str"], "integer": ["int", "bool"]}[sort])]
    if sort == "list":
        items = F.from_json(raw, "array<string>")
        raws = F.from_json(raw, "array<variant>")
        out = [typed("list", "list")]
        if rule.get("item_type") == "string":
            other = F.filter(F.transform(raws, lambda v: F.schema_of_variant(v)), lambda s: s != "STRING")
            out.append(F.when((kind == "list") & (F.size(other) > 0), F.lit(f"field '{name}' must hold strings only")))
        if rule.get("allowed"):
            bad = F.array_except(items, F.array(*[F.lit(str(v)) for v in rule["allowed"]]))
            out.append(F.when((kind == "list") & (F.size(bad) > 0), F.concat(F.lit(f"field '{name}' holds values not allowed: "), F.array_join(bad, ", "))))
        return out
    return []


def validate(notes: DataFrame, types: Sequence[NoteType]) -> DataFrame:
    """One row per fault: (note_id, path, type_id, field, message); notes of no type have none.

    Checks the ending of the path, that there is front matter where the type
    needs it, its required fields and the constraint of every field present.
    Only markdown files are asked for front matter.  JSON booleans count as
    integers too.
    """
    path, front = F.col("path"), F.col("front")
    typed = notes.select(F.col("note_id").cast("string").alias("note_id"), "path", F.from_json(F.coalesce(front, F.lit("{}")), "map<string,string>").alias("_keys"), F.coalesce(front, F.lit("{}")).alias("_front"), type_of(path, types).alias("type_id"))
    found = []
    for t in types:
        own = F.col("type_id") == t.id
        is_md = path.endswith(".md")
        has = F.size("_keys") > 0
        if t.extensions:
            ext = F.regexp_extract(path, r"(\.[^./]+)$", 1)
            found.append(F.when(own & ~ext.isin(list(t.extensions)), F.struct(F.lit(None).cast("string").alias("field"), F.concat(F.lit("ending '"), ext, F.lit("', not one of " + ", ".join(t.extensions))).alias("message"))))
        if t.needs_front:
            found.append(F.when(own & is_md & ~has, F.struct(F.lit(None).cast("string").alias("field"), F.lit("no front matter").alias("message"))))
        for name in t.required:
            found.append(F.when(own & is_md & has & ~F.map_contains_key("_keys", F.lit(name)), F.struct(F.lit(name).alias("field"), F.lit(f"required field '{name}' is missing").alias("message"))))
        for name, rule in t.constraints.items():
            raw = F.to_json(F.variant_get(F.parse_json("_front"), f"$['{name}']", "variant"))
            present = F.map_contains_key("_keys", F.lit(name))
            for m in _field_errors(F.coalesce(raw, F.lit("null")), name, rule):
                found.append(F.when(own & is_md & has & present & m.isNotNull(), F.struct(F.lit(name).alias("field"), m.alias("message"))))
    if not found:
        return notes.sparkSession.createDataFrame([], FINDING)
    return typed.select("note_id", "path", "type_id", F.explode(F.array_compact(F.array(*found))).alias("_f")).select("note_id", "path", "type_id", F.col("_f.field").alias("field"), F.col("_f.message").alias("message"))


def listing(spark: SparkSession, types: Sequence[NoteType]) -> DataFrame:
    """(type_id, description, required, optional, constrained): the registry as a table."""
    rows = [(t.id, t.description, list(t.required), list(t.optional), sorted(t.constraints)) for t in types]
    return spark.createDataFrame(rows, "type_id string, description string, required array<string>, optional array<string>, constrained array<string>")


def rules_in_scope(rules: DataFrame, scope: str, severity: str | None = None) -> DataFrame:
    """The declared rules (scope, severity ...) for a scope: its own, those of ``part:*`` and of lists ``a|b``."""
    one = F.exists(F.split("scope", r"\|"), lambda s: (s == scope) | (s.endswith(":*") & F.lit(scope).startswith(F.substring_index(s, "*", 1))))
    out = rules.where(one)
    return out if severity is None else out.where(F.col("severity") == severity)
