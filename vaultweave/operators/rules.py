"""Rules as data: a rule names a selector and a predicate and compiles to a plan.

Notes are rows of (note_id, name, kind, role, layer, canonical, content, links,
deps, aliases); every predicate gives rows of (level, rule, file, message, line,
invariant).  A ruleset is the union of its rules' plans, so one job runs them all.
"""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultweave.functions.markdown import headings
from vaultweave.functions.signals import layer_rank

RESULT = "level string, rule string, file string, message string, line int, invariant string"
# The invariant each rule enforces; rules not named are structural.
INVARIANT_OF = {
    "kind-violation": "decomposition", "layer-violation": "decomposition", "forbidden-edge": "governance", "missing-role": "governance",
    "responsibility-scope": "attribution", "missing-dependencies": "irreversibility", "mechanism-missing-residuals": "irreversibility", "hub-required-headings": "irreversibility",
}
# Phrases that assign responsibility.
RESPONSIBILITY = ("responsible for", "responsibility for", "who is responsible", "is responsible")
OBJECT_LAYERS, OPERATOR_LAYERS = ("primitive", "foundational", "first-order"), ("selector",)


@dataclass(frozen=True)
class Rule:
    """One rule: which notes it looks at, by which predicate, and how it speaks."""

    id: str
    predicate: str
    params: dict[str, Any] = field(default_factory=dict)
    severity: str = "error"
    invariant: str | None = None
    scope: str = "concept"
    selector: dict[str, Any] = field(default_factory=dict)
    message: str | None = None
    rationale: str | None = None
    boundary: str | None = None


@dataclass(frozen=True)
class Ruleset:
    id: str
    version: int
    rules: tuple[Rule, ...]


def load_ruleset(text: str) -> Ruleset:
    """A ruleset from TOML; id and a positive version are required, severity and scope have defaults."""
    raw = tomllib.loads(text)
    if not raw.get("ruleset_id") or not isinstance(raw.get("version"), int) or raw["version"] < 1:
        raise ValueError("a ruleset needs ruleset_id and a positive version")
    base = raw.get("defaults", {})
    rules = []
    for r in raw.get("rules", []):
        if not r.get("id") or not r.get("predicate", {}).get("name"):
            raise ValueError("a rule needs an id and a predicate")
        rules.append(
            Rule(
                id=r["id"], predicate=r["predicate"]["name"], params=r["predicate"].get("params", {}), severity=r.get("severity", base.get("severity", "error")),
                invariant=r.get("invariant"), scope=r.get("scope", base.get("scope", "vault")), selector=r.get("selector", {}).get("params", {}),
                message=r.get("message"), rationale=r.get("rationale"), boundary=r.get("boundary"),
            )
        )
    return Ruleset(raw["ruleset_id"], raw["version"], tuple(rules))


class Vault:
    """The frames rules read: notes, and what links and aliases resolve to."""

    def __init__(self, notes: DataFrame, names: DataFrame | None = None, aliases: DataFrame | None = None, assets: DataFrame | None = None):
        self.notes = notes
        self.links = notes.select("note_id", "kind", F.explode("links").alias("link"))
        self.deps = notes.where("kind = 'concept'").select("note_id", "name", "layer", F.explode("deps").alias("dep"))
        self.names = names if names is not None else notes.select(F.lower("name").alias("name"), "kind", "role", "layer")
        self.aliases = aliases if aliases is not None else notes.select(F.explode("aliases").alias("alias"), F.lower("name").alias("canonical")).select(F.lower("alias").alias("alias"), "canonical")
        self.assets = assets

    def concepts(self, selector: dict[str, Any]) -> DataFrame:
        """The concepts a selector leaves."""
        out = self.notes.where("kind = 'concept'")
        if selector.get("canonical_only"):
            out = out.where("canonical")
        roles = [r.lower().strip() for r in selector.get("exclude_roles", [])]
        return out.where(~F.coalesce(F.lower(F.trim("role")), F.lit("")).isin(roles)) if roles else out


def _results(frame: DataFrame, rule: Rule, message: Column, level: str | None = None, line: Column | None = None) -> DataFrame:
    return frame.select(
        F.lit(level or rule.severity).alias("level"), F.lit(rule.id).alias("rule"), F.col("note_id").cast("string").alias("file"), message.alias("message"),
        (F.lit(None).cast("int") if line is None else line).alias("line"), F.lit(rule.invariant).cast("string").alias("invariant"),
    )


def _say(rule: Rule, otherwise: str) -> Column:
    return F.lit(rule.message or otherwise)


# -- predicates over notes -------------------------------------------------------


def field_missing(v: Vault, r: Rule) -> DataFrame:
    """Notes of any kind without the ``field`` given (null or blank)."""
    name = r.params["field"]
    return _results(v.notes.where(F.coalesce(F.trim(F.col(name)), F.lit("")) == ""), r, _say(r, f"no {name}"))


def has_keys(v: Vault, r: Rule) -> DataFrame:
    """Selected concepts that lack any of ``keys``."""
    keys = r.params.get("keys", [])
    lacking = F.array_compact(F.array(*[F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) == "", F.lit(k)) for k in keys])) if keys else F.array()
    rows = v.concepts(r.selector).withColumn("_lacking", lacking.cast("array<string>")).where(F.size("_lacking") > 0)
    return _results(rows, r, F.concat(_say(r, "missing keys"), F.lit(": "), F.array_join("_lacking", ", ")))


def has_headings(v: Vault, r: Rule) -> DataFrame:
    """Selected concepts that lack any of ``headings``."""
    wanted = F.array(*map(F.lit, r.params.get("headings", []))).cast("array<string>")
    present = F.transform(headings(F.col("content")), lambda h: F.trim(h))
    rows = v.concepts(r.selector).withColumn("_lacking", F.array_except(wanted, present)).where(F.size("_lacking") > 0)
    return _results(rows, r, F.concat(_say(r, "missing headings"), F.lit(": "), F.array_join("_lacking", ", ")))


def text_missing(v: Vault, r: Rule) -> DataFrame:
    """Concepts (of a ``layer``, if given) whose content does not contain ``text``."""
    rows = v.concepts(r.selector)
    if r.params.get("layer"):
        rows = rows.where(F.lower("layer") == r.params["layer"])
    return _results(rows.where(~F.coalesce(F.col("content"), F.lit("")).contains(r.params["text"])), r, _say(r, f"no section {r.params['text']}"))


def prescriptive_tokens(v: Vault, r: Rule) -> DataFrame:
    """Selected concepts whose content holds any of ``tokens``, whatever its case."""
    low = F.lower(F.coalesce("content", F.lit("")))
    hits = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(t.lower()), F.lit(t)) for t in r.params.get("tokens", [])]))))
    rows = v.concepts(r.selector).withColumn("_hits", hits.cast("array<string>")).where(F.size("_hits") > 0)
    return _results(rows, r, F.concat(_say(r, "prescriptive tokens"), F.lit(": "), F.array_join("_hits", ", ")))


def unscoped_responsibility(v: Vault, r: Rule) -> DataFrame:
    """Diagnostics and projections that assign responsibility but declare no scope."""
    low = F.lower(F.coalesce("content", F.lit("")))
    said = low.rlike("|".join(r.params.get("phrases", RESPONSIBILITY)))
    return _results(v.notes.where(F.col("kind").isin("diagnostic", "projection") & said & ~low.contains("scope:")), r, _say(r, "responsibility without scope"))


# -- predicates over links ---------------------------------------------------------


def outlinks_to_roles(v: Vault, r: Rule) -> DataFrame:
    """Concepts that link to notes of any of ``roles``, one row each with the targets."""
    roles = [x.lower().strip() for x in r.params.get("roles", [])]
    targets = v.names.where(F.lower(F.trim("role")).isin(roles)).select(F.col("name").alias("link")).distinct()
    rows = v.concepts(r.selector).select("note_id", F.explode("links").alias("link")).join(targets, "link")
    found = rows.groupBy("note_id").agg(F.array_join(F.array_sort(F.collect_set("link")), ", ").alias("_links"))
    return _results(found, r, F.concat(_say(r, "links to roles kept apart"), F.lit(" ("), F.col("_links"), F.lit(")")))


def forbidden_edge(v: Vault, r: Rule) -> DataFrame:
    """Links from a note of kind ``source`` to one of kind ``target``."""
    targets = v.names.where(F.col("kind") == r.params.get("target", "paper")).select(F.col("name").alias("link")).distinct()
    rows = v.links.where(F.col("kind") == r.params.get("source", "concept")).join(targets, "link")
    return _results(rows, r, F.concat(_say(r, "links to"), F.lit(" "), F.col("link")))


def broken_link(v: Vault, r: Rule) -> DataFrame:
    """Links that name no note, no alias and no asset."""
    known = v.names.select(F.col("name").alias("link")).unionByName(v.aliases.select(F.col("alias").alias("link")))
    if v.assets is not None:
        known = known.unionByName(v.assets.select(F.lower("path").alias("link")))
    return _results(v.links.join(known.distinct(), "link", "left_anti"), r, F.concat(_say(r, "broken link to"), F.lit(" "), F.col("link")))


def alias_drift(v: Vault, r: Rule) -> DataFrame:
    """Links that use an alias instead of the name."""
    rows = v.links.join(v.aliases.select(F.col("alias").alias("link"), "canonical").distinct(), "link").where("link <> canonical")
    return _results(rows, r, F.concat(_say(r, "uses alias"), F.lit(" "), F.col("link"), F.lit(" for "), F.col("canonical")))


def _edges(v: Vault) -> DataFrame:
    to = v.names.select(F.col("name").alias("dep"), F.col("layer").alias("dep_layer")).groupBy("dep").agg(F.min("dep_layer").alias("dep_layer"))
    return v.deps.join(to, "dep")


def layer_violation(v: Vault, r: Rule) -> DataFrame:
    """Dependencies on a higher layer."""
    rows = _edges(v).where(layer_rank(F.col("dep_layer")) > layer_rank(F.col("layer")))
    return _results(rows, r, F.concat(_say(r, "depends on higher layer"), F.lit(" "), F.col("dep")))


def kind_violation(v: Vault, r: Rule) -> DataFrame:
    """Objects that depend on operators."""
    rows = _edges(v).where(F.lower("layer").isin(*OBJECT_LAYERS) & F.lower("dep_layer").isin(*OPERATOR_LAYERS))
    return _results(rows, r, F.concat(_say(r, "object depends on operator"), F.lit(" "), F.col("dep")))


def no_cycles(v: Vault, r: Rule) -> DataFrame:
    """One row for each strongly connected group of concepts, at its first member."""
    from vaultweave.operators.graph import strong_components

    found = strong_components(v.deps.select(F.lower("name").alias("src"), F.col("dep").alias("dst")))
    groups = found.groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("node")), " -> ").alias("_cycle")).withColumnRenamed("component", "note_id")
    return _results(groups, r, F.concat(_say(r, "dependency cycle"), F.lit(" ("), F.col("_cycle"), F.lit(")")))


PREDICATES: dict[str, Callable[[Vault, Rule], DataFrame]] = {
    f.__name__: f
    for f in (
        field_missing, has_keys, has_headings, text_missing, prescriptive_tokens, unscoped_responsibility, outlinks_to_roles,
        forbidden_edge, broken_link, alias_drift, layer_violation, kind_violation, no_cycles,
    )
}

#: The built-in checks as rules.
BUILT_IN = tuple(
    Rule(id=i, predicate=p, params=q, severity=s, invariant=INVARIANT_OF.get(i))
    for i, p, q, s in (
        ("forbidden-edge", "forbidden_edge", {"source": "concept", "target": "paper"}, "warning"),
        ("missing-dependencies", "text_missing", {"text": "## Structural dependencies"}, "error"),
        ("mechanism-missing-residuals", "text_missing", {"text": "## Residuals", "layer": "mechanism"}, "error"),
        ("alias-drift", "alias_drift", {}, "info"),
        ("dependency-cycle", "no_cycles", {}, "error"),
        ("missing-role", "field_missing", {"field": "role"}, "warning"),
        ("broken-link", "broken_link", {}, "warning"),
        ("layer-violation", "layer_violation", {}, "error"),
        ("kind-violation", "kind_violation", {}, "error"),
        ("responsibility-scope", "unscoped_responsibility", {}, "info"),
    )
)


def run(vault: Vault, rules: Sequence[Rule], only_invariant: str | None = None) -> DataFrame:
    """Results of all rules; rules of other invariants are left out before anything runs.

    A rule whose predicate is unknown gives one row of level ``error``.
    """
    spark = vault.notes.sparkSession
    plans = []
    for r in rules:
        if only_invariant is not None and r.invariant != only_invariant:
            continue
        if r.predicate in PREDICATES:
            plans.append(PREDICATES[r.predicate](vault, r))
        else:
            plans.append(spark.createDataFrame([("error", r.id, "vault", f"unknown predicate {r.predicate!r}", None, r.invariant)], RESULT))
    return reduce(DataFrame.unionByName, plans) if plans else spark.createDataFrame([], RESULT)


def ruleset_language(spark: SparkSession, ruleset: Ruleset) -> DataFrame:
    """Rules whose own texts are prescriptive."""
    rows = [(r.id, " ".join(filter(None, (r.message, r.rationale, r.boundary)))) for r in ruleset.rules]
    frame = spark.createDataFrame(rows, "rule string, text string")
    return frame.where(F.col("text").rlike(r"(?i)\b(must|should|fix:|todo:)")).select("rule")


def counts(results: DataFrame) -> DataFrame:
    """(rule, error, warning, info): results by rule and level."""
    return results.groupBy("rule").pivot("level", ["error", "warning", "info"]).agg(F.count(F.lit(1))).na.fill(0)


def by_invariant(results: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(invariant, rules, violations, files, status) of every invariant of the ruleset, those without violation included."""
    spark = results.sparkSession
    listed = spark.createDataFrame([(r.invariant or "structural", r.id) for r in rules], "invariant string, rule string")
    found = results.groupBy(F.coalesce("invariant", F.lit("structural")).alias("invariant")).agg(F.count(F.lit(1)).alias("violations"), F.count_distinct("file").alias("files"))
    all_ = listed.groupBy("invariant").agg(F.count_distinct("rule").alias("rules")).join(found, "invariant", "left").na.fill(0)
    return all_.withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("fail"))


def per_file(results: DataFrame) -> DataFrame:
    """(file, n, worst, rules): results of each file together."""
    rank = F.when(F.col("level") == "error", 0).when(F.col("level") == "warning", 1).otherwise(2)
    worst = F.element_at(F.array(F.lit("error"), F.lit("warning"), F.lit("info")), F.min(rank) + 1)
    return results.groupBy("file").agg(F.count(F.lit(1)).alias("n"), worst.alias("worst"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))


def lacking_headings(notes: DataFrame, policy: DataFrame, level: str = "error") -> DataFrame:
    """Hubs (name, content) that lack a heading their policy (name, headings) asks for, one row each; headings count wherever they stand."""
    asked = notes.withColumn("_name", F.lower("name")).join(policy.select(F.col("name").alias("_name"), "headings"), "_name")
    lack = F.filter("headings", lambda h: ~F.coalesce(F.col("content"), F.lit("")).contains(h))
    found = asked.withColumn("_lacking", lack).where(F.size("_lacking") > 0)
    return _results(found, Rule("hub-required-headings", "policy", severity=level, invariant=INVARIANT_OF["hub-required-headings"]), F.concat(F.lit("hub lacks: "), F.array_join("_lacking", ", ")))


def ordered(results: DataFrame) -> DataFrame:
    """Results as a report lists them: errors first, then by file and rule."""
    rank = F.when(F.col("level") == "error", 0).when(F.col("level") == "warning", 1).otherwise(2)
    return results.orderBy(rank, "file", "rule", "message")


def by_file(results: DataFrame) -> DataFrame:
    """(file, findings): all results of each file together, worst first."""
    rank = F.when(F.col("level") == "error", 0).when(F.col("level") == "warning", 1).otherwise(2)
    return results.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "rule", "level", "message", "line"))).alias("findings"))


def status(results: DataFrame, strict: bool = False) -> tuple[str, int]:
    """The line a report ends with and the exit code: 1 for errors, in strict mode for warnings too."""
    row = results.agg(F.count_if(F.col("level") == "error").alias("e"), F.count_if(F.col("level") == "warning").alias("w"), F.count_if(F.col("level") == "info").alias("i")).first()
    code = 1 if row.e or (strict and row.w) else 0
    return f"{'fail' if code else 'pass'}: {row.e} errors, {row.w} warnings, {row.i} notes", code


def spans(notes: DataFrame, names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(note_id, line, start, stop, link): where the broken links of each note stand, lines and columns from 0; a path before a name is looked through."""
    known = names.select(F.lower("name").alias("_key"))
    known = (known if aliases is None else known.unionByName(aliases.select(F.lower("alias").alias("_key")))).distinct()
    lines = notes.where(F.col("content").contains("[[")).select("note_id", F.posexplode(F.split("content", "\n")).alias("line", "_t")).where(F.col("_t").contains("[["))
    # Pieces between links carry the column along.
    pieces = F.regexp_extract_all("_t", F.lit(r"\[\[[^\]]*\]\]|(?:(?!\[\[[^\]]*\]\]).)+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,raw:string>>").alias("found"))
    step = lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.when(p.startswith("[["), F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(p)).alias("stop"), p.alias("raw"))))).otherwise(acc["found"]).alias("found"))
    each = lines.select("note_id", "line", F.explode(F.aggregate(pieces, start, step, lambda acc: acc["found"])).alias("x"))
    target = F.trim(F.regexp_extract("x.raw", r"\[\[([^\]|#]+)", 1))
    named = each.select("note_id", "line", "x.start", "x.stop", target.alias("link"), F.lower(F.regexp_replace(F.substring_index(target, "/", -1), r"\.md$", "")).alias("_key")).where("link <> ''")
    return named.join(known, "_key", "left_anti").select("note_id", "line", "start", "stop", "link")


def cycle_paths(v: Vault, r: Rule) -> DataFrame:
    """Dependency cycles, each as the path it takes from its smallest note back to it."""
    from vaultweave.operators.graph import simple_cycles

    found = simple_cycles(v.deps.select(F.lower("name").alias("src"), F.col("dep").alias("dst")), r.params.get("most", 8))
    path = F.concat("cycle", F.slice("cycle", 1, 1))
    return _results(found.where(F.size("cycle") > 1).withColumn("note_id", F.element_at("cycle", 1)), r, F.concat(_say(r, "dependency cycle"), F.lit(": "), F.array_join(path, " -> ")))


PREDICATES["cycle_paths"] = cycle_paths


def explain(rule_id: str) -> str:
    """What a built-in rule looks for."""
    for r in BUILT_IN:
        if r.id == rule_id:
            what = (PREDICATES[r.predicate].__doc__ or "").strip().splitlines()[0]
            with_ = ", ".join(f"{k} = {v}" for k, v in r.params.items())
            return f"{r.id} ({r.severity}, {r.invariant or 'structural'}): {what}" + (f" Here {with_}." if with_ else "")
    raise LookupError(f"no rule {rule_id!r}; there are {', '.join(r.id for r in BUILT_IN)}")


def without_failure_modes(projections: DataFrame) -> DataFrame:
    """Projections whose failure modes are null or none."""
    return projections.where(F.col("failure_modes").isNull() | (F.size("failure_modes") == 0))
