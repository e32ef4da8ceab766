"""Audits of concept notes: what their definitions say, mention and leave out, and how far mentions and dependencies agree."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultweave.functions import markdown as md
from vaultweave.functions import signals as sg
from vaultweave.functions.site import _or_null

#: Words a mention of a name may be long; names of more words are looked for word by word all the same.
_EDGE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def variants(names: DataFrame) -> DataFrame:
    """(node, variant): how each name (node, title, aliases) may be written: its words in lower case, joined by single blanks.

    A variant of one word shorter than three letters is none.
    """
    forms = F.array_compact(F.concat(F.array("node", "title"), F.coalesce("aliases", F.array().cast("array<string>"))))
    words = F.transform(forms, lambda f: F.array_join(F.array_remove(F.split(F.lower(F.trim(f)), r"[-\s]+"), ""), " "))
    return names.select("node", F.explode(F.array_distinct(words)).alias("variant")).where((F.length("variant") >= 3) & (F.col("variant") != "")).distinct()


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, n): how often each text (src, text) mentions each other name: its commonest variant counts.

    Words of a text and of a variant are compared, so no text meets every name:
    runs of as many words as the variants have are joined with them.  Words are
    runs of letters, digits and ``_``; between those of one name stand blanks and
    hyphens only.
    """
    forms = variants(names).withColumn("size", F.size(F.split("variant", " ")))
    # One row with the sizes there are, at most a handful.
    sizes = F.broadcast(forms.agg(F.array_sort(F.collect_set("size")).alias("_sizes")))
    # Stretches hold blanks and hyphens only between their words.
    stretches = texts.where("text is not null").select("src", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+(?:[-\s]+[\p{L}\p{N}_]+)*"), F.lit(0))).alias("s"))
    words = stretches.select("src", F.split("s", r"[-\s]+").alias("w")).join(sizes)
    runs = words.select("src", F.explode("_sizes").alias("size"), "w").where("size <= size(w)")
    pieces = runs.select("src", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.array_join(F.slice("w", i, F.col("size")), " "))).alias("variant"))
    counted = pieces.groupBy("src", "variant").agg(F.count(F.lit(1)).alias("n")).join(forms.select(F.col("node").alias("dst"), "variant"), "variant")
    return counted.where("src <> dst").groupBy("src", "dst").agg(F.max("n").alias("n"))


def unlinked_mentions(found: DataFrame, links: DataFrame, depends: DataFrame) -> DataFrame:
    """(src, dst, n, has_depends): mentions without a link, and whether there is a dependency."""
    free = found.join(links.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    flag = depends.select("src", "dst").distinct().withColumn("_has", F.lit(True))
    return free.join(flag, ["src", "dst"], "left").select("src", "dst", "n", F.coalesce("_has", F.lit(False)).alias("has_depends"))


def disagreements(links: DataFrame, depends: DataFrame) -> DataFrame:
    """(src, dst, kind): ``link`` without a dependency, ``depends`` without a link."""
    a, b = links.select("src", "dst").distinct(), depends.select("src", "dst").distinct()
    return a.join(b, ["src", "dst"], "left_anti").withColumn("kind", F.lit("link")).unionByName(b.join(a, ["src", "dst"], "left_anti").withColumn("kind", F.lit("depends")))


def implicit_dependencies(notes: DataFrame, names: DataFrame) -> DataFrame:
    """(node, implied): names found as plain text in the definition of a note (node, content, deps) that it neither links there nor declares.

    A name counts in any of its spellings (as it is, with blanks, with hyphens)
    of more than three letters, even inside a longer word.  The names (node)
    become part of the plan, so they must be a list of at most 5,000.
    """
    listed = [r[0] for r in names.select("node").where("node is not null").distinct().limit(5001).collect()]
    if len(listed) > 5000:
        raise ValueError("more than 5000 names are no list")
    text = md.section_loose(F.col("content"), "## Definition")
    spelt = {v: n for n in sorted(listed) for v in (n.lower(), n.lower().replace("-", " "), n.lower().replace(" ", "-")) if len(v) > 3}
    low = F.lower(text)
    # One constant array, so the plan does not grow with the list.
    pairs = F.from_json(F.lit(json.dumps([{"v": v, "n": n} for v, n in spelt.items()])), "array<struct<v:string,n:string>>")
    # Bound once: inside a lambda the section would be cut anew for every name.
    hits = F.element_at(F.transform(F.array(low), lambda t: F.transform(F.filter(pairs, lambda p: t.contains(p["v"])), lambda p: p["n"])), 1)
    flat = lambda c: F.transform(c, lambda x: F.replace(F.lower(x), F.lit(" "), F.lit("-")))
    linked = F.regexp_extract_all(low, F.lit(r"\[\[([^\]|]+)"), F.lit(1))
    known = F.array_union(F.array_union(flat(F.coalesce("deps", F.array().cast("array<string>"))), linked), F.array(F.replace(F.lower("node"), F.lit(" "), F.lit("-"))))
    free = F.filter(F.array_distinct(hits.cast("array<string>")), lambda n: ~F.array_contains(known, F.replace(F.lower(n), F.lit(" "), F.lit("-"))))
    return notes.select("node", F.explode(free).alias("implied"))


def implicit_clusters(implied: DataFrame) -> DataFrame:
    """(implied, nodes, names): dependencies left out by the notes that leave them out, most first."""
    return implied.groupBy("implied").agg(F.count_distinct("node").alias("nodes"), F.array_sort(F.collect_set("node")).alias("names"))


def definitions(notes: DataFrame) -> DataFrame:
    """One row per note (node, content) with the signals of its definition: verbs, negations, phrases, scope and how prescriptive it is."""
    text = md.section_loose(F.col("content"), "## Definition")
    sentences, nots, ratio = sg.scope_metrics(F.col("content"))
    told = F.size(sg.prescriptive_sentences(text))
    return notes.select(
        "node", *[sg.count_words(text, v).alias(f"{k}_verbs") for k, v in sg.VERBS.items()], sg.negations(text).alias("negations"),
        sg.count_phrases(text, sg.OPERATIONAL, bounded=False).alias("operational"), sg.count_phrases(text, sg.COST).alias("cost"), sg.spatial(text).alias("spatial"), told.alias("prescriptive"),
        F.when(told > 2, "prescriptive").when(told > 0, "mixed").otherwise("descriptive").alias("assessment"), sentences.alias("sentences"), nots.alias("nots"), ratio.cast("double").alias("ratio"),
    )


def definition_summary(found: DataFrame, implied: DataFrame) -> DataFrame:
    """One row: how many notes deny much, frame operationally, imply dependencies, prescribe, define at length or by boundary."""
    some = implied.agg(F.count_distinct("node").alias("implicit"))
    return found.agg(
        F.count(F.lit(1)).alias("notes"), F.count_if(F.col("negations") >= 5).alias("negating"), F.count_if(F.col("operational") > 0).alias("operational"),
        F.count_if(F.col("assessment") != "descriptive").alias("prescriptive"), F.count_if(F.col("ratio") > 0.7).alias("defining"), F.count_if(F.col("ratio") < 0.3).alias("bounding"),
    ).join(F.broadcast(some))


def concept_audit(notes: DataFrame, depends: DataFrame) -> DataFrame:
    """Per concept (node, layer, content): which sections it has, its degrees, its dependencies that stand in the dependency section only."""
    text = F.col("content")
    has = lambda h: md.section_strict(text, h).isNotNull()
    section = md.section_strict(text, "Structural dependencies")
    elsewhere = F.when(section.isNull(), text).otherwise(F.replace(text, section, F.lit("")))
    only = F.array_except(md.links(F.coalesce(section, F.lit(""))), md.links(F.coalesce(elsewhere, F.lit(""))))
    d = depends.select("src", "dst").distinct()
    out = d.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = d.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    flags = notes.select("node", "layer", has("Definition").alias("has_definition"), has("Structural dependencies").alias("has_dependencies"), has("What this is NOT").alias("has_boundary"), F.coalesce(F.size(only), F.lit(0)).alias("only_declared"))
    return flags.join(out, "node", "left").join(into, "node", "left").na.fill(0, ["out_degree", "in_degree"]).na.fill(False, ["has_definition", "has_dependencies", "has_boundary"])


def short_role(text: Column, name: Column) -> Column:
    """A short description: the front matter's, else the first paragraph of the definition or summary, else the first of the body, else the name; 140 characters at most."""
    block = md.front_matter(text)
    stated = F.coalesce(*[md.front_matter_field(block, k) for k in ("description", "summary", "blurb")])
    body = F.regexp_replace(text, r"(?s)^---\r?\n.*?\r?\n---[ \t]*(\r?\n|$)", "")
    paragraph = lambda t: F.element_at(F.filter(F.transform(F.split(t, r"\r?\n[ \t]*\r?\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: (p != "") & ~p.startswith("#") & ~p.startswith("|") & ~p.startswith("```")), 1)
    first = lambda t: F.when(F.size(F.filter(F.transform(F.split(t, r"\r?\n[ \t]*\r?\n"), lambda p: F.trim(p)), lambda p: (p != "") & ~p.startswith("#") & ~p.startswith("|") & ~p.startswith("```"))) > 0, paragraph(t))
    said = F.coalesce(stated, first(md.section_strict(body, "Definition")), first(md.section_strict(body, "Summary")), first(body), name)
    return F.when(F.length(said) > 140, F.concat(F.substr(said, F.lit(1), F.lit(137)), F.lit("…"))).otherwise(said)


def coverage(found: DataFrame, flags: list[str]) -> DataFrame:
    """(concept, covered, lacking, complete): of each yes/no column how many rows have it."""
    stacked = found.select(F.explode(F.array(*[F.struct(F.lit(f).alias("concept"), (F.col(f) == "yes").alias("has")) for f in flags])).alias("x")).select("x.*")
    return stacked.groupBy("concept").agg(F.count_if("has").alias("covered"), F.count_if(~F.col("has")).alias("lacking"), F.bool_and("has").alias("complete"))


def around(lines: DataFrame, flag: Column, before: int = 5, after: int = 5) -> DataFrame:
    """The lines (doc, line ...) within so many lines of one that is flagged."""
    span = Window.partitionBy("doc").orderBy("line").rowsBetween(-after, before)
    return lines.withColumn("_hit", F.max(flag.cast("int")).over(span)).where("_hit = 1").drop("_hit")


def ghost_id(term: Column) -> Column:
    """The id of a term that no note defines."""
    slug = F.btrim(F.regexp_replace(F.lower(F.trim(term)), "[^0-9a-zA-Z]+", "-"), F.lit("-"))
    return F.concat(F.lit("ghost/"), F.coalesce(_or_null(F.substr(slug, F.lit(1), F.lit(64))), F.lit("term")))
