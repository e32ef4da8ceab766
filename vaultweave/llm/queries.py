"""The llm problem queries (p1, p4, p6, p7, p8) over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultweave.functions.keys import blank_trim, is_wikilink, note_key
from vaultweave.llm.canonical import canonical_entries, map_values, unmatched_report
from vaultweave.llm.bpe import token_counts, token_ids
from vaultweave.llm.cooccurrence import cooccurrences
from vaultweave.llm.packing import faults, fill_report, pack
from vaultweave.llm.truncation import truncated, truncation_report
from vaultweave.operators.packed import split_packed
from vaultweave.plans.problems import field_sql, key_sql, packed_values, values_sql
from vaultweave.session import table, written

#: Where the public vocabularies lie; a parameter of every query that needs one.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
#: Words these vaults put around a concept's name.
FRAME = frozenset("the a an re cf see old of concept concepts core draft v1 v2 v3 md new".split())


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = canonical_entries(table(spark, sf_dir, "concepts"), "concept_id", "name", "aliases")
    typed = table(spark, sf_dir, "vault_aliases").where(F.col("canonical").isNull() & (blank_trim(F.col("alias")) != "")).select(
        F.lit("vault_aliases.alias").alias("field"), F.col("alias_id").alias("row_id"), F.lit(1).alias("pos"), F.col("alias").alias("value")
    )
    values = packed_values(spark, sf_dir, (("primitives_and_foundational", "depends_on"),))
    return map_values(typed.unionByName(values.where(~is_wikilink(F.col("value")))), "value", concepts, frame=FRAME)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("field", "row_id", "pos", "concept_id")


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmatched_report(_mapped(spark, sf_dir), "value", "field")


def paper_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper, concept): the key of each value of ``concepts_linked`` with the key of its paper."""
    papers = table(spark, sf_dir, "papers").select(note_key(F.col("paper")).alias("paper"), "concepts_linked")
    return split_packed(papers, "concepts_linked", ["paper"]).select("paper", note_key(F.col("value")).alias("concept"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrences(paper_concepts(spark, sf_dir), "paper", "concept", min_count=5, min_share=0.004, min_lift=3.0)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(F.col("item_a").alias("concept_a"), F.col("item_b").alias("concept_b"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def p6_ids(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), "doc_id", "text", f"{tokenizers}/{BYTE_BPE}")


def p7_containers(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    sizes = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", f"{tokenizers}/{BYTE_BPE}")
    return pack(sizes, table(spark, sf_dir, "context_budgets"), "doc_id", "tokens")


def p7_fill(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return fill_report(p7_containers(spark, sf_dir, tokenizers), table(spark, sf_dir, "context_budgets"), "tokens")


def p7_faults(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """What must not happen in any container: see :func:`vaultweave.llm.packing.faults`."""
    sizes = written(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", f"{tokenizers}/{BYTE_BPE}"), "sizes")
    budgets = table(spark, sf_dir, "context_budgets")
    return faults(pack(sizes, budgets, "doc_id", "tokens"), sizes, budgets, "doc_id", "tokens")


def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = canonical_entries(table(spark, sf_dir, "concepts"), "concept_id", "name", "aliases")
    return truncated(table(spark, sf_dir, "documents"), "doc_id", "text", "source", [names[0] for _, names in concepts if names])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir).where("truncated").select("doc_id")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_report(_truncated(spark, sf_dir), "source")


QUERIES = {
    "p1_found": p1_found,
    "p1_unmatched": p1_unmatched,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p7_faults": p7_faults,
    "p8_found": p8_found,
    "p8_sources": p8_sources,
}

_PAIRS = f"""WITH {values_sql(field_sql('papers.concepts_linked'))}, b AS (SELECT DISTINCT {key_sql('p.paper')} AS paper, {key_sql('v.value')} AS concept FROM vals v JOIN papers p ON p.row_id = v.row_id WHERE p.paper IS NOT NULL),
  t AS (SELECT count(DISTINCT paper) AS n FROM b), c AS (SELECT concept, count(*) AS k FROM b GROUP BY 1),
  q AS (SELECT x.concept AS item_a, y.concept AS item_b, count(*) AS n_ab FROM b x JOIN b y ON x.paper = y.paper AND x.concept < y.concept GROUP BY 1, 2),
  pairs AS (SELECT item_a, item_b, n_ab, a.k AS n_a, d.k AS n_b, t.n, CAST(n_ab * t.n AS DOUBLE) / (CAST(a.k AS DOUBLE) * d.k) AS lift FROM q JOIN c a ON a.concept = item_a JOIN c d ON d.concept = item_b, t
    WHERE n_ab >= greatest(5, 0.004 * t.n) AND n_ab * t.n >= 3 * a.k * d.k)"""
ORACLES: dict[str, str] = {
    "p4_found": f"{_PAIRS} SELECT item_a AS concept_a, item_b AS concept_b FROM pairs",
    "p4_pairs": f"{_PAIRS} SELECT * FROM pairs",
    "p7_faults": "SELECT budget, capacity, (SELECT count(*) FROM documents) AS items, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS split, false AS loose FROM context_budgets",
}
