import random
import re
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from vaultweave.llm import queries
from vaultweave.llm.canonical import Matcher, canonical_entries, distance, map_values, unmatched_report, words
from vaultweave.llm.truncation import truncated, truncation_report
from vaultweave.session import table

ENTRIES = [(1, ["elastic-plateau", "humming kiln"]), (2, ["plateau"]), (3, ["quiet-quorum", "mossy gutter"]), (4, ["hidden-nexus"]), (5, ["latched-keystone"]), (6, ["gated-seam"])]
MEANT = {
    "Elastic Plateau": 1, " ELASTIC_plateaus ": 1, "plateau of elastic": 1, "plateau, elastic": 1, "plateau (elastic)": 1, "elasticplateau": 1, "elas. plateau": 1, "elstc plateau": 1, "elsatic plataeu": 1,
    "Ｅｌａｓｔｉｃ－Ｐｌａｔｅａｕ": 1, "éláśtic plateau": 1, "elastiс рlateau": 1, "e1astic p1ateau": 1, "elastic​plateau": 1, "re: elastic plateau v2": 1, "concepts/elastic-plateau.md": 1, "elastic plateau [draft]": 1,
    "Hummng-Kiln": 1, "kiln humming": 1, "see the plateaus*": 2, "pltu": 2, "quietquorm": 3, "GUTTER - mossy": 3, "notes on the hidden nexus": 4, "lat. keystone": 5,
    "quiet nexus": -1, "hidden quorum": -1, "elastic gutter": -1, "payroll hatch 37": -1, "Simara Bolt": -1, "n/a": -1, "": -1, "   ": -1, "?": -1, None: -1, "x" * 5000: -1, "elasticplateau" * 20000: -1, "ab " * 50000: -1, "latched seam": -1,
}


def test_values():
    matcher = Matcher(ENTRIES)
    assert {v: matcher.find(v) for v in MEANT} == MEANT
    assert Matcher([]).find("plateau") == -1


def test_distance():
    rng = random.Random(2)

    def plain(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in range(2))
        assert distance(a, b, 3) == min(plain(a, b), 4)


def test_long_entries():
    """Names of many words, long typed values, near words in numbers, repeated mentions: no limit but the list's own."""
    matcher = Matcher([(1, ["slow gated inner seam ledger"]), (2, ["plateau"]), *[(10 + i, [f"tin{chr(97 + i)} ledger"]) for i in range(20)]], ["re", "of"])
    assert matcher.find("slow gated iner seam ledger") == 1 and matcher.find("Re: ledgers seam inner gated slow") == 1
    assert matcher.find("p l a t e a u") == 2 and matcher.find("tint ledgr") == 10 + ord("t") - 97
    assert matcher.find("slow gated iner seam ledger of something else") == -1
    # A value of many mentions means no single entry, however long it is.
    assert matcher.find("plateau " * 40000) == -1 and matcher.find("slow gated inner seam ledger " * 20000) == -1


def test_map_frame(spark):
    rows = [(v, i, "keep") for i, v in enumerate(MEANT)] * 2
    df = spark.createDataFrame(rows, "v string, field int, `a b` string").withColumn("concept_id", F.lit("clash"))
    got = map_values(df, "v", ENTRIES)
    assert Counter((r.v, r.concept_id) for r in got.collect()) == Counter({(v, c): 2 for v, c in MEANT.items()})
    assert map_values(df.limit(0), "v", ENTRIES).count() == 0 and map_values(df, "v", []).where("concept_id <> -1").count() == 0
    clash = df.select("v", F.lit(1).alias("_typed"), F.lit(2).alias("_means"))
    assert map_values(clash, "v", ENTRIES).where("_typed = 1 and _means = 2").count() == len(rows)
    assert unmatched_report(got.selectExpr("v", "'f' as f", "concept_id"), "v", "f").first().n_unmatched == 2 * sum(c == -1 for c in MEANT.values())


def test_settled_aliases(spark, small):
    """The curators' own decisions are the held-out truth."""
    concepts = table(spark, small, "concepts")
    matcher = Matcher(canonical_entries(concepts, "concept_id", "name", "aliases"))
    number = {r.name: r.concept_id for r in concepts.collect()}
    settled = [r for r in table(spark, small, "vault_aliases").where("canonical is not null").collect() if r.alias and r.alias.strip()]
    right = sum(matcher.find(r.alias) == number[r.canonical] for r in settled)
    assert settled and right >= 0.97 * len(settled)


def test_p1_rows(spark, small):
    got = Counter((r.field, r.row_id, r.pos) for r in queries.p1_found(spark, small).collect())
    want = Counter(("vault_aliases.alias", r.alias_id, 1) for r in table(spark, small, "vault_aliases").where("canonical is null").collect() if r.alias and r.alias.strip())
    for r in table(spark, small, "primitives_and_foundational").collect():
        want.update(("primitives_and_foundational.depends_on", r.row_id, i) for i, v in enumerate(brute.split(r.depends_on), 1) if not brute.is_link(v))
    assert got == want


NOUNS = "shelf mirror bridge hatch wagon kettle lever basket candle ladder gate table".split()
WHOLE = [
    "The {} rarely meets the {} that someone moved last week.", "Nobody planned the {} but everyone learned to copy around the {}.", "Every {} begins as a shortcut of somebody near the {}.",
    "A {} without a {} is not an error, only an open question.",
]
TAILS = ["", "\n\nStatus: open", "\n\nTODO", "\n\n#shelf #draft", "\n\n```\ncode = 1\n```", "\n\n| a | b |\n|---|---|\n| c | d |"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows, cut = [], set()

    def note(n):
        return "# Note\n\n" + " ".join(rng.choice(WHOLE).format(rng.choice(NOUNS), rng.choice(NOUNS)) for _ in range(n))

    for i in range(600):
        text = note(rng.randrange(3, 12))
        if i % 6 == 0:  # the last sentence without its full stop is whole all the same
            text = text[:-1]
        else:
            text += TAILS[i % len(TAILS)]
        rows.append((i, text, "whole"))
    for i in range(600, 700):
        text = note(12)
        at = rng.randrange(60, len(text) - 20)
        while not re.match(r"[a-z]", text[at - 1]) or not re.match(r"[a-z]", text[at]):
            at += 1
        rows.append((i, text[:at], "broken"))
        cut.add(i)
    for i in range(700, 760):
        rows.append((i, note(14)[:400], "limited"))
        cut.add(i)
    long = note(400)
    rows += [(900, long, "whole"), (901, long[: len(long) // 2].rsplit(".", 1)[0] + ".", "whole"), (902, None, None), (903, "", "x"), (904, " \n", "x"), (905, "[[open", "x"), (906, "```\nx", None), (907, long, "whole")]
    return rows, cut | {901, 905, 906}


def test_truncated(spark, corpus):
    rows, cut = corpus
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id int, t string, source string, reason string")
    found = truncated(df, "id", "t", "source").collect()
    assert len(found) == len(rows)
    got = {r.id: r.reason for r in found if r.truncated}
    wrong = set(got) - cut
    missed = cut - set(got)
    assert len(wrong) <= 4 and len(missed) <= 8, (sorted(wrong), sorted(missed))
    assert got[901] == "prefix" and got[905] == "open" and got[906] == "open" and not {902, 903, 904, 900} & set(got)
    # The prefix levels come first and carry most; the limit completes what they leave open.
    limited = Counter(got.get(i) for i in range(700, 760))
    assert limited["word"] + limited["passage"] >= 50 and limited["limit"] >= 1
    assert truncated(df.limit(0), "id", "t", "source").count() == 0


def test_copies_and_closing_lines(spark, corpus):
    rows = list(corpus[0])
    # A cut text in five copies whose last line opens as no other does, and cuts inside a closing line.
    body = next(t for i, t, _ in rows if i == 1)
    rows += [(2000 + i, f"{body.splitlines()[0]}\n\n{NOUNS[0]} note.\n\nQuarrel between the mirr", "copies") for i in range(5)]
    closed = ["\n\nMore to follow", "\n\nStatus: partial"]
    for i in range(60):
        text = rows[i * 6 + 1][1].split("\n\nStatus")[0].split("\n\n|")[0]
        rows.append((3000 + i, f"{text}\n\nA line of number {i}." + closed[i % 2], "closed"))
    rows += [(4000, f"{body}\n\nMore to fol", "cut"), (4001, f"{body}\n\nStatus: par", "cut")]
    df = spark.createDataFrame(rows, "id int, t string, source string")
    got = {r.id: r.reason for r in truncated(df, "id", "t", "source").where("truncated").collect()}
    assert {2000, 2001, 2002, 2003, 2004, 4000, 4001} <= set(got), sorted(i for i in got if i >= 2000)
    assert not [i for i in got if 3000 <= i < 3060]


def test_filled_to_the_limit(spark, corpus):
    """Whole notes that a source fills up to its limit are not cut; cut ones beside them are."""
    rows = [r for r in corpus[0] if r[0] < 600]
    rng = random.Random(5)
    whole = [t for _, t, _ in rows if len(t) > 420]
    for i in range(5000, 5080):
        text = whole[i % len(whole)][:300].rsplit(".", 1)[0] + ". It was kept by the"
        while len(text) < 500:
            text += " " + rng.choice(["early", "late", "dull", "odd", "plain", "local", "foreign", "rigid"])
        rows.append((i, text[:498] + "x." if i % 2 == 0 else text[:500], "filled"))
    found = truncated(spark.createDataFrame(rows, "id int, t string, source string"), "id", "t", "source").where("truncated").collect()
    got = {r.id: r.reason for r in found if r.id >= 5000}
    assert all(len(t) == 500 for i, t, _ in rows if i >= 5000) and not [i for i in got if i % 2 == 0]
    assert len(got) >= 38


def test_long_mentions(spark):
    """Names of any number of words stand in for each other."""
    names = ["amber lathe of the north", "tin", "slow gated seam"]
    body = "Here the {} is held by nobody at all until the week ends."
    rows = [(i, f"# N{i}\n\nA line of its own with number {i}. " + body.format(names[i % 3]), "s") for i in range(30)]
    rows += [(100 + i, f"# M{i}\n\nAnother line {i}. Here the {n} is held by nobody at", "s") for i, n in enumerate(names)]
    got = {r.id for r in truncated(spark.createDataFrame(rows, "id int, t string, source string"), "id", "t", "source", names).where("truncated").collect()}
    assert got == {100, 101, 102}


def test_report(spark, small):
    rows = {r.source: r for r in queries.p8_sources(spark, small).collect()}
    assert sum(r.n_texts for r in rows.values()) == table(spark, small, "documents").count()
    assert rows["csv_export"].n_truncated > 0 and words("a-b.md") == ["a", "b"]
    assert truncation_report(truncated(table(spark, small, "documents").limit(0), "doc_id", "text", "source"), "source").count() == 0
