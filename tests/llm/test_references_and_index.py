"""Quality references that other languages cannot remove, in one group or several; digest indexes that outlive cleaning."""

import random

import pytest
from pyspark.sql import functions as F

from signalloom.llm import exact_dedup, quality_rules
from signalloom.sources.shared import clear_shared

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance", "nearest"]


def prose(rng, syllables, n):
    common = ["".join(s) for s in zip(syllables, syllables[1:], strict=False)]
    return " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(n))


ENGLISH, GERMAN = ["the", "of", "an", "ing", "her", "was", "ed", "it"], ["der", "üb", "sch", "ung", "ß", "ein", "ge", "zu", "Äp"]


def corpus(spark, repeats):
    rng = random.Random(4)
    rows = [(i, prose(rng, ENGLISH, rng.randint(60, 120)), "en") for i in range(120)]
    german = [(1000 + i, prose(rng, GERMAN, rng.randint(60, 200)), "de") for i in range(30)]
    junk = [(2000 + i, " ".join(rng.choice(["#$%|", "<<>>", "zq9"]) + str(rng.randrange(9)) for _ in range(90)), "en") for i in range(5)]
    english = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).drop("n")
    return english.unionByName(spark.createDataFrame([*german, (3000, None, None), (3001, "", "xx"), (3002, "few words", "xx")], english.schema))


def test_more_rows_of_a_language_change_no_verdict_of_another(spark):
    verdict = lambda repeats: {tuple(r) for r in quality_rules.judge(corpus(spark, repeats)).filter("doc_id between 1000 and 1999").select("doc_id", "kept", "nearest").collect()}
    one = verdict(1)
    assert len(one) == 30 and all(kept and nearest == "de" for _, kept, nearest in one)
    assert verdict(130) == one


def test_references_in_groups_give_the_same_verdicts(spark):
    docs = corpus(spark, 2).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") < 1000, F.concat("lang", (F.col("doc_id") % 4).cast("string"))).otherwise(F.col("lang")))
    rows = lambda df: sorted(map(str, df.select(*COLUMNS).collect()))
    whole = rows(quality_rules.judge(docs))
    assert len({r.nearest for r in quality_rules.judge(docs).collect()}) > 2
    for limit in (100_000, 20_000, 256):
        assert rows(quality_rules.judge(docs, reference_bytes=limit)) == whole
    assert quality_rules.judge(docs.limit(0), reference_bytes=1).count() == 0


def test_a_named_index_outlives_cleaning_and_an_unnamed_one_goes(spark, tmp_path):
    docs = corpus(spark, 1)
    with pytest.raises(ValueError, match="location"):
        exact_dedup.DigestIndex(spark, "lasting_index")
    index = exact_dedup.DigestIndex(spark, "lasting_index", f"file://{tmp_path}/index", buckets=3)
    exact_dedup.deduplicate(docs.filter("doc_id < 60"), index).collect()
    scratch = exact_dedup.DigestIndex(spark)
    held = index.rows().count()
    assert held == 60 and spark.catalog.tableExists(scratch.name)
    clear_shared(spark)
    assert not spark.catalog.tableExists(scratch.name)
    again = exact_dedup.DigestIndex(spark, "lasting_index", f"file://{tmp_path}/index", buckets=3)
    assert again.rows().count() == held
    later = exact_dedup.deduplicate(docs.filter("doc_id < 80"), again).collect()
    assert sum(r.kept for r in later) == 80 and again.rows().count() == 80
    assert not exact_dedup.deduplicate(docs.filter("doc_id < 80").withColumn("doc_id", F.col("doc_id") + 500), again).filter("kept").count()
    spark.sql("DROP TABLE lasting_index")
