"""Sentiment lexicons as relations (word, score): loaders, duplicate folding and merging by precedence."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The domain words and their scores.
DOMAIN_VOCAB = {
    "残業": -0.8, "長時間労働": -0.9, "サービス残業": -1.0, "フレックス": 0.6, "有休": 0.5, "休暇": 0.4, "激務": -0.9, "裁量": 0.5, "テレワーク": 0.5, "在宅": 0.4, "ワークライフ": 0.5, "定時": 0.4,
    "スキルアップ": 0.7, "成長": 0.6, "停滞": -0.6, "頭打ち": -0.7, "スキル": 0.4, "研修": 0.4, "昇進": 0.6, "昇格": 0.6, "育成": 0.5, "キャリアパス": 0.5, "天井": -0.5,
    "限界": -0.8, "燃え尽き": -0.9, "ハラスメント": -1.0, "パワハラ": -1.0, "セクハラ": -1.0, "体調": -0.5, "ブラック": -1.0, "転職": -0.3,
    "風通し": 0.6, "閉鎖的": -0.7, "縦社会": -0.5, "派閥": -0.6, "古い": -0.3, "ビジョン": 0.5, "リストラ": -0.9, "不透明": -0.6, "コンプライアンス": 0.3, "改革": 0.4, "イノベーション": 0.6,
    "評価制度": 0.3, "実力主義": 0.5, "年功序列": -0.3, "給与": 0.3, "ボーナス": 0.4, "低賃金": -0.7,
}


def numbered_lines(spark: SparkSession, paths: Sequence[str], encoding: str = "utf-8") -> DataFrame:
    """(file_no, line_no, line) of text files in any encoding, numbered within each file; bytes that do not decode become
    replacement marks. Spark's own readers know seven encodings only, so each file (a dictionary of a few megabytes) is
    decoded as one row of an Arrow batch on an executor."""

    def lines(batches):
        for pdf in batches:
            for content in pdf["content"]:
                found = [x.strip() for x in bytes(content).decode(encoding, errors="replace").lstrip("\ufeff").splitlines()]
                yield pd.DataFrame({"line_no": range(len(found)), "line": found})

    out = None
    for i, p in enumerate(paths):
        rows = spark.read.format("binaryFile").load(p).select("content").mapInPandas(lines, "line_no long, line string").withColumn("file_no", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out


def fold_duplicates(rows: DataFrame) -> DataFrame:
    """(word, score) from (word, position, score): repeated words average step by step, (old + new) / 2, in line order."""
    grouped = rows.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("position", "score"))).alias("__s"))
    folded = F.aggregate(F.slice("__s", 2, F.greatest(F.size("__s") - 1, F.lit(0))), F.element_at("__s", 1)["score"], lambda acc, x: (acc + x["score"]) / 2)
    return grouped.select("word", folded.alias("score"))


def last_wins(rows: DataFrame) -> DataFrame:
    """(word, score) with the last position of each word."""
    return rows.groupBy("word").agg(F.max_by("score", "position").alias("score"))


def label_score(label):
    return F.when(label == "p", 1.0).when(label == "n", -1.0).otherwise(0.0)


def colon_lexicon(spark: SparkSession, path: str, encoding: str = "cp932") -> DataFrame:
    """word:reading:pos:score lines; shorter lines are skipped, repeated words folded."""
    parts = F.split("line", ":", -1)
    lines = numbered_lines(spark, [path], encoding).filter(F.size(parts) >= 4)
    return fold_duplicates(lines.select(parts[0].alias("word"), F.col("line_no").alias("position"), parts[3].cast("double").alias("score")))


def tab_lexicons(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """word<tab>p/e/n lines of several files; the last one wins."""
    parts = F.split("line", "\t", -1)
    lines = numbered_lines(spark, paths).filter(F.size(parts) >= 2)
    return last_wins(lines.select(parts[0].alias("word"), F.struct("file_no", "line_no").alias("position"), label_score(parts[1]).alias("score")))


def scored_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word<tab>label[<tab>score] lines with # comments; a third column that is no number falls back to the label. A missing
    file raises."""
    parts = F.split("line", "\t", -1)
    lines = numbered_lines(spark, [path]).filter("line != '' and not startswith(line, '#')").filter(F.size(parts) >= 2)
    score = F.coalesce(F.try_element_at(parts, F.lit(3)).try_cast("double"), label_score(parts[1]))
    return last_wins(lines.select(parts[0].alias("word"), F.col("line_no").alias("position"), score.alias("score")))


def domain_lexicon(spark: SparkSession, words: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame(list((DOMAIN_VOCAB if words is None else words).items()), "word string, score double")


def merge_lexicons(by_precedence: Sequence[DataFrame]) -> DataFrame:
    """(word, score): the first relation that has a word decides."""
    ranked = None
    for i, lexicon in enumerate(by_precedence):
        rows = lexicon.select("word", "score", F.lit(i).alias("priority"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    first = F.row_number().over(Window.partitionBy("word").orderBy("priority", "score"))
    return ranked.withColumn("__n", first).filter("__n = 1").select("word", "score")


def load_merged(spark: SparkSession, colon: DataFrame | None, tab: DataFrame | None, prefer: str = "titech", domain: dict[str, float] | None = None) -> DataFrame:
    """Domain words first, then the preferred dictionary (titech: the colon one), then the other; absent ones are left out."""
    order = [colon, tab] if prefer == "titech" else [tab, colon]
    return merge_lexicons([domain_lexicon(spark, domain), *[x for x in order if x is not None]])
