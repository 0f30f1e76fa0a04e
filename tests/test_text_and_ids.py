"""Literal expectations of the column helpers."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from booktext_spark.functions import ids
from booktext_spark.functions import text as T


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw", ["  a　　b\x1c c ", "", "\n\n", "一 二", "a\x85b"])
def test_canonical_text_is_pythons(spark, raw):
    assert one(spark, T.canonical_text(F.col("t")), t=raw) == " ".join(raw.split())
    assert one(spark, T.strip(F.col("t")), t=raw) == raw.strip()


def test_nfkc_and_copying_form(spark):
    assert one(spark, T.normalize_reference_text(F.col("t")), t="ﾊﾟﾋﾟ　１２ ！") == "パピ 12 !"
    assert one(spark, T.normalize_for_copying(F.col("t")), t="Ａ-b、「ｶﾞ」_²") == "abガ2"


def test_windows_count_code_points(spark):
    assert one(spark, T.windows(F.col("t"), 2), t="𠮷野家") == ["𠮷野", "野家"]
    assert one(spark, T.windows(F.col("t"), 2), t="a\nb") == ["a\n", "\nb"]
    assert one(spark, T.windows(F.col("t"), 3), t="ab") == []


def test_search_tokens(spark):
    assert one(spark, T.search_tokens(F.col("t")), t="猫が、猫が ab_1") == ["猫が", "が猫", "がa", "ab", "b_", "_1"][:3] + ["ab", "b1", "猫が猫", "が猫が", "猫がa", "がab", "ab1", "ab_1"]


def test_match_cost_and_signature(spark):
    same = one(spark, T.match_cost(F.col("s"), F.col("t")), s="あ" * 100 + "。", t="啊" * 72 + "。")
    assert same < 0.02
    assert one(spark, T.match_cost(F.col("s"), F.col("t")), s="「あ」", t="啊") > 0.28
    assert one(spark, T.dialogue_signature(F.col("t")), t=" 「あ」 ") == (True, True)


def test_text_for_takes_empty_translations(spark):
    m = F.create_map(F.lit("zh-CN"), F.lit(""))
    assert one(spark, T.text_for(m, "zh-CN", F.col("t")), t="x") == ""
    assert one(spark, T.text_for(m, "zh-TW", F.col("t")), t="x") == "x"


@pytest.mark.parametrize("raw", ["é", 'a"b\\', "日本\x1f", "\x0b!", "line\nbreak"])
def test_stable_identifier(spark, raw):
    data = json.dumps(["k", raw], ensure_ascii=False, separators=(",", ":")).encode()
    assert one(spark, ids.stable_identifier("blk", F.lit("k"), F.col("t")), t=raw) == f"blk_{hashlib.sha256(data).hexdigest()[:24]}"


def test_pair_hash(spark):
    want = hashlib.sha256("\x1f".join(["zh-cn", "A b", "c"]).encode()).hexdigest()
    assert one(spark, ids.pair_hash(F.col("s"), F.col("t"), F.lit("zh-CN")), s=" Ａ　b", t="c ") == want


def test_common_run_against_brute_force():
    random.seed(3)
    for _ in range(60):
        a, b = ("".join(random.choices("ab𠮷", k=random.randrange(0, 14))) for _ in "xy")
        best = max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b), default=0)
        assert T.common_run(a, b) == best


def test_review_at_the_threshold_is_that_of_the_sql(spark, tmp_path):
    """A target of 9 characters for 8 has a confidence of 0.64, up to the last place."""
    import duckdb

    from booktext_spark.plans import registry

    turns = [(k, turn, "user", "ab"[turn] * (8 + turn) * k) for k in range(1, 200) for turn in (0, 1)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES["match_cost"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.ORACLE_SQL["match_cost"]).fetchall())
    assert not {r.conv_id: r.needs_review for r in got}[5]
