"""Golden rows of Chinese texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dramaturg.functions import chinese as Z


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("我喜欢茶，我的猫也喜欢我。", "其喜欢茶，其猫也喜欢其。"), ("他说“我爱我的家”，我走了", "他说“我爱我的家”，其走了"), ('他说"我来"；我去', '他说"我来"；其去'), ("我们走，我们的家", "我们走，我们的家"),
        ("她有自我怀疑，我有自我介绍", "她有自我怀疑，其有自我介绍"), ("坚持自我，我在", "坚持自我，其在"), ("他读《我的家》，那是我的", "他读《我的家》，那是其"), ("告诉我，他认为我好", "告诉其，他认为其好"),
        ("没有“引号", "没有“引号"), ("", ""), (None, None),
    ],
)
def test_third_person(spark, text, want):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(Z.third_person(F.col("t")).alias("x")).first()["x"] == want


TREE = (
    "identity struct<name string, backstory string>, persona map<string,string>, session struct<learned_info array<string>, attitude_shifts map<string,string>, commitments array<string>, stance_changes array<string>>, "
    "moment struct<emotion string, emotion_intensity int, scene_context string>"
)


def test_trees(spark):
    full = (("小明", "生于北京。"), {"demographics": "十岁。", "personality": "性格温和。", "hobbies": "下棋", "relationships": "小红的哥哥", "speaking_style": "简洁！"}, (["知道密码。", "门开了"], {"小红": "变好"}, ["回家"], []), ("高兴", 5, "在学校。"))
    empty = (("小明", None), {}, ([], {}, [], []), ("neutral", 9, None))
    rows = spark.createDataFrame([(full,), (empty,), ((("小明", ""), {"occupation": "医生"}, (None, None, None, None), ("高兴", 2, "")),)], f"tree struct<{TREE}>")
    assert [r["x"] for r in rows.select(Z.tree_text(F.col("tree")).alias("x")).collect()] == [
        "小明，十岁。生于北京。小红的哥哥。性格温和，爱好下棋，说话风格为简洁。当前状态为情绪高兴（强度5/10），在学校，知道密码；门开了，对小红的态度变好，回家。", "小明。", "小明，医生。",
    ]


def test_profiles(spark):
    rows = [("小明", {"年龄": "12", "性别": "男", "物种": "人类", "昵称": "明明", "特长": "特长是下棋", "爱好": "茶。", "备注": "无"}), ("猫", {"物种": "猫", "年龄": "不详"}), ("空", {})]
    frame = spark.createDataFrame(rows, "n string, p map<string,string>")
    got = [r["x"] for r in frame.select(Z.profile_text(F.col("n"), F.col("p")).alias("x")).collect()]
    assert got == ["小明，男，12岁，又称明明。爱好茶。特长是下棋。", "猫，猫，年龄不详。", "空。"]
