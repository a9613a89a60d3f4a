"""Chinese texts: third person with protected quotations, trees and profiles in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words with "self" that aren't a first person, and words after which one is an object.
SELF_WORDS = [
    "自我怀疑", "自我改变", "自我投资", "自我身份", "自我保护", "自我反省", "自我提升", "自我认知", "自我介绍", "自我牺牲", "自我调节", "自我管理", "自我实现", "自我成长", "自我价值", "自我表达",
    "自我意识", "自我评价", "自我肯定", "自我否定", "自我安慰", "自我激励", "自我约束", "自我修复", "自我完善", "自我控制", "自我欺骗", "自我毁灭", "自我救赎", "自我定位", "持自我", "坚持自我",
]
BEFORE_OBJECT = [
    "对", "找", "知道", "以为", "认为", "觉得", "见到", "看到", "看", "见", "邀请", "期待", "夸", "夸奖", "称", "问", "询问", "请", "让", "帮", "关心", "喜欢", "欢迎", "尊重", "了解", "理解", "注意",
    "崇拜", "羡慕", "感谢", "提醒", "告诉", "告知", "鼓励", "安慰", "说服", "嘲笑", "批评", "赞", "赞扬", "佩服", "推荐", "带", "害", "要", "给", "向", "和", "与", "跟", "服", "望", "待", "享",
    "到", "说", "过", "听", "有", "去", "可", "误认为", "质疑", "是", "适合", "陪", "约", "记", "写", "发现", "记得", "怀疑", "把", "建议", "好奇", "听闻", "认出", "模仿", "满足", "为", "如", "管",
    "信", "闻", "出", "遇见", "遇", "称呼", "关注", "注", "叫做", "称为", "成为", "当做", "了",
]
#: A quotation, or what lies between two.
_PARTS = '["“][^"”]*["”]|[^"“]+|["“]'
#: A mark of private use for a first person that stays.
_HELD = "\ue000"


def third_person(text: Column) -> Column:
    """First person to ``其``: the possessive outside book titles, objects after a verb, and at the start of a clause.

    Quotations, ``我们`` and words with "self" stay. Null stays null.
    """
    def told(part: Column) -> Column:
        after = "|".join(w.removeprefix("自我") for w in SELF_WORDS if w.startswith("自我"))
        held = F.regexp_replace(part, f"自我(?={after})|(?<=持)自我", f"自{_HELD}")
        own = F.regexp_replace(held, "(?<!《)我的(?!》)", "其")
        put = F.regexp_replace(own, "(" + "|".join(sorted(BEFORE_OBJECT, key=len, reverse=True)) + ")我(?!们)", "$1其")
        return F.regexp_replace(F.regexp_replace(put, "(?<=[，。；,;])我(?!们)", "其"), _HELD, "我")

    parts = F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0))
    quoted = lambda p: p.rlike('(?s)^["“].*["”]$') & (F.length(p) > 1)
    whole = F.array_join(F.transform(parts, lambda p: F.when(quoted(p), p).otherwise(told(p))), "")
    return F.when(text.isNotNull(), F.regexp_replace(whole, "^我(?!们)", "其"))


def bare(text: Column) -> Column:
    """Without white space around it and signs at its end; an empty text is null."""
    return F.nullif(F.regexp_replace(F.trim(text), r"[\s。．.，,；;、！!？?]+$", ""), F.lit(""))


def headed(head: str, text: Column) -> Column:
    """The text after a heading, unless it begins with it."""
    return F.when(bare(text).startswith(head), bare(text)).otherwise(F.concat(F.lit(head), bare(text)))


def _joined(sign: str, *parts: Column) -> Column:
    return F.nullif(F.concat_ws(sign, *parts), F.lit(""))


def tree_text(tree: Column) -> Column:
    """A tree in words: who it is, bonds, nature, habits, then the present state.

    ``tree``: ``identity`` (name, backstory), ``persona`` (a map of texts), ``session`` (learned_info,
    attitude_shifts, commitments, stance_changes) and ``moment`` (emotion, emotion_intensity,
    scene_context). Parts that are null or empty are left out; a tree of nothing is its name.
    """
    identity, persona, session, moment = tree["identity"], tree["persona"], tree["session"], tree["moment"]
    field = lambda f: F.try_element_at(persona, F.lit(f))
    several = lambda xs: F.nullif(F.array_join(F.transform(xs, bare), "；"), F.lit(""))
    who = _joined("。", _joined("，", F.nullif(identity["name"], F.lit("")), bare(field("demographics")), bare(field("occupation"))), bare(identity["backstory"]))
    nature = _joined("，", headed("性格", field("personality")), headed("爱好", field("hobbies")), headed("说话风格为", field("speaking_style")))
    lasting = _joined("。", who, bare(field("relationships")), nature, bare(field("behavioral_tendencies")))
    strong = (moment["emotion"] != "neutral") & (moment["emotion"] != "") & (F.coalesce(moment["emotion_intensity"], F.lit(3)) >= 3)
    feels = F.when(strong, F.concat(F.lit("情绪"), moment["emotion"], F.lit("（强度"), F.coalesce(moment["emotion_intensity"], F.lit(3)).cast("string"), F.lit("/10）")))
    shifts = F.nullif(F.array_join(F.transform(F.map_entries(session["attitude_shifts"]), lambda e: F.concat(F.lit("对"), e["key"], F.lit("的态度"), e["value"])), "，"), F.lit(""))
    now = _joined("，", feels, bare(moment["scene_context"]), several(session["learned_info"]), shifts, several(session["commitments"]), several(session["stance_changes"]))
    return (
        F.when(now.isNotNull(), F.concat(F.coalesce(lasting, F.lit("")), F.lit("。当前状态为"), now, F.lit("。")))
        .when(lasting.isNotNull(), F.concat(lasting, F.lit("。"))).otherwise(F.coalesce(identity["name"], F.lit("")))
    )


# Fields that make the first sentence of a profile, in their order, with what is said before them; values that say nothing.
INTRODUCTION = {
    "性别": "", "物种": "", "年龄": "年龄", "工作": "", "昵称": "又称", "生日": "出生于", "生肖": "属", "星座": "", "身高": "身高", "体重": "体重", "居住地": "居住于", "学历": "", "智商": "智商", "情商": "情商", "恋爱状态": "",
}
NOTHING = ["", "无", "未知", "暂无"]


def profile_text(name: Column, profile: Column) -> Column:
    """A profile (a map of texts) as a paragraph: the name with what introduces it, then a sentence for each other field by its name.

    An age in figures gets its unit; the species is said unless it is human. Null values and those
    that say nothing are left out.
    """
    def clause(key: str, head: str) -> Column:
        value = F.trim(F.try_element_at(profile, F.lit(key)))
        said = F.concat(F.lit(head), value)
        if key == "年龄":
            said = F.when(value.contains("岁"), value).when(value.rlike("^[0-9]+$"), F.concat(value, F.lit("岁"))).otherwise(said)
        if key == "物种":
            said = F.when(value != "人类", said)
        return F.when(~value.isin(NOTHING), said)

    first = F.concat(F.concat_ws("，", name, *(clause(k, h) for k, h in INTRODUCTION.items())), F.lit("。"))
    rest = F.filter(F.sort_array(F.map_entries(profile)), lambda e: ~e["key"].isin(list(INTRODUCTION)) & e["value"].isNotNull() & ~F.trim(e["value"]).isin(NOTHING))
    said = F.transform(rest, lambda e: F.concat(F.when(F.trim(e["value"]).startswith(e["key"]), F.lit("")).otherwise(e["key"]), F.trim(e["value"]), F.lit("。")))
    return F.replace(F.concat(first, F.array_join(said, "")), F.lit("。。"), F.lit("。"))
