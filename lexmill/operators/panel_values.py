"""Schools of the panel and what they prescribe."""

from __future__ import annotations

# The panel in its order.
SCHOOLS = ("shanghan", "wenbing", "piwei", "huoshen", "integrative", "nihaixia")
# Treatment and formula by diagnosis and school.
OVERRIDES = [
    ("脾胃阳虚倾向", "shanghan", "温中祛寒，调理中焦", "理中汤类方（须执业中医师复核剂量）"),
    ("脾胃阳虚倾向", "wenbing", "温中为先，同时复核有无伏热", "暂不建议寒凉，先温中观察"),
    ("脾胃阳虚倾向", "piwei", "补中益气，升举清阳", "补中益气汤类方（须执业中医师复核剂量）"),
    ("脾胃阳虚倾向", "huoshen", "温补脾肾之阳", "附子理中汤类方（附子有毒，务必医师复核）"),
    ("脾胃阳虚倾向", "integrative", "健脾温中，兼顾消化功能评估", "香砂六君子汤类方（须执业中医师复核剂量）"),
    ("脾气不足倾向", "piwei", "健脾益气，升阳举陷", "四君子汤/补中益气汤类方（医师复核）"),
    ("脾气不足倾向", "shanghan", "建中益气，甘温除热", "小建中汤类方（医师复核）"),
    ("胃热倾向", "wenbing", "清胃生津，护养阴液", "清胃散类方（医师复核）"),
    ("胃热倾向", "huoshen", "确有实火方可清降，须辨真寒假热", "暂以清热和胃为先（医师复核）"),
    ("胃热倾向", "piwei", "清胃而不伤中，顾护脾胃", "益胃汤类方（医师复核）"),
    ("脾胃阳虚倾向", "nihaixia", "温补中焦阳气，建中御外", "理中汤或小建中汤类方（医师复核）"),
    ("脾气不足倾向", "nihaixia", "补足中焦，建运化之机", "四君子合小建中意（医师复核）"),
    ("胃热倾向", "nihaixia", "清阳明之经热，透热出表", "白虎汤或竹叶石膏汤意（医师复核）"),
]
