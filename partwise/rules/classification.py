"""Name families and synonyms, samples, keyword triggers, patterns and fusion weights."""

# (word in the item name, words in the category name), in order.
FAMILIES = [
    ("弯头", ["管道配件", "弯头", "弯管"]),
    ("三通", ["管道配件", "三通"]),
    ("法兰", ["管道配件", "法兰", "带颈对焊法兰", "平焊法兰"]),
    ("管道", ["管道配件", "管道", "管子"]),
    ("软管", ["管道配件", "软管", "金属软管"]),
    ("疏水器", ["疏水阀", "管道配件", "疏水器"]),
    ("疏水阀", ["疏水阀", "管道配件", "疏水器"]),
    ("密封", ["机械密封及配件", "密封"]),
    ("接头", ["管道配件", "接头", "终端接头"]),
    ("对焊", ["管道配件", "对焊", "焊接"]),
    ("压缩机", ["气体压缩机配件", "活塞式压缩机配件", "螺杆式压缩机配件", "离心式压缩机配件"]),
    ("泵", ["工业泵配件", "离心泵配件", "往复泵配件", "计量泵配件"]),
    ("阀门", ["管道配件", "阀门", "阀"]),
    ("金属软管", ["管道配件", "软管", "金属软管"]),
    ("螺塞", ["紧固件", "螺栓", "螺丝"]),
    ("螺栓", ["紧固件", "螺塞", "螺丝"]),
    ("螺钉", ["紧固件", "螺栓", "螺丝"]),
    ("螺母", ["紧固件", "螺栓配件"]),
    ("垫片", ["紧固件", "密封件"]),
]
FAMILY_SCORE, FAMILY_EXACT = 0.6, 0.9
SYNONYMS = [
    ("疏水器", ["疏水阀", "疏水", "蒸汽疏水器"]),
    ("疏水阀", ["疏水器", "疏水", "蒸汽疏水阀"]),
    ("蒸汽疏水器", ["疏水阀", "疏水器"]),
    ("压缩机", ["压缩", "空压机", "气体压缩机"]),
    ("接头", ["连接", "接口", "终端接头", "焊接接头"]),
    ("对焊接头", ["接头", "焊接终端接头"]),
    ("终端接头", ["接头", "对焊接头"]),
    ("法兰", ["连接", "接口", "带颈法兰", "平焊法兰"]),
    ("带颈对焊法兰", ["法兰", "对焊法兰"]),
    ("密封", ["密封件", "密封圈", "机械密封"]),
    ("机械密封", ["密封", "密封件"]),
    ("软管", ["管道", "管子", "管", "金属软管"]),
    ("金属软管", ["软管", "管道"]),
    ("阀门", ["阀", "开关"]),
    ("泵", ["水泵", "离心泵", "工业泵"]),
    ("离心泵", ["泵", "工业泵"]),
    ("往复泵", ["泵", "工业泵"]),
]
SYNONYM_SCORE, SYNONYM_EXACT = 0.7, 0.95
EXACT_SYNONYMS = [("疏水器", "疏水阀"), ("疏水阀", "疏水器")]
CONTAINED, OVERLAP_FACTOR, OVERLAP_LEAST = 0.8, 0.6, 0.3

# Category -> samples as (name, spec, dn, pn, material).
SAMPLES = {
    "金属软管": [("金属软管", "DN25 PN2.0，材质304SS，L=3m，两端法兰连接", "DN25", "PN2.0", "304SS"),
             ("金属软管", "DN50 PN16，304不锈钢，长度10米", "DN50", "PN16", "304SS")],
    "疏水器": [("疏水器", "DN25 CL150，材质CS，介质温度100-180℃", "DN25", "CL150", "CS")],
    "带颈对焊法兰": [("全平面带颈对焊法兰", "1.0MPa DN200 0Cr18Ni9", "DN200", "1.0MPa", "0Cr18Ni9"),
               ("凸面带颈对焊法兰", "4.0MPa DN50 20#", "DN50", "4.0MPa", "20#")],
    "无缝三通": [("无缝异径三通", "DN50*25 t=3.5 20#", "DN50*25", "", "20#")],
    "其它管道配件": [("对焊式直通焊接终端接头", 'PN63 BW Φ14/1/2"NPT(M) 316SS', "", "PN63", "316SS")],
}
COMMON_UNITS = {"金属软管": ["根", "米"], "疏水器": ["个", "台"], "法兰": ["件", "个"], "三通": ["个", "件"]}
UNIT_MATCH, UNIT_OTHER, UNIT_DEFAULT = 1.0, 0.3, 0.5
SCORE_WEIGHTS = {"name": 0.8, "spec": 0.1, "unit": 0.05, "keyword": 0.05}
REWARD_ABOVE, REWARD, KEEP_ABOVE, SAMPLE_ABOVE = 0.9, 1.2, 0.02, 0.3
SPECIFIC = ["疏水阀", "机械密封及配件", "金属软管", "离心泵配件", "往复泵配件", "计量泵配件", "活塞式压缩机配件"]
GENERAL = ["管道配件", "通用机械设备配件", "工业泵配件", "气体压缩机配件", "其他"]
SPECIFIC_GAIN, SPECIFIC_FROM, GENERAL_LOSS = 20, 50, 10
# Material family -> [(words in the category, points)], the first family detected decides.
MATERIAL_BOOSTS = [
    ("不锈钢", [(["疏水", "法兰", "阀门", "管道"], 8), (["紧固件"], 3)]),
    ("碳钢", [(["紧固件"], 10), (["法兰", "管道"], 5)]),
    ("表面处理", [(["接头", "管道", "紧固件"], 6)]),
]
RESORT_WORDS, RESORT_GAIN, MATERIAL_GAIN, MATERIAL_FROM = ["疏水阀", "球阀", "法兰", "紧固件"], 2, 5, 70

# (trigger words in a category name, keywords added); the first group has extras of its own.
TRIGGERS = [
    (["化工", "催化剂", "助剂", "溶剂", "添加剂"], ["化工", "化学", "催化剂", "助剂", "溶剂", "添加剂", "化学品"]),
    (["催化剂"], ["catalyst", "催化", "载体", "al2o3", "sio2"]),
    (["助剂"], ["添加剂", "稳定剂", "增塑剂", "改性剂"]),
    (["溶剂"], ["溶液", "有机溶剂", "无机溶剂", "甲醇", "乙醇"]),
    (["包装", "容器", "袋", "箱", "桶"], ["包装", "容器", "袋子", "纸箱", "包装袋", "包装箱", "桶"]),
    (["化验", "试验", "实验", "检测"], ["化验", "试验", "实验", "检测", "测试", "分析", "仪器"]),
    (["劳保", "防护", "安全"], ["劳保", "防护", "安全", "防护用品", "劳保用品", "安全用品"]),
    (["消防", "灭火", "报警"], ["消防", "灭火", "火灾", "报警", "消防器材", "灭火器"]),
    (["办公", "文具", "纸张", "笔"], ["办公", "文具", "办公用品", "文具用品", "纸张", "笔"]),
    (["电气", "电力", "电子", "仪表", "自控"], ["电气", "电力", "电子", "仪表", "自控", "电气设备", "电子设备"]),
    (["机械", "设备", "泵", "阀", "管件"], ["机械", "设备", "泵", "阀门", "管件", "机械设备", "工业设备"]),
    (["建筑", "钢材", "水泥", "砂石"], ["建筑", "建材", "钢材", "水泥", "砂石", "建筑材料"]),
    (["工具", "刀具", "量具", "夹具"], ["工具", "刀具", "量具", "夹具", "手工工具", "测量工具"]),
    (["运输", "车辆", "叉车"], ["运输", "车辆", "叉车", "运输设备", "搬运设备"]),
    (["通用", "设备", "备件"], ["通用", "设备", "备件", "通用设备", "机械备件"]),
]

TRAINED_HIT, TRAINED_CAP = 0.25, 1.0
MAP_HIT, MAP_CAP, MAP_TOP = 0.15, 0.95, 3
WIDE_HIT, WIDE_CAP, WIDE_TOP = 0.3, 0.95, 5
PRIORITY_WORDS = ["depuy", "强生", "johnson", "等离子", "射频", "气化", "电极"]
PRIORITY_CATEGORIES, PRIORITY_CONFIDENCE = ["治疗设备", "手术器械", "医疗器械"], 0.85
SPEC_HIT, SPEC_CAP, SPEC_PATTERN = 0.3, 0.8, 0.25
NUM = r"[0-9]+(?:\.[0-9]+)?"
SIZE_CATEGORIES = ["建筑材料", "钢材", "管材", "机械零件"]
POWER_CATEGORIES = ["电子设备", "电气设备"]
# (name, pattern, suggested categories), case ignored.
SPEC_FAMILIES = [
    ("size", rf"({NUM})\s*[×xX*]\s*({NUM})\s*[×xX*]\s*({NUM})", SIZE_CATEGORIES),
    ("diameter", rf"[φΦ直径]\s*({NUM})", SIZE_CATEGORIES),
    ("length", rf"长\s*({NUM})", SIZE_CATEGORIES),
    ("width", rf"宽\s*({NUM})", []),
    ("height", rf"高\s*({NUM})", []),
    ("voltage", rf"({NUM})\s*[VvKk电压]", POWER_CATEGORIES),
    ("power", rf"({NUM})\s*[WwKk功率]", POWER_CATEGORIES),
    ("capacity", rf"({NUM})\s*[LlMm容量升]", ["容器", "储罐", "医疗器械"]),
    ("medical_device", r"(电极|导管|植入物|一次性)", ["医疗器械", "手术器械"]),
    ("electronic", rf"({NUM}\s*[VWHzAΩ])", POWER_CATEGORIES),
    ("mechanical", r"([0-9]+\s*mm|[0-9]+\s*cm|M[0-9]+|不锈钢)", ["机械零件", "钢材"]),
]
MAKER_RULE, MAKER_HISTORY = 0.75, 0.4
UNCLASSIFIED, UNCLASSIFIED_CONFIDENCE = "未分类", 0.1
FAILED = "分类失败"
CLASSIFIER_WEIGHTS = {"IntelligentClassifier": 0.6, "SmartClassifier": 0.4, "AdvancedMatcher": 0.3}
OTHER_CLASSIFIER_WEIGHT, ACCEPT_AT = 0.2, 0.6
LEXICON_EXACT, LEXICON_KEYWORD, LEXICON_KEEP = 0.95, 0.7, 0.1
FALLBACK_SHARED, FALLBACK_TOP = 2, 3
VOTE_ITEMS, VOTE_FACTOR, VOTE_CAP = 10, 0.3, 0.85
BRAND_WORDS, BRAND_CONFIDENCE = ["医药", "制药", "生物"], 0.8
DRUG_UNITS, ELECTRIC_UNITS, UNIT_CONFIDENCE = ["mg", "ml", "片", "粒"], ["A", "V", "W", "Hz"], 0.7
DRUG_CATEGORY, ELECTRIC_CATEGORY = "医疗用品-药品", "工业用品-电气设备"
