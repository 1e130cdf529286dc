"""Industry taxonomies, template rules, weights and thresholds."""

TAXONOMY = {
    "manufacturing": [
        ("管道阀门", "控制阀门", ["球阀", "蝶阀", "闸阀", "截止阀", "调节阀"]),
        ("管道阀门", "安全阀门", ["安全阀", "泄压阀", "呼吸阀"]),
        ("管道阀门", "止回阀门", ["升降式止回阀", "旋启式止回阀", "蝶式止回阀"]),
        ("管道阀门", "特殊阀门", ["疏水阀", "减压阀", "过滤器"]),
        ("管道连接件", "管道配件", ["弯头", "三通", "四通", "异径管", "管帽"]),
        ("管道连接件", "法兰系列", ["平焊法兰", "对焊法兰", "螺纹法兰", "盲板法兰"]),
        ("管道连接件", "管道支架", ["固定支架", "滑动支架", "弹簧支架"]),
        ("流体输送设备", "泵类设备", ["离心泵", "齿轮泵", "螺杆泵", "往复泵", "计量泵"]),
        ("流体输送设备", "风机设备", ["离心风机", "轴流风机", "混流风机"]),
        ("流体输送设备", "压缩设备", ["空气压缩机", "制冷压缩机", "工艺压缩机"]),
        ("通用机械配件", "密封元件", ["机械密封", "填料密封", "垫片", "O型圈"]),
        ("通用机械配件", "传动元件", ["轴承", "联轴器", "齿轮", "皮带"]),
        ("通用机械配件", "连接件", ["螺栓", "螺母", "垫圈", "销钉", "铆钉"]),
    ],
    "medical": [
        ("医疗器械", "基础医疗器械", ["手术器械", "注射器械", "穿刺器械", "缝合材料"]),
        ("医疗器械", "诊断设备", ["影像设备", "检验设备", "监护设备", "测量设备"]),
        ("医疗器械", "治疗设备", ["手术设备", "康复设备", "急救设备", "理疗设备"]),
        ("医疗器械", "植入器械", ["心血管植入物", "骨科植入物", "神经植入物"]),
        ("医疗器械", "一次性医疗用品", ["输液器具", "注射用品", "医用敷料", "防护用品"]),
        ("药品", "处方药", ["化学药品", "生物制品", "中药制剂"]),
        ("药品", "非处方药", ["感冒药", "止痛药", "维生素", "保健品"]),
        ("药品", "外用药物", ["皮肤用药", "眼科用药", "耳鼻喉科用药"]),
        ("药品", "特殊药品", ["麻醉药品", "精神药品", "毒性药品", "放射性药品"]),
    ],
    "generic": [
        ("通用产品", "标准产品", ["产品A", "产品B", "产品C"]),
        ("通用产品", "定制产品", ["定制A", "定制B", "定制C"]),
    ],
}
KEYWORD_RULE = {"priority": 8, "threshold": 0.7, "weight": 0.4, "boost": 0.2, "fields": ["material_name", "specification", "category"]}
# Industry -> (patterns, fields, parameter -> (pattern, group)).
PATTERN_RULES = {
    "manufacturing": (
        [r"DN\s*[0-9]+", r"PN\s*[0-9]+"], ["specification"], {"diameter": (r"DN\s*([0-9]+)", 1), "pressure": (r"PN\s*([0-9]+)", 1)}),
    "medical": (
        [r"[0-9]+mg/ml", r"[0-9]+%", r"规格.*[0-9]+ml"], ["specification", "concentration"],
        {"concentration": (r"([0-9]+(?:\.[0-9]+)?)\s*(mg/ml|%)", 1), "volume": (r"([0-9]+(?:\.[0-9]+)?)\s*ml", 1)}),
}
PATTERN_RULE = {"priority": 7, "weight": 0.3, "boost": 0.15}
SIMILARITY_RULES = [
    {"priority": 6, "weight": 0.25, "threshold": 0.6, "boost": 0.0, "method": "tfidf_cosine", "fields": ["material_name", "specification"]},
    {"priority": 5, "weight": 0.15, "threshold": 0.8, "boost": 0.1, "method": "fuzzy_string", "fields": ["manufacturer"]},
]
COMPOSITE_RULE = {"priority": 9, "weight": 0.35, "multiplier": 1.2}
QUALITY_WEIGHTS = {
    "name_matching": 0.35, "specification_matching": 0.25, "category_matching": 0.20, "manufacturer_matching": 0.10, "technical_params": 0.10,
}
GOOD_SOURCE, POOR_SOURCE = 0.8, 0.5
GOOD_GAINS = {"name_matching": 0.1, "specification_matching": 0.05}
POOR_GAINS = {"category_matching": 0.1, "manufacturer_matching": 0.05}
THRESHOLDS = {"manufacturing": 0.75, "medical": 0.80, "generic": 0.70}
SURE_SOURCE, UNSURE_SOURCE, SURE_LOSS, UNSURE_GAIN = 0.8, 0.6, 0.05, 0.10
LOW_ACCURACY, HIGH_ACCURACY, KEYWORD_FACTOR, SIMILARITY_FACTOR = 0.7, 0.9, 1.1, 0.9
MANY_ERRORS, ERROR_GAIN, ACCURACY_LOSS = 10, 0.05, 0.02
UNCLASSIFIED, NO_RULE, NO_CATEGORY = "未分类", "无匹配规则", "规则无分类"
LOW_CONFIDENCE = 0.7
