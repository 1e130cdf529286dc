"""Keyword groups, specification buckets and search ranges of the trainer."""

KEYWORD_RULES = {
    "医疗器械": ["器械", "设备", "仪器", "系统", "机器", "治疗", "诊断", "监护"],
    "电子设备": ["电子", "电路", "芯片", "传感器", "控制器", "显示器"],
    "机械零件": ["零件", "配件", "轴承", "齿轮", "螺丝", "螺栓"],
    "化工材料": ["化学", "溶液", "试剂", "材料", "涂料", "胶水"],
}
MAKER_RULES = [
    (["医疗", "器械", "生物", "药业", "医药", "健康", "强生", "johnson", "depuy"], "医疗器械"),
    (["电子", "科技", "技术", "软件", "数码", "通讯"], "电子设备"),
    (["机械", "工程", "制造", "重工", "精密", "自动化"], "机械零件"),
]
MAKER_DEFAULT = "通用"
NUM = r"[0-9]+(?:\.[0-9]+)?"
SPEC_BUCKETS = {
    "尺寸规格": rf"{NUM}\s*[×xX*]\s*{NUM}",
    "电气规格": rf"{NUM}\s*[VvKk]",
    "材质规格": "(不锈钢|铝合金|塑料|橡胶|硅胶)",
    "医疗规格": "(一次性|无菌|消毒|灭菌)",
}
SPEC_RULES = {
    "医疗器械": ["电极", "导管", "植入物", "一次性"],
    "电子设备": ["V", "W", "Hz", "A", "Ω"],
    "机械零件": ["mm", "cm", "M3", "M4", "不锈钢"],
}
RULE_CONFIDENCE = {"keyword": 0.7, "manufacturer": 0.75, "specification": 0.6}
DOMAIN_WORDS = ["医", "疗", "械", "设备", "仪器", "系统", "治疗", "手术", "诊断"]
DOMAIN_LISTS = {"治疗设备": ["治疗", "射频", "等离子"], "手术器械": ["手术", "电极", "导管"]}

CATEGORY_WORDS = ["阀", "泵", "管", "轴承", "密封", "法兰", "螺栓"]
SPEC_MARKS = ["DN", "PN", "φ", "M", "*"]
# Feature -> lowest and highest weight searched, before normalising.
SEARCH = {
    "confidence": (0.1, 0.5), "consistency": (0.1, 0.4), "completeness": (0.1, 0.3), "accuracy": (0.05, 0.25), "compliance": (0.05, 0.2),
}
PREDICT_AT = 0.75
ADOPT_GAIN = 0.02
FEEDBACK_STEP = 0.05
MERGE_BELOW, SEPARATE_ABOVE = 0.8, 0.7
FAVOURED = ["疏水器", "带颈对焊法兰", "金属软管", "过滤器"]
SAMPLE_TARGET, SAMPLE_SHARE, FAVOURED_SHARE = 2000, 0.3, 0.5
COVERAGE_PREFIXES = ["A", "B", "C", "D", "E"]
