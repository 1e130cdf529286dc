r"""Regex families, tags and normalisers for free-text descriptions.

Patterns stay inside the dialect Java and RE2 share: no ``\w``, ``\b`` or ``\d``,
which differ on non-ASCII text, and no look-around.
"""

HAN = r"\x{4e00}-\x{9fff}"
NUM = r"[0-9]+(?:\.[0-9]+)?"

# A run of Latin words of two or more letters, company suffix included.
LATIN_RUN = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?:\s+(?:Inc|Corp|Ltd|Co))?"

# (pattern, group) in order; matching ignores case.
FAMILIES = {
    "brand": [
        (rf"[{HAN}]+(?:集团|公司|厂|制药|医药|生物|科技)", 0),
        (LATIN_RUN, 0),
        (rf"(?:进口|国产)?\s*[{HAN}]{{2,6}}(?:牌|品牌)?", 0),
    ],
    "specification": [
        (rf"{NUM}(?:mg|ml|g|l|kg|片|粒|支|盒|瓶|袋|包)", 0),
        (rf"{NUM}[*×]{NUM}(?:[*×]{NUM})?(?:mm|cm|m)?", 0),
        (rf"{NUM}(?:A|V|W|Hz|℃|bar|MPa)", 0),
        (r"(?:型号|规格)[：:]?\s*([A-Z0-9\-/]+)", 1),
    ],
    "model": [
        (r"(?:型号|model)[：:]?\s*([A-Z0-9\-/]+)", 1),
        (r"[A-Z]{1,3}[0-9]{2,6}[A-Z]?", 0),
        (r"[0-9]{3,6}[A-Z]{1,3}", 0),
    ],
    "material": [
        (rf"(?:材质|材料)[：:]?\s*([{HAN}]+|[A-Z]+)", 1),
        (r"(?:不锈钢|铝合金|塑料|橡胶|钢材|铜)", 0),
    ],
    "usage": [
        (rf"(?:用于|适用于|用途)[：:]?\s*([{HAN}]+)", 1),
        (r"(?:治疗|预防|检测|测量|控制)", 0),
    ],
}

MEDICAL_TAGS = {
    "药品": ["注射液", "胶囊", "片剂", "颗粒", "口服液", "软膏", "贴剂"],
    "医疗器械": ["监护仪", "呼吸机", "除颤器", "输液泵", "心电图机", "超声设备"],
    "检验试剂": ["试剂盒", "检测卡", "标准品", "质控品", "校准品"],
    "耗材": ["导管", "导丝", "支架", "缝合线", "敷料", "手套"],
}
INDUSTRIAL_TAGS = {
    "电气设备": ["变压器", "开关", "电缆", "电机", "控制器"],
    "机械设备": ["泵", "阀门", "轴承", "齿轮", "密封件"],
    "仪器仪表": ["传感器", "流量计", "压力表", "温度计", "分析仪"],
    "五金工具": ["螺丝", "螺母", "垫片", "弹簧", "紧固件"],
}

# Applied to lower-cased specification text; group 1 of every match is kept.
SPEC_FEATURES = {
    "dn": [r"dn\s*([0-9]+(?:\*[0-9]+)?)", r"φ\s*([0-9]+)", r"直径\s*([0-9]+)"],
    "pn": [r"pn\s*([0-9.]+)", r"cl\s*([0-9]+)", r"([0-9]+\.?[0-9]*)\s*mpa", r"([0-9]+)\s*lb"],
    "material": [r"(304ss?|316ss?|321ss?)", r"(cs|碳钢)", r"(20#|q235)", r"(a105|a182)", r"(0cr18ni9)"],
    "length": [r"l\s*=\s*([0-9.]+)\s*m", r"长度\s*([0-9.]+)\s*[米m]", r"([0-9.]+)\s*[米m]"],
    "temp": [r"([0-9]+(?:-[0-9]+)?)\s*℃", r"温度\s*[:：]?\s*([0-9]+(?:-[0-9]+)?)"],
}

# (pattern, tag, label); matching ignores case.
SPEC_TAGS = [
    (rf"{NUM}\s*%", "purity", "化学纯度"),
    (rf"[φΦ直径]\s*{NUM}\s*mm", "diameter", "直径规格"),
    (rf"{NUM}\s*[×xX]\s*{NUM}", "dimensions", "尺寸规格"),
    (rf"{NUM}\s*[VvKk电压]", "voltage", "电压规格"),
    (rf"{NUM}\s*[WwKk功率]", "power", "功率规格"),
    (rf"{NUM}\s*[LlMm容量升]", "capacity", "容量规格"),
    (rf"{NUM}\s*[KkGg千克公斤]", "weight", "重量规格"),
    (r"[A-Z][a-z]?[0-9]*", "chemical_formula", "化学分子式"),
]

NAME_NOISE = ["牌", "型", "式", "种", "个", "只", "根", "条", "块", "片"]
SPEC_UNITS = r"(mm|cm|m|kg|g|l|ml|mpa|bar|℃|°c)"
SPEC_MARKS = r"(dn|pn|cl|φ|直径|长|宽|高)"
COMPANY_SUFFIXES = ["有限公司", "股份有限公司", "ltd", "co", "inc", "厂", "公司"]
HASH_FIELDS = ["material_name", "specification", "manufacturer", "material_type", "unit", "category"]
MODIFIED_FIELDS = ["last_modified", "update_time", "modified_at", "updated_at"]
TIMESTAMP_FIELDS = ["updated_at", "created_at", "last_modified"]
BASELINE_CATEGORIES = [("注射", "药品-注射剂"), ("胶囊", "药品-口服剂")]
BASELINE_DEFAULT = "未识别分类"
