"""Manufacturing fields, sizes, ratings, standards and categories."""

NUM = r"[0-9]+(?:\.[0-9]+)?"
UNKNOWN_MATERIAL = "未知材质"
MATERIAL_FIELDS = ["材质", "材料", "material", "材质牌号", "材料类型"]
MATERIALS = {
    "不锈钢": ["304", "316", "316L", "321", "310S", "SS304", "SS316"],
    "碳钢": ["CS", "WCB", "A105", "Q235", "20#", "45#"],
    "合金钢": ["A182F11", "A182F22", "Cr-Mo", "铬钼钢"],
    "铸铁": ["HT200", "HT250", "灰铸铁", "球墨铸铁"],
}
MATERIAL_PROPERTIES = {
    "不锈钢": {"耐腐蚀": "true", "耐高温": "true", "强度": "high"},
    "碳钢": {"强度": "medium", "成本": "low"},
    "合金钢": {"耐高温": "true", "强度": "high"},
    "铸铁": {"成本": "low", "加工性": "good"},
}
# (name, pattern, group); the last match in the text counts, case ignored.
SIZES = [
    ("DN", r"DN\s*([0-9]+)", 1),
    ("PN", rf"PN\s*({NUM})", 1),
    ("CL", r"CL\s*([0-9]+)", 1),
    ("diameter", r"φ\s*([0-9]+)", 1),
    ("length", r"([0-9]+)\s*x\s*([0-9]+)", 1),
    ("width", r"([0-9]+)\s*x\s*([0-9]+)", 2),
    ("thread_diameter", rf"M([0-9]+)\s*[x×]\s*({NUM})", 1),
    ("thread_pitch", rf"M([0-9]+)\s*[x×]\s*({NUM})", 2),
]
SIZE_WITH_UNIT = rf'({NUM})\s*(mm|cm|m|inch|")'
TO_MM = {"cm": 10.0, "m": 1000.0, "inch": 25.4, '"': 25.4}
SIZE_FIELDS = ["尺寸", "直径", "长度", "宽度", "高度", "size", "diameter"]
PRESSURES = [rf"PN\s*({NUM})", r"CL\s*([0-9]+)", rf"({NUM})\s*MPa", r"([0-9]+)\s*bar", r"([0-9]+)\s*psi"]
TEMPERATURE_FIELDS = ["使用温度", "工作温度", "温度范围", "temperature"]
TEMPERATURE_RANGE = rf"(-?{NUM})\s*[~～]\s*(-?{NUM})\s*℃"
TEMPERATURE_ONE = rf"(-?{NUM})\s*℃"
STANDARD_FIELDS = ["执行标准", "标准", "standard", "技术标准"]
STANDARDS = [
    r"GB/T\s*[0-9]+[-.]?[0-9]*", r"GB\s*[0-9]+[-.]?[0-9]*", r"ANSI\s*[A-Z]?[0-9]+[-.]?[0-9]*", r"API\s*[0-9]+[A-Z]?",
    r"ASME\s*[A-Z]?[0-9]+[-.]?[0-9]*", r"JIS\s*[A-Z]?[0-9]+[-.]?[0-9]*", r"DIN\s*[0-9]+[-.]?[0-9]*", r"HG/T\s*[0-9]+[-.]?[0-9]*",
]
TECH_FIELDS = ["流量", "扬程", "功率", "转速", "效率", "介质", "连接方式", "flow_rate", "head", "power", "speed", "efficiency", "media"]
TECH_PATTERNS = {
    "流量": rf"({NUM})\s*(m³/h|L/min|t/h)",
    "功率": rf"({NUM})\s*(kW|W|HP)",
    "转速": r"([0-9]+)\s*(r/min|rpm)",
}
NAME_STOP_WORDS = ["型", "式", "用", "专用", "通用", "标准", "特殊", "进口", "国产"]
SIGNATURE_ORDER = ["DN", "PN", "CL", "diameter", "length", "width"]
CLASS_TO_PN = {"CL150": "PN20", "CL300": "PN50", "CL600": "PN110", "CL900": "PN150", "CL1500": "PN260", "CL2500": "PN420"}
MAKER_SUFFIXES = ["有限公司", "股份有限公司", "集团", "厂", "公司", "Co.,Ltd", "Corp", "Inc"]
UNCLASSIFIED = "未分类"
# (family, level 1, level 2, keywords)
CATEGORIES = [
    ("阀门", "管道阀门", "控制阀门", ["阀", "球阀", "蝶阀", "闸阀", "止回阀", "减压阀", "安全阀", "疏水阀", "疏水器"]),
    ("管件", "管道连接件", "管道配件", ["管件", "弯头", "三通", "四通", "异径管", "封头", "法兰", "管帽"]),
    ("泵", "流体输送设备", "泵类设备", ["泵", "离心泵", "齿轮泵", "螺杆泵", "往复泵", "计量泵", "潜水泵"]),
    ("压缩机", "动力设备", "压缩设备", ["压缩机", "空压机", "制冷压缩机", "往复式压缩机", "离心式压缩机"]),
    ("密封件", "通用机械配件", "密封元件", ["密封", "垫片", "密封圈", "机械密封", "填料", "O型圈"]),
    ("轴承", "通用机械配件", "传动元件", ["轴承", "球轴承", "滚子轴承", "滑动轴承", "推力轴承"]),
    ("紧固件", "通用机械配件", "连接件", ["螺栓", "螺钉", "螺母", "垫圈", "销钉", "铆钉", "紧固件"]),
]
LEVEL3 = {
    "阀门": [(["球阀", "球形阀"], "球阀"), (["蝶阀", "蝶形阀"], "蝶阀"), (["闸阀", "闸板阀"], "闸阀"), (["疏水器", "疏水阀"], "疏水阀")],
    "管件": [(["弯头"], "弯头"), (["三通"], "三通"), (["法兰"], "法兰")],
}
