"""Quality dimensions, patterns, points, messages and grades."""

WEIGHTS = {"completeness": 0.25, "accuracy": 0.25, "consistency": 0.20, "richness": 0.15, "reliability": 0.15}
GRADES = [("A", 90), ("B", 75), ("C", 60), ("D", 0)]
REQUIRED = ["material_name", "specification"]
PREFERRED = ["manufacturer", "material_type", "unit"]
BONUS = ["model", "brand", "technical_parameters"]
LEGAL_NAME = r"^[A-Za-z0-9\x{4e00}-\x{9fa5}\s\-_]+$"
TEST_NAME = r"(^|[^\p{L}\p{N}_])(测试|test|temp|临时)([^\p{L}\p{N}_]|$)"
SPEC_PATTERNS = [r"[0-9]+", r"(?i)(PN|压力|pressure)\s*[0-9]+", r"(?i)(材质|material|材料)[:：]?\s*[\p{L}\p{N}_]+"]
STANDARD_UNITS = ["个", "台", "套", "m", "kg", "l", "米", "千克", "升", "pcs", "set", "pc"]
PLAIN_BRACKETS = ["【】", "[]", "()"]
ODD_SYMBOLS = ["~", "～", "※", "★", "●"]
TECH_WORDS = ["DN", "PN", "材质", "压力", "温度", "精度", "型号", "规格"]
ADDITIONAL = ["model", "brand", "technical_parameters", "application", "notes"]
TRUSTED_SOURCES = ["ERP", "PLM", "PDM", "official", "正式系统"]
AGE_POINTS = [(30, 30), (90, 20), (365, 10)]
APPROVED = ["approved", "已审核", "validated", "confirmed", "active"]

MISSING_REQUIRED = "缺少必填字段: {}"
BAD_NAME = "物料名称格式不规范"
BAD_SPEC = "规格参数信息不完整或格式不规范"
NO_OVERLAP = "物料名称与规格信息缺乏一致性"
ODD_FIELD = "{}字段包含非标准符号"
NO_SOURCE = "缺少数据来源信息"
NO_STATUS = "缺少验证状态信息"

FILL_REQUIRED = "请补充{}信息"
FILL_PREFERRED = "建议补充{}信息以提高完整性"
FIX_NAME = "请检查物料名称格式，确保使用标准命名规则"
FIX_SPEC = "建议补充详细的技术规格参数"
SHORT_MAKER = "制造商信息过于简略，建议提供完整厂商名称"
FIX_OVERLAP = "确保物料名称与规格描述相互呼应"
FIX_UNIT = '单位"{}"建议使用标准单位'
MORE_DETAIL = "建议补充更详细的技术参数和应用信息"
TOO_SIMPLE = "信息过于简单，建议丰富物料描述"
CHECK_SOURCE = "数据来源需要进一步验证"
NAME_SOURCE = "请标明数据来源系统"
OLD_DATA = "数据更新时间较久，建议重新验证"
BAD_TIME = "更新时间格式不正确"
FINISH_REVIEW = "建议完成正式审核流程"
FILL_STATUS = "请补充审核验证状态"

LOW_AVERAGE = ["整体数据质量较低，建议建立数据质量管理流程", "重点关注数据完整性和准确性改进"]
MANY_POOR = "超过30%的物料质量等级为D，需要紧急改进"
POOR_LIMIT = 0.3
BY_ISSUE = [
    ("缺少必填字段", "建立数据录入规范，确保必填字段完整性"),
    ("格式不规范", "制定并执行标准化的数据格式规范"),
    ("信息过于简单", "鼓励录入更详细的技术参数和描述信息"),
]
CLASSIFICATION_WEIGHT, QUALITY_WEIGHT = 0.6, 0.4
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 0.8, 0.6
