"""Material grades as (keyword, weight, category, grade, aliases)."""

GRADES = [
    ("304", 0.9, "不锈钢", "A", ["304SS", "304不锈钢", "0Cr18Ni9"]),
    ("316", 0.95, "不锈钢", "A+", ["316SS", "316不锈钢", "0Cr17Ni12Mo2"]),
    ("316L", 0.95, "不锈钢", "A+", ["316LSS", "316L不锈钢", "00Cr17Ni14Mo2"]),
    ("321", 0.9, "不锈钢", "A", ["321SS", "321不锈钢", "0Cr18Ni10Ti"]),
    ("310S", 0.88, "不锈钢", "A", ["310SSS", "310S不锈钢"]),
    ("904L", 0.92, "不锈钢", "A+", ["904LSS", "904L不锈钢"]),
    ("不锈钢", 0.8, "不锈钢", "B+", ["SS", "stainless steel"]),
    ("20#", 0.85, "碳钢", "A-", ["20号钢", "20钢", "20#钢"]),
    ("Q235", 0.8, "碳钢", "B+", ["Q235A", "Q235B", "Q235C"]),
    ("A105", 0.85, "碳钢", "A-", ["ASTM A105", "A105锻件"]),
    ("A182", 0.85, "碳钢", "A-", ["ASTM A182", "A182锻件"]),
    ("碳钢", 0.75, "碳钢", "B", ["CS", "carbon steel", "普碳钢"]),
    ("黄铜", 0.75, "铜合金", "B", ["brass", "铜", "青铜"]),
    ("紫铜", 0.75, "铜合金", "B", ["copper", "纯铜", "T2"]),
    ("铝合金", 0.7, "铝合金", "B-", ["aluminum", "铝", "AL"]),
    ("钛合金", 0.9, "钛合金", "A", ["titanium", "钛", "Ti"]),
    ("镀锌", 0.7, "表面处理", "B", ["galvanized", "热镀锌", "电镀锌"]),
    ("镀镍", 0.65, "表面处理", "B-", ["nickel plated", "电镀镍"]),
    ("阳极氧化", 0.65, "表面处理", "B-", ["anodized", "氧化处理"]),
    ("涂塑", 0.6, "表面处理", "C+", ["plastic coated", "塑料涂层"]),
]
CONTEXT_WORDS = ["不锈钢", "钢", "合金", "金属", "材质"]
MODIFIERS = [
    ["优质", "精密", "高强度", "耐腐蚀", "防锈", "加厚", "标准", "非标", "定制"],
    ["国标", "美标", "欧标", "日标", "德标", "英标"],
    ["内六角", "外六角", "十字", "一字", "梅花"],
]
GRADE_BONUS = {"A+": 0.15, "A": 0.12, "A-": 0.08, "B+": 0.08}
OTHER_GRADE_BONUS = 0.05
CATEGORY_BONUS = [
    ("不锈钢", ["疏水阀", "法兰", "阀门", "管道配件", "接头"], 0.1),
    ("碳钢", ["紧固件", "螺栓", "螺母", "垫片"], 0.08),
]
MAX_BONUS = 0.3
