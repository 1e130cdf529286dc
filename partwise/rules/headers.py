"""Header synonyms per standard field."""

STANDARD_FIELDS = [
    "material_id", "material_name", "specification", "manufacturer", "standard_code", "category", "unit", "brand",
]
REQUIRED_FIELDS = ["material_name", "specification", "manufacturer"]

TEMPLATES = {
    "medical_device": {
        "material_name": ["产品名称", "商品名称", "器械名称", "设备名称", "物料名称"],
        "specification": ["产品规格", "规格型号", "技术参数", "型号", "规格"],
        "manufacturer": ["生产厂家", "制造商", "厂家名称", "供应商", "生产商"],
        "material_id": ["商品操作码", "物料编码", "产品编码", "资产代码", "设备编码"],
        "standard_code": ["医保代码", "医保码", "注册证号", "标准编码"],
    },
    "office_supplies": {
        "material_name": ["物品名称", "产品名称", "商品名称", "物料名称"],
        "specification": ["规格", "型号", "尺寸", "规格型号"],
        "manufacturer": ["品牌", "厂家", "制造商", "供应商"],
        "material_id": ["商品编码", "物料编码", "产品ID"],
    },
}

TRAINING_HEADERS = [
    ("material_code", ["编号", "code", "id", "代码"]),
    ("material_name", ["名称", "name", "物料名"]),
    ("brand", ["品牌", "brand", "厂家", "生产商", "manufacturer"]),
    ("specification", ["规格", "spec", "型号", "specification"]),
    ("category", ["分类", "category", "类别"]),
]

INDUSTRY_HEADERS = {
    "manufacturing": [
        ("material_name", ["名称", "name", "物料名", "产品名", "商品名", "品名"]),
        ("specification", ["规格", "spec", "型号", "参数", "尺寸", "技术参数"]),
        ("manufacturer", ["厂家", "制造商", "生产厂家", "manufacturer", "品牌"]),
        ("category", ["分类", "类别", "category", "物料分类"]),
    ],
    "medical": [
        ("material_name", ["器械名称", "药品名称", "产品名称", "name", "商品名"]),
        ("specification", ["规格", "型号", "浓度", "剂量", "容量"]),
        ("manufacturer", ["生产企业", "制造商", "厂家", "药厂"]),
        ("category", ["分类", "类别", "器械分类", "药品分类"]),
    ],
    "generic": [
        ("material_name", ["名称", "name"]),
        ("specification", ["规格", "spec"]),
        ("manufacturer", ["厂家", "manufacturer"]),
        ("category", ["分类", "category"]),
    ],
}
