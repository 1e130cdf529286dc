"""Medical fields, registration numbers, dosage forms and categories."""

NUM = r"[0-9]+(?:\.[0-9]+)?"
REGISTRATION_FIELDS = ["注册证号", "批准文号", "许可证号", "registration_no", "证号"]
REGISTRATIONS = [
    r"国械注准[0-9]+", r"国械注进[0-9]+", r"械字[0-9]+", r"准字[0-9]+", r"国药准字[A-Z][0-9]+", r"国药准字[HZS][0-9]+",
    r"国药试字[A-Z][0-9]+", r"进口药品注册证号[A-Z][0-9]+",
]
EXPIRY_FIELDS = ["有效期", "失效期", "过期时间", "expiry_date", "保质期"]
DATES = [r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{4}/[0-9]{2}/[0-9]{2}", r"[0-9]{4}\.[0-9]{2}\.[0-9]{2}", r"[0-9]{2}/[0-9]{2}/[0-9]{4}"]
FORM_FIELDS = ["剂型", "给药途径", "dosage_form"]
DOSAGE_FORMS = {
    "口服固体": ["片剂", "胶囊", "颗粒", "丸剂", "散剂"],
    "口服液体": ["口服液", "糖浆", "合剂", "酊剂"],
    "注射剂": ["注射液", "冻干粉针", "输液", "注射用粉"],
    "外用制剂": ["软膏", "乳膏", "凝胶", "贴剂", "喷雾剂"],
    "特殊剂型": ["栓剂", "吸入剂", "滴眼液", "鼻用制剂"],
}
CONCENTRATION_FIELDS = ["浓度", "含量", "规格", "concentration", "强度"]
HAS_CONCENTRATION = r"[0-9]+\s*(mg|μg|g|ml|%|IU)"
CONCENTRATIONS = [rf"{NUM}\s*mg/ml", rf"{NUM}\s*%", rf"{NUM}\s*mg", rf"{NUM}\s*μg", rf"{NUM}\s*IU"]
PACKAGE_FIELDS = ["包装规格", "包装", "装量", "package", "规格"]
HAS_PACKAGE = r"[0-9]+\s*(支|盒|瓶|袋|个|粒|ml)"
PACKAGES = [r"[0-9]+\s*支/盒", r"[0-9]+\s*粒/盒", r"[0-9]+\s*ml/瓶", r"[0-9]+\s*袋/盒"]
STANDARD_FIELDS = ["执行标准", "标准", "standard", "技术要求"]
STANDARDS = [
    r"YY/T\s*[0-9]+[-.]?[0-9]*", r"YY\s*[0-9]+[-.]?[0-9]*", r"GB/T\s*[0-9]+[-.]?[0-9]*", r"ISO\s*[0-9]+[-.]?[0-9]*",
    r"CE\s*[\p{L}\p{N}_]*", r"FDA\s*[\p{L}\p{N}_]*",
]
TYPE_FIELDS = ["产品类型", "器械类型", "药品类型", "type", "类别"]
TYPE_WORDS = [
    (["注射器", "输液", "导管", "敷料"], "一次性医疗用品"), (["心电", "超声", "监护"], "诊断设备"), (["片", "胶囊", "注射液"], "药品"),
]
UNKNOWN_TYPE = "未知类型"
CLASS_FIELDS = ["分类", "类别", "风险等级", "classification", "管理类别"]
# (words, label, level), the narrowest class first so that III is never read as I.
CLASSES = [
    (["III类", "三类"], "III类医疗器械", 3),
    (["II类", "二类"], "II类医疗器械", 2),
    (["I类", "一类"], "I类医疗器械", 1),
    (["非处方", "OTC"], "非处方药", 5),
    (["处方药", "Rx"], "处方药", 4),
]
CLASS_BY_NAME = [
    (["注射器", "体温计", "血压计"], "II类医疗器械"), (["呼吸机", "监护仪", "起搏器"], "III类医疗器械"), (["片剂", "胶囊", "注射液"], "处方药"),
]
UNCLASSIFIED = "未分类"
CLINICAL_FIELDS = ["用法用量", "不良反应", "药理作用", "药代动力学", "临床试验", "dosage", "side_effects", "pharmacology", "clinical_data"]
CLINICAL_ALIASES = {"用法用量": ["用法用量", "给药方案", "dosage"], "不良反应": ["不良反应", "副作用", "side_effects"]}
INDICATION_FIELDS = ["适应症", "用途", "功能主治", "indication", "应用"]
NAME_STOP_WORDS = ["一次性", "无菌", "医用", "临床", "专用", "型", "式", "进口", "国产"]
CONCENTRATION_PARTS = rf"({NUM})\s*([a-zA-Z/%μ]+)"
TO_MG = {"g": 1000.0, "mg": 1.0, "μg": 0.001, "mcg": 0.001}
MAKER_SUFFIXES = ["有限公司", "股份有限公司", "集团", "公司", "企业", "厂", "Co.,Ltd", "Corp", "Inc", "Ltd", "制药"]
THERAPEUTIC_AREAS = [
    ("心血管", ["高血压", "心脏病", "冠心病", "心律失常", "心衰"]),
    ("呼吸系统", ["哮喘", "肺炎", "支气管炎", "咳嗽", "感冒"]),
    ("消化系统", ["胃炎", "胃溃疡", "腹泻", "便秘", "肝炎"]),
    ("神经系统", ["头痛", "癫痫", "抑郁", "焦虑", "失眠"]),
    ("内分泌", ["糖尿病", "甲亢", "甲减", "骨质疏松"]),
    ("感染", ["细菌感染", "病毒感染", "真菌感染", "抗生素"]),
    ("肿瘤", ["癌症", "化疗", "肿瘤", "恶性", "良性"]),
    ("免疫", ["过敏", "免疫", "风湿", "关节炎"]),
]
CATEGORIES = [
    ("基础器械", "医疗器械", "基础医疗器械", ["手术刀", "镊子", "钳子", "剪刀", "针头", "注射器", "输液器"]),
    ("诊断器械", "医疗器械", "诊断设备", ["心电图", "超声", "内镜", "CT", "MRI", "血压计", "体温计", "血糖仪"]),
    ("治疗器械", "医疗器械", "治疗设备", ["呼吸机", "监护仪", "除颤器", "透析机", "激光治疗仪", "电刀"]),
    ("植入器械", "医疗器械", "植入物", ["支架", "起搏器", "人工关节", "假体", "植入材料"]),
    ("康复器械", "医疗器械", "康复辅助器具", ["轮椅", "助听器", "义肢", "矫形器", "理疗设备"]),
    ("一次性器械", "医疗器械", "一次性医疗用品", ["一次性", "无菌", "导管", "血袋", "敷料", "绷带", "口罩", "手套"]),
    ("处方药", "药品", "处方药", ["注射液", "胶囊", "片剂", "颗粒", "口服液", "栓剂"]),
    ("非处方药", "药品", "非处方药", ["OTC", "维生素", "感冒药", "止痛药", "消炎药"]),
    ("中药", "药品", "中药", ["中药", "中成药", "汤剂", "丸剂", "散剂", "膏药"]),
    ("生物制品", "药品", "生物制品", ["疫苗", "血液制品", "单克隆抗体", "重组蛋白", "细胞治疗"]),
    ("外用药", "药品", "外用药物", ["软膏", "乳膏", "凝胶", "溶液", "滴眼液", "滴耳液", "喷雾剂"]),
]
LEVEL3 = {
    "基础器械": [(["注射器"], "注射器械"), (["手术"], "手术器械")],
    "诊断器械": [(["心电"], "心电设备"), (["超声"], "超声设备")],
    "一次性器械": [(["输液"], "输液器具"), (["敷料"], "医用敷料")],
    "处方药": [(["注射液"], "注射剂"), (["片剂", "胶囊"], "口服制剂")],
}
