"""Words, patterns and units that point to an industry."""

INDICATORS = {
    "manufacturing": {
        "keywords": [
            "阀门", "管道", "法兰", "泵", "压缩机", "轴承", "密封", "螺栓", "疏水器", "疏水阀", "弯头", "三通", "异径管", "封头",
            "管件", "球阀", "蝶阀", "闸阀", "止回阀", "减压阀", "安全阀", "离心泵", "齿轮泵", "螺杆泵", "往复泵", "计量泵",
            "压缩机配件", "机械密封", "填料", "垫片", "紧固件",
        ],
        "patterns": [
            r"DN\s*[0-9]+", r"PN\s*[0-9]+", r"φ\s*[0-9]+", r"[0-9]+\.?[0-9]*\s*MPa", r"[0-9]+\.?[0-9]*\s*℃",
            r"CL\s*[0-9]+", r"M[0-9]+\*[0-9]+", r"G[0-9]+/[0-9]+",
        ],
        "units": ["mm", "MPa", "℃", "kg/h", "m³/h", "L/min", "个", "套", "台"],
        "markers": ["304", "316", "316L", "CS", "WCB", "CF8", "CF8M", "不锈钢", "碳钢"],
    },
    "medical": {
        "keywords": [
            "医疗器械", "药品", "手术", "诊断", "治疗", "一次性", "无菌", "注射器", "输液器", "导管", "血袋", "试剂", "耗材",
            "心电", "超声", "内镜", "监护", "呼吸机", "除颤器", "手术刀", "钳子", "镊子", "缝合线", "敷料", "绷带",
            "药物", "胶囊", "片剂", "注射液", "滴眼液", "软膏",
        ],
        "patterns": [
            r"规格.*[0-9]+ml", r"浓度.*[0-9]+%", r"批号.*[\p{L}\p{N}_]+", r"[0-9]+mg/ml", r"有效期.*[0-9]+",
            r"型号.*[\p{L}\p{N}_]+", r"Fr[0-9]+", r"[0-9]+G",
        ],
        "units": ["ml", "mg", "μg", "IU", "支", "盒", "瓶", "袋", "个"],
        "markers": ["I类", "II类", "III类", "处方药", "非处方药", "OTC"],
    },
}
KIND_WEIGHTS = {"keywords": 0.4, "patterns": 0.3, "units": 0.2, "markers": 0.1}
MIN_INDUSTRY_SCORE = 0.1
