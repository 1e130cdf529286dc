"""Item rows derived from the part table by fixed expressions both engines evaluate alike.

Words of a part name become a grade and a product noun, its size becomes a specification
text, so the rule tables meet records of the shape they were written for and the work
still grows with ``part``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.session import table


def _case(value: str, pairs: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " ELSE '' END"


FIRST, SECOND = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
GRADE = _case(FIRST, {"red": "304不锈钢", "old": "316L", "cold": "碳钢", "hot": "黄铜", "blue": "镀锌", "large": "Q235",
                      "new": "精密", "small": "20#"})
NOUN = _case(SECOND, {"bolt": "螺栓", "gear": "疏水器", "ring": "密封垫片", "anvil": "球阀", "plate": "带颈对焊法兰",
                      "rod": "金属软管", "widget": "三通", "gizmo": "离心泵"})
CATEGORY = _case(SECOND, {"bolt": "紧固件", "gear": "疏水阀", "ring": "密封件", "anvil": "球阀", "plate": "法兰",
                          "rod": "管道配件", "widget": "管道配件", "gizmo": "工业泵配件"})
SPEC = """CASE p_size % 6
 WHEN 0 THEN 'DN' || p_size || ' PN16 304SS'
 WHEN 1 THEN 'φ ' || p_size || 'x2mm 20#'
 WHEN 2 THEN 'M' || p_size || 'x1.5 CL150 100-180℃ A105 GB/T ' || (p_size + 9000)
 WHEN 3 THEN 'DN ' || p_size || ' 1.6MPa L=' || p_size || 'm 材质CS 压力16 精度'
 WHEN 4 THEN '型号' || 'AB' || (p_size + 100) || ' ' || p_size || 'cm 220V 500W 流量' || p_size || 'm³/h 2900r/min 30kW'
 ELSE '' END"""
UNIT = "CASE p_size % 4 WHEN 0 THEN '个' WHEN 1 THEN '台' WHEN 2 THEN '根' ELSE 'PCS' END"
MAKER = "CASE WHEN p_size % 7 = 0 THEN '' ELSE replace(p_brand, '#', '') || '阀门有限公司' END"
SOURCE = "CASE p_partkey % 4 WHEN 0 THEN 'ERP' WHEN 1 THEN 'PLM' WHEN 2 THEN 'WMS' ELSE '' END"

ITEM_COLUMNS = {
    "code": "p_partkey",
    "name": f"{GRADE} || {NOUN}",
    "spec": SPEC,
    "unit": UNIT,
    "manufacturer": MAKER,
    "source": SOURCE,
    "type": "p_type",
    "category": CATEGORY,
    "size": "p_size",
}
ITEMS = "items AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in ITEM_COLUMNS.items()) + " FROM part)"

MED_NAME = _case(FIRST, {"red": "一次性", "old": "无菌", "cold": "医用", "hot": "", "blue": "进口", "large": "复方", "new": "",
                         "small": "小儿"}) + " || " + _case(SECOND, {
    "bolt": "注射器", "gear": "阿司匹林胶囊", "ring": "CT球管", "anvil": "乙肝疫苗", "plate": "红霉素软膏", "rod": "心电图机",
    "widget": "人工关节", "gizmo": "氯化钠注射液"})
MED_SPEC = """CASE p_size % 5 WHEN 0 THEN p_size || 'mg/ml 10支/盒' WHEN 1 THEN p_size || 'ml'
 WHEN 2 THEN '0.9% 250ml/瓶' WHEN 3 THEN p_size || 'mg*24粒/盒 2026-12-31' ELSE '' END"""
MED_CLASS = "CASE p_size % 5 WHEN 0 THEN 'I类' WHEN 1 THEN 'II类' WHEN 2 THEN 'III类' WHEN 3 THEN '处方药' ELSE '' END"
MED_REG = "CASE p_size % 3 WHEN 0 THEN '国械注准' || (20200000 + p_partkey) WHEN 1 THEN '国药准字H' || (19990000 + p_partkey) ELSE '' END"
MED_USE = """CASE p_size % 4 WHEN 0 THEN '用于高血压' WHEN 1 THEN '感冒咳嗽' WHEN 2 THEN '细菌感染' ELSE '' END"""
MED_COLUMNS = {
    "code": "p_partkey",
    "name": MED_NAME,
    "spec": MED_SPEC,
    "class": MED_CLASS,
    "note": MED_REG,
    "indication": MED_USE,
    "manufacturer": "replace(p_brand, '#', '') || '制药有限公司'",
}
MED_ITEMS = "med AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in MED_COLUMNS.items()) + " FROM part)"


def items(spark, d) -> DataFrame:
    return table(spark, d, "part").select(*[F.expr(e).alias(c) for c, e in ITEM_COLUMNS.items()])


def med_items(spark, d) -> DataFrame:
    return table(spark, d, "part").select(*[F.expr(e).alias(c) for c, e in MED_COLUMNS.items()])
