"""Vocabulary of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed vocabulary of labels and relationship types, what other spellings stand
# for, which labels a type may join, and names too general to be entities.
LABELS = (
    "Company",
    "Plant",
    "Unit",
    "Equipment",
    "Material",
    "Product",
    "Process",
    "Parameter",
    "Risk",
    "Standard",
    "Operation",
    "Procedure",
    "Condition",
    "Measure",
    "Cause",
    "Fault",
    "Phenomenon",
    "ControlAction",
    "Purpose",
    "Document",
)

TYPES = (
    "OWNS",
    "HAS_UNIT",
    "USES_MATERIAL",
    "HAS_COMPONENT",
    "USES_PROCESS",
    "PRODUCES",
    "HAS_EQUIPMENT",
    "CONTROLS",
    "USED_FOR",
    "HAS_RISK",
    "COMPLIES_WITH",
    "HAS_PARAMETER",
    "HAS_QUALITY_INDEX",
    "HAS_RANGE",
    "OPERATES_AT",
    "HAS_CONDITION",
    "REQUIRES",
    "HAS_STEP",
    "PRECEDES",
    "CAUSES",
    "AFFECTS",
    "MITIGATED_BY",
    "MONITORS",
    "LOCATED_IN",
    "PART_OF",
    "REFERS_TO",
)

LABEL_ALIASES = {
    "corporation": "Company",
    "enterprise": "Company",
    "factory": "Plant",
    "installation": "Plant",
    "facility": "Plant",
    "device": "Equipment",
    "instrument": "Equipment",
    "machine": "Equipment",
    "feed": "Material",
    "raw_material": "Material",
    "intermediate": "Material",
    "finished_product": "Product",
    "technology": "Process",
    "procedure": "Procedure",
    "step": "Operation",
    "control_action": "ControlAction",
    "operating_condition": "Condition",
    "fault": "Fault",
    "hazard": "Risk",
    "safety_measure": "Measure",
    "specification": "Standard",
    "company": "Company",
    "plant": "Plant",
    "unit": "Unit",
    "equipment": "Equipment",
    "material": "Material",
    "product": "Product",
    "process": "Process",
    "parameter": "Parameter",
    "risk": "Risk",
    "standard": "Standard",
    "operation": "Operation",
    "condition": "Condition",
    "measure": "Measure",
    "cause": "Cause",
    "phenomenon": "Phenomenon",
    "document": "Document",
    "企业": "Company",
    "公司": "Company",
    "工厂": "Plant",
    "厂区": "Plant",
    "装置": "Unit",
    "单元": "Unit",
    "设备": "Equipment",
    "仪表": "Equipment",
    "物料": "Material",
    "原料": "Material",
    "产品": "Product",
    "工艺": "Process",
    "流程": "Process",
    "参数": "Parameter",
    "指标": "Parameter",
    "风险": "Risk",
    "危险": "Risk",
    "标准": "Standard",
    "规范": "Standard",
    "操作": "Operation",
    "步骤": "Procedure",
    "条件": "Condition",
    "措施": "Measure",
    "原因": "Cause",
    "现象": "Phenomenon",
    "文档": "Document",
}

TYPE_ALIASES = {
    "own": "OWNS",
    "owns": "OWNS",
    "has_unit": "HAS_UNIT",
    "contains_unit": "HAS_UNIT",
    "uses_material": "USES_MATERIAL",
    "uses_feed": "USES_MATERIAL",
    "has_component": "HAS_COMPONENT",
    "contains_component": "HAS_COMPONENT",
    "composed_of": "HAS_COMPONENT",
    "contains": "HAS_COMPONENT",
    "uses_process": "USES_PROCESS",
    "produces": "PRODUCES",
    "has_equipment": "HAS_EQUIPMENT",
    "contains_equipment": "HAS_EQUIPMENT",
    "controls": "CONTROLS",
    "controls_parameter": "CONTROLS",
    "used_for": "USED_FOR",
    "has_risk": "HAS_RISK",
    "complies_with": "COMPLIES_WITH",
    "has_parameter": "HAS_PARAMETER",
    "has_quality_index": "HAS_QUALITY_INDEX",
    "has_index": "HAS_QUALITY_INDEX",
    "has_range": "HAS_RANGE",
    "range": "HAS_RANGE",
    "operates_at": "OPERATES_AT",
    "has_condition": "HAS_CONDITION",
    "requires": "REQUIRES",
    "has_step": "HAS_STEP",
    "precedes": "PRECEDES",
    "causes": "CAUSES",
    "affects": "AFFECTS",
    "mitigated_by": "MITIGATED_BY",
    "monitors": "MONITORS",
    "located_in": "LOCATED_IN",
    "refers_to": "REFERS_TO",
    "属于": "PART_OF",
    "包含": "HAS_UNIT",
    "使用物料": "USES_MATERIAL",
    "含有": "HAS_COMPONENT",
    "组成为": "HAS_COMPONENT",
    "组成": "HAS_COMPONENT",
    "主要组分": "HAS_COMPONENT",
    "采用工艺": "USES_PROCESS",
    "生产": "PRODUCES",
    "具有设备": "HAS_EQUIPMENT",
    "控制": "CONTROLS",
    "用于": "USED_FOR",
    "存在风险": "HAS_RISK",
    "符合": "COMPLIES_WITH",
    "具有参数": "HAS_PARAMETER",
    "质量指标": "HAS_QUALITY_INDEX",
    "指标": "HAS_QUALITY_INDEX",
    "范围": "HAS_RANGE",
    "运行于": "OPERATES_AT",
    "需要": "REQUIRES",
    "导致": "CAUSES",
    "影响": "AFFECTS",
    "通过措施缓解": "MITIGATED_BY",
    "监测": "MONITORS",
    "位于": "LOCATED_IN",
}

TYPE_ENDS = {
    "OWNS": (("Company",), ("Plant", "Unit",)),
    "HAS_UNIT": (("Company", "Plant", "Unit",), ("Unit", "Process",)),
    "USES_MATERIAL": (("Plant", "Unit", "Process", "Operation",), ("Material",)),
    "HAS_COMPONENT": (("Material", "Product",), ("Material", "Product",)),
    "USES_PROCESS": (("Plant", "Unit",), ("Process",)),
    "PRODUCES": (("Plant", "Unit", "Process",), ("Product", "Material",)),
    "HAS_EQUIPMENT": (("Plant", "Unit", "Process",), ("Equipment",)),
    "CONTROLS": (("Equipment", "Unit", "Process", "Operation", "ControlAction",), ("Parameter", "Condition",)),
    "USED_FOR": (("Equipment", "Material", "Product", "Process", "Operation",), ("Process", "Product", "Unit", "Purpose",)),
    "HAS_RISK": (("Plant", "Unit", "Equipment", "Process", "Operation", "Material",), ("Risk", "Fault",)),
    "COMPLIES_WITH": (("Company", "Plant", "Unit", "Process", "Operation", "Equipment",), ("Standard",)),
    "HAS_PARAMETER": (("Plant", "Unit", "Equipment", "Process", "Operation",), ("Parameter",)),
    "HAS_QUALITY_INDEX": (("Material", "Product",), ("Parameter",)),
    "HAS_RANGE": (("Parameter", "Condition",), ("Condition", "Parameter",)),
    "OPERATES_AT": (("Plant", "Unit", "Equipment", "Process",), ("Parameter", "Condition",)),
    "HAS_CONDITION": (("Process", "Operation", "Unit", "Equipment",), ("Condition",)),
    "REQUIRES": (("Process", "Operation", "Procedure", "Equipment",), ("Material", "Parameter", "Condition", "Equipment", "Measure",)),
    "HAS_STEP": (("Procedure", "Process", "Operation",), ("Operation", "Procedure",)),
    "PRECEDES": (("Operation", "Procedure", "Process",), ("Operation", "Procedure", "Process",)),
    "CAUSES": (("Cause", "Fault", "Condition", "Parameter", "Operation", "Process",), ("Fault", "Risk", "Phenomenon", "Condition",)),
    "AFFECTS": (("Parameter", "Condition", "Material", "Process", "Operation",), ("Process", "Product", "Equipment", "Parameter", "Condition", "Material", "Risk", "Phenomenon",)),
    "MITIGATED_BY": (("Risk", "Fault", "Phenomenon",), ("Measure", "Procedure", "Operation", "ControlAction",)),
    "MONITORS": (("Equipment", "Instrument", "ControlAction", "Operation",), ("Parameter", "Condition", "Phenomenon",)),
    "LOCATED_IN": (("Equipment", "Unit", "Process",), ("Unit", "Plant",)),
    "PART_OF": (("Unit", "Equipment", "Process", "Operation",), ("Unit", "Plant", "Process",)),
    "REFERS_TO": (("Document", "Standard", "Procedure",), ("Plant", "Unit", "Equipment", "Process", "Parameter", "Risk",)),
}

GENERIC_NAMES = (
    "公司",
    "企业",
    "装置",
    "设备",
    "系统",
    "工艺",
    "流程",
    "产品",
    "物料",
    "参数",
    "风险",
    "标准",
    "要求",
    "问题",
    "措施",
    "原因",
    "现象",
    "unit",
    "equipment",
    "process",
    "parameter",
    "risk",
    "standard",
)


def lookup(entries: dict) -> Column:
    """A dictionary as a literal map."""
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))
